"""Readers, sinks, providers and streams over files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.operators import outputs, providers, state
from tidemark.sources import readers
from tidemark.streaming import ordered
from tidemark.streaming import state as streams


def test_readers(spark, tmp_path):
    (tmp_path / "log.txt").write_text("[2024-01-01 00:00:00.123] [INFO] [run:r] [task:t] [video:v] hi\nbroken\n")
    row = readers.read_log(spark, str(tmp_path / "log.txt")).first()
    assert (row["level"], row["video_id"], row["message"]) == ("INFO", "v", "hi")
    (tmp_path / "f.jsonl").write_text('{"video_id":"a","url":"u","stage":"s","error_type":"auth","timestamp":"t"}\nbroken\n')
    assert [r["video_id"] for r in readers.read_failures(spark, str(tmp_path / "f.jsonl")).collect()] == ["a"]
    (tmp_path / "urls.txt").write_text(" a \n\nb\na\n")
    assert sorted(r["url"] for r in readers.read_url_list(spark, str(tmp_path / "urls.txt")).collect()) == ["a", "a", "b"]
    (tmp_path / "items.jsonl").write_text('{"video_id":"x","channel_id":""}\n{"_type":"playlist","video_id":"p"}\n{"title":"no id"}\n')
    rows = readers.read_items(spark, str(tmp_path / "items.jsonl")).collect()
    assert [(r["video_id"], r["channel_id"], r["url"][-3:]) for r in rows] == [("x", None, "v=x")]
    (tmp_path / "b.manifest.json").write_text(json.dumps({"batch_id": "b", "videos": {"v1": {"stage": "done"}, "v2": {"stage": "failed", "error_type": "AUTH"}}}, indent=1))
    assert sorted((r["video_id"], r["stage"]) for r in readers.read_manifest(spark, str(tmp_path / "b.manifest.json")).collect()) == [("v1", "done"), ("v2", "failed")]


def test_archive_is_idempotent(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "video_id string")
    path = str(tmp_path / "archive")
    outputs.append_archive(items.where("video_id != 'c'"), path)
    done = state.read_archive(spark.read.text(path))
    left = state.unprocessed(items, done, "video_id")
    assert [r["video_id"] for r in left.collect()] == ["c"]
    assert state.unprocessed(items, done, "video_id", force=True).count() == 4


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("c1", "x"), ("c2", "y")], "channel string, content string")
    outputs.write_documents(docs, str(tmp_path / "out"), by=("channel",))
    assert sorted((r["channel"], r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()) == [("c1", "x"), ("c2", "y")]
    outputs.append_failures(spark.createDataFrame([("a", "")], "video_id string, reason string"), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).first()["value"] == '{"video_id":"a"}'


class Broken:
    def generate(self, prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return prompt[::-1]


def test_provider_errors_are_data(spark):
    providers.register("broken", Broken)
    rows = providers.call(spark.createDataFrame([("ab",), ("bad",), (None,)], "p string"), "broken", "p", concurrency=2)
    got = {r["p"]: (r["answer"], r["call_error"]) for r in rows.collect()}
    assert got == {"ab": ("ba", None), "bad": (None, "ValueError: no"), None: (None, None)}


def test_stream_processes_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "video_id string"
    run = lambda: streams.process_new(streams.read_files(spark, source, schema), str(tmp_path / "archive"), str(tmp_path / "out"), str(tmp_path / "cp"), "video_id", lambda df: df.withColumn("done", F.lit(True)))
    spark.createDataFrame([("a",), ("b",)], schema).write.parquet(source)
    run()
    spark.createDataFrame([("b",), ("c",)], schema).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r["video_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


class Short:
    def generate(self, prompt):
        if len(prompt) > 20 or "never" in prompt:
            raise ValueError("too long")
        return prompt.upper()


def test_bisecting(spark, tmp_path):
    providers.register("short", Short)
    rows = [(1, "\n\n".join(f"cue {i}" for i in range(9))), (2, "a"), (3, "cue 1\n\nnever\n\n" + "cue " * 9)]
    got = providers.call_bisecting(spark.createDataFrame(rows, "k int, t string"), ["k"], "t", "short", str(tmp_path), least=5)
    assert {r["k"]: r["answer"] for r in got.collect()} == {1: "\n\n".join(f"CUE {i}" for i in range(9)), 2: "A", 3: None}


def test_items_are_limited_per_channel(spark, tmp_path):
    lines = [json.dumps({"video_id": f"v{c}{i}", "channel_id": f"c{c}", "upload_date": f"2024010{i}"}) for c in range(3) for i in range(5)]
    (tmp_path / "items.jsonl").write_text("\n".join(lines))
    assert readers.read_items(spark, str(tmp_path / "items.jsonl")).count() == 15
    kept = sorted(r["video_id"] for r in readers.read_items(spark, str(tmp_path / "items.jsonl"), most=2).collect())
    assert kept == ["v03", "v04", "v13", "v14", "v23", "v24"]


def test_items_by_url(spark, tmp_path):
    (tmp_path / "v").write_text('{"video_id":"aaaaaaaaaaa"}\n{"video_id":"bbbbbbbbbbb"}\n')
    (tmp_path / "c").write_text('{"video_id":"x","channel_id":"UC1"}\n{"video_id":"y","channel_id":"UC2"}\n')
    (tmp_path / "p").write_text('{"video_id":"z"}\n')
    landed = {"video": str(tmp_path / "v"), "channel": str(tmp_path / "c"), "playlist": str(tmp_path / "p")}
    ask = lambda *urls: sorted((r["url_type"], r["video_id"]) for r in readers.read_by_url(spark, spark.createDataFrame([(u,) for u in urls], "url string"), landed).collect())
    assert ask("https://youtu.be/aaaaaaaaaaa", "https://www.youtube.com/channel/UC2") == [("channel", "y"), ("video", "aaaaaaaaaaa")]
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "PLone.json").write_text('{"video_id":"z"}\n{"video_id":"y"}\n')
    (tmp_path / "lists" / "more.json").write_text('{"video_id":"z","playlist_id":"PLtwo"}\n{"video_id":"u","playlist_id":"PLtwo"}\n')
    landed["playlist"] = str(tmp_path / "lists")
    assert ask("https://www.youtube.com/playlist?list=PLone") == [("playlist", "y"), ("playlist", "z")]
    assert ask("https://www.youtube.com/playlist?list=PLtwo") == [("playlist", "u"), ("playlist", "z")]
    assert ask("https://www.youtube.com/playlist?list=PLthree") == [] and len(ask("https://www.youtube.com/playlist?list=PLone", "https://www.youtube.com/playlist?list=PLtwo")) == 4


def test_archive_cleared_and_logs_listed(spark, tmp_path):
    outputs.append_archive(spark.createDataFrame([("a",)], "video_id string"), str(tmp_path / "archive"))
    outputs.clear_archive(spark, str(tmp_path / "archive"))
    assert spark.read.text(str(tmp_path / "archive")).count() == 0
    for name in ("app_1.log", "app_2.log", "b.txt"):
        (tmp_path / name).write_text("x")
    listed = readers.file_listing(spark, str(tmp_path), "*.log")
    assert [r["name"] for r in listed.collect()] == ["app_2.log", "app_1.log"]
    assert readers.outdated(listed, F.current_timestamp()).count() == 0
    assert readers.outdated(listed, F.current_timestamp() + F.expr("interval 15 days")).count() == 2


def test_manifests_written_and_read(spark, tmp_path):
    from tidemark.operators import batches

    updates = spark.createDataFrame([("b", "v1", 1, "pending", None, "t1"), ("b", "v1", 3, "failed", "AUTH", "t3"), ("b", "v1", 2, "done", None, "t2"), ("b", "v2", 1, "done", None, "t1"), ("c", "v3", 1, "done", None, "t1")], "batch_id string, video_id string, seq int, stage string, error_type string, at string")
    batches.write_manifests(batches.manifest(updates), str(tmp_path / "m"))
    got = sorted((r["video_id"], r["stage"], r["error_type"], r["started_at"], r["updated_at"]) for r in readers.read_manifest(spark, str(tmp_path / "m")).collect())
    assert got == [("v1", "failed", "AUTH", "t1", "t3"), ("v2", "done", None, "t1", "t1"), ("v3", "done", None, "t1", "t1")]


def test_bisecting_cuts_at_sentences(spark, tmp_path):
    """The cut is folds.split_points()'s; no chunk is given up for the number of its parts."""
    cues_ = [f"{i}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},500\nword {i}{'.' if i % 3 == 0 else ''}" for i in range(1, 12)]
    entries = spark.createDataFrame([("\n\n".join(cues_),)], "t string").select(F.split("t", "\n\n").alias("e"))
    from tidemark.operators import folds

    rows = spark.createDataFrame([(1, i, f"word {i}{'.' if i % 3 == 0 else ''}") for i in range(1, 12)], "k int, pos int, text string")
    assert entries.select(providers._better_half(F.col("e")).alias("h")).first()["h"] == folds.split_points(rows, ["k"]).first()["split_at"]

    class One:
        def generate(self, prompt):
            if "\n\n" in prompt:
                raise ValueError("one at a time")
            return prompt.upper()

    providers.register("one", One)
    many = "\n\n".join(f"cue {i}" for i in range(70))
    got = providers.call_bisecting(spark.createDataFrame([(1, many)], "k int, t string"), ["k"], "t", "one", str(tmp_path / "b"), least=1).first()["answer"]
    assert got == many.upper()


def test_drain_keeps_keys_of_all_batches(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "proxy long, seq long, ok boolean"
    for rows in ([(1, 1, False), (1, 2, False), (2, 3, True)], [(2, 4, False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    found = streams.drain(ordered.failure_runs(streams.read_files(spark, source, schema, per_trigger=1), 2), str(tmp_path / "out"), str(tmp_path / "cp"), "update", ["proxy"])
    assert sorted((r["proxy"], r["consecutive"], r["unhealthy"]) for r in found.collect()) == [(1, 2, True), (2, 1, False)]
    stages = streams.latest_stage(streams.read_files(spark, source, schema, per_trigger=1).select(F.col("proxy").alias("video_id"), F.col("ok").cast("string").alias("stage"), "seq"))
    assert streams.drain(stages, str(tmp_path / "out2"), str(tmp_path / "cp2")).count() == 2
    empty = str(tmp_path / "none")
    spark.createDataFrame([], schema).write.parquet(empty)
    assert streams.drain(ordered.failure_runs(streams.read_files(spark, empty, schema)), str(tmp_path / "out3"), str(tmp_path / "cp3"), "update", ["proxy"]).count() == 0


def test_tail_and_table_folders(spark, tmp_path):
    from tidemark.plans import QUERIES

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("[2024-01-01 00:00:00.123] [INFO] [run:r] [task:t] [video:v] hi\nbroken\n" * 2)
    found = streams.drain(streams.tail_log(spark.readStream.text(str(tmp_path / "logs"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r["task"], r["level"], r["n"]) for r in found.collect()] == [("t", "INFO", 2)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    same = lambda name: sorted(map(repr, QUERIES[name](spark, str(tmp_path / "sf")).collect())) == sorted(map(repr, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    assert same("stream_manifest")
