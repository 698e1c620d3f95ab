"""Streams and file sinks: order of arrival, appended lines, stages observed, named files."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, folds, outputs, state
from tidemark.sources import tail
from tidemark.streaming import blocks, monitor, ordered
from tidemark.streaming import state as streams


def land(spark, folder, parts, schema):
    """Files that a stream takes one by one, in this order."""
    os.makedirs(folder, exist_ok=True)
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp{n}")
        (name,) = [f for f in os.listdir(f"{folder}/tmp{n}") if f.endswith(".parquet")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp{n}/{name}", f"{folder}/in/{n}.parquet")
        os.utime(f"{folder}/in/{n}.parquet", (10**9 + n, 10**9 + n))
    return f"{folder}/in"


@pytest.mark.parametrize("lateness", [None, "3 minutes"])
def test_failure_runs_do_not_depend_on_order(spark, tmp_path, lateness):
    r, schema = random.Random(4), "proxy long, seq long, ok boolean, at timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=10 * s)
    rows = [(p, s, r.random() > (0.9 if p == 3 else 0.5), at(s)) for p in range(4) for s in range(60)]
    parts = [[x for x in rows if x[1] // 10 == k] for k in (1, 0, 3, 2, 5, 4)]
    source = land(spark, str(tmp_path), parts, schema)
    found = streams.drain(ordered.failure_runs(streams.read_files(spark, source, schema, per_trigger=1), 2, lateness), str(tmp_path / "out"), str(tmp_path / "cp"), "update", ["proxy"])
    events = spark.createDataFrame(rows, schema)
    last = state.consecutive_failures(events, ["proxy"], F.col("ok"), ["seq"], 2).groupBy("proxy").agg(F.max_by(F.struct("consecutive", "failures", "unhealthy"), "seq").alias("l")).select("proxy", "l.*")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, last.collect()))


def test_blocks_do_not_depend_on_how_cues_are_cut(spark, tmp_path):
    r, schema = random.Random(9), "video_id string, pos int, start_ms long, end_ms long, text string"
    cues, at = [], 0
    for v in ("a", "b"):
        at = 0
        for pos in range(1, 41):
            at += r.choice([100, 100, 2000])
            text = r.choice(["some words", "an end.", "more of it, and more", "", " 好。 ", "x" * 60])
            cues.append((v, pos, at, at + 500, text))
            at += 500
    shuffled = r.sample(cues, len(cues))
    source = land(spark, str(tmp_path), [shuffled[i : i + 20] for i in range(0, 80, 20)], schema)
    found = streams.drain(blocks.merged_blocks(streams.read_files(spark, source, schema, per_trigger=1), most_chars=80), str(tmp_path / "out"), str(tmp_path / "cp"), "update", ["video_id", "part"])
    batch = folds.merge_blocks(folds.block_parts(spark.createDataFrame(cues, schema), ["video_id"], most_chars=80), ["video_id"])
    same = ("video_id", "part", "start_ms", "end_ms", "text", "n_cues")
    assert sorted(map(tuple, found.select(*same).collect())) == sorted(map(tuple, batch.select(*same).collect()))
    assert 10 < batch.count() < 70


def test_lines_added_to_a_file_are_seen(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("one\ntwo\nhalf")
    (logs / "other.txt").write_text("not a log\n")

    def run(name, **options):
        lines = tail.tail(spark, str(logs), **options).select("file", "offset", "value")
        lines.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["file"], r["value"]) for r in spark.read.schema("file string, offset long, value string").parquet(str(tmp_path / name)).collect())

    assert run("all") == [("a.log", "one"), ("a.log", "two")]
    with open(logs / "a.log", "a") as f:
        f.write(" line\nthree\r\n\nlast")
    (logs / "b.log").write_text("new\n")
    assert run("all") == sorted([("a.log", x) for x in ("one", "two", "half line", "three", "")] + [("b.log", "new")])
    (logs / "b.log").write_text("x\n")  # rotated
    assert ("b.log", "x") in run("all")


def test_parts_of_a_long_file_hold_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "PART_BYTES", 7)
    monkeypatch.setattr(tail, "LOOK_BYTES", 3)
    text = "a\nbb\n\nccccccccccccccccccc\ndd\neeeeee\nf\nunfinished"
    (tmp_path / "x.log").write_text(text)
    reader = tail.TailReader(str(tmp_path), "*.log", "beginning")
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) > 4 and [v for p in parts for _, _, v in reader.read(p)] == text.split("\n")[:-1]
    assert [o for p in parts for _, o, _ in reader.read(p)] == [0, 2, 5, 6, 26, 29, 36]
    assert tail.TailReader(str(tmp_path), "*.log", "end").initialOffset() == reader.latestOffset()
    (tmp_path / "y.log").write_text("no end")
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_stages_are_observed(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k int, bad boolean"
    for n in range(3):
        spark.createDataFrame([(i, i % 3 == n) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(source)
    watcher = monitor.StageMonitor()
    spark.streams.addListener(watcher)
    first = monitor.observed(streams.read_files(spark, source, schema, per_trigger=1), "one", F.col("bad")).where("not bad")
    second = monitor.observed(first, "two", F.col("k") > 7, F.col("k") == 1)
    q = second.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert watcher.wait_for(q)
    spark.streams.removeListener(watcher)
    table = watcher.table(spark)
    assert table.count() == 6 and table.select("batch").distinct().count() == 3
    rows = spark.read.parquet(source)
    good = rows.where("not bad")
    got = {r["stage"]: (r["batches"], r["rows"], r["failed"], r["skipped"], r["passed"]) for r in monitor.stage_figures(table).collect()}
    failed, skipped = good.where("k > 7").count(), good.where("k = 1").count()
    assert got == {"one": (3, 30, rows.where("bad").count(), 0, good.count()), "two": (3, good.count(), failed, skipped, good.count() - failed - skipped)}
    assert watcher.flush(spark, str(tmp_path / "table")) == 6 and watcher.flush(spark, str(tmp_path / "table")) == 0
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


def files_below(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(path) for f in names}


def test_named_files(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"v{i % 3}/original.{i}.srt", f"text {i} é") for i in range(20)] + [("v0/none.txt", None)], "f string, content string").repartition(4)
    outputs.write_named(rows, path, F.col("f"))
    assert files_below(path) == {r["f"]: r["content"] or "" for r in rows.collect()}
    outputs.write_named(rows.withColumn("content", F.lit("other")), path, F.col("f"))
    assert files_below(path)["v1/original.1.srt"] == "text 1 é"  # what is there stays
    outputs.write_named(rows.limit(30).withColumn("content", F.lit("other")), path, F.col("f"), overwrite=True)
    assert set(files_below(path).values()) == {"other"}
    outputs.write_named(rows.limit(0), str(tmp_path / "none"), F.col("f"))
    assert not os.path.exists(tmp_path / "none") or files_below(tmp_path / "none") == {}


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"f{i}.txt", "x") for i in range(30)] + [("../outside.txt", "x")], "f string, content string").repartition(4)
    with pytest.raises(Exception, match="not a file below the folder"):
        outputs.write_named(rows, path, F.col("f"))
    assert files_below(path) == {} and not (tmp_path / "outside.txt").exists()


def test_overlapping_cues(spark):
    r, schema = random.Random(2), "video_id string, pos int, start_ms long, end_ms long, text string"
    make = lambda n: [(v, i, s, s + r.choice([0, 300, 4000, 60000]), f"t{i}") for v in "ab" for i, s in enumerate(sorted(r.randrange(0, 90000) for _ in range(n)))]
    one, two = make(30), make(25)
    got = {(x["video_id"], x["pos"]): (x["other"], x["n_overlaps"]) for x in align.overlapping(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), bucket_ms=1000).collect()}
    for v, pos, s, e, _ in one:
        with_ = sorted((a, p, t) for w, p, a, b, t in two if w == v and s < b and a < e and s < e and a < b)
        assert got[v, pos] == (" ".join(t for *_, t in with_) or None, len(with_))


def test_merged_sketches_are_close(spark):
    r = random.Random(3)
    rows = [(f"s{i % 2}", i % 30, int(r.expovariate(0.001))) for i in range(20000)]
    took = spark.createDataFrame(rows, "stage string, day int, took long")
    kept = state.duration_sketches(took, ["stage", "day"])
    assert kept.count() == 30  # of a stage, each second day
    shares = [0.1, 0.5, 0.99]
    by_day = {x["stage"]: x["quantiles"] for x in state.merged_quantiles(kept, ["stage"], shares).collect()}
    at_once = {x["stage"]: x["quantiles"] for x in state.merged_quantiles(state.duration_sketches(took, ["stage"]), ["stage"], shares).collect()}
    for stage in ("s0", "s1"):
        values = sorted(t for s, _, t in rows if s == stage)
        for found in (by_day, at_once):
            for q, x in zip(shares, found[stage], strict=True):
                assert abs(sum(v <= x for v in values) / len(values) - q) < 0.02


def test_bilingual_files_are_paired_by_time(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\none\n\n2\n00:00:03,000 --> 00:00:04,000\ntwo\n\n3\n00:00:05,000 --> 00:00:06,000\nthree\n"
    gone = "1\n00:00:01,000 --> 00:00:02,000\nONE\n\n2\n00:00:05,000 --> 00:00:06,000\nTHREE\n"
    files = spark.createDataFrame([("v", "en", srt, None, None, None)], "video_id string, lang string, content string, summary string, summary_lang string, metadata string")
    made = {r["file"]: r["content"] for r in outputs.artifacts(files.select("video_id"), files, ["de"], lambda c, _: F.lit(gone)).collect()}
    entries = [e.strip("\n") for e in made["bilingual.en-de.srt"].split("\n\n")]
    assert entries == ["1\n00:00:01,000 --> 00:00:02,000\none\nONE", "2\n00:00:03,000 --> 00:00:04,000\ntwo", "3\n00:00:05,000 --> 00:00:06,000\nthree\nTHREE"]
