"""Runs: calls made once, chunks committed one by one, alternatives in order, errors that pass stages by."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fetching, providers, stages, translation


class Counting:
    """Puts a file down for each call; refuses prompts that hold `refuse`."""

    def __init__(self, folder: str, refuse: str = "never said", kind: str = "network"):
        self.folder, self.refuse, self.kind = folder, refuse, kind

    def generate(self, prompt: str) -> str:
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        if self.refuse in prompt:
            raise RuntimeError(f"{self.kind}: refused")
        return prompt.upper()


@pytest.fixture
def counted(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    providers.register("counting", lambda: Counting(str(folder)))
    providers.register("refusing", lambda: Counting(str(folder), "bad"))
    yield lambda: sorted((folder / f).read_text() for f in os.listdir(folder))
    del providers.PROVIDERS["counting"], providers.PROVIDERS["refusing"]


def test_calls_are_made_once(spark, tmp_path, counted):
    rows = spark.createDataFrame([(i, f"prompt {i % 4}") for i in range(40)] + [(99, None), (100, "bad one"), (101, "")], "id int, p string").repartition(5)
    cache = str(tmp_path / "cache")
    got = {r["id"]: r for r in translation.call_once(rows, "refusing", "p", cache, tries=2).collect()}
    assert len(got) == 43 and got[5]["answer"] == "PROMPT 1" and got[99]["answer"] is None and got[99]["call_error"] is None
    assert got[100]["answer"] is None and got[100]["call_error"] == "RuntimeError: network: refused" and got[101]["answer"] == ""
    assert counted() == sorted(["", "bad one", "bad one", *[f"prompt {k}" for k in range(4)]])  # the refused one was tried twice
    result = translation.call_once(rows, "refusing", "p", cache, tries=1)
    assert result.count() == result.count() == 43
    assert len(counted()) == 8  # only the refused one again
    assert translation.call_once(rows, "counting", "p", cache).where("answer is not null").count() == 42  # another provider, other calls
    assert len(counted()) == 14
    assert translation.call_once(rows.limit(0), "counting", "p", str(tmp_path / "none")).count() == 0 and len(counted()) == 14


def test_translate_driver_makes_no_call_twice(spark, tmp_path, counted):
    targets = spark.createDataFrame([(v, t) for v in "abcde" for t in ("de", "zh-CN")], "video_id string, target string")
    existing = spark.createDataFrame([("a", "de", "old")], "video_id string, target string, content string")
    official = spark.createDataFrame([("a", "de", "track"), ("b", "de", "track")], "video_id string, target string, content string")
    sources = spark.createDataFrame([("a", "en", "same text"), ("b", "en", "same text"), ("c", "en", "a bad text"), ("e", "fr", "autre")], "video_id string, lang string, content string")
    run = lambda **more: {(r["video_id"], r["target"]): (r["how"], r["error_type"]) for r in translation.translate(targets, existing, official, sources, "refusing", str(tmp_path / "cache"), **more).collect()}
    got = run()
    assert got["a", "de"] == ("existing", None) and got["b", "de"] == ("official", None) and got["d", "de"] == ("no_source", None)
    assert got["a", "zh-CN"] == got["b", "zh-CN"] == got["e", "de"] == ("called", None) and got["c", "de"] == ("failed", "network")
    made = len(counted())
    assert made == 3 + 2 * 3  # a and b share one call; two refused ones are tried three times
    assert run(strategy="official_only")["e", "de"] == ("none", None) and len(counted()) == made
    assert run(force=True)["a", "de"] == ("official", None) and len(counted()) == made + 6
    good = sources.where("video_id <> 'c'")
    again = translation.translate(targets, existing, official, good, "refusing", str(tmp_path / "cache"))
    assert again.count() == 10 and len(counted()) == made + 6


def test_a_cut_run_of_chunks_calls_the_other_half(spark, tmp_path, counted):
    chunks = spark.createDataFrame([(f"v{v}", i, f"v{v} part {i}") for v in range(6) for i in range(8)], "video_id string, chunk_index int, content string").repartition(3)
    state = str(tmp_path / "state")
    first = translation.translate_chunks(chunks, ["video_id"], "counting", state, waves=4, upto=2, bisect=False)
    half = counted()
    assert 10 < len(half) < 38 and first.count() == 0
    report = {r["video_id"]: r for r in translation.chunk_milestones(chunks, ["video_id"], state).collect()}
    assert sum(r["completed"] for r in report.values()) == len(half)
    assert all(r["milestone"] == int(r["percent"] // 25) * 25 and r["total"] == 8 and r["failed"] == 0 for r in report.values())
    whole = {r["video_id"]: r["content"] for r in translation.translate_chunks(chunks, ["video_id"], "counting", state, waves=4, bisect=False).collect()}
    assert whole == {f"v{v}": "\n\n".join(f"V{v} PART {i}" for i in range(8)) for v in range(6)}
    assert len(counted()) == 48 and len(set(counted())) == 48
    changed = chunks.withColumn("content", F.when(F.expr("video_id = 'v1' and chunk_index = 3"), "new words").otherwise(F.col("content")))
    assert translation.translate_chunks(changed, ["video_id"], "counting", state, bisect=False).where("content like '%NEW WORDS%'").count() == 1
    assert len(counted()) == 49


def test_a_chunk_that_fails_leaves_its_item_without_a_result(spark, tmp_path, counted):
    long = "\n\n".join(["00:01 --> 00:02\n" + "good words. " * 30] * 3)
    chunks = spark.createDataFrame([("a", 0, "fine"), ("a", 1, "bad"), ("b", 0, long), (None, 0, "no id")], "video_id string, chunk_index int, content string")
    got = {r["video_id"]: r["content"] for r in translation.translate_chunks(chunks, ["video_id"], "refusing", str(tmp_path / "state")).collect()}
    assert set(got) <= {"b", None} and got["b"] == long.upper()
    report = {r["video_id"]: r for r in translation.chunk_milestones(chunks, ["video_id"], str(tmp_path / "state")).collect()}
    assert (report["a"]["completed"], report["a"]["failed"], report["a"]["milestone"]) == (1, 1, 50)


def test_fetches_take_the_next_alternative(spark):
    videos = spark.createDataFrame([("a", "en"), ("b", "de"), ("c", None), ("d", "en")], "video_id string, source_lang string")
    tracks = spark.createDataFrame([("a", "fr", False, 0), ("a", "en-GB", True, 1), ("a", "de", True, 2), ("b", "de", False, 0), ("b", "ja", True, 1), ("c", "it", False, 0)], "video_id string, lang string, is_auto boolean, pos int")
    targets = spark.createDataFrame([(v, t) for v in "abcd" for t in ("zh-CN", "en")], "video_id string, target string")
    plan = fetching.fetch_plan(videos, tracks, targets)
    assert plan.where("video_id = 'd'").count() == 0
    rows = {(r["video_id"], r["item"], r["place"]): (r["lang"], r["way"], r["file"]) for r in plan.collect()}
    assert [rows["a", "original", i][1] for i in range(3)] == ["manual", "auto", "url"]
    assert [rows["a", "zh-CN", i] for i in range(3)] == [("en-GB", "auto", "translated.en-GB.srt"), ("de", "auto", "translated.de.srt"), ("fr", "manual", "translated.fr.srt")]
    assert rows["a", "en", 0] == ("en-GB", "auto", "translated.en.srt") and ("a", "en", 1) not in rows and ("c", "en", 0) not in rows
    outcomes = spark.createDataFrame([("a", "en", "url", True), ("a", "en-GB", "auto", False), ("a", "de", "auto", True), ("b", "de", "manual", True)], "video_id string, lang string, way string, ok boolean")
    got = {(r["video_id"], r["item"]): tuple(r)[2:] for r in fetching.fetched(plan, outcomes).collect()}
    assert got["a", "original"] == (True, "original.en.srt", "en", "url", 3, ["en", "en"])
    assert got["a", "zh-CN"] == (True, "translated.de.srt", "de", "auto", 2, ["en-GB"])
    assert got["a", "en"] == (False, None, None, None, 1, ["en-GB"]) and got["b", "original"] == (True, "original.de.srt", "de", "manual", 1, [])


def test_failed_rows_pass_stages_by(spark, tmp_path, counted):
    items = spark.createDataFrame([(v,) for v in "abcdefg"], "video_id string")
    detections = spark.createDataFrame([("a", 2, None, None), ("b", 0, None, None), ("c", None, "ERROR: Connection reset by peer", False), ("d", 1, None, None), ("e", 3, None, None), ("g", 1, None, None)], "video_id string, n_tracks int, stderr string, timed_out boolean")
    archive = spark.createDataFrame([("d",), ("d",), ("x",)], "video_id string")
    fetched = spark.createDataFrame([("a", "original", True, "o.srt"), ("a", "de", True, "t.srt"), ("a", "fr", False, None), ("b", "original", True, "o.srt"), ("g", "original", True, "o.srt")], "video_id string, item string, ok boolean, file string")
    prompts = spark.createDataFrame([("a", "words"), ("b", "words of b"), ("g", "bad words")], "video_id string, prompt string")
    rows = stages.detect(stages.begin(items), detections, archive)
    rows = stages.summarize(stages.download(rows, fetched), prompts, "refusing", str(tmp_path / "calls-table"))
    got = {r["video_id"]: (r["error_stage"], r["error_type"], r["skip_reason"], r["summary"]) for r in rows.collect()}
    assert got == {
        "a": (None, None, None, "WORDS"), "b": ("detect", "content", None, None), "c": ("detect", "network", None, None), "d": (None, None, "archived", None),
        "e": ("download", "network", None, None), "f": ("detect", "unknown", None, None), "g": ("summarize", "network", None, None),
    }
    assert set(counted()) == {"words", "bad words"}  # nobody is called for rows that failed before
    assert rows.where("video_id = 'c'").first()["error"] == "ERROR: Connection reset by peer"
    total = stages.totals(rows).first()
    assert (total["total"], total["success"], total["failed"], total["skipped"]) == (7, 1, 5, 1)
    dry = stages.download(stages.detect(stages.begin(items), detections, archive, dry_run=True), fetched, dry_run=True)
    assert {r["video_id"]: r["skip_reason"] for r in dry.where("skip_reason is not null").collect()} == {"b": "no subtitles (dry run)", "d": "archived", "e": "no original (dry run)"}
    forced = stages.detect(stages.begin(items), detections, archive, force=True)
    assert forced.where("skip_reason is not null").count() == 0
    assert stages.summarize(rows, prompts, None, "unused").where("summary is not null").count() == 0
