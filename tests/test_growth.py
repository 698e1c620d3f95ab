"""What grows with the tables is moved, computed and stored once."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import fetching, translation
from tidemark.plans import QUERIES
from tidemark.streaming.blocks import Blocks

SF = "/root/testdata/sf0.001"


def test_fetches_of_one_aggregation_equal_those_of_a_plan(spark):
    r = random.Random(3)
    codes = ("en", "en-GB", "zh-CN", "zh_TW", "zh-Hans", "de", "it", "pt-BR", "JA", None)
    rows = [(f"v{v}", r.choice(codes), r.random() < 0.5, p, r.choice((True, False, None)), r.random() < 0.3) for v in range(150) for p in range(r.randrange(1, 6))]
    tracks = spark.createDataFrame(rows, "video_id string, lang string, is_auto boolean, pos int, ok boolean, url_ok boolean")
    wanted = ("en", "zh-CN", "zh-TW", "fr")
    videos = tracks.groupBy("video_id").agg(F.min_by("lang", F.struct("is_auto", "pos")).alias("source_lang"))
    targets = videos.select("video_id", F.explode(F.array(*[F.lit(c) for c in wanted])).alias("target"))
    way = F.when(F.col("is_auto"), "auto").otherwise("manual")
    outcomes = tracks.select("video_id", "lang", way.alias("way"), "ok").unionByName(tracks.select("video_id", "lang", F.lit("url").alias("way"), F.col("url_ok").alias("ok")))
    slow = fetching.fetched(fetching.fetch_plan(videos, tracks, targets), outcomes)
    quick = fetching.fetched_tracks(tracks, wanted)
    assert quick.columns == slow.columns and [f.dataType for f in quick.schema] == [f.dataType for f in slow.schema]
    assert sorted(map(repr, quick.collect())) == sorted(map(repr, slow.collect())) and quick.count() > 300


def test_a_fetch_plan_reads_tracks_once(spark):
    plan = QUERIES["fetch_plan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_rows_of_calls_are_computed_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def count(batches):
        import uuid

        for pdf in batches:
            (seen / uuid.uuid4().hex).write_text(str(len(pdf)))
            yield pdf

    rows = spark.range(100).select("id", F.concat(F.lit("words "), (F.col("id") % 5).cast("string")).alias("prompt")).mapInPandas(count, "id long, prompt string")
    got = translation.call_once(rows, "upper", "prompt", str(tmp_path / "calls"))
    assert got.where("answer = upper(prompt)").count() == 100
    assert sum(int(f.read_text()) for f in seen.iterdir()) == 100


class _Value:
    def __init__(self, log):
        self.value, self.log = None, log

    def exists(self):
        self.log.append("exists")
        return self.value is not None

    def get(self):
        self.log.append("get")
        return self.value

    def update(self, value):
        self.log.append("update")
        self.value = value

    def clear(self):
        self.log.append("clear")
        self.value = None


class _Map:
    def __init__(self, log):
        self.rows, self.log = {}, log

    def containsKey(self, key):
        self.log.append("containsKey")
        return key in self.rows

    def getValue(self, key):
        self.log.append("getValue")
        return self.rows[key]

    def removeKey(self, key):
        self.log.append("removeKey")
        del self.rows[key]

    def updateValue(self, key, value):
        self.log.append("updateValue")
        self.rows[key] = value


class _Handle:
    def __init__(self):
        self.log = []

    def getValueState(self, name, schema):
        return _Value(self.log)

    def getMapState(self, name, key, value):
        return _Map(self.log)


def test_cues_that_wait_cost_one_state_value_a_batch():
    handle, blocks = _Handle(), Blocks("video_id", 1200, 80)
    blocks.init(handle)
    cue = lambda p: {"pos": p, "start_ms": p * 1000, "end_ms": p * 1000 + 900, "text": f"cue {p}" + "." * (p % 7 == 0)}
    give = lambda at: [r for pdf in blocks.handleInputRows((1,), iter([pd.DataFrame([cue(p) for p in at])]), None) for r in pdf.to_dict("records")]
    assert give(range(2, 401, 2)) == []  # the first is not there yet
    found = give(range(1, 401, 2))
    assert sum(r["n_cues"] for r in found) == 400 and [r["part"] for r in found] == list(range(len(found)))
    assert len(handle.log) <= 12
