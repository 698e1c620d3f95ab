"""Hard negatives against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=100):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, anchor in enumerate(kept):
        if anchor[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(anchor[2], r[2], strict=False))
        others = sorted(((-score(r), r[0], j, r[1]) for j, r in enumerate(kept) if j != a))
        for s, p, _, _ in [o for o in others if o[3] == anchor[1]][:k]:
            fit = [(n, -t) for t, n, _, label in others if label != anchor[1] and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(anchor[0], p, i + 1, n, -s, t) for i, (n, t) in enumerate(fit[:k])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("key", "tile", "score", "norm", "v")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("id") % 100 == 0, label).collect()))


def vectors(r, n, dims, spread, centres=6):
    of = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(of)], r.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_all_pairs(spark, monkeypatch, spread):
    r = random.Random(3)
    rows = vectors(r, 900, 6, spread)
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(200)]  # many copies of one vector
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "PIVOTS", 12)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "PIECE_ROWS", 32)
    monkeypatch.setattr(hard_negatives, "PIECE_ANCHORS", 4)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_clusters_are_not_sent_everywhere(spark, monkeypatch):
    """Rows of far cells reach no group that they cannot serve."""
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 40)
    r = random.Random(1)
    rows = [(i, [math.cos(i % 6) + r.gauss(0, 0.002), math.sin(i % 6) + r.gauss(0, 0.002)], i % 2) for i in range(1200)]
    sent, plain = [], hard_negatives._grouped

    def watched(*args):
        dealt, anchors = plain(*args)
        sent.append((dealt.count(), anchors.select((F.col("tile") / 16).cast("int")).distinct().count()))
        return dealt, anchors

    monkeypatch.setattr(hard_negatives, "_grouped", watched)
    assert mined(spark, rows) == brute(rows)
    assert sent[0][1] > 2 and sent[0][0] < 0.6 * 1200 * sent[0][1]


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, i / 300], i % 3) for i in range(301)]
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [nan, 1.0], 1), (403, [inf, 0.0], 1), (404, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (500, [], 1), (501, [0.9], 2), (502, [0.9, 0.9, 7.0], 1), (600, [0.0, 0.0], 4), (601, [0.0, 0.0], 4), (602, [0.0, 0.0], 5)]
    rows += [(700, [-1.0, -1.0], 7), (701, [1.0, 1.0], 7), (800, [3e6, 2e6], 8), (801, [3e6, 1e6], 8), (802, [2.9e6, 1e6], 9), (803, [3e30, 1.0], 8)]
    got = mined(spark, rows)
    assert got == brute([r for r in rows if r[0] != 803])
    assert {x[0] for x in got} >= {0, 100, 200, 600, 800}
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_repeated_ids(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (3, [1.0, 0.0], 2)]
    assert mined(spark, rows) == [(100, 100, 1, 3, 65536, 65536), (100, 100, 1, 3, 65536, 65536), (100, 100, 2, 3, 65536, 65536), (100, 100, 2, 3, 65536, 65536)]
