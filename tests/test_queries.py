"""Every query of the engine against DuckDB over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def shown(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(shown(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([shown(v) for v in row]) for row in df.select(*columns).collect())
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted(repr([shown(row[i]) for i in at]) for row in theirs.fetchall())


@pytest.mark.parametrize("name", ["chunk_split_turns", "cue_merge", "bilingual_left", "source_select", "eta_weighted"])
def test_partitions_do_not_matter(spark, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, SF)
        found.append(sorted(map(repr, df.select(*sorted(df.columns)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
