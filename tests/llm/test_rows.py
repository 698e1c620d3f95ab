"""Exact dedup, line dedup, mixing and the n-gram join against brute force on hard rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.edge import empty, hard, rows
from tidemark.llm import common, exact_dedup, line_dedup, mixing, ngram_join
from tidemark.llm.common import materialise
from tidemark.llm.components import components

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(hard(spark)).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows():
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d or 0, d))
    expected = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for i, m in enumerate(members):
            expected.append((m[3], members[0][3], len(members), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_hot_group_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one hot text")).otherwise(F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_dedup(df).groupBy("group_size", "keep_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).where("keep_id = 0").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["group_size"], r["n"], r["kept"]) for r in got] == [(1000, 1000, 1)]


def kept_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    last = 2**63 - 1
    where = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                where[key(line)].add(last if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(where.get(key(x), ())) > 1 and (last if d is None else d) != min(where[key(x)]))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bound", "keys"), [(line_dedup.FILTER_BYTES, line_dedup.SHARD_KEYS), (line_dedup.FILTER_BYTES, 100), (0, 50), (0, 100_000)])
def test_line_dedup(spark, monkeypatch, bound, keys):
    """Filters at every worker or met by shard, one shard or many: the same lines go."""
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", bound)
    docs = hard(spark)
    counts = line_dedup.reference_counts(docs)
    filters = line_dedup.build_filters(counts, keys)
    got = line_dedup.drop_lines(docs, counts, filters).collect()
    assert sorted((tuple(r) for r in got), key=repr) == kept_lines([r[:2] for r in rows()])
    assert (filters.count() > 1) == (keys < 1000)
    none = line_dedup.reference_counts(empty(spark))
    assert line_dedup.drop_lines(empty(spark), none, line_dedup.build_filters(none)).count() == 0


def test_line_dedup_takes_documents_in_and_out(spark):
    a = spark.createDataFrame([(1, "first long line\nx"), (2, "first long line\nsecond long line"), (2, "another row of two"), (None, "second long line"), (7, None)], "doc_id long, text string")
    b = spark.createDataFrame([(0, "second long line"), (5, "first long line"), (5, "first long line"), (None, None)], "doc_id long, text string")
    before, of_a, of_b = line_dedup.reference_counts(a), line_dedup.line_keys(a), line_dedup.line_keys(b)
    both, postings = line_dedup.insert(before, of_a, of_b)
    as_rows = lambda df: sorted((bytes(r["key"]), r["n_docs"], r["min_doc"], r["max_doc"]) for r in df.collect())
    assert as_rows(both) == as_rows(line_dedup.reference_counts(a.unionByName(b)))
    left, rest = line_dedup.delete(both, postings, of_b)
    assert as_rows(left) == as_rows(before) == as_rows(line_dedup.counted(rest))
    assert as_rows(line_dedup.delete(both, postings, of_a)[0]) == as_rows(line_dedup.reference_counts(b))
    assert as_rows(line_dedup.delete(both, postings, of_a.limit(0))[0]) == as_rows(both) == as_rows(line_dedup.insert(both, postings, of_a.limit(0))[0])
    filters, gone = line_dedup.build_filters(both), both.where(line_dedup.repeated()).select("key")
    less = line_dedup.update_filters(filters, gone.limit(0), gone.unionByName(gone).unionByName(spark.createDataFrame([(None,)], "key binary")))
    assert all(not line_dedup.CuckooFilter.from_bytes(bytes(r["filter"])).table.any() for r in less.collect())
    again = line_dedup.update_filters(materialise(less, "filters"), gone, gone.limit(0))
    assert line_dedup.drop_lines(b, both, materialise(again, "filters")).agg(F.sum("n_dropped")).first()[0] == 2
    full = filters.withColumn("filter", F.lit(None).cast("binary"))
    assert [r["filter"] for r in line_dedup.update_filters(full, gone, gone.limit(0)).collect()] == [None]
    assert line_dedup.update_filters(filters, gone.limit(0), gone.limit(0)).count() == 1


def test_cuckoo_filter():
    r = random.Random(3)
    keys = [r.randbytes(16) for _ in range(20000)]
    made = line_dedup.CuckooFilter.of(keys[:10000])
    digests = made.digests(keys)
    assert made.contains(digests[:10000]).all()
    assert made.contains(digests[10000:]).mean() < 0.01
    made.delete(digests[:5000])
    assert made.contains(digests[5000:10000]).all()
    assert made.contains(digests[:5000]).mean() < 0.01
    assert (line_dedup.CuckooFilter.from_bytes(made.to_bytes()).table == made.table).all()


def test_mix(spark):
    got = mixing.mix(hard(spark)).collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(d), len(word.findall(t or ""))) for d, t, *_ in rows())
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(1.5 * total)
    for rs in by.values():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs) and rs[0]["target"] <= 2 * rs[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rs)
    again = mixing.mix(hard(spark).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize(("bins", "levels"), [(2, 1), (4, 2), (256, 3)])
def test_mix_bins_do_not_matter(spark, monkeypatch, bins, levels):
    """A source with nine rows in ten that reaches its cap, one that is met in part, one without words."""
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "LEVELS", levels)
    k = F.col("id")
    df = spark.range(2000).select(k.alias("doc_id"), F.when(k % 20 == 19, F.lit("")).otherwise(F.expr("repeat('w ', cast(id % 7 as int))")).alias("text"), F.when(k % 20 == 18, "b").when(k % 20 == 19, "c").otherwise("a").alias("source"))
    got = mixing.mix(df, weights=(50, 1, 1), share=1.95).collect()
    assert {r["copies"] for r in got if r["source"] == "a"} == {2}
    b = [r for r in got if r["source"] == "b"]
    rest = b[0]["target"] - sum(int(b[0]["target"] / b[0]["source_size"]) * r["size"] for r in b)
    whole = int(b[0]["target"] / b[0]["source_size"])
    p = b[0]["target"] / b[0]["source_size"] - whole
    u = lambda d: (int(hashlib.md5(f"{d}|mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    filled, taken = 0, {}
    for r in sorted(b, key=lambda r: (u(r["doc_id"]) / (1 - u(r["doc_id"])) / (p / (1 - p)), r["doc_id"])):
        filled += r["size"]
        taken[r["doc_id"]] = (whole + (filled - r["size"] / 2 <= rest)) * r["size"]
    assert {r["doc_id"]: r["taken"] for r in b} == taken
    assert {r["taken"] for r in got if r["source"] == "c"} == {0}


def test_mix_with_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") < 2000, 1.0).otherwise(3.0).alias("w"))
    got = mixing.mix(df, share=0.5, weight_col="w").groupBy((F.col("doc_id") < 2000).alias("light")).agg(F.sum("taken").alias("t")).collect()
    t = {r["light"]: r["t"] for r in got}
    assert abs(t[True] + t[False] - 10000) <= 5 and 2.5 < t[False] / t[True] < 3.6


def classes(docs, n, percent):
    sets = []
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        k = root(i)
        least[k] = min(least.get(k, 2**63), 2**63 - 1 if d is None else d)
    return sorted(((d, len(s), None if least[root(i)] == 2**63 - 1 else least[root(i)]) for i, (d, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_on_hard_rows(spark, n, percent):
    got = ngram_join.ngram_join(hard(spark), n, percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == classes([r[:2] for r in rows()], n, percent)
    assert ngram_join.ngram_join(empty(spark), n, percent).count() == 0


@pytest.mark.parametrize(("sets", "pivots"), [(512, 2000), (16, 40)])
def test_ngram_join_on_groups(spark, monkeypatch, sets, pivots):
    """Groups of near copies, small blocks and pivots included."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(ngram_join, "PIVOT_FROM", pivots)
    r = random.Random(1)
    words = [f"w{i}" for i in range(2000)]
    docs = []
    for size in (30, 120, 300):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(70):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                t[r.randrange(len(t))] = r.choice(words)
            docs.append(" ".join(t[: len(t) - r.randrange(len(t) // 10 + 1)]))
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = ngram_join.ngram_join(df, 3, 90).collect()
    assert sorted((tuple(x) for x in got), key=repr) == classes(docs, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_buckets_never_miss(spark, percent):
    """Pairs at the threshold and about it, among sets that share a passage, are connected by bucket links."""
    import numpy as np

    r = np.random.default_rng(percent)
    passage = np.unique(r.integers(0, 2**63, 40))
    sets = []
    for _ in range(60):
        size = int(r.integers(1, 200))
        a = np.unique(np.r_[r.integers(0, 2**63, size), passage if r.random() < 0.5 else []].astype(np.int64))
        drop, add = r.integers(0, len(a) // 8 + 2, 2)
        sets += [a, np.unique(np.r_[r.permutation(a)[drop:], r.integers(0, 2**63, add)].astype(np.int64))]
    sets = [x for x in sets if len(x)]
    sized = spark.createDataFrame([(i, len(x), x.tolist()) for i, x in enumerate(sets)], "short long, n_shingles long, elements array<long>").repartition(3)
    root = {r["node"]: r["root"] for r in components(ngram_join._bucket_links(sized, percent)).collect()}
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both and both * 100 >= percent * (len(a) + len(sets[j]) - both):
                assert root[i] == root[j]
                linked += 1
    assert linked > 20


def test_lookup_of_hot_keys(spark, monkeypatch):
    """A key that most rows have, absent keys and null keys; rows of the hot key are spread over tasks."""
    rows_ = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 30 == 0, F.lit(None).cast("int")).otherwise((F.col("id") % 50).cast("int")).alias("k"))
    table = rows_.where("k < 40").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    want = sorted(((r["id"], r["k"], r["v"]) for r in rows_.join(table.select("k", "v"), "k", "left").collect()), key=repr)
    for hot in (2, 1000):
        monkeypatch.setattr(common, "HOT", hot)
        got = common.lookup(rows_, table, "k", F.xxhash64("id"))
        assert sorted(((r["id"], r["k"], r["v"]) for r in got.collect()), key=repr) == want
    assert common.lookup(rows_.limit(0), table.limit(0), "k", F.xxhash64("id")).count() == 0


def test_linked_sets_send_enough_common_hashes():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(400):
        size = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        drop, add = r.integers(0, size // 9 + 2, 2)
        b = np.unique(np.r_[r.permutation(a)[drop:], r.integers(0, 2**63, add).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        for percent in (80, 90):
            if both and both * 100 >= percent * (len(a) + len(b) - both):
                (send_a, need_a), (send_b, need_b) = ngram_join.probes(len(a), percent), ngram_join.probes(len(b), percent)
                assert len(np.intersect1d(a[:send_a], b[:send_b])) >= max(need_a, need_b)


def test_components_of_a_long_path(spark):
    ids = spark.range(200).select(F.col("id"), F.xxhash64("id").alias("h"))
    edges = ids.join(ids.select((F.col("id") - 1).alias("id"), F.col("h").alias("next")), "id").select(F.col("h").alias("a"), F.col("next").alias("b"))
    assert components(edges).agg(F.countDistinct("root"), F.count("*")).first() == (1, 200)


def test_ngram_join_of_rows_without_ids_costs_no_more(spark):
    """Pairs of near copies, all without an id: the same sets as with ids, in about the same time."""
    import random
    import time

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(700):
        words = [word() for _ in range(60)]
        texts += [" ".join(words), " ".join([*words[:-1], word()])]
    took, found = [], []
    for ids in (range(len(texts)), [None] * len(texts)):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        began = time.perf_counter()
        found.append(ngram_join.ngram_join(df, 3, 90).collect())
        took.append(time.perf_counter() - began)
    assert len({x["component_id"] for x in found[0]}) == 700 and len(found[1]) == len(texts)
    assert {x["component_id"] for x in found[1]} == {None} and sorted(x["n_shingles"] for x in found[0]) == sorted(x["n_shingles"] for x in found[1])
    assert took[1] < 1.5 * took[0] + 2
