"""Benchmark decontamination against a plain version of its rules."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.edge import empty, hard, rows
from tidemark.llm import decontamination

ITEMS = "item_id long, text string"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, n=10):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                of = windows.get(tuple(w[i : i + size]))
                if of is not None:
                    hit |= set(range(i, i + size))
                    found |= of - {None}
        out.append((doc, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(map(repr, out))


def some_items():
    texts = [r[1] for r in rows() if r[1]]
    words = plain_words(texts[10])
    return [
        (1, " ".join(words[5:30])), (2, " ".join(words[12:22]).upper() + "!"), (3, "one a Ünï cödé 😀"), (3, "ünï cödé 😀 漢字"), (4, "漢字"), (5, None), (6, "... !!"), (7, " ".join(words[60:75])),
        (8, "never seen " * 20), (None, "no id here"), (9, " ".join(words[5:30])), (10, "x" * 30000),
    ]


def test_equals_brute_force_on_hard_rows(spark):
    items = some_items()
    got = decontamination.contamination(hard(spark), spark.createDataFrame(items, ITEMS).withColumn("gram", F.lit(1)))
    assert sorted(repr((r[0], r[1], r[2], r[3], list(r[4]), r[5])) for r in got.collect()) == brute([r[:2] for r in rows()], items)
    assert sum(r["contaminated"] for r in got.collect()) > 5


@pytest.mark.parametrize("block", [1, 7, 50])
def test_blocks_and_joins_do_not_matter(spark, monkeypatch, block):
    r = random.Random(block)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.choice([0, 3, 20, 120])))) for i in range(60)]
    items = [(i, " ".join(r.choice("abc") for _ in range(r.choice([1, 3, 5, 6])))) for i in range(3, 8)] + [(9, " ".join(r.choice("abc") for _ in range(30)))]
    docs[3] = (3, "b " + items[-1][1] + " c")
    monkeypatch.setattr(decontamination, "BLOCK", block)
    if block == 7:
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), n=6)
    assert sorted(repr((x[0], x[1], x[2], x[3], list(x[4]), x[5])) for x in got.collect()) == brute(docs, items, 6)


def test_empty_tables(spark):
    items = spark.createDataFrame(some_items(), ITEMS)
    assert decontamination.contamination(empty(spark), items).count() == 0
    clean = decontamination.contamination(hard(spark), items.limit(0)).collect()
    assert len(clean) == len(rows()) and not any(r["contaminated"] or r["n_items"] for r in clean)


def test_a_text_of_several_megabytes(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    text = " ".join(f"v{i % 9973} Q" for i in range(400_000)) + " " + passage + " end " + passage
    row = decontamination.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, passage)], ITEMS)).first()
    assert len(text) > 2_500_000 and tuple(row) == (1, 800_081, 80, 1, [5], True)


def test_every_word_of_a_long_text_hit(spark):
    text = "again " * 200_000
    row = decontamination.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, "again " * 12)], ITEMS)).first()
    assert row["n_hit"] == row["n_words"] == 200_000


def test_spans_and_documents_are_removed(spark):
    passage = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa LAMBDA"
    docs = spark.createDataFrame([(1, f"Keep this. {passage}! And (this)."), (2, "clean text."), (3, None), (4, passage), (4, f"  {passage} {passage}\nend "), (None, "")], "doc_id long, text string").withColumn("spans", F.lit(3))
    items = spark.createDataFrame([(1, passage.lower())], ITEMS)
    left = decontamination.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(repr, (tuple(r)[:2] for r in left.collect()))) == sorted(map(repr, [(1, "Keep this. And (this)."), (2, "clean text."), (3, None), (4, ""), (4, "  end "), (None, "")]))
    whole = decontamination.decontaminate(docs, items, whole=True)
    assert sorted(map(repr, (tuple(r)[:2] for r in whole.collect()))) == sorted(map(repr, [(2, "clean text."), (3, None), (None, "")]))


def test_digest_of_no_items(spark):
    from tidemark.llm.queries import queries

    clean = queries()["op11_decontamination"](spark, "/root/testdata/sf0.001").where("not contaminated").first()
    assert clean["items_sha256"] == hashlib.sha256(b"").hexdigest()
