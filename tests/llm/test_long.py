"""Texts of several megabytes, and models against plain versions of them, row by row."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_rows import classes
from tests.llm.test_texts import chains_of
from tidemark.llm import exact_dedup, line_dedup, ngram_join, ppm, quality, sentencepiece_codec, spotsigs
from tidemark.llm.common import fold
from tidemark.llm.queries import tokenizer

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def long_docs():
    """One text of over 3 MB, its copy with other white space, its copy with another end, and a short one."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    text = "\n".join(" ".join(r.choice(words) for _ in range(14)) for _ in range(36_000))
    assert len(text) > 3_000_000
    return [(1, text), (2, text.replace(" ", "  ", 1)), (3, text + " and another end"), (4, "a short text of some words")]


def test_long_texts(spark, long_docs):
    docs = spark.createDataFrame(long_docs, SCHEMA)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {d: (2 if d < 3 else d, d > 1, hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in long_docs}

    assert sorted(map(tuple, ngram_join.ngram_join(docs, 3, 90).collect())) == sorted(classes(long_docs, 3, 90))

    model = sentencepiece_codec.Codec(tokenizer("piece_bpe_32k.model")).model
    ids = {r["doc_id"]: list(r["ids"]) for r in sentencepiece_codec.encode(docs, tokenizer("piece_bpe_32k.model")).collect()}
    assert all(ids[d] == model.encode(t) for d, t in long_docs)

    counts = line_dedup.reference_counts(docs)
    lines = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_lines(docs, counts, line_dedup.build_filters(counts)).collect()}
    n = len(long_docs[0][1].split("\n"))
    assert lines[1] == (n, 0) and lines[2] == (n, n - 1) and lines[3] == (n, n - 1) and lines[4] == (1, 0)


def test_fingerprint_of_a_long_text(spark, long_docs):
    some = [(1, long_docs[0][1]), (2, "a short text of the words")]
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(spark.createDataFrame(some, SCHEMA)).collect()}
    third = len(some[0][1]) // 3
    for d, t in ((1, some[0][1]), (2, some[1][1])):
        assert got[d]["fingerprint"] == "".join(sorted(chains_of(t)))
    assert got[1]["edited_fingerprint"] == "".join(sorted(chains_of(some[0][1][:-third] + some[1][1])))


def test_quality_scores_are_those_of_the_model(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model, prior = quality.train(docs, labels, fold(3) != 1)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, prior).collect()}
    for r in docs.collect():
        plain = float(model.score(quality.features(r["text"] or "").reshape(1, -1))[0])
        assert got[r["doc_id"]] == pytest.approx(plain, abs=1e-5) and 0 <= got[r["doc_id"]] <= 1


def test_ppm_of_order_five_equals_a_plain_model(spark):
    order = 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 900").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()[:60]
    counts: dict[bytes, Counter] = {}
    start, end = bytes([ppm.START]) * order, bytes([ppm.END])
    training = [r for r in rows if r["doc_id"] % 3]
    for r in training:
        s = start + r["text"].encode().lower() + end
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def plain(context: bytes, symbol: int) -> float:
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in counts.get(context[len(context) - k :], {}).items() if s not in out}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return p * seen[symbol] / total
            p *= len(seen) / total
            out |= set(seen)
        return p / (ppm.SYMBOLS - len(out))

    some = spark.createDataFrame(rows).withColumn("n", F.lit(1))
    got = {r["doc_id"]: r["score"] for r in ppm.score(some, F.col("doc_id") % 3 != 0, order).collect()}
    for r in rows[:24]:
        s = start + r["text"].encode().lower() + end
        assert got[r["doc_id"]] == pytest.approx(sum(math.log10(plain(s[i - order : i], s[i])) for i in range(order, len(s))), rel=1e-4)
    assert np.isfinite(list(got.values())).all()
