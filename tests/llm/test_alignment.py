"""Alignment of two tokenizers against two pointers over plain lists."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.edge import empty, hard, rows
from tidemark.llm import token_alignment
from tidemark.llm.queries import queries, tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(tokenizer(A)), SentencePieceProcessor(model_file=tokenizer(B))
    a_model.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    found, documents = [], Counter()
    for doc, text in docs:
        text = text or ""
        a = [(i, bytes(letter[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in b_model.encode(text) if text else []:
            p = b_model.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append((doc, 0, 0, [], ""))
            continue
        links, groups, i, j, end_a, end_b, mine, other = [], [], 0, 0, len(a[0][1]), len(b[0][1]), [a[0][0]], [b[0][0]]
        while True:
            links.append((a[i][0], b[j][0]))
            to_a, to_b = end_a <= end_b, end_b <= end_a
            if to_a and to_b:
                groups.append(",".join(map(str, mine)) + "|" + ",".join(map(str, other)))
                mine, other = [], []
            if to_a:
                i += 1
            if to_b:
                j += 1
            if i == len(a) and j == len(b):
                break
            if to_a:
                end_a += len(a[i][1])
                mine.append(a[i][0])
            if to_b:
                end_b += len(b[j][1])
                other.append(b[j][0])
        documents.update(set(links))
        found.append((doc, len(a), len(b), links, ";".join(groups)))
    most = defaultdict(int)
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    out = []
    for doc, n_a, n_b, links, groups in found:
        best = sum(documents[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if links else ""
        out.append((doc, n_a, n_b, groups.count(";") + 1 if links else 0, len(links), best, sum(documents[p] for p in links), digest))
    return sorted(map(repr, out))


def shown(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_equals_brute_force_on_hard_rows(spark):
    df = hard(spark).withColumns({c: F.lit(1) for c in ("pairs", "times", "pair")})
    got = token_alignment.align(df, tokenizer(A), tokenizer(B))
    assert shown(got) == brute([r[:2] for r in rows()])
    assert token_alignment.align(empty(spark), tokenizer(A), tokenizer(B)).count() == 0


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 40)
    monkeypatch.setattr(token_alignment, "COMMON", 20)
    r = random.Random(2)
    texts = ["<|endoftext|>", "a <s> </s> <unk> <0x41>", "▁", "a▁b", " ", "  ", " a", "a  b ", "\n", "a\n\n b", " x", "tab\t\tx ", "'s don't ''", "漢字 かな", "é́ ﬁ ①", "\x00\x01", "﻿x", "x " * 50, "  a "]
    texts += ["".join(r.choice("ab \n\té漢😀<>|s") for _ in range(r.randint(1, 40))) for _ in range(80)]
    docs = list(enumerate(texts))
    assert shown(token_alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer(A), tokenizer(B))) == brute(docs)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert shown(queries()["op13_token_alignment"](spark, sf)) == brute(docs)


def test_a_text_of_several_megabytes(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    docs = [(1, " ".join(r.choice(words) for _ in range(500_000))), (2, " ".join(words[:50]))]
    assert len(docs[0][1]) > 2_500_000
    assert shown(token_alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer(A), tokenizer(B))) == brute(docs)


def test_groups_as_text(spark):
    row = token_alignment.links(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), tokenizer(A), tokenizer(B), whole_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and len(row["groups"].split(";")) == row["n_groups"]
    assert sum(row["times"]) == row["n_links"]


def test_merge():
    at, a, b, closes = token_alignment.merge(np.array([2, 5, 9]), np.array([5, 6, 9]), 9)
    assert list(zip(at.tolist(), a.tolist(), b.tolist(), closes.tolist(), strict=True)) == [(2, 0, 0, False), (5, 1, 0, True), (6, 2, 1, False), (9, 2, 2, True)]


def test_texts_together_and_apart_agree():
    both = token_alignment.Aligner(tokenizer(A), tokenizer(B))
    texts = [r[1] or "" for r in rows()] + ["one two three", "ünï cödé 😀", "a\nb c", "a▁b"]
    together = [(n, g, x.tolist()) for n, g, x in both.run(texts)]
    assert together == [(n, g, x.tolist()) for t in texts for n, g, x in both.run([t])]
    assert list(both.run([])) == []
