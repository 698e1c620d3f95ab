"""Tokens, fingerprints, models and the pipeline: libraries, brute force and held-out accuracy as references."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import empty, hard, rows
from tidemark.llm import language_id, ppm, quality, sentencepiece_codec, spotsigs, token_files
from tidemark.llm.common import fold, materialise
from tidemark.llm.queries import queries, tokenizer

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def small_texts(n=200):
    import duckdb

    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()]


ODD = [r[1] or "" for r in rows()] + [" lead", "trail ", "a\n b", "a \nb", " nb  sp", "中文 字 　x", "a b", "don't ''s 12a", "\x00 \x01", "é ﬁ ①"]


def test_sentencepiece_equals_the_library(spark):
    path = tokenizer("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec(path)
    assert codec.by_chunk
    texts = ODD + small_texts()
    for _ in range(2):  # a new table, then a known one
        counts, ids, decoded = codec.run(texts)
        expected = codec.model.encode(texts)
        assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]
        assert decoded == codec.model.decode(expected)
    codec.by_chunk = False
    assert codec.run(texts)[1].tolist() == ids.tolist()
    got = sentencepiece_codec.digests(sentencepiece_codec.encode(hard(spark), path)).collect()
    want = sorted(repr((d, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(codec.model.decode(x).encode()).hexdigest())) for d, x in ((r[0], codec.model.encode(r[1] or "")) for r in rows()))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert sentencepiece_codec.encode(empty(spark), path).count() == 0


def test_table_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "TABLE_CHARS", 50)
    codec = sentencepiece_codec.Codec(tokenizer("piece_bpe_32k.model"))
    for t in small_texts(20):
        assert codec.run([t])[1].tolist() == codec.model.encode(t)


def test_words_equal_the_library():
    table = token_files.WordTable(tokenizer("byte_bpe_50k.json"))
    assert table.by_word
    latin = [f"a{chr(c)}b {chr(c)}c d{chr(c)} {chr(c)}" for c in range(0x250)]
    texts = ODD + small_texts() + latin
    for _ in range(2):
        assert [x.tolist() for x in table.run(texts)] == [e.ids for e in table.model.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    assert (token_files.unpack(data, bits, 0, 1000) == ids).all() and (token_files.unpack(data, bits, 17, 333) == ids[17:333]).all()


def test_paths_of_token_files():
    said = {"s3a://b/k": "s3://b/k", "s3://b/k": "s3://b/k", "dbfs:/a/b": "/dbfs/a/b", "dbfs:///a": "/dbfs/a", "file:///t": "file:///t", "/t/a:b": "/t/a:b", "t": "t", "hdfs://h/x": "hdfs://h/x"}
    assert {p: token_files.plain_uri(p) for p in said} == said


def test_token_files_of_a_long_text(spark, tmp_path, monkeypatch):
    """A text of some MB that crosses blocks, slices and the word table's bound."""
    monkeypatch.setattr(token_files, "TABLE_CHARS", 200_000)
    path = tokenizer("byte_bpe_50k.json")
    long = "\n".join(f"line {i} of a very long text, w{i * 7919 % 100003} {i}." for i in range(60000))
    assert len(long) > 2_500_000 > token_files.SLICE_CHARS
    df = spark.createDataFrame([(2, long), (1, "short"), (3, long[::-1][:5000])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_files.read(spark, token_files.write(df, path, f"file://{tmp_path}/t")).collect()}
    want = [i for i in token_files.WordTable(path).model.encode(long, add_special_tokens=False).ids] + [0]
    assert np.frombuffer(bytes(got[2]["ids"]), "<u4").tolist() == want and len(want) > 4 * token_files.BLOCK_IDS
    assert [got[k]["start"] for k in (1, 2, 3)] == [0, got[1]["n_tokens"], got[1]["n_tokens"] + len(want)]


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    path = tokenizer("byte_bpe_50k.json")
    files = token_files.write(hard(spark), path, f"file://{tmp_path}/t")
    got = token_files.read(spark, files).collect()
    table = token_files.WordTable(path)
    want, start = [], 0
    for d, t, *_ in sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = np.append(table.whole(t or ""), 0)
        want.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got), key=lambda r: r[1]) == want
    name = files.orderBy("task").first()["file"]
    reader = token_files.Reader(name)
    assert reader.bits == 16 and (np.concatenate([reader.document(k) for k in range(len(reader.documents))]) == reader.read(0, reader.ids)).all()
    assert token_files.read(spark, token_files.write(empty(spark), path, f"file://{tmp_path}/e")).count() == 0


def chains_of(text):
    """Signatures by the rule, word by word."""
    import regex

    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    content = [(w, i > 0 and words[i - 1] in spotsigs.ANCHORS) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    digest = lambda *w: hashlib.md5(" ".join(w).encode()).hexdigest()[:8]
    found = {digest(w, content[i + 1][0]) for i, (w, a) in enumerate(content[:-1]) if a or i >= spotsigs.GAP and not any(x[1] for x in content[i - spotsigs.GAP : i])}
    if not found and words:
        found = {digest(*words[i : i + 2]) for i in range(max(1, len(words) - 1))}
    return found


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_spotsigs(spark):
    """Fingerprints and likeness of every row by sets, however unlike in length."""
    got = spotsigs.fingerprints(hard(spark)).collect()
    by_id: dict = {}
    for d, t, *_ in rows():
        by_id.setdefault(-1 if d is None else d, []).append(t or "")
    order = sorted(by_id, reverse=True)
    after = {k: by_id[order[(i + 1) % len(order)]] for i, k in enumerate(order)}
    assert len(got) == len(rows())
    for r in got:
        k = -1 if r["doc_id"] is None else r["doc_id"]
        options = []
        for t in by_id[k]:
            m = len(t) // 3
            for n in after[k]:
                own, edited, nxt = chains_of(t), chains_of(t[: len(t) - m] + n[:m]), chains_of(n)
                options.append((len(t), t[: len(t) - m] + n[:m], "".join(sorted(own)), "".join(sorted(edited)), jaccard(own, edited), jaccard(own, nxt)))
        assert any((r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"]) == o[:4] and abs(r["near_edited"] - o[4]) < 1e-12 and abs(r["near_next"] - o[5]) < 1e-12 for o in options)
    assert spotsigs.fingerprints(empty(spark)).count() == 0


def test_spotsigs_classes_keep_alike_sets_together(spark):
    sizes = spark.range(1, 400).select(F.expr("sequence(1, cast(id as int))").alias("s"))
    for least in (spotsigs.LEAST, 0.6, 0.8):
        of = {len(r["s"]): r["c"] for r in sizes.select("s", spotsigs.length_class("s", least).alias("c")).collect()}
        assert all(abs(of[n] - of[m]) <= 1 for n in of for m in of if m <= n and m >= least * n)
        assert len(set(of.values())) > 2 - (least < 0.5)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_spotsigs_alike_sets_are_found(spark, least):
    """Sets partitioned by length and pruned, against all pairs."""
    r = np.random.default_rng(6)
    sets = [sorted({f"s{k}" for k in r.choice(60, r.integers(1, 25))}) for _ in range(70)]
    sets += [sorted({*s[: len(s) * 9 // 10], "other"}) for s in sets[:30]] + [["s1"], []]
    schema = "id long, signatures array<string>"
    left, right = list(enumerate(sets[:60])) + [(999, None)], list(enumerate(sets[40:]))
    got = {(x["left_id"], x["right_id"]): x["likeness"] for x in spotsigs.similar(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), least).collect()}
    want = {(i, j): jaccard(set(a), set(b)) for i, a in left for j, b in right if a and b and jaccard(set(a), set(b)) >= least}
    assert got == pytest.approx(want) and len(want) > 10
    assert spotsigs.similar(spark.createDataFrame([], schema), spark.createDataFrame(right, schema), least).count() == 0


def test_spotsigs_of_texts_without_anchors(spark):
    words = [f"слово{i}" for i in range(90)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:60] + ["иное"] * 30))]
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["near_edited"] > 0.4 and got[1]["near_next"] > 0.4


def test_operators_equal_their_sql(spark):
    import duckdb

    from tidemark.llm.queries import oracle_sql

    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    shown = lambda row: repr([round(v, 9) if isinstance(v, float) else v for v in row])
    for name, sql in oracle_sql().items():
        df, theirs = queries()[name](spark, SMALL), con.sql(sql)
        columns = sorted(df.columns)
        assert sorted(theirs.columns) == columns
        at = [theirs.columns.index(c) for c in columns]
        assert sorted(shown(r) for r in df.select(*columns).collect()) == sorted(shown([r[i] for i in at]) for r in theirs.fetchall()), name


def test_ppm_sums_to_one_and_equals_a_plain_model():
    order, texts = 2, [b"abracadabra", b"abraham", b"banana band"]
    data, _ = ppm.symbols(texts, order)
    found = ppm.codes(data, 0, len(data), order)
    keys, n = np.unique(found[(found & np.uint64(255)) != ppm.START], return_counts=True)
    shorter = [ppm._summed(keys & np.uint64((1 << 8 * (k + 1)) - 1), n) for k in range(order)]
    trie = ppm.Trie(order, keys, n, shorter)
    counts: dict[bytes, Counter] = {}
    for t in texts:
        s = bytes([ppm.START]) * order + t + bytes([ppm.END])
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

    for context in (b"ab", b"ra", b"zz", b"\xff\xff", b"za", b"an"):
        got = 10 ** trie.log10(np.array([int.from_bytes(context + bytes([s]), "big") for s in range(ppm.SYMBOLS)], np.uint64))
        assert got.sum() == pytest.approx(1, abs=1e-6)
        assert got == pytest.approx([plain(context, s) for s in range(ppm.SYMBOLS)], rel=1e-5)
    assert trie.scores([b"abba", b""])[0] == pytest.approx(sum(math.log10(plain((bytes([ppm.START]) * 2 + b"abba")[i : i + 2], s)) for i, s in enumerate(b"abba" + bytes([ppm.END]))), rel=1e-5)


@pytest.mark.parametrize("kept", [ppm.KEPT_WORDS, 20])
def test_ppm_rows(spark, kept):
    df = hard(spark)
    got = ppm.score(df, fold(5) != 1, kept_words=kept).collect()
    split = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    c = Counter(w for d, t, *_ in rows() if split(d) for w in words(t))
    ends = sum(split(d) for d, *_ in rows())
    n, v = sum(c.values()) + ends, len(c) + 1
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted(((repr(d), split(d), len(words(t)) + 1, sum(w in c for w in words(t)) + 1, n, round(sum(log(c[w]) for w in words(t)) + log(ends), 4)) for d, t, *_ in rows()))
    assert sorted((repr(r["doc_id"]), r["training"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert ppm.score(empty(spark), fold(5) != 1).count() == 0


@pytest.mark.parametrize("hot", [0, 40, ppm.HOT_CODES])
def test_ppm_scores_by_the_whole_trie(spark, hot):
    """Whatever number of codes workers hold: contexts seen once count, and held-out texts escape as in a trie of all orders."""
    docs = [(d, t or "") for d, t, *_ in rows()] + [(900, "zq once only zq"), (901, "漢字 zq")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ppm.score(df, fold(5) != 1, hot_codes=hot).collect()
    learnt = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1
    lower = lambda t: t.encode().lower()
    data, _ = ppm.symbols([lower(t) for d, t in docs if learnt(d)], 5)
    found = ppm.codes(data, 0, len(data), 5)
    keys, n = np.unique(found[(found & np.uint64(255)) != ppm.START], return_counts=True)
    trie = ppm.Trie(5, keys, n, [ppm._summed(keys & np.uint64((1 << 8 * (k + 1)) - 1), n) for k in range(5)])
    want = sorted(zip((repr(d) for d, _ in docs), trie.scores([lower(t) for _, t in docs]), strict=True))
    have = sorted((repr(r["doc_id"]), r["score"]) for r in got)
    assert [d for d, _ in have] == [d for d, _ in want]
    assert [x for _, x in have] == pytest.approx([x for _, x in want], rel=1e-5)
    assert not all(learnt(d) for d, _ in docs)


def test_ppm_bound_holds_where_all_counts_are_alike(spark):
    alike = spark.range(100).select(F.lit(5).cast("long").alias("n"))
    assert (ppm._bounded(alike, 40), ppm._bounded(alike, 100), ppm._bounded(alike.limit(0), 40)) == (6, 5, 1)


def test_ppm_gains_on_held_out_texts(spark):
    got = queries()["op10_ppm"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_network_gradients(monkeypatch):
    monkeypatch.setattr(language_id, "WINDOW", 6)
    net = language_id.Network.random(["a", "b", "c"], 3, 1)
    for name in ("input", "recurrent", "output"):
        setattr(net, name, [w.astype(np.float64) for w in getattr(net, name)])
    net.bias = net.bias.astype(np.float64)
    r = np.random.default_rng(0)
    windows, labels, mask = r.integers(0, 256, (6, 5)).astype(np.uint8), r.integers(0, 3, 5), np.ones((6, 5))
    mask[4:, 1] = 0
    _, grads = net.gradients(windows, labels, mask)
    for w, g in zip(net.weights(), grads, strict=True):
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        held, losses = w[at], []
        for step in (0.01, -0.01):
            w[at] = held + step
            losses.append(net.gradients(windows, labels, mask)[0])
        w[at] = held
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_language_windows_cover_every_byte():
    texts = [b"", b"ab", bytes(range(256)) * 3, b"x" * 128, b"y" * 129]
    counted = np.zeros(len(texts), int)
    for _, counts, of in language_id._cut(texts):
        np.add.at(counted, of, counts.sum(0))
    assert counted.tolist() == [len(t) for t in texts]


def test_network_byte_by_byte():
    """predict() against the two recurrences written out for one position after the other, long and short texts."""
    net = language_id.train([(b"the cat and the dog", "en"), (b"der hund und die katze", "de")] * 20, steps=20)
    squash = lambda x: x / (1 + abs(x))

    def states(d, window):
        k, out = net.recurrent[d].shape[1], {}
        h = np.zeros(k)
        for t in range(len(window)) if d == 0 else reversed(range(len(window))):
            x, r = net.input[d][:, window[t]], net.recurrent[d] @ h
            reset, update = [0.5 + 0.5 * squash(x[i * k : i * k + k] + r[i * k : i * k + k]) for i in (0, 1)]
            h = update * h + (1 - update) * squash(x[2 * k :] + reset * r[2 * k :])
            out[t] = h
        return out

    texts = [b"x", b"the dog and die katze " * 9, bytes(range(1, 200))]
    want = []
    for text in texts:
        total = np.zeros(len(net.languages))
        for new in range(0, len(text), language_id.WINDOW):
            first = max(0, min(new, len(text) - language_id.WINDOW))
            window = text[first : first + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
            both = [states(d, window) for d in (0, 1)]
            for t in range(new - first, min(language_id.WINDOW, len(text) - first)):
                z = net.output[0] @ both[0][t] + net.output[1] @ both[1][t] + net.bias[:, 0]
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                total = total + p
        want.append(total / len(text))
    assert language_id.predict(net, texts) == pytest.approx(np.array(want), abs=1e-4)


def test_foreign_text_is_rejected_by_a_trained_network(spark):
    """Other scripts, random letters and codes go; texts of the learned languages, and of several of them, stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net, most = language_id.train_with_reject(language_id.examples(docs, fold(3) != 1), language_id.examples(docs, fold(3) == 1))
    assert language_id.REJECT_FROM <= most <= language_id.REJECT_UPTO and set(net.languages) == {"de", "en", "es", "fr", "und"}
    clean = {r["lang"]: r["text"] for r in docs.where("lang is not null and length(text) > 300").orderBy("doc_id").collect()}
    mixed = " ".join(clean[x][:400] for x in sorted(clean))
    r = np.random.default_rng(5)
    code = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[i] for i in r.integers(0, 64, 900))
    foreign = ["Широкая река течёт через большой город, и люди гуляют вдоль берега. " * 4, "这是一个很长的句子,用来测试网络是否能够拒绝外语文本。" * 5, "هذه جملة طويلة لاختبار الشبكة التي تتعرف على اللغات المختلفة " * 4, code]
    texts = [*clean.values(), mixed, *foreign, "12 34 !", "", None]
    kept = [i for (i,) in language_id.with_language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net, most).select("doc_id").collect()]
    assert sorted(kept) == list(range(len(clean) + 1))
    of = language_id.with_language(docs, net, most, wanted=["de", "fr"]).groupBy("lang").count().toPandas().set_index("lang")["count"]
    assert of.get("de", 0) > 20 and of.get("en", 0) < 0.1 * of["de"]


def test_every_language_can_be_learned(spark):
    """More languages than any bound, of very unequal size; each has its windows."""
    rows_ = [(i, chr(0x4E00 + i % 90) * 40, f"l{i % 90}") for i in range(900)] + [(1000 + i, "much more of it " * 3, "big") for i in range(3000)]
    got = Counter(lang for _, lang in language_id.examples(spark.createDataFrame(rows_, "doc_id long, text string, lang string"), F.lit(True), sample=100))
    assert len(got) == 91 and got["l7"] == 20 and 100 <= got["big"] <= 300


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries()["op1_language_id"](spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_language_rows(spark):
    net = language_id.train([(b"the cat and the dog", "en"), (b"der hund und die katze", "de")] * 20, steps=40)
    got = {repr(r["text"]): r for r in language_id.identify(hard(spark), net).collect()}
    for t in (None, "", "   ", "1234 !!"):
        assert (got[repr(t)]["lang_pred"], got[repr(t)]["score"]) == ("und", 0.0)
    assert got[repr("ünï cödé 😀 漢字")]["lang_pred"] in ("en", "de")
    odd = [("½ ²", False), ("① Ⅷ", False), ("_ 7", False), ("ª", True), ("漢", True), ("é", True)]
    seen = {r["text"]: r["lang_pred"] != "und" for r in language_id.identify(spark.createDataFrame([(t,) for t, _ in odd], "text string"), net).collect()}
    assert seen == dict(odd)
    assert language_id.identify(empty(spark), net).count() == 0
    assert language_id.examples(empty(spark), fold(3) != 1) == [] and language_id.train([]) is None
    assert {r["lang_pred"] for r in language_id.identify(hard(spark), None).collect()} == {"und"}


def test_quality_features_by_hand():
    text = "The cat sat on the mat\nThe cat sat on the mat\nB2 äß x"
    words = text.split()
    fold_ = {"The": "T", "B2": "T9", "äß": "a", "x": "a"}
    import xxhash

    shapes = Counter(xxhash.xxh3_64_intdigest(fold_.get(w, "a").encode()) % quality.SHAPES for w in words)
    got = quality.features(text)
    assert [got[s] ** 2 for s in shapes] == pytest.approx([n / len(words) for n in shapes.values()], rel=1e-5)
    assert (got[: quality.SHAPES] > 0).sum() == len(shapes)
    n, kinds, pairs = len(words), len(set(words)), Counter(zip(words, words[1:], strict=False))
    sizes = [len(w) for w in words]
    want = [kinds / n, kinds / n - min(1, 8 / n**0.5), 2 / n, 6 / n, 1 - len(pairs) / (n - 1), max(pairs.values()) / n, 1 / 3, np.mean(sizes) / 12, np.std(sizes) / 12, np.log1p(n) / 10, 1 / n, 0]
    assert got[quality.SHAPES :].tolist() == pytest.approx(want, rel=1e-5)
    assert quality.features("")[-1] == 1 and quality.features(" \n")[: quality.SHAPES].sum() == 0
    long = [quality._shape("-" + "a-" * 12 + end) for end in ("a", "9")]
    assert long[0] != long[1]  # the whole word counts, not its first characters


def test_quality_first_step_by_hand():
    """One step of fit() from the gradient of the non-negative risk, taken numerically; both signs of the negative part."""
    r = np.random.default_rng(3)
    for prior in (0.2, 0.95):
        p, u = r.normal(0.5, 1, (6, 3)).astype(np.float32), r.normal(-0.5, 1, (8, 3)).astype(np.float32)
        rate, decay = 1e-3, 1e-3
        k = {"hidden": 2, "batch": 8, "rate": rate, "decay": decay, "seed": 5}
        before, after = quality.fit(p, u, prior, epochs=0, **k), quality.fit(p, u, prior, epochs=1, **k)
        sigmoid = lambda x: 1 / (1 + np.exp(-x))

        def risk(c, prior=prior, p=p, u=u, before=before):
            at = lambda x: before.margin(x) - before.c[0] + c
            called_negative = sigmoid(at(u)).mean() - prior * sigmoid(at(p)).mean()
            return prior * sigmoid(-at(p)).mean() + called_negative if called_negative >= 0 else -called_negative

        slope = (risk(1e-4) - risk(-1e-4)) / 2e-4
        assert after.c[0] == pytest.approx(-rate * slope / (abs(slope) + 1e-8), rel=1e-2)  # Adam's first step


def test_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        positive = r.normal(1, 1, (1500, 20))
        unlabelled = np.concatenate([r.normal(1, 1, (int(3000 * share), 20)), r.normal(-1, 1, (3000 - int(3000 * share), 20))])
        assert quality.estimate_prior(positive, unlabelled) == pytest.approx(share, abs=0.06)


def test_quality_learns_from_positives_only(spark):
    """Without any row marked 0 the prior is found, and bad texts still score low."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    share = labels.where(fold(3) != 1).agg(F.avg("quality")).first()[0]
    model, prior = quality.train(docs, labels.where("quality = 1"), fold(3) != 1)
    assert prior == pytest.approx(share, abs=0.05)
    got = quality.score(docs, model, prior).join(labels.where(fold(3) == 1), "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == got["quality"]).mean() > 0.97


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = queries()["op2_quality"](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97
    assert got[got["quality"] == 1]["score"].mean() > got[got["quality"] == 0]["score"].mean() + 0.5


def test_quality_rows(spark):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(25)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels = labels.withColumns({c: F.lit(9) for c in ("id", "text", "y", "u", "score", "x")})
    model, prior = quality.train(hard(spark), labels, fold(3) != 1)
    got = quality.score(hard(spark), model, prior).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(empty(spark), model, prior).count() == 0
    assert quality.train(empty(spark), labels.limit(0), fold(3) != 1) == (None, 0.5)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    data = docs
    for name, stage in P.STAGES[:-1]:
        data = materialise(stage(spark, data, SMALL), "test")
        assert data.columns == P.COLUMNS
        kept[name] = [tuple(r) for r in data.select("doc_id", "text", "source").collect()]
    every = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    # the same rule, text by text; test_language_network_equals_a_plain_one holds predict() against a version byte by byte
    net, most = language_id.train_with_reject(language_id.examples(docs, fold(3) != 1), language_id.examples(docs, fold(3) == 1))
    lettered = [r for r in every if re.search(r"[^\W\d_]", r[1] or "") and language_id.predict(net, [r[1].encode()])[0, net.languages.index("und")] <= most]
    assert len(lettered) > 0.95 * len(every)
    assert sorted(kept["language ID"]) == sorted(lettered)
    best: dict = {}
    for d, t, s in lettered:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        if norm not in best or (-len(t), d) < best[norm][:2]:
            best[norm] = (-len(t), d, t, s)
    exact = sorted((d, t, s) for _, d, t, s in best.values())
    assert sorted(kept["exact dedup"]) == exact
    from tests.llm.test_rows import classes

    stay = {d for d, _, c in classes([r[:2] for r in exact], 5, 80) if c == d}
    near = [r for r in exact if r[0] in stay]
    assert sorted(kept["n-gram Jaccard join"]) == near
    taken = Counter(d for d, *_ in kept["mixing"])
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in near}
    assert set(taken) <= set(size) and max(taken.values()) <= 2
    assert abs(sum(size[d] * n for d, n in taken.items()) - 1.5 * sum(size.values())) <= sum(sorted(size.values())[-20:])
    got = P.run(spark, SMALL).collect()
    codec = sentencepiece_codec.Codec(tokenizer("piece_bpe_32k.model"))
    text = {d: t for d, t, _ in near}
    assert Counter(r["doc_id"] for r in got) == taken
    assert all(list(r["ids"]) == codec.model.encode(text[r["doc_id"]]) for r in got)


def test_pipeline_language_stage_rejects_by_the_network(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lettered = sum(re.search(r"[^\W\d_]", r["text"] or "") is not None for r in docs.collect())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert P.language(spark, unlabelled, SMALL).count() == lettered > 0  # nothing to learn from
    foreign = [(-1 - i, t * 6, None, "web", len(t) * 6) for i, t in enumerate(["Люди гуляют вдоль берега каждый вечер. ", "用来测试网络是否能够拒绝外语文本。", "これはとても長い文章です。"])]
    got = P.language(spark, docs.unionByName(spark.createDataFrame(foreign, docs.schema)), SMALL)
    assert got.count() >= 0.99 * lettered and got.where("doc_id < 0").count() == 0


def test_pipeline_decides_rows_that_share_an_id_one_by_one(spark):
    import corpus_pipeline as P

    base = [f"w{i}" for i in range(100)]
    text, near, other = " ".join(base), " ".join([*base[:99], "x"]), "quite another text of some words here"
    some = [(7, text), (7, text), (None, text), (None, near), (7, near), (None, other), (None, other), (3, near + " y")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in some], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    for data in (docs, materialise(docs, "test")):
        exact = P.exact(spark, data, SMALL)
        assert texts(exact) == sorted([(7, text), (7, near), (None, other), (3, near + " y")], key=repr)
        assert texts(P.near(spark, data, SMALL)) == sorted([(3, near + " y"), (None, other)], key=repr)
        assert texts(P.near(spark, exact, SMALL)) == sorted([(3, near + " y"), (None, other)], key=repr)
    many = docs.where("doc_id = 7").crossJoin(spark.range(50).select(F.col("id").alias("k"))).drop("k").withColumn("source", F.col("text").substr(-1, 1))
    words = lambda df: df.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words(P.mix(spark, many, SMALL)) - 1.5 * words(many)) <= 2 * 100


def test_pipeline_stages_take_hard_rows(spark):
    """What each stage keeps of the hard rows, each on all of them."""
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    given = [r[:2] for r in rows()]
    texts = lambda df: sorted((r["text"] or "" for r in df.collect()))
    language = texts(stages["language ID"](spark, hard(spark), SMALL))
    assert set(language) <= {t for _, t in given if re.search(r"[^\W\d_]", t or "")} and {t for _, t in given if t and len(t) > 5000 and " " in t} <= set(language)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    exact = texts(stages["exact dedup"](spark, hard(spark), SMALL))
    assert sorted(map(norm, exact)) == sorted({norm(t) for _, t in given})
    near = texts(stages["n-gram Jaccard join"](spark, hard(spark), SMALL))
    from tests.llm.test_rows import classes

    assert len(near) == len({c for _, _, c in classes([(i, t) for i, (_, t) in enumerate(given)], 5, 80)})
    mixed = stages["mixing"](spark, hard(spark), SMALL)
    assert mixed.columns == P.COLUMNS and {t or "" for t in texts(mixed)} <= {t or "" for _, t in given}
    tokens = stages["SentencePiece"](spark, hard(spark), SMALL)
    assert tokens.count() == len(given) and tokens.where("n_tokens <> size(ids)").count() == 0
    for stage in stages.values():
        assert stage(spark, empty(spark), SMALL).count() == 0


