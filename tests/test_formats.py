"""Parsers, converters and folds on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import errors, languages, texts, urls
from tidemark.operators import cues, folds


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("x")).first()["x"]


VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500 align:start position:0%\nHello\n\nNOTE x\n\n00:00:03.000 --> 00:00:04.000\nWorld\nagain\n"
JSON3 = '{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"a"},{"utf8":"b"}]},{"tStartMs":5},{"tStartMs":1600,"segs":[{"utf8":"\\n"}]},{"tStartMs":2000,"dDurationMs":1000,"segs":[{"utf8":"c"}]}]}'


@pytest.mark.parametrize(
    ("content", "expected"),
    [(VTT, "vtt"), (JSON3, "json3"), ("<?xml?>", "srv3"), ("x<transcript>", "srv3"), ("1\n00:00:01,000 --> 00:00:02,000\na", "srt"), ("plain", None), ("", None), ("{broken", None)],
)
def test_format(spark, content, expected):
    assert one(spark, content, cues.detect_format) == expected


def test_vtt(spark):
    assert one(spark, VTT, cues.vtt_to_srt) == "1\n00:00:01,000 --> 00:00:02,500\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\nWorld\nagain\n"
    assert one(spark, "WEBVTT\n\n", cues.vtt_to_srt) == ""


def test_json3(spark):
    assert one(spark, JSON3, cues.json3_to_srt) == "1\n00:00:01,000 --> 00:00:01,500\nab\n\n2\n00:00:02,000 --> 00:00:03,000\nc\n"
    assert one(spark, "no json", cues.json3_to_srt) == "no json"


def test_srv3(spark):
    assert one(spark, '<p t="0" d="1500">a &amp;&lt;b</p><p t="9" d="1"> </p>', cues.srv3_to_srt) == "1\n00:00:00,000 --> 00:00:01,500\na &<b\n"
    assert one(spark, "<none/>", cues.srv3_to_srt) == "<none/>"


def test_parsers_differ_on_empty_text(spark):
    content = "1\n00:00:01,000 --> 00:00:02,000\n\n2\n00:00:02.500 --> 00:00:03.000\nb\n"
    assert [c["text"] for c in one(spark, content, cues.parse_for_merge)] == ["b"]
    assert [c["text"] for c in one(spark, content, cues.parse_for_output)] == [""]
    web = one(spark, "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<b>x</b> &amp;gt; y\n", cues.parse_for_chunks)
    assert [(c["index"], c["start"], c["text"]) for c in web] == [(1, "00:00:01.000", "x &gt; y")]


def cue_rows(spark, rows):
    return spark.createDataFrame([(1, i, t, s, e) for i, (t, s, e) in enumerate(rows)], "video_id long, pos int, text string, start_ms long, end_ms long")


@pytest.mark.parametrize(
    ("rows", "most", "expected"),
    [
        ([], 1000, []),
        ([("a", 0, 500)], 1000, ["a"]),
        ([("a", 0, 500), ("b.", 600, 900), ("c", 1000, 1200)], 1000, ["a b.", "c"]),
        ([("a", 0, 500), ("b", 600, 900), ("c", 3900, 4200)], 1000, ["a b", "c"]),
        ([("x" * 15, 0, 500), ("y" * 15, 600, 900)], 20, ["x" * 15, "y" * 15]),
        ([("a", 0, 1), ("好。", 2, 3), ("b", 4, 5)], 1000, ["a 好。", "b"]),
    ],
)
def test_blocks(spark, rows, most, expected):
    parts = folds.block_parts(cue_rows(spark, rows), ["video_id"], most_chars=most)
    assert [r["text"] for r in folds.merge_blocks(parts, ["video_id"]).orderBy("part").collect()] == expected


def test_length_rule_leaves_the_joining_space_out(spark):
    parts = folds.block_parts(cue_rows(spark, [("aaaa", 0, 1), ("bbbb", 2, 3), ("c", 4, 5)]), ["video_id"], most_chars=8)
    assert [r["text"] for r in folds.merge_blocks(parts, ["video_id"]).orderBy("part").collect()] == ["aaaa bbbb", "c"]


def test_chunks_are_a_partition(spark):
    rows = spark.createDataFrame([(1, i, 10) for i in range(5)], "video_id long, pos int, size int")
    parts = folds.chunk_parts(rows, ["video_id"], "size", 2, 1000).groupBy("part").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy("part").collect()
    assert [(r["a"], r["b"]) for r in parts] == [(0, 1), (2, 3), (4, 4)]


@pytest.mark.parametrize(("n", "low", "high"), [(0, 300, 800), (2999, 300, 800), (3000, 500, 1000), (4999, 500, 1000), (5000, 800, 1500), (5001, 1500, 4000), (29999, 1500, 4000), (30000, 2000, 5000)])
def test_summary_length(spark, n, low, high):
    assert tuple(one(spark, n, texts.suggested_length, "int")) == (low, high)


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("k sk-abcdefghijklmnopqrstuvwx y", "k sk-a***uvwx y"), ("t=" + "a1" * 16, "t=a1a1***a1a1"), ("?key=123456789&x", "?key=12***89&x"), ("?key=12345678", "?key=12345678"),
        ("pwd: 1 password=abc", "pwd: 1 password=***REDACTED***"), ("http://u:p@h", "http://u:***REDACTED***@h"), ("Bearer short", "Bearer short"), ("Bearer abcdefghij", "Bearer abcd***ghij"), ("x" * 10 + " " + "y " * 300, None),
    ],
)
def test_masks(spark, message, expected):
    got = one(spark, message, texts.mask_secrets)
    assert got == expected if expected else got.endswith("... [truncated]") and len(got) == 515


def test_matching_is_not_transitive(spark):
    m = lambda a, b: one(spark, a, lambda c: languages.matches(c, F.lit(b)))
    assert m("zh", "zh-CN") and m("zh", "zh-TW") and not m("zh-CN", "zh_TW") and m("en-US", "en") and not m("en", "de")


def test_urls(spark):
    assert one(spark, "https://youtu.be/abcdefghijk?x", urls.video_id) == "abcdefghijk"
    assert one(spark, "ok https://youtube.com/@a\n\nhttp://x.y\nhttps://youtube.com/feed", urls.bad_lines) == [3, 4]
    assert one(spark, "  ", urls.validation_code) == "blank"


def test_versions(spark):
    newer = lambda a, b: one(spark, a, lambda c: texts.version(c) > texts.version(F.lit(b)))
    assert newer("v1.10", "1.9.9") and newer("1.2.0", "1.2") and not newer("bad", "0.0.0")


def test_error_order(spark):
    kind = lambda m: one(spark, m, lambda c: errors.classify(c, F.lit(False)))
    assert [kind(m) for m in ("429 forbidden 403", "Connection refused 404", "cookies: bad format", "WARNING: 404", "?")] == ["rate_limit", "network", "auth", "content", "external_service"]


def test_resumable_case(spark):
    df = spark.createDataFrame([("pending", None), ("done", None), ("failed", "NETWORK"), ("failed", "AUTH"), ("failed", "auth"), ("failed", None)], "s string, e string")
    rows = df.select(errors.is_resumable(F.col("s"), F.col("e")).alias("a"), errors.is_resumable(F.col("s"), F.col("e"), False).alias("b")).collect()
    assert [r["a"] for r in rows] == [True, False, True, False, True, True]
    assert [r["b"] for r in rows] == [True, False, True, False, False, True]


def masked_by_rule(m):
    """The rules of masking with their conditions on lengths as code."""
    import re

    ends = lambda v, k: v[:k] + "***" + v[-k:]
    m = re.sub(r"(sk-[a-zA-Z0-9])[a-zA-Z0-9]{15,}([a-zA-Z0-9]{4})", r"\1***\2", m)
    m = re.sub(r"\b[a-zA-Z0-9]{32,}\b", lambda x: ends(x[0], 4), m)

    def header(x):
        name, eq, value = x[2].strip().partition("=")
        return x[1] + (name + eq + (ends(value, 4) if len(value) > 8 else "***REDACTED***" if value else "") if eq else x[2])

    m = re.sub(r"(?i)(Cookie:\s*)([^;\n]+)", header, m)
    for start, value, k, least in ((r"cookie\s*=\s*", r"[^;\s\n&]+", 4, 9), (r"Authorization:\s*", r"[^\s\n]+", 4, 9)):
        m = re.sub(f"(?i)({start})({value})", lambda x, k=k, least=least: x[1] + (ends(x[2], k) if len(x[2]) >= least else x[2]), m)
    m = re.sub(r"(?i)Bearer\s+([a-zA-Z0-9\-_.]+)", lambda x: "Bearer " + (ends(x[1], 4) if len(x[1]) > 8 else x[1]), m)
    m = re.sub(r"(?i)Basic\s+([A-Za-z0-9+/=]{20,})", lambda x: "Basic " + ends(x[1], 4), m)
    for p in texts.SECRET_PARAMETERS:
        m = re.sub(rf"(?i)([?&]{p}=)([^&\s]+)", lambda x: x[1] + (ends(x[2], 2) if len(x[2]) > 8 else x[2]), m)
    m = re.sub(r"(?i)(password|pwd)\s*=\s*[^\s&]+", r"\1=***REDACTED***", m)
    m = re.sub(r"://([^:]+):([^@]+)@", r"://\1:***REDACTED***@", m)
    return m[:500] + "... [truncated]" if len(m) > 500 else m


def test_masks_hold_the_rule(spark):
    """Every kind of secret with values of 0 to 40 characters, alone and behind one another."""
    import random

    r = random.Random(8)
    value = lambda n: "".join(r.choice("abcXYZ019") for _ in range(n))
    kinds = ["Cookie: SID=", "cookie:  a=", "Cookie: ", "x cookie=", "cookie = ", "Authorization: ", "authorization:", "bearer  ", "Bearer ", "Basic ", "basic  ", "password=", "PWD = ", "socks5://u:", "sk-", "/p?x=1&", *[f"/p?{p}=" for p in texts.SECRET_PARAMETERS]]
    rows = [k + value(n) + r.choice(["", " tail", "; b=cdefghijklmnop", "\nnext", "&z=1", "@host/"]) for k in kinds for n in (0, 1, 4, 8, 9, 12, 16, 20, 24, 31, 32, 40)]
    rows += [" ".join(r.sample(rows, 3)) for _ in range(150)] + ["x" * 600, "", "Cookie: SID=abc123", "cookie=abcdefghijklmnop", "Cookie: a=b=c d e f g h i ; q"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", texts.mask_secrets(F.col("t")).alias("m")).collect()
    for x in got:
        assert x["m"] == masked_by_rule(rows[x["i"]]), rows[x["i"]]
