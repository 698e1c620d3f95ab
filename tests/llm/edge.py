"""Hard rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows() -> list[tuple]:
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 7)))
    base = " ".join(word() for _ in range(90))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(4000))
    near = base.split(" ")
    near[40] = "changed"
    texts = [None, "", "   ", "\n\n", "a", "A  b\tc", "ab c", "1234 !!", "ünï cödé 😀 漢字", base, base, base + " ", base.upper(), " ".join(near), long, long, "same line of text here\nother one", "Same line of text here \nthird", "x" * 30000, "▁ ▁▁x <|endoftext|> y", "tab\there  two  spaces ", "it's we'll 12a ½"]
    out = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s%d" % (i % 4), len(t) if t else None) for i, t in enumerate(texts)]
    out += [(100 + i, " ".join(word() for _ in range(r.randint(1, 60))), "de" if i % 2 else "fr", "s1", 1) for i in range(25)]
    return out + [(None, "no id here", "en", "s1", 10), (3, "a second row with id three", None, None, None), (9, base, "en", "s1", 1)]


def hard(spark: SparkSession) -> DataFrame:
    """The rows, with columns that operators use inside."""
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("k", "node", "score", "lang_pred", "size", "target", "run", "task", "_words", "row", "key", "kept", "copies", "word", "n")})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
