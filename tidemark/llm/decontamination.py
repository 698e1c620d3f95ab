"""Benchmark decontamination from DataFrame functions alone.

1. Every benchmark item becomes the set of its windows of `n` consecutive words (fewer words: one window of all of them), joined
   by single spaces; equal windows are one row with the ids of all their items.
2. Documents are cut into blocks of `BLOCK` words, and blocks into windows of each length that the items have. Windows meet the
   benchmark's in a hash join whose keys are the words themselves, so a hit is verified word by word by the join.
   The benchmark's windows go to every worker as long as they take `BROADCAST_BYTES` at most; beyond that both sides are
   shuffled by window, with the same rows as a result. Windows without a hit never leave their task on the first way.
3. Of each document only its number of words and its hits are shuffled, by a key of the row. Intervals of hits are united by one
   fold over their sorted starts.

A block, its windows and a document's hits are what a task holds at once; the widest is a row of one document's hits.

Words are what is left of the text between ASCII characters other than letters and digits; A-Z are lower-cased, everything beyond ASCII
is part of words as it stands.

Defined cases: null texts have no words; an item without words has no windows; rows that repeat an id are separate documents; a null
doc_id reads back as null; windows of items without an id hit, but name no item; items that repeat an id are one
item; empty tables give empty results, and documents without hits where there are no items; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, text_of

#: Words in a window.
WINDOW = 10
#: Words of a document that are cut into windows at once.
BLOCK = 20_000
#: Bytes of the benchmark's windows, with `ROW_BYTES` for each row, that are sent to every worker at most.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """A-Z in lower case; the cheap function does only that where all characters are ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words(text: str | Column) -> Column:
    """The words of a text."""
    return F.transform(F.filter(F.split(text, BETWEEN), lambda w: w != ""), _lowered)


def _gram(words: str, at: Column, n: int) -> Column:
    """`n` words from position `at` (from 0) on."""
    return F.concat_ws(" ", *[F.get(words, at + j) for j in range(n)])


def _windows(words: str, n: int, most: Column, of) -> Column:
    """of(position, window) for the first `most` windows of `n` words; an empty array where there are fewer words."""
    count = F.least(F.size(words) - n + 1, most)
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: i < count), lambda i: of(i, _gram(words, i, n)))


def item_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """gram, len (its words), items (ids of the items that hold it, in order) for each distinct window."""
    found = items.select(F.col(id_col).alias("item_id"), words(text_of(text_col)).alias("words")).where(F.size("words") > 0)
    whole = F.array(F.struct(F.size("words").alias("len"), F.concat_ws(" ", "words").alias("gram")))
    cut = _windows("words", n, F.size("words"), lambda _, gram: F.struct(F.lit(n).alias("len"), gram.alias("gram")))
    rows = found.select("item_id", F.explode(F.when(F.size("words") < n, whole).otherwise(cut)).alias("w"))
    return rows.groupBy("w.gram", "w.len").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def hits(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (array of from and upto, words from 0, disjoint and in order), items (sorted ids) for each row of `docs`."""
    table = item_windows(items, n, item_id_col, item_text_col)
    by_length = table.groupBy("len").agg(F.sum(F.octet_length("gram") + ROW_BYTES + 8 * F.size("items")).alias("bytes")).collect()  # `n` rows at most
    lengths, held = sorted(r["len"] for r in by_length), sum(r["bytes"] for r in by_length)

    found = docs.select(F.monotonically_increasing_id().alias("_key"), F.col(id_col).alias("doc_id"), words(text_of(text_col)).alias("_words"))
    found = found.withColumn("n_words", F.size("_words").cast("long"))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.col("n_words") - 1, F.lit(0)) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.struct((b * BLOCK).alias("at"), F.slice("_words", b * BLOCK + 1, BLOCK + n - 1).alias("words")))
    found = found.select("_key", "doc_id", "n_words", F.explode(blocks).alias("_block")).select("_key", "doc_id", "n_words", F.col("_block.at").alias("_at"), F.col("_block.words").alias("_words"))
    row = lambda at, size, gram: F.struct(at.alias("at"), F.lit(size).alias("len"), gram.alias("gram"))
    # one row that says a document is there, with a key that no window has
    there = F.when(F.col("_at") == 0, F.array(row(F.lit(-1), 0, F.concat(F.lit("\0"), F.col("_key").cast("string"))))).otherwise(F.array())
    cut = [_windows("_words", size, F.lit(BLOCK), lambda i, gram, size=size: row(F.col("_at") + i, size, gram)) for size in lengths]
    rows = found.select("_key", "doc_id", "n_words", F.explode(F.concat(there, *cut)).alias("_w")).select("_key", "doc_id", "n_words", "_w.at", "_w.len", "_w.gram")
    known = table.select("gram", "items").hint("broadcast" if held <= BROADCAST_BYTES else "merge")
    rows = rows.join(known, "gram", "left").where("at < 0 or items is not null")

    per = rows.groupBy("_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("at") >= 0, F.struct(F.col("at").alias("from"), (F.col("at") + F.col("len")).alias("upto"))))).alias("_found"),
        F.collect_set("items").alias("_items"),
    )
    return _united(per, n).select("doc_id", "n_words", "spans", F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"))


def _united(per: DataFrame, n: int) -> DataFrame:
    """`per` with spans: the intervals of its sorted column _found, of `n` words at most, united where they touch.

    Every step looks at a fixed number of neighbours, so the work is linear in the number of hits.
    """
    per = per.withColumn("_one", F.filter("_found", lambda x, i: F.coalesce(F.get("_found", i + 1)["from"] != x["from"], F.lit(True))))  # the longest of each start
    # how far the intervals up to this one reach; those more than n starts before end before it
    reach = F.transform("_one", lambda x, i: F.struct(x["from"].alias("from"), F.greatest(x["upto"], *[F.get("_one", i - j)["upto"] for j in range(1, n + 1)]).alias("upto")))
    per = per.withColumn("_reach", reach)
    per = per.withColumn("_starts", F.filter("_reach", lambda x, i: F.coalesce(x["from"] > F.get("_reach", i - 1)["upto"], F.lit(True))))
    per = per.withColumn("_ends", F.filter("_reach", lambda x, i: F.coalesce(F.get("_reach", i + 1)["from"] > x["upto"], F.lit(True))))
    return per.withColumn("spans", F.transform("_starts", lambda x, i: F.struct(x["from"].alias("from"), F.get("_ends", i)["upto"].alias("upto"))))


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for each row of `docs`; parameters as those of hits()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["upto"] - s["from"])
    return hits(docs, items, **names).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: str, spans: str) -> Column:
    """A text without the words in `spans` and what stands behind each of them."""
    flags = F.flatten(F.transform(spans, lambda s, i: F.concat(F.array_repeat(F.lit(False), s["from"] - F.coalesce(F.get(spans, i - 1)["upto"], F.lit(0))), F.array_repeat(F.lit(True), s["upto"] - s["from"]))))
    parts, behind = F.split(text, BETWEEN), F.regexp_extract_all(text, F.lit(f"({BETWEEN})"), F.lit(1))
    lead = F.when(F.get(parts, F.lit(0)) == "", F.lit(1)).otherwise(F.lit(0))
    said = F.struct(parts.alias("parts"), behind.alias("behind"), flags.alias("flags"), lead.alias("lead"))

    def kept(s: Column) -> Column:
        one = lambda p, i: F.when((p == "") | ~F.coalesce(F.get(s["flags"], i - s["lead"]), F.lit(False)), F.concat(p, F.coalesce(F.get(s["behind"], i), F.lit(""))))
        return F.array_join(F.filter(F.transform(s["parts"], one), lambda x: x.isNotNull()), "")

    return F.get(F.transform(F.array(said), kept), F.lit(0))


def decontaminate(docs: DataFrame, items: DataFrame, whole: bool = False, text_col: str = "text", **names) -> DataFrame:
    """`docs` without the words that occur in `items`, or, if `whole`, without the documents that hold any; the columns stay as they are.

    Null texts stay null. The rows are written first, with a key of their own, because they are read twice.
    """
    keyed = materialise(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "decontamination-rows")
    texts = keyed.select("row", F.col(f"doc.{text_col}").alias("text"))
    found = hits(texts, items, id_col="row", text_col="text", **names).where(F.size("spans") > 0).select(F.col("doc_id").alias("row"), "spans")
    if whole:
        return keyed.join(found, "row", "left_anti").select("doc.*")
    cleaned = keyed.join(found, "row", "left").withColumn("text", F.when(F.col("spans").isNull(), F.col(f"doc.{text_col}")).otherwise(without_spans(F.col(f"doc.{text_col}"), "spans")))
    return cleaned.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.{c}").alias(c) for c in docs.columns])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The contract in SQL.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), g AS (
  SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' '))) AS gram FROM b WHERE len(w) > 0
), p AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'pos': i, 'gram': array_to_string(w[i : i + n - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT n FROM g)
), h AS (
  SELECT p.doc_id, p.x.pos AS pos, p.n, g.item_id FROM p JOIN g ON g.gram = p.x.gram
), c AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
