"""SpotSigs fingerprints from DataFrame functions alone.

A spot is a content word behind a common word (an anchor); its signature is a digest of that word and the next content words,
a chain of `CHAIN`. Where `GAP` content words follow each other without an anchor, as in languages whose anchors are not
listed, each further one is a spot until the next anchor. A text's fingerprint is the sorted set of its signatures.

Where sets are compared with many others (`similar`), they are partitioned by their length into classes (`length_class`): the likeness of two
sets cannot exceed the smaller length over the larger, so a set only meets those of its own and the neighbouring classes, and there
those that share one of its rarest signatures. What the two lengths and the places of that signature leave possible bounds the
likeness from above; only pairs that can reach the least one asked for are intersected. The fingerprint query compares each text with two
given ones only, and its likeness is exact for every pair, however unlike in length.

Everything is built-in functions over arrays; a column that a lambda reads by index is computed in a projection of its own, and
read more than once, so that it is not computed anew for each element.

The document after each one, by falling id, is found without a global order: ids alone are range-partitioned and sorted, each
range finds its own successors, and the last id of a range takes the first id of the next range that has rows, from a table of
one row per range. Texts then meet their successor's opening by id.

Defined cases: null text counts as empty; a text without spots has the chains of all its words, one without words an empty set; two empty sets have a likeness of 1; a null id counts as the smallest; rows that repeat an id have one successor, and as a
successor the row whose text has the smallest hash stands for them; an empty table gives an empty result; columns other than id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, text_of

#: Common words of English, German, French and Spanish that serve as anchors (fixed values).
ANCHORS = (
    "the of and to in a is that it for on was as with be by are this at an from or not have "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de et un une du que est dans en pour sur au par ne pas qui "
    "el los las y se del por con para no lo su al es como"
).split()
#: Words in a signature; content words without an anchor behind which each is a spot.
CHAIN, GAP = 2, 8
#: The likeness that the classes of the fingerprints are made for.
LEAST = 0.1
_FIRST_ID = -(1 << 63)


def _chain(words: str, i: Column, word) -> Column:
    """Eight hexadecimal digits for the words from position `i` on."""
    return F.left(F.md5(F.concat_ws(" ", *[word(F.get(words, i + j)) for j in range(CHAIN)]).cast("binary")), F.lit(8))


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the sorted set of signatures (array of string) of its column `text`."""
    anchor = lambda c: c.isin(*ANCHORS)
    df = df.withColumn("_words", F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    spots = F.transform("_words", lambda x, i: F.struct(x.alias("w"), F.coalesce((i > 0) & anchor(F.get("_words", i - 1)), F.lit(False)).alias("a")))
    df = df.withColumn("_content", F.filter(spots, lambda s: ~anchor(s["w"])))

    def spot(s: Column, i: Column) -> Column:
        near = F.lit(False)
        for j in range(GAP, 0, -1):
            near = F.get("_content", i - j)["a"] | near
        return s["a"] | ((i >= GAP) & ~near)

    chain = F.transform("_content", lambda s, i: F.when((i + CHAIN <= F.size("_content")) & spot(s, i), _chain("_content", i, lambda x: x["w"])))
    df = df.withColumn("_found", F.sort_array(F.array_distinct(F.filter(chain, lambda x: x.isNotNull()))))
    every = F.transform("_words", lambda x, i: F.when((i + CHAIN <= F.size("_words")) | (i == 0), _chain("_words", i, lambda w: w)))
    plain = F.when((F.size("_found") == 0) & (F.size("_words") > 0), F.sort_array(F.array_distinct(F.filter(every, lambda x: x.isNotNull()))))
    return df.withColumn(out, F.coalesce(plain, "_found")).drop("_words", "_content", "_found")


def fingerprint(signature_set: str) -> Column:
    """A set of signatures as text: eight hexadecimal digits each, in order."""
    return F.array_join(signature_set, "")


def packed(signature_set: str) -> Column:
    """A set of signatures as four bytes each, in order: what is shuffled."""
    return F.unhex(F.array_join(signature_set, ""))


def unpacked(packed_set: str) -> Column:
    """The set that packed() holds."""
    return F.filter(F.split(F.lower(F.hex(packed_set)), r"(?<=\G.{8})"), lambda x: x != "")


def length_class(signature_set: str, least: float) -> Column:
    """The partition of a set: sets in classes more than one apart cannot be alike by `least`."""
    return F.floor(F.log(F.greatest(F.size(signature_set), F.lit(1)).cast("double")) / F.lit(math.log(1 / least) * 1.000001)).cast("int")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0, without an intersection, where their lengths alone keep it below `least`."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    possible = (F.least(n, m) > 0) & (F.least(n, m).cast("double") >= F.lit(least) * F.greatest(n, m))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when(possible, both.cast("double") / (n + m - both)).otherwise(F.lit(0.0))


def successors(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """k, next_k for every distinct id: the next smaller id, and the largest for the smallest."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID)).alias("k")).distinct()
    ranged = materialise(ids.repartitionByRange(F.desc("k")).withColumn("range", F.spark_partition_id()), "id-ranges")
    firsts = ranged.groupBy("range").agg(F.max("k").alias("first"))  # a row per range
    around = Window.orderBy(F.desc("first"))
    after = firsts.select(F.col("range"), F.coalesce(F.lead("first").over(around), F.max("first").over(Window.partitionBy())).alias("_after"))
    inside = ranged.withColumn("_next", F.lead("k").over(Window.partitionBy("range").orderBy(F.desc("k"))))
    return inside.join(after, "range").select("k", F.coalesce("_next", "_after").alias("next_k"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, length_class for each row of `docs`.

    The edited text has its last third replaced by as much of the next document's opening. A text's own set is made once, before rows
    are shuffled by id, and goes with them; the same shuffle serves rows and successors.
    """
    k, third = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID)).alias("k"), F.floor(F.length("text") / 3).cast("int")
    rows = signatures(docs.select(k, text_of(text_col).alias("text")), "text", "own_set").select("k", "text", packed("own_set").alias("own")).repartition("k")
    lengths = docs.select(k, third_of(text_col).alias("wanted")).groupBy("k").agg(F.max("wanted").alias("wanted"))
    links = materialise(successors(docs, id_col).join(lengths, "k"), "successors")  # narrow

    # each document as the successor of another: as much of its opening as that one wants, and its set
    ahead = rows.join(links.select(F.col("k").alias("of"), F.col("next_k").alias("k"), "wanted").hint("merge"), "k")
    ahead = ahead.select("of", F.struct(F.expr("left(text, wanted)").alias("opening"), "own").alias("next"), F.xxhash64("text").alias("h"))
    ahead = ahead.groupBy(F.col("of").alias("k")).agg(F.min_by("next", "h").alias("next"))

    met = rows.join(ahead.hint("merge"), "k").select("k", "text", unpacked("own").alias("own_set"), F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("next.opening", F.lit(1), third)).alias("edited"), unpacked("next.own").alias("next_set"))
    met = signatures(met, "edited", "edited_set")
    return met.select(
        F.when(F.col("k") != _FIRST_ID, F.col("k")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        "edited",
        fingerprint("own_set").alias("fingerprint"),
        fingerprint("edited_set").alias("edited_fingerprint"),
        likeness("own_set", "edited_set").alias("near_edited"),
        likeness("own_set", "next_set").alias("near_next"),
        length_class("own_set", LEAST).alias("length_class"),
    )


def similar(left: DataFrame, right: DataFrame, least: float, id_col: str = "id", set_col: str = "signatures") -> DataFrame:
    """left_id, right_id, likeness of all pairs of `left` and `right` (id, signatures) with a likeness of `least` or more.

    Ids are unique in each table. All pairs that reach `least` are rows, so of groups of copies give distinct sets. Empty or null sets are like
    nothing.
    """
    one = left.select(F.col(id_col).alias("id"), F.col(set_col).alias("s")).where(F.size(set_col) > 0).withColumn("side", F.lit(0))
    two = right.select(F.col(id_col).alias("id"), F.col(set_col).alias("s")).where(F.size(set_col) > 0).withColumn("side", F.lit(1))
    sets = materialise(one.unionByName(two).withColumn("n", F.size("s")).withColumn("class", length_class("s", least)), "sets")
    each = sets.select("side", "id", "n", "class", F.explode("s").alias("sig"))
    counts = each.groupBy("sig").agg(F.count("*").alias("f"))
    # each set's signatures from the rarest on; two alike sets share one of the first of both
    ranked = each.join(counts, "sig").groupBy("side", "id", "n", "class").agg(F.sort_array(F.collect_list(F.struct("f", "sig"))).alias("r"))
    first = F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int"))
    heads = materialise(ranked.select("side", "id", "n", "class", F.posexplode(first).alias("at", "x")).select("side", "id", "n", "class", "at", "x.sig"), "set-heads")
    a = heads.where("side = 0").select(F.col("id").alias("left_id"), F.col("n").alias("n1"), F.col("at").alias("at1"), "sig", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    b = heads.where("side = 1").select(F.col("id").alias("right_id"), F.col("n").alias("n2"), F.col("at").alias("at2"), "sig", "class")
    # at the first signature that both share, no more can follow than either has left
    most = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    possible = (F.least("n1", "n2") >= F.lit(least) * F.greatest("n1", "n2") - 1e-9) & (most >= F.lit(least) * (F.col("n1") + F.col("n2") - most) - 1e-9)
    met = a.join(b, ["class", "sig"]).groupBy("left_id", "right_id", "n1", "n2").agg(F.min("at1").alias("at1"), F.min("at2").alias("at2")).where(possible)
    of = lambda side, name: sets.where(F.col("side") == side).select(F.col("id").alias(f"{name}_id"), F.col("s").alias(name))
    pairs = met.select("left_id", "right_id").join(of(0, "left"), "left_id").join(of(1, "right"), "right_id")
    return pairs.select("left_id", "right_id", likeness("left", "right", least).alias("likeness")).where(F.col("likeness") >= least)


def third_of(text_col: str) -> Column:
    return F.floor(F.length(text_of(text_col)) / 3).cast("int")


_ANCHORS = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS)) + "]"
_NEAR = """CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0::DOUBLE
  WHEN least(len({0}), len({1})) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE END"""

#: The contract's fingerprints in SQL.
ORACLE = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d
), e AS (
  SELECT *, left(text, (length(text) - length(text) // 3)::INT) || left(nxt, (length(text) // 3)::INT) AS edited FROM s
), t AS (
  SELECT doc_id, 1 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 2, edited FROM e UNION ALL SELECT doc_id, 3, nxt FROM e
), w AS (
  SELECT doc_id, kind, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM t
), c AS (
  SELECT *, list_filter(list_transform(words, lambda x, i: {'w': x, 'a': i > 1 AND coalesce(list_contains(ANCHORS, words[i - 1]), false)}), lambda s: NOT list_contains(ANCHORS, s.w)) AS content FROM w
), g AS (
  SELECT doc_id, kind, words, list_filter(list_transform(content, lambda s, i: CASE WHEN i < len(content) AND (s.a OR (i > GAP AND NOT list_bool_or(list_transform(content[i - GAP : i - 1], lambda y: y.a)))) THEN left(md5(s.w || ' ' || content[i + 1].w), 8) END), lambda x: x IS NOT NULL) AS found FROM c
), f AS (
  SELECT doc_id, kind, list_sort(list_distinct(CASE WHEN len(found) > 0 OR len(words) = 0 THEN found WHEN len(words) = 1 THEN [left(md5(words[1]), 8)] ELSE list_transform(words[1 : len(words) - 1], lambda x, i: left(md5(x || ' ' || words[i + 1]), 8)) END)) AS sigs FROM g
), p AS (
  SELECT a.doc_id, a.sigs AS own, b.sigs AS edited, n.sigs AS nxt FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.kind = 2 JOIN f n ON a.doc_id = n.doc_id AND n.kind = 3 WHERE a.kind = 1
)
SELECT doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(p.edited, '') AS edited_fingerprint,
  NEAR_EDITED AS near_edited, NEAR_NEXT AS near_next, floor(ln(greatest(len(own), 1)::DOUBLE) / (ln(10.0::DOUBLE) * 1.000001::DOUBLE))::INT AS length_class
FROM p JOIN e USING (doc_id)
""".replace("ANCHORS", _ANCHORS).replace("GAP", str(GAP)).replace("NEAR_EDITED", _NEAR.format("own", "p.edited")).replace("NEAR_NEXT", _NEAR.format("own", "p.nxt"))
)
