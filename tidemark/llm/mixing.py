"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected number of copies is its source's target over the
source's size (times an optional weight of its own); its whole part is taken for certain, and for the rest the documents of
a source are ranked by Pareto order sampling: random odds divided by inclusion odds, the smallest first, until the words
that the source still needs are filled. The number of words taken is thus fixed, not random: it differs from the target by
half a document at most.

A source may hold a third of all rows, so no source is sorted in one task. The ranking value is cut into `BINS` bins, words are
counted per source and bin (combined before the shuffle), and the bin where the target is reached is found from those
counts; that bin is cut into `BINS` finer ones, and so on, `LEVELS` times. Only documents of the last bin are ordered: of a
source of n documents about n / BINS^LEVELS. Sources that need no further copy than the certain ones have no such bin, and
documents that no further copy is drawn from are never ordered. The random number of a document comes from a digest of its
id and a seed, so reruns agree.

Defined cases: null text has size 0; null sources are one source, ordered last; documents of size 0 take 0 words; rows that
repeat an id have the same random number and are ordered by size (an id's rows are ordered together, if the target is reached there); an empty table gives an empty result; a source column that
is missing is an error, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialise, text_of

#: Bins that a bin of the level before is cut into, and levels: 2^24 bins of the ranking value in all.
BINS, LEVELS = 256, 3


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target for a table (source, source_size), one row per source.

    Sources by code point, nulls last, weigh `weights` in turn and share `share` of all sizes; no target exceeds `cap` times
    its source's size, and what is cut off goes to the others by weight. That fixed point is found without iterating: by
    rising cap over weight, the sources that reach their cap are a prefix. The windows run over one row per source.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)) + 1).cast("int"))
    rising = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    capped = sizes.select("source", "source_size", turn.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
    all_of = Window.partitionBy()
    steps = capped.withColumn("_ratio", F.col("_cap") / F.col("_w")).select(
        "*",
        (F.sum("source_size").over(all_of) * F.lit(float(share))).alias("_total"),
        (F.sum("_cap").over(rising) - F.col("_cap")).alias("_before"),
        (F.sum("_w").over(all_of) - F.sum("_w").over(rising) + F.col("_w")).alias("_after"),
    )
    level = (F.col("_total") - F.col("_before")) / F.col("_after")
    # behind the first source below its cap the levels fall, so the largest is the one that holds for all such sources
    levels = steps.withColumn("_level", F.max(F.when(F.col("_cap") > level * F.col("_w"), level)).over(all_of))
    return levels.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def uniform(column: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the value and the seed."""
    digest = F.md5(F.concat(F.coalesce(column.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, weight_col: str | None = None, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies (whole copies and the sampled one), taken.

    `weight_col` makes inclusion unequal inside a source too: expected copies are proportional to it (at most `cap`). What
    the cap cuts off there is made up by sampling further down the ranking. `row_col`, a key of rows, is given back as row and
    orders rows that are otherwise equal.
    """
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    words = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), F.col(source_col).alias("source"), weight.alias("weight"), *([F.col(row_col).alias("row")] if row_col else []))
    row = ["row"] if row_col else []
    words = materialise(words, "mix-sizes")
    of = words.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("_sw"))
    targets = source_targets(of.select("source", "source_size"), weights, share, cap).withColumnRenamed("source", "s1").join(of.select(F.col("source").alias("s2"), "_sw"), F.col("s1").eqNullSafe(F.col("s2"))).drop("s2")
    targets = materialise(targets, "mix-targets")  # a row per source

    expected = F.when(F.col("_sw") > 0, F.least(F.lit(float(cap)), F.col("target") * F.col("weight") / F.col("_sw"))).otherwise(F.lit(0.0))
    ready = words.join(targets, F.col("source").eqNullSafe(F.col("s1"))).drop("s1").withColumn("_e", expected).withColumn("whole", F.floor("_e").cast("long"))
    inclusion, u = F.col("_e") - F.col("whole"), uniform(F.col("doc_id"), seed)
    odds = (u / (F.lit(1.0) - u)) / (inclusion / (F.lit(1.0) - inclusion))
    # odds / (1 + odds) ranks as the odds do, and lies in (0, 1); a document that needs no further copy has no rank
    rank = F.when(inclusion > 0, odds / (F.lit(1.0) + odds))
    ready = ready.withColumn("_rank", rank).withColumn("_bin", F.when(F.col("_rank").isNotNull(), F.least(F.floor(F.col("_rank") * (BINS**LEVELS)), F.lit(BINS**LEVELS - 1))))

    # a row per source that has words left to fill beyond the certain copies; bins are looked for there alone
    certain = ready.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("_certain"), F.first("target").alias("_target"))
    edge = certain.select(F.col("source").alias("s3"), (F.col("_target") - F.col("_certain")).alias("_rest"), F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_before"))
    for level in range(LEVELS):
        edge = materialise(edge, "mix-edges")  # a row per source
        wide, narrow = BINS ** (LEVELS - level), BINS ** (LEVELS - level - 1)
        inside = ready.where("_bin is not null").join(edge, F.col("source").eqNullSafe(F.col("s3")) & (F.floor(F.col("_bin") / wide) == F.col("_at")))
        bins = inside.groupBy("s3", F.floor(F.col("_bin") / narrow).alias("_b")).agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
        upto = F.col("_before") + F.sum("_words").over(Window.partitionBy("s3").orderBy("_b"))  # `BINS` rows a source
        # the first bin that the rest does not fill: all before it are taken, none behind it
        over = bins.withColumn("_upto", upto).where(F.col("_upto") > F.col("_rest")).groupBy("s3").agg(F.min_by(F.struct("_rest", "_b", (F.col("_upto") - F.col("_words")).alias("_before")), "_b").alias("_e"))
        edge = over.select("s3", "_e._rest", F.col("_e._b").alias("_at"), "_e._before")
    placed = ready.join(materialise(edge, "mix-edges"), F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    ordered = Window.partitionBy("source").orderBy("_rank", F.asc_nulls_last("doc_id"), "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    last_bin = F.coalesce(F.col("_bin") == F.col("_at"), F.lit(False))
    filled = F.col("_before") + F.sum("size").over(ordered) - F.col("size") / F.lit(2.0)
    chosen = placed.where(last_bin).withColumn("extra", (filled <= F.col("_rest")) & (F.col("_rank") < 1))
    rest = placed.where(~last_bin).withColumn("extra", F.coalesce((F.col("_at").isNull() | (F.col("_bin") < F.col("_at"))) & (F.col("_rank") < 1), F.lit(False)))
    copies = F.col("whole") + F.col("extra").cast("long")
    return rest.unionByName(chosen).select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *row)


#: The contract's mix in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), o AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM o
), l AS (
  SELECT *, (total - (sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap)) / ((sum(w) OVER ()) - (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)) + w) AS level FROM c
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE cap > level * w) * w, cap)) AS target FROM l
), e AS (
  SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target * 1.0::DOUBLE / source_size::DOUBLE) ELSE 0.0::DOUBLE END AS ex,
    (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|mix'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, floor(ex)::BIGINT AS whole, ex - floor(ex) AS p FROM e
), r AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p))) / (1.0::DOUBLE + ((u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)))) ELSE 1.0::DOUBLE END AS rank FROM f
), s AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM r
)
SELECT doc_id, size, source_size, target, (CASE WHEN rank < 1 AND upto - size / 2.0::DOUBLE <= rest THEN whole + 1 ELSE whole END * size)::BIGINT AS taken FROM s
"""
