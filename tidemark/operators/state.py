"""State of batches: stages, chunks, archives, proxies, progress, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages of an item, in order (fixed values).
STAGES = ("pending", "detecting", "downloading", "translating", "summarizing", "outputting", "done", "failed", "skipped")


def stage_statistics(items: DataFrame, stage: str = "stage") -> DataFrame:
    """How many items are in each of the nine stages, zero included."""
    every = items.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    counts = items.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"))
    return every.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def run_totals(items: DataFrame) -> DataFrame:
    """Totals of a run over items (error, skip_reason, done): thread mode tells skipped from failed, staged mode does not."""
    bad, skipped = F.col("error").isNotNull(), F.col("skip_reason").isNotNull()
    good = ~bad & ~skipped & F.col("done")
    return items.agg(F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(bad | (~skipped & ~F.col("done"))).alias("failed"), F.count_if(~bad & skipped).alias("skipped"), (F.count("*") - F.count_if(good)).alias("failed_staged"))


def unprocessed(items: DataFrame, archive: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Items that an archive does not list, repeated ones included; all of them if forced."""
    return items if force else items.join(archive.select(key).distinct(), key, "left_anti")


def read_archive(lines: DataFrame) -> DataFrame:
    """video_id of archive lines (value): the site's name, blanks, the id; anchored at the line's start."""
    return lines.select(F.regexp_extract("value", r"^youtube\s+(\S+)", 1).alias("video_id")).where("video_id != ''").distinct()


def chunk_status(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Progress of chunks (`keys`, is_completed, failed): counts, percent, whether all are done."""
    done, total = F.count_if("is_completed"), F.count("*")
    return chunks.groupBy(*keys).agg(total.alias("total"), done.alias("completed"), F.count_if(F.col("failed") & ~F.col("is_completed")).alias("failed"), (total - done).alias("pending"), (F.lit(100.0) * done / total).alias("percent"), (done >= total).alias("is_complete"))


def merge_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Translated chunks joined in order, for those keys whose chunks are all there."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "translated")))
    whole = chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.count("translated").alias("there"), ordered.alias("_o"))
    return whole.where("n = there").select(*keys, F.array_join(F.transform("_o", lambda x: x["translated"]), "\n\n").alias("content"))


def timeline_problems(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Cues that end before they start, or start before the one before them ends. Nothing overlaps an end of 0."""
    before = F.lag("end_ms").over(Window.partitionBy(*keys).orderBy("pos"))
    marked = cues.withColumn("_before", before)
    problem = F.when(F.col("start_ms") >= F.col("end_ms"), "inverted").when((F.col("_before") > 0) & (F.col("start_ms") < F.col("_before")), "overlap")
    return marked.withColumn("problem", problem).where("problem is not null").drop("_before")


def weighted_average(records: DataFrame, keys: list[str], value: str, order: list[str], last: int = 10) -> DataFrame:
    """Average of the last `last` values with weights 1, 2, ...; the newest weighs most. Null before the second record."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), 0)
    values = F.collect_list(value).over(w)
    folded = F.aggregate("_v", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x * (a["n"] + 1)).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] * 2 / (a["n"] * (a["n"] + 1)))
    return records.withColumn("_v", values).withColumn("average", F.when(F.size("_v") >= 2, folded)).drop("_v")


def consecutive_failures(events: DataFrame, keys: list[str], ok: Column, order: list[str], threshold: int = 5) -> DataFrame:
    """Running counts per key: failures since the last success, failures in all, and whether that makes the key unhealthy."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("_ok", ok).withColumn("_run", F.sum(F.col("_ok").cast("int")).over(w))
    inside = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    failed = F.sum((~F.col("_ok")).cast("int"))
    return runs.withColumn("consecutive", failed.over(inside)).withColumn("failures", failed.over(w)).withColumn("unhealthy", F.col("consecutive") >= threshold).drop("_ok", "_run")


def stage_durations(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`events` (`keys`, stage, kind, ms) that end what the one before them, of the same key and stage, started, with took."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = events.withColumn("_kind", F.lag("kind").over(w)).withColumn("_stage", F.lag("stage").over(w)).withColumn("_ms", F.lag("ms").over(w))
    return seen.where((F.col("kind") == "end") & (F.col("_kind") == "start") & (F.col("stage") == F.col("_stage"))).withColumn("took", F.col("ms") - F.col("_ms")).drop("_kind", "_stage", "_ms")


def duration_sketches(durations: DataFrame, by: list[str], k: int = 400) -> DataFrame:
    """`by`, n, sketch: a quantile sketch of took per group, to be kept and merged; ranks are right to about 1.8 / k with probability 0.99."""
    return durations.groupBy(*by).agg(F.count("took").alias("n"), F.kll_sketch_agg_bigint("took", F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: list[str], shares: list[float], k: int = 400) -> DataFrame:
    """`by`, n, quantiles (an array, in the order of `shares`) of kept sketches (n, sketch), merged and never made anew from rows."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("_s"))
    return merged.select(*by, "n", F.array(*[F.kll_sketch_get_quantile_bigint("_s", F.lit(q)) for q in shares]).alias("quantiles"))


def stage_timing(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Durations from a start (kind 'start') to the end right behind it, of the same key, per stage."""
    pairs = stage_durations(events, keys, order)
    by = pairs.groupBy("stage").agg(F.count("*").alias("n"), F.avg("took").alias("avg_ms"), F.min("took").alias("min_ms"), F.max("took").alias("max_ms"))
    return by.withColumn("share", F.col("avg_ms") / F.sum("avg_ms").over(Window.partitionBy()))  # a row per stage
