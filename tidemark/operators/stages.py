"""Plans of the stages detect, download and summarise, with errors as data.

Rows carry a channel beside their data: error_stage, error_type and error of what failed, skip_reason of what is left out. A stage takes
rows and gives all of them back; those that failed or were skipped before pass it by as they are, so one plan runs all stages
and no row is lost. A row that a stage fails keeps the stage, the class and the cause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.errors import classify, message_of
from tidemark.operators.state import run_totals
from tidemark.operators.translation import call_class, call_once

CHANNEL = ("error_stage", "error_type", "error", "skip_reason")


def begin(items: DataFrame) -> DataFrame:
    """`items` with an empty channel."""
    return items.withColumns({c: F.lit(None).cast("string") for c in CHANNEL})


def passing() -> Column:
    """Whether a row goes through a stage."""
    return F.col("error_type").isNull() & F.col("skip_reason").isNull()


def close(rows: DataFrame, stage: str, kind: Column, error: Column, skip: Column) -> DataFrame:
    """`rows` with what a stage found put into the channel of those that went through it: `kind` and `error` of failures, `skip` of others."""
    go = passing()
    after = {
        "error_stage": F.when(go & kind.isNotNull(), F.lit(stage)).otherwise(F.col("error_stage")),
        "error": F.when(go & kind.isNotNull(), error).otherwise(F.col("error")),
        "error_type": F.when(go, kind).otherwise(F.col("error_type")),
        "skip_reason": F.when(go, skip).otherwise(F.col("skip_reason")),
    }
    return rows.withColumns(after)


def detect(rows: DataFrame, detections: DataFrame, archive: DataFrame, dry_run: bool = False, force: bool = False) -> DataFrame:
    """`rows` with has_subtitles from `detections` (video_id, n_tracks, stderr, timed_out; stderr is null where detection went well).

    What `archive` (video_id) lists is skipped unless `force`. Without tracks a row fails as content, in a dry run it is skipped. A
    video without a detection failed for an unknown reason.
    """
    listed = archive.select("video_id").distinct().withColumn("_listed", F.lit(True))
    met = rows.join(listed, "video_id", "left").join(detections, "video_id", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)) & (not force))
    found, failed = F.col("n_tracks"), F.col("stderr").isNotNull()
    kind = F.when(failed, classify(F.col("stderr"), F.coalesce("timed_out", F.lit(False)))).when(found.isNull(), "unknown").when((found == 0) & (not dry_run), "content")
    error = F.when(failed, message_of(F.col("stderr"))).when(found.isNull(), "no detection").otherwise("no subtitles")
    skip = F.when(F.col("_listed"), "archived").when(kind.isNull() & (found == 0), "no subtitles (dry run)")
    went = passing() & ~F.col("_listed")
    met = met.withColumn("has_subtitles", F.when(went & ~failed, found > 0))
    return close(met, "detect", F.when(~F.col("_listed"), kind), error, skip).select(*rows.columns, "has_subtitles")


def download(rows: DataFrame, fetched: DataFrame, dry_run: bool = False) -> DataFrame:
    """`rows` (behind detect) with original and translated, the files of `fetched` (video_id, item, ok, file).

    Without the original a row fails as network, in a dry run it is skipped; a row without a detection is invalid input. Targets without a file
    do not fail it.
    """
    good = F.when(F.col("ok"), F.col("file"))
    files = fetched.groupBy("video_id").agg(F.max(F.when(F.col("item") == "original", good)).alias("original"), F.array_sort(F.collect_list(F.when(F.col("item") != "original", good))).alias("translated"))
    met = rows.join(files, "video_id", "left")
    missing = F.col("original").isNull()
    kind = F.when(F.col("has_subtitles").isNull(), "invalid_input").when(missing & (not dry_run), "network")
    error = F.when(F.col("has_subtitles").isNull(), "no detection").otherwise("no original")
    skip = F.when(kind.isNull() & missing, "no original (dry run)")
    went = passing()
    met = met.withColumns({c: F.when(went & kind.isNull() & ~missing, F.col(c)) for c in ("original", "translated")})
    return close(met, "download", kind, error, skip)


def summarize(rows: DataFrame, prompts: DataFrame, provider: str | None, cache: str) -> DataFrame:
    """`rows` (behind download) with summary: a provider's answer to `prompts` (video_id, prompt).

    Without a provider, or a prompt, a row goes through without a summary. A failed call fails the row by the provider's class.
    """
    none = F.lit(None).cast("string")
    if provider is None:
        return rows.withColumn("summary", none)
    asked = rows.join(prompts.select("video_id", F.col("prompt").alias("_prompt")), "video_id", "left").withColumn("_prompt", F.when(passing(), F.col("_prompt")))
    done = call_once(asked, provider, "_prompt", cache).drop("_prompt")
    closed = close(done, "summarize", call_class(F.col("call_error")), F.col("call_error"), none)
    return closed.withColumnRenamed("answer", "summary").drop("call_error")


def totals(rows: DataFrame) -> DataFrame:
    """Totals of a run, by state.run_totals(): done is what passed all stages."""
    return run_totals(rows.select(F.col("error_type").alias("error"), "skip_reason", passing().alias("done")))
