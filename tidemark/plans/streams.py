"""Queries that run as streams until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.structured import BLOCKS_SQL
from tidemark.sources import carriers as C
from tidemark.sources.places import place
from tidemark.streaming import blocks, monitor, ordered, state

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of its files, be it one file or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return state.read_files(spark, f"{sf_dir}/events.parquet", _EVENTS)
    return state.read_files(spark, sf_dir, _EVENTS, "events.parquet")


@query("SELECT user_id AS video_id, arg_max(event_type, event_id) AS stage, count(*) AS updates, min(event_id) AS started FROM events GROUP BY user_id")
def stream_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage of each item, kept in the state of a stream."""
    base = place(spark, "stream")
    updates = _events(spark, sf_dir).select(F.col("user_id").alias("video_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"))
    return state.drain(state.latest_stage(updates), f"{base}/out", f"{base}/checkpoint")


@query("WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS ok, max(CASE WHEN event_type <> 'error' THEN event_id ELSE -1 END) OVER (PARTITION BY user_id) AS last_ok FROM events) SELECT user_id AS proxy, count_if(NOT ok AND event_id > last_ok) AS consecutive, count_if(NOT ok) AS failures, count_if(NOT ok AND event_id > last_ok) >= 2 AS unhealthy FROM r GROUP BY user_id")
def stream_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = place(spark, "stream")
    events = _events(spark, sf_dir).select(F.col("user_id").alias("proxy"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return state.drain(ordered.failure_runs(events, 2), f"{base}/out", f"{base}/checkpoint", "update", ["proxy"])


@query(BLOCKS_SQL + "SELECT video_id, part, start_ms, end_ms, text, n_cues FROM blocks")
def stream_cue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of cues that arrive in four files, each with every fourth cue of a video; the streaming twin of cue_merge."""
    base = place(spark, "stream")
    cues = C.cues(spark, sf_dir).select("video_id", "pos", "start_ms", "end_ms", "text")
    cues.withColumn("file", F.col("pos") % 4).repartition(4, "file").write.partitionBy("file").parquet(f"{base}/in")
    stream = spark.readStream.schema("video_id long, pos int, start_ms long, end_ms long, text string").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(f"{base}/in")
    return state.drain(blocks.merged_blocks(stream, most_chars=300), f"{base}/out", f"{base}/checkpoint", "update", ["video_id", "part"])


@query("""SELECT 'intake' AS stage, count(*)::BIGINT AS rows, count_if(event_type = 'error')::BIGINT AS failed, 0::BIGINT AS skipped, count_if(coalesce(event_type <> 'error', true))::BIGINT AS passed FROM events
UNION ALL SELECT 'values', count(*)::BIGINT, count_if(value > 100)::BIGINT, count_if(user_id % 5 = 0 AND NOT coalesce(value > 100, false))::BIGINT, count_if(NOT coalesce(value > 100, false) AND NOT coalesce(user_id % 5 = 0, false))::BIGINT FROM events WHERE event_type <> 'error'""")
def stream_stage_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two stages of a stream took in, failed, skipped and let through, by a listener."""
    base, watcher = place(spark, "stream"), monitor.StageMonitor()
    taken = monitor.observed(_events(spark, sf_dir), "intake", F.col("event_type") == "error").where("event_type <> 'error'")
    large = F.coalesce(F.col("value") > 100, F.lit(False))
    done = monitor.observed(taken, "values", large, (F.col("user_id") % 5 == 0) & ~large)
    spark.streams.addListener(watcher)
    try:
        query_ = done.select("event_id").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query_.awaitTermination()
        watcher.wait_for(query_)
    finally:
        spark.streams.removeListener(watcher)
    return monitor.stage_figures(watcher.table(spark)).select("stage", "rows", "failed", "skipped", "passed")
