"""Streams over landed rows: the last stage of each item, incremental processing, log tails.

A stream is drained with the trigger `availableNow`; what a bounded queue does elsewhere, limits on the source do here. Keyed state
lives in Spark's state store and survives restarts through the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.sources.readers import parse_log


def read_files(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", per_trigger: int = 100) -> DataFrame:
    """Parquet files that land in a folder, at most `per_trigger` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest_stage(updates: DataFrame) -> DataFrame:
    """video_id, stage, updates, started from a stream of (video_id, stage, seq); late rows of a lower seq change nothing."""
    return updates.groupBy("video_id").agg(F.max_by("stage", "seq").alias("stage"), F.count("*").alias("updates"), F.min("seq").alias("started"))


def tail_log(lines: DataFrame) -> DataFrame:
    """Lines per task and level of a stream of log lines (value)."""
    return parse_log(lines).groupBy("task", "level").agg(F.count("*").alias("n"))


def drain(result: DataFrame, path: str, checkpoint: str, mode: str = "complete", keys: Sequence[str] = ()) -> DataFrame:
    """Runs a stream until nothing is left and returns its latest result, from tables below `path`, one per batch.

    In update mode a batch only holds what changed, so of each of `keys` the row of the last batch that has it counts; in complete
    mode the last batch is whole, and those before it are removed once it is written. A batch that is run again replaces its own table.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        before = result.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - 1}")
        if mode == "complete":
            before.getFileSystem(result.sparkSession._jsc.hadoopConfiguration()).delete(before, True)

    result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark, schema = result.sparkSession, StructType([*result.schema.fields, StructField("batch", LongType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # nothing ever came
        return spark.createDataFrame([], result.schema)
    kept = spark.read.schema(schema).parquet(path)
    if mode == "complete":
        return kept.join(F.broadcast(kept.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")  # one row
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in result.columns if c not in keys]), "batch").alias("_l")).select(*keys, "_l.*").select(*result.columns)


def watch(query: StreamingQuery) -> list[dict]:
    """What a running or finished stream reports of its last batches: number, rows in, rows a second, milliseconds."""
    return [{"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": p.batchDuration} for p in query.recentProgress]


def process_new(items: DataFrame, archive: str, out: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Processes items of a stream that the archive (Parquet, by batch) does not list, and lists them once they are written.

    Each batch writes its results, then its part of the archive, both below its own number: a batch that is run again after a
    failure replaces what it wrote, and nothing is processed twice or lost.
    """
    spark = items.sparkSession
    key_type = dict(items.dtypes)[key]

    def batch(rows: DataFrame, number: int) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(archive)
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        known = spark.read.schema(f"{key} {key_type}, batch long").parquet(archive).where(F.col("batch") < number).select(key) if there else spark.createDataFrame([], f"{key} {key_type}")
        new = rows.join(known, key, "left_anti")
        work(new).write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.select(key).distinct().write.mode("overwrite").parquet(f"{archive}/batch={number}")

    items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
