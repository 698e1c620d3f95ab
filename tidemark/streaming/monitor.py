"""What each stage of a stream takes in, lets through and fails, batch by batch, as a table.

A stage is observed where its rows pass: Spark counts them beside the work, without a job or a shuffle of its own, and reports the counts
with each batch's progress. A listener collects the reports of all queries of a session.
"""

from __future__ import annotations

import time
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

_PREFIX = "stage "
SCHEMA = "query string, batch long, stage string, rows long, failed long, skipped long, ms long"


def observed(rows: DataFrame, stage: str, failed: Column, skipped: Column | None = None) -> DataFrame:
    """`rows`, counted under the name of a stage: all, those that `failed` holds for, and those `skipped`. One place per stage and query."""
    none = F.lit(False)
    return rows.observe(_PREFIX + stage, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(failed, none)).alias("failed"), F.count_if(F.coalesce(skipped, none) if skipped is not None else none).alias("skipped"))


class StageMonitor(StreamingQueryListener):
    """Collects the counts of observed stages: a row per query, batch and stage, until they are taken."""

    def __init__(self) -> None:
        self._rows: dict[tuple, tuple] = {}
        self._lock = Lock()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        with self._lock:
            for name, counts in p.observedMetrics.items():
                if name.startswith(_PREFIX):
                    # a batch that is run again replaces its counts
                    self._rows[str(p.id), p.batchId, name[len(_PREFIX) :]] = (counts["rows"], counts["failed"], counts["skipped"], p.batchDuration)

    def wait_for(self, query: StreamingQuery, seconds: float = 30.0) -> bool:
        """Waits until the last batch of a query that has ended is counted; reports come a little later than their batches."""
        last, until = query.lastProgress, time.monotonic() + seconds
        while last is not None and last.observedMetrics and time.monotonic() < until:
            with self._lock:
                if any(k[0] == str(last.id) and k[1] == last.batchId for k in self._rows):
                    return True
            time.sleep(0.05)
        return last is None or not last.observedMetrics

    def table(self, spark: SparkSession) -> DataFrame:
        """query, batch, stage, rows, failed, skipped, ms of all batches so far."""
        with self._lock:
            rows = [(*k, *v) for k, v in self._rows.items()]
        return spark.createDataFrame(rows, SCHEMA)

    def flush(self, spark: SparkSession, path: str) -> int:
        """Adds what has come since the last time to a table at `path`, and forgets it; how many rows that were."""
        with self._lock:
            rows, self._rows = [(*k, *v) for k, v in self._rows.items()], {}
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return len(rows)


def stage_figures(table: DataFrame) -> DataFrame:
    """stage, batches, rows, failed, skipped, passed, rows_per_second over a monitor's table."""
    by = table.groupBy("stage").agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in ("rows", "failed", "skipped", "ms")])
    return by.select("stage", "batches", "rows", "failed", "skipped", (F.col("rows") - F.col("failed") - F.col("skipped")).alias("passed"), (F.col("rows") * 1000 / F.greatest("ms", F.lit(1))).alias("rows_per_second"))
