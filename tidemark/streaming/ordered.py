"""Keyed state that does not depend on the order in which rows arrive.

Files of a stream come in any order, and so do rows of a key. What a fold over a key's sequence needs is kept so that a late row falls into
its place: here the failures behind the last success, by sequence number. Rows older than the watermark cannot be preceded by
others any more; a timer then settles them into a number, so the buffer holds the lateness allowed, not the key's history.
State lives in the RocksDB state store; sessions set it by `use_state_store`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Queries that this session starts from now on keep their state in RocksDB, which arbitrary keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class FailureRuns(StatefulProcessor):
    """Failures behind the last success of a proxy, by sequence number.

    held: the sequence number of the last success, failures in all, those settled behind it, and up to which number they are.
    pending: failures behind both that are not settled, with their times.
    """

    def __init__(self, threshold: int, timed: bool):
        self.threshold, self.timed = threshold, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last_ok long, total long, settled long, upto long")
        self.pending = handle.getMapState("pending", "seq long", "at long")

    def _read(self) -> tuple[int, int, int, int]:
        return tuple(self.held.get()) if self.held.exists() else (-(1 << 62), 0, 0, -(1 << 62))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last_ok, total, settled, upto = self._read()
        new = pd.concat(list(rows))
        failed, good = new[~new["ok"]], new[new["ok"]]
        total += len(failed)
        if len(good) and int(good["seq"].max()) > last_ok:
            last_ok = int(good["seq"].max())
            if upto < last_ok:  # the success is behind all that was settled
                settled, upto = 0, last_ok
        for seq, at in zip(failed["seq"].tolist(), failed["ms"].tolist(), strict=True):
            if seq > last_ok:
                self.pending.updateValue((seq,), (at,))
        waiting = {k[0]: v[0] for k, v in self.pending.iterator()}
        for seq in [s for s in waiting if s < last_ok]:
            self.pending.removeKey((seq,))
            del waiting[seq]
        self.held.update((last_ok, total, settled, upto))
        if self.timed and waiting:
            self.handle.registerTimer(max(waiting.values()))
        yield self._row(key, settled + len(waiting), total)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last_ok, total, settled, upto = self._read()
        now, waiting = timerValues.getCurrentWatermarkInMs(), sorted((k[0], v[0]) for k, v in self.pending.iterator())
        for seq, at in waiting:
            if at > now:
                break
            settled, upto = settled + 1, max(upto, seq)
            self.pending.removeKey((seq,))
        self.held.update((last_ok, total, settled, upto))
        yield self._row(key, 0, 0).iloc[:0]  # nothing changed

    def _row(self, key: tuple, run: int, total: int) -> pd.DataFrame:
        return pd.DataFrame({"proxy": [key[0]], "consecutive": [run], "failures": [total], "unhealthy": [run >= self.threshold]})

    def close(self) -> None:
        pass


def failure_runs(events: DataFrame, threshold: int = 5, lateness: str | None = None) -> DataFrame:
    """proxy, consecutive, failures, unhealthy after each batch, from a stream of (proxy, seq, ok), whatever the order of arrival.

    Sequence numbers are unique in a proxy and grow with time. With `lateness`, rows have a time `at`: those that come later than that are left
    out, and failures that old are settled. Without it, a proxy's failures since its last success are all kept.
    """
    from pyspark.sql import functions as F

    use_state_store(events.sparkSession)
    if lateness:
        rows = events.withWatermark("at", lateness).select("proxy", "seq", "ok", "at", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"))
    else:
        rows = events.select("proxy", "seq", "ok", F.lit(0).cast("long").alias("ms"))
    return rows.groupBy("proxy").transformWithStateInPandas(
        FailureRuns(threshold, bool(lateness)), f"proxy {dict(events.dtypes)['proxy']}, consecutive long, failures long, unhealthy boolean", "Update", "EventTime" if lateness else "None"
    )
