"""Bursts of activity, found while it arrives.

Events are first counted per user and second, with map-side combine, and leave that count in time order,
once the watermark has passed them. What is kept for a user is then the last second seen and the bursts
that are still open, however many events there were; a timer reports a burst when its time is over.

An event is late if it is not newer than the watermark, the newest time seen less the delay, as of the
batch before its own: it is left out (Spark counts the user seconds left out in the query's progress). If
none is late, `closed_bursts` holds what `operators.activity.bursts` makes of the same events, for all bursts
whose time is over, and however files fall into batches. Events before 1970 are late; events without user
or time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chatterscope.params import DAY

ACTIVITY = "redditor string, created_utc bigint, kind string, item_id string"
STARTS = "redditor string, created_utc bigint, events bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Bursts(StatefulProcessor):
    """One user's seconds in, finished bursts out."""

    def __init__(self, silence: int, burst: int):
        self._silence, self._burst = silence, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "second bigint")
        self._open = handle.getMapState("open", "start bigint", "events bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The seconds that the watermark has passed since the last batch: a row each, in any order."""
        new = pd.concat(rows).sort_values("second")
        times = new["second"].to_numpy("int64")
        sums = np.concatenate([[0], np.cumsum(new["n"].to_numpy("int64"))])

        def until(start: int) -> int:
            return int(np.searchsorted(times, start + self._burst, "right"))

        for start, events in [(k[0], v[0]) for k, v in self._open.iterator()]:
            self._open.updateValue((start,), (events + int(sums[until(start)]),))
        if self._last.exists():
            before = np.concatenate([[self._last.get()[0]], times[:-1]])
            begun = np.flatnonzero(times - before >= self._silence)
        else:  # a first activity ends no silence
            begun = np.flatnonzero(np.diff(times) >= self._silence) + 1
        for i in begun.tolist():
            start = int(times[i])
            self._open.updateValue((start,), (int(sums[until(start)] - sums[i]),))
            self._handle.registerTimer((start + self._burst) * 1000)
        self._last.update((int(times[-1]),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No second of this burst can follow: those up to the watermark were handled before."""
        start = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self._burst
        (events,) = self._open.getValue((start,))
        self._open.removeKey((start,))
        yield pd.DataFrame({"redditor": [key[0]], "created_utc": [start], "events": [events]})


def activity_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Activity rows as their Parquet files land."""
    return spark.readStream.schema(ACTIVITY).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def finished_starts(activity: DataFrame, inactivity_days: int, burst_days: int, delay: str) -> DataFrame:
    """`(redditor, created_utc, events)` of each activity that ended a silence with a beginning, once the
    watermark, which trails the newest time by `delay`, has passed its burst. A streaming DataFrame."""
    second = F.timestamp_seconds("created_utc")
    seconds = (
        activity.where(F.col("redditor").isNotNull() & F.col("created_utc").isNotNull())
        .select("redditor", second.alias("at"))
        .withWatermark("at", delay)
        .groupBy("redditor", "at")
        .agg(F.count("*").alias("n"))
        .select("redditor", "at", F.unix_seconds("at").alias("second"), "n")
    )
    return seconds.groupBy("redditor").transformWithStateInPandas(
        _Bursts(inactivity_days * DAY, burst_days * DAY), STARTS, "Append", "EventTime"
    )


def burst_stream(
    activity: DataFrame, root: str, checkpoint: str, inactivity_days: int, burst_days: int, delay: str
) -> StreamingQuery:
    """Append finished starts to `root`, each exactly once, until all that has landed was read.

    State of this kind lives in RocksDB; the session's own choice for other streams is left as it was.
    """
    spark = activity.sparkSession
    chosen = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (
            finished_starts(activity, inactivity_days, burst_days, delay)
            .writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, chosen)


def closed_bursts(spark: SparkSession, root: str, least: int = 2) -> DataFrame:
    """`(redditor, burst_count, max_burst_size)` of the bursts finished so far."""
    return (
        spark.read.schema(STARTS).parquet(root).where(F.col("events") >= least)
        .groupBy("redditor")
        .agg(F.count("*").alias("burst_count"), F.max("events").alias("max_burst_size"))
    )
