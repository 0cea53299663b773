"""Keyed state: throttling with the time last shown per key; and expiry of idle keys by session windows.

The state of throttling is kept by Spark's state store (RocksDB) and saved with the stream's checkpoint: a batch writes what it changes, and a
new process goes on where the old one stopped. A task holds the rows of one key in one batch (three numbers a row); the
source's limit on a batch (maxFilesPerTrigger, maxBytesPerTrigger) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Keys that nobody has shown for so long are forgotten, unless the gap is longer.
FORGET_MS = 7 * 24 * 3_600_000


def _with_rocks(spark: SparkSession) -> None:
    """Keyed state needs this store; a session that names it already stays as it is."""
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)


class _Throttle(StatefulProcessor):
    """Lets the first event of a key pass, each one at least a gap after the last that passed, and final ones."""

    def __init__(self, gap_us: int, key: str, ttl_ms: int):
        self.gap_us, self.key, self.ttl_ms = gap_us, key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["event_us", "event_no"], na_position="first")
        held = self.last.get()
        known, last = held is not None, held[0] if held is not None else None
        shown = []
        for us, number, final in zip(events["event_us"], events["event_no"], events["event_final"], strict=True):
            timed = not pd.isna(us)
            if final or not known or timed and (last is None or us - last >= self.gap_us):
                known, last = True, int(us) if timed else last
                shown.append(number)
        if last is not None:
            self.last.update((int(last),))
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(shown), dtype=events[self.key].dtype), "event_no": pd.Series(shown, dtype="int64")})

    def close(self) -> None:
        pass


def throttle(spark: SparkSession, stream: DataFrame, key: str, ts: str, order: str, final: Column, gap_us: int, base: str, ttl_ms: int | None = None) -> DataFrame:
    """key and order of the events let through, of all that is available now; `base` holds them, and the stream's state.

    Another call with the same `base` goes on from there. Times are forgotten `ttl_ms` after they were shown (by the clock, FORGET_MS
    and the gap at least), so that keys that never come back need no room. Events without a time pass only as a key's first or as final.
    """
    _with_rocks(spark)
    rows = stream.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("event_us"), F.col(order).cast("long").alias("event_no"), F.coalesce(final, F.lit(False)).alias("event_final"))
    kind = stream.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("event_no", T.LongType())])
    keep = max(ttl_ms or FORGET_MS, gap_us // 1000 + 1)
    passed = rows.groupBy(key).transformWithStateInPandas(_Throttle(gap_us, key, keep), schema, "append", "ProcessingTime")
    writer = passed.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    # State that the clock may forget asks for batches without data for ever; here only data start one.
    empty = spark.conf.get(_EMPTY)
    spark.conf.set(_EMPTY, "false")
    try:
        query = writer.start(f"{base}/shown")
        query.awaitTermination()
    finally:
        spark.conf.set(_EMPTY, empty)
    return spark.read.schema(schema).parquet(f"{base}/shown").select(key, F.col("event_no").alias(order))


def expire(stream: DataFrame, key: str, ts: str, idle_us: int, delay: str) -> DataFrame:
    """key, first, last_seen, n of each stretch of activity, when it has been idle for so long by the watermark.

    Events at most `idle_us` apart are one stretch (sessions merge at exactly their gap). What could only be a stretch that ended behind
    the watermark is dropped, and so are rows without a time. State, merging and eviction are Spark's own: no key is a call to Python.
    """
    rows = stream.withWatermark(ts, delay).filter(F.col(ts).isNotNull())
    window = F.session_window(ts, f"{idle_us} microseconds")
    out = rows.groupBy(key, window.alias("_stretch")).agg(F.min(ts).alias("first"), F.max(ts).alias("last_seen"), F.count("*").alias("n"))
    return out.select(key, *[F.col(c).cast("timestamp").alias(c) for c in ("first", "last_seen")], "n")
