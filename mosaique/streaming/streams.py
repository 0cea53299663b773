"""Structured Streaming forms: arrivals, suppression, roll-ups (throttling and expiry: `stateful`; revisions and cached work: `log_table`).

Late rows: what is behind the watermark is dropped by `suppress_repeats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mosaique.session import shared_path
from mosaique.streaming.log_table import LogTable


def arrivals(spark: SparkSession, path: str, schema: str, known: DataFrame | None = None, key: str = "path") -> DataFrame:
    """A stream of new rows under a folder; those that are known already are ignored."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream if known is None else stream.join(known.select(key).distinct(), key, "left_anti")


def suppress_repeats(errors: DataFrame, keys: list[str], gap_us: int, ts: str, delay: str) -> DataFrame:
    """One row per burst: first (shown) and suppressed; a burst ends when the gap passes without the signature.

    Sessions merge at exactly their gap, while an error exactly one gap later is shown: hence a microsecond less.
    """
    window = F.session_window(ts, f"{gap_us - 1} microseconds")
    bursts = errors.withWatermark(ts, delay).groupBy(*keys, window.alias("w")).agg(F.min(ts).alias("first"), (F.count("*") - 1).alias("suppressed"))
    return bursts.drop("w")


def job_rollup(stream: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Newest state per job, for update or complete mode."""
    newest = F.struct(ts, order)
    return stream.groupBy(key).agg(F.max_by("status", newest).alias("status"), F.max_by("percent", newest).alias("percent"), F.count("*").alias("n_events"))


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Everything that is available now, written to a table in the shared folder and read back.

    A complete result is what the last batch wrote. An update result is a log by `key`: each batch writes its own rows alone, and
    readers take the newest one of each key; a batch that is run again writes the same.
    """
    path = shared_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, "stream-state")).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    if mode == "update" and not key:
        raise ValueError("an update result needs the key that its rows replace each other by")
    if mode == "update":
        log = LogTable(spark, key, path)
        writer.foreachBatch(lambda batch, batch_id: log.write(batch, batch_id)).start().awaitTermination()
        found = log.table()
        return spark.createDataFrame([], stream.schema) if found is None else found
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        last.append(batch_id)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[-1]}") if last else spark.createDataFrame([], stream.schema)
