"""Tables kept as a log of changes: upserts and tombstones per batch, compacted now and then.

A batch writes the rows that it changes, and nothing else; a removed key is a tombstone. Readers take the newest row of
each key from the last compaction and the changes after it. Compaction writes the table anew, without removed keys, and deletes
what it replaces: from then on they are in no file.

A second small write publishes each batch, so that readers see whole batches, a batch that is run again after a failure
writes the same, and a new process finds the table where the old one left it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaique.session import materialize, shared_path

#: Changes after which a table is compacted.
MAX_CHANGES = 32


class LogTable:
    """The newest row per key; the batch that was written last wins."""

    def __init__(self, spark: SparkSession, key: str | list[str], base: str | None = None):
        self.spark, self.key = spark, [key] if isinstance(key, str) else key
        self.base = base or shared_path(spark, "log")

    def _published(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """(batch of the last compaction, batches with changes after it), as far as batches before a number are concerned."""
        try:
            rows = self.spark.read.schema("batch long, whole boolean").option("recursiveFileLookup", "true").parquet(f"{self.base}/published")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None, []
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        marks = {(r["batch"], r["whole"]) for r in rows.collect()}  # two a batch at most, few after a compaction
        whole = max((b for b, w in marks if w), default=None)
        return whole, sorted(b for b, w in marks if not w and (whole is None or b > whole))

    def _publish(self, batch: int, whole: bool) -> None:
        mark = self.spark.createDataFrame([(batch, whole)], "batch long, whole boolean").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.base}/published/{'whole' if whole else 'change'}-{batch}")

    def _read(self, published: tuple[int | None, list[int]]) -> DataFrame | None:
        whole, changes = published
        paths = ([f"{self.base}/whole/{whole}"] if whole is not None else []) + [f"{self.base}/changes/{b}" for b in changes]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        columns = [c for c in rows.columns if not c.startswith("_log_")]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns, "_log_gone"), "_log_batch").alias("r"))
        return newest.filter("not r._log_gone").select(*[F.col(f"r.{c}").alias(c) for c in columns])

    def table(self) -> DataFrame | None:
        """The newest row of each key; nothing before the first batch."""
        return self._read(self._published())

    def before(self, batch: int) -> DataFrame | None:
        """The table without a batch and later ones, for a batch that is run again."""
        return self._read(self._published(batch))

    def write(self, rows: DataFrame, batch: int, gone: bool = False) -> None:
        """Upserts, or tombstones: one row a key."""
        marked = rows.withColumns({"_log_batch": F.lit(batch).cast("long"), "_log_gone": F.lit(gone)})
        marked.write.mode("overwrite").parquet(f"{self.base}/changes/{batch}")
        self._publish(batch, False)
        if len(self._published()[1]) >= MAX_CHANGES:
            self.compact()

    def compact(self) -> None:
        """Write the table anew and delete what that replaces; nobody may be reading the old files."""
        whole, changes = self._published()
        if not changes:
            return
        found = self._read((whole, changes)).withColumns({"_log_batch": F.lit(changes[-1]).cast("long"), "_log_gone": F.lit(False)})
        found.write.mode("overwrite").parquet(f"{self.base}/whole/{changes[-1]}")
        self._publish(changes[-1], True)
        old = ([f"whole/{whole}", f"published/whole-{whole}"] if whole is not None else []) + [f"{kind}{b}" for b in changes for kind in ("changes/", "published/change-")]
        jvm = self.spark.sparkContext._jvm
        for name in old:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def follow(self, stream: DataFrame, merge: Callable[[DataFrame, int], None]) -> None:
        """All that is available now; the stream's own state lies beside the table, so that another process goes on from it."""
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start().awaitTermination()


class LatestRevisions:
    """The latest revision per key, fed by batches of a stream; unchanged revisions are not written again, orphans are removed."""

    def __init__(self, spark: SparkSession, key: str, revision: str, base: str | None = None):
        self.log, self.key, self.revision = LogTable(spark, key, base), key, revision

    def table(self) -> DataFrame | None:
        return self.log.table()

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in batch.columns if c != self.key]
        newest = batch.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.col(self.revision)).alias("r")).select(self.key, "r.*")
        # A batch takes every second number; what lies between is for removals.
        current = self.log.before(2 * batch_id)
        if current is not None:
            old = current.select(self.key, F.col(self.revision).alias("_old"))
            newest = newest.join(old.hint("merge"), self.key, "left").filter(F.col("_old").isNull() | (F.col(self.revision) > F.col("_old"))).drop("_old")
        changed = materialize(newest, "changed")
        if not changed.isEmpty():
            self.log.write(changed, 2 * batch_id)

    def remove_orphans(self, alive: DataFrame) -> None:
        """Remove the keys that no longer exist, and compact: their rows are in no file afterwards."""
        current = self.log.table()
        if current is None:
            return
        whole, changes = self.log._published()
        gone = materialize(current.join(alive.select(self.key).distinct().hint("merge"), self.key, "left_anti"), "gone")
        if not gone.isEmpty():
            last = changes[-1] if changes else whole
            self.log.write(gone, last + 1, gone=True)
        self.log.compact()

    def follow(self, stream: DataFrame) -> None:
        self.log.follow(stream, self.merge)


class FingerprintCache:
    """Fingerprints by path, computed only for files whose path, size or time of change is new; changed files replace theirs.

    `computed` has the number of rows that each batch had to compute. A path that a batch names several times counts as its newest.
    """

    def __init__(self, spark: SparkSession, compute: Callable[[DataFrame], DataFrame], base: str | None = None):
        self.log, self.compute = LogTable(spark, "path", base), compute
        self.computed: dict[int, int] = {}

    def table(self) -> DataFrame | None:
        return self.log.table()

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """`batch` has path, size_bytes, mtime and what `compute` needs; `compute` keeps these three columns."""
        rows = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), F.struct("mtime", "size_bytes")).alias("r")).select("r.*")
        known = self.log.before(batch_id)
        if known is not None:
            same = known.select("path", "size_bytes", "mtime")
            rows = rows.join(same.hint("merge"), ["path", "size_bytes", "mtime"], "left_anti").select(*batch.columns)
        rows = materialize(rows, "new")
        self.computed[batch_id] = rows.count()
        if self.computed[batch_id]:
            self.log.write(self.compute(rows), batch_id)

    def follow(self, stream: DataFrame) -> None:
        self.log.follow(stream, self.merge)
