"""Session helpers: a local session for tests, and tables kept in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "mosaique", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench. A cluster brings its own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("MOSAIQUE_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    reach_workers(spark)
    return spark


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.

    Clusters without that folder get the package as they get any (--py-files, an image); for them this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Without that setting a session on one machine (a test) gets a temporary folder; a cluster gets an error.
    """
    found = spark.conf.get(_OWN_DIR, None) or spark.sparkContext.getConf().get(_OWN_DIR)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{_OWN_DIR} must name a folder that driver and executors share ({master} is no single machine)")
        found = "file://" + tempfile.mkdtemp(prefix="mosaique-")
        spark.conf.set(_OWN_DIR, found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used yet, in a folder of this application."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/mosaique/{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; none of its results may be in use any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
