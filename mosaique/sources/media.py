"""Media files as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaique.operators.batch import SUPPORTED


def scan_media(spark: SparkSession, root: str, recursive: bool = True, suffixes: Sequence[str] = SUPPORTED) -> DataFrame:
    """path, size_bytes and mtime of supported files under a folder (or of one file), by lower-cased path.

    Only metadata is read; a missing folder is empty, and any other failure (permissions, a broken store) is an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        files = reader.load(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, size_bytes long, mtime timestamp")
    kept = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)
    return files.filter(kept).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")).orderBy(F.lower("path"))
