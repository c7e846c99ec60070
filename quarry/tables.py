"""Readers of the catalogue tables. One place decides how a table is found, so that a lake path or a catalog can replace the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CATALOGUE = ("files", "assets", "vectors", "listing", "jobs", "judgments", "meta", "eval_queries", "documents")


_SCHEMAS: dict[tuple, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of ``folder``; column pruning and filters reach the scan. The schema is read once for a table as it is: as soon as its
    file or folder has another time or size it is read anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    own = (spark.sparkContext.applicationId, path.toString(), status.getModificationTime(), status.getLen())
    if own not in _SCHEMAS:
        _SCHEMAS[own] = spark.read.parquet(path.toString()).schema
    return spark.read.schema(_SCHEMAS[own]).parquet(path.toString())
