"""Session set-up and the few rules every operator follows about partitions, checkpoints and broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def get_session(cores: int | str = "*", app: str = "quarry") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is the cluster's ``spark.checkpoint.dir``; only where none is set
    (tests, one machine) a folder of our own is made and set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quarry-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, inside this application's own; ``clean`` removes them all."""
    return f"{shared_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. Call it when its results have been read: they are lazy."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder. It survives the loss of executors, is read by column, and computes a plan
    once that is used several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: Sequence[str], name: str, place: str = "_place") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of the columns ``by``. Ranges are sorted apart and written once; how many rows
    lie before each range (one row a range) is read from that table, so both sides of the join see the same ranges whatever the
    planner does with partitions."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(rows, name)
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft(part, 33)
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(place, F.col("_before") + inside).drop("_part", "_before", "_at")


def spread(scan: DataFrame) -> DataFrame:
    """Give a costly stage over a scan a partition a core when the scan has fewer (one small file); a larger scan stays as it is read.
    Planning a scan runs nothing. A plan with an exchange is left alone: asking for its partitions would run it."""
    if "Exchange" in scan._jdf.queryExecution().executedPlan().toString():
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that no machine needs it installed."""
    import shutil
    from pathlib import Path

    if getattr(spark.sparkContext, "_quarry_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarry-ship-")
    copy = Path(folder, "root", here.name)
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", f"{folder}/root"))
    spark.sparkContext._quarry_shipped = True
