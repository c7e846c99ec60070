"""Problem 7: only what is new, changed or unfinished since the last successful run.

A ledger keeps one row a known path in a versioned table: its size, its time, whether it is settled, and whether the last scan saw it with
work to do. What the catalogue says now and
what the folder scan sees now are merged into it as commits: a path that differs has its old row marked in a deletion vector and a new row
added; paths in order stay in their files, unwritten. The delta of the ledger's manifests since the version that the output has processed
is the work of the next run, and goes to the output in one commit with that version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch, written

from .catalogue import ATTEMPTS, SAME_TIME, newest_sightings, unfinished
from .versions import FILE, PLACE, VersionedTable, process_new

STATE = "path string, size long, mtime double, settled boolean, seen boolean"
WORK = "path string, size long, mtime double"


def catalogue_state(files: DataFrame, assets: DataFrame, signature: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(path, size, mtime, settled) of every stored path: settled unless it is ok without hash or its asset is unfinished."""
    open_ = assets.where(unfinished(signature, attempts)).select("hash").distinct().withColumn("_open", F.lit(True))
    rows = files.where(F.col("path").isNotNull()).join(open_, "hash", "left")
    interrupted = (F.col("file_status") == "ok") & F.col("hash").isNull()
    return rows.select("path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), (~(F.coalesce(interrupted, F.lit(False)) | F.coalesce("_open", F.lit(False)))).alias("settled"))


class Ledger:
    """The state of all paths under ``path`` and, beside it, the work handed out. Kept from run to run, it writes differences only."""

    def __init__(self, spark: SparkSession, path: str):
        self.state = VersionedTable(spark, f"{path}/state", STATE)
        self.work = VersionedTable(spark, f"{path}/work", WORK)

    def _placed(self, base: int) -> DataFrame:
        old = self.state.snapshot(base, places=True)
        return old.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("settled").alias("_settled"), F.col("seen").alias("_seen"), FILE, PLACE)

    def settle(self, files: DataFrame, assets: DataFrame, signature: str, attempts: int = ATTEMPTS) -> int:
        """Commit what the catalogue says, as no scan has seen it yet; returns the version. The first state counts as processed: by itself it
        gives no work. A path stored twice counts as often."""
        now = catalogue_state(files, assets, signature, attempts).withColumn("seen", F.lit(False))
        base = self.state.version()
        if not base:
            version = self.state.commit(now, base=0)
            self.work.commit(notes={"processed": version}, base=self.work.version())
            return version
        rows = now.join(self._placed(base), "path", "full_outer")
        same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("settled").eqNullSafe(F.col("_settled")) & ~F.coalesce("_seen", F.lit(True))
        moved = written(rows.where(~same), "settled")
        added = moved.where("settled is not null").select("path", "size", "mtime", "settled", "seen")
        return self.state.commit(added, moved.where(F.col(FILE).isNotNull()).select(FILE, PLACE), base=base)

    def see(self, listing: DataFrame) -> int:
        """Commit the paths of ``listing`` that need work; returns the version."""
        base = self.state.version()
        new = newest_sightings(listing).select("path", "size", "mtime")
        rows = new.join(self._placed(base), "path", "left")
        differs = ~F.col("size").eqNullSafe(F.col("_size")) | F.coalesce(F.abs(F.col("mtime") - F.col("_mtime")) >= SAME_TIME, ~F.col("mtime").eqNullSafe(F.col("_mtime")))
        open_ = written(rows.where(F.col(FILE).isNull() | differs | ~F.col("_settled")).select("path", "size", "mtime", F.lit(False).alias("settled"), F.lit(True).alias("seen"), FILE, PLACE), "open")
        return self.state.commit(open_.drop(FILE, PLACE), open_.where(F.col(FILE).isNotNull()).select(FILE, PLACE), base=base)

    def take(self) -> DataFrame:
        """(path, size, mtime) of all open work. What the ledger's versions since the last call saw open is put in, what they settled
        or dropped taken out, and the version processed saved, in one commit."""
        process_new(self.state, self.work, lambda rows: rows.where("seen").select("path", "size", "mtime"), ["path"])
        return self.work.snapshot()


def work_since(files: DataFrame, assets: DataFrame, listing: DataFrame, signature: str, attempts: int = ATTEMPTS, path: str | None = None) -> DataFrame:
    """(path, size, mtime) of the paths of ``listing`` that the next run must handle, by a ledger kept at ``path`` or, without one, begun anew.

    Each path once, with its newest sighting. Rows without a path are left out. A size or time that is null on one side only differs. A
    hash that no asset has isn't unfinished by itself. Paths that are no longer seen aren't work.
    """
    spark = files.sparkSession
    ledger = Ledger(spark, path or scratch(spark, "ledger"))
    ledger.settle(files, assets, signature, attempts)
    ledger.see(listing)
    return ledger.take()
