"""A run of the indexer over versioned tables: scan, difference, queue, processing in bounded batches, job row.

Every step is a commit of its own, so a run that dies is taken up where it stopped: what was processing waits again, what was committed
stays. Within a run nothing is collected but counters and the handful of rows of a job.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalar import kind_for_ext
from quarry.operators import catalogue as c
from quarry.operators.reports import first_path
from quarry.operators.versions import FILE, PLACE, VersionedTable
from quarry.session import numbered, written

META = "struct<width:int,height:int,format:string,duration:double,fps:double,frames_sampled:int,candidates_checked:int,has_speech:boolean,pages:int,title:string,has_text:boolean,ocr_pages:int>"
#: The catalogue's tables.
SCHEMAS = {
    "files": "id long, path string, folder string, filename string, ext string, kind string, size long, mtime double, hash string, file_status string, file_error string, present boolean, first_seen double, last_seen double",
    "assets": f"hash string, kind string, size long, status string, error string, attempts int, model_sig string, caption string, tags array<string>, body string, meta {META}, warnings array<string>, thumb string, processed_at double, process_ms long",
    "vectors": "id long, hash string, space string, source string, ref double, label string, thumb string, vec array<float>",
    "jobs": "id long, started_at double, finished_at double, state string, phase string, root string, total int, processed int, skipped int, failed int, duplicates int, unsupported int, current string, message string",
}
#: Outcomes of assets, as ``catalogue.finished`` takes them.
RESULTS = f"hash string, caption string, tags array<string>, body string, meta {META}, warnings array<string>, thumb string, processed_at double, process_ms long, error string, lasting boolean"

#: Makes (results, vectors) of assets (hash, kind, path); lazily.
Process = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Busy(RuntimeError):
    """A run is going on."""


@dataclass
class Ingest:
    """``scan(root)`` gives the listing, ``hashes(paths)`` (path, content_hash) of what can be read, ``process`` the outcomes. ``ready`` is
    called before any asset is touched: if it raises, the run ends as an error and no asset has failed. ``batch`` assets are in work at once."""

    spark: SparkSession
    path: str
    signature: str
    scan: Callable[[str], DataFrame]
    hashes: Callable[[DataFrame], DataFrame]
    process: Process
    ready: Callable[[], None] = lambda: None
    batch: int = 1000
    clock: Callable[[], float] = time.time
    stop: threading.Event = field(default_factory=threading.Event)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}", SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        return self.table(name).snapshot()

    def _merge(self, name: str, rows: DataFrame, key: str = "hash") -> None:
        """Replace the rows of these keys."""
        table = self.table(name)
        base = table.version()
        rows = written(rows, name)
        old = table.snapshot(base, places=True).join(rows.select(key).distinct(), key, "left_semi").select(FILE, PLACE) if base else None
        table.commit(rows, old, base=base)

    def _job(self, number: int, **values) -> None:
        old = self.read("jobs").where(F.col("id") == number).first()
        row = {**(old.asDict() if old else {x.split()[0]: None for x in _columns(SCHEMAS["jobs"])}), "id": number, **values}
        self._merge("jobs", self.spark.createDataFrame([tuple(row.values())], SCHEMAS["jobs"]), "id")

    def start(self, root: str) -> threading.Thread:
        """Run in the background; Busy if a run is going on."""
        if self._lock.locked():
            raise Busy("a run is going on")
        thread = threading.Thread(target=self.run, args=(root,), daemon=True)
        thread.start()
        return thread

    def run(self, root: str) -> dict:
        """One run; returns its counters. Busy if another is going on in this process; another process's commits lead to Conflict."""
        if not self._lock.acquire(blocking=False):
            raise Busy("a run is going on")
        number = None
        try:
            self.stop.clear()
            top = self.read("jobs").agg(F.max("id")).first()[0]
            number = (top or 0) + 1
            self._job(number, started_at=self.clock(), state="running", phase="scanning", root=root, total=0, processed=0, skipped=0, failed=0, duplicates=0, unsupported=0)
            counters = self._scan(root)
            counters |= {"processed": 0, "failed": 0}
            queue = written(c.pending_queue(self.read("assets"), self.read("files"), self.signature), "queue")
            total = queue.count()
            self._job(number, phase="processing", total=total, skipped=counters["unchanged"], duplicates=counters["duplicates"], unsupported=counters["unsupported"])
            if total:
                try:
                    self.ready()
                except Exception as e:
                    self._job(number, state="error", finished_at=self.clock(), message=f"models unavailable: {e}"[:2000])
                    raise
                self._work(number, queue, total, counters)
            state = "stopped" if self.stop.is_set() else "finished"
            self._job(number, state=state, phase="done", finished_at=self.clock(), processed=counters["processed"], failed=counters["failed"])
            return counters
        except Exception as e:
            last = self.read("jobs").where(F.col("id") == number).first() if number else None
            if last and last["state"] == "running":
                self._job(number, state="error", finished_at=self.clock(), message=str(e)[:2000])
            raise
        finally:
            self._lock.release()

    def _scan(self, root: str) -> dict:
        assets, files = self.read("assets"), self.read("files")
        stuck = assets.where("status = 'processing'")
        if stuck.limit(1).count():
            self._merge("assets", c.recovered(stuck))
        diff = written(c.scan_diff(self.scan(root), files, root), "diff")
        counters = c.scan_counters(diff).first().asDict()
        readable = kind_for_ext(F.col("ext")).isNotNull() & (F.col("size") > 0) & (F.col("size") <= c.MAX_FILE_MB * 1024 * 1024)
        hashed = written(self.hashes(diff.where(F.col("change").isin("new", "changed") & readable).select("path")), "hashes")
        now = self.clock()
        after = written(c.next_files(diff, hashed, now), "files")
        touched = after.join(diff.where("change <> 'gone'").select("path"), "path", "left_semi")
        self._merge("files", touched.select(*[x.split()[0] for x in _columns(SCHEMAS["files"])]), "path")
        fresh = written(c.new_assets(after, self.read("assets")), "new-assets")
        n = fresh.count()
        counters["duplicates"] = hashed.count() - n
        if n:
            empty = self.spark.createDataFrame([], SCHEMAS["assets"])
            self._merge("assets", empty.unionByName(fresh.withColumns({"status": F.lit("pending"), "attempts": F.lit(0)}), allowMissingColumns=True))
        return counters

    def _work(self, number: int, queue: DataFrame, total: int, counters: dict) -> None:
        """Assets in working order, ``batch`` at a time: each batch is started, processed and committed before the next. Where the rows of
        the queue and their old vectors lie is found in one pass over each table; a batch then reads and writes only its own."""
        assets, vectors = self.table("assets"), self.table("vectors")
        names = [x.split()[0] for x in _columns(SCHEMAS["assets"])]
        placed = assets.snapshot(places=True).join(queue.select("hash", F.col("place").alias("_order")), "hash")
        paths = first_path(self.read("files").where("present"))
        placed = numbered(placed.join(paths, "hash"), ["_order", "size", "hash"], "queue", "n")
        placed = written(placed.select("n", "path", FILE, PLACE, *names), "numbered")
        had = vectors.snapshot(places=True).select("hash", FILE, PLACE).join(placed.select("hash", "n"), "hash") if vectors.version() else self.spark.createDataFrame([], f"hash string, {FILE} string, {PLACE} long, n long")
        had = written(had.repartitionByRange("n").sortWithinPartitions("n"), "had-vectors")
        free = (self.read("vectors").agg(F.max("id")).first()[0] or 0) + 1
        for begin in range(0, total, self.batch):
            if self.stop.is_set():
                return
            inside = (F.col("n") >= begin) & (F.col("n") < begin + self.batch)
            part = placed.where(inside)
            at = assets.commit(c.started(part.select(*names), part), part.select(FILE, PLACE), base=assets.version())
            results, made = self.process(part.select("hash", "kind", "path"))
            results = written(results.select(*[x.split()[0] for x in _columns(RESULTS)]), "results")
            good = results.where("error is null").select("hash")
            made = numbered(made.join(good, "hash", "left_semi"), ["hash"], "vectors", "_n")
            made = written(made.withColumn("id", F.lit(free) + F.col("_n")).drop("_n"), "vectors")
            # vectors first: a run that dies between the two commits makes them again, and their places are found anew
            empty = self.spark.createDataFrame([], SCHEMAS["vectors"])
            vectors.commit(empty.unionByName(made, allowMissingColumns=True), had.where(inside).join(good, "hash", "left_semi").select(FILE, PLACE), base=vectors.version())
            free += made.count()
            now = written(assets.added(at), "started")
            assets.commit(c.finished(now.drop(FILE, PLACE), results, self.signature), now.select(FILE, PLACE), base=at)
            counters["processed"] += good.count()
            counters["failed"] += results.where("error is not null").count()
            self._job(number, processed=counters["processed"], failed=counters["failed"], current=f"{min(begin + self.batch, total)} of {total}")
        for name in ("assets", "vectors", "jobs"):
            self.table(name).compact()


def _columns(ddl: str) -> list[str]:
    """The columns of a schema text; commas inside types don't part columns."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def remaining_seconds(elapsed: float, done: int, total: int) -> float | None:
    """What a run still takes at its pace; None before anything is done."""
    return elapsed / done * (total - done) if done else None
