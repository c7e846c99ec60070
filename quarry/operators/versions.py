"""Versioned tables: immutable data files, manifests that list them, deletion vectors, and deltas between versions.

A commit writes data files and deletion vectors, then one manifest under the next number; putting the manifest in its place is the
commit. What no manifest names doesn't exist, so a run that dies leaves nothing behind that is ever read. The delta of two versions
comes from their manifests alone: files added, files removed, rows marked deleted. A consumer keeps the version it has processed in the
manifest of its own output, so output and progress can't part.

A manifest names with each data file the deletion vectors that touch it, so reading a file costs its own vectors and no others; a file
that goes takes its vectors with it. ``compact`` rewrites small and holed files; the delta passes over such a version, as it changes no row.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import written

#: Where a row lies: the columns a versioned read can add.
FILE, PLACE = "_file", "_place"
#: Hours for which ``vacuum`` spares what no manifest names: a commit under way may have written it.
SPARE_HOURS = 24.0


class Conflict(RuntimeError):
    """Another commit took the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._schema = schema

    # manifests -------------------------------------------------------------------------------------------------------------------
    def _manifest(self, version: int) -> str:
        return f"{self.path}/_manifests/{version:012d}.json"

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        folder = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()[:12]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int) -> dict:
        """A version's manifest: ``files``, all its data files with the commits whose deletion vectors touch each; ``moved``, whether it only
        rearranged rows; and the commit's notes."""
        if version == 0:
            return {"version": 0, "schema": self._schema, "files": {}, "moved": False, "notes": {}}
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _put(self, version: int, manifest: dict) -> None:
        """Write the manifest aside and move it into place; the move fails if the version exists."""
        aside = self._path(f"{self.path}/_aside/{uuid.uuid4().hex}.json")
        self._fs.mkdirs(self._path(f"{self.path}/_manifests"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        array = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = none
        try:
            self._context.rename(aside, self._path(self._manifest(version)), array)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} exists") from e
            raise

    # writing ---------------------------------------------------------------------------------------------------------------------
    def commit(
        self, added: DataFrame | None = None, deleted: DataFrame | None = None, removed: Sequence[str] | None = None, notes: dict | None = None, base: int | None = None, moved: bool = False
    ) -> int:
        """A new version: ``added`` rows in new files, rows at (FILE, PLACE) of ``deleted`` marked, whole files ``removed``. ``base`` is the
        version the change was made from; Conflict if it is no longer the last. Marks of a file that isn't there mean nothing."""
        base = self.version() if base is None else base
        before = self.manifest(base)
        commit = uuid.uuid4().hex
        files = {f: list(marks) for f, marks in before["files"].items()}
        schema = before["schema"]
        if added is not None:
            schema = schema or added._jdf.schema().toDDL()
            folder = f"{self.path}/data/{commit}"
            added.write.parquet(folder)
            files |= {f"{commit}/{s.getPath().getName()}": [] for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        if deleted is not None:
            marks = f"{self.path}/deleted/{commit}"
            deleted.select(FILE, PLACE).write.parquet(marks)
            for r in self.spark.read.schema(f"{FILE} string, {PLACE} long").parquet(marks).select(FILE).distinct().collect():  # names of files, not rows
                if r[FILE] in files:
                    files[r[FILE]].append(commit)
        for f in removed or ():
            files.pop(f, None)
        self._put(base + 1, {"version": base + 1, "schema": schema, "files": files, "moved": moved, "notes": {**(notes or {})}})
        return base + 1

    def compact(self, least_mb: float = 64.0, least_files: int = 32, most_vectors: int = 8) -> int:
        """Rewrite the files under ``least_mb``, once there are ``least_files`` of them, and those touched by more than ``most_vectors`` deletion
        vectors; returns the version. Rows, notes and deltas stay as they are."""
        base = self.version()
        m = self.manifest(base)
        size = {f: self._fs.getFileStatus(self._path(f"{self.path}/data/{f}")).getLen() / 1e6 for f in m["files"]}
        holed = [f for f, marks in m["files"].items() if len(marks) > most_vectors]
        small = [f for f in m["files"] if size[f] < least_mb]
        some = sorted({*holed, *(small if len(small) >= least_files else [])})
        if not some:
            return base
        rows = self._alive({f: m["files"][f] for f in some}, m["schema"]).drop(FILE, PLACE)
        parts = max(1, round(sum(size[f] for f in some) / max(least_mb, 1e-6) / 2))
        return self.commit(rows.coalesce(parts), removed=some, notes=m["notes"], base=base, moved=True)

    # reading ---------------------------------------------------------------------------------------------------------------------
    def _read(self, files: Sequence[str], schema: str) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema).withColumns({FILE: F.lit(None).cast("string"), PLACE: F.lit(None).cast("long")})
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in files])
        # the reader's own metadata column must not be asked for after a table column of that name shadows it
        meta = rows.metadataColumn("_metadata")
        name = F.regexp_extract(meta["file_path"], r"([^/]+/[^/]+)$", 1)
        return rows.withColumns({FILE: name, PLACE: meta["row_index"]})

    def _marks(self, commits: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(f"{FILE} string, {PLACE} long").parquet(*[f"{self.path}/deleted/{c}" for c in commits])

    def _alive(self, files: dict[str, list[str]], schema: str) -> DataFrame:
        """The rows of ``files`` without those their deletion vectors mark; only files that have vectors are joined."""
        whole = [f for f, marks in files.items() if not marks]
        holed = [f for f, marks in files.items() if marks]
        rows = self._read(sorted(whole), schema)
        if not holed:
            return rows
        marks = self._marks(sorted({c for f in holed for c in files[f]}))
        left = self._read(sorted(holed), schema).join(marks, [FILE, PLACE], "left_anti")
        return rows.unionByName(left) if whole else left

    def snapshot(self, version: int | None = None, places: bool = False) -> DataFrame:
        """All rows of a version; with ``places`` also where each lies."""
        m = self.manifest(self.version() if version is None else version)
        if m["schema"] is None:
            raise ValueError("the table has no schema before its first commit")
        rows = self._alive(m["files"], m["schema"])
        return rows if places else rows.drop(FILE, PLACE)

    def added(self, version: int) -> DataFrame:
        """The rows that a version's own new files hold, with their places."""
        b = self.manifest(version)
        return self._read(sorted(set(b["files"]) - set(self.manifest(version - 1)["files"])), b["schema"])

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows with ``_change`` insert or delete that turn version ``since`` into ``until``, and ``_version``, up to which they hold. Only
        files that one version has and the other hasn't, and files with new deletion vectors, are read. Rows that came and went in between
        appear in neither form, unless the table was compacted in between: the stretches before and after are then told one after the other."""
        until = self.version() if until is None else until
        stops = [v for v in range(since + 1, until + 1) if self.manifest(v)["moved"]]
        parts, at = [], since
        for v in [*stops, until + 1]:
            if v - 1 > at or not parts:
                parts.append(self._between(at, v - 1))
            at = v
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _between(self, since: int, until: int) -> DataFrame:
        a, b = self.manifest(since), self.manifest(until)
        schema, old, new = b["schema"], a["files"], b["files"]
        inserted = self._alive({f: new[f] for f in new if f not in old}, schema)
        was = self._alive({f: old[f] for f in old if f not in new}, schema)
        out = [(inserted, "insert"), (was, "delete")]
        hit = {f: [c for c in new[f] if c not in old[f]] for f in new if f in old and len(new[f]) > len(old[f])}
        if hit:
            fresh = self._marks(sorted({c for marks in hit.values() for c in marks}))
            out.append((self._alive({f: old[f] for f in hit}, schema).join(fresh, [FILE, PLACE], "left_semi"), "delete"))
        rows = [df.drop(FILE, PLACE).withColumns({"_change": F.lit(c), "_version": F.lit(until).cast("long")}) for df, c in out]
        for r in rows[1:]:
            rows[0] = rows[0].unionByName(r)
        return rows[0]

    def vacuum(self, keep: int, hours: float = SPARE_HOURS) -> int:
        """Drop manifests older than ``keep``, and data that no later manifest names and nobody has touched for ``hours``: a commit under way
        has written its data but no manifest yet. Returns the number of folders deleted."""
        last = self.version()
        used: set[str] = set()
        for v in range(max(1, keep), last + 1):
            for f, marks in self.manifest(v)["files"].items():
                used |= {f.split("/")[0], *marks}
        n = 0
        before = (time.time() - hours * 3600) * 1000
        for part in ("data", "deleted"):
            folder = self._path(f"{self.path}/{part}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if s.getPath().getName() not in used and self._touched(s) <= before:
                    n += bool(self._fs.delete(s.getPath(), True))
        for v in range(1, max(1, keep)):
            self._fs.delete(self._path(self._manifest(v)), False)
        return n

    def _touched(self, folder) -> int:
        """When anything in a folder last changed, in milliseconds."""
        walk = self._fs.listFiles(folder.getPath(), True)
        newest = folder.getModificationTime()
        while walk.hasNext():
            newest = max(newest, walk.next().getModificationTime())
        return newest


def _touched_by(rows: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose ``columns`` are among ``keys``; nulls equal nulls."""
    k = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)])
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(k, on, "left_semi")


def process_new(source: VersionedTable, output: VersionedTable, make: Callable[[DataFrame], DataFrame], key: Sequence[str], name: str = "processed") -> tuple[int, int]:
    """Run ``make`` over the rows of ``source`` added or changed since the version ``output`` has processed, and commit result and progress
    together. Returns the versions (from, to).

    ``key`` names the columns that identify a record in both tables (``make`` keeps them; it may make none or several rows of a record).
    The rows that ``output`` has of any touched key, changed or deleted alike, are marked deleted in the same commit. A key deleted and
    inserted again counts as changed. A null key is a key like any other. A run that fails before its commit changes nothing; one that races another gets Conflict.
    """
    base = output.version()
    done = int(output.manifest(base)["notes"].get(name, 0))
    last = source.version()
    if done == last:
        return done, last
    delta = written(source.changes(done, last), "delta")
    newest = delta.groupBy(*key).agg(F.max(F.struct("_version", (F.col("_change") == "insert").alias("_in"))).alias("_last"))
    still = newest.where("_last._in").select(*key, F.col("_last._version").alias("_version"))
    fresh = _touched_by(delta.where("_change = 'insert'"), still, [*key, "_version"]).drop("_change", "_version")
    stale = _touched_by(output.snapshot(base, places=True), newest, key).select(FILE, PLACE) if output.manifest(base)["files"] else None
    output.commit(make(fresh), stale, notes={name: last}, base=base)
    return done, last
