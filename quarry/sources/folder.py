"""Folder scan and content hashes. A listing is a Spark data source, so directories are listed by tasks and not by the driver."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, folder string, filename string, ext string, size long, mtime double, listed_at double"
# Names a scan passes over.
PASSED = ("__pycache__", "Thumbs.db", "desktop.ini")
CHUNK = 1 << 20


def _passed(name: str) -> bool:
    return name.startswith(".") or name in PASSED


class _Branch(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _FolderReader(DataSourceReader):
    """A partition for the files of the root and of each directory down to ``split`` levels, and one for each tree below."""

    def __init__(self, root: str, skip: tuple[str, ...], split: int, listed_at: float):
        self.root, self.skip, self.split, self.listed_at = root, skip, split, listed_at

    def _entries(self, path: str) -> list[os.DirEntry]:
        try:
            with os.scandir(path) as it:
                return sorted((e for e in it if not _passed(e.name) and os.path.abspath(e.path) not in self.skip), key=lambda e: e.name)
        except OSError:
            return []

    def partitions(self) -> list[InputPartition]:
        out, level = [], [self.root]
        for depth in range(self.split + 1):
            if depth == self.split:
                out += [_Branch(p, True) for p in level]
                break
            out += [_Branch(p, False) for p in level]
            level = [e.path for p in level for e in self._entries(p) if e.is_dir(follow_symlinks=False)]
        return out or [_Branch(self.root, True)]

    def read(self, partition: _Branch) -> Iterator[tuple]:
        stack = [partition.path]
        while stack:
            below = []
            for e in self._entries(stack.pop()):
                try:
                    if e.is_dir(follow_symlinks=False):
                        below.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        st = e.stat(follow_symlinks=False)
                        path = os.path.abspath(e.path)
                        yield (path, os.path.dirname(path), e.name, os.path.splitext(e.name)[1].lower(), st.st_size, st.st_mtime, self.listed_at)
                except OSError:
                    continue
            if partition.deep:
                stack += reversed(below)


class FolderSource(DataSource):
    """``spark.read.format("media_folder").option("listed_at", ...).load(root)``; symbolic links aren't followed, what can't be listed is left
    out, empty files are listed. Options: skip (paths parted by ``:``), split (levels listed in parallel, 1), listed_at."""

    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        skip = tuple(os.path.abspath(p) for p in o.get("skip", "").split(":") if p)
        return _FolderReader(os.path.abspath(o["path"]), skip, int(o.get("split", 1)), float(o.get("listed_at", 0)))


def scan(spark: SparkSession, root: str, listed_at: float, skip: tuple[str, ...] = (), split: int = 1) -> DataFrame:
    """The listing of a folder on storage every executor sees."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("media_folder").option("listed_at", listed_at).option("skip", ":".join(skip)).option("split", split).load(root)


def content_hashes(paths: DataFrame) -> DataFrame:
    """(path, content_hash) of files that can be read: SHA-256, read in chunks so that size doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for p in batch.column(0).to_pylist():
                try:
                    digest = hashlib.sha256()
                    with open(p, "rb") as f:
                        while piece := f.read(CHUNK):
                            digest.update(piece)
                except OSError:
                    continue
                keep.append(p)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string()), pa.array(out, pa.string())], names=["path", "content_hash"])

    return paths.select("path").mapInArrow(run, "path string, content_hash string")
