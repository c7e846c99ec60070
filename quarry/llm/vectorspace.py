"""What the vector operators share: usable rows, unit vectors, k-means on bounded samples, and files of the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual length of a vector by space, as the catalogue states it.
LENGTHS = {"clip": 96, "text": 64}


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as float32 rows, places of these rows in the column): those of the usual length, finite and not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, sizes)
    rows = np.flatnonzero(sizes == length)
    if not len(rows):
        return np.zeros((0, length), np.float32), rows
    if len(rows) == len(sizes) and offsets[0] == 0:
        x = values[: len(rows) * length].reshape(-1, length)
    else:
        x = values[offsets[rows][:, None] + np.arange(length)]
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), rows[good]


def sampled(vectors: DataFrame, space: str, bound: int, total: int, id_column: str = "id", vec: str = "vec") -> np.ndarray:
    """At most ``bound`` usable unit vectors of a space, chosen by the hash of their id, in order of the hash."""
    part = max(1, total // bound)
    rows = (
        vectors.where((F.col("space") == space) & (F.size(vec) == LENGTHS[space]))
        .withColumn("_h", F.xxhash64(id_column))
        .where(F.pmod("_h", F.lit(part)) == 0)
        .select("_h", vec)
        .toArrow()
    )
    x, at = matrix(rows.column(vec), LENGTHS[space]) if rows.num_rows else (np.zeros((0, LENGTHS[space]), np.float32), np.zeros(0, int))
    order = np.argsort(rows.column("_h").to_numpy()[at], kind="stable") if len(at) else at
    return x[order][: 2 * bound]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the most similar centroid, similarity) of each row."""
    block = max(64, (1 << 24) // max(1, len(centroids)))
    best = np.empty(len(x), np.int64)
    score = np.empty(len(x), np.float32)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ centroids.T
        best[a : a + block] = s.argmax(1)
        score[a : a + block] = s[np.arange(len(s)), best[a : a + block]]
    return best, score


def best_columns(scores: np.ndarray, take: int, width: int = 16) -> np.ndarray:
    """The columns of the ``take`` greatest values of each row, in no order. Strips of ``width`` columns are reduced to their greatest
    value first: the best values lie in the best strips, so only these are looked into."""
    rows, n = scores.shape
    if take >= n:
        return np.broadcast_to(np.arange(n), scores.shape)
    strips = n // width
    if strips <= 2 * take:
        return np.argpartition(scores, n - take, axis=1)[:, n - take :]
    body = scores[:, : strips * width].reshape(rows, width, strips)
    top = np.argpartition(body.max(1), strips - take, axis=1)[:, strips - take :]
    columns = (top[:, None, :] + strips * np.arange(width)[None, :, None]).reshape(rows, -1)
    columns = np.concatenate([columns, np.broadcast_to(np.arange(strips * width, n), (rows, n - strips * width))], 1)
    inner = np.argpartition(np.take_along_axis(scores, columns, 1), columns.shape[1] - take, axis=1)[:, columns.shape[1] - take :]
    return np.take_along_axis(columns, inner, 1)


def above(scores: np.ndarray, least: np.ndarray, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of all values of each row over its ``least``, in no order; rows with fewer end in column -1, value -inf. Only strips
    of ``width`` columns whose greatest value is over it are looked into."""
    rows, n = scores.shape
    strips = n // width
    top = scores[:, : strips * width].reshape(rows, width, strips).max(1) if strips else np.zeros((rows, 0), scores.dtype)
    r, s = np.divmod(np.flatnonzero(top > least[:, None]), max(1, strips))
    columns = s[:, None] + strips * np.arange(width)
    hit = scores[r[:, None], columns] > least[r, None]
    rest, last = np.nonzero(scores[:, strips * width :] > least[:, None])
    r, c = np.concatenate([np.repeat(r, hit.sum(1)), rest]), np.concatenate([columns[hit], last + strips * width])
    by = np.argsort(r, kind="stable")
    r, c = r[by], c[by]
    count = np.bincount(r, minlength=rows)
    place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
    found = np.full((rows, count.max(initial=0)), -1, np.int64)
    value = np.full(found.shape, -np.inf, scores.dtype)
    found[r, place], value[r, place] = c, scores[r, c]
    return found, value


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit length; seeds are rows at random, so that dense regions get their share."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at, _ = nearest(x, c)
        order = np.argsort(at, kind="stable")
        present, start = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = c.copy()
        c[present] = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c[present])
    return c


def codebook_kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 11) -> np.ndarray:
    """Plain k-means for a codebook."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)] if len(x) else np.zeros((k, x.shape[1]), np.float32)
    for _ in range(rounds if len(x) > k else 0):
        at = codes_of(x, c)
        count = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=col, minlength=k) for col in x.T], 1)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c).astype(np.float32)
    return c


def codes_of(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return (x @ codebook.T - (codebook**2).sum(1) / 2).argmax(1)


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder given as URI or path; hdfs, s3, gs and local ones alike."""
    return pyarrow.fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pyarrow.fs.LocalFileSystem(), uri)


def put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one Arrow file. Written under another name and moved, so a task that runs twice leaves one whole file."""
    import uuid

    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    table = pa.record_batch([pa.array([np.ascontiguousarray(a).tobytes()], pa.large_binary()) for a in arrays.values()], names=list(arrays))
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_batch(table)
    try:
        fs.move(own, path)
    except OSError:  # some stores don't move onto a file; the one there has the same content
        if fs.get_file_info(path).type != pyarrow.fs.FileType.File:
            raise
        fs.delete_file(own)


def get(uri: str) -> dict[str, memoryview]:
    """The arrays of a file that ``put`` wrote, as buffers; memory-mapped where the folder is local. Empty if there is none."""
    fs, path = filesystem(uri)
    try:
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
    except FileNotFoundError:
        return {}
    batch = pa.ipc.open_file(source).get_batch(0)
    return {name: batch.column(i)[0].as_buffer() for i, name in enumerate(batch.schema.names)}


def pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and last != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)
