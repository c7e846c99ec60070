"""Problem 4: the most similar vectors of every vector.

An inverted file: coarse centroids are fitted on a bounded sample, and every usable row is put on the list of its centroid with the
product-quantised residual to it. Lists are kept in files of the shared folder, similar lists in one file. A task takes the rows of a file
as queries, block by block: the lists its rows are nearest to are opened, their rows scored by asymmetric distance, and the best
candidates ranked by the exact cosine.

The lists nearest to the rows themselves come first. By the angles of rows to their centroid, kept for shells of each list, the other lists
of a block are asked only for queries to which they can still bring a neighbour; so rows with near neighbours don't pay for the others.

The asymmetric distance of a query is a sum over one table per sub-quantiser. For a few queries the tables are made and added up; for a
block, the same sums come cheaper as a product of the queries with the rows decoded from their codes.

A file much fuller than usual is split by the hash of the id. Copies of one vector share a query, and a file offers only their first K + 1
ids, so a hot group of copies costs no more than a single row.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch, spread

from .vectorspace import LENGTHS, above, best_columns, codebook_kmeans, codes_of, get, matrix, nearest, pieces, put, sampled, spherical_kmeans

K = 10
#: Rows per space the index is fitted on, at most (the hash of the id chooses, up to twice as many when the total is no multiple).
SAMPLE = 65_536
#: Rows of a list, on average, and least rows of the sample for a list; lists in a file; sub-quantisers of 256 codes each.
LIST_ROWS, LIST_SAMPLE, PACK, SUBSPACES = 32, 4, 32, 32
#: Rows asked together; and where a list's rows are hardly alike (mean cosine to their centroid under SPARSE).
BLOCK, SPARSE, SPARSE_BLOCK = 512, 0.6, 64
#: Lists nearest to a row that are always opened for it; lists a row votes for; rows a block's lists hold in all, filled up by votes;
#: candidates ranked exactly; queries up to which tables are added up.
SURE, VOTES, ROWS, RERANK, FEW = 8, 64, 24_576, 64, 8
#: Entries of a space from which the rows of a block's lists grow.
GROWS = 131_072
#: A list's rows lie in shells by their cosine to its centroid: from the first value, from the second, ...
SHELLS = np.array([0.9, 0.75, SPARSE], np.float32)
#: What rounding may take from an angle and from a cosine.
ANGLE_ERROR, COSINE_ERROR = 1e-3, 1e-5


@dataclass
class Space:
    name: str
    folder: str
    centroids: np.ndarray
    books: np.ndarray  # (sub-quantiser, code, dimension)
    rows: np.ndarray  # entries of each list, copies in one file as one: as the sample has it, after build as counted
    cohesion: np.ndarray  # mean cosine of a list's rows to the centroid
    blocks: list[int]  # of each file
    near: np.ndarray | None = None  # (list, shell): the least angle of a row to the centroid, infinite without rows; build sets both
    far: np.ndarray | None = None  # and the greatest

    def names(self, file: int) -> list[str]:
        return [f"{self.folder}/{self.name}/{file}-{b}" for b in range(self.blocks[file])]

    @property
    def room(self) -> int:
        """Entries a block's lists hold in all: ROWS, and beyond GROWS entries more by the root of their number."""
        return round(ROWS * max(1.0, math.sqrt(self.rows.sum() / GROWS)))

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the residual's direction, the residual's length) of each row."""
        rest, length = _directions(x - self.centroids[at])
        rest = rest.reshape(len(x), SUBSPACES, -1)
        return np.stack([codes_of(rest[:, m], self.books[m]) for m in range(SUBSPACES)], 1).astype(np.uint8), length

    def decode(self, codes: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        flat = codes + np.arange(0, SUBSPACES * self.books.shape[1], self.books.shape[1], dtype=np.int64)
        out = np.take(self.books.reshape(-1, self.books.shape[2]), flat, axis=0).reshape(len(codes), -1)
        out *= length[:, None]
        out += self.centroids[at]
        return out

    def distances(self, q: np.ndarray, codes: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The asymmetric products of queries with coded rows."""
        if len(q) > FEW:
            return q @ self.decode(codes, length, at).T
        sub = q.reshape(len(q), SUBSPACES, -1)
        rest = np.zeros((len(q), len(at)), np.float32)
        for m in range(SUBSPACES):
            rest += np.take(sub[:, m] @ self.books[m].T, codes[:, m], axis=1)
        return np.take(q @ self.centroids.T, at, axis=1) + rest * length


def _directions(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals at length one, and their lengths: tight and loose lists then share the codebooks on equal terms."""
    length = np.linalg.norm(rest, axis=1).astype(np.float32)
    return rest / np.maximum(length, 1e-6)[:, None], length


def fit(vectors: DataFrame, space: str, total: int, folder: str) -> Space:
    """Centroids and codebooks of one space, on the driver, from the bounded sample; and from its spread, which files need blocks."""
    x = sampled(vectors, space, SAMPLE, total)
    every = len(x)
    # copies count once: a hot group gets one list, not one for each of its rows drawn as a seed
    first, copies = np.unique(np.round(x, 5), axis=0, return_index=True, return_counts=True)[1:] if every else (np.zeros(0, int), np.zeros(0, int))
    order = np.argsort(first)
    x, copies = x[first[order]], copies[order]
    lists = max(1, min(round(total * len(x) / max(1, every) / LIST_ROWS), len(x) // LIST_SAMPLE))
    c = spherical_kmeans(x, lists, 3) if len(x) else np.zeros((1, LENGTHS[space]), np.float32)
    if len(x):  # no empty lists, which would fill a query's nearest ones
        c = c[np.bincount(nearest(x, c)[0], minlength=len(c)) > 0]
    files = -(-len(c) // PACK)
    if files > 1:  # similar lists next to each other
        c = c[np.argsort(nearest(c, spherical_kmeans(c, files, 3))[0], kind="stable")]
    at, score = nearest(x, c) if len(x) else (np.zeros(0, int), np.zeros(0, np.float32))
    rest = _directions((x - c[at])[:16_384])[0].reshape(-1, SUBSPACES, LENGTHS[space] // SUBSPACES)
    books = np.stack([codebook_kmeans(rest[:, m], 256, 6) for m in range(SUBSPACES)]).astype(np.float32)
    count = np.bincount(at, minlength=len(c))
    cohesion = np.bincount(at, weights=score, minlength=len(c)) / np.maximum(count, 1)
    scale = total / max(1, every)
    whole = np.bincount(at, weights=copies, minlength=len(c)) * scale
    usual = max(256.0, total / files)
    blocks = [max(1, math.ceil(whole[f * PACK : (f + 1) * PACK].sum() / (4 * usual))) for f in range(files)]
    return Space(space, folder, c, books, count * scale, cohesion, blocks)


def _assign(vectors: DataFrame, spaces: dict[str, Space], id_column: str, vec: str) -> DataFrame:
    """(space, list, id, vec) of every usable row."""
    sent = vectors.sparkSession.sparkContext.broadcast({s: i.centroids for s, i in spaces.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for space, centroids in sent.value.items():
                own = np.array([i for i, n in enumerate(names) if n == space], np.int64)
                if not len(own):
                    continue
                x, at = matrix(batch.column(2).take(pa.array(own)), LENGTHS[space])
                if not len(at):
                    continue
                home, _ = nearest(x, centroids)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([space] * len(x)), pa.array(home.astype(np.int32)), batch.column(0).take(pa.array(own[at])), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["space", "list", "id", "vec"]
                )

    rows = vectors.where(F.col("space").isin(list(spaces)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), "space", vec)
    return spread(rows).mapInArrow(run, "space string, list int, id long, vec array<float>")


def build(vectors: DataFrame, id_column: str = "id", vec: str = "vec") -> dict[str, Space]:
    """Index every usable row of ``vectors``; the lists are written to the shared folder."""
    spark = vectors.sparkSession
    folder = scratch(spark, "ivf")
    totals = {r["space"]: r["n"] for r in vectors.where(F.col("space").isin(list(LENGTHS))).groupBy("space").agg(F.count("*").alias("n")).collect()}
    spaces = {s: fit(vectors, s, n, folder) for s, n in sorted(totals.items())}
    if not spaces:
        return {}
    rows = _assign(vectors, spaces, id_column, vec).withColumn("file", F.floor(F.col("list") / PACK).cast("int"))
    blocks = F.create_map(*[y for s, index in spaces.items() for y in (F.lit(s), F.array(*[F.lit(n) for n in index.blocks]))])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks[F.col("space")][F.col("file")]))
    sent = spark.sparkContext.broadcast(spaces)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "key"):
            space, file, block = json.loads(part.column("key")[0].as_py())
            index = sent.value[space]
            x = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            ids, at = part.column("id").to_numpy(), part.column("list").to_numpy()
            order = np.lexsort((ids, at))
            ids, x, at = ids[order], np.ascontiguousarray(x[order]), at[order]
            # copies of a vector: one entry, the ids in order behind it; entries in order of their list
            view = x.view(np.dtype((np.void, x.shape[1] * 4))).ravel()
            _, first, group = np.unique(view, return_index=True, return_inverse=True)
            cosine = np.einsum("ij,ij->i", x[first], index.centroids[at[first]])
            shell = (cosine[:, None] < SHELLS).sum(1)
            by = np.lexsort((shell, at[first]))
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            group, first, cosine = place[group.ravel()], first[by], np.clip(cosine[by], -1, 1)
            members, size = np.argsort(group, kind="stable"), np.bincount(group, minlength=len(first))
            codes, length = index.encode(x[first], at[first])
            parts = at[first].astype(np.int64) * (len(SHELLS) + 1) + shell[by]
            put(
                f"{index.folder}/{space}/{file}-{block}",
                {"ids": ids[members], "sizes": size.astype(np.int64), "starts": np.cumsum(size) - size, "lists": at[first].astype(np.int64), "parts": parts, "vecs": x[first], "codes": codes, "lengths": length},
            )
            own, begin, entries = np.unique(parts, return_index=True, return_counts=True)
            near, far = np.arccos(np.maximum.reduceat(cosine, begin)), np.arccos(np.minimum.reduceat(cosine, begin))
            yield pa.RecordBatch.from_arrays([pa.array([space] * len(own)), pa.array(own), pa.array(entries.astype(np.int64)), pa.array(near.astype(np.float32)), pa.array(far.astype(np.float32))], names=["space", "part", "n", "near", "far"])

    keyed = rows.select(F.format_string('["%s", %d, %d]', "space", "file", "block").alias("key"), "list", "id", "vec")
    written = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(write, "space string, part long, n long, near float, far float")
    told = written.groupBy("space", "part").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).toArrow()
    names, part, n, near, far = (told.column(c).to_numpy() for c in ("space", "part", "n", "near", "far"))
    for space, index in spaces.items():
        own, shape = names == space, (len(index.centroids), len(SHELLS) + 1)
        rows, index.near, index.far = np.zeros(shape), np.full(shape, np.inf, np.float32), np.full(shape, -np.inf, np.float32)
        for to, value in ((rows, n), (index.near, near), (index.far, far)):
            to.reshape(-1)[part[own]] = value[own]
        index.rows = rows.sum(1)
    return spaces


class _Files:
    """Files a worker has open, the most recently used ones."""

    def __init__(self, bound: int = 512):
        self.open: OrderedDict[str, tuple | None] = OrderedDict()
        self.bound = bound

    def __call__(self, name: str, d: int) -> tuple | None:
        """(ids, copies of each entry, where an entry's ids begin, vectors, codes, list of each entry, residual lengths, list and shell of each
        entry as one number) or None for a file nothing fell into."""
        if name not in self.open:
            data = get(name)
            if data:
                self.open[name] = (
                    np.frombuffer(data["ids"], np.int64), np.frombuffer(data["sizes"], np.int64), np.frombuffer(data["starts"], np.int64), np.frombuffer(data["vecs"], np.float32).reshape(-1, d),
                    np.frombuffer(data["codes"], np.uint8).reshape(-1, SUBSPACES), np.frombuffer(data["lists"], np.int64), np.frombuffer(data["lengths"], np.float32),
                    np.frombuffer(data["parts"], np.int64),
                )
            else:
                self.open[name] = None
            if len(self.open) > self.bound:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]


def _fitting(order: np.ndarray, rows: np.ndarray, room: float) -> np.ndarray:
    """The lists of ``order`` that fit, in turn; one that doesn't is passed over."""
    taken = [order[:0]]
    while len(order := order[rows[order] <= room]):
        n = int(np.searchsorted(np.cumsum(rows[order]), room, side="right"))
        taken.append(order[:n])
        room -= rows[order[:n]].sum()
        order = order[n:]
    return np.concatenate(taken)


def _visited(index: Space, q: np.ndarray) -> np.ndarray:
    """The lists a block of queries looks into, in order."""
    return np.sort(np.concatenate(_lists(index, q)))


def _lists(index: Space, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists nearest to a block of queries, and those that fill up its room. Empty ones are no lists."""
    alive, limit = np.flatnonzero(index.rows > 0), index.room
    sims, rows = q @ index.centroids[alive].T, index.rows[alive]
    votes = best_columns(sims, min(VOTES, len(alive)))
    value = np.take_along_axis(sims, votes, 1)
    sure = np.take_along_axis(votes, np.argsort(-value, axis=1)[:, :SURE], 1)
    wanted = np.unique(sure)
    count = np.bincount(votes.ravel(), minlength=len(alive))
    count[wanted] = 0
    more = np.argsort(-count, kind="stable")
    more = _fitting(more[count[more] > 0], rows, limit - rows[wanted].sum())
    if len(alive) > len(wanted) + len(more) and rows[wanted].sum() + rows[more].sum() < limit / 2:
        # few lists were asked for: look around the block's middle as well
        rest = np.setdiff1d(np.arange(len(alive)), np.concatenate([wanted, more]))
        rest = rest[np.argsort(-sims[:, rest].mean(0), kind="stable")]
        more = np.concatenate([more, _fitting(rest, rows, limit / 2 - rows[wanted].sum() - rows[more].sum())])
    return alive[wanted], alive[more]


class _Opened:
    """The rows a block of queries has opened, and of each query the best ones so far by asymmetric distance."""

    def __init__(self, index: Space, files: _Files, q: np.ndarray):
        self.index, self.files, self.q = index, files, q
        self.parts: list[tuple] = []  # (file's arrays, entries)
        self.best, self.score = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32)
        self.rows = 0

    def ask(self, parts: np.ndarray, who: np.ndarray) -> None:
        """Score the rows of these parts of lists for the queries ``who``: so many rows at a time as a block of ROWS holds."""
        shells, d = len(SHELLS) + 1, self.q.shape[1]
        tile: list[tuple] = []
        held = 0
        for file in np.unique(parts // (PACK * shells)).tolist():
            inside = parts[parts // (PACK * shells) == file]
            for n in self.index.names(file):
                if (entry := self.files(n, d)) is None:
                    continue
                lo, hi = np.searchsorted(entry[7], inside), np.searchsorted(entry[7], inside, side="right")
                take = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
                for a in range(0, len(take), ROWS):
                    some = take[a : a + ROWS]
                    if tile and held + len(some) > ROWS:
                        self._score(tile, who)
                        tile, held = [], 0
                    tile.append((entry, some))
                    held += len(some)
        if tile:
            self._score(tile, who)

    def _score(self, tile: list[tuple], who: np.ndarray) -> None:
        codes, at, length = (np.concatenate([e[c][t] for e, t in tile]) for c in (4, 5, 6))
        scores = self.index.distances(self.q[who], codes, length, at)
        if self.best.shape[1] == RERANK:
            best, value = above(scores, self.score[who].min(1))
        else:
            best = best_columns(scores, min(RERANK, len(at)))
            value = np.take_along_axis(scores, best, 1)
        score = np.concatenate([self.score[who], value], 1)
        best = np.concatenate([self.best[who], np.where(best < 0, -1, best + self.rows)], 1)
        if best.shape[1] > RERANK:
            keep = best_columns(score, RERANK)
            best, score = np.take_along_axis(best, keep, 1), np.take_along_axis(score, keep, 1)
        if best.shape[1] > self.best.shape[1]:  # those who weren't asked keep theirs; -1 is no row
            more = ((0, 0), (0, best.shape[1] - self.best.shape[1]))
            self.best, self.score = np.pad(self.best, more, constant_values=-1), np.pad(self.score, more, constant_values=-np.inf)
        self.best[who], self.score[who] = best, score
        self.parts += tile
        self.rows += len(at)

    def exact(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, cosines in single precision) of the best rows of the queries ``who``; -2 for no row."""
        flat = self.best[who].ravel()
        vecs = np.zeros((len(flat), self.q.shape[1]), np.float32)
        for entry, hit, at in self.each(flat):
            vecs[hit] = entry[3][at]
        vecs = vecs.reshape(len(who), -1, self.q.shape[1])
        return vecs, np.where(self.best[who] < 0, np.float32(-2), np.einsum("qd,qrd->qr", self.q[who], vecs))

    def each(self, rows: np.ndarray) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """(file's arrays, which of ``rows`` lie in it, their entries)."""
        begin = np.cumsum([0, *(len(t) for _, t in self.parts)])
        by = np.argsort(rows, kind="stable")
        bounds = np.searchsorted(rows[by], begin)
        for f in np.flatnonzero(np.diff(bounds)).tolist():
            (entry, take), hit = self.parts[f], by[bounds[f] : bounds[f + 1]]
            yield entry, hit, take[rows[hit] - begin[f]]


def _needed(index: Space, q: np.ndarray, lists: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(query, list, shell): whether the list's shell can hold a row with a cosine of ``least`` or more to the query. The angle between two
    rows is at least the difference of their angles to a centroid."""
    apart = np.arccos(np.clip(q @ index.centroids[lists].T, -1, 1))[:, :, None]
    bound = np.arccos(np.clip(least - COSINE_ERROR, -1, 1)) + ANGLE_ERROR
    return np.maximum(index.near[lists] - apart, apart - index.far[lists]) <= bound[:, None, None]


def _search(index: Space, name: str, files: _Files, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, neighbour ids, cosines), k neighbours a query in order, for the rows of one file. Missing neighbours have cosine -2."""
    d = index.centroids.shape[1]
    own = files(name, d)
    if own is None:
        return
    ids, sizes, starts, queries, _, home, _, parts = own
    shells = len(SHELLS) + 1
    loose = (index.cohesion[home] < SPARSE) | (parts % shells == len(SHELLS))
    for rows, step, alike in ((np.flatnonzero(~loose), BLOCK, True), (np.flatnonzero(loose), SPARSE_BLOCK, False)):
        for a in range(0, len(rows), step):
            mine = rows[a : a + step]
            q = queries[mine]
            sure, more = _lists(index, q)
            if not alike:  # without near neighbours the angles rule out nothing
                sure, more = np.concatenate([sure, more]), more[:0]
            opened, every = _Opened(index, files, q), np.arange(len(q))
            opened.ask((np.sort(sure)[:, None] * shells + np.arange(shells)).ravel(), every)
            vecs, exact = opened.exact(every)
            if len(more):
                # with k + 1 rows at hand, itself among them, only what is as near as the last of them is still wanted
                least = -np.partition(-exact, k, axis=1)[:, k] if exact.shape[1] > k else np.full(len(q), -2.0)
                need = _needed(index, q, np.sort(more), least).reshape(len(q), -1)
                asked, parts_of = need.sum(1), (np.sort(more)[:, None] * shells + np.arange(shells)).ravel()
                wide = asked > 1.5 * np.median(asked)  # a few that ask for nearly all don't make the others ask for it
                for some in (np.flatnonzero(~wide & (asked > 0)), np.flatnonzero(wide)):
                    if len(some):
                        opened.ask(parts_of[need[some].any(0)], some)
                if asked.any():
                    vecs, exact = opened.exact(every)
            best, take = opened.best, opened.best.shape[1]
            # only the front is ranked, in double
            front = min(take, 2 * (k + 1))
            order = np.argpartition(-exact, front - 1, axis=1)[:, :front]
            best = np.take_along_axis(best, order, 1)
            near = np.take_along_axis(vecs, order[:, :, None], 1).astype(np.float64)
            near /= np.maximum(np.linalg.norm(near, axis=2, keepdims=True), 1e-12)
            whole = q.astype(np.float64)
            whole /= np.linalg.norm(whole, axis=1, keepdims=True)
            exact = np.einsum("qd,qrd->qr", whole, near)
            flat = best.ravel()
            size, begins, inside = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
            for f, (entry, hit, at) in enumerate(opened.each(flat)):
                size[hit], begins[hit], inside[hit] = np.minimum(entry[1][at], k + 1), entry[2][at], f
            query_row = np.repeat(np.repeat(np.arange(len(q)), front), size)
            cosine = np.repeat(exact.ravel(), size)
            total = np.cumsum(size)
            inner = np.arange(total[-1]) - np.repeat(total - size, size)
            owner = np.repeat(inside, size)
            place = np.repeat(begins, size) + inner
            other = np.empty(total[-1], np.int64)
            by = np.argsort(owner, kind="stable")
            used = [entry for entry, _, _ in opened.each(flat)]
            bounds = np.searchsorted(owner[by], np.arange(len(used) + 1))
            for f, entry in enumerate(used):
                hit = by[bounds[f] : bounds[f + 1]]
                other[hit] = entry[0][place[hit]]
            order = np.lexsort((other, -np.round(cosine, 12), query_row))
            query_row, cosine, other = query_row[order], cosine[order], other[order]
            begin = np.searchsorted(query_row, np.arange(len(q)))
            end = np.append(begin[1:], len(query_row))
            pick = begin[:, None] + np.arange(k + 1)
            valid = pick < end[:, None]
            pick = np.minimum(pick, len(query_row) - 1)
            top, score = np.where(valid, other[pick], -1), np.where(valid, cosine[pick], -2.0)
            # every copy of the query's vector is a query; it drops itself
            copies = sizes[mine]
            member = np.repeat(starts[mine] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
            who = ids[member]
            top, score = np.repeat(top, copies, axis=0), np.repeat(score, copies, axis=0)
            itself = (top == who[:, None]) & (score > -1.5)
            drop = np.where(itself.any(1), itself.argmax(1), k)
            keep = np.arange(k + 1)[None, :] != drop[:, None]
            yield who, top[keep].reshape(-1, k), np.minimum(score[keep].reshape(-1, k), 1.0)


def _compared(index: Space, name: str, files: _Files, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_search`` yields, by comparing the rows of one file with every row of the space; only the best so far are held."""
    d = index.centroids.shape[1]
    own = files(name, d)
    if own is None:
        return
    ids, sizes, starts, queries = own[:4]
    for a in range(0, len(queries), BLOCK):
        q = queries[a : a + BLOCK].astype(np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        score, other = np.full((len(q), k + 1), -2.0), np.full((len(q), k + 1), np.iinfo(np.int64).max)
        for n in (n for f in range(len(index.blocks)) for n in index.names(f)):
            entry = files(n, d)
            if entry is None:
                continue
            for b in range(0, len(entry[3]), 8192):
                y = entry[3][b : b + 8192].astype(np.float64)
                s = q @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
                best = best_columns(s, min(k + 1, s.shape[1]))
                least = np.take_along_axis(s, best, 1).min(1)
                r, c = np.nonzero(s >= least[:, None] - 1e-12)  # ties go by id
                many = np.minimum(entry[1][b + c], k + 1)
                total = np.cumsum(many)
                inner = np.arange(total[-1]) - np.repeat(total - many, many)
                rows, cosine = np.repeat(r, many), np.repeat(s[r, c], many)
                member = entry[0][np.repeat(entry[2][b + c], many) + inner]
                rows, cosine, member = np.concatenate([np.repeat(np.arange(len(q)), k + 1), rows]), np.concatenate([score.ravel(), cosine]), np.concatenate([other.ravel(), member])
                order = np.lexsort((member, -np.round(cosine, 12), rows))
                begin = np.searchsorted(rows[order], np.arange(len(q)))
                pick = order[begin[:, None] + np.arange(k + 1)]
                score, other = cosine[pick], member[pick]
        mine = np.arange(a, a + len(q))
        copies = sizes[mine]
        who = ids[np.repeat(starts[mine] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())]
        top, value = np.repeat(other, copies, axis=0), np.repeat(score, copies, axis=0)
        itself = (top == who[:, None]) & (value > -1.5)
        keep = np.arange(k + 1)[None, :] != np.where(itself.any(1), itself.argmax(1), k)[:, None]
        yield who, top[keep].reshape(-1, k), np.minimum(value[keep].reshape(-1, k), 1.0)


def neighbours(vectors: DataFrame, id_column: str = "id", vec: str = "vec", k: int = K, exact: bool = False) -> DataFrame:
    """(id, space, rank, neighbour, cosine): of every usable row, the ``k`` most similar other rows of its space. With ``exact`` every row is
    compared with every other, in blocks: no neighbour is missed, and the work grows with the square of the rows.

    Usable: usual length, finite, not all zero, a known space and an id. Equal cosines (to 12 places) go by id. Fewer than ``k`` other
    rows give fewer neighbours; unusable rows have none. Ids are taken to be unique: rows that repeat an id with the same vector count as copies.
    """
    spark = vectors.sparkSession
    spaces = build(vectors, id_column, vec)
    schema = "id long, space string, rank int, neighbour long, cosine double"
    names = [(s, n) for s, index in spaces.items() for f in range(len(index.blocks)) for n in index.names(f)]
    if not names:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(spaces)
    jobs = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "n int, space string, file string")
    parts = min(len(names), 8 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in batches:
            for space, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for who, other, cosine in (_compared if exact else _search)(sent.value[space], name, files, k):
                    rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(who))
                    real = cosine.ravel() > -1.5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(who, k)[real]), pa.array([space] * int(real.sum())), pa.array(rank[real]), pa.array(other.ravel()[real]), pa.array(cosine.ravel()[real])], names=["id", "space", "rank", "neighbour", "cosine"]
                    )

    return jobs.repartitionByRange(parts, "n").mapInArrow(run, schema)


def close_pairs(found: DataFrame, least: float = 0.96) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs where one is among the other's neighbours and the cosine is at least ``least``; each once."""
    return (
        found.where(F.col("cosine") >= least)
        .select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
        .distinct()
    )
