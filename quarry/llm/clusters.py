"""Problem 5: groups of mutually similar records, with their size, typical members and tags.

Records are vectorised with hashed weighted features: the unit vector, and the record's tags hashed into a few more dimensions at a low
weight. Distributed k-means, seeded by parallel oversampling, cuts the records into cells; a cell that stays too full gets more
centroids from its own rows. Every record goes to its nearest cells, where chains of similar records are followed exactly; cells are
joined through the records they share by label propagation over the few links between cells' groups. A pass over the pairs that share no
cell, bounded by their angles to the centres, then finds every link that is left, so the groups are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import scratch, spread, written

from .vectorspace import LENGTHS, get, matrix, nearest, pieces, put

#: A step of a chain has at least this cosine; a group at least so many records.
STEP, LEAST = 0.75, 5
#: Dimensions and weight of the hashed tags.
TAG_DIMS, TAG_WEIGHT = 32, 0.1
#: Rounds of oversampling and of k-means; cells a record is sent to; rows from which a cell gets more centroids, one for each FILL rows.
SEED_ROUNDS, MEAN_ROUNDS, CELLS, FULL, FILL = 4, 2, 3, 4096, 1024
#: Centroids on the driver from seeding, and as many again from full cells, at most: 2 * MOST * 512 bytes are broadcast. Beyond it cells grow.
MOST = 65_536
#: A record whose nearest centroid is under this cosine lies between cells, and is sent to so many.
LOOSE, LOOSE_CELLS = 0.7, 10
#: In the exact pass a row of at least this cosine to its centre is compared by its angles; rows taken together of the others.
TIGHT, LOOSE_ROWS = 0.8, 4096
TYPICAL, TAGS = 5, 5
VEC = LENGTHS["clip"]


@lru_cache(maxsize=1 << 16)
def _bin(tag: str) -> tuple[int, float]:
    h = zlib.crc32(tag.encode())
    return h % TAG_DIMS, 1.0 if h >> 31 else -1.0


def featured(records: DataFrame) -> DataFrame:
    """(id, hash, tags, feature) from (id, hash, vec, tags): tags trimmed, lower-case and distinct; the feature is of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = matrix(batch.column(2), VEC)
            if not len(at):
                continue
            kept = batch.take(pa.array(at))
            tags = [sorted({" ".join(t.split()).lower() for t in (row or ()) if t and t.strip()}) for row in kept.column(3).to_pylist()]
            extra = np.zeros((len(at), TAG_DIMS), np.float32)
            for i, row in enumerate(tags):
                for t in row:
                    where, sign = _bin(t)
                    extra[i, where] += sign
            norm = np.linalg.norm(extra, axis=1, keepdims=True)
            extra = TAG_WEIGHT * np.divide(extra, norm, out=extra, where=norm > 0)
            feature = np.concatenate([x, extra], 1)
            feature /= np.linalg.norm(feature, axis=1, keepdims=True)
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * feature.shape[1])
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(tags, pa.list_(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(feature.ravel()))], names=["id", "hash", "tags", "feature"])

    return records.mapInArrow(run, "id long, hash string, tags array<string>, feature array<float>")


def _features(batch: pa.RecordBatch, name: str = "feature") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _chance(ids: np.ndarray, turn: int) -> np.ndarray:
    """A number in [0, 1) that depends on the id and the turn alone."""
    from .codepoints import mix

    with np.errstate(over="ignore"):
        return mix(ids.astype(np.uint64) + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)).astype(np.float64) / 2.0**64


class Cells:
    """Centroids of the cells, found by distributed k-means over a table of features."""

    def __init__(self, rows: DataFrame, total: int):
        self.rows, self.spark = rows.select("id", "feature"), rows.sparkSession
        self.k = max(1, min(MOST, round(1.5 * total**0.5)))
        first = np.array(self.rows.orderBy(F.xxhash64("id"), "id").limit(1).collect()[0]["feature"], np.float32)
        seeds, cost = first[None], 2.0 * total
        for turn in range(SEED_ROUNDS):
            more, cost = self._oversample(seeds, cost, turn)
            seeds = np.concatenate([seeds, more])
        sums, counts = self._means(seeds)
        self.centroids = self._reduce(seeds, counts)
        for _ in range(MEAN_ROUNDS):
            sums, counts = self._means(self.centroids)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), self.centroids).astype(np.float32)
        full = counts > FULL
        if full.any():
            self.centroids = np.concatenate([self.centroids[~full], self._inside(self.centroids, full, float(counts[full].sum()))])

    def _oversample(self, centres: np.ndarray, cost: float, turn: int) -> tuple[np.ndarray, float]:
        """Rows drawn with a chance in proportion to their squared distance, about k of them; and the cost of the centres so far. What comes to
        the driver is these rows, k on average and at most a few standard deviations more, and a number a partition."""
        sent, k = self.spark.sparkContext.broadcast(centres), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                x = _features(batch)
                away = np.maximum(0.0, 2 - 2 * nearest(x, sent.value)[1].astype(np.float64))
                total += float(away.sum())
                drawn = np.flatnonzero(_chance(batch.column(0).to_numpy(), turn) < k * away / max(cost, 1e-9))
                if len(drawn):
                    yield pa.RecordBatch.from_arrays([pa.array([0.0] * len(drawn)), batch.column(1).take(pa.array(drawn))], names=["cost", "feature"])
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([[]], pa.list_(pa.float32()))], names=["cost", "feature"])

        got = self.rows.mapInArrow(run, "cost double, feature array<float>").toArrow()
        drawn = got.column("feature").combine_chunks().flatten().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, np.float32)
        return drawn.reshape(-1, centres.shape[1]), float(pa.compute.sum(got.column("cost")).as_py() or 0.0)

    def _means(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the rows nearest each centre, their number); summed per partition first, then by centre."""
        sent = self.spark.sparkContext.broadcast(centres)
        schema = "centre int, n long, total array<float>"

        def emit(n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(n)
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * total.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(total[at].astype(np.float32).ravel()))], names=["centre", "n", "total"])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            n, total = np.zeros(len(c)), np.zeros(c.shape)
            for batch in batches:
                x = _features(batch)
                at, _ = nearest(x, c)
                order = np.argsort(at, kind="stable")
                present, start = np.unique(at[order], return_index=True)
                if len(present):
                    total[present] += np.add.reduceat(x[order], start, axis=0)
                    n[present] += np.diff(np.append(start, len(at)))
            yield emit(n, total)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(sent.value)), np.zeros(sent.value.shape)
            for batch in batches:
                at = batch.column(0).to_numpy()
                np.add.at(n, at, batch.column(1).to_numpy())
                np.add.at(total, at, _features(batch, "total"))
            yield emit(n, total)

        rows = self.rows.mapInArrow(partial, schema).repartition("centre").mapInArrow(whole, schema).collect()
        n, total = np.zeros(len(centres)), np.zeros(centres.shape)
        for r in rows:
            n[r["centre"]], total[r["centre"]] = r["n"], r["total"]
        return total, n

    def _reduce(self, seeds: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """k centroids of the weighted seeds: the far and heavy ones first, then a few rounds of means."""
        if len(seeds) <= self.k:
            return seeds
        rng = np.random.default_rng(5)
        chosen, away = [int(weight.argmax())], np.full(len(seeds), np.inf)
        for _ in range(self.k - 1):
            away = np.minimum(away, np.maximum(0, 2 - 2 * (seeds @ seeds[chosen[-1]]).astype(np.float64)))
            p = away * np.maximum(weight, 0.1)
            if p.sum() <= 0:
                break
            chosen.append(int(rng.choice(len(seeds), p=p / p.sum())))
        c = seeds[chosen]
        for _ in range(3):
            at, _ = nearest(seeds, c)
            sums = np.zeros_like(c)
            np.add.at(sums, at, seeds * weight[:, None].astype(np.float32))
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c).astype(np.float32)
        return c

    def _inside(self, centres: np.ndarray, full: np.ndarray, rows: float) -> np.ndarray:
        """New centroids for full cells, which hold ``rows`` rows: one of each FILL of them, or fewer, so that about MOST come to the driver."""
        sent, rate = self.spark.sparkContext.broadcast((centres, full)), min(1 / FILL, MOST / max(1.0, rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _features(batch)
                drawn = np.flatnonzero(_chance(batch.column(0).to_numpy(), 99) < rate)
                drawn = drawn[sent.value[1][nearest(x[drawn], sent.value[0])[0]]] if len(drawn) else drawn
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(drawn, pa.int64()))], names=["feature"])

        got = self.rows.mapInArrow(run, "feature array<float>").toArrow()
        drawn = got.column("feature").combine_chunks().flatten().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, np.float32)
        return drawn.reshape(-1, centres.shape[1]) if len(drawn) else centres[full]


def chains(x: np.ndarray, step: float) -> np.ndarray:
    """The component of each row, as the place of its first row: rows are joined by chains of pairs with a product of ``step`` or more."""
    label = np.full(len(x), -1)
    left = np.arange(len(x))
    while len(left):
        first = left[0]
        front = left[:1]
        label[first] = first
        left = left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            for a in range(0, len(front), 512):
                todo = np.flatnonzero(~reached)
                if not len(todo):
                    break
                reached[todo] = ((x[left[todo]] @ x[front[a : a + 512]].T) >= step).any(1)
            front, left = left[reached], left[~reached]
            label[front] = first
    return label


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``links`` (a, b): root is the least node of the component. Labels travel along the links and along
    labels themselves, so the rounds grow with the logarithm of the longest path; each round's result is a written table."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        own = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("before"), F.least("root", "heard").alias("root"))
        above = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = own.join(above, F.col("root") == F.col("_n"), "left").select("node", "before", F.least("root", "_r").alias("root"))
        new = written(new, "labels")
        labels = new.select("node", "root")
        if not new.where("root <> before").limit(1).count():
            return labels


def _centres(centroids: np.ndarray) -> np.ndarray:
    """The centroids without their tags, at length one."""
    c = centroids[:, :VEC]
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class Groups:
    """Groups of the usable clip rows.

    Unusable rows (another length, not finite, all zero, null id) are in no group. Copies of a vector are followed as one and are all
    members. Null or empty tags add nothing; an unknown asset has no tags. Ids are taken to be unique.
    """

    def __init__(self, vectors: DataFrame, assets: DataFrame | None = None, step: float = STEP, least: int = LEAST):
        self.spark = vectors.sparkSession
        clip = spread(vectors.where((F.col("space") == "clip") & (F.size("vec") == VEC) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "hash", "vec"))
        if assets is not None:
            tags = assets.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.first("tags", ignorenulls=True).alias("tags"))
            clip = clip.join(tags, "hash", "left").select("id", "hash", "vec", "tags")
        else:
            clip = clip.withColumn("tags", F.lit(None).cast("array<string>"))
        keyed = lambda df: df.withColumns({"k1": F.xxhash64("vec"), "k2": F.hash("vec")})
        self.rows = written(featured(clip), "features")
        vec = F.slice("feature", 1, VEC)
        marked = self.rows.select("id", vec.alias("vec"))
        copies = keyed(marked).groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        twins = copies.where("n > 1")
        reps = self.rows.select("id", "feature").join(
            keyed(marked).join(twins, ["k1", "k2"]).where("id <> rep").select("id"), "id", "left_anti"
        )
        reps = written(reps, "distinct")
        total = reps.count()
        self.empty = not total
        if self.empty:
            self.members = self.spark.createDataFrame([], "id long, root long")
            self.sizes = self.spark.createDataFrame([], "root long, size long")
            return
        cells = Cells(reps, total)
        folder = scratch(self.spark, "homes")
        labelled = written(self._labelled(reps, cells.centroids, step, folder), "cells")
        own = labelled.groupBy("id").agg(F.min("label").alias("low"))
        links = labelled.join(own, "id").where("label <> low").select(F.col("low").alias("a"), F.col("label").alias("b")).distinct()
        roots = components(links)
        single = own.join(roots, F.col("low") == F.col("node"), "left").select("id", F.coalesce("root", "low").alias("root"))
        single = self._across(labelled, written(single, "inside"), cells.centroids, step, folder)
        followers = keyed(marked).join(twins, ["k1", "k2"]).where("id <> rep").select("id", F.col("rep"))
        followers = followers.join(single.select(F.col("id").alias("rep"), "root"), "rep").select("id", "root")
        every = single.unionByName(followers)
        self.sizes = written(every.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= least), "sizes")
        self.members = written(every.join(self.sizes, "root").select("id", "root"), "members")

    @staticmethod
    def _labelled(reps: DataFrame, centroids: np.ndarray, step: float, folder: str) -> DataFrame:
        """(id, label, home, cosine) for each cell of each record: label is the least id of its chain in the cell; home is the cell if it is
        the record's nearest one, else null, and cosine that to its centre. Ids and vectors of the records at home are left in files."""
        sent, centre = reps.sparkSession.sparkContext.broadcast(centroids), reps.sparkSession.sparkContext.broadcast(_centres(centroids))
        width, wide, tight = min(CELLS, len(centroids)), min(LOOSE_CELLS, len(centroids)), TIGHT

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _features(batch)
                for a in range(0, len(x), 4096):
                    part = x[a : a + 4096]
                    s = part @ sent.value.T
                    vec = part[:, :VEC] / np.linalg.norm(part[:, :VEC], axis=1, keepdims=True)
                    ids = batch.column(0).to_numpy()[a : a + 4096]
                    loose = s.max(1) < LOOSE
                    for rows, n in ((np.flatnonzero(~loose), width), (np.flatnonzero(loose), wide)):
                        if not len(rows):
                            continue
                        near = np.argpartition(-s[rows], n - 1, axis=1)[:, :n]
                        home = np.arange(n) == np.take_along_axis(s[rows], near, 1).argmax(1)[:, None]
                        flat = np.repeat(vec[rows], n, axis=0)
                        offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * VEC)
                        yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(np.repeat(ids[rows], n)), pa.array(home.ravel()), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=["cell", "id", "home", "vec"])

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell in pieces(batches, "cell"):
                ids = cell.column("id").to_numpy()
                column = cell.column("vec").combine_chunks()
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                ids, x, home = ids[order], x[order], cell.column("home").to_numpy()[order]
                number = cell.column("cell")[0].as_py()
                cosine = x @ centre.value[number]
                for name, mine in (("near", home & (cosine >= tight)), ("far", home & (cosine < tight))):
                    if mine.any():
                        put(f"{folder}/{number}-{name}", {"ids": ids[mine], "vecs": x[mine]})
                label = ids[chains(x, step)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(np.full(len(ids), number, np.int32), mask=~home), pa.array(cosine)], names=["id", "label", "home", "cosine"])

        sorted_ = reps.mapInArrow(assign, "cell int, id long, home boolean, vec array<float>").repartition("cell").sortWithinPartitions("cell")
        return sorted_.mapInArrow(follow, "id long, label long, home int, cosine float")

    def _across(self, labelled: DataFrame, single: DataFrame, centroids: np.ndarray, step: float, folder: str) -> DataFrame:
        """(id, root) with the links between rows that share no cell. Nothing is left out but what the angle forbids: two rows within
        acos(step) of each other differ by no more than that in their angle to any centre. Rows near their own centre (cosine TIGHT) meet
        only rows within that of the cell's greatest angle; the others are taken together from several cells and meet each other in full."""
        spark, near, tight_at = self.spark, len(centroids), TIGHT
        sent = spark.sparkContext.broadcast(_centres(centroids))
        homes = labelled.where("home is not null")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, "home"):
                ids = part.column("id").to_numpy()
                order = np.argsort(ids)
                put(f"{folder}/{part.column('home')[0].as_py()}-root", {"ids": ids[order], "roots": part.column("root").to_numpy()[order]})
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64())], names=["n"])

        homes.select("id", "home").join(single, "id").select("home", "id", "root").repartition("home").sortWithinPartitions("home").mapInArrow(write, "n long").agg(F.sum("n")).collect()
        told = homes.groupBy("home", (F.col("cosine") >= F.lit(tight_at).cast("float")).alias("near")).agg(F.min("cosine").alias("least"), F.count("*").alias("n")).orderBy("home").collect()
        tight = np.array([r["home"] for r in told if r["near"]], np.int64)
        away = [(r["home"], r["n"]) for r in told if not r["near"]]
        bundle = (np.cumsum([n for _, n in away]) - 1) // LOOSE_ROWS if away else np.zeros(0, np.int64)
        loose = {near + int(b): [away[i][0] for i in np.flatnonzero(bundle == b)] for b in np.unique(bundle)}
        # cosine to the centre below which no row reaches one of the cell; the angles a little wider, as single precision may have them less
        angle = np.arccos(np.clip([r["least"] for r in told if r["near"]], -1, 1)) + 1e-3
        reach = np.cos(np.minimum(np.pi, angle + np.arccos(step)))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def rows(file: int) -> tuple[np.ndarray, np.ndarray]:
                if file not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened)))
                    roots, vecs = [], []
                    for cell in loose[file] if file >= near else [file]:
                        data, known = get(f"{folder}/{cell}-{'far' if file >= near else 'near'}"), get(f"{folder}/{cell}-root")
                        at = np.searchsorted(np.frombuffer(known["ids"], np.int64), np.frombuffer(data["ids"], np.int64))
                        roots.append(np.frombuffer(known["roots"], np.int64)[at])
                        vecs.append(np.frombuffer(data["vecs"], np.float32).reshape(-1, VEC))
                    opened[file] = np.concatenate(roots), np.concatenate(vecs)
                return opened[file]

            for batch in batches:
                for file in batch.column(0).to_pylist():
                    root, x = rows(file)
                    before = tight[tight < file]
                    may = x @ sent.value[before].T >= reach[: len(before)]
                    links = set()
                    todo = [(int(before[j]), np.flatnonzero(may[:, j])) for j in np.flatnonzero(may.any(0)).tolist()]
                    todo += [(f, np.arange(len(x))) for f in loose if f <= file]
                    if file < near:
                        todo.append((file, np.arange(len(x))))
                    for f, mine in todo:
                        other, y = rows(f)
                        if file < near and f != file:
                            back = np.flatnonzero(y @ sent.value[file] >= reach[len(before)])
                            other, y = other[back], y[back]
                        if not len(y):
                            continue
                        for a in range(0, len(mine), 1024):
                            part = mine[a : a + 1024]
                            for b in range(0, len(y), 4096):
                                hit = x[part] @ y[b : b + 4096].T >= step
                                if hit.any():
                                    hit &= root[part][:, None] != other[b : b + 4096]
                                    i, k = np.nonzero(hit)
                                    u, v = root[part[i]], other[b + k]
                                    links |= set(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))
                    if links:
                        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links]), pa.array([b for _, b in links])], names=["a", "b"])

        # the long ones, which meet all others, are dealt out first
        order = [*sorted(loose, reverse=True), *reversed(tight.tolist())]
        parts = min(len(order), 8 * spark.sparkContext.defaultParallelism)
        jobs = spark.createDataFrame([(i % parts, f) for i, f in enumerate(order)], "part int, file long").repartitionByRange(parts, "part").select("file")
        links = written(jobs.mapInArrow(compare, "a long, b long").distinct(), "across")
        if not links.limit(1).count():
            return single
        roots = components(links).select("node", F.col("root").alias("joined"))
        return single.join(roots, F.col("root") == F.col("node"), "left").select("id", F.coalesce("joined", "root").alias("root"))

    def pairs(self, rows_a_bucket: int = 50_000) -> DataFrame:
        """(id_a, id_b): each member with the member of the same group that has the next greater id. Groups are cut into ranges of ids,
        whose edges are joined afterwards, so that no task holds a whole group."""
        low, high, n = self.members.agg(F.min("id"), F.max("id"), F.count("*")).collect()[0]
        if not n:
            return self.spark.createDataFrame([], "id_a long, id_b long")
        width = max(1, (high - low + 1) * rows_a_bucket // n)
        rows = self.members.withColumn("bucket", F.floor(F.col("id") / F.lit(width)).cast("long"))
        inside = rows.select("id", F.lead("id").over(W.partitionBy("root", "bucket").orderBy("id")).alias("next")).where("next is not null")
        edges = rows.groupBy("root", "bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        across = edges.select(F.col("high").alias("id"), F.lead("low").over(W.partitionBy("root").orderBy("bucket")).alias("next")).where("next is not null")
        return inside.unionByName(across).select(F.col("id").alias("id_a"), F.col("next").alias("id_b"))

    def described(self) -> DataFrame:
        """(group_id = least id, size, typical = ids nearest the centroid, similarity = their cosines to it, tags = the most frequent)."""
        if self.empty:
            return self.spark.createDataFrame([], "group_id long, size long, typical array<long>, similarity array<double>, tags array<string>")
        rows = self.rows.join(self.members, "id")
        names = [f"c{i}" for i in range(VEC)]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, root = _features(batch)[:, :VEC], batch.column(0).to_numpy()
                if not len(root):
                    continue
                order = np.argsort(root, kind="stable")
                present, start = np.unique(root[order], return_index=True)
                sums = np.add.reduceat(x[order], start, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(present), *(pa.array(c) for c in sums.T)], names=["root", *names])

        sums = rows.select("root", "feature").mapInArrow(partial, "root long, " + ", ".join(f"{c} float" for c in names)).groupBy("root").agg(*(F.sum(c).cast("float").alias(c) for c in names))
        centres = sums.select("root", F.array(*names).alias("centre"))

        def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                root, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(root):
                    continue
                x, c = _features(batch)[:, :VEC], _features(batch, "centre")
                s = np.einsum("ij,ij->i", x, c) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(c, axis=1), 1e-12)
                order = np.lexsort((ids, -s, root))
                place = np.arange(len(order)) - np.searchsorted(root[order], root[order])
                top = order[place < TYPICAL]
                yield pa.RecordBatch.from_arrays([pa.array(root[top]), pa.array(ids[top]), pa.array(s[top].astype(np.float64))], names=["root", "id", "cosine"])

        near = rows.select("root", "id", "feature").join(centres, "root").select("root", "id", "feature", "centre").mapInArrow(closest, "root long, id long, cosine double")
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "id"))), 1, TYPICAL)
        typical = near.groupBy("root").agg(best.alias("best"))
        counted = rows.select("root", F.explode("tags").alias("tag")).groupBy("root", "tag").agg(F.count("*").alias("n"))
        # the first few of each part come before the shuffle: no group's tags meet in whole
        ranked = counted.withColumn("place", F.row_number().over(W.partitionBy("root").orderBy(F.desc("n"), "tag"))).where(F.col("place") <= TAGS)
        tags = ranked.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "tag"))).alias("tags"))
        return (
            self.sizes.join(typical, "root").join(tags, "root", "left")
            .select(F.col("root").alias("group_id"), "size", F.col("best.id").alias("typical"), F.transform("best.d", lambda d: -d).alias("similarity"), F.coalesce("tags.tag", F.array().cast("array<string>")).alias("tags"))
        )
