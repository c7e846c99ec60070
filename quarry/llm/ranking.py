"""Problem 6: one ranking of assets per query from scores on different scales.

Three scores of every asset and query: the best cosine in each vector space, and a BM25 word score over caption and body. Median rank
aggregation makes them one ranking: in each score an asset has its rank among the assets of its kind, as a share of them; assets are
ordered by the weighted median of these, then their mean, then the hash. No score's range plays a part, nor how many vectors a kind has.

Scores are compared as they are, in single precision; equal ones share the average rank. Levels of a score only part the work: counts per
level say how many assets lie above, and ranges of levels are sorted apart, at most about RANGE scores each. A range is never cut inside a
level. Ranks travel in blocks of assets, so an asset's ranks for all queries meet in one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scalar import STOP as KEYWORD_STOP
from quarry.session import numbered, scratch, spread, written

from .vectorspace import LENGTHS, get, matrix, pieces, put

#: Weight of the scores by clip vector, text vector and words.
WEIGHTS = np.array([1.0, 1.0, 0.75])
#: Levels of a score; queries handled in one pass; assets of one query put in order together, about, and at most.
LEVELS, QUERIES, TOGETHER, CROWD = 8192, 128, 4000, 250_000
#: Assets of a block; scores of one query that are sorted together.
BLOCK, RANGE = 512, 1_000_000
K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")
#: Words that say nothing about the content: those of the keyword search, and the commonest of the other languages' queries.
STOP = {*KEYWORD_STOP, "le", "la", "les", "de", "des", "du", "et", "un", "une", "el", "los", "las", "y", "con", "der", "die", "das", "und", "ein", "eine", "image", "images", "video", "videos", "brochures", "pages"}


def folded(text: str) -> list[str]:
    """Words without case and accents."""
    return _WORD.findall("".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)))


def _words(assets: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(hash, kind, length, terms, counts): how often each asset's caption and body hold the queries' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts, ends = [], [], [], [0]
            for caption, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found: dict[int, int] = {}
                words = folded(f"{caption or ''}\n{body or ''}")
                for w in words:
                    if w in vocabulary:
                        found[vocabulary[w]] = found.get(vocabulary[w], 0) + 1
                lengths.append(len(words))
                terms += found.keys()
                counts += found.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                names=["hash", "kind", "length", "terms", "counts"],
            )

    source = spread(assets.where(F.col("hash").isNotNull()).select("hash", "kind", "caption", "body"))
    return source.mapInArrow(run, "hash string, kind string, length int, terms array<int>, counts array<int>")


def _best(vectors: DataFrame, wanted: dict[str, np.ndarray]) -> DataFrame:
    """(hash, space, best): the best cosine of each batch's rows of an asset with every query."""
    sent = vectors.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch.column(1).to_pylist(), object)
            for space, q in sent.value.items():
                own = np.flatnonzero(spaces == space)
                if not len(own):
                    continue
                x, at = matrix(batch.column(2).take(pa.array(own)), LENGTHS[space])
                if not len(at):
                    continue
                hashes = batch.column(0).take(pa.array(own[at])).dictionary_encode()
                code = hashes.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                present, start = np.unique(code[order], return_index=True)
                # summed in double: copies of a vector get equal scores in whatever batch they are
                best = np.maximum.reduceat((x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.float32)[order], start, axis=0)
                offsets = pa.array(np.arange(len(present) + 1, dtype=np.int32) * q.shape[0])
                yield pa.RecordBatch.from_arrays([hashes.dictionary.take(pa.array(present)), pa.array([space] * len(present)), pa.ListArray.from_arrays(offsets, pa.array(best.ravel()))], names=["hash", "space", "best"])

    rows = vectors.where(F.col("space").isin(list(wanted)) & F.col("hash").isNotNull()).select("hash", "space", "vec")
    return spread(rows).mapInArrow(run, "hash string, space string, best array<float>")


def whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the key column, several groups at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        last = values[len(values) - 1]
        lo = len(values) - 1
        while lo > 0 and values[lo - 1] == last:
            lo -= 1
        if lo == 0 and held and held[-1].column(key)[-1] == last:
            held.append(batch)
            continue
        if lo == 0:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, lo)])
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held)


def _level(score: np.ndarray) -> np.ndarray:
    return np.clip(np.round((score + 1) * (LEVELS / 2)), 0, LEVELS).astype(np.int16)


def _levels(values: np.ndarray, n: int) -> np.ndarray:
    """The levels of a batch's scores (row, 3 n), -1 where there is none. They never fall as a score grows."""
    x = values.astype(np.float64)
    x[:, 2 * n :] /= x[:, 2 * n :] + 2.0
    return np.where(np.isnan(x), -1, _level(np.nan_to_num(x))).astype(np.int64)


def scores(assets: DataFrame, vectors: DataFrame, rows: list) -> DataFrame:
    """(block, row, hash, kind, value): each score of each query, row-major by score; NaN where the asset has no such score. A block is a
    number of at most BLOCK assets, a row the place in it."""
    n = len(rows)
    wanted = {}
    for space, column in (("clip", "clip_vec"), ("text", "text_vec")):
        q = np.zeros((n, LENGTHS[space]), np.float32)
        for i, r in enumerate(rows):
            v = np.array(r[column] or [], np.float32)
            if len(v) == LENGTHS[space] and np.isfinite(v).all() and np.linalg.norm(v) > 0:
                q[i] = v / np.linalg.norm(v)
        wanted[space] = q
    asked = [[w for w in dict.fromkeys(folded(r["query"] or "")) if w not in STOP] for r in rows]
    vocabulary = {w: i for i, w in enumerate(sorted({w for a in asked for w in a}))}
    word = written(_words(assets, vocabulary), "words")
    number, mean = word.agg(F.count("*"), F.avg("length")).collect()[0]
    df = dict(word.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect())
    idf = np.array([max(np.log((number - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)), 1e-6) for t in range(len(vocabulary))])
    uses = np.zeros((len(vocabulary), n))
    for i, a in enumerate(asked):
        for w in a:
            uses[vocabulary[w], i] = idf[vocabulary[w]]
    mean = mean or 1.0
    given = {s: np.flatnonzero(np.abs(q).sum(1) > 0) for s, q in wanted.items()}
    ending = "hash string, kind string, length int, terms array<int>, counts array<int>, space string, best array<float>"
    none = {"kind": "string", "length": "int", "terms": "array<int>", "counts": "array<int>"}
    best = _best(vectors, wanted).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    both = best.unionByName(word.withColumns({"space": F.lit(None).cast("string"), "best": F.lit(None).cast("array<float>")}))
    names = [x.split()[0] for x in ending.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        for part in whole_groups(batches, 0):
            part = part.combine_chunks()
            code = part.column("hash").combine_chunks().dictionary_encode()
            hashes, code = code.dictionary, code.indices.to_numpy()
            out = np.full((len(hashes), 3, n), np.nan, np.float32)
            kinds: list = [None] * len(hashes)
            own = np.zeros(len(hashes), bool)
            spaces = part.column("space").to_pylist()
            mine = [i for i, s in enumerate(spaces) if s is None]
            if mine:
                rows_ = part.take(pa.array(mine))
                length = rows_.column("length").to_numpy()
                at = code[mine]
                for i, k in zip(at.tolist(), rows_.column("kind").to_pylist(), strict=True):
                    kinds[i] = kinds[i] or k
                own[at] = True
                terms = rows_.column("terms").combine_chunks()
                size = np.diff(terms.offsets.to_numpy())
                flat = terms.flatten().to_numpy(zero_copy_only=False)
                tf = rows_.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
                doc = np.repeat(np.arange(len(mine)), size)
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
                score = np.zeros((len(mine), n))
                for a in range(0, len(flat), 1 << 15):
                    np.add.at(score, doc[a : a + (1 << 15)], weight[a : a + (1 << 15), None] * uses[flat[a : a + (1 << 15)]])
                out[at, 2] = np.where(score > 0, score, np.nan)
            for s, space in enumerate(("clip", "text")):
                mine = [i for i, x in enumerate(spaces) if x == space]
                if mine:
                    at = code[mine]
                    cosine = part.column("best").take(pa.array(mine)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    merged = np.full((len(hashes), n), -2.0, np.float32)
                    np.maximum.at(merged, at, cosine)
                    got = np.zeros((len(hashes), n), bool)
                    got[np.unique(at)[:, None], given[space]] = True
                    out[:, s] = np.where(got, merged, np.nan)
            keep = np.flatnonzero(own)
            offsets = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * (3 * n))
            number = done + np.arange(len(keep))
            done += len(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number // BLOCK), pa.array((number % BLOCK).astype(np.int32)), hashes.take(pa.array(keep)), pa.array([kinds[i] or "" for i in keep.tolist()]), pa.ListArray.from_arrays(offsets, pa.array(out[keep].ravel()))],
                names=["block", "row", "hash", "kind", "value"],
            )

    return both.select(*names).repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "block long, row int, hash string, kind string, value array<float>")


def _values(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3 * n)


def _tables(scored: DataFrame, n: int, kinds: list[str], folder: str) -> None:
    """A file for each score and query: by kind, how many assets lie above every level; and the range each level belongs to."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.searchsorted(kinds, np.array(batch.column(0).to_pylist(), object).astype(str))
            level = _levels(_values(batch.column(1), n), n)
            key = (kind[:, None] * (3 * n) + np.arange(3 * n)) * (LEVELS + 1) + level
            value, number = np.unique(key[level >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((value // (LEVELS + 1) % (3 * n)).astype(np.int32)), pa.array((value // (LEVELS + 1) // (3 * n)).astype(np.int32)), pa.array((value % (LEVELS + 1)).astype(np.int32)), pa.array(number)],
                names=["score", "kind", "level", "n"],
            )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, 0):
            score = part.column("score").to_numpy()
            for s in np.unique(score):
                mine = score == s
                table = np.zeros((len(kinds), LEVELS + 1), np.int64)
                np.add.at(table, (part.column("kind").to_numpy()[mine], part.column("level").to_numpy()[mine]), part.column("n").to_numpy()[mine])
                above = table[:, ::-1].cumsum(1)[:, ::-1] - table
                level = table.sum(0)
                put(f"{folder}/{s}", {"above": above, "range": ((level.cumsum() - level) // RANGE).astype(np.int32)})
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32())], names=["score"])

    counted = scored.select("kind", "value").mapInArrow(count, "score int, kind int, level int, n long").groupBy("score", "kind", "level").agg(F.sum("n").alias("n"))
    counted.repartition("score").sortWithinPartitions("score").mapInArrow(store, "score int").agg(F.count("*")).collect()


def _shares(scored: DataFrame, n: int, kinds: list[str], sizes: dict[str, int], folder: str) -> DataFrame:
    """(block, score, row, share): the rank of each score among all of its kind, as a share of the kind's assets; a row per block and range."""
    total = np.array([sizes[k] for k in kinds], np.float64)

    def part_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = np.zeros((3 * n, LEVELS + 1), np.int32)
        for s in range(3 * n):
            if data := get(f"{folder}/{s}"):
                ranges[s] = np.frombuffer(data["range"], np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                asset = part.column(0).to_numpy() * BLOCK + part.column(1).to_numpy()
                kind = np.searchsorted(kinds, np.array(part.column(2).to_pylist(), object).astype(str)).astype(np.int32)
                value = _values(part.column(3), n)
                level = _levels(value, n)
                s, row = np.nonzero(level.T >= 0)
                if not len(s):
                    continue
                within = ranges[s, level[row, s]]
                order = np.lexsort((within, s))
                s, row, within = s[order], row[order], within[order]
                start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (within[1:] != within[:-1])]))
                offsets = pa.array(np.append(start, len(s)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (asset[row], kind[row], value[row, s])]
                yield pa.RecordBatch.from_arrays([pa.array((s[start].astype(np.int64) << 32) + within[start]), *lists], names=["key", "asset", "kind", "value"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "key"):
            s = part.column("key")[0].as_py() >> 32
            above = np.frombuffer(get(f"{folder}/{s}")["above"], np.int64).reshape(len(kinds), -1)
            asset, kind, value = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("asset", "kind", "value"))
            order = np.lexsort((-value, kind))
            asset, kind, value = asset[order], kind[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])]))
            size = np.diff(np.append(first, len(kind)))
            begins = np.searchsorted(kind, np.arange(len(kinds)))
            # above the range of levels: what is above the level of its best score
            x = value[np.minimum(begins, len(value) - 1)].astype(np.float64)
            over = above[np.arange(len(kinds)), _level(x / (x + 2.0) if s >= 2 * n else x)]
            here = kind[first]
            share = np.repeat((over[here] + first - begins[here] + (size + 1) / 2) / total[here], size)
            order = np.argsort(asset, kind="stable")
            block, row, share = asset[order] // BLOCK, (asset[order] % BLOCK).astype(np.int32), share[order]
            start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            offsets = pa.array(np.append(start, len(block)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[start]), pa.array(np.full(len(start), s, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(row)), pa.ListArray.from_arrays(offsets, pa.array(share))], names=["block", "score", "rows", "shares"]
            )

    parted = scored.select("block", "row", "kind", "value").mapInArrow(part_scores, "key long, asset array<long>, kind array<int>, value array<float>")
    return parted.repartition("key").sortWithinPartitions("key").mapInArrow(rank, "block long, score int, rows array<int>, shares array<double>")


def weighted_median(share: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted lower median, weighted mean) over axis 1, NaN left out; NaN where nothing is left."""
    there = ~np.isnan(share)
    w = np.where(there, weights[None, :, None], 0.0)
    order = np.argsort(np.where(there, share, np.inf), axis=1, kind="stable")
    x, w_sorted = np.take_along_axis(share, order, 1), np.take_along_axis(w, order, 1)
    total = w.sum(1)
    at = (np.cumsum(w_sorted, 1) >= total[:, None] / 2 - 1e-12).argmax(1)
    median = np.take_along_axis(x, at[:, None], 1)[:, 0]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(there, share * w, 0.0).sum(1) / total
    return np.where(total > 0, median, np.nan), mean


def ranking(queries: DataFrame, assets: DataFrame, vectors: DataFrame, weights: np.ndarray = WEIGHTS) -> DataFrame:
    """(query_id, position, hash, kind, median_rank, mean_rank, scores) of every asset that has a score for the query; best first.

    Ranks are shares of the kind's assets, from just above 0 (best) to 1. Missing scores don't count; an asset without any is not
    ranked. Unusable vectors and vectors of unknown assets are left out, a null kind is a kind of its own. Assets that repeat a hash
    count as one. Queries are handled QUERIES at a time.
    """
    rows = queries.select("id", "query", "clip_vec", "text_vec").orderBy("id").collect()
    parts = [rows[i : i + QUERIES] for i in range(0, len(rows), QUERIES)] or [[]]
    return reduce(DataFrame.unionAll, [_ranked(part, assets, vectors, weights) for part in parts])


def _ranked(rows: list, assets: DataFrame, vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    spark, n = assets.sparkSession, len(rows)
    schema = "query_id int, hash string, kind string, median_rank double, mean_rank double, scores int"
    if not n:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("position"), "hash", "kind", "median_rank", "mean_rank", "scores")
    scored = written(scores(assets, vectors, rows), "scores")
    sizes = {r["kind"]: r["n"] for r in scored.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    kinds = sorted(sizes)
    folder = scratch(spark, "ranks")
    _tables(scored, n, kinds, folder)
    ids = np.array([int(r["id"]) for r in rows], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "block"):
            head = part.filter(pa.compute.is_null(part.column("score")))
            place, hashes, kind = head.column("row").to_numpy(), head.column("hash").combine_chunks(), head.column("kind").combine_chunks()
            body = part.filter(pa.compute.is_valid(part.column("score")))
            share = np.full((BLOCK, 3 * n), np.nan)
            if body.num_rows:
                lists = body.column("rows").combine_chunks()
                score = np.repeat(body.column("score").to_numpy(), np.diff(lists.offsets.to_numpy()))
                share[lists.flatten().to_numpy(), score] = body.column("shares").combine_chunks().flatten().to_numpy()
            share = share[place].reshape(len(place), 3, n)
            median, mean = weighted_median(share, weights)
            row, q = np.nonzero(~np.isnan(median))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), hashes.take(pa.array(row)), kind.take(pa.array(row)), pa.array(median[row, q]), pa.array(mean[row, q]), pa.array((~np.isnan(share)).sum(1)[row, q].astype(np.int32))],
                names=["query_id", "hash", "kind", "median_rank", "mean_rank", "scores"],
            )

    none = {"score": "int", "rows": "array<int>", "shares": "array<double>"}
    heads = scored.select("block", "row", "hash", "kind").withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    shares = _shares(scored, n, kinds, sizes, folder).withColumns({c: F.lit(None).cast(t) for c, t in {"row": "int", "hash": "string", "kind": "string"}.items()})
    met = heads.unionByName(shares).repartition("block").sortWithinPartitions("block")
    ranked = written(met.mapInArrow(run, schema), "ranked")
    buckets = max(1, sum(sizes.values()) // TOGETHER)
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("median_rank") * buckets), F.lit(buckets)).cast("int"))
    counts = written(ranked.groupBy("query_id", "bucket").agg(F.count("*").alias("n")), "buckets")
    before = counts.select("query_id", "bucket", "n", F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = ["query_id", (F.col("before") + F.col("inner")).cast("int").alias("position"), "hash", "kind", "median_rank", "mean_rank", "scores"]
    inner = F.row_number().over(W.partitionBy("query_id", "bucket").orderBy("median_rank", "mean_rank", "hash"))
    if not counts.where(F.col("n") > CROWD).limit(1).count():
        return ranked.withColumn("inner", inner).join(before, ["query_id", "bucket"]).select(*out)
    # a crowd of equal ranks is put in order in ranges, so that no task sorts it alone
    told = ranked.join(before, ["query_id", "bucket"])
    crowd = numbered(told.where(F.col("n") > CROWD), ["query_id", "median_rank", "mean_rank", "hash"], "crowds")
    first = crowd.groupBy("query_id", "bucket").agg(F.min("_place").alias("_first"))
    crowd = crowd.join(first, ["query_id", "bucket"]).withColumn("inner", F.col("_place") - F.col("_first") + 1)
    return told.where(F.col("n") <= CROWD).withColumn("inner", inner).select(*out).unionByName(crowd.select(*out))
