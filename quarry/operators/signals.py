"""Similarity signals: the best cosine of every asset with a query, and their standardisation over the whole collection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import dot, vector, vector_sql

#: Rows of ``vectors`` a match tells about.
MATCH = ("source", "ref", "thumb", "label")


def finished_vectors(vectors: DataFrame, assets: DataFrame, *spaces: str) -> DataFrame:
    """Vectors of these spaces whose asset is done, whether a file of it is present or not."""
    return vectors.where(F.col("space").isin(*spaces)).join(assets.where(F.col("status") == "done").select("hash"), "hash", "left_semi")


def best_per_asset(rows: DataFrame, query: Sequence[float]) -> DataFrame:
    """(hash, score, match) of every asset of ``rows`` (from ``finished_vectors``).

    The score is the greatest inner product with the query; if the asset has a ``pdf_summary`` vector (the newest counts), the mean of
    that and the summary's. The match is the row of the greatest product; of equal ones the lowest id. Rows of another length than the
    query, and products that aren't numbers, are left out. Everything is in one partial aggregation: what is shuffled is one row per
    asset and partition.
    """
    scored = rows.where(F.size("vec") == len(query)).withColumn("sim", dot(F.col("vec"), vector(query))).where(~F.isnan("sim"))
    best = F.max(F.struct("sim", (-F.col("id")).alias("n"), *MATCH))
    summary = F.max(F.when(F.col("source") == "pdf_summary", F.struct("id", "sim")))
    out = scored.groupBy("hash").agg(best.alias("b"), summary.alias("s"))
    score = F.when(F.col("s").isNotNull(), 0.5 * F.col("b.sim") + 0.5 * F.col("s.sim")).otherwise(F.col("b.sim"))
    return out.select("hash", score.alias("score"), F.struct((-F.col("b.n")).alias("id"), *[F.col(f"b.{c}").alias(c) for c in MATCH]).alias("match"))


def signals(rows: DataFrame, asked: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """(hash, then for each name asked: the score, ``z_`` its standardisation and ``_match``) from one pass over ``rows``, finished vectors of
    all spaces. ``asked`` gives the space and the query vector of each name; scores and matches are those of ``best_per_asset``, z those of
    ``zscored``. An asset without a usable vector in a space has nulls there."""
    names = list(asked)
    sims = {n: f"CASE WHEN space = '{s}' AND size(vec) = {len(v)} THEN aggregate(zip_with(vec, {vector_sql(v)}, (x, y) -> cast(x AS double) * y), 0D, (s, x) -> s + x) END" for n, (s, v) in asked.items()}
    scored = rows.where(F.col("space").isin(*{s for s, _ in asked.values()})).selectExpr("hash", "id", *MATCH, *[f"{x} AS sim_{n}" for n, x in sims.items()])
    match = ", ".join(MATCH)
    real = lambda n: f"sim_{n} IS NOT NULL AND NOT isnan(sim_{n})"
    best = [F.expr(f"max(CASE WHEN {real(n)} THEN struct(sim_{n} AS sim, -id AS n, {match}) END)").alias(f"b_{n}") for n in names]
    summary = [F.expr(f"max(CASE WHEN {real(n)} AND source = 'pdf_summary' THEN struct(id, sim_{n} AS sim) END)").alias(f"s_{n}") for n in names]
    found = scored.groupBy("hash").agg(*best, *summary).where(" OR ".join(f"b_{n} IS NOT NULL" for n in names))
    each = [x for n in names for x in (f"CASE WHEN s_{n} IS NOT NULL THEN 0.5D * b_{n}.sim + 0.5D * s_{n}.sim ELSE b_{n}.sim END AS {n}", f"CASE WHEN b_{n} IS NOT NULL THEN struct(-b_{n}.n AS id, {', '.join(f'b_{n}.{c} AS {c}' for c in MATCH)}) END AS {n}_match")]
    found = found.selectExpr("hash", *each)
    stats = found.selectExpr(*[x for n in names for x in (f"avg({n}) AS mu_{n}", f"stddev_pop({n}) AS sd_{n}")])
    z = [f"({n} - mu_{n}) / CASE WHEN sd_{n} > 1e-6 THEN sd_{n} ELSE 1D END AS z_{n}" for n in names]
    return found.crossJoin(F.broadcast(stats)).selectExpr("hash", *names, *z, *[f"{n}_match" for n in names])


def best_per_asset_many(rows: DataFrame, queries: list[tuple[int, Sequence[float]]]) -> DataFrame:
    """(query_id, hash, score, vec_id): ``best_per_asset`` for a block of queries at once. One product of matrices per batch, reduced to
    one row per query and asset before the shuffle."""
    width = max((len(q) for _, q in queries), default=0)
    block = [(i, q) for i, q in queries if len(q) == width]
    sent = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in block]), np.array([list(q) for _, q in block], dtype=np.float64).reshape(-1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q = sent.value
        for batch in batches:
            if not batch.num_rows or not len(numbers):
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            whole = ~np.isnan(x).any(1)
            if not whole.all():
                batch, x = batch.filter(pa.array(whole)), x[whole]
                if not batch.num_rows:
                    continue
            sims = x @ q.T
            hashes = batch.column(1).dictionary_encode()
            code, ids = hashes.indices.to_numpy(), batch.column(0).to_numpy()
            summary = np.array(batch.column(2).to_pylist(), object) == "pdf_summary"
            order = np.lexsort((ids, code))
            sims, ids, summary, code = np.where(np.isnan(sims), -np.inf, sims)[order], ids[order], summary[order], code[order]
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            best = np.maximum.reduceat(sims, start, axis=0)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(code))))
            place = np.where(sims == best[group], np.arange(len(code))[:, None], len(code))
            first = np.minimum.reduceat(place, start, axis=0)
            last_summary = np.maximum.reduceat(np.where(summary, np.arange(len(code)), -1), start)
            m, k = best.shape
            g, n = np.repeat(np.arange(m), k), np.tile(np.arange(k), m)
            has = last_summary[g] >= 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers[n].astype(np.int64)), hashes.dictionary.take(pa.array(code[start][g])), pa.array(best.ravel()), pa.array(ids[np.minimum(first.ravel(), len(ids) - 1)]),
                    pa.array(ids[last_summary[g]], mask=~has), pa.array(sims[last_summary[g], n], mask=~has),
                ],
                names=["query_id", "hash", "sim", "vec_id", "summary_id", "summary_sim"],
            )

    source = rows.where(F.size("vec") == width).select("id", "hash", "source", "vec")
    parts = source.mapInArrow(run, "query_id long, hash string, sim double, vec_id long, summary_id long, summary_sim double")
    out = parts.groupBy("query_id", "hash").agg(F.max(F.struct("sim", (-F.col("vec_id")).alias("n"))).alias("b"), F.max(F.when(F.col("summary_id").isNotNull(), F.struct("summary_id", "summary_sim"))).alias("s"))
    score = F.when(F.col("s").isNotNull(), 0.5 * F.col("b.sim") + 0.5 * F.col("s.summary_sim")).otherwise(F.col("b.sim"))
    return out.where(F.col("b.sim") > float("-inf")).select("query_id", "hash", score.alias("score"), (-F.col("b.n")).alias("vec_id"))


def zscored(signal: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``signal`` with ``z``: the score in population standard deviations from the mean, over the whole collection (of each ``by``); a
    deviation of 1e-6 or less counts as 1. The statistics, one row or one of each ``by``, are joined back; no window gathers the collection."""
    stats = [F.avg("score").alias("_mu"), F.stddev_pop("score").alias("_sd")]
    z = (F.col("score") - F.col("_mu")) / F.when(F.col("_sd") > 1e-6, F.col("_sd")).otherwise(1.0)
    joined = signal.join(signal.groupBy(*by).agg(*stats), list(by)) if by else signal.crossJoin(F.broadcast(signal.agg(*stats)))
    return joined.withColumn("z", z).drop("_mu", "_sd")
