"""Retrieval quality from ranked results and judgments."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import where_label

from .reports import markdown_table


def judged_results(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """Results (query, rank, hash, ...) with ``relevant``, null where nobody judged."""
    return results.join(judgments.select("query", "hash", "relevant"), ["query", "hash"], "left")


def metrics(results: DataFrame, judgments: DataFrame, k: int = 5, deep: int = 10) -> DataFrame:
    """(query, judged, p_at_k, mrr, hit, recall_at_10) of each query with results.

    Judged: all of the first ``k`` rows (or of fewer, if there are fewer) are judged; else the metrics are null. Precision divides by the
    rows there are. MRR looks at ``deep`` rows, 0 without a relevant one. Recall compares with all assets judged relevant for the query,
    null if there are none. Each is rounded to two places.
    """
    rows = judged_results(results.where(F.col("rank") <= deep), judgments)
    hit = F.col("relevant") == 1
    near = F.col("rank") <= k
    per = rows.groupBy("query").agg(
        F.count_if(near).alias("n"), F.count_if(near & F.col("relevant").isNotNull()).alias("known"), F.count_if(near & hit).alias("good"),
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(hit).alias("found"),
    )
    all_ = judgments.where("relevant = 1").groupBy("query").agg(F.count_distinct("hash").alias("wanted"))
    whole = (F.col("n") > 0) & (F.col("n") == F.col("known"))
    value = lambda x: F.when(whole, F.round(x, 2))
    return per.join(all_, "query", "left").select(
        "query", whole.alias("judged"), value(F.col("good") / F.col("n")).alias("p_at_k"), value(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(whole, (F.col("good") > 0).cast("int")).alias("hit"), value(F.col("found") / F.col("wanted")).alias("recall_at_10"),
    )


def summary(per_query: DataFrame) -> DataFrame:
    """One row: queries, fully judged ones, and means of the rounded metrics to three places; recall over queries that have one."""
    mean = lambda c: F.round(F.avg(c), 3)
    return per_query.agg(
        F.count("*").alias("queries"), F.count_if("judged").alias("fully_judged"), mean("p_at_k").alias("mean_p_at_k"), mean("mrr").alias("mean_mrr"), mean("hit").alias("hit_rate_at_k"), mean("recall_at_10").alias("mean_recall_at_10")
    )


def export(results: DataFrame, judgments: DataFrame, per_query: DataFrame, folder: str, k: int = 5, queries: DataFrame | None = None, notes: DataFrame | None = None) -> str:
    """Write judged results and metrics as JSON lines under ``folder``; returns a Markdown report: the summary, a table of the queries, and each
    query with its first ``k`` rows. ``results`` may carry filename, kind, score, source, ref and label; ``queries`` (query, intent,
    expected, and where known detected_type and ms) and ``notes`` (query, note) say more about a query."""
    judged = judged_results(results, judgments)
    judged.write.mode("overwrite").json(f"{folder}/results")
    per_query.write.mode("overwrite").json(f"{folder}/metrics")
    have = lambda df, name, kind: F.col(name) if df is not None and name in df.columns else F.lit(None).cast(kind)
    told = per_query
    if queries is not None:
        told = told.join(queries.select("query", *[have(queries, c, "string").alias(c) for c in ("intent", "expected", "detected_type")], have(queries, "ms", "long").alias("ms")).dropDuplicates(["query"]), "query", "left")
    if notes is not None:
        told = told.join(notes.select("query", "note").dropDuplicates(["query"]), "query", "left")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not judged"))
    table = told.orderBy("query").select(F.col("query").alias("Query"), have(told, "detected_type", "string").alias("Kind"), value("p_at_k").alias(f"P@{k}"), value("mrr").alias("MRR"), have(told, "ms", "long").alias("ms"))
    names = {"queries": "Queries", "fully_judged": "Fully judged", "mean_p_at_k": f"Mean precision@{k}", "mean_mrr": "Mean reciprocal rank", "hit_rate_at_k": f"Hit rate@{k}", "mean_recall_at_10": "Mean recall@10"}
    numbers = summary(per_query).select(F.explode(F.array(*[F.struct(F.lit(n).alias("Metric"), F.col(c).cast("string").alias("Value")) for c, n in names.items()])).alias("x")).select("x.*")
    # The marks of a judgment.
    mark = F.when(F.col("relevant") == 1, "✅").when(F.col("relevant") == 0, "❌").otherwise("–")
    place = F.concat_ws(" ", have(judged, "source", "string"), where_label(have(judged, "source", "string"), have(judged, "ref", "double"), have(judged, "kind", "string")))
    match = F.concat_ws(": ", F.nullif(F.btrim(place), F.lit("")), F.nullif(F.substring(have(judged, "label", "string"), 1, 80), F.lit("")))
    lines = judged.where(F.col("rank") <= k).orderBy("query", "rank").select(
        "query", F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("rank"), F.coalesce(have(judged, "filename", "string"), F.col("hash")), have(judged, "kind", "string"), have(judged, "score", "double"), F.translate(match, "|", "/"), mark)]).alias("line")
    )
    out = ["# Search evaluation", "", *markdown_table(numbers), "", *markdown_table(table)]
    about = {r["query"]: r.asDict() for r in told.toLocalIterator()}  # a row a query, of a set a person has judged
    last = None
    for query, line in lines.toLocalIterator():
        if query != last:
            last, said = query, about.get(query, {})
            out += ["", f"## {query}", "", *[f"{name}: {said[c]}" for c, name in (("intent", "Intent"), ("expected", "Expected"), ("note", "Note")) if said.get(c)]]
            out += ["", "| Rank | File | Kind | Score | Match | Relevant |", "|---|---|---|---|---|---|"]
        out.append(f"| {line} |")
    return "\n".join(out) + "\n"


def query_set(spark, path: str) -> DataFrame:
    """(id, query, intent, expected, filters) from a JSON array; filters as JSON text or null. A missing file gives no rows."""
    schema = "id int, query string, intent string, expected string, filters string"
    try:
        rows = spark.read.option("multiLine", True).schema(schema).json(path)
        rows.take(1)
        return rows
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def filters_of(text: str | None):
    """Search filters from the JSON of a query set."""
    from quarry.operators.filters import Filters

    given = json.loads(text or "{}")
    return Filters(**{k: tuple(v) if k == "kinds" else v for k, v in given.items()})
