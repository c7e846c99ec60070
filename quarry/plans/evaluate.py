"""Running a query set through a searcher and measuring the results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.evaluation import filters_of, metrics, summary

from .search import HybridSearcher

#: Embeds a query for both spaces: (clip vector or None, text vector or None).
Embed = Callable[[str], tuple[Sequence[float] | None, Sequence[float] | None]]
DEEP = 10


def run(searcher: HybridSearcher, queries: DataFrame, judgments: DataFrame, embed: Embed, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, metrics, summary) of a query set (id, query, filters as JSON or null): the ten best rows of each query, ranked; the
    filters of a query are honoured. A query set is small: its plans are built one by one and run as one union."""
    parts = []
    for q in queries.orderBy("id").collect():
        clip, text = embed(q["query"])
        found = searcher.search(q["query"], filters_of(q["filters"] if "filters" in q.asDict() else None), DEEP, clip, text).results
        rank = F.row_number().over(W.orderBy(F.desc("score"), "folder", "filename", "hash"))  # ten rows
        parts.append(found.select(F.lit(q["query"]).alias("query"), rank.alias("rank"), "hash", "filename", "kind", "score", "confidence", "best_match.source", "best_match.ref", "best_match.label"))
    if not parts:
        raise ValueError("the query set is empty")
    results = reduce(DataFrame.unionAll, parts)
    per = metrics(results.select("query", "rank", "hash"), judgments, k)
    return results, per, summary(per)
