"""``python -m quarry``: stats, failures, search and eval-export over a folder of catalogue tables."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quarry.operators import evaluation, reports
from quarry.operators.filters import Filters
from quarry.plans import evaluate
from quarry.plans.search import HybridSearcher
from quarry.session import clean, get_session, ship
from quarry.tables import table


def _searcher(spark, d: str) -> HybridSearcher:
    return HybridSearcher(table(spark, d, "assets"), table(spark, d, "files"), table(spark, d, "vectors"))


def _embedder(spark, d: str):
    """Vectors of known queries; others are searched by keywords alone."""
    known = {r["query"]: (r["clip_vec"], r["text_vec"]) for r in table(spark, d, "eval_queries").select("query", "clip_vec", "text_vec").collect()}
    return lambda q: known.get(q, (None, None))


def main(args: list[str], spark=None, out=print) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("--tables", required=True, help="folder of the catalogue's Parquet tables")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("stats")
    commands.add_parser("failures")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--kinds", default="")
    search.add_argument("--folder")
    search.add_argument("--ext")
    search.add_argument("--min-mb", type=float)
    search.add_argument("--max-mb", type=float)
    search.add_argument("--orientation", choices=["landscape", "portrait", "square"])
    search.add_argument("--max-duration", type=float)
    search.add_argument("--has-speech", action="store_true")
    search.add_argument("--modified-after", type=float)
    export = commands.add_parser("eval-export")
    export.add_argument("--out", required=True)
    export.add_argument("--ids", default="", help="ids of queries, parted by commas; all if empty")
    given = parser.parse_args(args)
    spark = spark or get_session()
    ship(spark)
    d = given.tables
    if given.command == "stats":
        out(reports.dataset_markdown(table(spark, d, "files"), table(spark, d, "assets")))
    elif given.command == "failures":
        for r in reports.problems(table(spark, d, "assets"), table(spark, d, "files")).toLocalIterator():
            out(f"{r['state']}\t{r['path']}\t{r['detail'] or ''}")
    elif given.command == "search":
        filters = Filters(tuple(k for k in given.kinds.split(",") if k), given.min_mb, given.max_mb, given.folder, given.ext, given.modified_after, given.orientation, given.max_duration, given.has_speech)
        clip, text = _embedder(spark, d)(given.query)
        answer = _searcher(spark, d).search(given.query, filters, given.top_k, clip, text)
        for w in answer.warnings:
            out(f"warning: {w.splitlines()[0]}")
        for r in answer.results.collect():
            out(json.dumps({k: r[k] for k in ("score", "confidence", "kind", "path", "caption") if k in r.asDict()}, ensure_ascii=False))
    else:
        queries = table(spark, d, "eval_queries").selectExpr("id", "query", "intent", "expected", "cast(null as string) as filters")
        if given.ids:
            queries = queries.where(queries.id.isin(*[int(i) for i in given.ids.split(",")]))
        judgments = table(spark, d, "judgments")
        results, per, _ = evaluate.run(_searcher(spark, d), queries, judgments, _embedder(spark, d))
        folder = Path(given.out).resolve()
        text = evaluation.export(results, judgments, per, folder.as_uri(), queries=queries)
        (folder / "RESULTS.md").write_text(text, encoding="utf-8")
        out(text)
    return 0


if __name__ == "__main__":
    code = main(sys.argv[1:])
    clean(get_session())
    sys.exit(code)
