"""Fusing the signals into one score, and telling where an asset matched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import confidence, relevance

# The weight of the visual and the semantic signal by kind, of keywords, and what naming a kind gives or takes.
WEIGHTS = {"image": (0.60, 0.40), "video": (0.55, 0.45), "pdf": (0.25, 0.75)}
OTHER = (0.5, 0.5)
KEYWORD, BOOST, PENALTY = 0.35, 1.5, 0.5
SPEECH = 0.45


_MATCH = "struct<id:long,source:string,ref:double,thumb:string,label:string>"


def fused(found: DataFrame, near: DataFrame | None, keyword: DataFrame | None, intent: str | None = None) -> DataFrame:
    """``found`` with the signals joined and scored. ``near``: (hash, and visual, semantic or both, each with z and match) as ``signals`` gives;
    ``keyword``: (hash, keyword).

    An asset without any signal is dropped. With only one of visual and semantic that one has weight 1. Signals that failed are None, or
    missing among the columns.
    """
    rows = found if near is None else found.join(near, "hash", "left")
    for name in ("visual", "semantic"):
        if near is None or name not in near.columns:
            rows = rows.selectExpr("*", f"cast(null AS double) AS {name}", f"cast(null AS double) AS z_{name}", f"cast(null AS {_MATCH}) AS {name}_match")
    rows = rows.selectExpr("*", "cast(null AS double) AS keyword") if keyword is None else rows.join(keyword.select("hash", "keyword"), "hash", "left")
    kinds = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN {w[i]}D" for k, w in WEIGHTS.items()) + f" ELSE {OTHER[i]}D END"
    alone = lambda own, other, i: f"CASE WHEN {own} IS NOT NULL AND {other} IS NULL THEN 1D WHEN {other} IS NOT NULL AND {own} IS NULL THEN 0D ELSE {kinds(i)} END"
    raw = f"{alone('z_visual', 'z_semantic', 0)} * coalesce(z_visual, 0D) + {alone('z_semantic', 'z_visual', 1)} * coalesce(z_semantic, 0D) + {KEYWORD}D * coalesce(keyword, 0D)"
    if intent:
        raw += f" + CASE WHEN kind = '{intent}' THEN {BOOST}D ELSE -{PENALTY}D END"
    rows = rows.where("coalesce(z_visual, z_semantic, keyword) IS NOT NULL").selectExpr("*", f"{raw} AS raw_score")
    return rows.select("*", F.round("raw_score", 3).alias("score"), relevance(F.col("raw_score")).alias("relevance"), confidence(F.round("raw_score", 3)).alias("confidence"))


def explained(rows: DataFrame) -> DataFrame:
    """``rows`` with ``best_match``: the text match for PDFs, for good speech and where nothing visual matched; else the visual one."""
    v, s = F.col("visual_match"), F.col("semantic_match")
    text = s.isNotNull() & (v.isNull() | (F.col("kind") == "pdf") | ((s["source"] == "transcript") & (F.col("semantic") > SPEECH)))
    return rows.withColumn("best_match", F.when(text, s).otherwise(v))


def top(rows: DataFrame, top_k: int = 24) -> DataFrame:
    """The best assets by rounded score; ties by folder and filename."""
    return rows.orderBy(F.desc("score"), "folder", "filename", "hash").limit(top_k)
