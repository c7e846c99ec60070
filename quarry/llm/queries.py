"""The queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ship
from quarry.tables import table

from .bpe import token_ids
from .clusters import Groups
from .leakage import leaks
from .neighbours import close_pairs, neighbours
from .ranking import ranking
from .repetition import repetition
from .scans import Scans
from .split import oversized_pages, split_pages
from .truncation import cut_share, truncated


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every page of every body in pieces of at most 900 characters."""
    return split_pages(table(spark, d, "assets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The pages that are too long for one piece."""
    return oversized_pages(split_pages(table(spark, d, "assets")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of scan noise each body shows."""
    return Scans(table(spark, d, "assets")).defects()


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every PDF body as continuous paragraphs."""
    return Scans(table(spark, d, "assets")).texts()


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels taken from PDF bodies, put right."""
    return Scans(table(spark, d, "assets")).labels(table(spark, d, "vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Assets whose body was cut."""
    return truncated(table(spark, d, "assets"), table(spark, d, "files")).where("cut").select("hash")


def p3_sources(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut bodies per source."""
    return cut_share(truncated(table(spark, d, "assets"), table(spark, d, "files")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Close pairs among the nearest neighbours."""
    return close_pairs(neighbours(table(spark, d, "vectors")))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar rows of every usable row."""
    return neighbours(table(spark, d, "vectors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring members, by id, of every group of clip rows."""
    return Groups(table(spark, d, "vectors"), table(spark, d, "assets")).pairs()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every group with its size, most typical members and most frequent tags."""
    return Groups(table(spark, d, "vectors"), table(spark, d, "assets")).described()


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    """One ranking of all assets for every evaluation query."""
    return ranking(table(spark, d, "eval_queries"), table(spark, d, "assets"), table(spark, d, "vectors"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_queries")).select("doc_id", F.col("item_id").cast("long").alias("item_id"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The same with the share found and the spans to remove."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_queries"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 0.3 of their words repeated."""
    return repetition(table(spark, d, "documents"), every=False).where("repeated").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated content of every document."""
    return repetition(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_pieces, p2_found, p2_texts, p2_labels, p3_found, p3_sources, p4_found, p4_neighbours, p5_found, p5_groups, p6_ranking, p8_ids, p9_found, p9_leaks, p10_found, p10_shares]

    def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: (ship(spark), f(spark, d))[1]

    return {f.__name__: shipped(f) for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            SELECT hash, ref FROM (
                SELECT hash, unnest(string_split(body, chr(12))) AS page, generate_subscripts(string_split(body, chr(12)), 1)::BIGINT AS ref
                FROM assets WHERE body IS NOT NULL)
            WHERE length(trim(regexp_replace(page, '[ \t\r\n]+', ' ', 'g'), ' ')) > 900
        """,
    }
