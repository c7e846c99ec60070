"""Grouped statistics of the catalogue, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import with_present_file

_present = lambda files: files.where(F.col("present"))


def by_kind(files: DataFrame) -> DataFrame:
    """(kind, files, bytes, unique_assets) of present readable files."""
    return _present(files).where("file_status = 'ok'").groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("hash").alias("unique_assets"))


def totals(files: DataFrame) -> DataFrame:
    """``by_kind`` with a last row of grand totals, whose kind is null and ``all`` true."""
    rows = _present(files).where("file_status = 'ok'")
    return rows.rollup("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), (F.grouping("kind") == 1).alias("is_total"))


def duplicate_files(files: DataFrame) -> DataFrame:
    """One row: present files beyond the first of each content."""
    per = _present(files).where("hash is not null").groupBy("hash").agg(F.count("*").alias("c")).where("c > 1")
    return per.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_files"))


def skipped_by_status(files: DataFrame, *more: str) -> DataFrame:
    """(file_status, ..., n, bytes) of present files that aren't read."""
    return _present(files).where("file_status <> 'ok'").groupBy("file_status", *more).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def vector_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("space", "source").agg(F.count("*").alias("n"))


def timing(assets: DataFrame) -> DataFrame:
    """(kind, n, avg_ms, total_ms) of finished assets."""
    return assets.where("status = 'done'").groupBy("kind").agg(F.count("*").alias("n"), F.avg("process_ms").alias("avg_ms"), F.sum("process_ms").alias("total_ms"))


def status_by_kind(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, status, n, ms) of assets with a present file."""
    return with_present_file(assets, files).groupBy("kind", "status").agg(F.count("*").alias("n"), F.round(F.avg("process_ms")).alias("ms"))


def status_counts(assets: DataFrame, files: DataFrame) -> DataFrame:
    return with_present_file(assets, files).groupBy("status").agg(F.count("*").alias("n"))


def media_totals(assets: DataFrame) -> DataFrame:
    """One row: videos, their seconds, frames and how many speak; pages of PDFs. Finished assets."""
    video, pdf = F.col("kind") == "video", F.col("kind") == "pdf"
    return assets.where("status = 'done'").agg(
        F.count_if(video).alias("videos"), F.sum(F.when(video, F.col("meta.duration"))).alias("seconds"), F.sum(F.when(video, F.col("meta.frames_sampled"))).alias("frames"),
        F.sum(F.when(video, F.col("meta.has_speech").cast("long"))).alias("with_speech"), F.sum(F.when(pdf, F.col("meta.pages"))).alias("pages"),
    )


def first_path(files: DataFrame) -> DataFrame:
    """(hash, path) of each content's file with the smallest id."""
    return files.where("hash is not null").groupBy("hash").agg(F.min(F.struct("id", "path")).alias("f")).select("hash", "f.path")


def failures(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(hash, kind, error, attempts, processed_at, path) of failed assets with a present file; last processed first."""
    bad = assets.where("status = 'failed'").select("hash", "kind", "error", "attempts", "processed_at")
    return bad.join(first_path(_present(files)), "hash").orderBy(F.desc("processed_at"), "hash")


def skipped(files: DataFrame) -> DataFrame:
    return _present(files).where("file_status <> 'ok'").select("id", "path", "ext", "size", "file_status", "file_error").orderBy("path")


def warned(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(hash, kind, warnings, path) of finished assets with warnings; path null without a file."""
    rows = assets.where("status = 'done'").where(F.size("warnings") > 0).select("hash", "kind", "warnings")
    return rows.join(first_path(files), "hash", "left")


def problems(assets: DataFrame, files: DataFrame, most_warnings: int = 50) -> DataFrame:
    """(state, path, detail): failed, skipped and (the first by path) warned files in one list."""
    a = failures(assets, files).select(F.lit("failed").alias("state"), "path", F.col("error").alias("detail"))
    b = skipped(files).select(F.col("file_status").alias("state"), "path", F.col("file_error").alias("detail"))
    c = warned(assets, files).select(F.lit("warning").alias("state"), "path", F.array_join("warnings", "; ").alias("detail")).orderBy("path", "detail").limit(most_warnings)
    return a.unionByName(b).unionByName(c)


def folders(files: DataFrame) -> DataFrame:
    return _present(files).select("folder").distinct().orderBy("folder")


def markdown_table(rows: DataFrame) -> list[str]:
    """A few rows as lines of a Markdown table, headed by their column names; nulls are empty."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return lines + ["| " + " | ".join("" if x is None else str(x).replace("|", "/") for x in r) + " |" for r in rows.toLocalIterator()]


def dataset_markdown(files: DataFrame, assets: DataFrame) -> str:
    """The dataset report as Markdown, made from a few aggregated rows whose columns are formatted by Spark."""
    from quarry.functions.scalar import bytes_text

    shown = bytes_text(F.coalesce(F.col("bytes"), F.lit(0)).cast("double")).alias("Size")
    kinds = by_kind(files).orderBy("kind").select(F.col("kind").alias("Type"), F.col("files").alias("Files"), F.col("unique_assets").alias("Unique"), shown)
    whole = totals(files).where("is_total").select(F.lit("all").alias("Type"), F.col("files").alias("Files"), F.lit(None).cast("long").alias("Unique"), shown)
    left = skipped_by_status(files, "ext").orderBy("file_status", "ext").select(F.col("file_status").alias("Reason"), F.coalesce(F.nullif("ext", F.lit("")), F.lit("(no ending)")).alias("Ending"), F.col("n").alias("Files"))
    seconds = F.format_string("%.1f s", F.coalesce("ms", F.lit(0.0)) / 1000).alias("Mean time")
    times = status_by_kind(assets, files).orderBy("kind", "status").select(F.col("kind").alias("Type"), F.col("status").alias("Status"), F.col("n").alias("Assets"), seconds)
    zero = lambda c: F.coalesce(c, F.lit(0))
    media = media_totals(assets).select(
        F.col("videos").alias("Videos"), F.round(zero(F.col("seconds")) / 60).cast("long").alias("Minutes"), zero(F.col("frames")).alias("Frames"),
        zero(F.col("with_speech")).alias("With speech"), zero(F.col("pages")).alias("PDF pages"),
    )
    parts = [["# Dataset summary"], [*markdown_table(kinds), *markdown_table(whole)[2:]], markdown_table(times), markdown_table(media)]
    skipped_lines = markdown_table(left)
    if len(skipped_lines) > 2:
        parts.insert(2, ["Skipped files:", "", *skipped_lines])
    return "\n\n".join("\n".join(p) for p in parts) + "\n"


def write_manifest(files: DataFrame, sources: DataFrame, path: str) -> None:
    """A CSV of (file, type, source, query, url, license) for the files of ``sources`` that are present."""
    here = _present(files).select(F.col("path").alias("file"), F.col("kind").alias("type"))
    here.join(sources, "file").select("file", "type", "source", "query", "url", "license").write.mode("overwrite").csv(path, header=True)
