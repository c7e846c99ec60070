"""The catalogue's state changes as plans from one snapshot to the next. None of them writes; ``quarry.operators.versions`` does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalar import kind_for_ext, spoken_filename
from quarry.session import numbered

ATTEMPTS = 3
BODY, ERROR = 20_000, 2_000
MAX_FILE_MB = 2048
#: Sizes equal and times within this: a file that wasn't touched.
SAME_TIME = 1e-3


def newest_sightings(listing: DataFrame) -> DataFrame:
    """One row per path: the sighting with the greatest ``listed_at``; of several, the greatest mtime, then size. Null paths are left out.
    One partial aggregation, so repeated sightings of one path never meet in one task unreduced."""
    others = [c for c in listing.columns if c not in ("path", "listed_at", "mtime", "size")]
    best = listing.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct("listed_at", "mtime", "size", *others)).alias("s"))
    return best.select("path", *[F.col(f"s.{c}").alias(c) for c in listing.columns if c != "path"])


def file_status(kind: Column, size: Column, readable: Column, max_mb: float = MAX_FILE_MB) -> Column:
    """ok, or why a file isn't read: unsupported, unreadable (empty, or its content can't be read) or too_large, in this order."""
    return (
        F.when(kind.isNull(), "unsupported").when(size == 0, "unreadable").when(size > max_mb * 1024 * 1024, "too_large").when(~readable, "unreadable").otherwise("ok")
    )


def file_error(status: Column, ext: Column, size: Column, max_mb: float = MAX_FILE_MB) -> Column:
    return (
        F.when(status == "unsupported", F.concat(F.lit("unsupported file type '"), F.when(F.coalesce(ext, F.lit("")) == "", "(none)").otherwise(ext), F.lit("'")))
        .when((status == "unreadable") & (size == 0), "empty file (0 bytes)")
        .when(status == "unreadable", "cannot read file")
        .when(status == "too_large", f"larger than MAX_FILE_MB={max_mb:g}")
    )


def unchanged(size: Column, mtime: Column, old_size: Column, old_mtime: Column, old_hash: Column, old_status: Column) -> Column:
    """Same size, same time, and nothing left to do."""
    return F.coalesce((size == old_size) & (F.abs(mtime - old_mtime) < SAME_TIME) & (old_hash.isNotNull() | (old_status != "ok")), F.lit(False))


def scan_diff(listing: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """(path, change, ...) of every path seen now or known: new, changed, unchanged, missing (known as present under ``root``, not seen)
    or gone (known as absent, or outside the root). Columns of the sighting and, as ``old_``, of the stored row."""
    new = newest_sightings(listing).select("path", "folder", "filename", "ext", "size", "mtime", F.lit(True).alias("seen"))
    old = files.select("path", *[F.col(c).alias(f"old_{c}") for c in files.columns if c != "path"])
    rows = new.join(old, "path", "full_outer")
    under = F.lit(True) if root is None else (F.col("path") == root.rstrip("/")) | F.col("path").startswith(root.rstrip("/") + "/")
    same = unchanged(F.col("size"), F.col("mtime"), F.col("old_size"), F.col("old_mtime"), F.col("old_hash"), F.col("old_file_status"))
    change = (
        F.when(F.col("seen") & F.col("old_id").isNull(), "new")
        .when(F.col("seen") & same, "unchanged")
        .when(F.col("seen"), "changed")
        .when(F.col("old_present") & under, "missing")
        .otherwise("gone")
    )
    return rows.withColumn("change", change)


def scan_counters(diff: DataFrame, hashes: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """One row of counters of a scan; with the ``hashes`` (path, content_hash) of touched files and the ``assets`` known before, also how many of
    these files are ``duplicates``: copies of a known content or of another of them."""
    c = F.col("change")
    kind = kind_for_ext(F.col("ext"))
    touched = c.isin("new", "changed")
    counted = diff.agg(
        F.count_if(c.isin("new", "changed", "unchanged")).alias("seen"), F.count_if(c == "new").alias("new"), F.count_if(c == "changed").alias("changed"),
        F.count_if(c == "unchanged").alias("unchanged"), F.count_if(c == "missing").alias("missing"),
        F.count_if((touched & kind.isNull()) | ((c == "unchanged") & (F.col("old_file_status") == "unsupported"))).alias("unsupported"),
        F.count_if(touched & kind.isNotNull() & ((F.col("size") == 0) | (F.col("size") > MAX_FILE_MB * 1024 * 1024))).alias("errors"),
    )
    if hashes is None:
        return counted
    fresh = hashes.select(F.col("content_hash").alias("hash")).distinct()
    fresh = fresh if assets is None else fresh.join(assets.select("hash"), "hash", "left_anti")
    both = hashes.agg(F.count("*").alias("_all")).crossJoin(F.broadcast(fresh.agg(F.count("*").alias("_new"))))  # one row each
    return counted.crossJoin(F.broadcast(both.select((F.col("_all") - F.col("_new")).alias("duplicates"))))


def next_files(diff: DataFrame, hashes: DataFrame, now: float) -> DataFrame:
    """The next snapshot of ``files``. ``hashes``: (path, content_hash) of touched files that could be read.

    A known path keeps its id and first_seen; a new one gets the next ids in order of path. Missing files become absent, unchanged
    ones are touched.
    """
    rows = diff.join(hashes, "path", "left")
    touched = F.col("change").isin("new", "changed")
    kind = kind_for_ext(F.col("ext"))
    status = file_status(kind, F.col("size"), F.col("content_hash").isNotNull())
    pick = lambda new, old: F.when(touched, new).otherwise(F.col(old))
    out = rows.select(
        F.col("old_id").alias("id"), "path", F.coalesce("old_folder", "folder").alias("folder"), F.coalesce("old_filename", "filename").alias("filename"), F.coalesce("old_ext", "ext").alias("ext"),
        pick(kind, "old_kind").alias("kind"), pick(F.col("size"), "old_size").alias("size"), pick(F.col("mtime"), "old_mtime").alias("mtime"),
        pick(F.when(status == "ok", F.col("content_hash")), "old_hash").alias("hash"), pick(status, "old_file_status").alias("file_status"),
        pick(file_error(status, F.col("ext"), F.col("size")), "old_file_error").alias("file_error"),
        F.when(F.col("change").isin("new", "changed", "unchanged"), True).when(F.col("change") == "missing", False).otherwise(F.col("old_present")).alias("present"),
        F.coalesce("old_first_seen", F.lit(now)).alias("first_seen"), F.when(F.col("change").isin("missing", "gone"), F.col("old_last_seen")).otherwise(now).alias("last_seen"),
    )
    known, fresh = out.where("id is not null"), out.where("id is null").drop("id")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # ids of new paths: places in the order of path, without one task that numbers them all
    given = numbered(fresh, ["path"], "new-paths").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_place") + 1)
    return known.unionByName(given.select(*known.columns))


def new_assets(files: DataFrame, assets: DataFrame) -> DataFrame:
    """(hash, kind, size) of contents the catalogue hasn't met; kind and size are those of the file with the smallest id."""
    first = files.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min(F.struct("id", "kind", "size")).alias("f"))
    return first.join(assets.select("hash"), "hash", "left_anti").select("hash", "f.kind", "f.size")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns in ``keep`` stay as they were. Keys are unique on each side."""
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in key], F.lit(True).alias("_new"))
    rows = old.withColumn("_old", F.lit(True)).join(n, list(key), "full_outer")
    value = lambda c: F.when(F.col("_new") & ~(F.coalesce("_old", F.lit(False)) & F.lit(c in keep)), F.col(f"_{c}")).otherwise(F.col(c))
    return rows.select(*[F.col(c) if c in key or c not in new.columns else value(c).alias(c) for c in old.columns])


def missing_sweep(files: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """(id, path) of present files under ``root`` whose path isn't among ``seen``."""
    under = (F.col("path") == root.rstrip("/")) | F.col("path").startswith(root.rstrip("/") + "/")
    return files.where(F.col("present") & under).join(seen.select("path").distinct(), "path", "left_anti").select("id", "path")


def with_present_file(assets: DataFrame, files: DataFrame) -> DataFrame:
    return assets.join(files.where(F.col("present")).select("hash"), "hash", "left_semi")


def unfinished(signature: str, attempts: int = ATTEMPTS) -> Column:
    """Assets that a run still has to process: waiting, interrupted, failed with attempts left, or made under another signature."""
    s = F.col("status")
    return s.isin("pending", "processing") | ((s == "failed") & (F.col("attempts") < attempts)) | ((s == "done") & ~F.col("model_sig").eqNullSafe(F.lit(signature)))


def pending_queue(assets: DataFrame, files: DataFrame, signature: str) -> DataFrame:
    """(hash, kind, size, place) of unfinished assets with a present file, in working order: images, PDFs, videos, others; small first."""
    place = F.when(F.col("kind") == "image", 0).when(F.col("kind") == "pdf", 1).when(F.col("kind") == "video", 2).otherwise(9)
    return with_present_file(assets, files).where(unfinished(signature)).select("hash", "kind", "size", place.alias("place")).orderBy("place", "size", "hash")


def recovered(assets: DataFrame) -> DataFrame:
    """After a crash: what was processing waits again."""
    return assets.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def started(assets: DataFrame, hashes: DataFrame) -> DataFrame:
    """An attempt begins for some assets."""
    now = hashes.select("hash").distinct().withColumn("_now", F.lit(True))
    rows = assets.join(now, "hash", "left")
    return rows.withColumns({"status": F.when(F.col("_now"), "processing").otherwise(F.col("status")), "attempts": F.when(F.col("_now"), F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts"))}).drop("_now")


def finished(assets: DataFrame, results: DataFrame, signature: str) -> DataFrame:
    """Outcomes put in: (hash, caption, tags, body, meta, warnings, thumb, processed_at, process_ms, error, lasting). An error fails the
    asset, one that is ``lasting`` for good (attempts at the limit); texts are cut to their limits."""
    columns = ["caption", "tags", "body", "meta", "warnings", "thumb", "processed_at", "process_ms"]
    r = results.select("hash", *[F.col(c).alias(f"_{c}") for c in columns], F.col("error").alias("_error"), F.col("lasting").alias("_lasting"), F.lit(True).alias("_got"))
    rows = assets.join(r, "hash", "left")
    done, bad = F.coalesce(F.col("_got") & F.col("_error").isNull(), F.lit(False)), F.coalesce(F.col("_got") & F.col("_error").isNotNull(), F.lit(False))
    new = {c: F.when(done, F.substring("_body", 1, BODY) if c == "body" else F.col(f"_{c}")).when(bad & F.lit(c == "processed_at"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    new |= {
        "status": F.when(done, "done").when(bad, "failed").otherwise(F.col("status")),
        "error": F.when(done, F.lit(None).cast("string")).when(bad, F.substring("_error", 1, ERROR)).otherwise(F.col("error")),
        "attempts": F.when(bad & F.coalesce("_lasting", F.lit(False)), ATTEMPTS).otherwise(F.col("attempts")),
        "model_sig": F.when(done, signature).otherwise(F.col("model_sig")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in assets.columns])


def retried(assets: DataFrame) -> DataFrame:
    """Every failed asset waits again with all its attempts, corrupt ones too."""
    bad = F.col("status") == "failed"
    return assets.withColumns({"attempts": F.when(bad, 0).otherwise(F.col("attempts")), "status": F.when(bad, "pending").otherwise(F.col("status"))})


def search_texts(files: DataFrame) -> DataFrame:
    """(hash, filenames): the names of an asset's present files as words, by id."""
    rows = files.where(F.col("present") & F.col("hash").isNotNull())
    names = F.sort_array(F.collect_list(F.struct("id", spoken_filename(F.col("filename")).alias("w"))))
    return rows.groupBy("hash").agg(names.alias("n")).select("hash", F.array_join("n.w", " ").alias("filenames"))


def replaced_vectors(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """All vectors of the assets of ``fresh`` replaced by those in it."""
    return vectors.join(fresh.select("hash").distinct(), "hash", "left_anti").unionByName(fresh)


def latest_job(jobs: DataFrame) -> DataFrame:
    """The job with the greatest id."""
    return jobs.orderBy(F.desc("id")).limit(1)


def judged(judgments: DataFrame, changes: DataFrame) -> DataFrame:
    """Judgments with changes (query, hash, relevant, at) put in: the newest per key counts, a null takes the judgment away."""
    last = changes.groupBy("query", "hash").agg(F.max(F.struct("at", "relevant")).alias("c")).select("query", "hash", F.col("c.relevant").alias("_r"), F.lit(True).alias("_c"))
    rows = judgments.join(last, ["query", "hash"], "full_outer")
    value = F.when(F.col("_c"), F.when(F.col("_r").isNull(), None).when(F.col("_r") != 0, 1).otherwise(0)).otherwise(F.col("relevant"))
    return rows.select("query", "hash", value.cast("int").alias("relevant")).where("relevant is not null")


def put_values(meta: DataFrame, values: dict[str, str], spark: SparkSession) -> DataFrame:
    """Key and value pairs put in."""
    return upserted(meta, spark.createDataFrame(list(values.items()) or [("", "")], "key string, value string").where("key <> ''"), ["key"])
