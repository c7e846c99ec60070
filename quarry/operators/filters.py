"""Which assets a search may return: metadata filters over present files of finished assets, with a representative file for each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import orientation

MB = 1024.0 * 1024.0


@dataclass(frozen=True)
class Filters:
    """None, and '' where text comes from a form, mean no filter; 0 is a real bound of a size."""

    kinds: tuple[str, ...] = ()
    min_mb: float | str | None = None
    max_mb: float | str | None = None
    folder: str | None = None
    ext: str | None = None
    modified_after: float | None = None
    orientation: str | None = None
    max_duration: float | str | None = None
    has_speech: bool = False

    @classmethod
    def modified_within(cls, days: float, now: float, **more) -> Filters:
        """Files modified in the last ``days`` (a form offers 1, 7 and 30)."""
        return cls(modified_after=now - 86_400 * days, **more)

    def predicates(self) -> list[Column]:
        """Conditions on the joined columns of files and assets (``asset_kind``, ``meta``)."""
        f, out = F.col, []
        if self.kinds:
            out.append(f("asset_kind").isin(*self.kinds))
        if self.min_mb not in (None, ""):
            out.append(f("size") >= float(self.min_mb) * MB)
        if self.max_mb not in (None, ""):
            out.append(f("size") <= float(self.max_mb) * MB)
        if self.folder:
            out.append(folder_like(f("folder"), self.folder))
        if self.ext:
            out.append(f("ext") == "." + self.ext.lower().lstrip("."))
        if self.modified_after:
            out.append(f("mtime") >= float(self.modified_after))
        if self.orientation:
            shown = orientation(f("meta.width"), f("meta.height")) == self.orientation
            out.append(F.when(f("asset_kind").isin("image", "video"), shown).otherwise(True))
        if self.max_duration not in (None, ""):
            short = F.coalesce(f("meta.duration"), F.lit(0.0)) <= float(self.max_duration)
            out.append(F.when(f("asset_kind") == "video", short).otherwise(True))
        if self.has_speech:
            out.append(F.when(f("asset_kind") == "video", F.coalesce(f("meta.has_speech"), F.lit(False))).otherwise(True))
        return out


def folder_like(folder: Column, part: str) -> Column:
    """Substring match where only ASCII letters ignore case and % and _ of ``part`` are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = part.translate(str.maketrans(upper, lower)).replace("!", "!!")
    return F.like(F.translate(folder, upper, lower), F.lit(f"%{text}%"), F.lit("!"))


def located(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Finished assets with each of their present files, one row a file; the asset's columns kind, size, thumb are prefixed."""
    a = assets.where(F.col("status") == "done").select("hash", F.col("kind").alias("asset_kind"), "caption", "tags", "meta", "thumb", "warnings")
    f = files.where(F.col("present") & F.col("hash").isNotNull()).select(F.col("id").alias("file_id"), "hash", "path", "filename", "folder", "ext", "size", "mtime")
    return f.join(a, "hash")


def allowed(assets: DataFrame, files: DataFrame, filters: Filters | None = None) -> DataFrame:
    """One row per asset that passes: its columns, those of its first file by (folder, filename, id), and ``duplicates``: id and path of
    the other files that pass. Files of one asset come together in one aggregation buffer: copies of a single content, not of a key."""
    rows = located(assets, files)
    for p in (filters or Filters()).predicates():
        rows = rows.where(p)
    place = F.struct("folder", "filename", "file_id", "path", "ext", "size", "mtime")
    info = F.first(F.struct(F.col("asset_kind").alias("kind"), "caption", "tags", "meta", "thumb", "warnings"))
    first = rows.groupBy("hash").agg(info.alias("a"), F.min(place).alias("f"), F.sort_array(F.collect_list(F.struct("folder", "filename", "file_id", "path"))).alias("all"))
    others = "transform(slice(all, 2, greatest(size(all), 1)), x -> struct(x.file_id AS file_id, x.path AS path)) AS duplicates"
    return first.selectExpr("hash", *[f"a.{c}" for c in ("kind", "caption", "tags", "meta", "thumb", "warnings")], *[f"f.{c}" for c in ("file_id", "path", "filename", "folder", "ext", "size", "mtime")], others)


def browse(found: DataFrame, top_k: int = 24) -> DataFrame:
    """The newest assets first; ties by folder and filename."""
    return found.orderBy(F.desc("mtime"), "folder", "filename", "hash").limit(top_k)
