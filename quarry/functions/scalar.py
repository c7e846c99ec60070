"""Scalar functions of the catalogue as Column expressions: no Python runs per row."""

from __future__ import annotations

import math
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings by kind.
IMAGE = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff")
VIDEO = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v", ".wmv")
PDF = (".pdf",)

# Words that name a kind in a query, phrases that open a query, words that no keyword search uses.
KIND_WORDS = {
    "video": r"videos?|clips?|footage|films?|recordings?|movies?",
    "image": r"images?|photos?|photographs?|pictures?|pics?|stills?",
    "pdf": r"pdfs?|brochures?|documents?|docs?|leaflets?|flyers?|catalogu?es?|reports?|booklets?",
}
OPENERS = r"show me|find|search for|look for|i want|give me|showing|containing|that contain|with|of|related to|about|any|all|some"
STOP = ("a", "an", "the", "of", "with", "and", "or", "in", "on", "to", "for", "showing", "containing", "related", "about", "show", "me", "find", "some", "any", "all", "is", "are", "that", "this", "at", "by", "from")
QUERY_TERMS = 12


def kind_for_ext(ext: Column) -> Column:
    """image, video or pdf by file ending, letter case aside; null for any other ending and for null."""
    e = F.lower(ext)
    return F.when(e.isin(*IMAGE), "image").when(e.isin(*VIDEO), "video").when(e.isin(*PDF), "pdf")


def ext_of(filename: Column) -> Column:
    """The ending of a file name with its dot, lower-case; '' where there is none (a name that is only an ending has none)."""
    return F.lower(F.regexp_extract(filename, r"[^/.](\.[^./\s]+)$", 1))


def detected_kind(query: Column) -> Column:
    """The kind a query names: the first of video, image and pdf whose words occur; else null."""
    found = None
    for kind, words in KIND_WORDS.items():
        hit = query.rlike(rf"(?iU)\b({words})\b")
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found


def cleaned_query(query: Column) -> Column:
    """The query without the words of its kind and, if it names one, without opening phrases; the query itself if nothing is left."""
    kind = detected_kind(query)
    stripped = query
    for k, words in KIND_WORDS.items():
        stripped = F.when(kind == k, F.regexp_replace(query, rf"(?iU)\b({words})\b", " ")).otherwise(stripped)
    opened = F.when(kind.isNotNull(), F.regexp_replace(stripped, rf"(?iU)^\s*(?:\b(?:{OPENERS})\b\s*)+", " ")).otherwise(stripped)
    tidy = F.btrim(F.regexp_replace(opened, r"(?U)\s+", " "), F.lit(" ,.-"))
    return F.when(tidy == "", F.regexp_replace(query, r"(?U)^\s+|\s+$", "")).otherwise(tidy)


def query_terms(query: Column) -> Column:
    """The first QUERY_TERMS keyword terms: ASCII words of two or more characters that aren't stop words; repeats stay."""
    words = F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9]+)"), 1)
    return F.slice(F.filter(words, lambda w: ~w.isin(*STOP) & (F.length(w) > 1)), 1, QUERY_TERMS)


def chunks(text: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters of the text with white space made single: cut after the last blank beyond the middle of the
    window, else at the window's end; trimmed; those of 20 characters or fewer dropped. Null gives null, blank the empty list."""
    tidy = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    pattern = rf"(?s)(.{{1,{size}}}\z|.{{{size // 2 + 1},{size - 1}}} |.{{{size}}})"
    return F.filter(F.transform(F.regexp_extract_all(tidy, F.lit(pattern), 1), lambda c: F.btrim(c)), lambda c: F.length(c) > 20)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null where the lengths differ or a side is null."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def vector_sql(values) -> str:
    """A vector as SQL text of doubles."""
    return "array(" + ", ".join(f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)}')" for x in values) + ")" if len(values) else "cast(array() AS array<double>)"


def vector(values) -> Column:
    """A vector as a literal of doubles, parsed at once instead of element by element."""
    return F.expr(vector_sql(values))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def relevance(score: Column) -> Column:
    """The unrounded score as a percentage."""
    return F.round(100 / (1 + F.exp(-1.6 * (score - 1.2))), 1)


def confidence(score: Column) -> Column:
    """high, medium or low, by the rounded score."""
    return F.when(score >= 2.0, "high").when(score >= 1.0, "medium").otherwise("low")


def orientation(width: Column, height: Column) -> Column:
    """landscape, portrait or square; a missing measure counts as 0."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    return F.when(w > h, "landscape").when(h > w, "portrait").otherwise("square")


def spoken_filename(filename: Column) -> Column:
    """A file name as words: the ending goes, _ and - become blanks."""
    return F.translate(F.regexp_replace(filename, r"\.[^.]*$", ""), "_-", "  ")


def bytes_text(n: Column) -> Column:
    """A size as text: 512 B, 1.5 KB, ... up to TB."""
    out = F.concat(F.format_string("%.1f", n / F.pow(F.lit(1024.0), 4)), F.lit(" TB"))
    for power, name in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.format_string("%.1f", n / 1024.0**power), F.lit(f" {name}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def clock(seconds: Column) -> Column:
    """Seconds as m:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)


def day_text(seconds: Column) -> Column:
    """Epoch seconds as a date, by the session's time zone; null of null."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def where_label(source: Column, ref: Column, kind: Column) -> Column:
    """Where in an asset a match lies: a time in a video, its speech, a page of a PDF; else ''."""
    return (
        F.when((source == "frame") & ref.isNotNull(), F.concat(F.lit("▶ "), clock(ref)))
        .when(source == "transcript", F.lit("🗣 speech"))
        .when((kind == "pdf") & ref.isNotNull(), F.format_string("page %d", ref.cast("long")))
        .otherwise("")
    )


def first_line(text: Column, longest: int = 120) -> Column:
    """The first line of more than three characters, trimmed and cut; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: F.length(x) > 3)
    return F.substring(F.try_element_at(lines, F.lit(1)), 1, longest)


def summary_text(title: Column, text: Column) -> Column:
    """What stands for a whole PDF: its title and the first 600 characters of its text with white space made single."""
    start = F.substring(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, 600)
    return F.btrim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), start), F.lit(". "))


def joined_caption(title: Column, first: Column) -> Column:
    """``title — first``, or the one that isn't empty."""
    t, f = F.nullif(title, F.lit("")), F.nullif(first, F.lit(""))
    return F.coalesce(F.concat(t, F.lit(" — "), f), t, f, F.lit(""))


def video_body(captions: Column, transcript: Column) -> Column:
    """``[12s] caption | ...`` from an array of (t, caption), and a line with the transcript if there is one."""
    shown = F.filter(captions, lambda c: c["caption"] != "")
    text = F.array_join(F.transform(shown, lambda c: F.concat(F.lit("["), F.round(c["t"]).cast("long").cast("string"), F.lit("s] "), c["caption"])), " | ")
    return F.concat(text, F.when(F.coalesce(transcript, F.lit("")) != "", F.concat(F.lit("\nTRANSCRIPT: "), transcript)).otherwise(""))


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms: 0 for the same shape, 1 for no overlap or an empty one."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    overlap = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(total(a) * total(b))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.when(scale > 0, overlap / scale).otherwise(0.0)))


def model_signature(clip: str, pretrained: str, text: str, captions: str | None, speech: str | None) -> str:
    """The signature under which features were made; features of another signature are stale."""
    return "|".join(["v1", clip, pretrained, text, captions or "nocap", speech or "noasr"])


@cache
def accents() -> tuple[str, str]:
    """Latin letters with marks, and the same letters without: the arguments of ``translate``."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in (*range(0xC0, 0x180), *range(0x1E00, 0x1F00))]
    plain = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in plain), "".join(p for _, p in plain)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits without Latin accents; null gives the empty list."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), *accents()), F.lit(r"([\p{L}\p{N}]+)"), 1)
