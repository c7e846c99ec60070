"""From decoded assets to captions, tags, bodies and vectors. Models are duck-typed objects used inside Arrow batches: a batch of assets
is embedded with a few calls. ``FakeModels`` is a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import chunks, first_line, joined_caption, summary_text, video_body

from .frames import evenly, middle

VECTOR = "hash string, space string, source string, ref double, label string, vec array<float>"
# Colours the stand-in knows.
COLOURS = {"red": (220, 30, 30), "green": (30, 180, 30), "blue": (30, 30, 220), "yellow": (230, 220, 30), "black": (10, 10, 10), "white": (245, 245, 245)}
DIM = 16
LABEL, PDF_CHUNKS, TRANSCRIPT_CHUNKS, CAPTIONED_FRAMES, CAPTIONED_PAGES = 300, 250, 40, 6, 3


class FakeModels:
    """Vectors of colour words and of mean colours; the last of 16 places is always a little on."""

    def _unit(self, rows: np.ndarray) -> np.ndarray:
        rows[:, -1] = 0.05
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def text(self, texts: Sequence[str]) -> np.ndarray:
        rows = np.zeros((len(texts), DIM))
        for i, c in enumerate(COLOURS):
            rows[:, i] = [float(c in (t or "").lower()) for t in texts]
        return self._unit(rows)

    clip_text = text

    def image(self, colours: Sequence[Sequence[float]]) -> np.ndarray:
        seen = np.array(colours, float).reshape(-1, 3)
        rows = np.zeros((len(seen), DIM))
        for i, c in enumerate(COLOURS.values()):
            rows[:, i] = np.exp(-np.linalg.norm(seen - np.array(c), axis=1) / 40)
        return self._unit(rows)

    def caption(self, colours: Sequence[Sequence[float]]) -> list[str]:
        seen = np.array(colours, float).reshape(-1, 3)
        names = list(COLOURS)
        nearest = [int(np.argmin([np.linalg.norm(s - np.array(c)) for c in COLOURS.values()])) for s in seen]
        return [f"a {names[i]} picture" for i in nearest]


def captioned(pictures: DataFrame, models) -> DataFrame:
    """(hash, ref, colour) with caption, clip vector and, where captions failed, a warning and the empty caption."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            warning = None
            try:
                captions = models.caption(list(b["colour"]))
            except Exception as e:  # noqa: BLE001
                captions, warning = [""] * len(b), f"captions unavailable: {e}"
            yield pd.DataFrame({"hash": b["hash"], "ref": b["ref"], "caption": captions, "vec": list(models.image(list(b["colour"]))), "warning": warning})

    return pictures.select("hash", "ref", "colour").mapInPandas(run, "hash string, ref double, caption string, vec array<float>, warning string")


def embedded(texts: DataFrame, models) -> DataFrame:
    """(hash, source, ref, text) as vectors of the text space; texts that are empty have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"hash": b["hash"], "space": "text", "source": b["source"], "ref": b["ref"], "label": b["text"].str[:LABEL], "vec": list(models.text(list(b["text"])))})

    return texts.where(F.coalesce("text", F.lit("")) != "").select("hash", "source", "ref", "text").mapInPandas(run, VECTOR)


def spoken(segments: Column) -> Column:
    """The text of speech segments (text, no_speech_prob) that are likely speech."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["no_speech_prob"] < 0.6), lambda x: F.btrim(x["text"])), " ")


def process_images(images: DataFrame, models) -> tuple[DataFrame, DataFrame]:
    """Images (hash, colour) to (results, vectors). Results: hash, caption, body (null), warnings."""
    seen = captioned(images.withColumn("ref", F.lit(None).cast("double")), models)
    results = seen.select("hash", "caption", F.lit(None).cast("string").alias("body"), F.array_compact(F.array("warning")).alias("warnings"))
    clip = seen.select("hash", F.lit("clip").alias("space"), F.lit("image").alias("source"), "ref", F.substring("caption", 1, LABEL).alias("label"), "vec")
    return results, clip.unionByName(embedded(seen.select("hash", F.lit("caption").alias("source"), "ref", F.col("caption").alias("text")), models))


def process_videos(frames: DataFrame, transcripts: DataFrame, models) -> tuple[DataFrame, DataFrame]:
    """Key frames (hash, t, colour) and transcripts (hash, transcript) to (results, vectors). Every key frame has a clip vector; captions
    are made for a few of them, evenly spread; the middle distinct caption is the video's."""
    spread_times = frames.groupBy("hash").agg(evenly(F.array_sort(F.collect_set("t")), CAPTIONED_FRAMES).alias("times"))
    chosen = frames.join(spread_times, "hash").withColumn("told", F.array_contains("times", F.col("t")))
    seen = captioned(chosen.select("hash", F.col("t").alias("ref"), "colour"), models).join(chosen.select("hash", F.col("t").alias("ref"), "told"), ["hash", "ref"])
    seen = seen.withColumn("caption", F.when(F.col("told"), F.col("caption")).otherwise(""))
    told = seen.where("told").groupBy("hash").agg(F.array_sort(F.collect_list(F.struct(F.col("ref").alias("t"), "caption"))).alias("c"), F.array_distinct(F.collect_list("warning")).alias("warnings"))
    rows = told.join(transcripts, "hash", "left")
    results = rows.select("hash", F.coalesce(middle(F.filter("c.caption", lambda x: x != "")), F.lit("")).alias("caption"), video_body(F.col("c"), F.col("transcript")).alias("body"), "warnings")
    clip = seen.select("hash", F.lit("clip").alias("space"), F.lit("frame").alias("source"), "ref", F.substring("caption", 1, LABEL).alias("label"), "vec")
    captions = seen.where("told").select("hash", F.lit("caption").alias("source"), "ref", F.col("caption").alias("text"))
    speech = transcripts.select("hash", F.lit("transcript").alias("source"), F.lit(None).cast("double").alias("ref"), F.explode(F.slice(chunks(F.col("transcript"), 500), 1, TRANSCRIPT_CHUNKS)).alias("text"))
    return results, clip.unionByName(embedded(captions.unionByName(speech), models))


def process_pdfs(pages: DataFrame, models) -> tuple[DataFrame, DataFrame]:
    """Pages (hash, page, text, colour, title) to (results, vectors). The first pages are captioned where they have a picture; the text is cut into chunks with
    their page; one more vector stands for the whole document."""
    seen = captioned(pages.where((F.col("page") <= CAPTIONED_PAGES) & F.col("colour").isNotNull()).select("hash", F.col("page").cast("double").alias("ref"), "colour"), models)
    first = seen.groupBy("hash").agg(F.min(F.struct("ref", "caption")).alias("f"), F.array_distinct(F.collect_list("warning")).alias("warnings"))
    whole = pages.groupBy("hash").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    whole = whole.select("hash", F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\f").alias("body"), "title")
    whole = whole.withColumn("title", F.coalesce(F.nullif(F.btrim("title"), F.lit("")), first_line(F.translate(F.col("body"), "\f", "\n")), F.lit("")))
    results = whole.join(first, "hash", "left").select("hash", joined_caption(F.col("title"), F.col("f.caption")).alias("caption"), "body", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    clip = seen.select("hash", F.lit("clip").alias("space"), F.lit("page").alias("source"), "ref", F.substring("caption", 1, LABEL).alias("label"), "vec")
    pieces = pages.select("hash", F.col("page").cast("double").alias("ref"), F.posexplode(chunks(F.col("text"), 900)).alias("n", "text"))
    capped = pieces.groupBy("hash").agg(F.slice(F.array_sort(F.collect_list(F.struct("ref", "n", "text"))), 1, PDF_CHUNKS).alias("c")).select("hash", F.explode("c").alias("c"))
    texts = capped.select("hash", F.lit("pdf_text").alias("source"), "c.ref", "c.text").unionByName(whole.select("hash", F.lit("pdf_summary").alias("source"), F.lit(1.0).alias("ref"), summary_text(F.col("title"), F.translate(F.col("body"), "\f", " ")).alias("text")))
    return results, clip.unionByName(embedded(texts, models))
