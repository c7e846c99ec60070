"""From files to outcomes: each asset goes to the decoder of its kind, and what is decoded to the processor of its kind.

Decoding runs once, a file at a time in Python workers, and its rows are written; everything after that reads the table. A file that
can't be decoded becomes an error row, lasting if the file is at fault; no error ends the run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.features import mean_vectors, vocabulary_vectors, zero_shot_tags
from quarry.operators.frames import keyframes
from quarry.operators.processors import process_images, process_pdfs, process_videos
from quarry.session import written
from quarry.sources.media import DECODERS, Part, ProcessingError, brightness, histogram, thumbnail

from .ingest import META, RESULTS

Decoder = Callable[[str], tuple[list[Part], dict]]
#: Reads the spoken text of a video; None where there is no speech model.
Transcriber = Callable[[str], str | None]
#: Reads the text in a picture of a page; None where there is no such model.
Reader = Callable[[np.ndarray], str]
#: Characters of a page's text under which its picture is read.
READ_UNDER = 30
_META = [x.split(":")[0] for x in META.removeprefix("struct<").removesuffix(">").split(",")]
DECODED = f"hash string, kind string, ref double, colour array<double>, brightness double, hist array<double>, text string, meta {META}, thumb binary, transcript string, error string, lasting boolean, ms long"


def decoded(assets: DataFrame, decoders: dict[str, Decoder] | None = None, transcribe: Transcriber | None = None, read: Reader | None = None, thumbs: bool = True) -> DataFrame:
    """The parts of assets (hash, kind, path), one row each; a file that fails has one row with its error. Pages with hardly any text are read
    by ``read``, where their picture is there. The first part of a file carries its thumbnail and its speech, pages with a picture their own."""
    known = DECODERS if decoders is None else decoders

    def one(kind: str, path: str) -> list[dict]:
        began = time.perf_counter()
        try:
            if kind not in known:
                raise ProcessingError(f"no processor for kind {kind!r}")
            parts, meta = known[kind](path)
            if not parts:
                raise ProcessingError("nothing to read in the file")
            spoken = transcribe(path) if kind == "video" and transcribe else None
            seen = 0
            for p in parts:
                if kind == "pdf" and read and p.rgb is not None and len((p.text or "").strip()) < READ_UNDER:
                    p.text = read(p.rgb)
                    seen += 1
            meta = meta | ({"has_speech": bool(spoken)} if kind == "video" else {"has_text": any((p.text or "").strip() for p in parts), "ocr_pages": seen} if kind == "pdf" else {})
            picture = next((p.rgb for p in parts if p.rgb is not None), None)
            out = []
            for i, p in enumerate(parts):
                shown = {} if p.rgb is None else {"colour": np.asarray(p.rgb, float).reshape(-1, 3).mean(0).tolist(), "brightness": brightness(p.rgb)} | ({"hist": histogram(p.rgb).tolist()} if kind == "video" else {})
                first = {"thumb": thumbnail(picture) if thumbs and picture is not None else None, "transcript": spoken} if i == 0 else {"thumb": thumbnail(p.rgb)} if thumbs and kind == "pdf" and p.rgb is not None else {}
                out.append({"ref": p.ref, "text": p.text, "meta": {c: meta.get(c) for c in _META}} | shown | first)
            ms = round(1000 * (time.perf_counter() - began))
            return [r | {"ms": ms} for r in out]
        except ProcessingError as e:
            return [{"error": str(e), "lasting": True}]
        except MemoryError:
            return [{"error": "out of memory while processing", "lasting": False}]
        except Exception as e:  # noqa: BLE001
            return [{"error": f"{type(e).__name__}: {e}", "lasting": False}]

    names = [c.split()[0] for c in DECODED.replace(META, "meta").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, kind, path in zip(b["hash"], b["kind"], b["path"], strict=True):
                rows = [{"hash": h, "kind": kind} | r for r in one(kind, path)]
                yield pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names, dtype=object)

    return assets.select("hash", "kind", "path").mapInPandas(run, DECODED)


def _uri(png: str) -> Column:
    return F.when(F.col(png).isNotNull(), F.concat(F.lit("data:image/png;base64,"), F.base64(png)))


def media_process(models, decoders: dict[str, Decoder] | None = None, transcribe: Transcriber | None = None, read: Reader | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """The ``process`` of an ``Ingest``: (results, vectors) of assets (hash, kind, path) by the decoder and the processor of their kind.
    Tags come from the vocabulary where ``models`` embed text for the image space."""

    def process(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = assets.sparkSession
        parts = written(decoded(assets, decoders, transcribe, read), "decoded")
        good, of = parts.where("error is null"), lambda kind: parts.where((F.col("kind") == kind) & F.col("error").isNull())
        video = of("video")
        chosen = keyframes(video.select("hash", F.col("ref").alias("t"), "brightness", "hist")).select("hash", F.explode("times").alias("t"))
        chosen = chosen.join(video.select("hash", F.col("ref").alias("t"), "colour"), ["hash", "t"]).dropDuplicates(["hash", "t"])
        pages = of("pdf").select("hash", F.col("ref").cast("int").alias("page"), "text", "colour", "meta.title")
        made = [
            process_images(of("image").select("hash", "colour"), models),
            process_videos(chosen, video.where("transcript is not null").select("hash", "transcript"), models),
            process_pdfs(pages, models),
        ]
        results = made[0][0].unionByName(made[1][0]).unionByName(made[2][0])
        vectors = made[0][1].unionByName(made[1][1]).unionByName(made[2][1])
        # a page's own thumbnail, else the file's first
        shown = good.where("thumb is not null and ref is not null").select(F.col("hash").alias("_hash"), F.col("ref").alias("_ref"), _uri("thumb").alias("_own"))
        first = good.where("thumb is not null").groupBy("hash").agg(F.min_by(_uri("thumb"), F.coalesce("ref", F.lit(0.0))).alias("_first"))
        paged = F.col("source").isin("page", "pdf_text", "pdf_summary")
        vectors = vectors.join(shown, (F.col("hash") == F.col("_hash")) & paged & (F.col("ref") == F.col("_ref")), "left").drop("_hash").join(first, "hash", "left")
        vectors = written(vectors.withColumn("thumb", F.coalesce("_own", "_first")).drop("_ref", "_own", "_first"), "made-vectors")
        counts = chosen.groupBy("hash").agg(F.count("*").cast("int").alias("_frames"))
        whole = good.groupBy("hash").agg(F.first("meta", ignorenulls=True).alias("meta"), F.min_by("thumb", F.when(F.col("thumb").isNotNull(), F.coalesce("ref", F.lit(0.0)))).alias("_thumb"), F.max("ms").alias("process_ms"))
        whole = whole.join(counts, "hash", "left").withColumn("meta", F.when(F.col("_frames").isNotNull(), F.col("meta").withField("frames_sampled", F.col("_frames"))).otherwise(F.col("meta")))
        results = results.join(whole.drop("_frames"), "hash").withColumn("thumb", _uri("_thumb")).drop("_thumb")
        if hasattr(models, "clip_text"):
            vocabulary = vocabulary_vectors(models)
            tags = zero_shot_tags(mean_vectors(vectors, "clip", len(vocabulary[0][1])), vocabulary)
            results = results.join(tags, "hash", "left")
        bad = parts.where("error is not null").select("hash", "error", F.coalesce("lasting", F.lit(False)).alias("lasting"))
        empty = spark.createDataFrame([], RESULTS)
        out = empty.unionByName(results, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)
        return out.withColumn("processed_at", F.lit(time.time())), vectors

    return process
