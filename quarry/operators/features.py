"""Features of whole assets from their vectors: mean vectors and zero-shot tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS, LEAST = 5, 0.2


def mean_vectors(vectors: DataFrame, space: str, length: int, key: str = "hash") -> DataFrame:
    """(key, vec): the mean of each asset's vectors of one length, at length one; a zero mean stays. Vectors with a NaN are left out. Each
    batch adds up its rows of an asset before the shuffle, so what meets in a task is a row per asset and batch."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n long, total array<double>"

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64)
            good = np.flatnonzero(~np.isnan(x).any(1))
            if not len(good):
                continue
            keys = batch.column(0).take(pa.array(good)).dictionary_encode()
            code = keys.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            present, start = np.unique(code[order], return_index=True)
            n = np.add.reduceat(batch.column(1).to_numpy()[good][order], start)
            offsets = pa.array(np.arange(len(present) + 1, dtype=np.int32) * length)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(present)), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(np.add.reduceat(x[good][order], start, axis=0).ravel()))], names=[key, "n", "total"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            for batch in added(iter(pa.Table.from_batches(rows).combine_chunks().to_batches())):
                x = batch.column(2).flatten().to_numpy().reshape(-1, length) / batch.column(1).to_numpy()[:, None]
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norm == 0, 1.0, norm)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(batch.column(2).offsets, pa.array(x.ravel()))], names=[key, "vec"])

    rows = vectors.where((F.col("space") == space) & (F.size("vec") == length) & F.col(key).isNotNull())
    parts = rows.select(key, F.lit(1).cast("long").alias("n"), "vec").mapInArrow(added, schema)
    return parts.repartition(key).mapInArrow(means, f"`{key}` {kind}, vec array<double>")


def zero_shot_tags(means: DataFrame, tags: list[tuple[str, list[float]]], key: str = "hash", most: int = TAGS, least: float = LEAST) -> DataFrame:
    """(key, tags): up to ``most`` tags whose vector has at least ``least`` similarity, most similar first, then by name. The tag vectors
    are a fixed vocabulary; one product of matrices a batch."""
    kind = means.schema[key].dataType.simpleString()
    given = sorted(tags, key=lambda t: t[0])
    names, matrix = np.array([t for t, _ in given], object), np.array([v for _, v in given], float).reshape(len(given), -1)
    sent = means.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sims = np.round(x @ matrix.T, 12) if len(names) else np.zeros((len(x), 0))
            order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
            good = np.take_along_axis(sims, order, 1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(names[o[g]]) for o, g in zip(order, good, strict=True)], pa.list_(pa.string()))], names=[key, "tags"])

    return means.select(key, "vec").mapInArrow(run, f"`{key}` {kind}, tags array<string>")


#: The vocabulary of tags, and the text that is embedded for one.
VOCABULARY = (
    "person", "woman", "man", "child", "group of people", "crowd", "family", "couple",
    "cat", "dog", "bird", "horse", "animal",
    "living room", "bedroom", "kitchen", "bathroom", "office", "meeting room", "interior design",
    "modern interior", "furniture", "sofa",
    "house", "apartment building", "residential building", "skyscraper", "city skyline", "street",
    "construction site", "crane", "construction worker", "excavator", "building under construction",
    "road", "car", "traffic", "bicycle", "airplane", "train", "boat",
    "beach", "ocean", "mountain", "forest", "park", "garden", "lake", "river", "snow", "desert",
    "sunset", "night", "aerial view",
    "food", "coffee", "restaurant", "fruit",
    "laptop", "computer", "smartphone", "document", "text", "chart", "map", "logo", "floor plan",
    "person talking to camera", "interview", "presentation", "handshake", "teamwork",
    "sports", "fitness", "yoga", "music", "concert", "wedding", "party",
    "hospital", "school", "classroom", "factory", "warehouse", "shop", "shopping",
    "swimming pool", "real estate", "villa", "hotel", "church", "bridge",
)
PROMPT = "a photo of {}"


def vocabulary_vectors(models) -> list[tuple[str, list[float]]]:
    """The tags of the vocabulary with the vectors their prompts have in the image space."""
    rows = models.clip_text([PROMPT.format(t) for t in VOCABULARY])
    return [(t, list(map(float, v))) for t, v in zip(VOCABULARY, rows, strict=True)]
