"""Choosing key frames: a stateful scan over the frames of each video in time order, and even thinning."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quarry.session import numbered

# Frames darker than this are black; a scene changes beyond this distance; a frame is kept after so many seconds anyway.
BLACK, SCENE, GAP = 12.0, 0.35, 4.0
MOST_FRAMES, MOST_CANDIDATES, UNKNOWN_LENGTH = 16, 60, 240


def candidate_times(duration: Column, most: int = MOST_CANDIDATES) -> Column:
    """Times of candidate frames: every second, or fewer so that there are at most ``most``; null or non-positive length: time 0."""
    d = F.coalesce(duration, F.lit(0.0))
    step = F.greatest(F.lit(1.0), d / most)
    n = F.least(F.floor(d / step).cast("int"), F.lit(most - 1))
    return F.when(d > 0, F.transform(F.sequence(F.lit(0), n), lambda i: i * step)).otherwise(F.array(F.lit(0.0)))


def kept_times(times: Column, gap: float) -> Column:
    """Of ascending times those at least ``gap`` after the last kept one; the first is kept."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("kept"))

    def step(state: Column, t: Column) -> Column:
        keep = state["last"].isNull() | (t - state["last"] >= gap)
        return F.when(keep, F.struct(t.alias("last"), F.concat(state["kept"], F.array(t)).alias("kept"))).otherwise(state)

    return F.aggregate(times, start, step, lambda s: s["kept"])


def evenly(items: Column, most: int = MOST_FRAMES) -> Column:
    """At most ``most`` items, evenly spread from the first to the last; places are rounded half to even and not repeated."""
    n = F.size(items)
    if most == 1:
        return F.slice(items, 1, 1)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(most - 1))).cast("int")))
    return F.when(n <= most, items).otherwise(F.transform(places, lambda p: F.element_at(items, p + 1)))


def evenly_rows(rows: DataFrame, key: str, order: str, most: int = MOST_FRAMES) -> DataFrame:
    """``rows`` thinned to at most ``most`` of each key, evenly spread by ``order``, as ``evenly`` does in an array. Rows are numbered over
    all keys in ranges, so a key with many rows is in no single task."""
    placed = numbered(rows, [key, order], "places")
    bounds = placed.groupBy(key).agg(F.min("_place").alias("_low"), F.count("*").alias("_n"))
    spread = F.sequence(F.lit(0), F.lit(most - 1))
    wanted = F.array_distinct(F.transform(spread, lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, most - 1)))).cast("long")))
    k = bounds.select(F.col(key).alias("_k"), "_low", F.when(F.col("_n") > most, wanted).alias("_wanted"))
    joined = placed.join(k, F.col(key).eqNullSafe(F.col("_k")))
    return joined.where(F.col("_wanted").isNull() | F.array_contains("_wanted", F.col("_place") - F.col("_low"))).select(*rows.columns)


def kept_rows(rows: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """(key, time) of the rows at least ``gap`` after the last kept one of their key, as ``kept_times`` does in an array. Rows pass in order,
    a batch at a time; what is held of a key is its last kept time. Null times are left out."""
    chosen = rows.select(key, time).where(F.col(time).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            keys, times = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = keys.indices.fill_null(-1).to_numpy()
            kept: list[int] = []
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for a, b in zip(edges, edges[1:], strict=False):
                name = keys.dictionary[int(code[a])].as_py() if code[a] >= 0 else None
                at = a if held is None or held[0] != name else int(np.searchsorted(times[a:b], held[1] + gap)) + a
                last = None if held is None or held[0] != name else held[1]
                while at < b:
                    kept.append(at)
                    last = float(times[at])
                    at = a + int(np.searchsorted(times[a:b], last + gap))
                held = (name, last) if last is not None else held
            yield batch.take(pa.array(kept, pa.int64()))

    return chosen.repartition(key).sortWithinPartitions(key, time).mapInArrow(run, chosen.schema)


@dataclass
class _Video:
    """The scan of one video: whether a bright frame was met, what was kept (null times come first), and the last kept frame."""

    bright: bool = False
    nulls: int = 0
    times: array = field(default_factory=lambda: array("d"))
    last: tuple | None = None  # time or None, histogram, its length, its sum or None


class _Frames:
    """The frames of a batch as flat arrays. Histograms are padded with zeros to one width; a null value in one makes its sum unknown."""

    def __init__(self, batch: pa.RecordBatch):
        time, brightness, hist = batch.column(1), batch.column(2), batch.column(3)
        self.null = time.is_null().to_numpy(zero_copy_only=False)
        self.t = time.fill_null(0.0).to_numpy()
        # NaN is the greatest number, here and below
        self.bright = ~(brightness.fill_null(BLACK).to_numpy() <= BLACK)
        at = hist.offsets.to_numpy()
        null = hist.is_null().to_numpy(zero_copy_only=False)
        self.size = np.where(null, 0, np.diff(at))
        width = int(self.size.max(initial=0))
        values = hist.values.fill_null(0.0).to_numpy()
        inside = np.arange(width) < self.size[:, None]
        self.hist = np.zeros((len(at) - 1, width))
        self.hist[inside] = values[(at[:-1, None] + np.arange(width))[inside]]
        gaps = np.concatenate([[0], np.cumsum(hist.values.is_null().to_numpy(zero_copy_only=False))])
        self.known = ~null & (gaps[at[1:]] == gaps[at[:-1]])
        self.total = self.added(self.hist)

    @staticmethod
    def added(x: np.ndarray) -> np.ndarray:
        """Sums of rows, from the first value to the last, as ``histogram_distance`` adds."""
        return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    def new(self, rows: np.ndarray, last: tuple) -> np.ndarray:
        """Which of ``rows`` differ from the last kept frame by more than SCENE, or come GAP or more seconds after it: ``histogram_distance``
        of whole arrays. An unknown sum is a distance of 1, another length one of 0."""
        time, hist, size, total = last
        scene = np.ones(len(rows), bool)
        if total is not None:
            scale = np.sqrt(self.total[rows] * total)
            apart = ~(scale <= 0)
            overlap = self.added(np.sqrt(self.hist[rows, : len(hist)] * hist[: self.hist.shape[1]]))
            distance = np.sqrt(np.maximum(0.0, 1 - overlap / np.where(apart, scale, 1.0)))
            scene = ~self.known[rows] | ~apart | ((self.size[rows] == size) & ~(distance <= SCENE))
        return scene | ~(self.t[rows] - time < GAP)

    def scan(self, rows: np.ndarray, video: _Video) -> None:
        """Go on with a video in its next ``rows``; as many are looked at together as lay between the last kept ones."""
        at, look = 0, 4
        while at < len(rows):
            if video.last is None or video.last[0] is None:
                hit = 0
            else:
                some = rows[at : at + look]
                found = self.new(some, video.last)
                hit = int(found.argmax())
                if not found[hit]:
                    at, look = at + len(some), min(2 * look, 1024)
                    continue
                look = 2 * hit + 2
            i = int(rows[at + hit])
            at += hit + 1
            if self.null[i]:
                video.nulls += 1
            else:
                video.times.append(self.t[i])
            size = int(self.size[i])
            video.last = (None if self.null[i] else float(self.t[i]), self.hist[i, :size].copy(), size, float(self.total[i]) if self.known[i] else None)


def keyframes(frames: DataFrame, key: str = "hash") -> DataFrame:
    """(key, times): the key frames of every video from rows (key, t, brightness, hist). Frames that are nearly black are left out, unless
    all are. Of the others in time order the first is kept, and each whose histogram differs from the last kept one's by more than SCENE or
    that comes GAP or more seconds after it; these are thinned evenly. Equal times go by brightness and histogram. Frames pass in order, a
    batch at a time: what is held of a video is its last kept frame and the kept times, so a video may have any number of frames.
    """
    ordered = frames.select(key, F.col("t").cast("double").alias("t"), F.col("brightness").cast("double").alias("brightness"), F.col("hist").cast("array<double>").alias("hist"))

    def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in slices, so that one long histogram doesn't widen many."""
        width = int(np.diff(batch.column(3).offsets.to_numpy()).max(initial=1))
        step = max(1, (1 << 22) // max(1, width))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (key, scan, type of the key)

        def told(done: list[tuple]) -> pa.RecordBatch:
            times = [[None] * v.nulls + v.times.tolist() for _, v, _ in done]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in done], done[0][2]), pa.array(times, pa.list_(pa.float64()))], names=[key, "times"])

        for batch in (x for whole in batches for x in bounded(whole)):
            keys, done = batch.column(0).dictionary_encode(), []
            code = keys.indices.fill_null(-1).to_numpy()
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            with np.errstate(all="ignore"):
                data = _Frames(batch)
                for a, b in zip(edges, edges[1:], strict=False):
                    name = keys.dictionary[int(code[a])].as_py() if code[a] >= 0 else None
                    if held is None or held[0] != name:
                        if held is not None:
                            done.append(held)
                        held = (name, _Video(), batch.column(0).type)
                    rows = np.arange(a, b)
                    if not held[1].bright and data.bright[a:b].any():
                        held = (name, _Video(bright=True), held[2])  # what was kept of dark frames doesn't count
                    data.scan(rows[data.bright[a:b]] if held[1].bright else rows, held[1])
            if done:
                yield told(done)
        if held is not None:
            yield told([held])

    schema = StructType([frames.schema[key], StructField("times", ArrayType(DoubleType()))])
    return ordered.repartition(key).sortWithinPartitions(key, "t", "brightness", "hist").mapInArrow(run, schema).select(key, evenly(F.col("times")).alias("times"))


def middle(items: Column) -> Column:
    """The middle one of the distinct items in order; null of none."""
    d = F.array_distinct(items)
    return F.try_element_at(d, (F.floor(F.size(d) / 2) + 1).cast("int"))
