"""Skip-gram vectors with negative sampling, learned by gradient over all texts.

Every partition trains from the shared vectors on its own texts, and the changes are averaged by how often a word was met: a few such
rounds. The vectors lie in two tables of a fixed number of rows; a word is the sum of two rows that its hash names. So what is broadcast and
collected has a proven bound whatever the vocabulary, and rare words have vectors as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import written

#: Length of a vector, rows of a table (at most 2 * ROWS * DIMS * 4 bytes are broadcast: 6 MB), words to either side.
DIMS, ROWS, WINDOW = 24, 1 << 15, 2
#: Rounds over all texts, words contrasted with each pair, pairs of one step, length of the first steps.
ROUNDS, NEGATIVES, STEP_PAIRS, RATE = 2, 2, 16_384, 0.2
#: Share of all words above which a word is met less often, by the root of its share, but LEAST_MET times still.
SUBSAMPLE, LEAST_MET = 2e-5, 500


@lru_cache(maxsize=1 << 17)
def rows_of(word: str) -> tuple[int, int]:
    """The two rows of a word."""
    raw = word.encode()
    return zlib.crc32(raw) % ROWS, zlib.crc32(b"~" + raw) % ROWS


@dataclass
class Vectors:
    """``own``: the vectors of words; ``around``: those of words as neighbours."""

    own: np.ndarray
    around: np.ndarray

    @staticmethod
    def start() -> Vectors:
        return Vectors(((np.random.default_rng(3).random((ROWS, DIMS)) - 0.5) / DIMS).astype(np.float32), np.zeros((ROWS, DIMS), np.float32))

    def of(self, words: list[str], table: str) -> np.ndarray:
        at = np.array([rows_of(w) for w in words], np.int64).reshape(-1, 2)
        rows = getattr(self, table)
        return rows[at[:, 0]] + rows[at[:, 1]]


def frequent_weights(texts: DataFrame, tokens: str) -> dict[str, float]:
    """The chance to be met of each word that is more than SUBSAMPLE of all words; fewer than 1 / SUBSAMPLE words can be."""
    counted = written(texts.select(F.explode(F.split(tokens, " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where((F.col("n") > max(LEAST_MET, SUBSAMPLE * total)) & (F.col("word") != "")).collect()
    return {r["word"]: max(LEAST_MET / r["n"], float(np.sqrt(SUBSAMPLE * total / r["n"]))) for r in frequent}


def indexed(values: list[str]) -> tuple[list[str], np.ndarray]:
    """(distinct words, the place among them of each word of all texts, with WINDOW places of -1 after each text). Words are parted by blanks."""
    ids: dict[str, int] = {}
    out: list[int] = []
    for value in values:
        out += [ids.setdefault(w, len(ids)) for w in value.split()]
        out += [-1] * WINDOW
    return list(ids), np.array(out, np.int64)


def _scatter(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, c, n) for c in x.T], 1)


def trained(own: np.ndarray, around: np.ndarray, t: np.ndarray, keep: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the words of some texts after one pass of gradient steps over their pairs."""
    rng = np.random.default_rng(seed)
    t = t[(t < 0) | (rng.random(len(t)) < keep[t])]
    pairs = []
    reach = rng.integers(1, WINDOW + 1, len(t))  # nearer neighbours count more
    for d in range(1, WINDOW + 1):
        a, b = t[:-d], t[d:]
        both = (a >= 0) & (b >= 0)
        pairs += [np.stack([a, b], 1)[both & (reach[:-d] >= d)], np.stack([b, a], 1)[both & (reach[d:] >= d)]]
    pairs = np.concatenate(pairs)
    if not len(pairs):
        return own, around
    pairs = pairs[rng.permutation(len(pairs))]
    pool = t[t >= 0]
    own, around = own.astype(np.float64), around.astype(np.float64)
    seen_own, seen_around = np.full(len(own), 1e-3), np.full(len(own), 1e-3)
    for a in range(0, len(pairs), STEP_PAIRS):
        w, c = pairs[a : a + STEP_PAIRS].T
        w, c = np.concatenate([w] * (1 + NEGATIVES)), np.concatenate([c, pool[rng.integers(0, len(pool), NEGATIVES * len(c))]])
        x, y = own[w], around[c]
        true = np.arange(len(w)) < len(w) // (1 + NEGATIVES)
        error = true - 1 / (1 + np.exp(-np.einsum("ij,ij->i", x, y)))
        for table, seen, at, other in ((own, seen_own, w, y), (around, seen_around, c, x)):
            g = _scatter(at, error[:, None] * other, len(table))
            seen += (g * g).mean(1)
            table += RATE * g / np.sqrt(seen)[:, None]
    return own, around


def learn(texts: DataFrame, tokens: str, rounds: int = ROUNDS) -> tuple[Vectors, dict[str, float]]:
    """(vectors, chances of the frequent words) from all texts, whose words are parted by blanks. Without texts the vectors are as they start."""
    spark = texts.sparkSession
    chance = frequent_weights(texts, tokens)
    vectors = Vectors.start()
    names = [f"d{i}" for i in range(DIMS)]
    schema = "side int, row int, n double, " + ", ".join(f"{c} double" for c in names)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((vectors, chance))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            shared, chance = sent.value
            now = Vectors(shared.own.astype(np.float64), shared.around.astype(np.float64))
            met = np.zeros(ROWS)
            for batch in batches:
                values = batch.column(0).to_pylist()
                words, t = indexed(values)
                if not words:
                    continue
                at = np.array([rows_of(w) for w in words])
                keep = np.array([chance.get(w, 1.0) for w in words])
                seed = zlib.crc32(values[0].encode()) + 7919 * turn
                before = [now.of(words, "own"), now.of(words, "around")]
                after = trained(*before, t, keep, seed)
                times = np.bincount(t[t >= 0], minlength=len(words)) * keep
                for table, x, y in zip((now.own, now.around), before, after, strict=True):
                    for side in range(2):  # rows that several words share get the mean of their changes
                        change = _scatter(at[:, side], (y - x) * times[:, None], ROWS) / np.maximum(np.bincount(at[:, side], times, ROWS), 1e-9)[:, None]
                        table += change / 2
                met += np.bincount(at.ravel(), np.repeat(times, 2), ROWS)
            hit = np.flatnonzero(met)
            for side, (table, old) in enumerate(((now.own, shared.own), (now.around, shared.around))):
                change = (table[hit] - old[hit]) * met[hit, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), side, np.int32)), pa.array(hit.astype(np.int32)), pa.array(met[hit]), *(pa.array(c) for c in change.T)], names=["side", "row", "n", *names])

        moved = texts.select(tokens).mapInArrow(run, schema).groupBy("side", "row").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).toArrow()
        side, row, n = (moved.column(c).to_numpy() for c in ("side", "row", "n"))
        change = np.stack([moved.column(c).to_numpy() for c in names], 1) / np.maximum(n, 1e-9)[:, None] if len(n) else np.zeros((0, DIMS))
        own, around = vectors.own.copy(), vectors.around.copy()
        own[row[side == 0]] += change[side == 0].astype(np.float32)
        around[row[side == 1]] += change[side == 1].astype(np.float32)
        vectors = Vectors(own, around)
        sent.unpersist()
    return vectors, chance
