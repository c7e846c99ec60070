"""Problem 10: the share of repeated content inside each document.

Words are maximal runs of letters in lower case. A word is repeated if it lies in a stretch of eight words that also starts earlier in
the document. Batches of documents are handled as flat arrays; words and pairs that occur again are found by sorting 64-bit keys.

Documents are scored by gradient-boosted trees over statistics of their words and pairs of words; the exact measure, which compares
stretches of eight, runs only where the score reaches the cut. The trees are node arrays, scored for all rows at once, and monotone in the
statistics that repetition moves one way. Every case has at least known values of these (BOUNDS), so the least score of any case can be
read off the trees themselves: that is the cut, and no case lies below it, whatever the sample held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

from .codepoints import chunks, codepoints, letter_table, lower_table, mix, run_hashes

STRETCH, SHARE = 8, 0.3
#: Labelled rows the trees are fitted on, at most. Everything else covers all rows.
SAMPLE = 4000
#: Statistics, and whether the score may only grow (1) or fall (-1) with them; 0: either.
FEATURES = (("log_words", 0), ("top_word", 0), ("new_words", -1), ("repeat_2", 1), ("run_2", 1), ("longest_run", 1))
#: What every case has at least (new_words: at most): a stretch of eight that occurs again consists of words and of seven pairs in a row that do.
BOUNDS = {"new_words": 1 - SHARE, "repeat_2": SHARE * (STRETCH - 1) / STRETCH, "run_2": SHARE, "longest_run": float(np.log1p(STRETCH))}
SLACK = 1e-9


def _again(key: np.ndarray) -> np.ndarray:
    """True where a value has occurred before."""
    seen = np.ones(len(key), bool)
    if len(key):
        order = np.argsort(key)
        ranked = key[order]
        begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        seen[np.minimum.reduceat(order, begin)] = False
    return seen


@dataclass
class Words:
    """The words of some documents: a hash each, the document each lies in, their lengths; ``n``: how many documents."""

    word: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    n: int

    @property
    def salt(self) -> np.ndarray:
        return mix(self.doc.astype(np.uint64) + np.uint64(1))

    def of(self, docs: np.ndarray) -> Words:
        """The words of these documents alone."""
        kept = np.zeros(self.n, bool)
        kept[docs] = True
        inside = kept[self.doc]
        return Words(self.word[inside], (np.cumsum(kept) - 1)[self.doc[inside]], self.size[inside], int(kept.sum()))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(where a run of ``size`` words, a power of two, starts inside a document; a hash of each such run, different in each document)."""
        gram, have = self.word, 1
        with np.errstate(over="ignore"):
            while have < size:
                wide = np.zeros_like(gram)
                if len(gram) > have:
                    wide[:-have] = mix(gram[:-have] * np.uint64(0x9E3779B97F4A7C15) + gram[have:])
                gram, have = wide, 2 * have
        n = len(self.word)
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        return at, gram[at] ^ self.salt[at]

    def per(self, where: np.ndarray) -> np.ndarray:
        """The share of each document's words that are at ``where``."""
        return np.bincount(self.doc[where], minlength=self.n) / np.maximum(1, np.bincount(self.doc, minlength=self.n))


def words_of(texts: list[str | None]) -> Words:
    none = np.zeros(0, np.int64)
    joined = "\n".join(t or "" for t in texts)
    cps = codepoints(joined)
    letter = letter_table()[cps]
    at = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if not len(at):
        return Words(none.astype(np.uint64), none, none, len(texts))
    kept = lower_table()[cps[letter]]
    starts = np.cumsum(letter)[at] - 1
    begins = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    return Words(run_hashes(kept, starts), np.searchsorted(begins, at, side="right") - 1, np.diff(np.append(starts, len(kept))), len(texts))


def _covered(hit: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie within ``width`` places from one of ``hit``."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, np.minimum(hit + width, n), -1)
    return np.cumsum(cover[:n]) > 0


def statistics(w: Words) -> np.ndarray:
    """A row of FEATURES for each document; without words it is zero, and new_words 1."""
    out = np.zeros((w.n, len(FEATURES)))
    out[:, 2] = 1.0
    count = np.bincount(w.doc, minlength=w.n)
    if not len(w.word):
        return out
    key = w.word ^ w.salt
    ranked = np.sort(key)
    order = np.argsort(key)
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    first, times = np.minimum.reduceat(order, begin), np.diff(np.append(begin, len(key)))
    top = np.zeros(w.n)
    np.maximum.at(top, w.doc[first], times)
    at, pair = w.grams(2)
    again = at[_again(pair)]
    # runs of at least seven pairs in a row that occur again, all in one document
    edge = np.flatnonzero(np.diff(again) != 1)
    begin, end = np.concatenate([[0], edge + 1]) if len(again) else edge, np.concatenate([edge, [len(again) - 1]]) if len(again) else edge
    low, size = again[begin], end - begin + 1
    long = size >= STRETCH - 1
    low, size = low[long], size[long]
    longest = np.zeros(w.n)
    np.maximum.at(longest, w.doc[low], size + 1)
    cover = np.zeros(len(key) + 1, np.int64)
    np.add.at(cover, low, 1)
    np.add.at(cover, low + size + 1, -1)
    total = np.maximum(1, count)
    some = count > 0
    out[:, 0], out[:, 1] = np.log1p(count), top / total
    out[some, 2] = (np.bincount(w.doc[first], minlength=w.n) / total)[some]
    out[:, 3], out[:, 4], out[:, 5] = w.per(again), w.per(np.cumsum(cover[:-1]) > 0), np.log1p(longest)
    return out


def repeated_share(w: Words) -> np.ndarray:
    """The exact share of repeated words of each document."""
    at, gram = w.grams(STRETCH)
    return w.per(_covered(at[_again(gram)], STRETCH, len(w.word)))


@dataclass
class Trees:
    """Boosted trees of one depth, flattened: node i of tree t splits at feature[t, i] <= threshold[t, i], its children are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    cut: float = 0.0

    @property
    def depth(self) -> int:
        return int(np.log2(self.feature.shape[1] + 1))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, marks: np.ndarray | None = None) -> Trees:
    """Logistic boosting on binned features. A split that would break a feature's direction is refused and the bounds on leaf values
    are passed down, so the whole score is monotone."""
    edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    if marks is not None:  # values to part at, besides
        edges = [e if np.isnan(m) else np.unique(np.append(e, m)) for e, m in zip(edges, marks, strict=True)]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, np.int64)
    rate_of = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    score = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        leaf = lambda rows, lo, hi: float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), lo, hi))  # noqa: E731, B023
        level = [(0, np.arange(len(y)), -4.0, 4.0)]
        for _ in range(depth):
            below = []
            for node, rows, lo, hi in level:
                best, found = 1e-9, None
                for f in range(x.shape[1]):
                    if not len(edges[f]) or len(rows) < 2:
                        continue
                    m = len(edges[f]) + 1
                    gl = np.cumsum(np.bincount(code[rows, f], g[rows], m))
                    hl = np.cumsum(np.bincount(code[rows, f], h[rows], m))
                    gr, hr = gl[-1] - gl[:-1], hl[-1] - hl[:-1]
                    gl, hl, whole = gl[:-1], hl[:-1], gl[-1] ** 2 / (hl[-1] + ridge)
                    left, right = np.clip(gl / (hl + ridge), lo, hi), np.clip(gr / (hr + ridge), lo, hi)
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole
                    gain[(monotone[f] * (right - left) < 0) | (hl < 1e-3) | (hr < 1e-3)] = 0
                    if len(gain) and gain.max() > best:
                        best, k = float(gain.max()), int(gain.argmax())
                        found = (f, k, (left[k] + right[k]) / 2)
                if found is None:
                    below += [(2 * node + 1, rows, lo, hi), (2 * node + 2, rows[:0], lo, hi)]
                    continue
                f, k, middle = found
                out.feature[t, node], out.threshold[t, node] = f, edges[f][k]
                go = code[rows, f] > k
                l, r = ((lo, middle), (middle, hi)) if monotone[f] > 0 else ((middle, hi), (lo, middle)) if monotone[f] < 0 else ((lo, hi), (lo, hi))
                below += [(2 * node + 1, rows[~go], *l), (2 * node + 2, rows[go], *r)]
            level = below
        for node, rows, lo, hi in level:
            out.value[t, node - inner] = rate * leaf(rows, lo, hi)
            score[rows] += out.value[t, node - inner]
    return out


def least_score(model: Trees, corner: dict[str, float]) -> float:
    """The least score of any row whose monotone statistics are at ``corner`` or beyond it in their direction. Monotone trees have it at the
    corner itself; of the free statistics every combination of thresholds is tried."""
    names = [n for n, _ in FEATURES]
    free = [i for i, (n, d) in enumerate(FEATURES) if not d or n not in corner]
    steps = []
    for i in free:
        t = np.unique(model.threshold[(model.feature == i) & np.isfinite(model.threshold)])
        steps.append(np.concatenate([t, [np.inf]]))
    grid = np.stack([g.ravel() for g in np.meshgrid(*steps, indexing="ij")], 1)
    x = np.zeros((len(grid), len(names)))
    for i, n in enumerate(names):
        if i not in free:
            x[:, i] = corner[n] + SLACK if dict(FEATURES)[n] < 0 else corner[n] - SLACK
    x[:, free] = grid
    return float(model.score(x).min())


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Fit the scorer on at most ``sample`` documents, chosen by the hash of their id, with the exact measure as label. The cut is the least
    score any case can have."""
    total = max(1, docs.count())
    chosen = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(total)) < min(total, sample)).select(text).limit(2 * sample)
    names = [n for n, _ in FEATURES]
    rows = np.array(_measured(chosen, None, text).select("repeated_share", *names).collect(), dtype=float).reshape(-1, 1 + len(names))[:sample]
    x, y = rows[:, 1:], (rows[:, 0] >= SHARE).astype(float)
    marks = np.array([np.nan if n not in BOUNDS else BOUNDS[n] + (2 * SLACK if d < 0 else -2 * SLACK) for n, d in FEATURES])
    model = fit_trees(x, y, np.array([d for _, d in FEATURES]), marks=marks)
    model.cut = least_score(model, BOUNDS)
    return model


def _measured(docs: DataFrame, key: str | None, text: str, model: Trees | None = None, every: bool = True) -> DataFrame:
    """(key, words, repeated_share, score, selected, statistics). The share is exact where the score reaches the cut and, with ``every`` or
    without a model, wherever it isn't zero by the statistics; elsewhere it is null."""
    columns = ([key] if key else []) + [text]
    source = docs.select(*columns)
    names = [n for n, _ in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(columns) - 1).to_pylist()
            for a, b in chunks(texts):
                w = words_of(texts[a:b])
                x = statistics(w)
                score = model.score(x) if model else np.zeros(len(x))
                chosen = score >= model.cut if model else np.ones(len(x), bool)
                some = x[:, 4] > 0  # no run of seven pairs: no stretch of eight
                share = np.where(some, np.nan, 0.0)
                exact = np.flatnonzero(some & (chosen | every))
                share[exact] = repeated_share(w.of(exact))
                own = [batch.column(0).slice(a, b - a)] if key else []
                count = np.bincount(w.doc, minlength=w.n)
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(count), pa.array(share, mask=np.isnan(share)), pa.array(score), pa.array(chosen), *(pa.array(c) for c in x.T)], names=[*columns[:-1], "words", "repeated_share", "score", "selected", *names]
                )

    head = f"`{key}` {source.schema[key].dataType.simpleString()}, " if key else ""
    return source.mapInArrow(run, head + "words long, repeated_share double, score double, selected boolean, " + ", ".join(f"{m} double" for m in names))


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, every: bool = True) -> DataFrame:
    """(key, words, repeated_share, score, selected, repeated) of every document.

    ``selected``: the trees' score reaches their cut, below which no case can lie; ``repeated``: selected and at least SHARE of the words are
    repeated. Without ``every`` the share of documents that aren't selected is left null where the statistics alone don't make it 0.
    Null, empty and wordless texts have 0 words and share 0. A repeated key is measured as often as it occurs.
    """
    model = train(docs, key, text, sample)
    m = _measured(spread(docs.select(key, text)), key, text, model, every)
    return m.select(key, "words", "repeated_share", "score", "selected", (F.col("selected") & (F.coalesce("repeated_share", F.lit(0.0)) >= SHARE)).alias("repeated"))
