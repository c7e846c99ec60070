"""Problem 9: evaluation passages inside the corpus.

Each shard of the corpus (the texts of a batch) becomes an FM-index over words: suffix array by prefix doubling, Burrows-Wheeler
transform in a wavelet matrix, suffix positions sampled. Every phrase of six words of every evaluation item is searched backwards, all
phrases at once; occurrences are located through the samples and merged into spans. A document lies in one shard, so nothing is
shuffled. Words outside the evaluation vocabulary are one symbol: no phrase can contain it.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.session import scratch, spread

from .codepoints import chunks, codepoints, run_hashes
from .vectorspace import get, put

#: Words of the shortest run that counts, and the share of an item's words that makes a case.
RUN, SHARE = 6, 0.5
#: Items prepared and searched together; more items take more passes over a shard's index, so what is held stays bounded.
ITEMS_PER_PASS = 4000
#: Every so many text positions, one suffix position is kept.
SAMPLED = 32
#: Symbols: the end of a shard (once, as the transform needs it), the end of a text, a word of no item; then the items' words.
END, SEPARATOR, OTHER, FIRST = range(4)
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|mark|sub|sup|small|code|font)(?:\s[^<>\x1e]{0,200})?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>\x1e]{0,200}>|&nbsp;|&#?\w{1,8};")


@cache
def _kinds() -> np.ndarray:
    """1: part of a word; 2: dropped without ending a word; 0: between words."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        table[i] = 1 if c.isalnum() else 2 if unicodedata.category(c) in ("Mn", "Me", "Cf") or c in "*`" else 0
    return table


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text): without case, accents, markup and punctuation."""
    joined = "\x1e".join((t or "").replace("\x1e", " ") for t in texts)
    if "<" in joined or "&" in joined:
        joined = _TAG.sub(" ", _INLINE.sub("", joined))
    if not joined.isascii():
        joined = unicodedata.normalize("NFKD", joined)
        joined = unicodedata.normalize("NFKD", joined.casefold())
    else:
        joined = joined.lower()
    cps = codepoints(joined)
    kind = _kinds()[cps]
    text = np.cumsum(cps == 0x1E)[kind != 2]
    cps, kind = cps[kind != 2], kind[kind != 2]
    part = kind == 1
    first = np.flatnonzero(part & ~np.concatenate([[False], part[:-1]]))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return run_hashes(cps[part], np.cumsum(part)[first] - 1), text[first]


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Full order of the suffixes: packed first symbols, then prefix doubling of those still tied."""
    n = len(t)
    bits = max(1, int(sigma).bit_length())
    width = max(1, min(62 // bits, 8))
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(width, np.int64)])
    bits = max(1, int(sigma + 1).bit_length())
    width = max(1, min(62 // bits, width))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key << bits | padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1]
    h = width
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return sa
        own = sa[tied]
        key = rank[own] * (n + 2) + rank[np.minimum(own + h, n)] + 1
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[tied] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[tied] = new
        rank[own] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        h *= 2


class WaveletMatrix:
    """rank of any symbol at any position, for arrays of questions."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.begin = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[at].astype(np.int64)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.begin[symbol]


class FMIndex:
    def __init__(self, t: np.ndarray, sigma: int, sampled: int = SAMPLED):
        sa = suffix_array(t, sigma)
        self.bwt = t[sa - 1]  # the suffix at 0 is preceded by the last symbol, END
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        self.marked = sa % sampled == 0
        self.sample_of = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]
        self.n = len(t)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``patterns``, from the last symbol backwards."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            c = column[live]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk left until a sampled one."""
        at, steps, live = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live := live[~self.marked[at[live]]]):
            c = self.bwt[at[live]].astype(np.int64)
            at[live] = self.before[c] + self.wavelet.rank(c, at[live])
            steps[live] += 1
        return self.samples[self.sample_of[at]] + steps


@dataclass
class Phrases:
    """All runs of RUN words of a set of items."""

    vocabulary: np.ndarray  # sorted word hashes; a word's symbol is its place + FIRST
    patterns: np.ndarray
    owners: np.ndarray  # rows (pattern, item, offset), by pattern
    items: list
    sizes: np.ndarray

    @classmethod
    def of(cls, items: list, texts: list[str | None], run: int = RUN) -> Phrases:
        word, text = words(texts)
        vocabulary = np.unique(word)
        symbol = np.searchsorted(vocabulary, word) + FIRST
        sizes = np.bincount(text, minlength=len(items))
        begins = np.cumsum(sizes) - sizes
        whole = np.flatnonzero(text[: len(text) - run + 1] == text[run - 1 :]) if len(text) >= run else np.zeros(0, np.int64)
        grams = np.stack([symbol[whole + k] for k in range(run)], 1) if len(whole) else np.zeros((0, run), np.int64)
        patterns, which = np.unique(grams, axis=0, return_inverse=True) if len(grams) else (grams, np.zeros(0, np.int64))
        owners = np.stack([which.ravel(), text[whole], whole - begins[text[whole]]], 1)
        return cls(vocabulary, patterns, owners[np.argsort(owners[:, 0], kind="stable")], items, sizes)


    def save(self, uri: str) -> None:
        put(uri, {"vocabulary": self.vocabulary, "patterns": self.patterns.astype(np.int64), "owners": self.owners.astype(np.int64), "sizes": self.sizes.astype(np.int64), "items": np.frombuffer(pickle.dumps(self.items), np.uint8)})

    @classmethod
    def load(cls, uri: str, run: int) -> Phrases:
        """What ``save`` wrote; arrays are views of the file."""
        data = get(uri)
        of = lambda name, kind, width=1: np.frombuffer(data[name], kind).reshape(*((-1, width) if width > 1 else (-1,)))
        return cls(of("vocabulary", np.uint64), of("patterns", np.int64, run), of("owners", np.int64, 3), pickle.loads(bytes(data["items"])), of("sizes", np.int64))


class Shard:
    """The FM-index of some texts. Its symbols are the words that any of the vocabularies has, all others are one; so one index serves
    the phrases of every pass."""

    def __init__(self, texts: list[str | None], vocabularies: Iterable[np.ndarray]):
        self.texts = len(texts)
        word, self.text = words(texts)
        self.index = None
        if not len(word):
            return
        own = np.unique(word)
        known = np.zeros(len(own), bool)
        for vocabulary in vocabularies:
            known |= np.isin(own, vocabulary, assume_unique=True)
        self.vocabulary = own[known]
        if not len(self.vocabulary):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == word, at + FIRST, OTHER)
        # a separator after each text; the position of a word in the indexed text
        self.place = np.arange(len(word)) + self.text
        t = np.full(len(word) + int(self.text[-1]) + 1, SEPARATOR, np.int32)
        t[self.place] = symbol
        t[-1] = END
        self.index = FMIndex(t, len(self.vocabulary) + FIRST)

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, offset in the item, word position in the text) of every occurrence of every phrase."""
        nothing = (np.zeros(0, np.int64),) * 4
        if self.index is None or not len(phrases.patterns):
            return nothing
        # the shard's symbols of the phrases' words; a phrase with a word the shard hasn't can't occur
        at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
        here = np.append(np.zeros(FIRST, np.int64), np.where(self.vocabulary[at] == phrases.vocabulary, at + FIRST, -1))
        asked = here[phrases.patterns]
        asked_at = np.flatnonzero((asked >= 0).all(1))
        low, high = self.index.search(asked[asked_at])
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return nothing
        count = (high - low)[hit]
        total = np.cumsum(count)
        rows = np.repeat(low[hit] - (total - count), count) + np.arange(total[-1])
        position = self.index.locate(rows)
        pattern = np.repeat(asked_at[hit], count)
        bounds = np.searchsorted(phrases.owners[:, 0], np.arange(len(phrases.patterns) + 1))
        owners = (bounds[1:] - bounds[:-1])[pattern]
        ends = np.cumsum(owners)
        pick = np.repeat(bounds[pattern] - (ends - owners), owners) + np.arange(ends[-1])
        position = np.repeat(position, owners)
        where = np.searchsorted(self.place, position)
        begins = np.searchsorted(self.text, np.arange(self.texts))
        return self.text[where], phrases.owners[pick, 1], phrases.owners[pick, 2], where - begins[self.text[where]]


def occurrences(phrases: Phrases, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The occurrences of the phrases in a shard of these texts."""
    return Shard(texts, [phrases.vocabulary]).occurrences(phrases)


def _union(group: np.ndarray, at: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end) of the merged stretches [at, at + run) of each group; touching stretches are merged."""
    if not len(at):
        return group, at, at
    order = np.lexsort((at, group))
    group, at = group[order], at[order]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (at[1:] > at[:-1] + run)])
    start = np.flatnonzero(new)
    return group[start], at[start], np.maximum.reduceat(at, start) + run


SCHEMA = "item_words int, found_words int, share double, spans array<struct<start:int,end:int>>, items_too_short long"


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "id", item_text: str = "expected", run: int = RUN, share: float = SHARE) -> DataFrame:
    """(key, item_id, item_words, found_words, share, spans, items_too_short) of each document and item where runs of ``run`` or more words of
    the item that occur in the document cover at least ``share`` of the item's words.

    ``spans`` are the merged stretches of the document to remove, as word positions from 0, end exclusive. Null, empty and wordless
    texts match nothing; an item of fewer than ``run`` words can't be found, and ``items_too_short`` says how many of those there are. Repeated
    documents are reported each, repeated items under each of their ids. Items are prepared ITEMS_PER_PASS at a time and left in the shared
    folder; a shard of the corpus is indexed once and takes one pass after the other from there.
    """
    spark = docs.sparkSession
    source = spread(docs.select(key, text))
    key_type, item_type = source.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    own = items.select(item_key, item_text).where(F.col(item_text).isNotNull())
    passes = -(-own.count() // ITEMS_PER_PASS) or 1
    folder, short = scratch(spark, "phrases"), 0
    for part in range(passes):
        rows = (own.where(F.pmod(F.xxhash64(item_text), F.lit(passes)) == part) if passes > 1 else own).collect()
        phrases = Phrases.of([r[0] for r in rows], [r[1] for r in rows], run)
        short += int((phrases.sizes < run).sum())
        phrases.save(f"{folder}/{part}")
    kind = to_arrow_type(item_type)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Phrases] = {}

        def of(part: int) -> Phrases:
            if part not in kept:
                if len(kept) >= 4:
                    kept.clear()
                kept[part] = Phrases.load(f"{folder}/{part}", run)
            return kept[part]

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                shard = Shard(texts[a:b], (of(p).vocabulary for p in range(passes)))
                for part in range(passes):
                    phrases = of(part)
                    doc, item, offset, position = shard.occurrences(phrases)
                    if not len(doc):
                        continue
                    pair = doc * len(phrases.items) + item
                    group, start, end = _union(pair, offset, run)
                    pairs, at = np.unique(group, return_inverse=True)
                    found = np.bincount(at, weights=end - start, minlength=len(pairs)).astype(np.int64)
                    size = phrases.sizes[pairs % len(phrases.items)]
                    good = found >= share * size
                    group, start, end = _union(pair, position, run)
                    chosen = good[np.searchsorted(pairs, group)]
                    counts = np.bincount(np.searchsorted(pairs[good], group[chosen]), minlength=int(good.sum()))
                    pairs, found, size = pairs[good], found[good], size[good]
                    spans = pa.StructArray.from_arrays([pa.array(start[chosen], pa.int32()), pa.array(end[chosen], pa.int32())], names=["start", "end"])
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, b - a).take(pa.array(pairs // len(phrases.items))),
                            pa.array([phrases.items[i] for i in (pairs % len(phrases.items)).tolist()], kind),
                            pa.array(size, pa.int32()),
                            pa.array(found, pa.int32()),
                            pa.array(found / np.maximum(size, 1)),
                            pa.ListArray.from_arrays(offsets, spans),
                            pa.array(np.full(len(pairs), short, np.int64)),
                        ],
                        names=[key, "item_id", "item_words", "found_words", "share", "spans", "items_too_short"],
                    )

    return source.mapInArrow(find, f"`{key}` {key_type}, item_id {item_type.simpleString()}, {SCHEMA}")
