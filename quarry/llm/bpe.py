"""Problem 8: the whole corpus as token ids of a public byte-level BPE vocabulary.

Texts are cut into pre-tokens by classes of code points, in one numpy pass over a batch. The distinct pre-tokens that a worker
hasn't met are encoded together: their symbols lie in one flat array, and in each round every word merges its pair of lowest rank,
found by binary search over the sorted pair keys. The ids come out as one Arrow list array; no token is ever a Python object of a row.

A null text and an empty text give the empty list. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.session import spread

from .codepoints import chunks, codepoints, list_array

#: Where the vocabulary files are; a parameter of every function here.
TOKENIZERS = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")
#: Symbols from which a single pre-token is merged with a heap instead of in rounds: the rounds' cost is its length times its merges.
LONG = 256
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@cache
def class_table() -> np.ndarray:
    """The class of every code point, by the properties the vocabulary's own pattern names."""
    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = value
    table[0xD800:0xE000] = OTHER
    return table


def pretoken_starts(cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the joined texts; ``rows``: where each text begins."""
    n = len(cps)
    kind = class_table()[cps]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # a run of white space leaves its last character to what follows, if anything follows in the text
    space = kind == SPACE
    last = np.flatnonzero(space & start[1:] & ~first[1:])
    start[last] = True
    joined = last[cps[last] == 32]
    start[joined + 1] = False
    # 's 't 're 've 'm 'll 'd where an apostrophe opens a pre-token
    at = np.flatnonzero((cps == 39) & start[:n])
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    one = np.append(cps, 0)[at + 1]
    two = np.append(cps, [0, 0])[at + 2]
    inner = ~first[np.minimum(at + 2, n)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = inner & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for hit, size in ((at[short], 2), (at[long], 3)):
        start[hit + 1] = False
        if size == 3:
            start[hit + 2] = False
        start[hit + size] = True
    return np.flatnonzero(start[:n])


class Vocabulary:
    """Pairs that merge, as sorted keys with their rank and result; ids of pre-tokens already met."""

    #: Pre-tokens a worker remembers before it starts afresh. A bound on memory only.
    REMEMBERED = 400_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        glyph = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.byte = np.array([ids[glyph[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], np.arange(len(pairs))[order]
        self.result = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = [0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], np.iinfo(np.int64).max)

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        none = np.iinfo(np.int64).max
        symbols = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_word = [], []
        while len(symbols):
            rank = np.full(len(symbols), none)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(symbols)))
            live = np.repeat(best != none, size)
            done_symbols.append(symbols[~live])
            done_word.append(word[~live])
            symbols, word, rank = symbols[live], word[live], rank[live]
            if not len(symbols):
                break
            hit = rank == np.repeat(best[best != none], size[best != none])
            # in a run of overlapping hits every second one merges
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            since = np.arange(len(hit))
            since = since - since[run][np.cumsum(hit & ~np.concatenate([[False], hit[:-1]])) - 1] if len(run) else since
            hit &= since % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.result[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def long(self, data: bytes) -> np.ndarray:
        """One very long pre-token: a heap over its pairs, length times its logarithm."""
        symbols = self.byte[np.frombuffer(data, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True)) if not hasattr(self, "table") else self.table
        self.table = table
        first = self.ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r != np.iinfo(np.int64).max]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if symbols[i] >= 0 else n
            if j >= n or table.get(symbols[i] << 32 | symbols[j]) != r:
                continue
            symbols[i], symbols[j] = int(self.result[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (q := table.get(symbols[a] << 32 | symbols[after[a]])) is not None:
                    heapq.heappush(heap, (q, a))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def learn(self, words: list[str]) -> None:
        """Append the ids of pre-tokens not met before."""
        data = [w.encode() for w in words]
        short = [i for i, w in enumerate(data) if len(w) <= LONG]
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(data)
        if short:
            ids, sizes = self.rounds([data[i] for i in short])
            for i, part in zip(short, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                parts[i] = part
        for i, w in enumerate(data):
            if len(w) > LONG:
                parts[i] = self.long(w)
        end = self.ends[-1]
        need = end + sum(map(len, parts))
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[:end], np.zeros(2 * need, np.int32)])
        self.flat[end:need] = np.concatenate(parts)
        self.ends.extend((end + np.cumsum([len(p) for p in parts])).tolist())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in a row)."""
        if len(self.seen) > self.REMEMBERED:
            self.forget()
        joined = "".join(t for t in texts if t)
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        if not joined:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[sizes > 0]
        starts = pretoken_starts(codepoints(joined), begins)
        bounds = np.append(starts, len(joined)).tolist()
        words = [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        seen = self.seen
        fresh = list(dict.fromkeys(w for w in words if w not in seen))
        if fresh:
            base = len(seen)
            self.learn(fresh)
            seen.update((w, base + i) for i, w in enumerate(fresh))
        at = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        edge = np.asarray(self.ends)
        low, count = edge[at], edge[at + 1] - edge[at]
        total = np.cumsum(count)
        flat = self.flat[np.repeat(low - (total - count), count) + np.arange(total[-1])]
        owner = np.searchsorted(ends, starts, side="right")
        return np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64), flat


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row of ``docs``; other columns are not read. Null and empty texts: the empty list. A null key stays null."""
    path = f"{folder}/{name}.json"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                counts, flat = vocab.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_array(offsets, pa.array(flat, pa.int32()))], names=[key, "ids"])

    source = spread(docs.select(key, text))
    return source.mapInArrow(encode, f"`{key}` {source.schema[key].dataType.simpleString()}, ids array<int>")
