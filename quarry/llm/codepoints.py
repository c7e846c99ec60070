"""Text as arrays of code points: the ground the vectorised text operators share.

Texts of a batch are joined into one array, so that one numpy pass serves thousands of short texts or one very long one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters handled in one numpy pass. Only a bound on memory: longer texts make longer passes, whole.
CHUNK_CHARS = 2_000_000


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each; a longer text stands alone and whole."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


@cache
def letter_table() -> np.ndarray:
    """True at every code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@cache
def lower_table() -> np.ndarray:
    """The lower-case form of every code point that has one of a single character."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1E944):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64."""
    r = 0x9E3779B97F4A7C15
    inverse = pow(r, -1, 1 << 64)
    def series(x: int) -> np.ndarray:
        a = np.full(n, x, np.uint64)
        a[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(a, dtype=np.uint64)

    return series(r), series(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def run_hashes(kept: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; ``kept`` holds the code points of all words, ``starts`` where each begins."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(16, int(len(kept)).bit_length())
    up, down = powers(size)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(kept) * up[: len(kept)], starts)
        return mix(sums * down[starts])


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), values)
