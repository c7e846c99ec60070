"""Problem 1: cutting oversized pages into pieces at natural boundaries, with overlap.

Each page gets an array of boundary strengths. A sparse table over it answers "the strongest boundary in this window, the rightmost of
equals" in constant time; a piece ends at the answer for the window of permissible lengths, and the next piece begins at the answer for
the window of permissible overlaps.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

from .codepoints import codepoints

#: Strengths of a cut before a position: within a character, anywhere, between words, after a clause, after a sentence, after a paragraph.
INSIDE, ANYWHERE, WORD, CLAUSE, SENTENCE, PARAGRAPH = range(6)
NAMES = np.array(["inside", "anywhere", "word", "clause", "sentence", "paragraph"])
LIMIT, OVERLAP, LEAST_OVERLAP = 900, 90, 40
_BLANK = re.compile(r"[ \t\r\n]+")
_CLOSERS = "\"'”’»)]"
PIECE = "page_chars int, piece int, pieces int, start int, end int, boundary string, text string"


class StrongestCut:
    """Range-maximum index: level k holds the best of each 2**k positions. Ties go to the right."""

    def __init__(self, strength: np.ndarray, widest: int):
        n = len(strength)
        key = strength.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels = n, [key]
        step = 1
        while 2 * step <= min(widest, n):
            key = np.maximum(key[:-step], key[step:])
            self.levels.append(key)
            step *= 2

    def query(self, low: int, high: int) -> int:
        """The position of the strongest boundary in [low, high]."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1])) % (self.n + 1)


def normalised(page: str) -> tuple[str, set[int]]:
    """The page with runs of blanks, tabs, CR and LF as one blank, trimmed; and the positions where a paragraph begins."""
    text, paragraphs, size = [], set(), 0
    at = 0
    for m in _BLANK.finditer(page):
        text.append(page[at : m.start()])
        size += m.start() - at
        if size:
            text.append(" ")
            size += 1
            if m.group().count("\n") > 1:
                paragraphs.add(size)
        at = m.end()
    text.append(page[at:])
    return "".join(text).rstrip(" "), paragraphs


def strengths(text: str, paragraphs: set[int]) -> np.ndarray:
    """Entry i: the strength of a cut before character i. A cut between words lies before the blank."""
    n = len(text)
    cps = codepoints(text)
    s = np.full(n + 1, ANYWHERE, np.int8)
    odd = np.flatnonzero(cps > 0x2FF)
    for i in odd:
        if unicodedata.combining(text[i]) or text[i] in "‍️" or (i and text[i - 1] == "‍"):
            s[i] = INSIDE
        elif i and text[i - 1] in "。！？":
            s[i] = SENTENCE
        elif i and text[i - 1] in "、，；：":
            s[i] = CLAUSE
    blank = np.flatnonzero(cps == 32)
    s[blank] = WORD
    for i in blank.tolist():
        j = i - 1
        while j > 0 and text[j] in _CLOSERS:
            j -= 1
        if text[j] in ".!?…":
            s[i] = SENTENCE
        elif text[j] in ",;:|–—":
            s[i] = CLAUSE
    for i in paragraphs:
        if i - 1 < n:
            s[i - 1] = PARAGRAPH
    return s


def pieces(text: str, paragraphs: set[int], limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST_OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece; the first starts at 0, the last ends with the text.

    Pieces are at most ``limit`` long; a piece ends in the later half of what is allowed, or before it where only there is a boundary
    between words. Consecutive pieces share ``least`` to ``overlap`` characters. A text within the limit is one piece, an empty text none.
    """
    if not 0 <= least <= overlap < limit // 2:
        raise ValueError("need 0 <= least <= overlap < limit // 2")
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, n, PARAGRAPH)]
    strength = strengths(text, paragraphs)
    ends = StrongestCut(strength, limit)
    begin = np.where(np.concatenate([[0], strength[:-1]]) >= WORD, np.concatenate([[0], strength[:-1]]), np.minimum(strength, ANYWHERE))
    starts = StrongestCut(begin, overlap)  # the strength of beginning at i: of the cut at the blank before it
    out, at = [], 0
    while n - at > limit:
        end = ends.query(at + (limit + 1) // 2, at + limit)
        if strength[end] < WORD:  # the next piece still has to begin behind this one's begin
            early = ends.query(at + overlap + 1, at + (limit + 1) // 2)
            end = early if strength[early] >= WORD else end
        out.append((at, end, int(strength[end])))
        at = starts.query(end - overlap, end - least)
        if text[at] == " ":
            at += 1
    out.append((at, n, PARAGRAPH))
    return out


def split_pages(assets: DataFrame, key: str = "hash", body: str = "body", limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST_OVERLAP) -> DataFrame:
    """One row per piece of every page of every body: (key, ref = page from 1, page_chars, piece from 1, pieces, start, end, boundary, text).

    A body is cut at form feeds and empty pages count. Lengths and positions are code points of the normalised page. Null and blank
    pages give no piece. A repeated key is split as often as it occurs. Other columns are not read.
    """
    source = assets.where(F.col(body).isNotNull()).select(key, body)
    key_type = source.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "ref", "page_chars", "piece", "pieces", "start", "end", "boundary", "text"]
        kinds = [None, pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            keys = batch.column(0)
            for i, value in enumerate(batch.column(1)):
                for ref, page in enumerate(value.as_py().split("\f"), 1):
                    text, paragraphs = normalised(page)
                    cuts = pieces(text, paragraphs, limit, overlap, least)
                    for k, (a, b, strength) in enumerate(cuts, 1):
                        for column, x in zip(rows, (i, ref, len(text), k, len(cuts), a, b, NAMES[strength], text[a:b]), strict=True):
                            column.append(x)
                        held += b - a
                if held > 1 << 24 or i == len(keys) - 1:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[0], pa.int32())), *(pa.array(r, t) for r, t in zip(rows[1:], kinds[1:], strict=True))], names=names)
                    rows, held = [[] for _ in names], 0

    return spread(source).mapInArrow(split, f"`{key}` {key_type}, ref long, {PIECE}")


def oversized_pages(cut: DataFrame, key: str = "hash") -> DataFrame:
    """(key, ref) of the pages that had to be cut, each known from its second piece: only a page over the limit has one, and nothing is
    shuffled."""
    return cut.where(F.col("piece") == 2).select(key, "ref")
