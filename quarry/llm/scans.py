"""Problem 2: noise in the text of scanned pages.

Words of all PDF bodies are counted; a rare word is linked to a frequent one when plausible glyph edits turn the frequent one into it, which
an equi-join on a skeleton (look-alike glyphs made equal) finds without comparing pairs. Skip-gram vectors are learned over all these bodies
(``skipgram``); a link is a correction only if both words stand among neighbours whose vectors agree, the more strictly the more often the
rare word was met. A body shows misread characters if it has a word with a correction. Then running headers and page numbers are
removed, words split over line ends are joined, and lines are reflowed into paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import spread, written

from .skipgram import DIMS, WINDOW, Vectors, indexed, learn

#: A frequent word occurs in at least this many bodies, and in this many times the bodies of the rare word.
FREQUENT, RATIO = 4, 8.0
#: The neighbours of a rare word and of its correction have vectors with a cosine of 1 - UNLIKE / sqrt(bodies of the rare word) at least.
UNLIKE = 0.45

# Glyphs that recognition confuses, what is printed and what is read.
GLYPHS = (("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("s", "5"), ("g", "9"), ("b", "8"), ("z", "2"), ("e", "c"), ("h", "b"), ("a", "o"), ("t", "f"), ("d", "cl"), ("m", "rn"), ("w", "vv"), ("n", "ri"), ("u", "ii"))
#: Words after which a hyphen at a line end is a suspended one.
SUSPENDED = {"and", "or", "und", "oder", "bzw", "et", "ou", "y", "o", "e", "u", "to", "bis"}

_HYPHENS = "-¬­‐‑"
# a hyphen between letters at a line end, with the white space around the line end; group 1 is the word that goes on
_SPLIT = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t]*\r?\n[ \t]*(?=([^\W\d_]+))")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"^[\W_]*(?:(?:page|seite|página|pagina|p|s)\b\.?\s*)?([\dOolI]{1,4}|[ivxlc]{1,7})(?:\s*(?:/|of|von|de|sur)\s*[\dOolI]{1,4})?[\W_]*$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


@lru_cache(maxsize=1 << 18)
def skeleton(word: str) -> str:
    """The word with look-alike glyphs made equal."""
    for printed, read in GLYPHS:
        if len(read) > 1:
            word = word.replace(read, printed)
    return word.translate(_CLASSES)


def _classes() -> dict[int, str]:
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for printed, read in GLYPHS:
        if len(read) == 1:
            parent[root(read)] = root(printed)
    return {ord(c): root(c) for c in {c for pair in GLYPHS for c in pair if len(c) == 1}}


_CLASSES = _classes()


def misread(frequent: str, rare: str) -> int:
    """The number of glyph edits that turn ``frequent`` into ``rare``; 0 if none do."""
    best = {(0, 0): 0}
    for i in range(len(frequent) + 1):
        for j in range(len(rare) + 1):
            if (i, j) not in best:
                continue
            cost = best[i, j]
            if i < len(frequent) and j < len(rare) and frequent[i] == rare[j]:
                best[i + 1, j + 1] = min(best.get((i + 1, j + 1), 99), cost)
            for printed, read in GLYPHS:
                if frequent.startswith(printed, i) and rare.startswith(read, j):
                    to = (i + len(printed), j + len(read))
                    best[to] = min(best.get(to, 99), cost + 1)
    return best.get((len(frequent), len(rare)), 0)


def _value(line: str) -> tuple[int, bool] | None:
    """(the page number a line prints, roman) or None."""
    m = _NUMBER.match(line)
    if not m:
        return None
    token = m[1].lower()
    if re.fullmatch(r"[ivxlc]+", token) and m[1] != "l":
        values = [_ROMAN[c] for c in token]
        return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0], strict=True)), True
    digits = token.translate(str.maketrans("oli", "011"))
    return (int(digits), False) if digits.isdigit() else None


def _header_key(line: str) -> str:
    return skeleton("".join(c for c in line.lower() if c.isalpha() or c in "01589"))


def furniture(pages: list[list[str]]) -> tuple[set[tuple[int, int]], bool, bool]:
    """(the (page, line) positions of furniture, whether there is a running header, whether page numbers are printed).

    A running header is a line among the first two or last two of a page that recurs, misreadings aside, on two or more pages and on more
    than half of them; or, where left and right pages have their own, on more than half of the pages of one side, if such lines together stand on
    more than half of all. Page numbers count up with the pages, on two or more and on more than half of them.
    """
    edges: list[dict[int, str]] = []
    for lines in pages:
        filled = [i for i, x in enumerate(lines) if x.strip()]
        edges.append({i: lines[i].strip() for i in {*filled[:2], *filled[-2:]}})
    drop: set[tuple[int, int]] = set()
    numbers: dict[tuple[int, bool], set[tuple[int, int]]] = {}
    for p, lines in enumerate(edges):
        for i, line in lines.items():
            if (v := _value(line)) is not None:
                numbers.setdefault((v[0] - p, v[1]), set()).add((p, i))
    counted: set[tuple[int, int]] = set()
    some = sum(1 for e in edges if e)
    for places in numbers.values():
        covered = {p for p, _ in places}
        if len(covered) >= 2 and len(covered) > some / 2:
            counted |= places
    if some == 1 and not counted:  # a single page: its number stands alone at an edge, and not in a column of numbers
        p = next(i for i, e in enumerate(edges) if e)
        filled = [i for i, x in enumerate(pages[p]) if x.strip()]
        for i in ({filled[-1], filled[0]} if len(filled) > 2 else ()):
            inner = filled[-2] if i == filled[-1] else filled[1]
            deeper = filled[-3] if i == filled[-1] else filled[2]
            if _value(pages[p][i].strip()) and not (_value(pages[p][deeper].strip()) or len(_WORD.findall(pages[p][inner])) < 2 and not re.search(r"[.!?]\W*$", pages[p][inner])):
                counted.add((p, i))
    where: dict[str, set[tuple[int, int]]] = {}
    for p, lines in enumerate(edges):
        for i, line in lines.items():
            if (p, i) in counted or len(line) > 80:
                continue
            key = _header_key(line)
            if len(key) >= 4:
                where.setdefault(key, set()).add((p, i))
    header: set[tuple[int, int]] = set()
    sides = [sum(1 for p, e in enumerate(edges) if e and p % 2 == side) for side in range(2)]
    sided: set[tuple[int, int]] = set()
    for places in where.values():
        met = {p for p, _ in places}
        side = next(iter(met)) % 2
        if len(met) >= 2 and len(met) > some / 2:
            header |= places
        elif len(met) >= 2 and all(p % 2 == side for p in met) and len(met) > sides[side] / 2:
            sided |= places
    if len({p for p, _ in header | sided}) > some / 2:
        header |= sided
    drop = counted | header
    return drop, bool(header), bool(counted)


def _joined(m: re.Match) -> str:
    return m[0] if m[1].lower() in SUSPENDED else ""


def hyphens(text: str) -> int:
    """Words split over a line end by a hyphen-like mark."""
    return sum(m[1].lower() not in SUSPENDED and m[1][0].islower() for m in _SPLIT.finditer(text))


def clean(body: str) -> tuple[str, int, bool, bool]:
    """(text of the body without furniture and split words, split words, header, page numbers)."""
    pages = [p.split("\n") for p in body.split("\f")]
    drop, header, pageno = furniture(pages)
    text = "\n".join(line for p, lines in enumerate(pages) for i, line in enumerate(lines) if (p, i) not in drop)
    return _SPLIT.sub(_joined, text), hyphens(body), header, pageno


@F.pandas_udf(T.StringType())
def _skeletons(words: pd.Series) -> pd.Series:
    return words.map(skeleton)


@F.pandas_udf(T.IntegerType())
def _edits(fix: pd.Series, word: pd.Series) -> pd.Series:
    return fix.combine(word, misread)


def survey(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, hyphen, header, pageno, words, tokens): what a body shows by itself; its distinct words, lower-case, in which a leading '^' marks a
    word only met capitalised; and all its words in order, lower-case, parted by blanks."""
    kind = bodies.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                text, split, header, pageno = clean(value)
                words = _WORD.findall(text)
                if words and text.rstrip().endswith(words[-1]):
                    words.pop()  # a body may be cut inside its last word
                met = set(words)
                tokens = " ".join(words).lower()
                lower = {w for w in met if not w[0].isupper()}
                rows.append((split, header, pageno, [*lower, *{"^" + w.lower() for w in met if w[0].isupper() and w.lower() not in lower}], tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.list_(pa.string())), pa.array([r[4] for r in rows], pa.string())],
                names=[key, "hyphen", "header", "pageno", "words", "tokens"],
            )

    return bodies.mapInArrow(run, f"`{key}` {kind}, hyphen int, header boolean, pageno boolean, words array<string>, tokens string")


def contexts(texts: DataFrame, tokens: str, vectors: Vectors, chance: dict[str, float]) -> DataFrame:
    """(word, v0 ... ): of every word of all texts, the sum of its neighbours' vectors; frequent neighbours count less."""
    columns = [f"v{i}" for i in range(DIMS)]
    sent = texts.sparkSession.sparkContext.broadcast((vectors, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, chance = sent.value
        for batch in batches:
            words, t = indexed(batch.column(0).to_pylist())
            if not words:
                continue
            base = vectors.of(words, "around") * np.array([chance.get(w, 1.0) for w in words], np.float32)[:, None]
            base = np.concatenate([base, np.zeros((1, DIMS), np.float32)])
            around = np.zeros((len(t), DIMS), np.float32)
            for d in range(1, WINDOW + 1):
                around[d:] += base[t[:-d]]
                around[:-d] += base[t[d:]]
            real = t >= 0
            order = np.argsort(t[real], kind="stable")
            begin = np.searchsorted(t[real][order], np.arange(len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(words), *(pa.array(c) for c in np.add.reduceat(around[real][order], begin).T)], names=["word", *columns])

    return texts.select(tokens).mapInArrow(run, "word string, " + ", ".join(f"{c} float" for c in columns)).groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))


def corrections(surveyed: DataFrame) -> DataFrame:
    """(word, fix, edits, likeness): rare words that are misread frequent ones. One fix for a word: most alike in context, then most
    frequent, then first in the alphabet."""
    met = surveyed.select(F.explode("words").alias("w"))
    counted = met.groupBy("w").agg(F.count("*").alias("n"))
    vocabulary = written(
        counted.select(F.ltrim(F.col("w"), F.lit("^")).alias("word"), "n", F.when(F.col("w").startswith("^"), 0).otherwise(F.col("n")).alias("lower"))
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("lower").alias("lower"))
        .where(F.length("word") >= 3)
        .withColumn("skeleton", _skeletons("word")),
        "vocabulary",
    )
    rare = vocabulary.where(F.col("word").rlike(r"\p{L}.*\p{L}")).select(F.col("word"), F.col("n").alias("few"), F.col("lower").alias("few_lower"), "skeleton")
    frequent = vocabulary.where((F.col("n") >= FREQUENT) & ~F.col("word").rlike("[0-9]")).select(F.col("word").alias("fix"), F.col("n").alias("many"), F.col("lower").alias("many_lower"), "skeleton")
    links = rare.join(frequent, "skeleton").where((F.col("word") != F.col("fix")) & (F.col("many") >= RATIO * F.col("few")))
    links = links.withColumn("edits", _edits("fix", "word")).where("edits > 0")
    around = written(contexts(surveyed, "tokens", *learn(surveyed, "tokens")), "contexts")
    names = [f"v{i}" for i in range(DIMS)]
    a = around.select(F.col("word"), F.array(*names).alias("a"))
    b = around.select(F.col("word").alias("fix"), F.array(*names).alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    scored = links.join(a, "word", "left").join(b, "fix", "left").withColumn("likeness", F.coalesce(F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a") * dot("b", "b"))), F.lit(0.0)))
    # a name differs from another by a letter as easily as by a misreading: only digits and doubled glyphs tell there
    name = (F.col("few_lower") == 0) & (F.col("many_lower") == 0)
    good = scored.where((F.col("likeness") >= 1 - UNLIKE / F.sqrt("few")) & (~name | F.col("word").rlike("[0-9]") | (F.col("many") >= 4 * RATIO * F.col("few"))))
    return good.groupBy("word").agg(F.max(F.struct("likeness", "many", "edits", "fix")).alias("x")).select("word", "x.fix", "x.edits", "x.likeness")


class Scans:
    """The noise of all scanned bodies: what each shows, the corrections, and the repaired text.

    Null and blank bodies show nothing and have no row. Repeated keys are handled each; other columns aren't read.
    """

    def __init__(self, assets: DataFrame, key: str = "hash", body: str = "body"):
        self.key, self.body = key, body
        self.bodies = spread(assets.where((F.col("kind") == "pdf") & F.col(body).isNotNull() & (F.length(F.trim(F.col(body))) > 0)).select(key, body))
        self.surveyed = written(survey(self.bodies, key, body), "scan-survey")
        self.corrections = written(corrections(self.surveyed), "scan-corrections")
        words = self.surveyed.select(key, F.explode("words").alias("w")).select(key, F.ltrim(F.col("w"), F.lit("^")).alias("word"))
        self.fixes = words.join(self.corrections, "word").groupBy(key).agg(F.collect_set(F.struct("word", "fix")).alias("fixes"))

    def defects(self) -> DataFrame:
        """(key, defect): hyphen, char, header, pageno, one row each that the body shows."""
        s, k = self.surveyed, self.key
        own = [s.where(c).select(k, F.lit(d).alias("defect")) for d, c in (("hyphen", F.col("hyphen") > 0), ("header", F.col("header")), ("pageno", F.col("pageno")))]
        char = self.fixes.select(k, F.lit("char").alias("defect"))
        return own[0].unionByName(own[1]).unionByName(own[2]).unionByName(char).distinct()

    def texts(self) -> DataFrame:
        """(key, paragraphs, text, fixed): each body as continuous paragraphs, and the number of distinct misread words put right."""
        k = self.key
        known = self.fixes.select(F.col(k).alias("_k"), F.map_from_entries("fixes").alias("fixes"))
        rows = self.bodies.join(known, F.col(k) == F.col("_k"), "left").select(k, self.body, "fixes")
        kind = self.bodies.schema[k].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [repaired(v, dict(f or ())) for v, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([t.count("\n\n") + 1 for t, _ in out], pa.int32()), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], names=[k, "paragraphs", "text", "fixed"]
                )

        return rows.mapInArrow(run, f"`{k}` {kind}, paragraphs int, text string, fixed int")

    def labels(self, vectors: DataFrame) -> DataFrame:
        """(id, label): the labels of the vectors of these bodies, split and misread words put right; a null label stays null."""
        known = self.fixes.select(F.col(self.key).alias("_k"), F.map_from_entries("fixes").alias("fixes"))
        rows = vectors.where(F.col("source").isin("page", "pdf_text", "pdf_summary")).select("id", "hash", "label").join(self.bodies.select(F.col(self.key).alias("_b")), F.col("hash") == F.col("_b"), "left_semi")
        rows = rows.join(known, F.col("hash") == F.col("_k"), "left").select("id", "label", "fixes")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [None if v is None else _fix(_LABEL_SPLIT.sub(_joined, v), dict(f or ()))[0] for v, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "label"])

        return rows.mapInArrow(run, "id long, label string")


_LABEL_SPLIT = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t]+(?=([^\W\d_]+))")


def _fix(text: str, fixes: dict[str, str]) -> tuple[str, int]:
    if not fixes:
        return text, 0
    done = set()

    def one(m: re.Match) -> str:
        w = m[0]
        fix = fixes.get(w.lower())
        if fix is None:
            return w
        done.add(w.lower())
        return fix.upper() if w.isupper() and len(w) > 1 else fix[:1].upper() + fix[1:] if w[0].isupper() else fix

    return _WORD.sub(one, text), len(done)


def repaired(body: str, fixes: dict[str, str]) -> tuple[str, int]:
    """(the body as paragraphs parted by blank lines, words put right)."""
    pages = [p.split("\n") for p in body.split("\f")]
    drop, _, _ = furniture(pages)
    kept = []
    for p, lines in enumerate(pages):
        page = [line for i, line in enumerate(lines) if (p, i) not in drop]
        if kept and page:
            # a page break inside a sentence is no paragraph
            before = next((x for x in reversed(kept) if x.strip()), "")
            if re.search(r"[.!?:…][\"'”’»)\]]*\s*$", before):
                kept.append("")
            else:
                while kept and not kept[-1].strip():
                    kept.pop()
                while page and not page[0].strip():
                    page.pop(0)
        kept += page
    text = _SPLIT.sub(_joined, "\n".join(kept))
    text, n = _fix(text, fixes)
    out = []
    for block in re.split(r"\n[ \t\r]*\n", text):
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        run: list[str] = []
        for line in lines:
            if re.match(r"(?:[-*•–]|\d+[.)])\s", line) and run:
                out.append(" ".join(run))
                run = []
            run.append(line)
        if run:
            out.append(" ".join(run))
    return "\n\n".join(re.sub(r"[ \t]+", " ", x) for x in out), n
