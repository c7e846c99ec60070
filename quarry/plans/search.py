"""Hybrid search as one lazy plan: filters, three signals over the whole collection, fusion, explanation, top k."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalar import cleaned_query, detected_kind, query_terms
from quarry.operators.filters import Filters, allowed, browse
from quarry.operators.fusion import explained, fused, top
from quarry.operators.keyword import KeywordIndex, bm25, documents
from quarry.operators.signals import MATCH, finished_vectors, signals

T = TypeVar("T")
#: Embeds a cleaned query; None where a space has no encoder.
Encoder = Callable[[str], Sequence[float]]


@dataclass
class Response:
    """What a search returns. ``results`` is lazy and in order; ``candidates`` are all rows before the cut."""

    query: str
    embedded_query: str
    detected_type: str | None
    results: DataFrame
    candidates: DataFrame
    warnings: list[str] = field(default_factory=list)
    began: float = field(default_factory=time.perf_counter)

    def ms(self) -> int:
        """Milliseconds since the search began; asked after reading the results, the latency of the search."""
        return round(1000 * (time.perf_counter() - self.began))

    def total(self) -> int:
        return self.candidates.count()


def parsed(spark: SparkSession, query: str) -> tuple[str, str | None, list[str]]:
    """(text to embed, kind the query names, keyword terms)."""
    q = spark.sql("SELECT * FROM VALUES (:q) AS t(q)", args={"q": query})  # a local relation: the optimizer evaluates it, no job runs
    clean = q.select("q", cleaned_query(F.col("q")).alias("c"))
    r = clean.select("c", detected_kind(F.col("q")).alias("k"), query_terms(F.col("c")).alias("t")).first()
    return r["c"], r["k"], list(r["t"])


class HybridSearcher:
    """Searches a catalogue. Signal statistics always cover every finished asset; filters only decide what is shown."""

    def __init__(self, assets: DataFrame, files: DataFrame, vectors: DataFrame, clip: Encoder | None = None, text: Encoder | None = None, stems: bool = True):
        self.assets, self.files, self.vectors = assets, files, vectors
        self.clip, self.text, self.stems = clip, text, stems
        self._version: str | None = None
        self._kept: DataFrame | None = None
        self.keywords: KeywordIndex | None = None

    def keep_fresh(self, version: str, read: Callable[[], DataFrame], path: str | None = None) -> None:
        """Hold the finished vectors in memory, and with ``path`` the keyword postings there, until ``version`` changes; then make them anew."""
        if version == self._version:
            return
        if path:
            self.keywords = KeywordIndex(documents(self.assets, self.files), f"{path}/{version}", stems=self.stems)
        if self._kept is not None:
            self._kept.unpersist()
        self.vectors = read()
        self._kept = self._finished().persist()
        self._version = version

    def _finished(self) -> DataFrame:
        return finished_vectors(self.vectors, self.assets, "clip", "text").select("id", "hash", "space", *MATCH, "vec")

    def search(self, query: str | None, filters: Filters | None = None, top_k: int = 24, clip_vec: Sequence[float] | None = None, text_vec: Sequence[float] | None = None) -> Response:
        """A null or blank query browses: newest first, no scores. A kinds filter switches the guessed kind off. A signal that fails is a
        warning, and the others still rank. top_k: 1 to 200."""
        if not 1 <= top_k <= 200:
            raise ValueError("top_k must be from 1 to 200")
        began = time.perf_counter()
        filters = filters or Filters()
        found = allowed(self.assets, self.files, filters)
        query = (query or "").strip()
        if not query:
            return Response("", "", None, browse(found, top_k), found, began=began)
        clean, kind, terms = parsed(self.assets.sparkSession, query)
        if filters.kinds:
            kind = None
        warnings: list[str] = []

        def tried(name: str, make: Callable[[], T]) -> T | None:
            try:
                return make()
            except Exception as e:  # noqa: BLE001
                warnings.append(f"{name} search unavailable: {e}")
                return None

        def asked(given: Sequence[float] | None, encode: Encoder | None) -> Sequence[float]:
            if given is None and encode is None:
                raise RuntimeError("no encoder")
            return encode(clean) if given is None else given

        near = {n: (space, v) for n, space, v in (("visual", "clip", tried("visual", lambda: asked(clip_vec, self.clip))), ("semantic", "text", tried("text", lambda: asked(text_vec, self.text)))) if v is not None}
        rows = self._finished() if self._kept is None else self._kept
        rank = self.keywords.search if self.keywords else lambda t: bm25(documents(self.assets, self.files), t, stems=self.stems)
        keyword = tried("keyword", lambda: rank(terms)) if terms else None
        rows = explained(fused(found, signals(rows, near) if near else None, keyword, kind))
        return Response(query, clean, kind, top(rows, top_k), rows, warnings, began)
