"""Quarry: search, indexing and corpus preparation over a media catalogue, as Spark plans."""

__version__ = "0.1.0"
