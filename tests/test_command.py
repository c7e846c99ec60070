"""The command line over the smallest tables."""

from __future__ import annotations

import os

import pytest

from quarry.__main__ import main

DATA = os.environ.get("QUARRY_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def said(spark, *args):
    out: list[str] = []
    assert main(["--tables", DATA, *args], spark, out.append) == 0
    return out


def test_reports(spark):
    assert said(spark, "stats")[0].startswith("# Dataset summary")
    assert all(line.count("\t") == 2 for line in said(spark, "failures"))


def test_search(spark):
    rows = said(spark, "search", "images showing the sharp catalogue", "--top-k", "3", "--kinds", "image,pdf")
    assert len(rows) == 3 and all('"kind": "video"' not in r for r in rows)
    assert said(spark, "search", "sharp")[0].startswith("warning: ")


def test_export(spark, tmp_path):
    text = said(spark, "eval-export", "--out", str(tmp_path / "out"), "--ids", "1,2")[0]
    assert "| Queries | 2 |" in text and (tmp_path / "out" / "RESULTS.md").exists()
