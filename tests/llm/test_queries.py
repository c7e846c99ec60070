"""Every query of the subpackage on the smallest tables: it runs over whole tables and has the columns it is to have."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from quarry.llm.queries import queries

DATA = Path(os.environ.get("QUARRY_TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
COLUMNS = {
    "p1_found": {"hash", "ref"}, "p2_found": {"hash", "defect"}, "p3_found": {"hash"}, "p4_found": {"id_a", "id_b"}, "p5_found": {"id_a", "id_b"}, "p8_ids": {"doc_id", "ids"},
    "p9_found": {"doc_id", "item_id"}, "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    df = queries()[name](spark, str(DATA))
    rows = df.count()
    assert name not in COLUMNS or set(df.columns) == COLUMNS[name]
    if name in ("p8_ids", "p10_shares"):
        assert rows == spark.read.parquet(str(DATA / "documents.parquet")).count()
