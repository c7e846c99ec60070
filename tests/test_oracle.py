"""Every query with SQL against that SQL on the smallest tables; the others must run."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

DATA = Path(os.environ.get("QUARRY_TESTDATA", "/root/testdata/sf0.001"))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 9) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("p") or not n[1:2].isdigit() or n in SQL])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in SQL:
        assert df.schema
        return
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
