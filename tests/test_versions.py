"""Versioned tables and incremental work."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_core import ASSETS, FILES, LISTING, asset, file, sighting

from quarry.operators.incremental import Ledger, work_since
from quarry.operators.versions import FILE, PLACE, Conflict, VersionedTable, process_new
from quarry.session import scratch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_come_from_manifests(spark):
    table = VersionedTable(spark, scratch(spark, "t"))
    one = table.commit(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"))
    gone = table.snapshot(places=True).where("k = 2")
    two = table.commit(spark.createDataFrame([(2, "B"), (4, "d")], "k int, v string"), gone.select(FILE, PLACE))
    assert rows(table.snapshot(one)) == [(1, "a"), (2, "b"), (3, "c")] and rows(table.snapshot()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert rows(table.changes(one, two).select("_change", "k", "v")) == [("delete", 2, "b"), ("insert", 2, "B"), ("insert", 4, "d")]
    assert rows(table.changes(0, two).select("_change", "k", "v")) == [("insert", *x) for x in rows(table.snapshot())]
    three = table.commit(removed=[f for f in table.manifest(two)["files"] if f in table.manifest(one)["files"]])
    assert rows(table.changes(two, three).select("_change", "k")) == [("delete", 1), ("delete", 3)]
    assert table.changes(three, three).count() == 0
    with pytest.raises(Conflict):
        table.commit(base=one)
    assert table.vacuum(three) == 0 and table.vacuum(three, hours=0) >= 1 and rows(table.snapshot()) == [(2, "B"), (4, "d")]


def test_output_and_progress_commit_together(spark):
    source, output = VersionedTable(spark, scratch(spark, "s")), VersionedTable(spark, scratch(spark, "o"))
    source.commit(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"))
    upper = lambda df: df.select("k", F.concat("v", F.lit("!")).alias("v"))
    assert process_new(source, output, upper, ["k"]) == (0, 1)
    source.commit(spark.createDataFrame([(3, "c")], "k int, v string"))

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(source, output, broken, ["k"])
    assert output.manifest(output.version())["notes"]["processed"] == 1
    assert process_new(source, output, upper, ["k"]) == (1, 2) and process_new(source, output, broken, ["k"]) == (2, 2)
    assert sorted(x["v"] for x in output.snapshot().collect()) == ["a!", "b!", "c!", "n!"]
    # changed and deleted records leave nothing stale, null keys neither
    source.commit(spark.createDataFrame([(1, "A"), (None, "N")], "k int, v string"), source.snapshot(places=True).where("k = 1 or k = 3 or k is null").select(FILE, PLACE))
    process_new(source, output, upper, ["k"])
    assert sorted(x["v"] for x in output.snapshot().collect()) == ["A!", "N!", "b!"]


def test_compaction_changes_no_row(spark):
    source, output = VersionedTable(spark, scratch(spark, "s")), VersionedTable(spark, scratch(spark, "o"))
    for i in range(6):
        old = source.snapshot(places=True).where(f"k = {i - 1}").select(FILE, PLACE) if i else None
        source.commit(spark.createDataFrame([(i, "x"), (100 + i, "y")], "k int, v string").coalesce(1), old, notes={"n": i})
    same = lambda df: df.select("k", "v")
    process_new(source, output, same, ["k"])
    last, before = source.version(), rows(source.snapshot())
    source.commit(spark.createDataFrame([(7, "z")], "k int, v string"), source.snapshot(places=True).where("k = 100").select(FILE, PLACE))
    done = source.compact(least_files=2)
    assert done == last + 2 and len(source.manifest(done)["files"]) < len(source.manifest(last)["files"])
    source.commit(spark.createDataFrame([(8, "z")], "k int, v string"), source.snapshot(places=True).where("k = 7").select(FILE, PLACE))
    assert rows(source.changes(last).select("_change", "k")) == [("delete", 7), ("delete", 100), ("insert", 7), ("insert", 8)]
    process_new(source, output, same, ["k"])
    assert rows(output.snapshot()) == rows(source.snapshot()) and rows(source.snapshot(last)) == before
    assert all(not marks for marks in source.manifest(done)["files"].values())


def test_work(spark):
    assets = spark.createDataFrame([asset("done"), asset("old", model_sig="x"), asset("none", model_sig=None), asset("wait", status="pending"), asset("tried", status="failed", attempts=3), asset("again", status="failed", attempts=2)], ASSETS)
    files = spark.createDataFrame(
        [file(1, "m/done", "done"), file(2, "m/old", "old"), file(3, "m/none", "none"), file(4, "m/wait", "wait"), file(5, "m/tried", "tried"), file(6, "m/again", "again"), file(7, "m/interrupted", None), file(8, "m/skipped", None, status="unsupported"), file(9, "m/size", "done"), file(10, "m/time", "done"), file(11, "m/unseen", "wait"), file(12, "m/unknown", "nobody")], FILES
    )
    seen = ["done", "old", "none", "wait", "tried", "again", "interrupted", "skipped", "unknown", "new"]
    listing = spark.createDataFrame([sighting(f"m/{n}") for n in seen] + [sighting("m/done", 99, at=0.5), sighting("m/done"), sighting("m/size", 11), sighting("m/time", mtime=100.002), (None, None, None, None, 1, 1.0, 1.0)], LISTING)
    got = {x["path"] for x in work_since(files, assets, listing.withColumn("settled", F.lit(1)), "sig").collect()}
    assert got == {f"m/{n}" for n in ("old", "none", "wait", "again", "interrupted", "size", "time", "new")}
    assert work_since(files, assets, listing.limit(0), "sig").count() == 0
    assert work_since(files.limit(0), assets.limit(0), listing, "sig").count() == 12


def test_kept_ledger_writes_differences_only(spark):
    path = scratch(spark, "ledger")
    assets = spark.createDataFrame([asset("a"), asset("b", status="failed", attempts=1)], ASSETS)
    files = spark.createDataFrame([file(1, "m/a", "a"), file(2, "m/b", "b"), file(3, "m/unseen", "b")], FILES)
    listing = spark.createDataFrame([sighting("m/a"), sighting("m/b"), sighting("m/new")], LISTING)
    paths = lambda *x: sorted(r["path"] for r in work_since(*x, "sig", path=path).collect())
    assert paths(files, assets, listing) == ["m/b", "m/new"]
    # nothing was done: all of it again
    assert paths(files, assets, listing) == ["m/b", "m/new"]
    # both are done, another changes, one is gone
    done = spark.createDataFrame([asset("a"), asset("b"), asset("c")], ASSETS)
    known = spark.createDataFrame([file(1, "m/a", "a"), file(2, "m/b", "b"), file(3, "m/unseen", "b"), file(4, "m/new", "c")], FILES)
    later = spark.createDataFrame([sighting("m/a", 11), sighting("m/new")], LISTING)
    assert paths(known, done, later) == ["m/a"]
    state = Ledger(spark, path).state
    added = state.added(state.version()).count()
    assert added == 1 and state.snapshot().count() == 4
    assert paths(known, done, listing.limit(0)) == []
