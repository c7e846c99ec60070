"""Runs of the indexer over a folder, with outcomes made of the files' bytes."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.sql import functions as F

from quarry.plans.ingest import RESULTS, Busy, Ingest, remaining_seconds
from quarry.session import scratch
from quarry.sources.folder import content_hashes, scan


@pytest.fixture
def run(spark, tmp_path):
    root = tmp_path / "media"
    for name, data in (("photos/red.jpg", "red"), ("photos/green.jpg", "green"), ("videos/clip.mp4", "blue clip"), ("docs/doc.pdf", "yellow"), ("backup/copy.jpg", "red"), ("photos/broken.jpg", "broken"), ("docs/notes.txt", "n"), ("photos/empty.png", "")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(data)
    now = [100.0]
    seen: list[str] = []

    def process(assets):
        text = F.udf(lambda p: open(p).read(), "string")
        rows = assets.withColumn("t", text("path"))
        seen.extend(r["path"] for r in assets.select("path").collect())
        bad = F.col("t") == "broken"
        base = spark.createDataFrame([], RESULTS)
        results = base.unionByName(rows.select("hash", F.col("t").alias("caption"), F.when(bad, "corrupt file").alias("error"), bad.alias("lasting"), F.lit(1.0).alias("processed_at")), allowMissingColumns=True)
        return results, rows.select("hash", F.lit("clip").alias("space"), F.col("kind").alias("source"), F.array(F.lit(1.0).cast("float")).alias("vec"))

    def clock():
        now[0] += 1
        return now[0]

    ingest = Ingest(spark, scratch(spark, "catalogue"), "sig", lambda r: scan(spark, r, now[0]), content_hashes, process, batch=4, clock=clock)
    return ingest, str(root), seen


def test_runs(run):
    ingest, root, seen = run
    first = ingest.run(root)
    assert (first["processed"], first["failed"], first["duplicates"], first["unsupported"], first["errors"], first["new"]) == (4, 1, 1, 1, 1, 8)
    assert [os.path.basename(p) for p in seen][:1] != ["clip.mp4"] and os.path.basename(seen[-1]) == "clip.mp4"
    broken = ingest.read("assets").where("status = 'failed'").first()
    assert broken["error"] == "corrupt file" and broken["attempts"] == 3
    assert ingest.read("vectors").count() == 4 and ingest.read("vectors").select("id").distinct().count() == 4
    seen.clear()
    second = ingest.run(root)
    assert not seen and (second["processed"], second["unchanged"], second["failed"]) == (0, 8, 0)
    # changed, new and deleted files
    path = f"{root}/photos/green.jpg"
    with open(path, "w") as f:
        f.write("white and wide")
    with open(f"{root}/photos/new.jpg", "w") as f:
        f.write("black")
    os.remove(f"{root}/docs/doc.pdf")
    third = ingest.run(root)
    assert (third["processed"], third["changed"], third["new"], third["missing"]) == (2, 1, 1, 1)
    files = {r["filename"]: r for r in ingest.read("files").collect()}
    assert len(files) == 9 and not files["doc.pdf"]["present"] and files["green.jpg"]["first_seen"] < files["new.jpg"]["first_seen"]
    job = ingest.read("jobs").orderBy(F.desc("id")).first()
    assert (job["id"], job["state"], job["processed"]) == (3, "finished", 2)


def test_recovery_and_errors(run):
    ingest, root, seen = run

    def missing():
        raise RuntimeError("no model file")

    ingest.ready = missing
    with pytest.raises(RuntimeError):
        ingest.run(root)
    assert ingest.read("assets").where("status = 'failed'").count() == 0 and ingest.read("jobs").first()["state"] == "error"
    ingest.ready = lambda: None
    own = ingest.process

    def dies(assets):
        raise MemoryError("lost")

    ingest.process = dies
    with pytest.raises(MemoryError):
        ingest.run(root)
    assert ingest.read("assets").where("status = 'processing'").count() == 4
    ingest.process = own
    assert ingest.run(root)["processed"] == 4
    # a new signature processes everything again, and replaces vectors
    ingest.signature = "sig2"
    assert ingest.run(root)["processed"] == 4 and ingest.read("vectors").count() == 4


def test_one_run_at_a_time_and_stop(run):
    ingest, root, _ = run
    ingest._lock.acquire()
    with pytest.raises(Busy):
        ingest.run(root)
    with pytest.raises(Busy):
        ingest.start(root)
    ingest._lock.release()
    own = ingest.process

    def stopping(assets):
        ingest.stop.set()
        return own(assets)

    ingest.process = stopping
    assert ingest.run(root)["processed"] + ingest.read("assets").where("status = 'failed'").count() == 4
    assert ingest.read("jobs").first()["state"] == "stopped" and isinstance(ingest.stop, threading.Event)
    assert remaining_seconds(10, 0, 5) is None and remaining_seconds(10, 2, 6) == 20
