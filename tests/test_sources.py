"""Folder scans, hashes, fake processing and streams."""

from __future__ import annotations

import hashlib
import os
import struct
import sys
import types
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.processors import COLOURS, FakeModels, process_images, process_pdfs, process_videos
from quarry.plans.ingest import Ingest
from quarry.plans.media import media_process
from quarry.session import scratch
from quarry.sources.folder import content_hashes, scan
from quarry.sources.media import MissingDecoder, Part, ProcessingError, audio, brightness, histogram, image, thumbnail, transcriber, video_frames
from quarry.streaming.keyframes import newest_stream, spaced_stream


@pytest.fixture
def tree(tmp_path):
    for name in ("a/b/one.JPG", "a/two.txt", "a/.hidden", "_c/three.pdf", "_c/__pycache__/x.pyc", "data/skip.jpg", "empty.png", "noending", "é x.mp4"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"" if name == "empty.png" else name.encode())
    os.symlink(tmp_path / "a", tmp_path / "link")
    return tmp_path


@pytest.mark.parametrize("split", [0, 1, 3])
def test_scan(spark, tree, split):
    rows = scan(spark, str(tree), 5.0, (str(tree / "data"),), split).collect()
    assert {os.path.relpath(r["path"], tree): r["ext"] for r in rows} == {"a/b/one.JPG": ".jpg", "a/two.txt": ".txt", "_c/three.pdf": ".pdf", "empty.png": ".png", "noending": "", "é x.mp4": ".mp4"}
    assert {r["size"] for r in rows if r["filename"] == "empty.png"} == {0} and {r["listed_at"] for r in rows} == {5.0}
    assert len(rows) == len({r["path"] for r in rows})


def test_content_hashes(spark, tree):
    paths = spark.createDataFrame([(str(tree / "a/two.txt"),), (str(tree / "none"),)], "path string")
    assert [tuple(r) for r in content_hashes(paths).collect()] == [(str(tree / "a/two.txt"), hashlib.sha256(b"a/two.txt").hexdigest())]


def test_decoders_say_what_is_at_fault():
    try:
        import PIL  # noqa: F401

        with pytest.raises(ProcessingError):
            image(b"no image")
    except ImportError:
        with pytest.raises(MissingDecoder):  # the file may be fine
            image(b"no image")


def test_picture_features():
    red, grey = np.full((40, 30, 3), (220, 30, 30), np.uint8), np.full((4, 4, 3), 128, np.uint8)
    h = histogram(red)
    assert h.shape == (128,) and h.sum() == pytest.approx(1) and (h > 0).sum() == 1 and h.argmax() == (0 * 4 + 3) * 4 + 3
    assert histogram(grey).argmax() == 2 and brightness(grey) == pytest.approx(128)
    mixed = histogram(np.stack([red[:4, :4], np.full((4, 4, 3), (30, 30, 220), np.uint8)]))
    assert mixed[15] == 0.5 and mixed[(5 * 4 + 3) * 4 + 3] == 0.5
    for shape in ((1, 1, 3), (700, 500, 3), (1, 900, 3)):
        png = thumbnail(np.zeros(shape, np.uint8), 320)
        w, h = struct.unpack(">II", png[16:24])
        assert png.startswith(b"\x89PNG") and max(w, h) <= 320 and min(w, h) >= 1
        assert len(zlib.decompress(png[41:-16])) == h * (3 * w + 1)


def wav(path, x, rate, channels=1, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes((np.repeat(x, channels) * (2 ** (8 * width - 1) - 1)).astype({2: "<i2", 4: "<i4"}[width]).tobytes())
    return str(path)


def test_sound(tmp_path):
    tone = np.sin(np.arange(32_000) * 2 * np.pi * 440 / 8000) / 2
    for width, channels in ((2, 1), (4, 2)):
        sound = audio(wav(tmp_path / "a.wav", tone, 8000, channels, width), most=3)
        assert sound.dtype == np.float32 and len(sound) == 3 * 16_000 and abs(sound).max() == pytest.approx(0.5, abs=0.01)
    cut = tmp_path / "cut.wav"
    cut.write_bytes((tmp_path / "a.wav").read_bytes()[:4001])
    assert 0 < len(audio(str(cut))) < 16_000
    (tmp_path / "none.wav").write_bytes(b"nothing")
    assert len(audio(str(tmp_path / "none.wav"))) == 0
    read = transcriber(lambda sound: [(" hello ", 0.1), ("noise", 0.9), ("there", 0.2)])
    assert read(str(tmp_path / "a.wav")) == "hello there" and read(str(cut)) == ""


class Cap:
    """A capture of ``frames`` frames at one a second, of which those in ``bad`` can't be read; ``seeks`` says whether it can be sought in."""

    def __init__(self, frames, bad=(), length=True, seeks=True):
        self.frames, self.bad, self.length, self.seeks, self.at = frames, set(bad), length, seeks, 0

    def isOpened(self): return True
    def release(self): pass
    def get(self, what): return {"fps": 1.0, "count": float(self.frames if self.length else 0)}.get(what, 8)
    def set(self, what, value): self.at = int(value / 1000 if what == "ms" else value)
    def grab(self): self.at += 1; return self.at <= self.frames
    def retrieve(self): return self.at - 1 not in self.bad, self.at - 1
    def read(self):
        ok = self.seeks and self.at < self.frames and self.at not in self.bad
        return ok, self.at


@pytest.mark.parametrize(
    ("cap", "times"),
    [
        (Cap(5), [0, 1, 2, 3, 4]), (Cap(6, bad=[1]), [0, 2, 3, 4, 5]), (Cap(9, bad=[2, 3, 4]), [0, 1]), (Cap(4, seeks=False), [0, 1, 2, 3]), (Cap(3, length=False), [0, 1, 2]), (Cap(2, bad=[0, 1]), None),
    ],
)
def test_video_sampling(monkeypatch, cap, times):
    module = types.SimpleNamespace(VideoCapture=lambda path: cap, CAP_PROP_FPS="fps", CAP_PROP_FRAME_COUNT="count", CAP_PROP_POS_MSEC="ms", CAP_PROP_POS_FRAMES="frame")
    monkeypatch.setitem(sys.modules, "cv2", module)
    if times is None:
        with pytest.raises(ProcessingError):
            video_frames("x")
    else:
        assert [t for t, _ in video_frames("x")[0]] == times


def reader():
    """A decoder made inside a function, so that workers get it by value."""

    def read(path):
        """Files of these tests: colours by comma, or pages by form feed."""
        with open(path) as f:
            text = f.read()
        if text == "broken":
            raise ProcessingError("corrupt file")
        if text == "later":
            raise MissingDecoder("no decoder")
        if path.endswith(".pdf"):
            return [Part(float(i), None if page else np.full((2, 2, 3), COLOURS["red"], np.uint8), page) for i, page in enumerate(text.split("\f"), 1)], {"pages": text.count("\f") + 1, "title": ""}
        frames = [np.full((8, 6, 3), COLOURS[c], np.uint8) for c in text.split(",")]
        return [Part(None if len(frames) == 1 else 2.0 * i, f) for i, f in enumerate(frames)], {"width": 6, "height": 8, "duration": 2.0 * len(frames)}

    return read


def test_a_folder_is_indexed_by_kind(spark, tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    files = {"red.jpg": "red", "clip.mp4": "green,green,blue", "doc.pdf": "Luxury yellow homes for all families of the town.\f", "bad.jpg": "broken", "late.png": "later", "notes.txt": "x"}
    for name, text in files.items():
        (root / name).write_text(text)
    process = media_process(FakeModels(), dict.fromkeys(("image", "video", "pdf"), reader()), lambda path: "a quiet speech about the green garden", lambda rgb: "scanned words of a page")
    ingest = Ingest(spark, scratch(spark, "catalogue"), "sig", lambda r: scan(spark, r, 1.0), content_hashes, process)
    counters = ingest.run(str(root))
    assert (counters["processed"], counters["failed"], counters["unsupported"]) == (3, 2, 1)
    names = {r["hash"]: r["filename"] for r in ingest.read("files").where("hash is not null").collect()}
    assets = {names[r["hash"]]: r for r in ingest.read("assets").collect()}
    assert assets["red.jpg"]["caption"] == "a red picture" and assets["red.jpg"]["meta"]["width"] == 6 and assets["red.jpg"]["thumb"].startswith("data:image/png;base64,")
    assert "TRANSCRIPT: a quiet speech" in assets["clip.mp4"]["body"] and assets["clip.mp4"]["meta"]["has_speech"] and assets["clip.mp4"]["meta"]["frames_sampled"] == 2
    assert assets["doc.pdf"]["body"].endswith("\fscanned words of a page") and assets["doc.pdf"]["meta"]["ocr_pages"] == 1 and assets["doc.pdf"]["meta"]["pages"] == 2
    assert (assets["bad.jpg"]["status"], assets["bad.jpg"]["attempts"]) == ("failed", 3)
    assert (assets["late.png"]["status"], assets["late.png"]["attempts"]) == ("failed", 1) and "no decoder" in assets["late.png"]["error"]
    sources = {(names[r["hash"]], r["space"], r["source"]) for r in ingest.read("vectors").collect()}
    assert {("red.jpg", "clip", "image"), ("clip.mp4", "clip", "frame"), ("clip.mp4", "text", "transcript"), ("doc.pdf", "clip", "page"), ("doc.pdf", "text", "pdf_text"), ("doc.pdf", "text", "pdf_summary")} <= sources
    thumbs = {(r["source"], r["ref"]): r["thumb"] for r in ingest.read("vectors").collect() if names[r["hash"]] == "doc.pdf"}
    assert thumbs["page", 2.0] and thumbs["pdf_text", 1.0] == thumbs["page", 2.0]  # the first page has no picture
    # the decoder is there now: only the file that failed for want of it is done
    (root / "late.png").touch()
    ingest.process = media_process(FakeModels(), {"image": lambda path: ([Part(None, np.full((2, 2, 3), COLOURS["blue"], np.uint8))], {})})
    assert ingest.run(str(root))["processed"] == 1
    assert {names[r["hash"]] for r in ingest.read("assets").where("status = 'done'").collect()} == {"red.jpg", "clip.mp4", "doc.pdf", "late.png"}


def test_processors(spark):
    models = FakeModels()
    images = spark.createDataFrame([("i", [220.0, 30.0, 30.0])], "hash string, colour array<double>")
    results, vectors = process_images(images, models)
    assert results.first()["caption"] == "a red picture" and {(v["space"], v["source"]) for v in vectors.collect()} == {("clip", "image"), ("text", "caption")}
    frames = spark.createDataFrame([("v", float(t), [30.0, 180.0, 30.0] if t < 3 else [30.0, 30.0, 220.0]) for t in range(9)], "hash string, t double, colour array<double>")
    speech = spark.createDataFrame([("v", "we walk through the blue harbour today and talk")], "hash string, transcript string")
    results, vectors = process_videos(frames, speech, models)
    row = results.first()
    assert row["caption"] == "a blue picture" and row["body"].startswith("[0s] a green picture | ") and row["body"].endswith("\nTRANSCRIPT: we walk through the blue harbour today and talk")
    counted = {r["source"]: r["count"] for r in vectors.groupBy("source").count().collect()}
    assert counted == {"frame": 9, "caption": 6, "transcript": 1}
    pages = spark.createDataFrame([("p", 1, "Luxury apartments brochure\n" + "yellow sunny homes for families " * 40, [230.0, 220.0, 30.0], ""), ("p", 2, None, [230.0, 220.0, 30.0], "")], "hash string, page int, text string, colour array<double>, title string")
    results, vectors = process_pdfs(pages, models)
    assert results.first()["caption"] == "Luxury apartments brochure — a yellow picture"
    assert {r["source"] for r in vectors.collect()} == {"page", "pdf_text", "pdf_summary"}

    class Silent(FakeModels):
        def caption(self, colours):
            raise RuntimeError("no model")

    row = process_images(images, Silent())[0].first()
    assert row["caption"] == "" and row["warnings"] == ["captions unavailable: no model"]


def test_spaced_stream_equals_the_batch(spark, tmp_path):
    data = [(u, f"2024-01-01 00:00:{t:02d}") for u in (1, 2) for t in (0, 3, 4, 5, 9, 14, 15)]
    path = scratch(spark, "events")
    spark.createDataFrame(data, "u int, ts string").select("u", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(path)
    stream = spaced_stream(spark.readStream.schema("u int, ts timestamp").parquet(path), "u", "ts", 5.0)
    q = stream.writeStream.format("memory").queryName("spaced").outputMode("append").option("checkpointLocation", scratch(spark, "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["u"], int(r["t"]) % 60) for r in spark.table("spaced").collect())
    assert got == [(u, t) for u in (1, 2) for t in (0, 5, 14)]


def test_newest_stream(spark):
    path, out = scratch(spark, "listing"), scratch(spark, "out")
    spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 1.0, 2.0), ("b", 1, 1.0, 1.0)], "path string, size long, mtime double, listed_at double").coalesce(1).write.parquet(path)
    newest_stream(spark.readStream.schema("path string, size long, mtime double, listed_at double").parquet(path), out, scratch(spark, "cp")).awaitTermination(60)
    assert sorted((r["path"], r["size"]) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 1)]
