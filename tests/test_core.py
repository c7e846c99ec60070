"""Behaviour of the core on small fixtures, with the odd rows every operator must stand."""

from __future__ import annotations

import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import scalar as s
from quarry.functions.porter import stem
from quarry.functions.scalar import histogram_distance
from quarry.operators import catalogue as c
from quarry.operators import evaluation as e
from quarry.operators import features, frames
from quarry.operators import reports as r
from quarry.operators.filters import Filters, allowed
from quarry.operators.fusion import fused
from quarry.operators.keyword import bm25
from quarry.operators.signals import best_per_asset, best_per_asset_many, zscored
from quarry.plans.search import HybridSearcher
from quarry.session import numbered
from quarry.settings import Settings

META = "struct<width:int,height:int,format:string,duration:double,fps:double,frames_sampled:int,candidates_checked:int,has_speech:boolean,pages:int,title:string,has_text:boolean,ocr_pages:int>"
ASSETS = f"hash string, kind string, size long, status string, error string, attempts int, model_sig string, caption string, tags array<string>, body string, meta {META}, warnings array<string>, thumb string, processed_at double, process_ms long"
FILES = "id long, path string, folder string, filename string, ext string, kind string, size long, mtime double, hash string, file_status string, file_error string, present boolean, first_seen double, last_seen double"
VECTORS = "id long, hash string, space string, source string, ref double, label string, thumb string, vec array<float>"
LISTING = "path string, folder string, filename string, ext string, size long, mtime double, listed_at double"


def asset(h, kind="image", status="done", **x):
    meta = {k: x.pop(k, None) for k in ("width", "height", "format", "duration", "fps", "frames_sampled", "candidates_checked", "has_speech", "pages", "title", "has_text", "ocr_pages")}
    row = {"size": 1, "error": None, "attempts": 0, "model_sig": "sig", "caption": None, "tags": None, "body": None, "warnings": None, "thumb": None, "processed_at": 1.0, "process_ms": 5} | x
    return (h, kind, row["size"], status, row["error"], row["attempts"], row["model_sig"], row["caption"], row["tags"], row["body"], tuple(meta.values()), row["warnings"], row["thumb"], row["processed_at"], row["process_ms"])


def file(i, path, h, present=True, size=10, mtime=100.0, status="ok"):
    folder, _, name = path.rpartition("/")
    return (i, path, folder, name, "." + name.rpartition(".")[2].lower(), None, size, mtime, h, status, None, present, 1.0, 1.0)


def sighting(path, size=10, mtime=100.0, at=1.0):
    folder, _, name = path.rpartition("/")
    return (path, folder, name, "." + name.rpartition(".")[2].lower(), size, mtime, at)


@pytest.fixture(scope="module")
def catalogue(spark):
    assets = spark.createDataFrame(
        [
            asset("clip_only", width=20, height=10, caption="a red house"), asset("text_only", "pdf", caption="green field", pages=2), asset("word_only", "video", caption="blue harbour", duration=50.0, has_speech=True),
            asset("nothing"), asset("gone"), asset("waiting", status="pending", caption="red red"), asset("long", "pdf", body="red " * 3),
        ],
        ASSETS,
    )
    files = spark.createDataFrame(
        [
            file(1, "b/red_house.jpg", "clip_only"), file(2, "a/copy-of.jpg", "clip_only", size=3 << 20), file(3, "docs/f.pdf", "text_only", mtime=200.0), file(4, "v/x.mp4", "word_only"),
            file(5, "v/y.jpg", "nothing"), file(6, "v/z.jpg", "gone", present=False), file(7, "v/w.jpg", "waiting"), file(8, "docs/l.pdf", "long"), file(9, "docs/x.txt", None, status="unsupported"),
        ],
        FILES,
    )
    vectors = spark.createDataFrame(
        [
            (1, "clip_only", "clip", "image", None, "l", "t", [1.0, 0.0]), (2, "clip_only", "clip", "image", None, "l2", "t", [1.0, 0.0]), (3, "gone", "clip", "image", None, "l", "t", [0.0, 1.0]),
            (4, "text_only", "text", "caption", 1.0, "c", "t", [0.6, 0.8]), (5, "long", "text", "pdf_text", 2.0, "c", "t", [1.0, 0.0]), (6, "long", "text", "pdf_summary", 1.0, "s", "t", [0.0, 1.0]),
            (7, "clip_only", "clip", "image", None, "bad", "t", [1.0, 0.0, 0.0]), (8, "clip_only", "clip", "image", None, "nan", "t", [float("nan"), 9.0]), (9, "waiting", "clip", "image", None, "w", "t", [5.0, 5.0]),
        ],
        VECTORS,
    )
    return assets, files, vectors


@pytest.mark.parametrize(
    ("query", "clean", "kind"),
    [
        ("Customer testimonial videos", "Customer testimonial", "video"), ("Brochures related to residential projects", "residential projects", "pdf"), ("Images showing a modern living room", "a modern living room", "image"),
        ("Videos containing construction activity", "construction activity", "video"), ("A woman standing with a cat", "A woman standing with a cat", None), ("videos", "videos", "video"), ("", "", None),
    ],
)
def test_parse_query(spark, query, clean, kind):
    row = spark.range(1).select(F.lit(query).alias("q")).select(s.cleaned_query(F.col("q")).alias("c"), s.detected_kind(F.col("q")).alias("k")).first()
    assert (row["c"], row["k"]) == (clean, kind)


def chunked(text: str, size: int) -> list[str]:
    text, out = " ".join(text.split()), []
    while text:
        if len(text) <= size:
            cut = len(text)
        else:
            blank = text[:size].rfind(" ")
            cut = blank + 1 if blank > size // 2 else size
        out.append(text[:cut].strip())
        text = text[cut:]
    return [x for x in out if len(x) > 20]


def test_chunks_equal_a_procedural_chunker(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é🙂.   \n") for _ in range(rng.randrange(600))) for _ in range(150)] + ["", "x" * 400, " " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", s.chunks(F.col("t"), 90).alias("c")).collect()
    for row in rows:
        assert row["c"] == chunked(texts[row["i"]], 90)
    assert spark.sql("select cast(null as string) t").select(s.chunks(F.col("t"), 90).alias("c")).first()["c"] is None


def test_stems_of_the_published_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "sky": "sky"}
    assert {w: stem(w) for w in pairs} == pairs


def test_filters(catalogue):
    assets, files, _ = catalogue
    found = {x["hash"]: x for x in allowed(assets, files).collect()}
    assert set(found) == {"clip_only", "text_only", "word_only", "nothing", "long"}
    assert found["clip_only"]["path"] == "a/copy-of.jpg" and [d["path"] for d in found["clip_only"]["duplicates"]] == ["b/red_house.jpg"]
    names = lambda f: {x["hash"] for x in allowed(assets, files, f).collect()}
    assert names(Filters(orientation="landscape")) == {"clip_only", "text_only", "long"}
    assert names(Filters(max_duration=10)) == {"clip_only", "text_only", "nothing", "long"}
    assert names(Filters(has_speech=True)) == names(Filters())
    assert names(Filters(min_mb=1)) == {"clip_only"} and names(Filters(max_mb=0)) == set()
    assert names(Filters(folder="_")) == names(Filters()) and names(Filters(folder="DOC")) == {"text_only", "long"}
    assert names(Filters(ext="..PDF")) == {"text_only", "long"} and names(Filters(modified_after=150)) == {"text_only"}
    one = allowed(assets, files, Filters(folder="b")).first()
    assert one["path"] == "b/red_house.jpg" and not one["duplicates"]


def test_small_texts_and_presets(spark):
    row = spark.sql("select 0D a, cast(null as double) n").select(s.day_text(F.col("a")).alias("d"), s.day_text(F.col("n")).alias("n")).first()
    assert tuple(row) == ("1970-01-01", None)
    assert Filters.modified_within(7, 1e6, kinds=("pdf",)) == Filters(modified_after=1e6 - 604_800, kinds=("pdf",))
    listing = spark.createDataFrame([sighting("m/a.jpg"), sighting("m/b.jpg"), sighting("m/c.jpg")], LISTING)
    diff = c.scan_diff(listing, spark.createDataFrame([], FILES))
    hashes = spark.createDataFrame([("m/a.jpg", "x"), ("m/b.jpg", "x"), ("m/c.jpg", "known")], "path string, content_hash string")
    known = spark.createDataFrame([("known",)], "hash string")
    assert c.scan_counters(diff, hashes, known).first()["duplicates"] == 2 and c.scan_counters(diff, hashes).first()["duplicates"] == 1


def test_signals(catalogue):
    _, _, vectors = catalogue
    clip = {x["hash"]: x for x in best_per_asset(vectors.where("space = 'clip'"), [1.0, 0.0]).collect()}
    assert clip["clip_only"]["match"]["id"] == 1 and clip["clip_only"]["score"] == 1.0
    text = {x["hash"]: x["score"] for x in best_per_asset(vectors.where("space = 'text'"), [1.0, 0.0]).collect()}
    assert text["long"] == 0.5 and text["text_only"] == pytest.approx(0.6)
    many = {(x["query_id"], x["hash"]): (x["score"], x["vec_id"]) for x in best_per_asset_many(vectors.where("space = 'text'"), [(1, [1.0, 0.0]), (2, [0.0, 1.0])]).collect()}
    assert many[1, "long"] == (0.5, 5) and many[2, "text_only"][1] == 4
    single = zscored(best_per_asset(vectors.where("id = 1"), [1.0, 0.0])).first()
    assert single["z"] == 0.0
    assert not best_per_asset(vectors.limit(0), [1.0, 0.0]).collect()


def test_search(catalogue):
    assets, files, vectors = catalogue
    hybrid = HybridSearcher(assets, files, vectors)
    got = hybrid.search("red house", clip_vec=[1.0, 0.0], text_vec=[1.0, 0.0])
    rows = {x["hash"]: x for x in got.results.collect()}
    assert set(rows) == {"clip_only", "text_only", "long"} and not got.warnings
    assert rows["clip_only"]["score"] == pytest.approx(1.0 + 0.35 * rows["clip_only"]["keyword"], abs=1e-3)
    assert rows["long"]["best_match"]["source"] == "pdf_text"
    kind = hybrid.search("videos of harbour", clip_vec=[1.0, 0.0], text_vec=[1.0, 0.0])
    assert kind.detected_type == "video" and kind.embedded_query == "harbour"
    assert {x["hash"]: x["score"] for x in kind.results.collect()}["word_only"] == pytest.approx(1.85)
    assert hybrid.search("videos of harbour", Filters(kinds=("pdf",)), clip_vec=[1.0, 0.0], text_vec=[1.0, 0.0]).detected_type is None
    alone = hybrid.search("red")
    assert len(alone.warnings) == 2 and alone.total() > 0
    assert [x["hash"] for x in hybrid.search(" ").results.collect()][0] == "text_only"
    with pytest.raises(ValueError):
        hybrid.search("x", top_k=0)


def test_fused_without_signals_is_empty(catalogue):
    assets, files, _ = catalogue
    assert not fused(allowed(assets, files), None, None, None).collect()


def test_bm25_against_the_formula(spark):
    docs = spark.createDataFrame([("a", "", "red house", "", "red red"), ("b", "", "", "house", "café"), ("c", "", "", "", "")], "hash string, filenames string, caption string, tags string, body string")
    got = {x["hash"]: x["bm25"] for x in bm25(docs, ["red", "cafe", "cafe"]).collect()}
    idf = max(math.log((3 - 1 + 0.5) / 1.5), 1e-6)
    f, dl, mean = 1.0 + 0.6 * 2, 4, 2.0
    assert got["a"] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean)))
    f = 0.6
    assert got["b"] == pytest.approx(2 * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * 2 / mean))) and "c" not in got
    assert {x["hash"] for x in bm25(docs, ["houses"], stems=True).collect()} == {"a", "b"}
    assert not bm25(docs, []).collect() and not bm25(docs.limit(0), ["red"]).collect()


def test_bm25_equals_the_full_text_index_of_sqlite(spark):
    import sqlite3

    rng = random.Random(2)
    rows = [(str(i), *(" ".join(rng.choice("red house harbour walking walks city light".split()) for _ in range(rng.randrange(6))) for _ in range(4))) for i in range(40)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table d using fts5(hash unindexed, filenames, caption, tags, body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index")
    con.executemany("insert into d values (?,?,?,?,?)", rows)
    want = dict(con.execute("select hash, -bm25(d, 0.0, 0.3, 1.0, 0.8, 0.6) from d where d match '\"walk\" OR \"light\"'").fetchall())
    got = {x["hash"]: x["bm25"] for x in bm25(spark.createDataFrame(rows, "hash string, filenames string, caption string, tags string, body string"), ["walk", "light"], stems=True).collect()}
    assert got == pytest.approx(want)


def test_scan_diff_and_next_files(spark):
    files = spark.createDataFrame([file(1, "m/same.jpg", "h1"), file(2, "m/new_size.jpg", "h2"), file(3, "m/missing.jpg", "h3"), file(4, "m/no_hash.jpg", None), file(5, "other/x.jpg", "h5"), file(6, "m/t.txt", None, status="unsupported")], FILES)
    listing = spark.createDataFrame(
        [sighting("m/same.jpg", mtime=100.0004), sighting("m/new_size.jpg", 11), sighting("m/new_size.jpg", 12, at=2.0), sighting("m/no_hash.jpg"), sighting("m/t.txt"), sighting("m/b.png"), sighting("m/a.png", 0), sighting("m/a.png", 0), (None, None, None, None, 1, 1.0, 1.0)], LISTING
    )
    diff = c.scan_diff(listing, files, "m/")
    assert {x["path"]: x["change"] for x in diff.collect()} == {"m/same.jpg": "unchanged", "m/new_size.jpg": "changed", "m/missing.jpg": "missing", "m/no_hash.jpg": "changed", "other/x.jpg": "gone", "m/t.txt": "unchanged", "m/b.png": "new", "m/a.png": "new"}
    counters = c.scan_counters(diff).first().asDict()
    assert counters == {"seen": 6, "new": 2, "changed": 2, "unchanged": 2, "missing": 1, "unsupported": 1, "errors": 1}
    hashes = spark.createDataFrame([("m/new_size.jpg", "n2"), ("m/b.png", "nb")], "path string, content_hash string")
    rows = {x["path"]: x for x in c.next_files(diff, hashes, 9.0).collect()}
    assert rows["m/new_size.jpg"]["id"] == 2 and rows["m/new_size.jpg"]["size"] == 12 and rows["m/new_size.jpg"]["hash"] == "n2" and rows["m/new_size.jpg"]["first_seen"] == 1.0
    assert [rows[p]["id"] for p in ("m/a.png", "m/b.png")] == [7, 8] and rows["m/a.png"]["file_status"] == "unreadable"
    assert rows["m/no_hash.jpg"]["file_status"] == "unreadable" and not rows["m/missing.jpg"]["present"] and rows["other/x.jpg"]["present"]
    assert {x["hash"] for x in c.new_assets(c.next_files(diff, hashes, 9.0), spark.createDataFrame([asset("h1")], ASSETS)).collect()} == {"n2", "nb", "h3", "h5"}
    assert c.scan_diff(listing.limit(0), files).where("change = 'new'").count() == 0


def test_status_machine(spark):
    assets = spark.createDataFrame([asset("a", status="pending"), asset("b", status="processing"), asset("c", status="failed", attempts=2), asset("d", status="failed", attempts=3), asset("e", model_sig=None), asset("f", model_sig="old"), asset("g")], ASSETS)
    files = spark.createDataFrame([file(i, f"m/{h}.jpg", h) for i, h in enumerate("abcdefg")], FILES)
    assert {x["hash"] for x in c.pending_queue(assets, files, "sig").collect()} == {"a", "b", "c", "e", "f"}
    assert {x["hash"] for x in c.pending_queue(assets, files.withColumn("present", F.lit(False)), "sig").collect()} == set()
    assert {x["status"] for x in c.recovered(assets).where("hash = 'b'").collect()} == {"pending"}
    assert c.retried(assets).where("hash = 'd'").first()["attempts"] == 0
    going = c.started(assets, assets.where("hash in ('a', 'c')"))
    assert {x["hash"]: x["attempts"] for x in going.where("status = 'processing'").collect()} == {"a": 1, "b": 0, "c": 3}
    out = going.where("hash in ('a', 'c')").withColumns({"error": F.when(F.col("hash") == "c", F.lit("x" * 3000)), "lasting": F.col("hash") == "c", "body": F.lit("y" * 30_000)})
    done = {x["hash"]: x for x in c.finished(going, out, "sig").collect()}
    assert done["a"]["status"] == "done" and len(done["a"]["body"]) == 20_000 and done["c"]["status"] == "failed" and len(done["c"]["error"]) == 2000 and done["c"]["attempts"] == 3


def test_judgments_and_metrics(spark):
    judgments = spark.createDataFrame([("q", "a", 1), ("q", "b", 0)], "query string, hash string, relevant int")
    changes = spark.createDataFrame([("q", "a", None, 2), ("q", "a", 1, 1), ("q", "c", 5, 1)], "query string, hash string, relevant int, at int")
    assert {tuple(x) for x in c.judged(judgments, changes).collect()} == {("q", "b", 0), ("q", "c", 1)}
    results = spark.createDataFrame([("q", 1, "b"), ("q", 2, "a"), ("open", 1, "z")], "query string, rank int, hash string")
    known = judgments.unionByName(spark.createDataFrame([("q", "far", 1)], judgments.schema))
    m = {x["query"]: x.asDict() for x in e.metrics(results, known).collect()}
    assert m["q"] == {"query": "q", "judged": True, "p_at_k": 0.5, "mrr": 0.5, "hit": 1, "recall_at_10": 0.5}
    assert m["open"]["judged"] is False and m["open"]["p_at_k"] is None
    total = e.summary(e.metrics(results, known)).first()
    assert (total["queries"], total["fully_judged"], total["mean_p_at_k"]) == (2, 1, 0.5)
    assert e.summary(e.metrics(results.limit(0), known)).first()["mean_mrr"] is None


def test_export_and_query_set(spark, tmp_path):
    results = spark.createDataFrame([("q", 1, "b", "frame", 3.0, "a|b")], "query string, rank int, hash string, source string, ref double, label string")
    judgments = spark.createDataFrame([("q", "b", 1)], "query string, hash string, relevant int")
    text = e.export(results, judgments, e.metrics(results, judgments), f"file://{tmp_path}/out")
    assert "frame ▶ 0:03: a/b" in text and "✅" in text and "| q |  | 1.0 | 1.0 |  |" in text
    told = spark.createDataFrame([("q", "find it", "an image", "image", 12)], "query string, intent string, expected string, detected_type string, ms long")
    notes = spark.createDataFrame([("q", "worked")], "query string, note string")
    text = e.export(results, judgments, e.metrics(results, judgments), f"file://{tmp_path}/out", queries=told, notes=notes)
    assert "Intent: find it" in text and "Expected: an image" in text and "Note: worked" in text and "| q | image | 1.0 | 1.0 | 12 |" in text
    path = tmp_path / "queries.json"
    path.write_text('[{"id": 1, "query": "red", "filters": {"kinds": ["pdf"]}}, {"id": 2, "query": "blue"}]')
    rows = e.query_set(spark, str(path)).orderBy("id").collect()
    assert e.filters_of(rows[0]["filters"]) == Filters(kinds=("pdf",)) and e.filters_of(rows[1]["filters"]) == Filters()
    assert e.query_set(spark, str(tmp_path / "none.json")).count() == 0


def kept(frames_):
    out, last = [], None
    for t, h in frames_:
        if last is None or t - last[0] >= 4.0 or math.sqrt(max(0.0, 1 - sum(math.sqrt(a * b) for a, b in zip(h, last[1], strict=True)) / math.sqrt(sum(h) * sum(last[1])))) > 0.35:
            out.append(t)
            last = (t, h)
    return out


def test_keyframes_equal_a_loop(spark):
    rng = random.Random(8)
    videos = {f"v{i}": [(float(t), [rng.random() ** 4 + 1e-3 for _ in range(6)]) for t in range(rng.randrange(1, 30))] for i in range(12)}
    rows = spark.createDataFrame([(v, t, 100.0, h) for v, fs in videos.items() for t, h in fs], "hash string, t double, brightness double, hist array<double>")
    for x in frames.keyframes(rows).collect():
        want = kept(videos[x["hash"]])
        if len(want) > 16:
            want = list(dict.fromkeys(want[round(i * (len(want) - 1) / 15)] for i in range(16)))
        assert x["times"] == want
    dark = spark.createDataFrame([("d", 0.0, 1.0, [1.0]), ("d", 9.0, 2.0, [1.0])], rows.schema)
    assert frames.keyframes(dark).first()["times"] == [0.0, 9.0]
    assert frames.keyframes(rows.limit(0)).count() == 0


def test_keyframes_of_a_long_video(spark):
    """A video of many thousand frames, over many batches, beside short ones: every frame is looked at, in linear time."""
    x = F.rand(5)
    hist = F.array(*[F.pow(F.rand(i), 3.0) for i in range(8)])
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("v"), F.col("id") % 97)).otherwise(F.lit("long")).alias("hash"), (F.col("id") / 2).alias("t"), F.when(x < 0.3, 5.0).otherwise(90.0).alias("brightness"), hist.alias("hist"))
    began = time.time()
    got = {r["hash"]: r["times"] for r in frames.keyframes(rows).collect()}
    took = time.time() - began
    videos = {}
    for r in rows.orderBy("t").collect():
        if r["brightness"] > frames.BLACK:
            videos.setdefault(r["hash"], []).append((r["t"], r["hist"]))
    assert set(got) == set(videos) and len(videos["long"]) > 30_000
    for v, fs in videos.items():
        want = kept(fs)
        assert got[v] == (want if len(want) <= 16 else [want[round(i * (len(want) - 1) / 15)] for i in range(16)])
    assert took < 60


def test_keyframes_of_odd_frames(spark):
    """Null and NaN times, empty, null and unequal histograms, dark beginnings: as the distance of whole arrays has it."""
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 0.0], [0.0, 1.0]
    videos = {
        "dark": [(0.0, 1.0, a), (1.0, 2.0, b), (2.0, 50.0, a), (3.0, None, b), (4.0, 60.0, a), (7.0, 60.0, b)],
        "nulls": [(None, 90.0, a), (None, 90.0, b), (3.0, 90.0, a), (4.0, 90.0, a), (5.0, nan, b)],
        "hist": [(0.0, 90.0, a), (1.0, 90.0, [1.0, 0.0, 0.0]), (2.0, 90.0, []), (2.5, 90.0, a), (2.75, 90.0, None), (3.0, 90.0, a), (3.25, 90.0, [None, 1.0]), (3.5, 90.0, a), (3.6, 90.0, [nan, 1.0]), (3.7, 90.0, [inf, 1.0])],
        "nan": [(0.0, 90.0, a), (1.0, 90.0, a), (nan, 90.0, a), (nan, 90.0, a)],
        None: [(0.0, 90.0, a), (1.0, 90.0, b)],
    }
    rows = spark.createDataFrame([(v, *f) for v, fs in videos.items() for f in fs], "hash string, t double, brightness double, hist array<double>")

    def want(fs):
        above = [f for f in fs if f[1] is not None and not f[1] <= frames.BLACK] or fs
        out, last = [], None
        for t, _, h in above:
            if last is not None and last[0] is not None:
                pair = spark.createDataFrame([(h, last[1], t, last[0])], "a array<double>, b array<double>, t double, u double")
                if not pair.select((histogram_distance(F.col("a"), F.col("b")) > frames.SCENE) | (F.col("t") - F.col("u") >= frames.GAP)).first()[0]:
                    continue
            out.append(t)
            last = (t, h)
        return out

    got = {r["hash"]: r["times"] for r in frames.keyframes(rows).collect()}
    assert {k: str(v) for k, v in got.items()} == {k: str(want(fs)) for k, fs in videos.items()}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=30))
def test_zscores_have_mean_zero_and_deviation_one(spark, values):
    rows = zscored(spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], "hash string, score double")).collect()
    z = [x["z"] for x in rows]
    assert sum(z) / len(z) == pytest.approx(0, abs=1e-4)
    spread_ = math.sqrt(sum(v * v for v in z) / len(z))
    assert spread_ == pytest.approx(1, abs=1e-3) or max(values) - min(values) < 1e-5


def test_mean_vectors_and_tags(spark):
    rows = spark.createDataFrame([("a", "clip", [1.0, 0.0]), ("a", "clip", [0.0, 1.0]), ("z", "clip", [0.0, 0.0]), ("n", "clip", [float("nan"), 1.0]), ("w", "clip", [1.0])], "hash string, space string, vec array<float>")
    means = features.mean_vectors(rows, "clip", 2)
    got = {x["hash"]: x["vec"] for x in means.collect()}
    assert got["a"] == pytest.approx([0.5**0.5] * 2) and got["z"] == [0.0, 0.0] and set(got) == {"a", "z"}
    tags = {x["hash"]: x["tags"] for x in features.zero_shot_tags(means, [("right", [1.0, 0.0]), ("both", [0.7, 0.7]), ("left", [-1.0, 0.0])]).collect()}
    assert tags == {"a": ["both", "right"], "z": []}


def test_reports(catalogue):
    assets, files, _ = catalogue
    text = r.dataset_markdown(files, assets)
    assert "| unsupported | .txt | 1 |" in text
    assert r.duplicate_files(files).first()[0] == 1 and r.duplicate_files(files.limit(0)).first()[0] == 0
    assert {x["state"] for x in r.problems(assets, files).collect()} == {"unsupported"}


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("TOP_K=7\nENABLE_SPEECH=no\n# x\nMAX_FILE_MB=\n")
    got = Settings.load({"TOP_K": "9"}, str(env))
    assert (got.top_k, got.enable_speech, got.max_file_mb) == (9, False, 2048) and got.signature().endswith("|noasr")


def test_places_and_new_ids_under_many_partitions(spark):
    """Every new path gets one id, in order of path, whatever the planner does with 200 partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        n = 600_000
        seen = spark.range(n).select(F.concat(F.lit("m/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"))
        listing = seen.select("path", F.lit("m").alias("folder"), F.lit("x.jpg").alias("filename"), F.lit(".jpg").alias("ext"), F.lit(5).cast("long").alias("size"), F.lit(1.0).alias("mtime"), F.lit(1.0).alias("listed_at"))
        files = spark.createDataFrame([file(41, "m/known", "h")], FILES)
        got = c.next_files(c.scan_diff(listing, files), seen.select("path", F.lit("h").alias("content_hash")), 2.0)
        assert got.count() == n + 1
        fresh = got.where("id > 41").selectExpr("count(*) n", "count(distinct id) ids", "min(id) low", "max(id) high").first()
        assert tuple(fresh) == (n, n, 42, 41 + n)
        first = got.where("id in (42, 43, 300000)").orderBy("id").select("path").collect()
        every = seen.orderBy("path").select("path").toPandas()["path"]
        assert [r["path"] for r in first] == [every[0], every[1], every[300000 - 42]]
        placed = numbered(seen.limit(0), ["path"], "none")
        assert placed.count() == 0 and placed.columns == ["path", "_place"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
