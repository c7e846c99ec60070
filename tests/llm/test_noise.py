"""Scan noise and cut texts on made-up bodies whose truth is known."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm.scans import Scans, clean, furniture, hyphens, misread, repaired, skeleton
from quarry.llm.skipgram import learn
from quarry.llm.truncation import cut_share, ending, fit_lengths, learn_endings, limits, truncated

WORDS = "the modern kitchen opens towards a quiet garden while visitors measure every corridor and describe framed windows behind the station".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "."


def test_glyphs():
    assert misread("kitchen", "kitcben") == 1 and misread("modern", "moclern") == 1 and misread("garden", "garden") == 0 and misread("garden", "window") == 0
    assert skeleton("moclern") == skeleton("modern") and skeleton("k1tchen") == skeleton("kitchen")


def test_furniture_and_hyphens():
    pages = ["Sajor Guide\nIt is a long text here.\n117", "Saj0r Guide\nMore of the text.\n118", "Sajor Guide\nThe end of it.\n119"]
    drop, header, pageno = furniture([p.split("\n") for p in pages])
    assert header and pageno and drop == {(p, i) for p in range(3) for i in (0, 2)}
    assert furniture([["A heading", "", "Some text."], ["Another one", "", "Other text."]]) == (set(), False, False)
    # left and right pages with headers of their own; line ends that happen to come twice are none
    sides = [["Part One", "Some text."], ["The Guide", "Other text."], ["Part One", "More."], ["The Guide", "Last."]]
    assert furniture(sides)[1] and len(furniture(sides)[0]) == 4
    assert furniture([["Text a b.", "harbour."], ["Text c.", "d"], ["Text e.", "harbour."], ["Text f.", "g"]]) == (set(), False, False)
    assert not furniture([["Text a b.", "37"], ["Text c."], ["Text d."], ["Text e."], ["Text f.", "41"]])[2]
    table = "Prices\n\ndrawing\n84\nbridge\n9\nphotograph\n59"
    assert not furniture([table.split("\n")])[2]
    assert hyphens("photo-\ngraph and cov¬\nered and vi\xad\nsible") == 3 and hyphens("Two- \nand three-room flats") == 0
    assert clean("exca-\nvator")[0] == "excavator"
    text, n = repaired("Sajor Guide\nThe exca-\nvator co5ts\n12\fSajor Guide\nless. Done.\n13", {"co5ts": "costs"})
    assert text == "The excavator costs less. Done." and n == 1


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(1)
    rows = [(f"clean{i}", "pdf", "\n".join(sentence(rng) for _ in range(20))) for i in range(60)]
    for i in range(6):
        rows.append((f"noisy{i}", "pdf", "\n".join(sentence(rng) for _ in range(20)).replace("kitchen", "kitcben").replace("modern", "m0dern")))
    rows += [("null", "pdf", None), ("empty", "pdf", ""), ("blank", "pdf", " \n\f "), ("image", "image", "x-\ny"), ("clean0", "pdf", "Short.")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "hash string, kind string, body string, word string")


def test_scans(noisy):
    scans = Scans(noisy)
    found = {(r["hash"], r["defect"]) for r in scans.defects().collect()}
    assert found == {(f"noisy{i}", "char") for i in range(6)}
    texts = {r["hash"]: r for r in scans.texts().collect()}
    assert "kitchen" in texts["noisy0"]["text"] and "kitcben" not in texts["noisy0"]["text"] and "m0dern" not in texts["noisy0"]["text"]
    assert "null" not in texts and "image" not in texts


def test_labels(spark, noisy):
    vectors = spark.createDataFrame([(1, "noisy0", "pdf_text", "a kitcben and a gar- den"), (2, "noisy0", "pdf_text", None), (3, "other", "pdf_text", "kitcben")], "id long, hash string, source string, label string")
    assert {r["id"]: r["label"] for r in Scans(noisy).labels(vectors).collect()} == {1: "a kitchen and a garden", 2: None}


def test_labels_of_bodies_without_misread_words(spark):
    rows = spark.createDataFrame([("clean", "pdf", "A quiet garden is here."), ("clean", "pdf", "A quiet garden is here."), ("blank", "pdf", " "), ("image", "image", "A quiet garden.")], "hash string, kind string, body string")
    vectors = spark.createDataFrame([(1, "clean", "page", "a gar- den"), (2, "clean", "pdf_summary", None), (3, "clean", "caption", "x"), (4, "blank", "page", "x"), (5, "image", "page", "x")], "id long, hash string, source string, label string")
    assert sorted((r["id"], r["label"]) for r in Scans(rows).labels(vectors).collect()) == [(1, "a garden"), (2, None)]


@pytest.fixture(scope="module")
def themes(spark):
    """Two themes with words of their own, and words that a misreading may have come from."""
    rng = random.Random(4)
    house, field = "marble stairs tall windows lobby carpet curtains doors".split(), "green grass goal player whistle referee team boots".split()
    line = lambda words, w: " ".join([*rng.sample(words, 3), w, *rng.sample(words, 3)]) + "."
    rows = [(f"h{i}", "pdf", "\n".join(line(house, "hall") for _ in range(20))) for i in range(60)]
    rows += [(f"f{i}", "pdf", "\n".join(line(field, w) for w in ["ball", "bat"] * 10)) for i in range(60)]
    rows += [(f"n{i}", "pdf", "\n".join(line(house, w) for w in ["boll", *["hall"] * 9])) for i in range(3)]
    rows += [(f"m{i}", "pdf", "\n".join(line(house, w) for w in ["bof", *["hall"] * 9])) for i in range(3)]
    return spark.createDataFrame(rows, "hash string, kind string, body string")


def test_vectors_decide(themes):
    """'boll' is nearer to 'ball', but stands where 'hall' does; 'bof' could be a misread 'bat', but stands where no 'bat' does."""
    assert misread("ball", "boll") == 1 and misread("hall", "boll") == 2 and misread("bat", "bof") == 2
    scans = Scans(themes)
    assert {r["word"]: r["fix"] for r in scans.corrections.collect()} == {"boll": "hall"}
    assert {r["hash"] for r in scans.defects().collect()} == {"n0", "n1", "n2"}


def test_vectors_of_like_words_are_alike(themes):
    vectors, chance = learn(themes.repartition(5, "hash").withColumn("tokens", F.regexp_replace("body", r"[.\n]+", " ")), "tokens")
    assert vectors.own.dtype == np.float32 and all(0 < c < 1 for c in chance.values())
    x = vectors.of(["hall", "lobby", "ball", "goal", "team"], "own")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    assert s[2, 3] > s[0, 3] + 0.2 and s[0, 1] > s[1, 3] + 0.2 and s[3, 4] > s[1, 4] + 0.2


def test_no_bodies(spark, noisy):
    scans = Scans(noisy.limit(0))
    assert scans.defects().count() == 0 and scans.texts().count() == 0


@pytest.mark.parametrize(
    ("body", "what"),
    [
        ("A whole sentence.", "stop"), ("A question?\n\f", "stop"), ('Quoted."', "stop"), ("Text here.\n117", "furniture"), ("Text here.\n~ 46 ~", "furniture"), ("Text here.\nPage 7 of 15", "furniture"), ("Text here.\n* * *", "furniture"),
        ("It goes on and the comp", "open"), ("It goes on […", "mark"), ("It goes on\n(continued", "mark"), ("It goes&am", "mark"), ("wel�", "mark"), ("Text here.\nEnde", "closing"), ("Text here.\n\nA heading over the garden", "line"),
        ("[12s] a caption | [30s] another one", "list"), ("Text.\n- an item\n- the last item", "list"), (" \n", "blank"),
    ],
)
def test_endings(body, what):
    assert ending(body)[0] == what


def test_censored_lengths_are_fitted():
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(7.0, 0.6, 4000))
    length = np.minimum(x, 1500).astype(int)
    values, n = np.unique(length, return_counts=True)
    mu, sigma = fit_lengths(values.astype(float), n.astype(float), np.where(values == 1500, n, 0).astype(float))
    assert mu == pytest.approx(7.0, abs=0.05) and sigma == pytest.approx(0.6, abs=0.05)


def test_the_length_decides_where_the_ending_does_not():
    """The same ending is a cut at a limit and none off it; and what isn't seen at limits stays whole."""
    cells = [("stop", 0, None, 14_000), ("stop", 0, 0.99, 3), ("open", 2, None, 110), ("open", 2, 0.99, 100), ("list", -1, None, 1000), ("list", -1, 0.99, 3), ("list", -3, None, 900), ("mark", 0, None, 40)]
    ratio, rate = learn_endings(cells)
    sure = lambda prior, what, step: math.log(prior / (1 - prior)) + ratio[what, step] > 0
    assert 0.004 < rate < 0.02
    assert sure(0.99, "list", -1) and not sure(rate, "list", -1) and not sure(rate, "list", -3)
    assert sure(0.99, "open", 2) and sure(rate, "open", 2) and sure(rate, "mark", 0)
    assert not sure(0.99, "stop", 0) and not sure(rate, "stop", 0)
    # without a limit the start holds
    assert learn_endings([("open", 0, None, 5)])[0]["open", 0] == pytest.approx(math.log(100))
    assert learn_endings([]) == ({}, 0.03)


def test_limits_are_no_chance():
    """A length with two open endings among thousands isn't a limit; one with twenty is."""
    lengths = pd.DataFrame({"source": "s", "length": [*range(300, 2000), 1024], "n": [5] * 1700 + [30], "open": [2 if i % 425 == 200 else i % 17 == 0 for i in range(1700)] + [20]})
    found = limits(lengths)
    assert found["limit"].tolist() == [1024] and found["posterior"].iloc[0] > 0.7


@pytest.mark.parametrize("times", [1, 20, 150])
def test_limits_at_any_size(times):
    """However many texts there are, the limit is the length that stands out from those around it; a text cut elsewhere is at none."""
    rng = np.random.default_rng(times)
    whole = np.exp(rng.normal(7.0, 0.6, 3000 * times)).astype(int)
    length = np.concatenate([whole, np.full(40 * times, 1024)])
    rows = pd.DataFrame({"length": length, "open": np.concatenate([rng.random(len(whole)) < 0.04, np.ones(40 * times)])})
    found = limits(rows.groupby("length")["open"].agg(n="count", open="sum").reset_index().assign(source="s"))
    assert found["limit"].tolist() == [1024] and found["posterior"].iloc[0] > 0.85


def test_furniture_at_a_limit_is_learned():
    """Where far more texts of a limit's length end in a number than whole texts would, the cut went through it."""
    cells = [("stop", 0, None, 340_000), ("stop", 0, 0.99, 30), ("open", 2, None, 12_000), ("open", 2, 0.99, 11_000), ("furniture", 0, None, 40_000), ("furniture", 0, 0.99, 60)]
    ratio, rate = learn_endings(cells)
    sure = lambda prior: math.log(prior / (1 - prior)) + ratio["furniture", 0] > 0
    assert sure(0.99) and not sure(rate)
    few, rate = learn_endings([("stop", 0, None, 14_000), ("open", 2, None, 500), ("open", 2, 0.99, 460), ("furniture", 0, None, 1700)])
    assert math.log(99) + few["furniture", 0] < 0


def test_copies_make_no_limit(spark):
    """A cut text that many assets hold is judged like one that a single asset holds."""
    rng = random.Random(12)
    bodies = []
    for i in range(120):
        whole = " ".join(sentence(rng) for _ in range(rng.randrange(12, 40)))
        bodies.append((f"h{i}", whole[:500] if i % 4 == 0 else whole[: rng.randrange(510, 700)] if i % 4 == 1 else whole))
    files = spark.createDataFrame([(1, "docs/x.pdf", "none")], "id long, path string, hash string")
    got = [
        truncated(spark.createDataFrame([(f"{h}_{c}", b) for h, b in bodies for c in range(copies)], "hash string, body string"), files)
        .select(F.regexp_extract("hash", "^[^_]*", 0).alias("h"), "cut", "cut_limit", F.round("probability", 9)).distinct().collect()
        for copies in (1, 6)
    ]
    assert len(got[1]) == 120 and set(got[0]) == set(got[1])
    assert {r["cut_limit"] for r in got[1]} == {500, None}


def test_truncated(spark):
    rng = random.Random(9)
    bodies, files = [], []
    for i in range(120):
        whole = " ".join(sentence(rng) for _ in range(rng.randrange(6, 40)))
        cut = i % 4 == 0 and len(whole) > 500
        bodies.append((f"h{i}", whole[:500] if cut else whole, cut and not whole[:500].endswith(".")))
        files += [(2 * i + 1, f"{'scans' if i % 4 == 0 else 'docs'}/x/{i}.pdf", f"h{i}"), (2 * i + 2, f"other/{i}.pdf", f"h{i}")]
    bodies += [("nofile", "It stops in the mid", True), ("null", None, False), ("blank", " \n", False), ("list", "[1s] the garden behind the station | [9s] the quiet garden", False)]
    assets = spark.createDataFrame([(h, b, 1) for h, b, _ in bodies], "hash string, body string, source int")
    judged = truncated(assets, spark.createDataFrame(files, "id long, path string, hash string"))
    got = {r["hash"] for r in judged.where("cut").collect()}
    want = {h for h, _, c in bodies if c}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 1
    rows = {r["source"]: r for r in cut_share(judged).collect()}
    assert set(rows) == {"scans", "docs", None} and rows["docs"]["cut_share"] <= 0.02 and rows["scans"]["cut_share"] > 0.5
    at = judged.where("cut and source = 'scans'").first()
    assert at["cut_limit"] == 500 and at["length_posterior"] > 0.9
    assert truncated(assets.limit(0), spark.createDataFrame(files, "id long, path string, hash string")).count() == 0
