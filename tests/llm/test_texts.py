"""Splitting, tokens, repetition and leakage: against plain versions of themselves."""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe
from quarry.llm.leakage import RUN, FMIndex, Phrases, leaks, occurrences, suffix_array
from quarry.llm.repetition import BOUNDS, FEATURES, SLACK, fit_trees, least_score, repeated_share, repetition, statistics, words_of
from quarry.llm.split import StrongestCut, normalised, oversized_pages, pieces, split_pages

VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"


# splitting
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.data())
def test_strongest_cut(strength, data):
    index = StrongestCut(np.array(strength), len(strength))
    low = data.draw(st.integers(0, len(strength) - 1))
    high = data.draw(st.integers(low, len(strength) - 1))
    best = max(range(low, high + 1), key=lambda i: (strength[i], i))
    assert index.query(low, high) == best


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.,;! \n\téé🙂‍", max_size=900))
def test_pieces_cover_the_page(page):
    text, paragraphs = normalised(page)
    assert text == re.sub(r"[ \t\r\n]+", " ", page).strip(" ")
    cuts = pieces(text, paragraphs, 100, 20, 5)
    at = 0
    for k, (a, b, _) in enumerate(cuts):
        assert 0 < b - a <= 100
        assert a == 0 if not k else 0 <= at - a <= 20
        at = b
    assert at == len(text)


def test_pieces_prefer_the_strongest_boundary():
    text = "word " * 100 + "end. Next " + "word " * 100
    text, p = normalised(text)
    first = pieces(text, p, 900, 90, 40)[0]
    assert text[first[0] : first[1]].endswith("end.")
    long = "x" * 2500
    cut = pieces(long, set())
    assert [b - a for a, b, _ in cut][:2] == [900, 900] and all(40 <= x[1] - y[0] <= 90 for x, y in zip(cut, cut[1:], strict=False))
    with pytest.raises(ValueError):
        pieces("a", set(), 100, 60)


def test_pieces_end_between_words_before_a_long_run():
    text = "word " * 40 + "f" * 1400 + " end" * 300
    cuts = pieces(text, set())
    # the run itself has to be cut; what comes before it isn't cut inside
    assert (cuts[0][0], cuts[0][1]) == (0, 199) and cuts[0][2] >= 2
    assert all(b < d and a < c and 40 <= b - c <= 90 for (a, b, _), (c, d, _) in zip(cuts, cuts[1:], strict=False)) and cuts[-1][1] == len(text)


def test_split_pages(spark):
    rows = spark.createDataFrame([("a", "\f" + "word. " * 300 + "\f", "x"), ("a", "\f" + "word. " * 300 + "\f", "y"), ("b", None, "x"), ("c", "", "x"), ("d", " \n\f \t", "x"), (None, "short", "x")], "hash string, body string, ref string")
    cut = split_pages(rows)
    assert sorted(map(tuple, oversized_pages(cut).collect())) == [("a", 2), ("a", 2)]
    assert {r["hash"] for r in cut.collect()} == {"a", None}
    assert split_pages(rows.limit(0)).count() == 0


# tokens
def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(VOCABULARY)
    reference.encode_special_tokens = True
    rng = random.Random(3)
    letters = "ab'sd  tre\n\r\t vell1２é́ß​ 漢字🙂!<|endoftext|>''m  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 700 + "'s", "<|endoftext|>", "it's I'll we've\n\n x", " \n ", "   a", "\n\na", "", None, "'", "'s", " 's", "\x00", "re'llama"]
    vocabulary = bpe.vocabulary(VOCABULARY)
    counts, flat = vocabulary.encode(texts)
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    want = [x.ids for x in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts[-40:])], "doc_id long, text string, ids string")
    out = {r["doc_id"]: r["ids"] for r in bpe.token_ids(rows).collect()}
    assert [out[i] for i in range(40)] == want[-40:]
    assert bpe.token_ids(rows.limit(0)).count() == 0


def test_a_long_word_is_merged_alike_by_heap_and_rounds():
    vocabulary = bpe.Vocabulary(VOCABULARY)
    rng = random.Random(5)
    for n in (2, 5, 40, 200):
        word = "".join(rng.choice("aeinrstlo") for _ in range(n)).encode()
        assert vocabulary.long(word).tolist() == vocabulary.rounds([word])[0].tolist()


def test_the_memory_of_words_may_be_dropped():
    vocabulary = bpe.Vocabulary(VOCABULARY)
    vocabulary.REMEMBERED = 3
    first = vocabulary.encode(["one two three four five"])[1].tolist()
    assert vocabulary.encode(["one two three four five"])[1].tolist() == first


# repetition
def brute(text):
    w = [x.lower() for x in re.findall(r"[^\W\d_]+", text or "")]
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - 7):
        g = tuple(w[i : i + 8])
        if g in seen:
            hit[i : i + 8] = [True] * 8
        seen.add(g)
    return len(w), sum(hit) / len(w) if w else 0.0


def test_repetition_equals_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("a b c d e f g hé".split()) for _ in range(rng.randrange(80))) for _ in range(200)]
    texts += ["", None, "1 2 3", "A b C d E f G h " * 9, "word " * 8, "word " * 9, "é́ " * 20, "x" * 50_000]
    w = words_of(texts)
    for t, n, share, row in zip(texts, np.bincount(w.doc, minlength=len(texts)), repeated_share(w), statistics(w), strict=True):
        assert (n, share) == pytest.approx(brute(t))
        # what the cut rests on: the statistics of words and pairs bound the share
        told = dict(zip([f for f, _ in FEATURES], row, strict=True))
        assert share <= min(1 - told["new_words"], told["repeat_2"] * 8 / 7, told["run_2"]) + 1e-9 and (share == 0 or told["longest_run"] >= BOUNDS["longest_run"])
    rows = spark.createDataFrame([(i % 200, t, i) for i, t in enumerate(texts)], "doc_id long, text string, score long")
    out = repetition(rows)
    want = sorted(i % 200 for i, t in enumerate(texts) if brute(t)[1] >= 0.3)
    assert sorted(r["doc_id"] for r in out.where("repeated").collect()) == want and out.count() == len(texts)
    assert sorted(round(r["repeated_share"], 9) for r in out.collect()) == sorted(round(brute(t)[1], 9) for t in texts)
    assert sorted(r["doc_id"] for r in repetition(rows, every=False).where("repeated").collect()) == want
    assert repetition(rows.limit(0)).count() == 0


def test_repetition_unlike_the_sample_is_found(spark):
    """The trees see only documents that repeat as a block; sentences that come again here and there are found all the same."""
    letters = "abcdefghij"
    fresh = iter("".join(letters[int(d)] for d in str(n)) for n in range(10**6))
    new = lambda n: " ".join(next(fresh) for _ in range(n))
    block = [(100 + i, " ".join([new(30)] * 4) if i % 8 == 0 else new(120)) for i in range(200)]
    scattered = " ".join(new(8) + " this one sentence of eight words comes again" for _ in range(12))
    assert brute(scattered)[1] >= 0.3
    x = statistics(words_of([t for _, t in block]))
    model = fit_trees(x, np.array([i % 8 == 0 for i in range(200)], float), np.array([d for _, d in FEATURES]))
    model.cut = least_score(model, BOUNDS)
    assert model.score(statistics(words_of([scattered])))[0] >= model.cut
    rows = spark.createDataFrame([*block, (1, scattered), (2, new(200)), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in repetition(rows, sample=50).where("repeated").collect()} == {1, *(100 + i for i in range(0, 200, 8))}


def test_no_case_scores_under_the_cut():
    rng = np.random.default_rng(2)
    x = rng.random((600, len(FEATURES))) * np.array([8, 1, 1, 1, 1, 6])
    y = (x[:, 4] + x[:, 0] / 20 + 0.4 * rng.random(600) > 0.8).astype(float)
    model = fit_trees(x, y, np.array([d for _, d in FEATURES]))
    cut = least_score(model, BOUNDS)
    cases = rng.random((20_000, len(FEATURES))) * np.array([8, 1, 1, 1, 1, 6])
    for i, (name, direction) in enumerate(FEATURES):
        if name in BOUNDS:
            cases[:, i] = np.minimum(cases[:, i], BOUNDS[name]) if direction < 0 else np.maximum(cases[:, i], BOUNDS[name] - SLACK / 2)
    assert (model.score(cases) >= cut).all() and (model.score(x) < cut).any()


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((800, len(FEATURES)))
    y = (x[:, 4] + 0.3 * rng.random(800) > 0.7).astype(float)
    model = fit_trees(x, y, np.array([d for _, d in FEATURES]))
    assert ((model.score(x) > 0) == (y > 0)).mean() > 0.9
    base = rng.random((50, len(FEATURES)))
    for f, (_, direction) in enumerate(FEATURES):
        if direction:
            steps = np.repeat(base, 11, axis=0)
            steps[:, f] = np.tile(np.linspace(0, 1, 11), 50)
            change = np.diff(model.score(steps).reshape(50, 11), axis=1)
            assert (direction * change >= -1e-9).all()


# leakage
def plain_words(text):
    text = unicodedata.normalize("NFKD", re.sub(r"<[^>]{0,40}>", "", text or "")).casefold()
    return re.findall(r"[^\W_]+", "".join(c for c in text if not unicodedata.combining(c) and c not in "​*"))


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for n, s in ((50, 3), (300, 2), (1000, 40)):
        t = rng.integers(1, s + 1, n).astype(np.int32)
        t[-1] = 0
        assert suffix_array(t, s + 1).tolist() == sorted(range(n), key=lambda i, t=t: tuple(t[i:]))
        index = FMIndex(t, s + 1, 5)
        patterns = rng.integers(1, s + 1, (30, 2))
        for p, a, b in zip(patterns, *index.search(patterns), strict=True):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(n - 1) if tuple(t[i : i + 2]) == tuple(p)]


def test_occurrences_equal_brute_force():
    rng = random.Random(7)
    words = "un deux trois quatre".split()
    items = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(4)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(20)] + [None, "", items[0], items[0]]
    got = sorted(zip(*(x.tolist() for x in occurrences(Phrases.of(list(range(4)), items), texts)), strict=True))
    want = []
    for t, text in enumerate(texts):
        w = plain_words(text)
        for i, item in enumerate(items):
            v = plain_words(item)
            want += [(t, i, o, p) for o in range(len(v) - RUN + 1) for p in range(len(w) - RUN + 1) if v[o : o + RUN] == w[p : p + RUN]]
    assert got == sorted(want)


def test_leaks(spark):
    item = "Good matches depict the framed bookshelf named after Enkáfal beside the heavy brochure today"
    half = " ".join(item.split()[:7])
    texts = [
        item.upper(), item.replace("framed", "<span>framed</span>"), f"before {half}, and after", " ".join(item.split()[:5]), "Good  matches\r\ndepict, **the** framed - bookshelf named",
        unicodedata.normalize("NFD", item), "", None, item, "\x1e".join(item.split()), f"{' '.join(item.split()[:6])} other words {' '.join(item.split()[8:])}",
    ]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "")], "id int, expected string")
    found = {r["doc_id"]: r for r in leaks(rows, items).collect()}
    assert set(found) == {0, 1, 2, 4, 5, 8, 9, 10} and {r["item_id"] for r in found.values()} == {1}
    assert all(r["items_too_short"] == 2 for r in found.values())
    assert found[2]["found_words"] == 7 and [tuple(x) for x in found[2]["spans"]] == [(1, 8)]
    assert leaks(rows.limit(0), items).count() == 0 and leaks(rows, items.limit(0)).count() == 0


def test_many_items_take_several_passes(spark, monkeypatch):
    import quarry.llm.leakage as module

    monkeypatch.setattr(module, "ITEMS_PER_PASS", 2)
    items = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon zeta number{i}") for i in range(7)], "id int, expected string")
    rows = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta number3"), (2, "other words alone"), (3, None)], "doc_id long, text string")
    one = sorted(tuple(r) for r in module.leaks(rows, items).select("doc_id", "item_id", "found_words").collect())
    assert [r[1] for r in one] == list(range(7)) and {r[0] for r in one} == {1}
    monkeypatch.setattr(module, "ITEMS_PER_PASS", 4000)
    assert one == sorted(tuple(r) for r in module.leaks(rows, items).select("doc_id", "item_id", "found_words").collect())
