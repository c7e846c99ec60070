"""Neighbours, groups and rankings: against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from quarry.llm.clusters import Groups, chains, components
from quarry.llm.neighbours import close_pairs, fit, neighbours
from quarry.llm.ranking import _level, ranking, weighted_median
from quarry.llm.vectorspace import LENGTHS, above, best_columns, get, matrix, put
from quarry.session import scratch

SCHEMA = "id long, hash string, space string, vec array<float>, source string, neighbour int"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []

    def add(space, x, asset):
        rows.append((len(rows) + 1, asset, space, [float(v) for v in x], "s", 0))

    for space, d in LENGTHS.items():
        for g in range(12):
            centre = rng.normal(size=d)
            centre /= np.linalg.norm(centre)
            for i in range(25 if g else 150):
                noise = rng.normal(size=d)
                add(space, 0.92 * centre + 0.39 * noise / np.linalg.norm(noise), f"a{g}_{i % 4}")
        for i in range(60):
            add(space, rng.normal(size=d), f"n{i}")
    same = rows[0][3]
    for i in range(40):
        add("clip", [2 * v for v in same] if i % 2 else same, "copy")
    rows += [(9001, "x", "clip", [0.0] * 96, "s", 0), (9002, "x", "clip", [1.0] * 95, "s", 0), (9003, "x", "clip", [float("nan")] * 96, "s", 0), (9004, "x", "clip", None, "s", 0), (9005, None, "clip", [1e38] * 96, "s", 0), (None, "x", "clip", [1.0] * 96, "s", 0), (9006, "x", "other", [1.0] * 96, "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), rows


def usable(rows, space):
    kept = [(r[0], np.array(r[3], np.float32).astype(float)) for r in rows if r[2] == space and r[0] is not None and r[3] is not None and len(r[3]) == LENGTHS[space]]
    kept = [(i, v / np.linalg.norm(v)) for i, v in kept if np.isfinite(v).all() and np.isfinite(np.linalg.norm(v)) and np.linalg.norm(v) > 0]
    return np.array([i for i, _ in kept]), np.stack([v for _, v in kept])


def test_neighbours(table):
    df, rows = table
    found = neighbours(df).toPandas()
    hits = total = 0
    pairs = set()
    for space in LENGTHS:
        ids, x = usable(rows, space)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        got = found[found.space == space].sort_values("rank")
        assert set(got.id) == set(ids.tolist()) and (got.groupby("id").size() == 10).all() and (got.id != got.neighbour).all()
        by = dict(tuple(got.groupby("id")))
        for k, i in enumerate(ids.tolist()):
            tenth = np.sort(s[k])[-10]
            hits += int((by[i].cosine >= tenth - 1e-6).sum())
            total += 10
            order = np.lexsort((ids, -np.round(s[k], 5)))[:10]
            pairs |= {(min(i, ids[j]), max(i, ids[j])) for j in order if s[k][j] >= 0.96 and np.round(s[k][j], 5) < 0.99999}
        assert by[int(ids[0])].cosine.is_monotonic_decreasing
    assert hits / total >= 0.9
    close = {tuple(r) for r in close_pairs(neighbours(df)).collect()}
    assert pairs <= close


def test_exact_neighbours_miss_none(table):
    df, rows = table
    found = neighbours(df, exact=True).toPandas()
    for space in LENGTHS:
        ids, x = usable(rows, space)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        by = dict(tuple(found[found.space == space].sort_values("rank").groupby("id")))
        assert set(by) == set(ids.tolist())
        for k, i in enumerate(ids.tolist()):
            assert by[i].cosine.to_numpy() == pytest.approx(np.sort(s[k])[::-1][:10], abs=1e-6) and i not in set(by[i].neighbour) and by[i].neighbour.is_unique
    few = neighbours(df.where("id in (1, 2, 3)"), exact=True)
    assert few.count() == 6


def test_few_rows_have_few_neighbours(spark, table):
    df, _ = table
    few = neighbours(df.where("id in (1, 2, 3)")).collect()
    assert len(few) == 6 and {r["rank"] for r in few} == {1, 2}
    assert neighbours(df.limit(0)).count() == 0 and neighbours(df.where("id = 1")).count() == 0


def searched(index, k=10):
    """(id, cosines) of every row, searched in this process."""
    import quarry.llm.neighbours as module

    files = module._Files()
    found = [x for f in range(len(index.blocks)) for n in index.names(f) for x in module._search(index, n, files, k)]
    who, other, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(who)
    return who[order], other[order], cosine[order]


@pytest.fixture(scope="module")
def groups(spark):
    """The index of tight and loose groups of rows, and of rows without a group."""
    import quarry.llm.neighbours as module

    rng = np.random.default_rng(12)
    c = rng.normal(size=(60, 96))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.concatenate([np.repeat(c, 50, axis=0) + rng.normal(size=(3000, 96)) * np.repeat(np.where(np.arange(60) % 3, 0.03, 0.08), 50)[:, None], rng.normal(size=(400, 96))])
    return module.build(spark.createDataFrame([(i, "clip", [float(v) for v in r]) for i, r in enumerate(x)], "id long, space string, vec array<float>"))["clip"]


def test_lists_that_the_angles_rule_out_hold_no_neighbour(groups, monkeypatch):
    import quarry.llm.neighbours as module

    asked, real = [], module._needed
    monkeypatch.setattr(module, "SURE", 2)
    monkeypatch.setattr(module, "_needed", lambda *a: asked.append(real(*a)) or asked[-1])
    got = searched(groups)
    assert asked and 0 < sum(n.sum() for n in asked) < 0.8 * sum(n.size for n in asked)
    monkeypatch.setattr(module, "_needed", lambda *a: np.ones_like(real(*a)))
    whole = searched(groups)
    assert (got[0] == whole[0]).all() and (got[2] >= whole[2] - 1e-6).mean() > 0.9999


def test_a_grown_room_takes_no_smaller_blocks(groups, monkeypatch):
    """Rows of lists are decoded once for a block of the usual size, however many the room holds."""
    import quarry.llm.neighbours as module

    decoded = []
    real = module.Space.distances
    monkeypatch.setattr(module, "GROWS", groups.rows.sum() / 10_000)
    monkeypatch.setattr(module.Space, "distances", lambda self, q, codes, length, at: decoded.append(len(at)) or real(self, q, codes, length, at))
    assert groups.room == 100 * module.ROWS
    got = searched(groups)
    blocks = sum(-(-3400 // s) for s in (module.BLOCK, module.SPARSE_BLOCK))
    assert sum(decoded) <= 3400 * (blocks + 2 * len(groups.blocks)) and max(decoded) <= module.ROWS
    monkeypatch.setattr(module, "ROWS", 300)  # the same in many tiles
    tiled = searched(groups)
    assert max(decoded[-50:]) <= 300 and (tiled[2] == got[2]).mean() > 0.999


def test_values_above_are_all_values_above():
    rng = np.random.default_rng(6)
    for n in (1, 15, 16, 333, 4000):
        x = rng.normal(size=(7, n)).astype(np.float32)
        least = np.array([-9, 9, 0, 1, 2, 2.5, 3], np.float32)
        columns, values = above(x, least)
        for r in range(7):
            assert sorted(columns[r][columns[r] >= 0].tolist()) == np.flatnonzero(x[r] > least[r]).tolist()
            assert (values[r][columns[r] >= 0] == x[r][columns[r][columns[r] >= 0]]).all() and (values[r][columns[r] < 0] == -np.inf).all()


def test_tables_and_products_are_the_same_distance(table):
    df, rows = table
    index = fit(df, "clip", 600, "/nowhere")
    _, x = usable(rows, "clip")
    x = x.astype(np.float32)[:40]
    at = (x @ index.centroids.T).argmax(1)
    codes, length = index.encode(x, at)
    assert index.distances(x[:3], codes, length, at) == pytest.approx(index.distances(x[:20], codes, length, at)[:3], abs=1e-4)


def test_best_columns():
    rng = np.random.default_rng(0)
    for n in (5, 100, 5003):
        scores = rng.random((7, n)).astype(np.float32)
        best = best_columns(scores, min(9, n))
        assert (np.sort(np.take_along_axis(scores, best, 1), axis=1) == np.sort(scores, axis=1)[:, -min(9, n) :]).all()


def test_files_of_arrays(spark):
    at = f"{scratch(spark, 'files')}/x"
    put(at, {"a": np.arange(5), "b": np.zeros(0)})
    put(at, {"a": np.arange(5), "b": np.zeros(0)})
    got = get(at)
    assert np.frombuffer(got["a"], np.int64).tolist() == [0, 1, 2, 3, 4] and len(got["b"]) == 0 and get(at + "y") == {}
    import pyarrow as pa

    x, rows = matrix(pa.array([[3.0, 4.0], None, [1.0], [0.0, 0.0]], pa.list_(pa.float32())), 2)
    assert rows.tolist() == [0] and x.tolist() == [[pytest.approx(0.6), pytest.approx(0.8)]]


def brute_groups(x, step=0.75):
    label = chains(x, step)
    return [np.flatnonzero(label == k) for k in np.unique(label)]


def test_chains():
    angle = np.deg2rad(np.arange(0, 350, 35.0))
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    assert len(set(chains(x, 0.8).tolist())) == 1 and len(set(chains(x, 0.83).tolist())) == len(x)


def test_groups(spark, table):
    df, rows = table
    assets = spark.createDataFrame([("a1_0", [" Red ", "red", "Blue"]), ("a1_1", ["blue"]), ("a2_0", None), ("copy", [])], "hash string, tags array<string>")
    groups = Groups(df, assets)
    ids, x = usable(rows, "clip")
    want = set()
    sizes = {}
    for g in brute_groups(x):
        if len(g) >= 5:
            m = np.sort(ids[g]).tolist()
            sizes[m[0]] = len(m)
            want |= set(zip(m, m[1:], strict=False))
    assert {tuple(r) for r in groups.pairs().collect()} == want
    assert {tuple(r) for r in groups.pairs(rows_a_bucket=7).collect()} == want
    told = {r["group_id"]: r for r in groups.described().collect()}
    assert {k: r["size"] for k, r in told.items()} == sizes
    one = next(r for r in told.values() if "blue" in r["tags"])
    assert one["tags"][0] == "blue" and len(one["typical"]) == 5 and one["similarity"] == sorted(one["similarity"], reverse=True)
    assert Groups(df.limit(0), assets).pairs().count() == 0 and Groups(df.limit(0), assets).described().count() == 0
    assert Groups(df).described().count() == len(sizes)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (200, 200)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert {roots[i] for i in range(1, 41)} == {1} and roots[102] == 100 and roots[200] == 200


def test_weighted_median():
    share = np.array([[[0.1], [0.5], [0.9]], [[0.3], [np.nan], [0.2]], [[np.nan]] * 3])
    median, mean = weighted_median(share, np.array([1.0, 1.0, 0.75]))
    assert median[:, 0].tolist()[:2] == [0.5, 0.3] and np.isnan(median[2, 0]) and mean[1, 0] == pytest.approx((0.3 + 0.15) / 1.75)


def test_ranking(spark, table, monkeypatch):
    import quarry.llm.ranking as module

    df, rows = table
    hashes = sorted({r[1] for r in rows if r[1]})
    assets = spark.createDataFrame(
        [(h, "image" if i % 2 else "pdf", "a sharp garden" if i % 5 == 0 else None, "x " * i, "clash") for i, h in enumerate(hashes)] + [("alone", None, "sharp", None, ""), ("nothing", "image", None, "", ""), (hashes[0], "pdf", "a sharp garden", "", "")],
        "hash string, kind string, caption string, body string, position string",
    )
    rng = np.random.default_rng(1)
    queries = spark.createDataFrame([(1, "the Sharp garden", rng.normal(size=96).tolist(), rng.normal(size=64).tolist()), (2, None, None, [0.0] * 64)], "id int, query string, clip_vec array<float>, text_vec array<float>")
    got = ranking(queries, assets, df).where("query_id = 1").toPandas().sort_values("position")
    assert got.position.tolist() == list(range(1, len(got) + 1)) and got.hash.is_unique and "nothing" not in set(got.hash) and "alone" in set(got.hash)
    assert got.sort_values(["median_rank", "mean_rank", "hash"]).hash.tolist() == got.hash.tolist()
    kinds = {h: ("image" if i % 2 else "pdf") for i, h in enumerate(hashes)} | {"alone": "", "nothing": "image"}
    q = queries.first()
    best = {}
    for space, v in (("clip", q["clip_vec"]), ("text", q["text_vec"])):
        v = np.array(v, np.float32).astype(float)
        v /= np.linalg.norm(v)
        ids, x = usable(rows, space)
        owner = {r[0]: r[1] for r in rows}
        for i, s in zip(ids.tolist(), x @ v, strict=True):
            if owner[i] in kinds:
                best[space, owner[i]] = max(best.get((space, owner[i]), -2), s)
    clip = {h: int(_level(np.array(s))) for (sp, h), s in best.items() if sp == "clip"}
    only = got[(got.scores == 1)].hash
    for h in list(only)[:20]:
        if h in clip and ("text", h) not in best:
            same = [x for x in clip if kinds[x] == kinds[h]]
            share = (sum(clip[x] > clip[h] for x in same) + (sum(clip[x] == clip[h] for x in same) + 1) / 2) / sum(k == kinds[h] for k in kinds.values())
            assert float(got[got.hash == h].median_rank.iloc[0]) == pytest.approx(share, abs=2e-2)
    # crowds put in order in ranges: the same places
    monkeypatch.setattr(module, "CROWD", 20)
    again = ranking(queries, assets, df).where("query_id = 1").toPandas().sort_values("position")
    assert again.position.tolist() == got.position.tolist() and again.hash.tolist() == got.hash.tolist()
    assert ranking(queries.limit(0), assets, df).count() == 0
    assert ranking(queries, assets.limit(0), df).count() == 0


@pytest.mark.parametrize("apart", [1_000_000, 7])
def test_ranking_tells_close_scores_apart(spark, monkeypatch, apart):
    import quarry.llm.ranking as module

    monkeypatch.setattr(module, "RANGE", apart, raising=False)
    rng = np.random.default_rng(5)
    q = np.zeros(96, np.float32)
    q[0] = 1
    # cosines about 1e-5 apart, some 24 of them on one level
    cosine = 0.3 + 1e-5 * rng.permutation(600)
    rows = []
    for i, c in enumerate(cosine):
        v = np.zeros(96)
        v[0], v[1 + i % 95] = c, np.sqrt(1 - c * c)
        rows.append((i, f"h{i:03d}", "clip", [float(x) for x in v]))
    rows += [(700 + i, f"t{i}", "clip", [2 * x for x in rows[9][3]]) for i in range(3)]
    vectors = spark.createDataFrame(rows, "id long, hash string, space string, vec array<float>").repartition(5)
    assets = spark.createDataFrame([(r[1], "image" if r[0] % 2 else "pdf", None, None) for r in rows], "hash string, kind string, caption string, body string")
    queries = spark.createDataFrame([(1, None, q.tolist(), None)], "id int, query string, clip_vec array<float>, text_vec array<float>")
    got = {r["hash"]: r["median_rank"] for r in module.ranking(queries, assets, vectors).collect()}
    kind = np.array([r[0] % 2 for r in rows])
    score = np.append(cosine, [cosine[9]] * 3)
    for (_, h, _, _), k, x in zip(rows, kind, score, strict=True):
        same = score[kind == k]
        assert got[h] == pytest.approx(((same > x).sum() + ((same == x).sum() + 1) / 2) / len(same), abs=1e-9)


@pytest.mark.parametrize("tight", [0.8, 0.99, 0.0])
def test_links_between_rows_that_share_no_cell(spark, monkeypatch, tight):
    import quarry.llm.clusters as module

    for name, value in (("CELLS", 1), ("LOOSE_CELLS", 1), ("TIGHT", tight), ("LOOSE_ROWS", 50)):
        monkeypatch.setattr(module, name, value, raising=False)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(6):  # long chains by small steps, and rows of no group
        at = rng.normal(size=96)
        for _ in range(60):
            at /= np.linalg.norm(at)
            rows.append(at)
            at = at + 0.6 * rng.normal(size=96) / np.sqrt(96)
    rows += list(rng.normal(size=(60, 96)))
    data = [(i, f"h{i}", "clip", [float(v) for v in x]) for i, x in enumerate(rows)]
    ids, x = usable(data, "clip")
    want = {p for g in brute_groups(x) if len(g) >= 5 for p in zip(ids[g].tolist(), ids[g].tolist()[1:], strict=False)}
    assert {tuple(r) for r in module.Groups(spark.createDataFrame(data, "id long, hash string, space string, vec array<float>")).pairs().collect()} == want and len(want) > 300


def test_copies_take_no_lists_and_no_room(spark):
    import quarry.llm.neighbours as module

    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 96))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, "clip", [float(v) for v in r]) for i, r in enumerate(x)], "id long, space string, vec array<float>")
    index = fit(df, "clip", len(x), "/nowhere")
    assert len(np.unique(np.round(index.centroids, 4), axis=0)) == len(index.centroids) and (index.rows > 0).all() and index.rows.sum() < 1400
    built = module.build(df)["clip"]
    assert built.rows.sum() < 1400 and built.rows.max() < 600
    # a list too full for the room is passed over, those behind it are opened; an empty one isn't
    rows = np.full(40, 10.0)
    rows[[8, 30]] = 10 * module.ROWS, 0
    c = np.eye(96, dtype=np.float32)[:40]
    space = module.Space("clip", "", c, index.books, rows, np.ones(40), [1, 1])
    q = np.linspace(1, 0.5, 96, dtype=np.float32)[None, :]
    assert module._visited(space, q).tolist() == [i for i in range(40) if i not in (8, 30)]
