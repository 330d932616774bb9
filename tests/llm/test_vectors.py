"""Near-duplicate vectors and exact search against brute force and defined cases."""

import numpy as np
import pytest

from gristmill.llm import cap_filters, topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, weight int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "s") for i, v in rows], SCHEMA).repartition(3)


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]


@pytest.mark.parametrize("cell", [cap_filters.CELL, 16])
def test_links_match_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(cap_filters, "CELL", cell)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16))
    near = np.repeat(base[:3], 30, axis=0) + 0.12 * rng.normal(size=(90, 16))
    x = np.concatenate([base, near, near[:5]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + ODD + [(950, [2.0, 0.0])]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    comp = np.arange(len(x))
    while (new := np.minimum(comp, np.where(linked, comp[None, :], len(x)).min(axis=1))).tolist() != comp.tolist():
        comp = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cap_filters.near_duplicates(table(spark, rows)).collect()}
    found = sum(got[k][0] for k in range(len(x)))
    assert found <= linked.sum() and found >= 0.99 * linked.sum()
    assert [got[k][1] for k in range(len(x))] == comp.tolist()
    for i, _ in ODD[:-1]:
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False) and got[950] == (0, 950, True) and len(got) == len(rows)


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(12)
    for n, d in ((2_000, 64), (20_000, 64), (200_000, 64), (2_000_000, 64), (5_000, 2), (5_000, 6)):
        x, y = cap_filters.unit(rng.normal(size=(800, d))), rng.normal(size=(800, d))
        y = 0.9 * x + np.sqrt(0.19) * cap_filters.unit(y - (y * x).sum(axis=1, keepdims=True) * x)
        own, near, scaled = ([set() for _ in x] for _ in range(3))
        for found, rows in ((own, x), (near, y), (scaled, cap_filters.unit(3 * x))):
            for row, code in zip(*cap_filters.decode(rows, *cap_filters.plan(n, d, 0.9))):
                found[row].add(code)
        assert np.mean([not a & b for a, b in zip(own, near)]) < 0.025, (n, d)
        assert all(a & b for a, b in zip(own, scaled)), (n, d)


def test_recall_among_twenty_thousand(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    y = cap_filters.unit(rng.normal(size=(400, 64)))
    x[-400:] = cap_filters.unit(x[:400]) * 0.905 + np.sqrt(1 - 0.905**2) * y
    x = x.astype(np.float32)
    u = cap_filters.unit(x.astype(float))
    links = sum(int((u[k : k + 1000] @ u.T >= 0.9).sum()) for k in range(0, len(u), 1000)) - len(u)
    got = cap_filters.near_duplicates(table(spark, [(k, v.tolist()) for k, v in enumerate(x)]))
    assert links > 200 and 0.97 * links <= sum(r["n_links"] for r in got.collect()) <= links


def test_repeated_rows_link_with_each_other(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 2.0])]
    got = sorted(tuple(r) for r in cap_filters.near_duplicates(table(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_long_vectors_of_different_lengths(spark):
    rng = np.random.default_rng(8)
    rows, groups = [], {}
    for d in (1_022, 1_023, 1_100, 1_536):
        base = rng.normal(size=(3, d))
        for k in range(15):
            vec_id = len(rows)
            groups.setdefault((d, k % 3), []).append(vec_id)
            rows.append((vec_id, (base[k % 3] + 0.05 * rng.normal(size=d)).tolist()))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cap_filters.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: (4, min(ids)) for ids in groups.values() for i in ids}


def test_a_common_vector_and_double_precision(spark):
    rng = np.random.default_rng(6)
    common = rng.normal(size=8)
    rows = [(k, common.tolist()) for k in range(400)] + [(1000 + k, v.tolist()) for k, v in enumerate(rng.normal(size=(40, 8)))]
    doubles = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in cap_filters.near_duplicates(doubles).collect()}
    assert [got[i] for i, _ in rows] == links.tolist()


def test_no_vectors(spark):
    empty = table(spark, [(1, [1.0])]).where("vec_id < 0")
    assert cap_filters.near_duplicates(empty).count() == 0 and topk_search.top_k(empty).count() == 0


def brute_top(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = np.floor(64 * np.array(v, np.float32).astype(float)).astype(int).tolist()
    out = []
    for q in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("band", [topk_search.BAND, 32])
def test_search_matches_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(topk_search, "BAND", band)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 16)) * np.exp(rng.normal(size=(150, 1)))
    x[40:60] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + ODD + [(7, x[7].tolist()), (40 * 50, [3.0, -1.0])]
    got = sorted(tuple(r) for r in topk_search.top_k(table(spark, rows), block=4).collect())
    assert got == brute_top(rows, 20, 20)


def test_large_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (v * 2.0 ** (17 + k % 5)).tolist()) for k, v in enumerate(rng.normal(size=(60, 6)))] + [(500 * 20, [1e17] * 6), (10_001, [1e30] * 6)]
    got = sorted(tuple(r) for r in topk_search.top_k(table(spark, rows)).collect())
    assert got == brute_top(rows[:-2], 20, 20)


def test_blocks_of_queries():
    counts = [(1, 5), (2, 3), (4, 25), (5, 1), (9, 9), (10, 1)]
    assert topk_search.blocks_of(counts, 10) == [(1, 0, 1), (2, 0, 1), (4, 1, 3), (5, 4, 1), (9, 4, 1), (10, 5, 1)]


def pruned(x, every=20, k=20):
    """Share of (query, candidate) pairs that are never scored, in one cell of all vectors by descending length."""
    x = np.floor(64 * x)
    _, squares, turn = np.linalg.svd(x.T @ x)
    left = 1 - np.cumsum(squares) / squares.sum()
    levels = sorted({int(np.searchsorted(-left, -share)) + 1 for share in topk_search.LEFT})
    order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
    ids = np.arange(len(x))
    asked = ids % every == 0
    cell = topk_search.Cell(ids[asked], x[asked], np.full(asked.sum(), topk_search._LOWEST), k, turn.T, levels)
    for lo in range(0, len(x), topk_search.STEP):
        some = order[lo : lo + topk_search.STEP]
        cell.meet(ids[some], x[some])
    best = np.sort(np.where(ids == ids[asked][:, None], -np.inf, x[asked] @ x.T), axis=1)[:, -k:]
    assert np.array_equal(np.sort(cell.found[2].reshape(-1, k), axis=1), best)
    return 1 - cell.scored / (asked.sum() * len(x))


def test_bounds_prune(capsys):
    rng = np.random.default_rng(1)
    even = cap_filters.unit(rng.normal(size=(6000, 64)))
    skewed = even * np.exp(rng.normal(size=(6000, 1)))
    spread = rng.normal(size=(6000, 64)) * 0.85 ** np.arange(64)
    shares = [pruned(x) for x in (even, skewed, spread @ np.linalg.qr(rng.normal(size=(64, 64)))[0])]
    print("pruned:", [round(s, 3) for s in shares])
    assert shares[0] > 0.85 and shares[1] > 0.9 and shares[2] > 0.9


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, -1.0])]
    got = sorted(tuple(r) for r in topk_search.top_k(table(spark, rows)).collect())
    assert got == brute_top(rows, 20, 20)
