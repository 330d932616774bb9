"""Jaccard join and mixing against brute force and defined cases."""

import random
import re

import duckdb
import pyarrow as pa
import pytest

from gristmill.llm import jaccard_join, mixing


def brute_components(rows, size, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        grams = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] or ([tuple(words)] if words else [])
        sets[doc] = set(grams)
    root = {d: d for d in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def edited_copies(seed, groups, copies, length):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(25)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)] + (passage if g % 2 else [])
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 1)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("most_frequent", [1, 1 << 12])
def test_components_match_brute_force(make, most_frequent):
    rows = edited_copies(5, 9, 8, 60) + [(500 + k, t) for k, t in enumerate(["a b", "A  B", "c", "", "a b c d e"])]
    docs = make([(i, t, "en", "s") for i, t in rows], parts=5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, most_frequent=most_frequent).collect()}
    want = brute_components(rows, 4, 85)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(rows) - 20


def test_odd_rows(odd, nothing):
    got = {}
    for r in jaccard_join.jaccard_components(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got[1] == [(0, 1)] and got[2] == [(0, 2)] and got[3] == [(0, 3)]
    assert got[6] == [(1, 6)] and got[8] == [(1, 6)]
    assert got[7] == [(3, 7), (3, 7)] and got[None] == [(3, None)]
    assert got[4] == [(1, 4)] and got[5][0][0] > 900
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_rows_of_gone_ids_go_and_all_columns_stay(odd, spark):
    kept = jaccard_join.without_ids(odd, spark.createDataFrame([(7,), (8,)], "x long"))
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, None, 9]))


def oracle(rows):
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": pa.array([r[2] for r in rows], pa.string())})
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(mixing.ORACLE_SQL).fetchall()


def test_mix_matches_sql_and_targets(make):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "b", "hot", "hot", "hot", None, "é"])) for k in range(300)]
    docs = make([(i, t, "en", s) for i, t, s in rows])
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, mixing.mix(docs).select(*columns).collect()))
    assert got == sorted(oracle(rows))
    taken = {}
    for _, source, size, _, target, t in got:
        assert t <= 2 * size
        taken.setdefault((source, target), []).append(t)
    for (_, target), parts in taken.items():
        assert abs(sum(parts) - target) <= 15
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in again.where("n_chars > 0").groupBy("doc_id").count().collect()}
    assert times == {d: t // size for d, _, size, _, _, t in got if t}


def test_mix_of_odd_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    blank = odd.where("doc_id in (1, 2, 3)")
    assert {(r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0.0, 0)}
