"""Registered queries against their check SQL on the smallest tables."""

import math

import duckdb
import pytest

from gristmill.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier orders lineitem events documents embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(columns, rows):
    index = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in index) for r in rows), key=repr)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLES:
        rel = tables.execute(ORACLES[name])
        columns = [d[0] for d in rel.description]
        assert sorted(df.columns) == sorted(columns)
        assert ordered(df.columns, got) == ordered(columns, rel.fetchall())


@pytest.mark.parametrize("name", ["lineage", "lineage_report", "review_queue", "decision_reasons"])
def test_rows_are_repaired_once(spark, monkeypatch, name):
    """Decisions and issues read the same staged rows."""
    from gristmill.catalog import file_queries, repair_queries

    plans, repaired = [], repair_queries.repaired_rows
    for module in (file_queries, repair_queries):
        monkeypatch.setattr(module, "repaired_rows", lambda *a: plans.append(a) or repaired(*a))
    QUERIES[name](spark, SF)
    assert len(plans) == 1
