"""The registered queries against their check SQL on the smallest tables."""

import re

import duckdb
import pytest

from gristmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_check_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    rows = QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(rel.fetchall())
