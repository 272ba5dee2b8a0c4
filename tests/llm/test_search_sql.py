"""The searches with SQL, against DuckDB on the tables that their SQL reads."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparkloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = {"op12_topk_search": ["embeddings"], "op13_lexical_search": ["documents", "benchmark"]}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(TABLES))
def test_search_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES[name]:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), c.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    got = sorted(tuple(r[x] for x in columns) for r in df.collect())
    assert got and got == sorted(tuple(r[i] for i in at) for r in want.fetchall())
