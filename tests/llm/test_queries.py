"""The registered queries against their DuckDB statements, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from footfall.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_duckdb(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, wanted))
