"""Every query against its DuckDB statement; those without one must give rows."""

import pytest

import __spark_entry__ as contract
from footfall.catalog import catalog
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog()
SQL = {n: text for n, text in contract.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    problem = compare(spark, duck, SF_DIR, name, QUERIES[name], SQL[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry(spark):
    assert {r.site_id for r in contract.entry(spark).collect()} == {"site_a", "site_b", "site_c"}
