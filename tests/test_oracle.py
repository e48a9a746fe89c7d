"""Every registered query against its DuckDB oracle at sf0.01."""

import pytest

import __spark_entry__ as E
from oracle import compare

SF = "/root/testdata/sf0.01"
SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    (n1, c1, h1), (n2, c2, h2), got, exp = compare(spark, name, QUERIES[name], SQL[name], SF)
    assert c1 == c2, f"columns {c1} vs {c2}"
    assert n1 == n2, f"rows {n1} vs {n2}"
    assert h1 == h2, f"values differ:\n{got.sort_values(list(got.columns)).head(10)}\n{exp.sort_values(list(exp.columns)).head(10)}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
