"""Every registered query with SQL against the DuckDB oracle on the smallest scale,
plus the rows-only ones for a non-empty, stable schema."""

import pytest

from medialens.plans.compare import compare, duck
from medialens.plans.registry import oracle_sql, queries

from .conftest import SF_SMALL

Q = queries()
O = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(O))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, Q[name], O[name], SF_SMALL)
    assert r["cols_ok"], r["cols"]
    assert r["rows"][0] == r["rows"][1]
    assert r["hash_ok"]


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_rows_only_queries_run(spark, name):
    df = Q[name](spark, SF_SMALL)
    assert df.count() > 0
    assert df.schema == Q[name](spark, SF_SMALL).schema


def test_oracle_keys_are_queries():
    assert set(O) <= set(Q)
    assert len(Q) >= 80
