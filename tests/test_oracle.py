"""Every registered query with an oracle matches DuckDB on sf0.01."""

import pytest

from qalam.plans.catalog import load_all
from qalam.plans.verify import compare, duckdb_connect

from conftest import SF_MED

NAMES = sorted(n for n, q in load_all().items() if q.sql_fn is not None)


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SF_MED)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, registry, con, name):
    r = compare(spark, con, registry[name], SF_MED)
    assert r["status"] == "match", r
