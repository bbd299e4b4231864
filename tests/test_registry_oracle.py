"""Every registered query against its DuckDB oracle at sf0.001 (the driver's
check runs the same at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as entry
from sightline.plans import registry
from tests.conftest import SMOKE_DIR
from tools.oracle_check import TABLES, digest

QUERIES = registry.QUERIES
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SMOKE_DIR)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[key])
    cols = [c[0] for c in res.description]
    expected = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(expected)
    assert digest(df.columns, rows)[0] == digest(cols, expected)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["week", "year", "start_of_year", "week_number", "unique_observations",
                          "cumulative_observations"]
    assert df.count() > 0
