"""The queries that SQL can express against DuckDB on the driver's tables."""

import duckdb
import pytest

from sightline.llm.oracle import ORACLE
from sightline.llm.queries import QUERIES
from tests.conftest import SMOKE_DIR
from tools.oracle_check import TABLES, digest


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SMOKE_DIR)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[key])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, got)[0] == digest(cols, res.fetchall())[0]
