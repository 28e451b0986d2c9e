"""Every registered query against its DuckDB oracle at sf0.01;
rows-only keys must at least run and keep a stable schema."""

import os

import duckdb
import pytest

from tests.conftest import SF001
from tools.check_oracle import TABLES, rows_of

import __spark_entry__ as E

from brokerlens.plans.catalog import REGISTRY

# the catalog; the training-data queries have tests of their own
QUERIES = {k: f for k, f in E.queries().items() if k in REGISTRY}
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    if key not in ORACLE:
        assert df.columns, key
        return
    rel = con.sql(ORACLE[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, rows) == rows_of(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["general_ip", "request_count", "duplicate_rate", "unique_topics", "suspicion_score"]
    assert len(df.collect()) == 10
