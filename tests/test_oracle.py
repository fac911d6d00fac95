"""Every registered query with a SQL twin agrees with DuckDB on the same parquet tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from pairlab.sources.tables import TABLES
from tools.check_oracle import table_hash

#: Minutes of model fitting; tools/check_oracle.py runs these, and the loops' rules have tests of their own.
SLOW = {"al_loop_fixed", "al_loop_badge", "al_loop_hybrid", "al_campaign", "experiment_grid", "forest_leaf_proximity"}
SQL_NAMES = sorted(set(E.oracle_sql()) - SLOW)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = [tuple(r) for r in res.fetchall()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert table_hash(df.columns, rows) == table_hash(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["row_id", "cosine", "p", "entropy"]
    assert 0 < df.count() <= 96
