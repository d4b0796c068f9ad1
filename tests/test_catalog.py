"""Every query with oracle SQL returns the same rows as DuckDB does on the same tables."""

import glob
import os

import duckdb
import pytest

from quillon.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows, names, order):
    say = lambda v: f"{v:.5g}" if isinstance(v, float) else str(v)
    at = [names.index(n) for n in order]
    return sorted(tuple(say(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    assert plain(df.collect(), df.columns, order) == plain(got.fetchall(), names, order)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
