"""Every registered query runs on the smallest tables; those with a SQL oracle
match DuckDB on the same parquet files; the flagship entry runs."""

import math

import duckdb
import pytest

from conftest import SF_SMALL
from logweave.plans import all_queries
from logweave.sources.tables import TABLES

QUERIES, ORACLES = all_queries()


def _norm(v):
    if v is None or v is getattr(__import__("pandas"), "NA", None):
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(repr(_norm(x)) for x in rec) for rec in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    if name in ORACLES:
        exp = duck.execute(ORACLES[name]).fetchdf()
        assert _rows(got) == _rows(exp)


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
