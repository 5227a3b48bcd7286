"""Every registered query against its DuckDB oracle on the smallest driver
scale (the driver runs the same comparison at sf0.01)."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
FAST = os.environ.get("OPSLENS_FAST_TESTS") == "1"


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_most_queries_have_an_oracle():
    assert len(ORACLES) >= 0.75 * len(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0 and len(df.columns) > 0


@pytest.mark.parametrize("name", sorted(ORACLES) if not FAST else sorted(ORACLES)[:10])
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    s = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    d = _rows(cols, res.fetchall())
    assert sorted(sdf.columns) == sorted(cols)
    assert s == d


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "z_score" in df.columns
