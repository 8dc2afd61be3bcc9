"""Every query of the library equals its DuckDB oracle (rows, columns, values), on data where none is empty."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from paylens.plans.oracle import oracle_sql
from paylens.plans.oracle_extended import more_sql
from paylens.plans.registry import QUERIES
from paylens.sources.tables import TABLES
from tests.conftest import SF01

SQL = {**oracle_sql(), **more_sql()}
KEYS = sorted(SQL)


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows), key=lambda r: tuple((x is None, repr(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_every_query_has_oracle_or_is_declared_rows_only():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF01)
    got = [tuple(r) for r in df.collect()]
    assert got, "an empty result proves nothing"
    cur = duck.execute(SQL[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    exp = cur.fetchall()
    idx = [cols.index(c) for c in df.columns]
    exp = [tuple(r[i] for i in idx) for r in exp]
    assert _rows(got) == _rows(exp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["bucket_5m", "metric", "actual", "baseline", "z_score", "is_anomaly", "impact_estimated"]
    assert df.count() > 0
