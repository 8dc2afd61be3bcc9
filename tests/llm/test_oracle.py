"""Queries that SQL can express equal their DuckDB SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from paylens.llm.oracle import ORACLE_SQL
from paylens.llm.queries import QUERIES
from tests.conftest import SF01


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, key):
    cur = duck.execute(ORACLE_SQL[key])
    cols = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    df = QUERIES[key](spark, SF01)
    assert sorted(df.columns) == sorted(cols)
    assert want and sorted(map(tuple, df.select(*cols).collect())) == want


def test_every_operator_is_registered():
    keys = E.queries()
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(keys) and set(ORACLE_SQL) <= set(E.oracle_sql())
