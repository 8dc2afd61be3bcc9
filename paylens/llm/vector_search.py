"""Exact top-k search over a vector-approximation file (operator 9).

Vectors are compared by the inner product of their components as integers,
``floor(scale * x)``.  The approximation of a vector holds, per component, the
number of the cell it falls in: ``2 ** BITS`` equal cells over the range of all
components.  From cells alone, a query's score is bounded on both sides.

1. *Scan.*  Every block of queries meets every block of approximations; each
   keeps the ``k`` best lower bounds per query, and the ``k``-th best of all of
   them is a score that ``k`` vectors are sure to reach.
2. *Refine.*  Only vectors whose upper bound reaches that score are read, in
   order of their upper bound, until the bound falls below the ``k``-th exact
   score of the block.  The best of all blocks are the answer.

Blocks have a bounded number of rows, dealt by a hash; a query block is sent to
every block of vectors (a stated query set against all rows), never all rows to
one task.  Very common vectors tie, and ties are resolved by the smaller id.

Results: vectors that are NULL, empty or hold a NULL or non-finite component
take no part, neither do rows without id; vectors of different length are not
compared.  Every other row is a candidate, also rows that share the query's id.
Components of any size are kept: products that doubles could round are summed in
whole numbers of any length, and bounds get a margin for rounding.  A score beyond
64 bits is returned as the largest or smallest of 64 bits, ranked by its true value
(up to about 10^56; beyond, scores tie).
With fewer than ``k`` candidates, all are returned.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.common import written

BITS = 8
BLOCK = 4096        # vectors per block
QUERY_BLOCK = 1024  # queries per block
READ = 256          # exact vectors read at a time
LONG = 2**63 - 1
MOST = 10**38 - 1


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``(row, id, dim, v)`` of the rows that take part; ``v`` is ``array<double>`` with integer values."""
    v = F.col(vector_col)
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # rint(x) - 1 where that is above x: doubles beyond 64 bits are whole already
    whole = F.transform(scaled, lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0))
    return (df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(F.size(v) > 0).where(finite)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                    F.size(v).alias("dim"), whole.alias("v")))


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries (rows) and cells (columns)."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    size = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    margin = np.where(size < 2**52, 0.0, size * (q.shape[1] + 8) * 2.0**-50)  # doubles round
    return least - margin, most + margin


def _exact(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Integer scores: by doubles or 64-bit integers where these hold every sum, else by whole numbers of any length."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    if most < 2**53:
        return (x @ q).astype(np.int64).tolist()
    if most < 2**62 and max(np.abs(q).max(), np.abs(x).max()) < 2**62:
        return (x.astype(np.int64) @ q.astype(np.int64)).tolist()
    mine = [int(c) for c in q]
    return [sum(a * int(c) for a, c in zip(mine, row)) for row in x]


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, bits: int = BITS) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` best candidates of every query row."""
    vectors = written(integer_vectors(df, id_col, vector_col, scale), "vectors")
    queries = vectors.where(is_query)
    n, low, high = vectors.agg(F.count(F.lit(1)), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    n_queries = queries.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    width = max(1.0, float(np.ceil(((high or 0.0) - (low or 0.0) + 1) / 2**bits)))
    low = low or 0.0

    cells = F.transform("v", lambda x: F.floor((x - low) / width).cast("int"))
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    approx = written(placed.select("row", "dim", "block", cells.alias("cell")), "cells")
    asked = queries.withColumn("qblock", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumnsRenamed(
        {"id": "query_id", "row": "query_row"})
    # columns of its own: queries and vectors are rows of one table
    asked = asked.select(*[F.col(c).alias(c) for c in ("query_row", "query_id", "v", "dim", "block", "qblock")])
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    key = ["block", "qblock", "dim"]

    def scan(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_row": [], "bound": []})
        qs, cell = np.stack(q["v"].to_list()), np.stack(c["cell"].to_list()).astype(float)
        lo = cell * width + low
        lower, _ = _bounds(qs, lo, lo + (width - 1))
        lower[q["query_row"].to_numpy()[:, None] == c["row"].to_numpy()[None, :]] = -np.inf
        m = min(k, lower.shape[1])
        best = -np.partition(-lower, m - 1, axis=1)[:, :m]
        out = pd.DataFrame({"query_row": np.repeat(q["query_row"].to_numpy(), m), "bound": best.ravel()})
        return out[np.isfinite(out["bound"])]

    rows = approx.withColumn("qblock", every)
    found = asked.select("query_row", "v", *key).groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(
        scan, "query_row long, bound double")
    nth = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("bound")))
    sure = found.withColumn("n", nth).where(F.col("n") <= k).where(F.col("n") == k).select("query_row", "bound")

    def refine(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(c):
            own, ids, exact = c["row"].to_numpy(), c["id"].to_numpy(), np.stack(c["v"].to_list())
            cell = np.stack(c["cell"].to_list()).astype(float)
            lo = cell * width + low
            qs = np.stack(q["v"].to_list())
            _, upper = _bounds(qs, lo, lo + (width - 1))
            for i, (row, qid, bound) in enumerate(zip(q["query_row"], q["query_id"], q["bound"])):
                live = np.flatnonzero((own != row) & ((upper[i] >= bound) | np.isnan(bound)))
                live = live[np.argsort(-upper[i][live], kind="stable")]
                best: list[tuple[int, int]] = []
                for at in range(0, len(live), READ):
                    if len(best) == k and upper[i][live[at]] < -best[-1][0]:
                        break  # no later vector can reach the k-th score
                    part = live[at:at + READ]
                    best = sorted(best + list(zip((-x for x in _exact(qs[i], exact[part])), ids[part].tolist())))[:k]
                # the true value in two parts that keep its order, for scores of more than 64 bits
                out += [(row, qid, j, max(-LONG - 1, min(LONG, -s)), *divmod(-s, 1 << 62)) for s, j in best]
        f = pd.DataFrame(out, columns=["query_row", "query_id", "id", "score", "high", "low"])
        return f.assign(high=[Decimal(max(-MOST, min(MOST, x))) for x in f["high"]])

    both = placed.select("row", "id", "dim", "block", "v", cells.alias("cell")).withColumn("qblock", every)
    asked = asked.join(sure, "query_row", "left").select("query_row", "query_id", "v", "bound", *key)
    hits = asked.groupBy(*key).cogroup(both.groupBy(*key)).applyInPandas(
        refine, "query_row long, query_id long, id long, score long, high decimal(38,0), low long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("high"), F.desc("low"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op9_vector_search(embeddings: DataFrame) -> DataFrame:
    """The 5 best neighbours of every row whose id is divisible by 50."""
    return top_k(embeddings.select("vec_id", "embedding"), F.col("id") % 50 == 0, 5).withColumnRenamed("id", "vec_id")
