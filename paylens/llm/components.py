"""Connected components of an edge table by alternating large and small stars.

Each round is two groupings with a map-side minimum and two joins (a node with
very many neighbours is one skewed join key, which adaptive execution splits);
its edges are written, so the next round never recomputes the last.  Every edge
set and the result stay on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import written


def _down(e: DataFrame) -> DataFrame:
    """Distinct edges with ``a > b``."""
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _down(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    pulled = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(pulled.unionByName(least.withColumnRenamed("m", "b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``: ``root`` is the smallest node reachable."""
    e, seen = written(_down(edges), "edges"), None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, e = mark, written(_small_star(_large_star(e)), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components ``comp`` after adding ``edges``: only the graph of components is solved anew."""
    root = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = components(between).toDF("root", "top")
    known = comp.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # nodes that had no component of their own
    return known.unionByName(top.join(comp.select(F.col("node").alias("root")), "root", "left_anti").select(
        F.col("root").alias("node"), F.col("top").alias("root")))
