"""Numbering the rows of an already-limited result.

A top-k result has at most ``k`` rows.  Numbering it with
``row_number().over(Window.orderBy(...))`` would plan a window without a
partition key; instead the k rows are folded by one global aggregate into a
sorted array and exploded with their position — the same single small task,
stated explicitly, with no window over unbounded input anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_rows(limited: DataFrame, sort_keys: Sequence[Column], name: str = "rank") -> DataFrame:
    """``limited`` plus a 1-based ``name`` column in ``sort_keys`` order.

    ``sort_keys`` sort ascending (negate a numeric key for descending);
    ``limited`` must be bounded (a top-k or dimension-bounded result).
    """
    row = F.struct(*[F.col(c) for c in limited.columns]).alias("_row")
    keyed = F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(sort_keys)], row)
    folded = limited.agg(F.array_sort(F.collect_list(keyed)).alias("_rows"))
    return folded.select(F.posexplode("_rows").alias("_pos", "_e")).select(
        (F.col("_pos") + 1).cast("int").alias(name), "_e._row.*")
