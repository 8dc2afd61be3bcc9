"""Distinct users by mergeable sketches.

An exact distinct count of a window reads the window's raw events.  Here the gold
layer keeps, per bucket and segment, a HyperLogLog sketch of the users with a failed
payment and, per day, one of the users seen.  Sketches merge: the users of any window,
segment or roll-up are the union of the sketches below it, whatever the order, and no
event is read again.

A sketch of at most ``3/4 * 2**(lg_k - 3)`` users (6,144 at the default) holds them as a
list and counts them as good as exactly; beyond, the estimate's standard error is
below ``1.04 / sqrt(2**lg_k)`` (0.41 %), whatever the number.  A stored sketch takes
bytes in proportion to its users, at most ``2**lg_k`` (64 KB).

Windows are whole buckets: the last flagged bucket counts to its end, while the exact
``user_impact`` stops at its start.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.config import BUCKET_MINUTES, DIMS
from paylens.functions.expr import bucket_start, is_fail, ntz, ratio, round_half_up
from paylens.operators.cube import BUCKET

LG_K = 16
FAILING = "failing_users"
SEEN = "users"


def error_bound(lg_k: int = LG_K, deviations: int = 3) -> float:
    """Relative error that an estimate stays within, by ``deviations`` standard errors."""
    return round(deviations * 1.04 / math.sqrt(2**lg_k), 4)


def failing_user_sketches(payments: DataFrame, minutes: int = BUCKET_MINUTES, dims: Sequence[str] = DIMS,
                          lg_k: int = LG_K, ts_col: str = "event_ts") -> DataFrame:
    """``gold_users``: per bucket and segment, the sketch of users with a failed payment.

    Built with partial sketches in every task: a segment with a third of all rows sends
    one sketch per task.
    """
    failed = payments.where(is_fail() & F.col("user_id").isNotNull())
    return failed.groupBy(bucket_start(ts_col, minutes).alias(BUCKET), *dims).agg(
        F.hll_sketch_agg("user_id", lg_k).alias(FAILING))


def daily_user_sketches(events: DataFrame, lg_k: int = LG_K, ts_col: str = "event_ts") -> DataFrame:
    """``gold_dau``: per day, the sketch of the users seen."""
    return events.where("user_id is not null").groupBy(F.to_date(ts_col).alias("dt")).agg(
        F.hll_sketch_agg("user_id", lg_k).alias(SEEN))


def estimate(sketch: Column | str) -> Column:
    """Users of the union of sketches, 0 if there is none."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0).cast("bigint"))


def user_impact_from_sketches(gold_users_in_window: DataFrame, gold_dau: DataFrame, as_of: _dt.date,
                              lg_k: int = LG_K) -> DataFrame:
    """Affected users of a window and users of the day, from the gold sketches alone.

    One aggregate over the stacked sketches of both kinds; ``rel_error`` is the bound on
    the relative error of either estimate (three standard errors).
    """
    kind = lambda k: F.lit(k).alias("kind")
    both = gold_users_in_window.select(kind("a"), F.col(FAILING).alias("s")).unionByName(
        gold_dau.where(F.col("dt") == F.lit(as_of)).select(kind("t"), F.col(SEEN).alias("s")))
    of = lambda k: F.when(F.col("kind") == k, F.col("s"))
    g = both.agg(estimate(of("a")).alias("affected_users"), estimate(of("t")).alias("total_dau"))
    pct = F.when(F.col("total_dau") > 0, round_half_up(ratio("affected_users", "total_dau") * F.lit(100), 1)).otherwise(F.lit(0.0))
    return g.select("affected_users", "total_dau", pct.alias("dau_pct"), F.lit(error_bound(lg_k)).alias("rel_error"))


def segment_users(gold_users: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Affected users at every drill level, by merging the sketches below it."""
    levels = [list(dims[:k]) for k in range(len(dims) + 1)]
    g = gold_users.groupingSets([[F.col(c) for c in level] for level in levels], *dims).agg(
        estimate(FAILING).alias("affected_users"), sum((F.grouping(c) for c in dims[1:]), F.grouping(dims[0])).alias("_open"))
    level = (F.lit(len(dims)) - F.col("_open")).cast("int")
    return g.select(level.alias("drill_level"), *dims, "affected_users")


def on_buckets(gold_users: DataFrame, start: _dt.datetime, end: _dt.datetime) -> DataFrame:
    """The sketches of the buckets that start in ``[start, end]``."""
    rows = gold_users.where((F.col(BUCKET) >= ntz(start)) & (F.col(BUCKET) <= ntz(end)))
    if "dt" in gold_users.columns:  # day-partitioned table: static pruning
        rows = rows.where(F.col("dt").between(F.lit(start.date()), F.lit(end.date())))
    return rows
