"""Drill-downs and error breakdowns inside an anomaly window.

Inputs are already restricted to the window (see
:mod:`paylens.operators.windows`).  Every aggregate is a partial + final hash
aggregate on low-cardinality keys; every top-k is ``orderBy(...).limit(k)``,
which Spark plans as a per-partition top-k followed by a merge of k rows per
partition (``TakeOrderedAndProject``) — no global sort of the input.

The reference's top-k queries have no tie-breaker; here every ordering ends
with the group keys so results are deterministic.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.config import (
    DIMS, ERROR_SEGMENT, TOPK_APP, TOPK_DRILL_USERS, TOPK_ERRORS, TOPK_ERRORS_ALERT, TOPK_PROVIDER,
    TOPK_REGION, TOPK_SAMPLE, TOPK_SEGMENTS_ALERT,
)
from paylens.functions.expr import cents, from_cents, is_fail, is_success, ntz, ratio, round_half_up, segment_condition
from paylens.operators.cube import BUCKET

ERROR_KEYS = (*DIMS, "error_code")


def _keys_asc(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in keys]


def order_top(df: DataFrame, first: Column, keys: Sequence[str], k: int | None) -> DataFrame:
    """``ORDER BY first, keys… [LIMIT k]`` — keys break ties deterministically."""
    ordered = df.orderBy(first, *_keys_asc(keys))
    return ordered.limit(k) if k else ordered


_top = order_top


# -- gold (KPI cube) drill-downs ------------------------------------------------

def drill_version(kpi_in_window: DataFrame) -> DataFrame:
    keys = ["platform", "app_version"]
    g = kpi_in_window.groupBy(*keys).agg(
        F.sum("pay_attempts").alias("attempts"),
        F.sum("pay_success").alias("success"),
        F.sum("pay_fail").alias("fails"),
        F.sum(cents("revenue")).alias("_rev"),
    )
    g = g.select(*keys, "attempts", "success", "fails",
                 round_half_up(ratio("success", "attempts"), 4).alias("success_rate"),
                 from_cents("_rev").alias("revenue"))
    return _top(g, F.col("success_rate").asc_nulls_last(), keys, None)


def drill_region(kpi_in_window: DataFrame, k: int = TOPK_REGION) -> DataFrame:
    keys = ["platform", "app_version", "region"]
    g = kpi_in_window.groupBy(*keys).agg(
        F.sum("pay_attempts").alias("attempts"),
        F.sum("pay_success").alias("success"),
        F.sum("pay_fail").alias("fails"),
    )
    g = g.select(*keys, "attempts", "success", "fails",
                 round_half_up(ratio("success", "attempts"), 4).alias("success_rate"))
    return _top(g, F.col("success_rate").asc_nulls_last(), keys, k)


def drill_provider(kpi_in_window: DataFrame, k: int = TOPK_PROVIDER) -> DataFrame:
    keys = list(DIMS)
    g = kpi_in_window.groupBy(*keys).agg(
        F.sum("pay_attempts").alias("attempts"),
        F.sum("pay_fail").alias("fails"),
    )
    g = g.select(*keys, "attempts", "fails", round_half_up(ratio("fails", "attempts"), 4).alias("fail_rate"))
    return _top(g, F.col("fail_rate").desc_nulls_last(), keys, k)


def drill_all(kpi_in_window: DataFrame) -> DataFrame:
    """The three drill levels in one pass (GROUPING SETS over the hierarchy)."""
    p, v, r, pr = DIMS
    g = kpi_in_window.groupingSets(
        [[p, v], [p, v, r], [p, v, r, pr]], p, v, r, pr
    ).agg(
        F.grouping_id().alias("_gid"),
        F.sum("pay_attempts").alias("attempts"),
        F.sum("pay_success").alias("success"),
        F.sum("pay_fail").alias("fails"),
        F.sum(cents("revenue")).alias("_rev"),
    )
    level = F.when(F.col("_gid") == 3, 2).when(F.col("_gid") == 1, 3).otherwise(4)
    return g.select(
        level.alias("drill_level"), p, v, r, pr, "attempts", "success", "fails",
        round_half_up(ratio("success", "attempts"), 4).alias("success_rate"),
        round_half_up(ratio("fails", "attempts"), 4).alias("fail_rate"),
        from_cents("_rev").alias("revenue"),
    )


def segment_vs_rest(kpi_df: DataFrame, segment: Mapping[str, str], as_of: _dt.date) -> DataFrame:
    """Per bucket of the day: failures/attempts inside the segment vs the rest."""
    inside = segment_condition(segment)
    zero = F.lit(0).cast("bigint")
    g = kpi_df.where(F.to_date(BUCKET) == F.lit(as_of)).groupBy(BUCKET).agg(
        F.sum(F.when(inside, F.col("pay_fail")).otherwise(zero)).alias("affected_fails"),
        F.sum(F.when(inside, F.col("pay_attempts")).otherwise(zero)).alias("affected_attempts"),
        F.sum(F.when(~inside, F.col("pay_fail")).otherwise(zero)).alias("healthy_fails"),
        F.sum(F.when(~inside, F.col("pay_attempts")).otherwise(zero)).alias("healthy_attempts"),
    )
    one = F.lit(1).cast("bigint")
    return g.select(
        "*",
        (F.col("affected_fails").cast("double") / F.greatest("affected_attempts", one).cast("double")).alias("affected_fail_rate"),
        (F.col("healthy_fails").cast("double") / F.greatest("healthy_attempts", one).cast("double")).alias("healthy_fail_rate"),
    ).orderBy(BUCKET)


# -- silver (raw payments) breakdowns ---------------------------------------------

def top_errors(payments_in_window: DataFrame, k: int | None = TOPK_ERRORS) -> DataFrame:
    """Failures by segment and error code (also used on the shifted window)."""
    g = payments_in_window.where(is_fail()).groupBy(*ERROR_KEYS).agg(F.count(F.lit(1)).alias("error_count"))
    return _top(g, F.col("error_count").desc(), ERROR_KEYS, k)


def error_counts_now_vs_prev(tagged_failures: DataFrame) -> DataFrame:
    """Failures per segment × code in the window (``tag='now'``) and the same
    window a day earlier (``tag='prev'``), from ONE scan of the payments.

    Replaces two grouped queries plus a full outer join with a single
    conditional aggregate.
    """
    return tagged_failures.where(is_fail()).groupBy(*ERROR_KEYS).agg(
        F.count_if(F.col("tag") == "now").alias("error_count"),
        F.count_if(F.col("tag") == "prev").alias("prev_error_count"),
    )


def error_delta(tagged_failures: DataFrame) -> DataFrame:
    g = error_counts_now_vs_prev(tagged_failures)
    g = g.withColumn("delta", F.col("error_count") - F.col("prev_error_count"))
    return g.orderBy(F.col("delta").desc(), *_keys_asc(ERROR_KEYS))


def error_distribution(payments_in_window: DataFrame, segment: Mapping[str, str] = ERROR_SEGMENT) -> DataFrame:
    g = payments_in_window.where(is_fail() & segment_condition(segment)).groupBy("error_code").agg(
        F.count(F.lit(1)).alias("cnt"))
    return _top(g, F.col("cnt").desc(), ["error_code"], None)


def segment_fail_rate(payments_in_window: DataFrame, k: int | None = TOPK_SEGMENTS_ALERT,
                      min_attempts: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Fail rate per segment from raw payments; ``min_attempts`` > 1 keeps
    one-payment segments from topping the list (default 1 = reference)."""
    keys = [*keep, *DIMS]
    g = payments_in_window.groupBy(*keys).agg(
        F.count_if(is_fail()).alias("fails"),
        F.count(F.lit(1)).alias("attempts"),
    )
    g = g.where(F.col("attempts") >= min_attempts).select(
        *keys, "fails", "attempts", round_half_up(ratio("fails", "attempts"), 4).alias("fail_rate"))
    return _top(g, F.col("fail_rate").desc_nulls_last(), keys, k)


def errors_by_provider(payments_in_window: DataFrame, k: int = TOPK_ERRORS_ALERT) -> DataFrame:
    keys = ["platform", "app_version", "provider", "error_code"]
    g = payments_in_window.where(is_fail()).groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    return _top(g, F.col("cnt").desc(), keys, k)


def error_drill_users(payments_in_window: DataFrame, k: int = TOPK_DRILL_USERS) -> DataFrame:
    """Failures and distinct failing users per segment × code.

    The distinct count is planned as an aggregate on (keys, user_id) first,
    so a hot segment is spread over the user ids, not funnelled into one task.
    """
    g = payments_in_window.where(is_fail()).groupBy(*ERROR_KEYS).agg(
        F.count(F.lit(1)).alias("error_count"),
        F.count_distinct("user_id").alias("affected_users"),
    )
    return _top(g, F.col("error_count").desc(), ERROR_KEYS, k)


def sample_failures(payments_in_window: DataFrame, segment: Mapping[str, str] = ERROR_SEGMENT,
                    k: int = TOPK_SAMPLE, keep_id: bool = False) -> DataFrame:
    """First ``k`` failures of the segment in time order (log excerpt); ``keep_id`` adds the order's tie-breaker."""
    f = payments_in_window.where(is_fail() & segment_condition(segment))
    return f.orderBy("event_ts", "event_id").limit(k).select(
        *(["event_id"] if keep_id else []), "event_ts", "user_id", "provider", "error_code", "amount")


def top_error_codes(payments_in_window: DataFrame, k: int | None = TOPK_APP) -> DataFrame:
    g = payments_in_window.where(is_fail()).groupBy("error_code").agg(F.count(F.lit(1)).alias("cnt"))
    return _top(g, F.col("cnt").desc(), ["error_code"], k)


def fail_rate_by_platform(payments: DataFrame) -> DataFrame:
    """Dashboard tile: daily fail rate per platform over the whole table."""
    g = payments.groupBy(F.to_date("event_ts").alias("dt"), "platform").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(is_fail()).alias("fails"),
    )
    return g.select("dt", "platform", "attempts", "fails", round_half_up(ratio("fails", "attempts"), 4).alias("fail_rate"))


def fail_rate_per_platform(payments: DataFrame) -> DataFrame:
    """Dashboard tile: fail rate per platform over the whole table."""
    g = payments.groupBy("platform").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(is_fail()).alias("fails"))
    return g.select("platform", "attempts", "fails", round_half_up(ratio("fails", "attempts"), 4).alias("fail_rate"))


# -- validation queries of the data load ----------------------------------------------

def validate_segment_status(payments: DataFrame, as_of: _dt.date, segment: Mapping[str, str],
                            hours: tuple[int, int] = (9, 11)) -> DataFrame:
    """Status counts of a segment in an hour band, from the start of ``as_of`` on."""
    f = payments.where(
        (F.col("event_ts") >= ntz(as_of))
        & F.hour("event_ts").between(hours[0], hours[1])
        & segment_condition(segment)
    )
    g = f.groupBy(*DIMS, "payment_status").agg(F.count(F.lit(1)).alias("cnt"))
    return g.orderBy(*_keys_asc(["provider", "payment_status", "platform", "app_version", "region"]))


def validate_hourly_success(payments: DataFrame, as_of: _dt.date) -> DataFrame:
    """Success rate (percent) per hour of day, from the start of ``as_of`` on."""
    g = payments.where(F.col("event_ts") >= ntz(as_of)).groupBy(F.hour("event_ts").alias("hr")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_success()).alias("success"),
    )
    pct = round_half_up(ratio("success", "total") * F.lit(100), 2)
    return g.select("hr", "total", "success", pct.alias("success_rate_pct")).orderBy("hr")
