"""KPI cube: payments → fixed-width buckets × segment dimensions.

Plan shape: one scan, a projection computing the bucket, a partial hash
aggregate on the map side, one shuffle on (bucket, dims) and the final
aggregate.  The shuffle carries at most buckets × segments partial rows per
task, independent of the number of payments, so a hot segment holding a
third of all rows costs no more than any other (map-side combine absorbs it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.config import BUCKET_MINUTES, DIMS
from paylens.functions.expr import (
    bucket_start, cents, from_cents, is_fail, is_success, micros, ratio, round_half_up, rounded_micros, tod_slot,
)

BUCKET = "bucket_5m"


def bucketize(payments: DataFrame, minutes: int = BUCKET_MINUTES, ts_col: str = "event_ts") -> DataFrame:
    """Payments with the start of their bucket (``bucket_5m``)."""
    return payments.select(
        *[c for c in ("event_id", ts_col) if c in payments.columns],
        bucket_start(ts_col, minutes).alias(BUCKET),
        *DIMS,
        "amount",
        "payment_status",
        "error_code",
    )


def kpi(payments: DataFrame, minutes: int = BUCKET_MINUTES, dims: Sequence[str] = DIMS,
        ts_col: str = "event_ts") -> DataFrame:
    """``gold_kpi_5m``: revenue, attempts, successes, failures, success rate.

    Revenue is ``ROUND(SUM(amount), 2)``: summed exactly in integer millionths
    and rounded once.  Statuses other than success/fail count as attempts only.
    """
    ok = is_success()
    return (
        payments.groupBy(bucket_start(ts_col, minutes).alias(BUCKET), *dims)
        .agg(
            F.sum(F.when(ok, micros("amount")).otherwise(F.lit(0).cast("bigint"))).alias("_rev"),
            F.count(F.lit(1)).alias("pay_attempts"),
            F.count_if(ok).alias("pay_success"),
            F.count_if(is_fail()).alias("pay_fail"),
        )
        .select(
            BUCKET,
            *dims,
            rounded_micros("_rev").alias("revenue"),
            "pay_attempts",
            "pay_success",
            "pay_fail",
            round_half_up(ratio("pay_success", "pay_attempts"), 4).alias("pay_success_rate"),
        )
    )


def kpi_extent(kpi_df: DataFrame) -> DataFrame:
    """Row count and bucket range of the cube."""
    return kpi_df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min(BUCKET).alias("earliest"),
        F.max(BUCKET).alias("latest"),
    )


def overall(kpi_df: DataFrame) -> DataFrame:
    """Roll-up of the cube over all dimensions (rate recomputed from sums).

    Segment revenues carry two decimals, so they are re-summed as cents.
    """
    return (
        kpi_df.groupBy(BUCKET)
        .agg(
            F.sum(cents("revenue")).alias("_rev_cents"),
            F.sum("pay_attempts").alias("pay_attempts"),
            F.sum("pay_success").alias("pay_success"),
            F.sum("pay_fail").alias("pay_fail"),
        )
        .select(
            BUCKET,
            from_cents("_rev_cents").alias("revenue"),
            "pay_attempts",
            "pay_success",
            "pay_fail",
            round_half_up(ratio("pay_success", "pay_attempts"), 4).alias("pay_success_rate"),
        )
    )


def overall_from_payments(payments: DataFrame, minutes: int = BUCKET_MINUTES, ts_col: str = "event_ts") -> DataFrame:
    """:func:`overall` of :func:`kpi` in ONE aggregation straight from payments.

    One shuffle fewer and bucket-only keys in the map-side combine, for use when
    the segment cube itself is not needed.  Revenue is rounded once per bucket;
    with amounts of two decimals that is the sum of the segments' revenues.
    """
    ok = is_success()
    return (
        payments.groupBy(bucket_start(ts_col, minutes).alias(BUCKET))
        .agg(
            F.sum(F.when(ok, micros("amount")).otherwise(F.lit(0).cast("bigint"))).alias("_rev"),
            F.count(F.lit(1)).alias("pay_attempts"),
            F.count_if(ok).alias("pay_success"),
            F.count_if(is_fail()).alias("pay_fail"),
        )
        .select(
            BUCKET,
            rounded_micros("_rev").alias("revenue"),
            "pay_attempts",
            "pay_success",
            "pay_fail",
            round_half_up(ratio("pay_success", "pay_attempts"), 4).alias("pay_success_rate"),
        )
    )


def with_tod_key(overall_df: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Add the time-of-day slot ``tod_key`` and calendar day ``dt``."""
    return overall_df.withColumns({
        "tod_key": tod_slot(BUCKET, minutes),
        "dt": F.to_date(BUCKET),
    })
