"""Seasonal z-score anomaly detection on the overall KPI series.

Each bucket is compared with the same time-of-day slot on the *other* days
(``mode="other_days"``, the reference's ``a.dt != b.dt``) or only on earlier
days (``mode="previous_days"``).  Two forms compute the same statistics:

* :func:`baselines` — the literal self-join ``tod_key = tod_key AND dt != dt``
  followed by a grouped AVG / STDDEV.  O(days²) pairs per slot.
* :func:`baselines_window` — leave-one-out moments over a window partitioned
  by ``tod_key``: slot totals minus the own row.  O(days) per slot, one
  shuffle on a 288-valued key and no join.

Both take exact integer moments (rates in basis points, revenue in cents), so
they agree bit for bit and a constant comparison series yields a standard
deviation of exactly 0.  The overall series has one row per bucket — its size
is set by history length / bucket width, not by the number of payments.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.config import AVG_PURCHASE_VALUE, BUCKET_MINUTES, METRIC_RATE, METRIC_REVENUE, Z_THRESHOLD
from paylens.functions.expr import cents, from_cents, round_half_up
from paylens.functions.stats import EXACT, basis_points, exact_mean, exact_stddev
from paylens.operators.cube import BUCKET, with_tod_key

RATE_SCALE = 10000
MONEY_SCALE = 100

BASELINE_COLUMNS = [
    BUCKET, "actual_revenue", "actual_psr", "actual_attempts",
    "baseline_psr", "std_psr", "baseline_revenue", "std_revenue",
]


def moment_inputs(overall_df: DataFrame, minutes: int) -> DataFrame:
    """The overall series with slot, day and the integer samples ``x_bp``, ``x_ct`` of its baselines."""
    return with_tod_key(overall_df, minutes).select(
        BUCKET, "tod_key", "dt",
        F.col("revenue").alias("actual_revenue"),
        F.col("pay_success_rate").alias("actual_psr"),
        F.col("pay_attempts").alias("actual_attempts"),
        basis_points("pay_success_rate").alias("x_bp"),
        cents("revenue").alias("x_ct"),
    )


def finish_moments(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Baseline columns from the moments of the other days; rows without another day are left out."""
    n = F.col("n")
    return df.where(n > 0).select(
        *keep, BUCKET, "actual_revenue", "actual_psr", "actual_attempts",
        exact_mean(n, F.col("sx_bp"), RATE_SCALE).alias("baseline_psr"),
        exact_stddev(n, F.col("sx_bp"), F.col("sq_bp"), RATE_SCALE).alias("std_psr"),
        exact_mean(n, F.col("sx_ct"), MONEY_SCALE).alias("baseline_revenue"),
        exact_stddev(n, F.col("sx_ct"), F.col("sq_ct"), MONEY_SCALE).alias("std_revenue"),
    )


def _sq(c: Column) -> Column:
    return c.cast(EXACT) * c.cast(EXACT)


def baselines(overall_df: DataFrame, mode: str = "other_days", minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Baseline statistics by the literal self-join (the reference's form)."""
    m = moment_inputs(overall_df, minutes)
    a = m.alias("a")
    b = m.select(
        F.col("tod_key").alias("b_tod"), F.col("dt").alias("b_dt"),
        F.col("x_bp").alias("b_bp"), F.col("x_ct").alias("b_ct"),
    )
    if mode not in ("other_days", "previous_days"):
        raise ValueError(f"unknown baseline mode {mode!r}")
    other = F.col("b_dt") != F.col("a.dt") if mode == "other_days" else F.col("b_dt") < F.col("a.dt")
    j = a.join(b, (F.col("a.tod_key") == F.col("b_tod")) & other)
    g = j.groupBy(F.col(f"a.{BUCKET}").alias(BUCKET)).agg(
        F.any_value("a.actual_revenue").alias("actual_revenue"),
        F.any_value("a.actual_psr").alias("actual_psr"),
        F.any_value("a.actual_attempts").alias("actual_attempts"),
        F.count(F.lit(1)).alias("n"),
        F.sum("b_bp").alias("sx_bp"),
        F.sum(_sq(F.col("b_bp"))).alias("sq_bp"),
        F.sum("b_ct").alias("sx_ct"),
        F.sum(_sq(F.col("b_ct"))).alias("sq_ct"),
    )
    return finish_moments(g)


def baselines_window(overall_df: DataFrame, mode: str = "other_days", minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Baseline statistics as leave-one-out window moments (no join)."""
    m = moment_inputs(overall_df, minutes)
    if mode == "other_days":
        w = Window.partitionBy("tod_key")
        moments = m.select(
            "*",
            (F.count(F.lit(1)).over(w) - 1).alias("n"),
            (F.sum("x_bp").over(w) - F.col("x_bp")).alias("sx_bp"),
            (F.sum(_sq(F.col("x_bp"))).over(w) - _sq(F.col("x_bp"))).alias("sq_bp"),
            (F.sum("x_ct").over(w) - F.col("x_ct")).alias("sx_ct"),
            (F.sum(_sq(F.col("x_ct"))).over(w) - _sq(F.col("x_ct"))).alias("sq_ct"),
        )
    elif mode == "previous_days":
        w = Window.partitionBy("tod_key").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
        moments = m.select(
            "*",
            F.count(F.lit(1)).over(w).alias("n"),
            F.coalesce(F.sum("x_bp").over(w), F.lit(0)).alias("sx_bp"),
            F.coalesce(F.sum(_sq(F.col("x_bp"))).over(w), F.lit(0)).alias("sq_bp"),
            F.coalesce(F.sum("x_ct").over(w), F.lit(0)).alias("sx_ct"),
            F.coalesce(F.sum(_sq(F.col("x_ct"))).over(w), F.lit(0)).alias("sq_ct"),
        )
    else:
        raise ValueError(f"unknown baseline mode {mode!r}")
    return finish_moments(moments)


def _metric_row(metric: str, actual: Column, mean: Column, std: Column, baseline_digits: int,
                impact: Column, threshold: float) -> Column:
    z_raw = F.when(std > 0, (actual - mean) / std)
    return F.struct(
        F.lit(metric).alias("metric"),
        actual.alias("actual"),
        round_half_up(mean, baseline_digits).alias("baseline"),
        round_half_up(F.coalesce(z_raw, F.lit(0.0)), 2).alias("z_score"),
        F.coalesce(z_raw < F.lit(threshold), F.lit(False)).alias("is_anomaly"),
        round_half_up(F.when(actual < mean, impact).otherwise(F.lit(0.0)), 2).alias("impact_estimated"),
    )


def anomaly(baselines_df: DataFrame, z_threshold: float = Z_THRESHOLD,
            avg_purchase_value: float = AVG_PURCHASE_VALUE, keep: Sequence[str] = ()) -> DataFrame:
    """``gold_anomaly``: two metric rows per bucket with at least one comparison day.

    The UNION ALL of the two metric branches is a single pass: both rows are
    generated from one baseline row with ``inline(array(struct, struct))``.
    """
    a_psr, m_psr, s_psr = F.col("actual_psr"), F.col("baseline_psr"), F.col("std_psr")
    a_rev, m_rev, s_rev = F.col("actual_revenue"), F.col("baseline_revenue"), F.col("std_revenue")
    psr = _metric_row(METRIC_RATE, a_psr, m_psr, s_psr, 4,
                      (m_psr - a_psr) * F.col("actual_attempts") * F.lit(avg_purchase_value), z_threshold)
    rev = _metric_row(METRIC_REVENUE, a_rev, m_rev, s_rev, 2, m_rev - a_rev, z_threshold)
    return baselines_df.select(*keep, BUCKET, F.inline(F.array(psr, rev)))


def on_day(as_of: _dt.date, df: DataFrame | None = None) -> Column:
    """Rows whose bucket lies on the day."""
    cond = F.to_date(BUCKET) == F.lit(as_of)
    if df is not None and "dt" in df.columns:  # day-partitioned gold table: prune statically
        cond = cond & (F.col("dt") == F.lit(as_of))
    return cond


def anomaly_rows(anomaly_df: DataFrame) -> DataFrame:
    """Flagged rows, in time order."""
    return anomaly_df.where("is_anomaly").orderBy(BUCKET, "metric")


def anomaly_summary(anomaly_df: DataFrame) -> DataFrame:
    """Per metric: count, first and last flagged bucket, total impact."""
    return anomaly_df.where("is_anomaly").groupBy("metric").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.min(BUCKET).alias("first_anomaly"),
        F.max(BUCKET).alias("last_anomaly"),
        from_cents(F.sum(cents("impact_estimated"))).alias("total_estimated_impact"),
    )


def metric_series(anomaly_df: DataFrame, metric: str = METRIC_RATE, as_of: _dt.date | None = None) -> DataFrame:
    """One metric's series on one day (chart feed)."""
    df = anomaly_df.where(F.col("metric") == metric)
    if as_of is not None:
        df = df.where(on_day(as_of, df))
    return df.select(BUCKET, "actual", "baseline", "z_score", "is_anomaly", "impact_estimated").orderBy(BUCKET)


def anomaly_markers(anomaly_df: DataFrame, as_of: _dt.date | None = None) -> DataFrame:
    """Flagged points of the day's series (chart markers), both metrics."""
    df = anomaly_df.where("is_anomaly")
    if as_of is not None:
        df = df.where(on_day(as_of, df))
    return df.select(BUCKET, "metric", "actual").orderBy(BUCKET, "metric")


def anomaly_windows(anomaly_df: DataFrame, as_of: _dt.date) -> DataFrame:
    """Per metric, the min–max window of the day's flagged buckets."""
    n = F.count(F.lit(1))
    avg_z = F.sum(cents("z_score")).cast("double") / n.cast("double") / F.lit(100.0)
    return anomaly_df.where(F.col("is_anomaly") & on_day(as_of, anomaly_df)).groupBy("metric").agg(
        F.min(BUCKET).alias("anomaly_start"),
        F.max(BUCKET).alias("anomaly_end"),
        n.alias("anomaly_buckets"),
        round_half_up(avg_z, 2).alias("avg_z_score"),
        from_cents(F.sum(cents("impact_estimated"))).alias("total_impact_usd"),
    )


def anomaly_bounds(anomaly_df: DataFrame, as_of: _dt.date, metric: str = METRIC_RATE) -> DataFrame:
    """One row ``(astart, aend)`` of the day's flagged buckets; NULLs when none."""
    return anomaly_df.where(F.col("is_anomaly") & on_day(as_of, anomaly_df) & (F.col("metric") == metric)).agg(
        F.min(BUCKET).alias("astart"),
        F.max(BUCKET).alias("aend"),
    )
