"""User and revenue impact of an anomaly window."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.config import BUCKET_MINUTES, METRIC_RATE, METRIC_REVENUE
from paylens.functions.expr import is_fail, ntz, ratio, round_half_up


def user_impact(failures_in_window: DataFrame, game_events: DataFrame, as_of: _dt.date) -> DataFrame:
    """Affected users (distinct failing payers in the rate-anomaly window),
    daily active users of ``as_of`` and the affected share in percent.

    Both distinct counts come from ONE aggregate over the union of the two
    user streams (no cross join of two scalar results).  Spark plans each
    distinct count as a dedup on (kind, user_id) across all partitions, so it
    scales with the number of distinct users, not with one task.  No rate
    anomaly → no failing rows → 0 affected users, as in the reference.
    """
    failing = failures_in_window.where(is_fail()).select(F.lit("a").alias("kind"), "user_id")
    day = game_events.where(
        (F.col("event_ts") >= ntz(as_of)) & (F.col("event_ts") < ntz(as_of + _dt.timedelta(days=1)))
    ).select(F.lit("t").alias("kind"), "user_id")
    g = failing.unionByName(day).agg(
        F.count_distinct(F.when(F.col("kind") == "a", F.col("user_id"))).alias("affected_users"),
        F.count_distinct(F.when(F.col("kind") == "t", F.col("user_id"))).alias("total_dau"),
    )
    pct = F.when(F.col("total_dau") > 0, round_half_up(ratio("affected_users", "total_dau") * F.lit(100), 1)).otherwise(F.lit(0.0))
    return g.select("affected_users", "total_dau", pct.alias("dau_pct"))


def impact_summary(windows_by_metric: DataFrame, user_impact_df: DataFrame,
                   minutes: int = BUCKET_MINUTES) -> DataFrame:
    """One row: window, duration, buckets, money and user impact.

    The metric rows (≤ 2) and the user row (1) are stacked and folded by one
    global aggregate over at most three rows — no join is needed to put
    scalars side by side.
    """
    w = windows_by_metric.select(
        "metric", "anomaly_start", "anomaly_end", "anomaly_buckets", "avg_z_score", "total_impact_usd",
        F.lit(None).cast("bigint").alias("affected_users"),
        F.lit(None).cast("bigint").alias("total_dau"),
        F.lit(None).cast("double").alias("dau_pct"),
    )
    u = user_impact_df.select(
        F.lit(None).cast("string").alias("metric"),
        F.lit(None).cast(w.schema["anomaly_start"].dataType).alias("anomaly_start"),
        F.lit(None).cast(w.schema["anomaly_end"].dataType).alias("anomaly_end"),
        F.lit(None).cast("bigint").alias("anomaly_buckets"),
        F.lit(None).cast("double").alias("avg_z_score"),
        F.lit(None).cast("double").alias("total_impact_usd"),
        "affected_users", "total_dau", "dau_pct",
    )

    def rate(c: str):
        return F.max(F.when(F.col("metric") == METRIC_RATE, F.col(c)))

    g = w.unionByName(u).agg(
        rate("anomaly_start").alias("anomaly_start"),
        rate("anomaly_end").alias("anomaly_end"),
        rate("anomaly_buckets").alias("anomaly_buckets"),
        rate("avg_z_score").alias("avg_z_score"),
        rate("total_impact_usd").alias("estimated_impact_usd"),
        F.max(F.when(F.col("metric") == METRIC_REVENUE, F.col("total_impact_usd"))).alias("revenue_loss_usd"),
        F.max("affected_users").alias("affected_users"),
        F.max("total_dau").alias("total_dau"),
        F.max("dau_pct").alias("dau_pct"),
    )
    duration = F.timestamp_diff("MINUTE", F.col("anomaly_start"), F.col("anomaly_end")) + F.lit(minutes)
    return g.select(
        "anomaly_start", "anomaly_end", duration.cast("bigint").alias("duration_minutes"), "anomaly_buckets",
        "avg_z_score", "estimated_impact_usd", "revenue_loss_usd",
        F.coalesce("affected_users", F.lit(0).cast("bigint")).alias("affected_users"),
        "total_dau", "dau_pct",
    )
