"""Separate anomaly windows: gaps and islands over flagged buckets.

The min–max window of a day (:func:`paylens.operators.seasonal.anomaly_windows`) glues a
stray flag to an incident hours away.  An island is a maximal series of flagged
buckets of one metric of which neighbours are at most ``gap`` buckets apart.

Islands are found in two steps so that no window spans the whole history: within a day
(partitioned by metric and day), then neighbouring islands of different days are
merged over the few island rows, whose moments (count, sums, extent) add up.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.config import BUCKET_MINUTES, METRIC_RATE
from paylens.functions.expr import cents, from_cents, round_half_up
from paylens.operators.cube import BUCKET

GAP = 12  # an hour of 5-minute buckets


def _numbered(df: DataFrame, keys: list[str], start: str, end: str, reach: int) -> DataFrame:
    """``_no``: number of the island that a row ``[start, end]`` belongs to, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(start)
    apart = F.timestamp_diff("SECOND", F.lag(end).over(w), F.col(start)) > F.lit(reach)
    df = df.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    return df.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def islands(anomaly_df: DataFrame, gap: int = GAP, minutes: int = BUCKET_MINUTES, as_of: _dt.date | None = None) -> DataFrame:
    """One row per island: ``(metric, island, anomaly_start, anomaly_end, anomaly_buckets, avg_z_score, total_impact_usd)``.

    ``island`` numbers the islands of a metric in time order.  With ``as_of`` only the
    flagged buckets of that day are looked at.
    """
    reach = gap * minutes * 60
    flagged = anomaly_df.where("is_anomaly").select(
        "metric", BUCKET, F.to_date(BUCKET).alias("_day"), cents("z_score").alias("_z"), cents("impact_estimated").alias("_impact"),
        *(["dt"] if "dt" in anomaly_df.columns else []))
    if as_of is not None:
        flagged = flagged.where(F.col("_day") == F.lit(as_of))
        if "dt" in flagged.columns:  # day-partitioned table: static pruning
            flagged = flagged.where(F.col("dt") == F.lit(as_of))
    parts = _numbered(flagged, ["metric", "_day"], BUCKET, BUCKET, reach).groupBy("metric", "_day", "_no").agg(
        F.min(BUCKET).alias("s"), F.max(BUCKET).alias("e"), F.count(F.lit(1)).alias("n"),
        F.sum("_z").alias("_z"), F.sum("_impact").alias("_impact"))
    whole = _numbered(parts.drop("_no", "_day"), ["metric"], "s", "e", reach).groupBy("metric", "_no").agg(
        F.min("s").alias("anomaly_start"), F.max("e").alias("anomaly_end"), F.sum("n").alias("anomaly_buckets"),
        F.sum("_z").alias("_z"), F.sum("_impact").alias("_impact"))
    avg_z = F.col("_z").cast("double") / F.col("anomaly_buckets").cast("double") / F.lit(100.0)
    return whole.select("metric", F.col("_no").cast("int").alias("island"), "anomaly_start", "anomaly_end", "anomaly_buckets",
                        round_half_up(avg_z, 2).alias("avg_z_score"), from_cents("_impact").alias("total_impact_usd"))


def island_bounds(islands_df: DataFrame, metric: str = METRIC_RATE) -> DataFrame:
    """``(astart, aend)`` of the islands of one metric: several disjoint windows of a day."""
    return islands_df.where(F.col("metric") == metric).select(
        F.col("anomaly_start").alias("astart"), F.col("anomaly_end").alias("aend"))
