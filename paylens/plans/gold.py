"""Gold refresh: materialise ``gold_kpi_5m`` and ``gold_anomaly``.

The reference re-runs both CTAS statements in order after every append.  Here
the KPI cube is written (day-partitioned) and read back, and the anomaly table
is computed from the table just written — the write is the lineage cut, so a
lost executor later on never recomputes the scan of the payments.  Both
tables live under the cluster-shared folder (``spark.checkpoint.dir``) unless
a location is given.

Incremental refresh: the cube of a day depends only on that day's payments,
so after an append only the touched days are recomputed (a pruned scan) and
written with dynamic partition overwrite; every other day's files stay.  The
anomaly table compares each day with all others, so it is rebuilt — from the
cube, whose size is buckets × segments, not from the payments.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.config import BUCKET_MINUTES
from paylens.functions.expr import ntz
from paylens.operators.cube import BUCKET, kpi, overall
from paylens.operators.seasonal import anomaly, baselines_window
from paylens.session import unique_shared_path
from paylens.sources.sinks import overwrite_table, read_written, replace_named, written_schema


def _days_filter(payments: DataFrame, days: Sequence[_dt.date] | DataFrame, ts_col: str) -> DataFrame:
    if isinstance(days, DataFrame):
        # A DataFrame of days (column ``dt``), e.g. the days of a micro-batch:
        # a NULL-safe semi-join (payments without a timestamp are a day of
        # their own), never collected; the planner sizes the join.
        d = days.select(F.col("dt").cast("date").alias("_refresh_dt")).distinct()
        key = F.col("dt") if "dt" in payments.columns else F.to_date(ts_col)
        return payments.join(d, key.eqNullSafe(F.col("_refresh_dt")), "left_semi")
    cond = F.lit(False)
    for d in sorted({d for d in days if d is not None}):
        day = (F.col(ts_col) >= ntz(d)) & (F.col(ts_col) < ntz(d + _dt.timedelta(days=1)))
        if "dt" in payments.columns:  # partitioned source: static partition pruning
            day = day & (F.col("dt") == F.lit(d))
        cond = cond | day
    if None in days:
        cond = cond | F.col(ts_col).isNull()
    return payments.where(cond)


ANOMALY_SCHEMA = (f"{BUCKET} timestamp_ntz, metric string, actual double, baseline double, z_score double, "
                  "is_anomaly boolean, impact_estimated double, dt date")


def read_gold_anomaly(spark: SparkSession, location: str, keep_partition: bool = False) -> DataFrame:
    """The anomaly table below ``location``; also when it is empty (one day of history)."""
    df = spark.read.schema(ANOMALY_SCHEMA).parquet(f"{location}/gold_anomaly")
    return df if keep_partition else df.drop("dt")


def refresh_gold(spark: SparkSession, payments: DataFrame, location: str | None = None,
                 minutes: int = BUCKET_MINUTES, keep_partition: bool = False,
                 days: Sequence[_dt.date | None] | DataFrame | None = None,
                 names: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rebuild the gold tables; returns ``(kpi_table, anomaly_table)`` read back.

    ``days=None`` rebuilds the whole cube.  With ``days`` (dates, or a
    DataFrame with a ``dt`` column) and an existing ``location`` only those
    days of the cube are recomputed and replaced (``None`` among them stands for
    payments without a timestamp).  With ``names`` the two tables are replaced
    in the catalog under those names, for ``spark.sql`` users.
    Gold tables are small (buckets × segments per day, independent of the
    number of payments); the rebalance before the write gives one or a few
    files per day instead of one per task and day.  ``keep_partition`` keeps
    the ``dt`` column so window joins can prune partitions.
    """
    if days is not None and location is None:
        raise ValueError("an incremental refresh needs the location of the existing tables")
    if names and days is not None:
        raise ValueError("named gold tables are replaced as a whole")
    if names:
        kpi_named = replace_named(kpi(payments, minutes), names[0], BUCKET)
        series = overall(kpi_named.drop("dt"))
        anomaly_named = replace_named(anomaly(baselines_window(series, minutes=minutes)), names[1], BUCKET)
        return tuple(t if keep_partition else t.drop("dt") for t in (kpi_named, anomaly_named))
    base = location or unique_shared_path(spark, "gold")
    kpi_path, anomaly_path = f"{base}/gold_kpi_5m", f"{base}/gold_anomaly"
    cube = kpi(payments if days is None else _days_filter(payments, days, "event_ts"), minutes)
    overwrite_table(cube, kpi_path, BUCKET, dynamic=days is not None)
    kpi_table = read_written(spark, kpi_path, keep_partition=True, schema=written_schema(cube, BUCKET))
    kpi_cols = [c for c in kpi_table.columns if c != "dt"]
    # one day of history has no comparison day: the anomaly table is then empty
    rows = anomaly(baselines_window(overall(kpi_table.select(*kpi_cols)), minutes=minutes))
    overwrite_table(rows, anomaly_path, BUCKET)
    anomaly_table = read_written(spark, anomaly_path, keep_partition=keep_partition, schema=written_schema(rows, BUCKET))
    return (kpi_table if keep_partition else kpi_table.select(*kpi_cols)), anomaly_table
