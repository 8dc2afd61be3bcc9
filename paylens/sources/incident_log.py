"""The ground-truth log of released incidents as an appendable table.

Each append is one write into the log's folder under the shared directory;
``latest`` is the newest incident by start (then id), ``read_log`` all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.sources.fixtures import INCIDENT_SCHEMA


def append_incidents(incidents: DataFrame, path: str) -> None:
    """Add incidents to the log at ``path`` (created by the first append)."""
    incidents.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INCIDENT_SCHEMA]).write.mode(
        "append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INCIDENT_SCHEMA).parquet(path)


def latest_incident(log: DataFrame) -> DataFrame:
    """The newest incident (one row; none for an empty log)."""
    return log.orderBy(F.col("incident_start").desc_nulls_last(), F.col("incident_id").desc()).limit(1)


def incidents_from_payments(payments: DataFrame, minutes: int = 60, min_attempts: int = 1) -> DataFrame:
    """Log rows derived from the data: per day, the hour and segment × code with the most failures.

    What a release log would record if every day's worst hour were an incident:
    one row per day, numbered by date.
    """
    from paylens.config import DIMS
    from paylens.functions.expr import bucket_start, is_fail, ratio, round_half_up

    keys = ["day", "hour", *DIMS]
    hourly = payments.where("event_ts is not null").withColumn("hour", bucket_start("event_ts", minutes)).withColumn(
        "day", F.to_date("hour"))
    seg = hourly.groupBy(*keys).agg(F.count_if(is_fail()).alias("fails"), F.count(F.lit(1)).alias("attempts"),
                                    F.min(F.when(is_fail(), F.col("error_code"))).alias("error_code"))
    seg = seg.where((F.col("fails") > 0) & (F.col("attempts") >= min_attempts))
    worst = seg.groupBy("day").agg(F.min(F.struct(
        (-F.col("fails")).alias("f"), "hour", *DIMS, "error_code", "attempts")).alias("w"))
    return worst.select(
        F.datediff("day", F.lit("1970-01-01").cast("date")).alias("incident_id"),
        *[F.col(f"w.{d}").alias(d) for d in DIMS], "w.error_code",
        round_half_up(ratio(-F.col("w.f"), F.col("w.attempts")), 4).alias("fail_rate"),
        F.col("w.hour").alias("incident_start"),
        (F.col("w.hour") + F.expr(f"INTERVAL '{int(minutes * 60 - 1)}' SECOND")).alias("incident_end"),
        F.lit(None).cast("int").alias("rows_inserted"))
