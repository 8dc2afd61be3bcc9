"""SQL entry points whose values are bound, never spliced into the text.

``spark.sql(q, args=…)`` parses the text with named parameters and binds the values
after parsing, so quotes, braces, percent signs and comment marks in a value are just
characters.  :func:`install_day_function` adds the day's rows as a SQL table function.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SEGMENT_FAILURES = """
    SELECT platform, app_version, region, provider, error_code, COUNT(*) AS error_count,
           COUNT(DISTINCT user_id) AS affected_users
    FROM IDENTIFIER(:payments)
    WHERE payment_status = :status AND event_ts >= :day AND event_ts < :day + INTERVAL 1 DAY
      AND (:error_code IS NULL OR error_code = :error_code)
    GROUP BY ALL"""

NOTES = """
    SELECT platform, COUNT(*) AS attempts, :note AS note
    FROM IDENTIFIER(:payments) WHERE region <> :note GROUP BY platform"""


def named_view(df: DataFrame, prefix: str = "payments") -> str:
    """A temporary view of its own name for ``df``, so that two callers of a session do not meet."""
    name = f"{prefix}_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(name)
    return name


def run_sql(spark: SparkSession, text: str, args: Mapping[str, Any]) -> DataFrame:
    """``text`` with its named parameters bound to ``args``."""
    return spark.sql(text, args=dict(args))


def segment_failures(payments: DataFrame, day: _dt.date, error_code: str | None = None, status: str = "fail") -> DataFrame:
    """Failures of a day per segment and error code, as SQL."""
    start = _dt.datetime.combine(day, _dt.time())
    return run_sql(payments.sparkSession, SEGMENT_FAILURES, {
        "payments": named_view(payments), "status": status, "day": start, "error_code": error_code})


def noted_attempts(payments: DataFrame, note: str) -> DataFrame:
    """Attempts per platform outside the region named like ``note``, with the note, whatever its characters."""
    return run_sql(payments.sparkSession, NOTES, {"payments": named_view(payments), "note": note})


def install_day_function(payments: DataFrame, name: str | None = None) -> str:
    """A temporary SQL table function ``name(d DATE)`` of the day's payments; returns its name.

    ``SELECT … FROM name(DATE'2024-01-20')``: the day's bounds reach the scan as for a literal filter.
    """
    spark = payments.sparkSession
    view = named_view(payments)
    name = name or f"payments_of_day_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payments.schema)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(d DATE) RETURNS TABLE ({columns})
        RETURN SELECT * FROM {view} WHERE event_ts >= CAST(d AS TIMESTAMP_NTZ)
          AND event_ts < CAST(d AS TIMESTAMP_NTZ) + INTERVAL 1 DAY""")
    return name
