"""Adapter from the driver's star-schema tables to the silver tables.

``events ⋈ customer ⋈ nation ⋈ region`` becomes ``silver_payments`` (one row
per event) and ``silver_game_events`` (three telemetry rows per payment).
Dimensions are derived deterministically from the keys, and two incidents with
known answers are injected:

* A (broad): 2024-01-20 10:00–14:00, every row on iOS *or* version 1.2.7;
* B (one segment): 2024-01-10 00:00 – 2024-01-13 00:00, iOS / 1.2.7 / ASIA /
  Stripe, all failing with PROVIDER_ERROR.

Join strategy: nation (25 rows) and region (5 rows) are fixed-size TPC-H
dimensions and are broadcast explicitly; ``customer`` grows with the scale
factor, so its join with ``events`` is left to the planner (AQE turns it into a
broadcast only when the measured size is under the threshold, else a
sort-merge join whose skewed partitions AQE splits).  See
:func:`events_with_region`.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.functions.expr import ntz
from paylens.sources.tables import read_table

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
ERROR_CODES = ["TOKEN_EXPIRED", "NETWORK_TIMEOUT", "PROVIDER_ERROR", "INSUFFICIENT_FUNDS", "CARD_DECLINED"]
ANDROID_DEVICES = ["Galaxy_S24", "Pixel_8", "OnePlus_12"]
VERSIONS = ["1.2.6", "1.2.7"]
CURRENCY = "USD"
# Game-event names written per payment.
EVENT_LOGIN = "login"
EVENT_ATTEMPT = "purchase_attempt"
EVENT_SUCCESS = "purchase_success"
EVENT_FAIL = "purchase_fail"
# ---------------------------------------------------------------------------

# Injected incidents (half-open windows).
INCIDENT_A = ("2024-01-20 10:00:00", "2024-01-20 14:00:00")
INCIDENT_B = ("2024-01-10 00:00:00", "2024-01-13 00:00:00")

PAYMENT_COLUMNS = [
    "event_id", "event_ts", "user_id", "amount", "currency", "provider",
    "payment_status", "error_code", "platform", "app_version", "region", "device_model",
]
GAME_EVENT_COLUMNS = [
    "event_id", "event_ts", "user_id", "region", "platform", "device_model", "app_version", "event_name",
]


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey → r_name``; nation/region are fixed 25/5-row tables."""
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return (
        customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
        .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey)
        .select("c_custkey", "r_name")
    )


def events_with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events ⋈ customer ⋈ nation ⋈ region`` → events plus ``r_name``.

    Join order: events with customer first (the one join whose sides both
    grow with the scale factor — AQE picks broadcast or sort-merge from
    measured sizes and splits a hot ``user_id``), then the fixed-size nation
    and region tables as map-side broadcast joins.  The three broadcasts are
    independent, so they are built concurrently rather than in a chain.
    """
    return join_regions(
        read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "customer"),
        read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region"))


def join_regions(events: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """The join of :func:`events_with_region` over any four DataFrames (e.g.
    tables bucketed by the user key, see :mod:`paylens.sources.bucketed`)."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    customer = customer.select("c_custkey", "c_nationkey")
    nation = nation.select("n_nationkey", "n_regionkey")
    region = region.select("r_regionkey", "r_name")
    return (
        e.join(customer, e.user_id == customer.c_custkey)
        .join(F.broadcast(nation), F.col("c_nationkey") == nation.n_nationkey)
        .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey)
        .select("event_id", "ts", "user_id", "event_type", "value", "props", "r_name")
    )


def payments_from_events(events: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Derive ``silver_payments`` from raw events.

    ``regions`` (``c_custkey → r_name``) is joined in when given (e.g. the
    static side of a stream); without it ``events`` must carry ``r_name``.
    """
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    if regions is not None:
        e = events.select(*cols)
        j = e.join(regions, e.user_id == regions.c_custkey)
    else:
        j = events.select(*cols, "r_name")

    uid = F.col("user_id")
    k = F.get_json_object("props", "$.k").try_cast("int")
    is_ios = uid % 2 == 0
    platform = F.when(is_ios, "iOS").otherwise("Android")
    version = F.when(uid % 4 < 2, VERSIONS[0]).otherwise(VERSIONS[1])
    provider = F.when(k % 2 == 0, "Stripe").when(is_ios, "ApplePay").otherwise("GooglePay")
    device = F.when(is_ios, F.concat(F.lit("iPhone"), (F.lit(13) + uid % 3).cast("string"))).otherwise(
        F.element_at(F.array(*[F.lit(d) for d in ANDROID_DEVICES]), (uid % 3 + 1).cast("int"))
    )

    staged = j.select(
        "event_id",
        F.col("ts").alias("event_ts"),
        uid.alias("uid"),
        "event_type",
        F.col("value").alias("amount"),
        k.alias("k"),
        platform.alias("platform"),
        version.alias("app_version"),
        F.col("r_name").alias("region"),
        provider.alias("provider"),
        device.alias("device_model"),
    )
    ts = F.col("event_ts")
    in_a = (
        (ts >= ntz(INCIDENT_A[0])) & (ts < ntz(INCIDENT_A[1]))
        & ((F.col("platform") == "iOS") | (F.col("app_version") == VERSIONS[1]))
    )
    in_b = (
        (ts >= ntz(INCIDENT_B[0])) & (ts < ntz(INCIDENT_B[1]))
        & (F.col("platform") == "iOS") & (F.col("app_version") == VERSIONS[1])
        & (F.col("region") == "ASIA") & (F.col("provider") == "Stripe")
    )
    failed = (F.col("event_type") == "error") | ((in_a | in_b) & (F.col("event_type") != "purchase"))
    status = F.when(failed, "fail").otherwise("success")
    error = F.when(
        failed,
        F.when(in_b, "PROVIDER_ERROR")
        .when(in_a & (F.col("k") % 4 < 3), "TOKEN_EXPIRED")
        .otherwise(F.element_at(F.array(*[F.lit(c) for c in ERROR_CODES]), (F.col("k") % 5 + 1).cast("int"))),
    )
    return staged.select(
        "event_id",
        "event_ts",
        F.concat(F.lit("u_"), F.lpad(F.col("uid").cast("string"), 6, "0")).alias("user_id"),
        "amount",
        F.lit(CURRENCY).alias("currency"),
        "provider",
        status.alias("payment_status"),
        error.alias("error_code"),
        "platform",
        "app_version",
        "region",
        "device_model",
    )


def silver_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``silver_payments`` over the whole ``events`` table."""
    return payments_from_events(events_with_region(spark, sf_dir))


def game_events_from_payments(payments: DataFrame) -> DataFrame:
    """Three telemetry rows per payment: login, attempt, success|fail."""
    outcome = F.when(F.col("payment_status") == "success", EVENT_SUCCESS).otherwise(EVENT_FAIL)
    return payments.select(
        "event_id", "event_ts", "user_id", "region", "platform", "device_model", "app_version",
        F.explode(F.array(F.lit(EVENT_LOGIN), F.lit(EVENT_ATTEMPT), outcome)).alias("event_name"),
    )


def silver_game_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return game_events_from_payments(silver_payments(spark, sf_dir))


# Ground-truth log of released incidents (the reference keeps it as a Python
# list in the web process).  Rows: the two injected incidents as a release
# log would record them, and a window with no data.
INCIDENT_SCHEMA = T.StructType([
    T.StructField("incident_id", T.IntegerType(), False),
    T.StructField("platform", T.StringType()),
    T.StructField("app_version", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("fail_rate", T.DoubleType()),
    T.StructField("incident_start", T.TimestampNTZType()),
    T.StructField("incident_end", T.TimestampNTZType()),
    T.StructField("rows_inserted", T.IntegerType()),
])

INCIDENT_ROWS = [
    (1, "iOS", "1.2.7", "ASIA", "Stripe", "PROVIDER_ERROR", 0.8,
     _dt.datetime(2024, 1, 10, 0, 0, 0), _dt.datetime(2024, 1, 12, 23, 59, 59), None),
    (2, "iOS", "1.2.7", "EUROPE", "Stripe", "TOKEN_EXPIRED", 0.8,
     _dt.datetime(2024, 1, 20, 10, 0, 0), _dt.datetime(2024, 1, 20, 13, 59, 59), None),
    (3, "Android", "1.2.6", "AMERICA", "GooglePay", "CARD_DECLINED", 0.2,
     _dt.datetime(2025, 6, 1, 10, 0, 0), _dt.datetime(2025, 6, 1, 10, 30, 0), None),
]


def incidents(spark: SparkSession) -> DataFrame:
    """The ground-truth incident log as a DataFrame."""
    return spark.createDataFrame(INCIDENT_ROWS, INCIDENT_SCHEMA)
