"""Registered queries on sketches, maintained moments, windows of any length, the segment
lattice, separate windows, quarantined input, bound SQL and ordered output.

Like :mod:`paylens.plans.registry`, every query reads the given tables as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens import config as C
from paylens.functions.expr import is_fail, ntz
from paylens.operators import evidence as E
from paylens.operators import islands as I
from paylens.operators import rootcause as R
from paylens.operators import sketches as K
from paylens.operators.cube import BUCKET, kpi, overall_from_payments
from paylens.operators.seasonal import anomaly, baselines_window
from paylens.operators.windows import WIN_END, WIN_START, restrict_to_windows
from paylens.plans import sql_entry as Q
from paylens.plans.incident import IncidentAnalysis, incident_attribution
from paylens.plans.seasonal_gold import SeasonalGold
from paylens.session import unique_shared_path
from paylens.sources import fixtures as X
from paylens.sources import ingest as G
from paylens.sources.incident_log import append_incidents, incidents_from_payments, read_log
from paylens.sources.sinks import overwrite_ordered, overwrite_table, read_written, written_schema
from paylens.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

# values that break text spliced into SQL
AWKWARD_NOTE = "it's {not} a \"region\"; -- %s /* :payments */ \\ '' OR 1=1"


def _pay(spark: SparkSession, d: str) -> DataFrame:
    return X.silver_payments(spark, d)


def _stored(df: DataFrame, name: str, ts_col: str) -> DataFrame:
    """A gold table written by day and read back."""
    path = unique_shared_path(df.sparkSession, name) + "/t"
    overwrite_table(df, path, ts_col)
    return read_written(df.sparkSession, path, keep_partition=True, schema=written_schema(df, ts_col))


def _user_impact_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Users of the anomaly window and of the day, from stored sketches."""
    pay = _pay(spark, d)
    users = _stored(K.failing_user_sketches(pay), "gold_users", BUCKET)
    dau = _stored(K.daily_user_sketches(X.game_events_from_payments(pay)), "gold_dau", "dt")
    ia = IncidentAnalysis(pay, C.AS_OF)
    inside = restrict_to_windows(users, ia.window, ts_col=BUCKET, day_range=(C.AS_OF, C.AS_OF))
    return K.user_impact_from_sketches(inside, dau, C.AS_OF)


def _segment_users_sketch(spark: SparkSession, d: str) -> DataFrame:
    return K.segment_users(_stored(K.failing_user_sketches(_pay(spark, d)), "gold_users", BUCKET))


def _refresh_gold_incremental(spark: SparkSession, d: str) -> DataFrame:
    """History first, then the later days one refresh at a time: the as-of day, and all after it."""
    pay = _pay(spark, d)
    gold = SeasonalGold(spark)
    day, after = ntz(C.AS_OF), F.expr(f"TIMESTAMP_NTZ'{C.AS_OF.isoformat()} 00:00:00' + INTERVAL 1 DAY")
    gold.rebuild(pay.where(F.col("event_ts") < day))
    gold.refresh(pay.where(F.col("event_ts") < after), [C.AS_OF])
    late = pay.where(F.col("event_ts") >= after).select(F.to_date("event_ts").alias("dt")).distinct()
    gold.refresh(pay, late)
    return gold.anomaly()


def _log(spark: SparkSession, d: str) -> DataFrame:
    path = unique_shared_path(spark, "incident_log") + "/log"
    append_incidents(incidents_from_payments(_pay(spark, d)), path)
    return read_log(spark, path)


def _window_volume(spark: SparkSession, d: str) -> DataFrame:
    """Payments inside windows from a minute to a month around every incident of the log."""
    s, e = F.col("incident_start"), F.col("incident_end")
    ends = {
        "minute": (s, s + F.expr("INTERVAL 59 SECOND")),
        "hour": (s, e),
        "day": (F.date_trunc("day", s).cast("timestamp_ntz"), F.date_trunc("day", s).cast("timestamp_ntz") + F.expr("INTERVAL 86399 SECOND")),
        "month": (s - F.expr("INTERVAL 15 DAY"), s + F.expr("INTERVAL 15 DAY")),
    }
    windows = _log(spark, d).select("incident_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("span"), a.alias(WIN_START), b.alias(WIN_END)) for k, (a, b) in ends.items()])))
    inside = restrict_to_windows(_pay(spark, d), windows, keep=["incident_id", "span"], bounded=False)
    return inside.groupBy("incident_id", "span").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(is_fail()).alias("fails"),
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


def _log_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Attribution and accuracy of every incident of the appended log."""
    log = _log(spark, d)
    return R.incident_scorecard(log, incident_attribution(_pay(spark, d), log))


def _all_islands(spark: SparkSession, d: str) -> DataFrame:
    return I.islands(anomaly(baselines_window(overall_from_payments(_pay(spark, d)))))


def _separate(spark: SparkSession, d: str) -> IncidentAnalysis:
    return IncidentAnalysis(_pay(spark, d), C.AS_OF, separate=True)


def _ingest_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Payments written as text, some lines cut and some amounts spoilt, read into table and quarantine."""
    base = unique_shared_path(spark, "quarantine")
    pay = _pay(spark, d)
    bad_amount = F.when(F.col("event_id") % 89 == 0, F.lit("n/a | \"none\"")).otherwise(F.col("amount").cast("string"))
    line = F.to_json(F.struct(*[
        (bad_amount if c == "amount" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if c == "event_ts" else F.col(c).cast("string")).alias(c)
        for c in X.PAYMENT_COLUMNS]))
    pay.select(F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(f"{base}/raw")
    table, quarantine = G.ingest(spark, f"{base}/raw", X.PAYMENT_COLUMNS, G.PAYMENT_TYPES, f"{base}/table", f"{base}/bad")
    ids = F.regexp_extract("record", '"event_id":"([0-9]+)"', 1).cast("bigint")
    return table.agg(F.lit("accepted").alias("reason"), F.lit("").alias("columns"), F.count(F.lit(1)).alias("lines"),
                     F.sum("event_id").alias("ids")).unionByName(
        quarantine.groupBy("reason", F.array_join("columns", ",").alias("columns")).agg(
            F.count(F.lit(1)).alias("lines"), F.sum(ids).alias("ids")))


def _gold_ordered(spark: SparkSession, d: str) -> DataFrame:
    path = unique_shared_path(spark, "gold_ordered") + "/t"
    cube = kpi(_pay(spark, d))
    overwrite_ordered(cube, path, [BUCKET, *C.DIMS])
    return spark.read.schema(cube.schema).parquet(path)


def _sql_day_function(spark: SparkSession, d: str) -> DataFrame:
    name = Q.install_day_function(_pay(spark, d))
    return Q.run_sql(spark, f"""
        SELECT platform, app_version, COUNT(*) AS attempts, COUNT_IF(payment_status = :status) AS fails
        FROM {name}(:day) GROUP BY platform, app_version""", {"day": C.AS_OF, "status": "fail"})


def _export_quoted(spark: SparkSession, d: str) -> DataFrame:
    """The first events as delimited text, with values that hold separators, quotes and line breaks."""
    first = read_table(spark, d, "events").orderBy("event_id").limit(50).select(
        "event_id", "props", F.concat("event_type", F.lit("|"), "user_id").alias("kind|user"),
        F.concat("event_type", F.lit("\n"), "event_type").alias("lines"), "value")
    return E.table_text(first, [F.col("event_id")], {"value": 2})


MORE_QUERIES: dict[str, Query] = {
    "user_impact_sketch": _user_impact_sketch,
    "segment_users_sketch": _segment_users_sketch,
    "refresh_gold_incremental": _refresh_gold_incremental,
    "window_volume": _window_volume,
    "log_scorecard": _log_scorecard,
    "anomaly_islands": _all_islands,
    "island_drill_provider": lambda s, d: _separate(s, d).drill_provider(),
    "island_top_errors": lambda s, d: _separate(s, d).top_errors(),
    "root_cause_lattice": lambda s, d: IncidentAnalysis(_pay(s, d), C.AS_OF).lattice_causes(),
    "ingest_quarantine": _ingest_quarantine,
    "gold_ordered": _gold_ordered,
    "sql_segment_failures": lambda s, d: Q.segment_failures(_pay(s, d), C.AS_OF),
    "sql_bound_values": lambda s, d: Q.noted_attempts(_pay(s, d), AWKWARD_NOTE),
    "sql_day_function": _sql_day_function,
    "export_quoted": _export_quoted,
}
