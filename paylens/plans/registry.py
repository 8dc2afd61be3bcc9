"""Registered queries: name → ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables in ``sf_dir`` (through the fixture
adapter) over their whole extent; parameters are the analysis defaults of
:mod:`paylens.config` (``as_of`` = 2024-01-20, 5-minute buckets).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens import config as C
from paylens.operators import seasonal as A
from paylens.operators import evidence as E
from paylens.operators import rootcause as R
from paylens.operators.drill import fail_rate_by_platform, fail_rate_per_platform, validate_hourly_success, validate_segment_status
from paylens.operators.cube import BUCKET, bucketize, kpi, kpi_extent, overall, overall_from_payments, with_tod_key
from paylens.plans.extended import MORE_QUERIES
from paylens.plans.gold import refresh_gold
from paylens.plans.incident import IncidentAnalysis, incident_attribution
from paylens.session import unique_shared_path
from paylens.sources import fixtures as X
from paylens.sources.bucketed import silver_payments_bucketed
from paylens.sources.incident_log import append_incidents, incidents_from_payments, latest_incident, read_log
from paylens.sources.ingest import read_game_events, read_payments, write_text
from paylens.sources.sinks import append_named, append_table, overwrite_table, read_written, replace_named
from paylens.sources.tables import read_table
from paylens.streaming.gold_stream import run_gold_stream
from paylens.streaming.kpi_stream import run_partial_kpi_stream

Query = Callable[[SparkSession, str], DataFrame]


def _pay(spark: SparkSession, d: str) -> DataFrame:
    return X.silver_payments(spark, d)


def _ia(spark: SparkSession, d: str, **kw) -> IncidentAnalysis:
    return IncidentAnalysis(_pay(spark, d), C.AS_OF, **kw)


def _table_counts(spark: SparkSession, d: str) -> DataFrame:
    pay = _pay(spark, d)
    ge = X.game_events_from_payments(pay)
    return (
        ge.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("silver_game_events").alias("table_name"), "row_count")
        .unionByName(pay.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("silver_payments").alias("table_name"), "row_count"))
    )


def _incidents_and_attribution(spark: SparkSession, d: str):
    inc = X.incidents(spark)
    return inc, incident_attribution(_pay(spark, d), inc)


def _scorecard(spark: SparkSession, d: str) -> DataFrame:
    inc, att = _incidents_and_attribution(spark, d)
    return R.incident_scorecard(inc, att)


def _scorecard_fields(spark: SparkSession, d: str) -> DataFrame:
    inc, att = _incidents_and_attribution(spark, d)
    return R.scorecard_fields(inc, att)


def _root_cause_label(spark: SparkSession, d: str) -> DataFrame:
    _, att = _incidents_and_attribution(spark, d)
    return R.attribution_labels(att)


def _alert_payload(spark: SparkSession, d: str) -> DataFrame:
    ia = _ia(spark, d)
    inc, att = _incidents_and_attribution(spark, d)
    acc = E.accuracy_payloads(R.scorecard_fields(inc, att), R.incident_scorecard(inc, att))
    return (ia.anomaly_alert_payload().unionByName(ia.drilldown_payload())
            .unionByName(E.release_payloads(inc)).unionByName(acc))


def _parse_answer(spark: SparkSession, d: str) -> DataFrame:
    ia = _ia(spark, d)
    answers = read_table(spark, d, "conversations").where(F.col("role") == "assistant")
    return E.parse_answer(answers, "text", ia.answer_fallback(), keep=["conv_id", "turn"])


def _insight_lines(spark: SparkSession, d: str) -> DataFrame:
    return E.insight_lines(_parse_answer(spark, d), keep=["conv_id", "turn"])


def _refresh_gold(spark: SparkSession, d: str) -> DataFrame:
    _, anomaly_table = refresh_gold(spark, _pay(spark, d))
    return anomaly_table


def _sink_overwrite(spark: SparkSession, d: str) -> DataFrame:
    path = unique_shared_path(spark, "silver_payments")
    overwrite_table(_pay(spark, d), path, "event_ts")
    return read_written(spark, path)


def _sink_append(spark: SparkSession, d: str) -> DataFrame:
    """History first, then the as-of day onwards appended (the release flow)."""
    path = unique_shared_path(spark, "silver_payments_append")
    pay = _pay(spark, d)
    cut = F.lit(C.AS_OF.isoformat() + " 00:00:00").cast("timestamp_ntz")
    overwrite_table(pay.where(F.col("event_ts") < cut), path, "event_ts")
    append_table(pay.where(F.col("event_ts") >= cut), path, "event_ts")
    return read_written(spark, path)


def _kpi_stream(spark: SparkSession, d: str) -> DataFrame:
    base = unique_shared_path(spark, "kpi_stream")
    return run_partial_kpi_stream(spark, d, "events.parquet", X.customer_regions(spark, d),
                                  f"{base}/out", f"{base}/checkpoint")


def _gold_named_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of the anomalies as SQL text over the named gold table."""
    tag = uuid.uuid4().hex[:12]  # two callers of one catalog do not meet
    refresh_gold(spark, _pay(spark, d), names=(f"gold_kpi_5m_{tag}", f"gold_anomaly_{tag}"))
    return spark.sql(f"""
        SELECT metric, COUNT(*) AS anomaly_count, MIN(bucket_5m) AS first_anomaly, MAX(bucket_5m) AS last_anomaly,
               ROUND(SUM(impact_estimated), 2) AS total_estimated_impact
        FROM gold_anomaly_{tag} WHERE is_anomaly = true GROUP BY metric""")


def _silver_named(spark: SparkSession, d: str) -> DataFrame:
    """Payments replaced and appended to by name, read back through SQL."""
    pay = _pay(spark, d)
    cut = F.lit(C.AS_OF.isoformat() + " 00:00:00").cast("timestamp_ntz")
    name = f"silver_payments_{uuid.uuid4().hex[:12]}"  # two callers of one catalog do not meet
    replace_named(pay.where(F.col("event_ts") < cut), name, "event_ts")
    append_named(pay.where(F.col("event_ts") >= cut), name, "event_ts")
    return spark.sql(f"SELECT * FROM {name}").drop("dt")


def _ingest_payments(spark: SparkSession, d: str) -> DataFrame:
    path = unique_shared_path(spark, "raw_payments") + "/json"
    write_text(_pay(spark, d), path)
    return read_payments(spark, path)


def _ingest_game_events(spark: SparkSession, d: str) -> DataFrame:
    path = unique_shared_path(spark, "raw_game_events") + "/json"
    write_text(X.game_events_from_payments(_pay(spark, d)), path)
    return read_game_events(spark, path)


def _incident_log(spark: SparkSession, d: str) -> DataFrame:
    """The log with every day's worst hour appended, the newest row marked."""
    path = unique_shared_path(spark, "incident_log") + "/log"
    found = incidents_from_payments(_pay(spark, d))
    append_incidents(found.where(F.col("incident_start") < F.lit(C.AS_OF)), path)
    append_incidents(found.where(F.col("incident_start") >= F.lit(C.AS_OF)), path)
    log = read_log(spark, path)
    newest = latest_incident(log).select("incident_id", F.lit(True).alias("latest"))
    return log.join(newest, "incident_id", "left").withColumn("latest", F.coalesce("latest", F.lit(False)))


def _parse_answer_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers written from each day's worst hour: clean JSON, JSON within text, and a broken one."""
    log = incidents_from_payments(_pay(spark, d))
    label = R.root_cause_label(*[F.col(c) for c in ("platform", "app_version", "region", "provider", "error_code")])
    fields = zip(E.ANSWER_FIELDS, ("platform", "app_version", "region", "provider", "error_code"))
    body = F.concat(F.lit('{"insights": ["'), label, F.lit('", "second"]'),
                    *[F.concat(F.lit(f', "{f}": "'), F.col(c), F.lit('"')) for f, c in fields], F.lit("}"))
    kind = F.pmod("incident_id", F.lit(3))
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Analysis:\n"), body, F.lit("\nDone."))).otherwise(
        F.concat(F.lit('{"insights": ["'), label, F.lit("]}")))
    fallback = {f: F.lit(R.UNKNOWN) for f in E.ANSWER_FIELDS}
    return E.parse_answer(log.select("incident_id", text.alias("text")), "text", fallback, keep=["incident_id"])


def _insight_cards(spark: SparkSession, d: str) -> DataFrame:
    return E.insight_cards(_insight_lines(spark, d), keep=["conv_id", "turn"])


def _gold_stream(spark: SparkSession, d: str) -> DataFrame:
    base = unique_shared_path(spark, "gold_stream")
    return run_gold_stream(spark, d, "events.parquet", X.customer_regions(spark, d),
                           f"{base}/silver", f"{base}/gold", f"{base}/checkpoint")


def _anomaly(minutes: int = C.BUCKET_MINUTES, mode: str = "other_days") -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return A.anomaly(A.baselines_window(overall_from_payments(_pay(spark, d), minutes), mode, minutes))
    return q


def _anomaly_of(spark: SparkSession, d: str) -> DataFrame:
    return _anomaly()(spark, d)


QUERIES: dict[str, Query] = {
    # sources
    "silver_payments": _pay,
    "ingest_payments": _ingest_payments,
    "ingest_game_events": _ingest_game_events,
    "silver_named": _silver_named,
    "incident_log": _incident_log,
    "silver_game_events": lambda s, d: X.game_events_from_payments(_pay(s, d)),
    "silver_payments_bucketed": lambda s, d: silver_payments_bucketed(s, d, buckets=16, salt=8),
    "table_counts": _table_counts,
    "validate_segment_status": lambda s, d: validate_segment_status(_pay(s, d), C.AS_OF, C.FOCUS_SEGMENT),
    "validate_hourly_success": lambda s, d: validate_hourly_success(_pay(s, d), C.AS_OF),
    # gold
    "bucketize": lambda s, d: bucketize(_pay(s, d)),
    "kpi_5m": lambda s, d: kpi(_pay(s, d)),
    "kpi_extent": lambda s, d: kpi_extent(kpi(_pay(s, d))),
    "overall_5m": lambda s, d: overall(kpi(_pay(s, d))),
    "overall_direct": lambda s, d: overall_from_payments(_pay(s, d)),
    "tod_key": lambda s, d: with_tod_key(overall(kpi(_pay(s, d)))),
    "baselines": lambda s, d: A.baselines(overall(kpi(_pay(s, d)))),
    "baselines_window": lambda s, d: A.baselines_window(overall_from_payments(_pay(s, d))),
    "anomaly": _anomaly_of,
    "anomaly_join": lambda s, d: A.anomaly(A.baselines(overall(kpi(_pay(s, d))))),
    "anomaly_60m": _anomaly(60),
    "anomaly_previous_days": _anomaly(mode="previous_days"),
    "anomaly_rows": lambda s, d: A.anomaly_rows(_anomaly_of(s, d)),
    "anomaly_summary": lambda s, d: A.anomaly_summary(_anomaly_of(s, d)),
    "metric_series": lambda s, d: A.metric_series(_anomaly_of(s, d), C.METRIC_RATE, C.AS_OF),
    "metric_series_revenue": lambda s, d: A.metric_series(_anomaly_of(s, d), C.METRIC_REVENUE, C.AS_OF),
    "anomaly_markers": lambda s, d: A.anomaly_markers(_anomaly_of(s, d), C.AS_OF),
    "anomaly_windows": lambda s, d: _ia(s, d).windows_by_metric,
    "anomaly_bounds": lambda s, d: _ia(s, d).bounds,
    # drill-downs in the window
    "drill_version": lambda s, d: _ia(s, d).drill_version(),
    "drill_region": lambda s, d: _ia(s, d).drill_region(),
    "drill_provider": lambda s, d: _ia(s, d).drill_provider(),
    "drill_all": lambda s, d: _ia(s, d).drill_all(),
    "top_errors": lambda s, d: _ia(s, d).top_errors(),
    "top_errors_prev_day": lambda s, d: _ia(s, d).top_errors_prev_day(),
    "error_delta": lambda s, d: _ia(s, d).error_delta(),
    "segment_vs_rest": lambda s, d: _ia(s, d).segment_vs_rest(),
    "error_distribution": lambda s, d: _ia(s, d).error_distribution(),
    "segment_fail_rate": lambda s, d: _ia(s, d).segment_fail_rate(),
    "errors_by_provider": lambda s, d: _ia(s, d).errors_by_provider(),
    "error_drill_users": lambda s, d: _ia(s, d).error_drill_users(),
    "sample_failures": lambda s, d: _ia(s, d).sample_failures(),
    "top_error_codes": lambda s, d: _ia(s, d).top_error_codes(),
    "fail_rate_by_platform": lambda s, d: fail_rate_by_platform(_pay(s, d)),
    "fail_rate_per_platform": lambda s, d: fail_rate_per_platform(_pay(s, d)),
    # impact, attribution, ranking
    "user_impact": lambda s, d: _ia(s, d).user_impact(),
    "impact_summary": lambda s, d: _ia(s, d).impact_summary(),
    "attribution": lambda s, d: _incidents_and_attribution(s, d)[1],
    "incident_scorecard": _scorecard,
    "scorecard_fields": _scorecard_fields,
    "root_cause_label": _root_cause_label,
    "root_cause_rank": lambda s, d: _ia(s, d).root_cause_rank(),
    # text and payloads
    "evidence_text": lambda s, d: _ia(s, d).evidence_text(),
    "evidence_bundle": lambda s, d: _ia(s, d).evidence_bundle(),
    "evidence_lines": lambda s, d: _ia(s, d).evidence_lines(),
    "alert_payload": _alert_payload,
    "root_cause_card": lambda s, d: _ia(s, d).root_cause_card(),
    "report_card": lambda s, d: _ia(s, d).report_card(),
    "insight_cards": _insight_cards,
    "parse_answer": _parse_answer,
    "parse_answer_json": _parse_answer_json,
    "insight_lines": _insight_lines,
    # sinks and refresh
    "refresh_gold": _refresh_gold,
    "gold_named_summary": _gold_named_summary,
    "sink_overwrite": _sink_overwrite,
    "sink_append": _sink_append,
    "kpi_5m_stream": _kpi_stream,
    "gold_stream": _gold_stream,
}


QUERIES.update(MORE_QUERIES)

__all__ = ["QUERIES", "BUCKET"]
