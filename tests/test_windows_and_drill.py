"""Window restriction, empty windows, ties, text products, answer parsing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from paylens.operators import drill as D
from paylens.operators import evidence as E
from paylens.operators.windows import restrict_to_windows, window_table
from paylens.plans.incident import IncidentAnalysis
from tests.conftest import pay_row


def _bounds(spark, s, e):
    return spark.createDataFrame([(s, e)], "astart timestamp_ntz, aend timestamp_ntz")


def test_between_is_closed_and_last_bucket_is_cut(spark, make_payments):
    p = make_payments([pay_row(1, "2024-01-20 10:00:00"), pay_row(2, "2024-01-20 10:35:00"),
                       pay_row(3, "2024-01-20 10:35:00.000001"), pay_row(4, "2024-01-20 09:59:59")])
    w = window_table(_bounds(spark, dt.datetime(2024, 1, 20, 10), dt.datetime(2024, 1, 20, 10, 35)))
    got = sorted(r.event_id for r in restrict_to_windows(p, w).collect())
    assert got == [1, 2]


def test_window_over_several_days_and_shift(spark, make_payments):
    p = make_payments([pay_row(1, "2024-01-10 00:00:00"), pay_row(2, "2024-01-11 12:00:00"),
                       pay_row(3, "2024-01-12 23:59:59"), pay_row(4, "2024-01-13 00:00:00"),
                       pay_row(5, "2024-01-12 00:00:00")])
    b = _bounds(spark, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12, 23, 59, 59))
    assert sorted(r.event_id for r in restrict_to_windows(p, window_table(b)).collect()) == [1, 2, 3, 5]
    # shifted one day back: 2024-01-10 12:00 .. 2024-01-12 00:00 (closed)
    shifted = window_table(_bounds(spark, dt.datetime(2024, 1, 11, 12), dt.datetime(2024, 1, 13)), shift_days=1)
    assert sorted(r.event_id for r in restrict_to_windows(p, shifted).collect()) == [2, 5]


def test_no_anomaly_means_empty_drills_and_zero_users(make_payments):
    rows = [pay_row(i, f"2024-01-0{d} 10:00:00") for i, d in enumerate(range(1, 6))]
    ia = IncidentAnalysis(make_payments(rows), dt.date(2024, 1, 5))
    assert ia.bounds.collect()[0].astart is None
    assert ia.drill_provider().count() == 0 and ia.top_errors().count() == 0
    assert ia.root_cause_rank().count() == 0
    u = ia.user_impact().collect()[0]
    assert u.affected_users == 0 and u.total_dau == 1
    s = ia.impact_summary().collect()[0]
    assert s.anomaly_start is None and s.affected_users == 0
    assert ia.anomaly_alert_payload().count() == 0
    assert ia.drilldown_payload().count() == 0


def test_equal_fail_rates_break_ties_by_keys(make_payments):
    rows = [pay_row(1, "2024-01-01 10:00:00", "fail", region="EUROPE"),
            pay_row(2, "2024-01-01 10:00:00", "fail", region="ASIA"),
            pay_row(3, "2024-01-01 10:00:00", "fail", region="AFRICA", platform="Android")]
    got = [(r.platform, r.region) for r in D.segment_fail_rate(make_payments(rows), k=2).collect()]
    assert got == [("Android", "AFRICA"), ("iOS", "ASIA")]


def test_min_attempts_filters_tiny_segments(make_payments):
    rows = [pay_row(1, "2024-01-01 10:00:00", "fail", region="EUROPE")] + \
        [pay_row(10 + i, "2024-01-01 10:00:00", "fail" if i < 3 else "success") for i in range(4)]
    got = D.segment_fail_rate(make_payments(rows), k=1, min_attempts=2).collect()
    assert got[0].region == "ASIA" and got[0].fail_rate == 0.75


def test_table_text_nulls_and_order(spark):
    df = spark.createDataFrame([("b", 2, None), ("a", 2, 0.5), ("c", 9, 0.25)], "k string, n bigint, r double")
    t = E.table_text(df, [-F.col("n"), F.col("k")], {"r": 4}).collect()[0]
    assert t.n_rows == 3
    assert t.text == "k|n|r\nc|9|0.2500\na|2|0.5000\nb|2|"


def test_parse_answer_paths(spark):
    texts = [
        (1, 'Sure! {"insights": ["a", "b"], "detected_platform": "iOS",\n "detected_error": "X"} thanks'),
        (2, "no json here at all " * 30),
        (3, "{not: valid json}"),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    fb = {f: F.lit("fb_" + f) for f in E.ANSWER_FIELDS}
    got = {r.id: r for r in E.parse_answer(df, "text", fb, keep=["id"]).collect()}
    assert got[1].source == "json" and got[1].parse_ok and got[1].insights == ["a", "b"]
    assert got[1].detected_platform == "iOS" and got[1].detected_error == "X" and got[1].detected_region is None
    assert got[2].source == "fallback" and got[2].insights == [texts[1][1]]
    assert got[2].detected_version == "fb_detected_version" and got[2].answer_chars == 600
    assert got[3].source == "json" and got[3].parse_ok is False and got[3].detected_platform is None


def test_alert_payload_json(spark):
    from paylens.plans.registry import QUERIES
    import json
    rows = QUERIES["alert_payload"](spark, "/root/testdata/sf0.01").collect()
    kinds = sorted(r.kind for r in rows)
    assert kinds == ["accuracy_report"] * 3 + ["anomaly_alert", "drilldown"] + ["release"] * 3
    for r in rows:
        card = json.loads(r.payload)
        assert card["msg_type"] == "interactive" and card["card"]["elements"]
    rel = [json.loads(r.payload) for r in rows if r.kind == "release" and r.incident_id == 2][0]
    assert "**Incident**: 10:00 → 13:59" in rel["card"]["elements"][0]["text"]["content"]
    acc = [json.loads(r.payload) for r in rows if r.kind == "accuracy_report" and r.incident_id == 1][0]
    assert acc["card"]["header"]["title"]["content"].endswith("100%")
    assert acc["card"]["header"]["template"] == "green"


def test_insight_lines_enumerate(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, None)], "id int, insights array<string>")
    got = {r.id: r for r in E.insight_lines(df, keep=["id"]).collect()}
    assert got[1].text == "• Root Cause #1: x\n• Root Cause #2: y" and got[1].n_insights == 2
    assert got[2].text == "" and got[2].n_insights == 0


def test_hot_key_holding_a_third_of_rows(spark, make_payments):
    """One user and one segment hold a third of all rows: counts stay exact and
    the distinct count is pre-aggregated on (keys, user) before any shuffle."""
    import contextlib
    import io

    rows = [pay_row(i, "2024-01-20 10:01:00", "fail", user="u_hot") for i in range(300)]
    rows += [pay_row(1000 + i, "2024-01-20 10:02:00", "fail", region=["EUROPE", "ASIA", "AFRICA"][i % 3],
                     user=f"u_{i:06d}") for i in range(600)]
    p = make_payments(rows)
    got = {(r.region, r.error_code): (r.error_count, r.affected_users) for r in D.error_drill_users(p, k=10).collect()}
    assert got[("ASIA", "TOKEN_EXPIRED")] == (500, 201)
    assert got[("EUROPE", "TOKEN_EXPIRED")] == (200, 200)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        D.error_drill_users(p, k=10).explain()
    plan = buf.getvalue()
    # the first aggregate over the scan groups by the segment keys AND user_id
    first_agg = [ln for ln in plan.splitlines() if "HashAggregate(keys=" in ln][-1]
    assert "user_id" in first_agg and "region" in first_agg
