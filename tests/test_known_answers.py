"""Injected incidents are recovered (known answers of the fixture adapter)."""

from __future__ import annotations

import datetime as dt

import pytest

from paylens.plans.incident import IncidentAnalysis
from paylens.plans.registry import QUERIES, _pay
from tests.conftest import SF01

DAY = dt.date(2024, 1, 20)


@pytest.fixture(scope="module")
def hourly(spark):
    return IncidentAnalysis(_pay(spark, SF01), DAY, minutes=60)


def test_incident_a_window_recovered_hourly(spark):
    a = QUERIES["anomaly_60m"](spark, SF01)
    flagged = a.where("is_anomaly and metric = 'pay_success_rate' and to_date(bucket_5m) = '2024-01-20'")
    got = [(r.bucket_5m.hour, r.z_score) for r in flagged.orderBy("bucket_5m").collect()]
    assert got == [(10, -6.12), (11, -3.2), (12, -5.85), (13, -4.46)]


def test_bounds_and_top_error_code(hourly):
    b = hourly.bounds.collect()[0]
    assert (b.astart, b.aend) == (dt.datetime(2024, 1, 20, 10), dt.datetime(2024, 1, 20, 13))
    top = hourly.top_error_codes().collect()
    assert top[0].error_code == "TOKEN_EXPIRED" and top[0].cnt > 3 * top[1].cnt


def test_drill_version_ranks_incident_segments_lowest(hourly):
    rows = hourly.drill_version().collect()
    # every segment on iOS or 1.2.7 is hit by incident A; Android 1.2.6 is healthy
    assert rows[-1].platform == "Android" and rows[-1].app_version == "1.2.6"
    assert [r.success_rate for r in rows] == sorted(r.success_rate for r in rows)


def test_scorecard(spark):
    got = {r.incident_id: (r.matches, r.accuracy, r.passed) for r in QUERIES["incident_scorecard"](spark, SF01).collect()}
    assert got == {1: (5, 100, True), 2: (2, 40, False), 3: (0, 0, False)}


def test_incident_b_top_segment(spark):
    att = {r.incident_id: r for r in QUERIES["attribution"](spark, SF01).collect()}
    b = att[1]
    assert (b.detected_platform, b.detected_version, b.detected_region, b.detected_provider, b.detected_error) == (
        "iOS", "1.2.7", "ASIA", "Stripe", "PROVIDER_ERROR")
    assert all(getattr(att[3], f) == "unknown" for f in
               ("detected_platform", "detected_version", "detected_region", "detected_provider", "detected_error"))


def test_impact_summary(hourly):
    r = hourly.impact_summary().collect()[0]
    assert r.duration_minutes == 240 and r.anomaly_buckets == 4
    assert r.affected_users > 0 and r.total_dau >= r.affected_users
    assert r.dau_pct == round(100 * r.affected_users / r.total_dau, 1)


def test_segment_vs_rest_separates_incident(hourly):
    # Android 1.2.6 is the only segment outside incident A (fails = error events
    # only, ~20 %); every other segment fails on all non-purchase events.
    rows = [r for r in hourly.segment_vs_rest({"platform": "Android", "app_version": "1.2.6"}).collect()
            if 10 <= r.bucket_5m.hour <= 13]
    outside = sum(r.affected_fails for r in rows) / sum(r.affected_attempts for r in rows)
    inside = sum(r.healthy_fails for r in rows) / sum(r.healthy_attempts for r in rows)
    assert outside < 0.4 < 0.6 < inside
