"""Hand-built micro-frames for the edges of the anomaly rule."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paylens.operators import seasonal as A
from paylens.operators.cube import bucketize, kpi, overall, overall_from_payments
from tests.conftest import pay_row


def _anomaly(payments, form=A.baselines_window, **kw):
    return A.anomaly(form(overall(kpi(payments)), **kw))


def _day_rows(day: str, slot: str, statuses: list[str], amount: float = 1.0, start: int = 0):
    return [pay_row(start + i, f"{day} {slot}", s, amount) for i, s in enumerate(statuses)]


def test_one_day_only_gives_no_rows(make_payments):
    p = make_payments(_day_rows("2024-01-01", "10:01:00", ["success", "fail"]))
    assert _anomaly(p).count() == 0


def test_one_comparison_day_has_null_std_and_zero_z(make_payments):
    rows = _day_rows("2024-01-01", "10:01:00", ["success", "success"]) + \
        _day_rows("2024-01-02", "10:02:00", ["fail", "fail"], start=10)
    out = {(r.bucket_5m.day, r.metric): r for r in _anomaly(make_payments(rows)).collect()}
    assert len(out) == 4
    for r in out.values():
        assert r.z_score == 0.0 and r.is_anomaly is False
    b = A.baselines_window(overall(kpi(make_payments(rows)))).collect()
    assert all(r.std_psr is None and r.std_revenue is None for r in b)


def test_constant_history_has_exact_zero_std(make_payments):
    rows = []
    for d in range(1, 5):
        rows += _day_rows(f"2024-01-0{d}", "10:03:00", ["success"] * 3 + ["fail"], start=d * 10)
    rows += _day_rows("2024-01-05", "10:03:00", ["fail"] * 4, start=100)
    b = {r.bucket_5m.day: r for r in A.baselines_window(overall(kpi(make_payments(rows)))).collect()}
    assert b[5].std_psr == 0.0  # exactly zero, not a rounding residue
    out = [r for r in _anomaly(make_payments(rows)).collect() if r.bucket_5m.day == 5]
    assert all(not r.is_anomaly and r.z_score == 0.0 for r in out)
    psr = [r for r in out if r.metric == "pay_success_rate"][0]
    # (0.75 - 0) * 4 attempts * 14.99
    assert psr.impact_estimated == 44.97


def _revenue_history(other_day_dollars, actual_dollars):
    rows, i = [], 0
    for d, dollars in enumerate(other_day_dollars, start=1):
        rows.append(pay_row(i, f"2024-01-0{d} 10:01:00", "success", float(dollars)))
        i += 1
    day = len(other_day_dollars) + 1
    if actual_dollars:
        rows.append(pay_row(i, f"2024-01-0{day} 10:01:00", "success", float(actual_dollars)))
    else:
        rows.append(pay_row(i, f"2024-01-0{day} 10:01:00", "fail"))
    return rows, day


def _revenue_row(make_payments, others, actual):
    rows, day = _revenue_history(others, actual)
    out = _anomaly(make_payments(rows)).where(F.col("metric") == "revenue").collect()
    return [r for r in out if r.bucket_5m.day == day][0]


def test_z_exactly_minus_three_is_not_flagged(make_payments):
    r = _revenue_row(make_payments, [8, 12, 16], 0)  # mean 12, std 4 -> z = -3
    assert r.z_score == -3.0 and r.is_anomaly is False
    assert r.baseline == 12.0 and r.impact_estimated == 12.0


def test_z_below_minus_three_is_flagged(make_payments):
    r = _revenue_row(make_payments, [9, 12, 15], 0)  # mean 12, std 3 -> z = -4
    assert r.z_score == -4.0 and r.is_anomaly is True


def test_positive_spike_is_not_flagged(make_payments):
    r = _revenue_row(make_payments, [9, 12, 15], 48)  # z = +12
    assert r.z_score == 12.0 and r.is_anomaly is False and r.impact_estimated == 0.0


def test_previous_days_mode_uses_only_earlier_days(make_payments):
    rows, _ = _revenue_history([9, 12, 15], 0)
    out = A.anomaly(A.baselines_window(overall(kpi(make_payments(rows))), mode="previous_days"))
    days = sorted({r.bucket_5m.day for r in out.collect()})
    assert days == [2, 3, 4]  # day 1 has no earlier day
    j = A.anomaly(A.baselines(overall(kpi(make_payments(rows))), mode="previous_days"))
    assert sorted(out.collect()) == sorted(j.collect())


def test_bucket_edges(make_payments):
    p = make_payments([
        pay_row(1, "2024-01-01 10:04:59.999999"),
        pay_row(2, "2024-01-01 10:05:00"),
        pay_row(3, "2024-01-01 23:59:59.5"),
    ])
    got = {r.event_id: r.bucket_5m for r in bucketize(p).collect()}
    assert got[1] == dt.datetime(2024, 1, 1, 10, 0)
    assert got[2] == dt.datetime(2024, 1, 1, 10, 5)
    assert got[3] == dt.datetime(2024, 1, 1, 23, 55)


def test_other_status_counts_as_attempt_only(make_payments):
    p = make_payments([pay_row(1, "2024-01-01 10:00:00", "success", 2.5),
                       pay_row(2, "2024-01-01 10:01:00", "pending", 9.0),
                       pay_row(3, "2024-01-01 10:02:00", "fail")])
    r = kpi(p).collect()[0]
    assert (r.pay_attempts, r.pay_success, r.pay_fail, r.revenue, r.pay_success_rate) == (3, 1, 1, 2.5, 0.3333)


def test_null_dimension_is_its_own_group(make_payments):
    p = make_payments([pay_row(1, "2024-01-01 10:00:00", region=None),
                       pay_row(2, "2024-01-01 10:01:00", region="ASIA")])
    assert sorted((r.region or "") for r in kpi(p).collect()) == ["", "ASIA"]


def test_revenue_sums_are_exact_cents(make_payments):
    rows = [pay_row(i, "2024-01-01 10:00:00", "success", 0.1) for i in range(10)]
    r = kpi(make_payments(rows)).collect()[0]
    assert r.revenue == 1.0  # a float sum of ten 0.1 would be 0.9999999999999999


def test_direct_overall_equals_cube_rollup(make_payments, spark):
    from paylens.plans.registry import _pay
    p = _pay(spark, "/root/testdata/sf0.001")
    assert sorted(overall(kpi(p)).collect()) == sorted(overall_from_payments(p).collect())


def test_join_and_window_baselines_are_identical(spark):
    from paylens.plans.registry import _pay
    ov = overall(kpi(_pay(spark, "/root/testdata/sf0.01")))
    a = sorted(A.baselines(ov).collect())
    b = sorted(A.baselines_window(ov).collect())
    assert a == b  # bit-identical, not approximately equal


def test_invariants_on_fixture(spark):
    from paylens.plans.registry import _pay
    k = kpi(_pay(spark, "/root/testdata/sf0.01"))
    assert k.where(F.col("pay_success") + F.col("pay_fail") != F.col("pay_attempts")).count() == 0
    an = _anomaly(_pay(spark, "/root/testdata/sf0.01"))
    assert an.where(F.col("is_anomaly") & (F.col("z_score") > -3)).count() == 0
    assert an.where(~F.col("is_anomaly") & (F.col("z_score") < -3.005)).count() == 0


def test_null_timestamp_is_its_own_bucket_and_vanishes_in_anomaly(make_payments):
    rows = [pay_row(1, "2024-01-01 10:00:00"), pay_row(2, "2024-01-02 10:00:00")]
    rows.append((3, None, "u_000003", 1.0, "USD", "Stripe", "success", None, "iOS", "1.2.7", "ASIA", "iPhone14"))
    p = make_payments(rows)
    k = kpi(p).collect()
    assert sorted(r.bucket_5m is None for r in k) == [False, False, True]
    assert all(r.bucket_5m is not None for r in _anomaly(p).collect())


def test_amounts_below_a_cent_are_summed_before_rounding(make_payments):
    rows = [pay_row(i, "2024-01-01 10:00:00", "success", 0.004) for i in range(1000)]
    p = make_payments(rows)
    assert kpi(p).collect()[0].revenue == 4.0
    assert overall_from_payments(p).collect()[0].revenue == 4.0


def test_rounding_holds_for_large_and_small_values(spark):
    from paylens.functions.expr import round_half_up
    df = spark.createDataFrame([(123456789.125, 0.285, 0.2849999)], "a double, b double, c double")
    r = df.select(*[round_half_up(c, 2).alias(c) for c in df.columns]).first()
    assert (r.a, r.b, r.c) == (123456789.13, 0.29, 0.28)


def test_unknown_baseline_mode_is_refused(spark, make_payments):
    with pytest.raises(ValueError):
        A.baselines(overall(kpi(make_payments([pay_row(1, "2024-01-01 10:00:00")]))), "all_days")
