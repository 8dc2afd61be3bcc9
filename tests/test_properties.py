"""Property test: leave-one-out baselines equal a direct computation."""

from __future__ import annotations

import datetime as dt
import math
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st

from paylens.operators import seasonal as A

# per day: (success count, attempts, revenue in cents) of one 5-minute slot
day = st.tuples(st.integers(0, 20), st.integers(1, 20), st.integers(0, 500_000)).map(
    lambda t: (min(t[0], t[1]), t[1], t[2]))


@settings(max_examples=15, deadline=None)
@given(st.lists(day, min_size=1, max_size=8))
def test_window_baseline_matches_python(spark, days):
    rows = []
    for i, (succ, att, cents) in enumerate(days):
        ts = dt.datetime(2024, 1, 1 + i, 10, 5)
        rate = round(succ / att + 1e-9, 4)
        rows.append((ts, cents / 100.0, att, succ, att - succ, rate))
    ov = spark.createDataFrame(rows, "bucket_5m timestamp_ntz, revenue double, pay_attempts bigint, "
                                     "pay_success bigint, pay_fail bigint, pay_success_rate double")
    got = {r.bucket_5m.day: r for r in A.baselines_window(ov).collect()}
    join = {r.bucket_5m.day: r for r in A.baselines(ov).collect()}
    assert got == join
    for i, r in enumerate(rows):
        others = [o for j, o in enumerate(rows) if j != i]
        d = r[0].day
        if not others:
            assert d not in got
            continue
        g = got[d]
        rates, revs = [o[5] for o in others], [o[1] for o in others]
        assert math.isclose(g.baseline_psr, statistics.fmean(rates), rel_tol=0, abs_tol=1e-12)
        assert math.isclose(g.baseline_revenue, statistics.fmean(revs), rel_tol=0, abs_tol=1e-9)
        if len(others) == 1:
            assert g.std_psr is None and g.std_revenue is None
        else:
            assert math.isclose(g.std_psr, statistics.stdev(rates), rel_tol=0, abs_tol=1e-12)
            assert math.isclose(g.std_revenue, statistics.stdev(revs), rel_tol=1e-12, abs_tol=1e-9)
            if len(set(rates)) == 1:
                assert g.std_psr == 0.0
