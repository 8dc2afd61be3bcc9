"""Sketches, maintained moments, windows of any length, lattice causes, islands, named versions, quarantine, bound SQL."""

from __future__ import annotations

import csv
import datetime as dt
import io
import random
import threading

import pytest
from pyspark.sql import functions as F

from paylens.config import DIMS
from paylens.operators import evidence as E
from paylens.operators import islands as I
from paylens.operators import lattice as L
from paylens.operators import sketches as K
from paylens.operators import windows as W
from paylens.operators.cube import overall_from_payments
from paylens.operators.seasonal import anomaly, baselines_window
from paylens.plans import sql_entry as Q
from paylens.plans.incident import IncidentAnalysis
from paylens.plans.seasonal_gold import SeasonalGold
from paylens.session import unique_shared_path
from paylens.sources import ingest as G
from paylens.sources import sinks as S
from paylens.sources.fixtures import PAYMENT_COLUMNS
from tests.conftest import pay_row


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------------- sketches

def test_sketch_error_bound_and_merge_order(spark):
    """30,000 users in buckets that overlap: within the bound, whatever the partitioning and the order of merging."""
    n = 30_000
    pay = spark.range(3 * n).select(
        F.concat(F.lit("u"), F.col("id") % n).alias("user_id"), F.lit("fail").alias("payment_status"),
        (F.lit("2024-01-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 600).cast("int"))).alias("event_ts"),
        *[F.lit("x").alias(d) for d in DIMS])
    for lg_k in (12, 16):
        est = set()
        for parts in (1, 3, 8):
            s = K.failing_user_sketches(pay.repartition(parts), lg_k=lg_k)
            est |= {s.repartition(parts).agg(K.estimate(K.FAILING)).first()[0], s.orderBy(F.desc("bucket_5m")).agg(K.estimate(K.FAILING)).first()[0]}
        assert all(abs(e - n) <= K.error_bound(lg_k) * n for e in est)
    few = K.failing_user_sketches(pay.where(F.col("user_id").isin([f"u{i}" for i in range(4000)])))
    assert few.agg(K.estimate(K.FAILING)).first()[0] == 4000  # a list of users still, counted exactly


def test_sketch_impact_edges(spark, make_payments):
    p = make_payments([pay_row(1, "2024-01-20 10:01:00", "fail", user="a"), pay_row(2, "2024-01-20 10:04:00", "fail", user="a"),
                       pay_row(3, "2024-01-20 10:06:00", "fail", user="b"), pay_row(4, "2024-01-20 11:00:00", user="c"),
                       pay_row(5, "2024-01-20 10:02:00", "fail", user="d", region=None), (6, None, None, 1.0, "USD", "Stripe", "fail", "X", "iOS", "1", "ASIA", "d")])
    s = K.failing_user_sketches(p)
    one = K.on_buckets(s, dt.datetime(2024, 1, 20, 10, 0), dt.datetime(2024, 1, 20, 10, 0))
    dau = K.daily_user_sketches(p)
    got = K.user_impact_from_sketches(one, dau, dt.date(2024, 1, 20)).first()
    assert (got.affected_users, got.total_dau, got.dau_pct) == (2, 4, 50.0)
    none = K.user_impact_from_sketches(s.limit(0), dau, dt.date(2020, 1, 1)).first()
    assert (none.affected_users, none.total_dau, none.dau_pct) == (0, 0, 0.0)
    levels = {(r.drill_level, r.region): r.affected_users for r in K.segment_users(s).where("drill_level in (0, 3)").collect()}
    assert levels == {(0, None): 3, (3, "ASIA"): 2, (3, None): 1}


# ------------------------------------------------------------- maintained moments

def _history(r, days, per_day=40):
    rows, i = [], 0
    for d in days:
        for _ in range(per_day):
            i += 1
            ts = f"2024-01-{d:02d} {r.choice([3, 9, 10]):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}"
            rows.append(pay_row(d * 1000 + i, ts, r.choice(["success", "success", "fail"]), amount=r.randrange(1, 5000) / 1000))
    return rows


def _full(pay):
    return _rows(anomaly(baselines_window(overall_from_payments(pay))))


def test_incremental_anomaly_equals_rebuild(spark, make_payments):
    r = random.Random(7)
    rows = _history(r, range(1, 6))
    g = SeasonalGold(spark)
    g.rebuild(make_payments(rows))
    assert _rows(g.anomaly()) == _full(make_payments(rows))
    # an appended day, at one hour only
    rows += [pay_row(9000 + k, f"2024-01-06 09:{k:02d}:00", "fail" if k % 3 else "success") for k in range(30)]
    before = {x.slot: x["at"] for x in g.moments().collect()}
    gen = g.refresh(make_payments(rows), [dt.date(2024, 1, 6)])
    assert _rows(g.anomaly()) == _full(make_payments(rows))
    after = {x.slot: x["at"] for x in g.moments().collect()}
    assert {s // 12 for s, a in after.items() if a == gen} == {9}  # the rows of other hours stay where they were
    assert all(after[s] == before[s] for s in before if s // 12 != 9)
    # a correction of an old day
    rows = [(*x[:6], "fail", "TOKEN_EXPIRED", *x[8:]) if x[1].day == 2 and x[1].minute < 20 else x for x in rows]
    g.refresh(make_payments(rows), [dt.date(2024, 1, 2)])
    assert _rows(g.anomaly()) == _full(make_payments(rows))
    # a removed day, and a refresh that changes nothing
    rows = [x for x in rows if x[1].day != 3]
    g.refresh(make_payments(rows), [dt.date(2024, 1, 3)])
    want = _full(make_payments(rows))
    assert _rows(g.anomaly()) == want
    gen = g.refresh(make_payments(rows), spark.createDataFrame([(dt.date(2024, 1, 4),), (None,)], "dt date"))
    assert _rows(g.anomaly()) == want and not any(x["at"] == gen for x in g.moments().collect())


def test_incremental_reads_only_touched_hours(spark, make_payments):
    rows = _history(random.Random(2), range(1, 5))
    g = SeasonalGold(spark)
    g.rebuild(make_payments(rows))
    part = g.moments().where("part = 9")
    t = g._current("by_hour", "bucket_5m timestamp_ntz, slot int, gen int, part int", 1, part, "part")
    assert "dynamicpruning" in t._jdf.queryExecution().executedPlan().toString()
    assert {(r.part, r.slot // 12) for r in t.select("part", "slot").distinct().collect()} == {(9, 9)}


def test_seasonal_gold_readers_and_failed_refresh(spark, make_payments):
    rows = _history(random.Random(3), range(1, 5))
    g = SeasonalGold(spark)
    with pytest.raises(ValueError):
        g.refresh(make_payments(rows), [dt.date(2024, 1, 1)])
    assert g.anomaly().count() == 0
    g.rebuild(make_payments(rows))
    reader, old = g.anomaly(), _full(make_payments(rows))
    more = rows + [pay_row(9000 + k, f"2024-01-05 10:{k:02d}:00", "fail") for k in range(20)]
    # files of a refresh that died before its last write are not seen, nor in the way
    spark.range(1).write.parquet(f"{g.location}/anomaly/gen=2/part=9")
    assert _rows(g.anomaly()) == old
    gen = g.refresh(make_payments(more), [dt.date(2024, 1, 5)])
    assert gen == 3 and _rows(reader) == old and _rows(g.anomaly()) == _full(make_payments(more))
    g.rebuild(make_payments(more))
    g.rebuild(make_payments(more))
    assert set(g.vacuum(1)) >= {1, 3} and _rows(g.anomaly()) == _full(make_payments(more))
    one_day = SeasonalGold(spark)
    one_day.rebuild(make_payments(_history(random.Random(4), [1])))
    assert one_day.anomaly().count() == 0


# ------------------------------------------------------------------ dyadic windows

def test_windows_of_any_length(spark):
    r = random.Random(5)
    t0 = dt.datetime(2019, 12, 31, 23, 0, 0)
    events = [(i, t0 + dt.timedelta(seconds=r.choice([r.randrange(4 * 10**8), r.randrange(7200)]), microseconds=r.choice([0, 1, 999_999])))
              for i in range(3000)] + [(9999, None), (9998, dt.datetime(1969, 12, 31, 23, 59, 59)), (9997, dt.datetime(1970, 1, 1))]
    wins = []
    for j in range(60):
        s = t0 + dt.timedelta(seconds=r.randrange(3 * 10**8) if j % 2 else r.randrange(7200))
        wins.append((j, s, s + dt.timedelta(seconds=r.choice([0, 1, 59, 60, 3600, 86_400, 30 * 86_400, 400 * 86_400, 8 * 10**8]))))
    wins += [(100, events[0][1], events[0][1]), (101, None, t0), (102, t0, None), (103, t0 + dt.timedelta(days=1), t0),
             (104, dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)), (105, dt.datetime(1969, 12, 31), dt.datetime(1970, 1, 1))]
    ev = spark.createDataFrame(events, "event_id int, event_ts timestamp_ntz")
    w = W.window_table(spark.createDataFrame(wins, "w int, astart timestamp_ntz, aend timestamp_ntz"), keep=["w"])
    got = W.restrict_to_windows(ev, w, keep=["w"], bounded=False)
    assert got.columns == ["event_id", "event_ts", "w", "window_start", "window_end"]
    want = sorted((j, i) for j, s, e in wins if s and e for i, t in events if t and s <= t <= e)
    assert sorted((x.w, x.event_id) for x in got.select("w", "event_id").collect()) == want and len(want) > 3000
    cover = W.dyadic_cover(w, ["w"]).collect()
    per = {}
    for c in cover:
        per.setdefault(c.w, []).append((c._cell << c._cell_level, (c._cell + 1) << c._cell_level, c._cell_level))
    for j, s, e in wins:
        if s and e and s <= e:  # the cells are the window's grains, without overlap
            lo, hi = (int((x - dt.datetime(1970, 1, 1)).total_seconds() // W.GRAIN_SECONDS) for x in (s, e))
            cells = sorted(per[j])
            assert cells[0][0] == lo and cells[-1][1] == hi + 1
            assert all(a[1] == b[0] for a, b in zip(cells, cells[1:]))
            assert len(cells) <= 2 * max(1, (hi + 1 - lo).bit_length())
    assert 103 not in per


def test_month_window_is_few_rows(spark):
    w = spark.createDataFrame([(dt.datetime(2024, 1, 3, 4, 5), dt.datetime(2024, 2, 3, 4, 5))], "window_start timestamp_ntz, window_end timestamp_ntz")
    assert W.dyadic_cover(w).count() <= 30


# ---------------------------------------------------------------------- lattice

def _tagged(spark, now_failing, per_leaf=40, now_share=0.9, base_share=0.1):
    """Every leaf with the same attempts in both windows; ``now_failing(leaf)`` tells which fail now."""
    rows = []
    for p in ("iOS", "Android"):
        for v in ("1.2.6", "1.2.7"):
            for reg in ("ASIA", "EU", None):
                for pr in ("Stripe", "Apple"):
                    for tag in ("now", "prev"):
                        share = now_share if tag == "now" and now_failing(p, v, reg, pr) else base_share
                        for k in range(per_leaf):
                            fail = k < share * per_leaf
                            rows.append((p, v, reg, pr, tag, "fail" if fail else "success", ("OLD" if share < 0.5 or k % 4 == 0 else "NEW") if fail else None))
    return spark.createDataFrame(rows, "platform string, app_version string, region string, provider string, tag string, payment_status string, error_code string")


def _causes(df, k=3):
    codes = L.leaf_counts(df, extra=["error_code"])
    return [r for r in L.lattice_causes(L.leaf_counts(df), codes, k).orderBy("cause").collect()]


def test_lattice_finds_the_right_level(spark):
    broad = _causes(_tagged(spark, lambda p, v, r, pr: p == "iOS" or v == "1.2.7"))
    assert [c.segment for c in broad] == ["* + 1.2.7 + * + *", "iOS + * + * + *"]  # equal scores: open dimensions first
    assert all(c.level == 1 and c.error_code == "NEW" for c in broad)
    assert abs(sum(c.excess_share for c in broad) - 1.0) < 0.02  # disjoint, and together all of it
    leaf = _causes(_tagged(spark, lambda p, v, r, pr: (p, v, r, pr) == ("iOS", "1.2.7", "ASIA", "Stripe")))
    assert [(c.segment, c.level) for c in leaf] == [("iOS + 1.2.7 + ASIA + Stripe", 4)]
    nulls = _causes(_tagged(spark, lambda p, v, r, pr: r is None and pr == "Apple"))
    assert [(c.region, c.provider, c.level, c.fixed) for c in nulls] == [(None, "Apple", 2, 3)]
    assert _causes(_tagged(spark, lambda *a: False)) == []


def test_lattice_without_rows(spark):
    assert _causes(_tagged(spark, lambda *a: True).limit(0)) == []
    whole = _causes(_tagged(spark, lambda *a: True), 1)
    assert whole[0].level == 1  # the whole is no segment; the widest one stands for it


# ---------------------------------------------------------------------- islands

def _flags(spark, times):
    rows = [(dt.datetime.fromisoformat(t), m, 1.0, 1.0, z, True, 2.5) for t, m, z in times] + [
        (dt.datetime(2024, 1, 20, 10, 5), "revenue", 1.0, 1.0, 0.0, False, 99.0)]
    return spark.createDataFrame(rows, "bucket_5m timestamp_ntz, metric string, actual double, baseline double, z_score double, "
                                       "is_anomaly boolean, impact_estimated double")


def test_islands(spark):
    r = "pay_success_rate"
    df = _flags(spark, [("2024-01-20 03:00", r, -4.0), ("2024-01-20 10:00", r, -4.0), ("2024-01-20 10:05", r, -5.0), ("2024-01-20 10:15", r, -6.0),
                        ("2024-01-20 10:30", r, -3.5), ("2024-01-20 23:55", r, -4.0), ("2024-01-21 00:05", r, -4.0), ("2024-01-21 00:10", r, -4.0),
                        ("2024-01-20 10:00", "revenue", -9.0)])
    got = [(x.metric, x.island, str(x.anomaly_start)[5:16], str(x.anomaly_end)[5:16], x.anomaly_buckets, x.avg_z_score, x.total_impact_usd)
           for x in I.islands(df, gap=2).orderBy("metric", "island").collect()]
    assert got == [(r, 1, "01-20 03:00", "01-20 03:00", 1, -4.0, 2.5), (r, 2, "01-20 10:00", "01-20 10:15", 3, -5.0, 7.5),
                   (r, 3, "01-20 10:30", "01-20 10:30", 1, -3.5, 2.5), (r, 4, "01-20 23:55", "01-21 00:10", 3, -4.0, 7.5),
                   ("revenue", 1, "01-20 10:00", "01-20 10:00", 1, -9.0, 2.5)]
    day = I.islands(df, gap=2, as_of=dt.date(2024, 1, 21)).collect()
    assert [(str(x.anomaly_start)[5:16], x.anomaly_buckets) for x in day] == [("01-21 00:05", 2)]
    assert I.islands(df.limit(0)).count() == 0


def test_drills_over_separate_windows(spark, make_payments):
    """What fails between two islands is in the min–max window, not in the separate ones."""
    r = "pay_success_rate"
    flags = _flags(spark, [("2024-01-20 03:00", r, -4.0), ("2024-01-20 10:00", r, -4.0)])
    pay = make_payments([pay_row(1, "2024-01-20 03:00:00", "fail"), pay_row(2, "2024-01-20 06:00:00", "fail"), pay_row(3, "2024-01-20 10:00:00", "fail")])
    one = IncidentAnalysis(pay, dt.date(2024, 1, 20), anomaly_df=flags)
    many = IncidentAnalysis(pay, dt.date(2024, 1, 20), anomaly_df=flags, separate=True, gap=2)
    assert one.top_errors().first().error_count == 3 and many.top_errors().first().error_count == 2
    assert sorted(x.event_id for x in many.payments_in_window.collect()) == [1, 3]
    assert many.user_impact().first().affected_users == 2


# ---------------------------------------------------------------- named versions

def test_readers_during_replaces(spark, make_payments):
    name = "t_replaced"
    rows = lambda n: make_payments([pay_row(i, f"2024-01-{1 + i % 3:02d} 10:00:00") for i in range(n)])
    S.replace_named(rows(10), name, "event_ts")
    stop, seen, failed = threading.Event(), set(), []

    def read():
        while not stop.is_set():
            try:
                seen.add(spark.sql(f"SELECT COUNT(*) FROM {name}").first()[0])
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(11, 21):
            S.replace_named(rows(n), name, "event_ts")
    finally:
        stop.set()
        reader.join()
    assert not failed and seen <= set(range(10, 21)) and len(seen) > 1
    assert len(S.named_versions(spark, name)) == 11
    assert S.vacuum_named(spark, name, 2) == list(range(1, 10)) and spark.table(name).count() == 20
    spark.sql(f"DROP VIEW {name}")


def test_named_table_edges(spark, make_payments):
    name = "t_named"
    p = make_payments([pay_row(1, "2024-01-01 10:00:00"), (2, None, "u", 1.0, "USD", "S", "fail", "X", "iOS", "1", "A", "d")])
    S.replace_named(p, name, "event_ts")
    held = spark.table(name)
    S.replace_named(spark.table(name).drop("dt").where("event_id = 1"), name, "event_ts")  # from itself
    assert spark.table(name).count() == 1 and held.count() == 2
    with pytest.raises(Exception):
        S.replace_named(p.withColumn("event_id", F.raise_error(F.lit("broken"))), name, "event_ts")
    assert spark.table(name).count() == 1  # the old version is still the table
    S.replace_named(p.limit(0), name, "event_ts")
    assert spark.table(name).count() == 0 and spark.table(name).columns == p.columns + ["dt"]
    S.append_named(p, name, "event_ts")
    assert _rows(spark.table(name).drop("dt")) == _rows(p)
    p.createOrReplaceTempView("t_plain")
    with pytest.raises(ValueError):
        S.append_named(p, "t_plain", "event_ts")
    spark.sql(f"DROP VIEW {name}")


def test_ordered_output_has_disjoint_files(spark):
    path = unique_shared_path(spark, "t_ordered") + "/t"
    df = spark.range(20_000).select((F.col("id") * 7919 % 1009).alias("k"), F.col("id").alias("v"))
    S.overwrite_ordered(df, path, ["k", "v"], files=6)
    back = spark.read.parquet(path)
    ranges = sorted((r.lo, r.hi) for r in back.groupBy(F.input_file_name()).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    assert len(ranges) > 3 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and back.count() == 20_000
    import glob
    import pyarrow.parquet as pq
    for f in glob.glob(f"{path}/*.parquet"):
        t = pq.read_table(f).to_pylist()
        assert t == sorted(t, key=lambda x: (x["k"], x["v"]))


# -------------------------------------------------------------------- quarantine

def test_every_line_is_accepted_or_quarantined(spark):
    base = unique_shared_path(spark, "t_quarantine")
    good = '{"event_id":"1","event_ts":"2024-01-20T10:00:00","amount":"1.5","user_id":"u|\\"x\\""}'
    lines = [good, '{"event_id":"2","event_ts"', '{"event_id":"x","event_ts":"bad","amount":"1"}', "plain | text", '{"event_id":"3"}', "[1]", "null", "{}"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{base}/raw")
    table, bad = G.ingest(spark, f"{base}/raw", PAYMENT_COLUMNS, G.PAYMENT_TYPES, f"{base}/t", f"{base}/q")
    rows, out = table.collect(), bad.collect()
    assert len(rows) + len(out) == len(lines)
    assert {r.event_id for r in rows} == {1, 3, None} and {r.user_id for r in rows if r.event_id == 1} == {'u|"x"'}
    assert {r.record for r in out if r.reason == G.NOT_A_RECORD} == {lines[1], lines[3], "[1]", "null"}
    wrong = next(r for r in out if r.reason == G.WRONG_TYPE)
    assert wrong["columns"] == ["event_id", "event_ts"] and '"event_id":"x"' in wrong.record and '"event_ts":"bad"' in wrong.record
    assert all(r.source_file.endswith(".txt") for r in out)
    spark.createDataFrame([], "value string").write.text(f"{base}/none")
    table, bad = G.ingest(spark, f"{base}/none", PAYMENT_COLUMNS, G.PAYMENT_TYPES, f"{base}/t0", f"{base}/q0")
    assert table.count() == 0 and bad.count() == 0


def test_plain_reader_rejects_broken_lines(spark):
    base = unique_shared_path(spark, "t_broken")
    spark.createDataFrame([("{oops",), ('{"event_id":"7"}',)], "value string").coalesce(1).write.text(f"{base}/raw")
    rows = G.read_payments(spark, f"{base}/raw")
    assert G.rejects(rows).count() == 1 and rows.where("event_id = 7").first().rejected == []


# ------------------------------------------------------------------ bound values

@pytest.mark.parametrize("value", ["x' OR '1'='1", "{braces} %s", 'say "hi"', "back\\slash", ":day", "-- end", "/* c */", "é\n東京", ""])
def test_bound_values_are_only_values(spark, make_payments, value):
    p = make_payments([pay_row(1, "2024-01-20 10:00:00", "fail", error=value or "E"), pay_row(2, "2024-01-20 10:00:00", "fail", error="E2"),
                       pay_row(3, "2024-01-21 00:00:00", "fail", error=value or "E")])
    got = Q.segment_failures(p, dt.date(2024, 1, 20), value or "E").collect()
    assert [(r.error_code, r.error_count) for r in got] == [(value or "E", 1)]
    assert {r.note for r in Q.noted_attempts(p, value).collect()} == {value}
    assert sum(r.error_count for r in Q.segment_failures(p, dt.date(2024, 1, 20)).collect()) == 2


def test_day_function(spark, make_payments):
    p = make_payments([pay_row(1, "2024-01-20 00:00:00"), pay_row(2, "2024-01-20 23:59:59"), pay_row(3, "2024-01-21 00:00:00")])
    a, b = Q.install_day_function(p), Q.install_day_function(p.limit(0))
    assert a != b
    assert Q.run_sql(spark, f"SELECT event_id FROM {a}(:d)", {"d": dt.date(2024, 1, 20)}).count() == 2
    assert spark.sql(f"SELECT * FROM {b}(DATE'2024-01-20')").count() == 0


# ------------------------------------------------------------------- quoted export

def test_export_round_trip(spark):
    rows = [(1, "a|b", 'say "hi"'), (2, "two\nlines", "cr\rx"), (3, "", None), (4, '"', "|\"|\n"), (5, "plain", "été")]
    df = spark.createDataFrame(rows, "id int, `x|y` string, z string")
    text = E.table_text(df, [F.col("id")]).first().text
    back = list(csv.reader(io.StringIO(text, newline=""), delimiter="|"))
    assert back == [["id", "x|y", "z"]] + [[str(i), a or "", b or ""] for i, a, b in rows]
