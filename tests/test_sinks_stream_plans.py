"""Sinks (write-then-read), partition pruning, streaming twin, plan shapes."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from paylens.operators import seasonal as A
from paylens.operators.cube import kpi, overall
from paylens.plans.gold import refresh_gold
from paylens.plans.incident import IncidentAnalysis
from paylens.plans.registry import QUERIES, _pay
from paylens.session import unique_shared_path
from paylens.sources.fixtures import game_events_from_payments
from paylens.sources.incident_log import incidents_from_payments
from paylens.sources.sinks import append_table, overwrite_table, read_written
from paylens.streaming.kpi_stream import partial_kpi
from tests.conftest import SF001, SF01, pay_row


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_overwrite_then_append_round_trip(spark):
    p = _pay(spark, SF001)
    path = unique_shared_path(spark, "t_sink")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    overwrite_table(p.where(F.col("event_ts") < cut), path, "event_ts")
    append_table(p.where(F.col("event_ts") >= cut), path, "event_ts")
    back = read_written(spark, path)
    assert sorted(back.collect()) == sorted(p.collect())
    overwrite_table(p, path, "event_ts")  # overwrite replaces, not appends
    assert read_written(spark, path).count() == p.count()


def test_gold_refresh_equals_lazy_chain(spark):
    p = _pay(spark, SF001)
    kpi_t, an_t = refresh_gold(spark, p)
    assert sorted(kpi_t.collect()) == sorted(kpi(p).collect())
    assert sorted(an_t.collect()) == sorted(QUERIES["anomaly"](spark, SF001).collect())


def test_window_join_prunes_day_partitions(spark):
    path = unique_shared_path(spark, "t_dpp")
    overwrite_table(_pay(spark, SF01), path, "event_ts")
    silver = read_written(spark, path, keep_partition=True)
    kpi_t, an_t = refresh_gold(spark, silver, keep_partition=True)
    ia = IncidentAnalysis(silver, anomaly_df=an_t, kpi_df=kpi_t)
    plan = _plan(ia.top_errors())
    assert "dynamicpruningexpression" in plan
    assert "PartitionFilters: [isnotnull(dt" in plan and "2024-01-20" in plan
    lazy = IncidentAnalysis(_pay(spark, SF01))
    assert sorted(ia.top_errors().collect()) == sorted(lazy.top_errors().collect())
    assert sorted(ia.drill_provider().collect()) == sorted(lazy.drill_provider().collect())


def test_stream_equals_batch(spark):
    out = QUERIES["kpi_5m_stream"](spark, SF001)
    assert sorted(out.collect()) == sorted(kpi(_pay(spark, SF001)).collect())  # open buckets included


# what the writing queries write; the plan of their result is a scan of it
WRITTEN = {
    "refresh_gold": lambda p: A.anomaly(A.baselines_window(overall(kpi(p)))),
    "gold_named_summary": lambda p: A.anomaly(A.baselines_window(overall(kpi(p)))),
    "gold_stream": kpi, "kpi_5m_stream": partial_kpi, "sink_overwrite": lambda p: p, "sink_append": lambda p: p,
    "silver_named": lambda p: p, "silver_payments_bucketed": lambda p: p, "ingest_payments": lambda p: p,
    "ingest_game_events": game_events_from_payments, "incident_log": incidents_from_payments,
}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, key):
    plan = _plan(WRITTEN[key](_pay(spark, SF001)) if key in WRITTEN else QUERIES[key](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["top_errors", "error_drill_users", "user_impact", "sample_failures"])
def test_window_queries_push_day_bounds_to_scan(spark, key):
    plan = _plan(QUERIES[key](spark, SF001))
    assert "GreaterThanOrEqual(ts,2024-01-20T00:00)" in plan and "LessThan(ts,2024-01-21T00:00)" in plan


def test_typed_ingest_from_text(spark):
    from paylens.sources.ingest import read_payments, rejects, write_text
    p = _pay(spark, SF001)
    path = unique_shared_path(spark, "t_ingest") + "/json"
    write_text(p, path)
    back = read_payments(spark, path)
    assert sorted(back.drop("rejected").collect()) == sorted(p.collect())
    assert rejects(back).count() == 0


def test_typed_ingest_names_what_does_not_parse(spark):
    from paylens.sources.ingest import PAYMENT_TYPES, rejects, typed
    raw = spark.createDataFrame([("1", "2024-01-01T10:00:00", "1.5"), ("x", "not a time", None)],
                                "event_id string, event_ts string, amount string")
    rows = typed(raw, PAYMENT_TYPES).collect()
    assert rows[0].rejected == [] and rows[0].amount == 1.5
    assert rows[1].rejected == ["event_id", "event_ts"] and rows[1].event_id is None
    assert rejects(typed(raw, PAYMENT_TYPES)).count() == 1


def test_checkpointed_analysis_equals_lazy(spark):
    lazy = IncidentAnalysis(_pay(spark, SF001))
    ck = lazy.checkpointed()
    assert sorted(ck.drill_provider().collect()) == sorted(lazy.drill_provider().collect())
    assert "Scan ExistingRDD" in _plan(ck.anomaly) or "LogicalRDD" in _plan(ck.anomaly)


def test_incremental_gold_refresh_equals_full(spark):
    import datetime as dt
    p = _pay(spark, SF001)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    silver = unique_shared_path(spark, "t_inc_silver")
    overwrite_table(p.where(F.col("event_ts") < cut), silver, "event_ts")
    gold = unique_shared_path(spark, "t_inc_gold")
    refresh_gold(spark, read_written(spark, silver, keep_partition=True), location=gold)
    # a release appends rows for the later days; refresh only those days
    later = p.where(F.col("event_ts") >= cut)
    append_table(later, silver, "event_ts")
    days = sorted({r.d for r in later.select(F.to_date("event_ts").alias("d")).distinct().collect()})
    kpi_t, an_t = refresh_gold(spark, read_written(spark, silver, keep_partition=True), location=gold, days=days)
    full_k, full_a = refresh_gold(spark, p)
    assert sorted(kpi_t.collect()) == sorted(full_k.collect())
    assert sorted(an_t.collect()) == sorted(full_a.collect())
    assert days[0] == dt.date(2024, 1, 20)


def test_gold_stream_incremental_batches_equal_batch(spark):
    import time
    from paylens.sources.fixtures import customer_regions
    from paylens.streaming.gold_stream import run_gold_stream
    base = unique_shared_path(spark, "t_gold_stream")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    # the given events table split in two files: one micro-batch each
    ev.where(F.col("ts") < cut).coalesce(1).write.parquet(f"{base}/in1")
    ev.where(F.col("ts") >= cut).coalesce(1).write.parquet(f"{base}/in2")
    import glob
    import os
    import shutil
    os.makedirs(f"{base}/events")
    for i in (1, 2):
        src = glob.glob(f"{base}/in{i}/part-*.parquet")[0]
        shutil.copy(src, f"{base}/events/events_{i}.parquet")
        time.sleep(1.1)  # distinct modification times keep the file order
    out = run_gold_stream(spark, f"{base}/events", "events_*.parquet", customer_regions(spark, SF001),
                          f"{base}/silver", f"{base}/gold", f"{base}/ck", max_files_per_trigger=1)
    batches = sorted(r.batch for r in spark.read.parquet(f"{base}/silver").select("batch").distinct().collect())
    assert batches == [0, 1]
    assert sorted(out.collect()) == sorted(QUERIES["anomaly"](spark, SF001).collect())


def test_bucketed_join_needs_no_exchange(spark):
    from paylens.sources.bucketed import silver_payments_bucketed
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the sort-merge path
    try:
        df = silver_payments_bucketed(spark, SF001, 4, salt=3)
        tree = _plan(df).split("\n\n")[0]
        assert "SortMergeJoin" in tree and "Exchange" not in tree.replace("BroadcastExchange", "")
        assert sorted(df.collect()) == sorted(_pay(spark, SF001).collect())
        for t in ("paylens_events_bucketed", "paylens_customer_bucketed"):
            assert len(spark.table(t).inputFiles()) <= 4  # one file per bucket, not one per task and bucket
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stream_drops_rows_behind_the_watermark(spark):
    """Rows older than the watermark are dropped once it has advanced.

    Spark filters late input with the watermark of the *previous* micro-batch
    (eviction uses the current one), so the late copy arrives in a third batch:
    1 = the whole table, 2 = the latest row again (it only touches a bucket
    that is still open), 3 = the first two days re-delivered late.
    """
    import datetime as dt
    import glob
    import os
    import shutil
    import time
    from paylens.sources.fixtures import customer_regions
    from paylens.streaming.kpi_stream import run_kpi_stream
    base = unique_shared_path(spark, "t_late")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.coalesce(1).write.parquet(f"{base}/in1")
    ev.orderBy(F.col("ts").desc()).limit(1).coalesce(1).write.parquet(f"{base}/in2")
    ev.where(F.col("ts") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{base}/in3")
    os.makedirs(f"{base}/events")
    for i in (1, 2, 3):
        shutil.copy(glob.glob(f"{base}/in{i}/part-*.parquet")[0], f"{base}/events/events_{i}.parquet")
        time.sleep(1.1)
    run_kpi_stream(spark, f"{base}/events", "events_*.parquet", customer_regions(spark, SF001),
                   f"{base}/out", f"{base}/ck", max_files_per_trigger=1)
    out = spark.read.parquet(f"{base}/out")
    mx = ev.agg(F.max("ts")).collect()[0][0]
    closed = kpi(_pay(spark, SF001)).where(
        F.col("bucket_5m") + F.expr("INTERVAL 5 MINUTES") <= F.lit(mx - dt.timedelta(minutes=10)))
    # every closed bucket emitted once, unchanged by the late copies
    assert sorted(out.collect()) == sorted(closed.collect())


# -- refresh on small and odd histories ---------------------------------------------

def test_refresh_gold_on_one_day_and_on_nothing(make_payments):
    one = make_payments([pay_row(1, "2024-01-01 10:00:00")])
    kpi_t, an_t = refresh_gold(one.sparkSession, one)
    assert (kpi_t.count(), an_t.count()) == (1, 0)
    kpi_t, an_t = refresh_gold(one.sparkSession, one.limit(0))
    assert (kpi_t.count(), an_t.count()) == (0, 0)
    assert an_t.columns == ["bucket_5m", "metric", "actual", "baseline", "z_score", "is_anomaly", "impact_estimated"]


def test_incremental_refresh_counts_payments_without_a_time(spark, make_payments):
    no_time = lambda i: (i, None, "u_1", 1.0, "USD", "Stripe", "success", None, "iOS", "1.2.7", "ASIA", "iPhone14")
    first = make_payments([no_time(1), pay_row(2, "2024-01-01 10:00:00")])
    both = first.unionByName(make_payments([no_time(3)]))
    gold = unique_shared_path(spark, "t_null_day")
    refresh_gold(spark, first, location=gold)
    days = make_payments([no_time(3)]).select(F.to_date("event_ts").alias("dt"))
    for arg in (days, [None]):
        kpi_t, _ = refresh_gold(spark, both, location=gold, days=arg)
        assert [r.pay_attempts for r in kpi_t.where("bucket_5m is null").collect()] == [2]
        assert kpi_t.count() == 2


def test_appended_rows_are_seen_by_the_next_read(spark):
    from paylens.sources.tables import read_table
    base = unique_shared_path(spark, "t_append_read")
    spark.range(5).write.parquet(f"{base}/events.parquet")
    assert read_table(spark, base, "events").count() == 5
    spark.range(5).write.mode("append").parquet(f"{base}/events.parquet")
    assert read_table(spark, base, "events").count() == 10


def test_named_tables_replace_and_append(spark, make_payments):
    from paylens.sources.sinks import append_named, replace_named
    a = make_payments([pay_row(1, "2024-01-01 10:00:00")])
    b = make_payments([pay_row(2, "2024-01-02 10:00:00")])
    replace_named(a, "t_named", "event_ts")
    append_named(b, "t_named", "event_ts")
    assert spark.sql("SELECT count(*) FROM t_named").first()[0] == 2
    replace_named(b.limit(0), "t_named", "event_ts")
    assert spark.sql("SELECT * FROM t_named").count() == 0
    spark.sql("DROP TABLE t_named")


def test_partial_cubes_do_not_depend_on_the_batches(spark):
    from paylens.streaming.kpi_stream import merged_kpi
    p = _pay(spark, SF001)
    parts = [partial_kpi(p.where(F.col("event_id") % 3 == i)) for i in range(3)]
    got = merged_kpi(parts[2].unionByName(parts[0]).unionByName(parts[1]))
    assert sorted(got.collect()) == sorted(kpi(p).collect())


# -- scans and joins ------------------------------------------------------------------

def _event_scans(plan: str) -> list[str]:
    return [b for b in re.findall(r"\(\d+\) Scan parquet.*?(?=\n\n|$)", plan, re.S) if "event_type" in b]


@pytest.mark.parametrize("key,full", [
    ("segment_vs_rest", 0), ("drill_version", 1), ("drill_region", 1), ("drill_provider", 1), ("drill_all", 1),
    ("top_errors", 1), ("user_impact", 1), ("root_cause_rank", 1)])
def test_only_the_series_reads_the_whole_history(spark, key, full):
    scans = _event_scans(_plan(QUERIES[key](spark, SF001)))
    bounded = [s for s in scans if "GreaterThanOrEqual(ts," in s and "LessThan(ts," in s]
    assert scans and len(scans) - len(bounded) <= full


def test_many_windows_on_a_hot_day(spark, make_payments):
    """Thousands of windows: no job while the plan is built, one row per payment and window."""
    import datetime as dt
    from paylens.operators.windows import restrict_to_windows
    rows = [pay_row(i, f"2024-01-01 10:{i % 60:02d}:00") for i in range(300)]
    wins = spark.range(3000).select(
        F.col("id").alias("incident_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 1400).cast("int"))).alias("window_start"))
    wins = wins.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 3 MINUTES"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = restrict_to_windows(make_payments(rows), wins, keep=["incident_id"], bounded=False)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs
    got = df.groupBy("incident_id").count().collect()
    starts = {r.incident_id: r.window_start for r in wins.collect()}
    length = dt.timedelta(minutes=3)
    want = {i: n for i, s in starts.items() if (n := sum(s <= x[1] <= s + length for x in rows))}
    assert {r.incident_id: r["count"] for r in got} == want


def test_daily_users_come_from_game_events(make_payments):
    """Users who only log in are active too."""
    import datetime as dt
    days = [pay_row(i, f"2024-01-{d:02d} 10:00:00") for i, d in enumerate(range(1, 6), 1)]
    p = make_payments(days)
    logins = p.sparkSession.createDataFrame(
        [(dt.datetime(2024, 1, 5, 9, 0), f"u_{i}") for i in range(10)], "event_ts timestamp_ntz, user_id string")
    ia = IncidentAnalysis(p, dt.date(2024, 1, 5), game_events=logins)
    assert ia.user_impact().first().total_dau == 10
    assert IncidentAnalysis(p, dt.date(2024, 1, 5)).user_impact().first().total_dau == 1


def test_answers_keep_their_whole_text(spark):
    from paylens.operators import evidence as E
    long = "word " * 300
    df = spark.createDataFrame([(1, long), (2, 'x {"insights": ["a"], "detected_platform": "iOS"} y'), (3, '{"insights": [a}')],
                               "id int, text string")
    got = {r.id: r for r in E.parse_answer(df, "text", {f: F.lit("unknown") for f in E.ANSWER_FIELDS}, keep=["id"]).collect()}
    assert got[1].insights == [long] and got[1].source == "fallback"
    assert got[2].insights == ["a"] and got[2].detected_platform == "iOS" and got[2].parse_ok
    assert not got[3].parse_ok and got[3].insights is None
