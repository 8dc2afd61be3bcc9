"""The incident analysis of one day, as lazily composed DataFrames.

``IncidentAnalysis(payments, as_of)`` wires the operators the way the
reference's notebooks and app chain their SQL statements — KPI cube →
anomaly table → window of the day → drill-downs, impact, root cause, evidence
— but without driver round trips: the window is a DataFrame joined into each
consumer, not a string spliced into SQL text.  Nothing runs until a consumer
DataFrame is acted upon; each consumer is one Spark job whose plan reuses
shared exchanges (e.g. the KPI aggregation feeding both the window and the
drill-down is shuffled once).

For many outputs over the same day, materialise the gold tables first
(:func:`paylens.plans.gold.refresh_gold`) and build the analysis on the
tables read back — that cuts lineage and is what the reference does too.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens import config as C
from paylens.operators import seasonal as A
from paylens.operators import drill as D
from paylens.operators import evidence as E
from paylens.operators import impact as I
from paylens.operators import rootcause as R
from paylens.functions.expr import ntz
from paylens.operators.islands import GAP, island_bounds, islands
from paylens.operators.lattice import COUNTS, lattice_causes, leaf_counts
from paylens.operators.cube import BUCKET, kpi, overall, overall_from_payments
from paylens.operators.windows import WIN_END, WIN_START, restrict_to_windows, window_table
from paylens.session import unique_shared_path
from paylens.sources.fixtures import game_events_from_payments


class IncidentAnalysis:
    def __init__(self, payments: DataFrame, as_of: _dt.date = C.AS_OF, minutes: int = C.BUCKET_MINUTES,
                 game_events: DataFrame | None = None, kpi_df: DataFrame | None = None,
                 anomaly_df: DataFrame | None = None, baseline_form: str = "window",
                 baseline_mode: str = "other_days", series_from_cube: bool = False, separate: bool = False,
                 gap: int = GAP):
        """``series_from_cube``: roll the overall series up from the KPI cube
        (share one scan and aggregation with cube-based outputs such as the
        drill-downs) instead of aggregating payments straight to buckets (one
        shuffle fewer for payment-only outputs).  Same values either way while
        amounts have two decimals.

        ``separate``: the day's window is every island of flagged buckets (see
        :mod:`paylens.operators.islands`) instead of the range from first to last,
        so what lies between two incidents is left out of all drill-downs."""
        self.separate = separate
        self.gap = gap
        self.series_from_cube = series_from_cube
        self.payments = payments
        self.as_of = as_of
        self.minutes = minutes
        self._game_events = game_events
        self._kpi = kpi_df
        self._anomaly = anomaly_df
        self.baseline_form = baseline_form
        self.baseline_mode = baseline_mode

    # -- gold ---------------------------------------------------------------------
    @cached_property
    def kpi(self) -> DataFrame:
        return self._kpi if self._kpi is not None else kpi(self.payments, self.minutes)

    @cached_property
    def overall(self) -> DataFrame:
        # From a materialised cube: roll it up.  From raw payments: one
        # aggregation straight to buckets (same values, one shuffle fewer for
        # outputs that never touch the segment cube).
        if self._kpi is not None:
            return overall(self._kpi.drop("dt") if "dt" in self._kpi.columns else self._kpi)
        if self.series_from_cube:
            return overall(self.kpi)
        return overall_from_payments(self.payments, self.minutes)

    @cached_property
    def baselines(self) -> DataFrame:
        form = A.baselines_window if self.baseline_form == "window" else A.baselines
        return form(self.overall, self.baseline_mode, self.minutes)

    @cached_property
    def anomaly(self) -> DataFrame:
        return self._anomaly if self._anomaly is not None else A.anomaly(self.baselines)

    @cached_property
    def game_events(self) -> DataFrame:
        return self._game_events if self._game_events is not None else game_events_from_payments(self.payments)

    def checkpointed(self) -> "IncidentAnalysis":
        """The same analysis over reliably checkpointed gold frames.

        ``checkpoint()`` writes the KPI cube and the anomaly table to the
        cluster-shared checkpoint folder (``spark.checkpoint.dir``) and cuts
        their lineage: every later output reads the files, and a lost
        executor never re-scans the payments.
        """
        from paylens.session import shared_dir

        shared_dir(self.payments.sparkSession)
        kpi_c = self.kpi.checkpoint(eager=True)
        form = A.baselines_window if self.baseline_form == "window" else A.baselines
        anomaly_c = A.anomaly(form(overall(kpi_c), self.baseline_mode, self.minutes)).checkpoint(eager=True)
        return IncidentAnalysis(self.payments, self.as_of, self.minutes, self._game_events, kpi_c, anomaly_c,
                                self.baseline_form, self.baseline_mode, True, self.separate, self.gap)

    # -- the day's window -------------------------------------------------------------
    @cached_property
    def windows_by_metric(self) -> DataFrame:
        return A.anomaly_windows(self.anomaly, self.as_of)

    @cached_property
    def islands(self) -> DataFrame:
        return islands(self.anomaly, self.gap, self.minutes, self.as_of)

    @cached_property
    def bounds(self) -> DataFrame:
        if self.separate:
            return island_bounds(self.islands)
        return A.anomaly_bounds(self.anomaly, self.as_of)

    @cached_property
    def window(self) -> DataFrame:
        return window_table(self.bounds)

    def _day(self, shift: int = 0) -> tuple[_dt.date, _dt.date]:
        d = self.as_of - _dt.timedelta(days=shift)
        return (d, d)

    @cached_property
    def kpi_of_day(self) -> DataFrame:
        """The cube of the day alone: a day's buckets need only that day's payments."""
        if self._kpi is not None:
            return self._kpi.where(A.on_day(self.as_of, self._kpi))
        lo, hi = ntz(self.as_of), ntz(self.as_of + _dt.timedelta(days=1))
        day = self.payments.where((F.col("event_ts") >= lo) & (F.col("event_ts") < hi))
        if "dt" in day.columns:
            day = day.where(F.col("dt") == F.lit(self.as_of))
        return kpi(day, self.minutes)

    @cached_property
    def kpi_in_window(self) -> DataFrame:
        return restrict_to_windows(self.kpi_of_day, self.window, ts_col=BUCKET, day_range=self._day()).drop(WIN_START, WIN_END)

    @cached_property
    def payments_in_window(self) -> DataFrame:
        return restrict_to_windows(self.payments, self.window, day_range=self._day()).drop(WIN_START, WIN_END)

    @cached_property
    def payments_prev_day(self) -> DataFrame:
        prev = window_table(self.bounds, shift_days=1)
        return restrict_to_windows(self.payments, prev, day_range=self._day(1)).drop(WIN_START, WIN_END)

    @cached_property
    def tagged_payments(self) -> DataFrame:
        """Payments in the window (``tag='now'``) and in the same window one day
        earlier (``tag='prev'``) — one scan, two windows."""
        s, e, day = F.col(WIN_START), F.col(WIN_END), F.make_dt_interval(F.lit(1))
        both = self.window.select(F.inline(F.array(*[  # both windows from one row: the history is read once
            F.struct(F.lit(tag).alias("tag"), a.alias(WIN_START), b.alias(WIN_END))
            for tag, a, b in (("now", s, e), ("prev", s - day, e - day))])))
        lo = self.as_of - _dt.timedelta(days=1)
        return restrict_to_windows(self.payments, both, keep=["tag"],
                                   day_range=(lo, self.as_of)).drop(WIN_START, WIN_END)

    # -- outputs ----------------------------------------------------------------------
    def drill_version(self) -> DataFrame:
        return D.drill_version(self.kpi_in_window)

    def drill_region(self) -> DataFrame:
        return D.drill_region(self.kpi_in_window)

    def drill_provider(self) -> DataFrame:
        return D.drill_provider(self.kpi_in_window)

    def drill_all(self) -> DataFrame:
        return D.drill_all(self.kpi_in_window)

    def top_errors(self) -> DataFrame:
        return D.top_errors(self.payments_in_window)

    def top_errors_prev_day(self) -> DataFrame:
        return D.top_errors(self.payments_prev_day)

    def error_delta(self) -> DataFrame:
        return D.error_delta(self.tagged_payments)

    def segment_vs_rest(self, segment=None) -> DataFrame:
        return D.segment_vs_rest(self.kpi_of_day, segment or C.FOCUS_SEGMENT, self.as_of)

    def error_distribution(self, segment=None) -> DataFrame:
        return D.error_distribution(self.payments_in_window, segment or C.ERROR_SEGMENT)

    def segment_fail_rate(self, k: int | None = C.TOPK_SEGMENTS_ALERT, min_attempts: int = 1) -> DataFrame:
        return D.segment_fail_rate(self.payments_in_window, k, min_attempts)

    def errors_by_provider(self) -> DataFrame:
        return D.errors_by_provider(self.payments_in_window)

    def error_drill_users(self) -> DataFrame:
        return D.error_drill_users(self.payments_in_window)

    def sample_failures(self, segment=None, keep_id: bool = False) -> DataFrame:
        return D.sample_failures(self.payments_in_window, segment or C.ERROR_SEGMENT, keep_id=keep_id)

    def top_error_codes(self) -> DataFrame:
        return D.top_error_codes(self.payments_in_window)

    def user_impact(self) -> DataFrame:
        return I.user_impact(self.payments_in_window, self.game_events, self.as_of)

    def impact_summary(self) -> DataFrame:
        return I.impact_summary(self.windows_by_metric, self.user_impact(), self.minutes)

    def root_cause_rank(self, k: int = 3) -> DataFrame:
        return R.root_cause_rank(self.tagged_payments, k)

    def lattice_causes(self, k: int = 3) -> DataFrame:
        """Disjoint root causes at any level of the segment lattice.

        The leaf table (a row per segment and error code that occurs) is written once
        and read by every round.
        """
        path = unique_shared_path(self.payments.sparkSession, "lattice-leaves") + "/leaves"
        found = leaf_counts(self.tagged_payments, extra=["error_code"])
        found.write.parquet(path)
        codes = self.payments.sparkSession.read.schema(found.schema).parquet(path)
        leaves = codes.groupBy(*C.DIMS).agg(*[F.sum(c).alias(c) for c in COUNTS])
        return lattice_causes(leaves, codes, k)

    def evidence_sections(self):
        """The five evidence tables, built from two shared aggregations.

        The three drill levels come from ONE grouping-sets pass over the
        window's cube rows, and the now / previous-day error tables from ONE
        conditional aggregate over a single scan tagged by window — five
        sections, two shuffles of input data.
        """
        neg = lambda c: -F.col(c)  # noqa: E731  DESC on a numeric key
        asc = lambda *cs: [F.col(c) for c in cs]
        ek = ("platform", "app_version", "region", "provider", "error_code")
        levels = D.drill_all(self.kpi_in_window)
        lvl = lambda n: levels.where(F.col("drill_level") == n)
        version = D.order_top(
            lvl(2).select("platform", "app_version", "attempts", "success", "fails", "success_rate", "revenue"),
            F.col("success_rate").asc_nulls_last(), ["platform", "app_version"], None)
        region = D.order_top(
            lvl(3).select("platform", "app_version", "region", "attempts", "success", "fails", "success_rate"),
            F.col("success_rate").asc_nulls_last(), ["platform", "app_version", "region"], C.TOPK_REGION)
        provider = D.order_top(
            lvl(4).select("platform", "app_version", "region", "provider", "attempts", "fails", "fail_rate"),
            F.col("fail_rate").desc_nulls_last(), list(ek[:4]), C.TOPK_PROVIDER)
        counts = D.error_counts_now_vs_prev(self.tagged_payments)
        now = D.order_top(counts.where(F.col("error_count") > 0).select(*ek, "error_count"),
                          F.col("error_count").desc(), list(ek), C.TOPK_ERRORS)
        prev = D.order_top(counts.where(F.col("prev_error_count") > 0)
                           .select(*ek, F.col("prev_error_count").alias("error_count")),
                           F.col("error_count").desc(), list(ek), C.TOPK_ERRORS)
        return [
            (E.SECTION_TITLES[0], version, [F.col("success_rate"), *asc("platform", "app_version")],
             {"success_rate": 4, "revenue": 2}),
            (E.SECTION_TITLES[1], region, [F.col("success_rate"), *asc("platform", "app_version", "region")],
             {"success_rate": 4}),
            (E.SECTION_TITLES[2], provider,
             [neg("fail_rate"), *asc("platform", "app_version", "region", "provider")], {"fail_rate": 4}),
            (E.SECTION_TITLES[3], now, [neg("error_count"), *asc(*ek)], {}),
            (E.SECTION_TITLES[4], prev, [neg("error_count"), *asc(*ek)], {}),
        ]

    def evidence_text(self) -> DataFrame:
        return E.evidence_text(self.evidence_sections())

    def evidence_bundle(self) -> DataFrame:
        return E.evidence_bundle(self.evidence_text())

    def evidence_lines(self) -> DataFrame:
        return (
            E.drill_lines(self.error_drill_users())
            .unionByName(E.log_lines(self.sample_failures(keep_id=True)))
            .unionByName(E.app_segment_lines(self.segment_fail_rate(k=C.TOPK_APP)))
            .unionByName(E.app_error_lines(self.top_error_codes()))
        )

    def drilldown_payload(self) -> DataFrame:
        lines = E.drill_lines(self.error_drill_users()).unionByName(E.log_lines(self.sample_failures(keep_id=True)))
        return E.drilldown_payload(lines, self.window)

    def anomaly_alert_payload(self) -> DataFrame:
        return E.anomaly_alert_payload(self.impact_summary(), self.minutes)

    def root_cause_card(self) -> DataFrame:
        return E.root_cause_card(self.root_cause_rank(), self.window)

    def report_card(self) -> DataFrame:
        return E.report_card(self.evidence_bundle(), self.as_of)

    def answer_fallback(self) -> dict:
        """Top-1 segment and error code of the window as scalar subqueries."""
        seg = self.segment_fail_rate(k=1)
        err = self.top_error_codes()
        fb = {
            "detected_platform": seg.select("platform"),
            "detected_version": seg.select("app_version"),
            "detected_region": seg.select("region"),
            "detected_provider": seg.select("provider"),
            "detected_error": err.limit(1).select("error_code"),
        }
        return {k: F.coalesce(v.scalar(), F.lit(R.UNKNOWN)) for k, v in fb.items()}


def incident_attribution(payments: DataFrame, incidents_df: DataFrame) -> DataFrame:
    """Attribution for every incident of the ground-truth log in one job.

    The log is caller-supplied, so the join with its windows is left to the
    planner's size check.
    """
    w = window_table(incidents_df, start="incident_start", end="incident_end", keep=["incident_id"])
    inside = restrict_to_windows(payments, w, keep=["incident_id"], bounded=False).drop(WIN_START, WIN_END)
    return R.attribution(incidents_df, inside)
