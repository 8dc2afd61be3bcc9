"""Root-cause attribution, ranking and scoring against ground truth.

The reference handles one incident at a time (the latest of an in-process
list) with two ``LIMIT 1`` queries.  Here all incidents are evaluated in one
job: payments are joined to the incident windows (day-keyed broadcast join,
see :mod:`paylens.operators.windows`), aggregated per incident and segment,
and the top-1 per incident is picked with ``row_number`` over a window
partitioned by incident — over *aggregated* groups, whose count is bounded
by the dimension cardinality, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.config import DIMS, PASS_ACCURACY
from paylens.functions.expr import is_fail, ratio, round_half_up
from paylens.operators.drill import ERROR_KEYS, error_counts_now_vs_prev
from paylens.operators.topk import number_rows

UNKNOWN = "unknown"
RANK_PARTS = 64  # parts that the ranking deals the segment groups to

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Scored fields: (label, ground-truth column, detected column).
SCORED_FIELDS = [
    ("Platform", "platform", "detected_platform"),
    ("App Version", "app_version", "detected_version"),
    ("Region", "region", "detected_region"),
    ("Provider", "provider", "detected_provider"),
    ("Error Code", "error_code", "detected_error"),
]
# Root-cause label template.
LABEL_FORMAT = "%s %s + %s + %s: %s spike"
# ---------------------------------------------------------------------------

DETECTED = [d for _, _, d in SCORED_FIELDS]


def root_cause_label(platform: Column, version: Column, region: Column, provider: Column, error: Column) -> Column:
    return F.format_string(LABEL_FORMAT, platform, version, region, provider, error)


def attribution(incidents_df: DataFrame, payments_in_incidents: DataFrame) -> DataFrame:
    """Per incident: the segment with the highest fail rate and the most
    frequent error code inside its window; ``'unknown'`` when the window is
    empty.  ``payments_in_incidents`` carries ``incident_id``.

    One scan, one aggregation: GROUPING SETS ((incident, segment dims),
    (incident, error_code)) computes both candidate lists; one window
    partitioned by (incident, set) keeps the top row of each (planned as a
    per-partition group limit before the shuffle); one fold per incident
    puts the two winners side by side.  Ties: segment dims / error code
    ascending.
    """
    p, v, r, pr = DIMS
    g = payments_in_incidents.groupingSets(
        [["incident_id", p, v, r, pr], ["incident_id", "error_code"]],
        "incident_id", p, v, r, pr, "error_code",
    ).agg(
        F.grouping(p).alias("_by_code"),  # 1 on the (incident, error_code) set
        F.count_if(is_fail()).alias("fails"),
        F.count(F.lit(1)).alias("attempts"),
    )
    by_code = F.col("_by_code") == 1
    # the error-code list only counts failing rows (WHERE status = 'fail')
    g = g.where(~by_code | (F.col("fails") > 0))
    score = F.when(by_code, F.col("fails").cast("double")).otherwise(
        round_half_up(ratio("fails", "attempts"), 4))
    w = Window.partitionBy("incident_id", "_by_code").orderBy(
        score.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in (p, v, r, pr, "error_code")])
    top = g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    seg = ~by_code
    winners = top.groupBy("incident_id").agg(
        *[F.max(F.when(seg, F.col(d))).alias(n) for d, n in zip(DIMS, DETECTED[:4])],
        F.max(F.when(by_code, F.col("error_code"))).alias("detected_error"),
    )
    j = incidents_df.select("incident_id").join(winners, "incident_id", "left")
    return j.select("incident_id", *[F.coalesce(F.col(d), F.lit(UNKNOWN)).alias(d) for d in DETECTED])


def scorecard_fields(incidents_df: DataFrame, attribution_df: DataFrame) -> DataFrame:
    """One row per incident × scored field (case-insensitive match)."""
    j = incidents_df.join(attribution_df, "incident_id", "left")
    rows = F.array(*[
        F.struct(
            F.lit(label).alias("field"),
            F.col(gt).alias("ground_truth"),
            F.coalesce(F.col(det), F.lit(UNKNOWN)).alias("ai_detected"),
        )
        for label, gt, det in SCORED_FIELDS
    ])
    u = j.select("incident_id", F.inline(rows))
    return u.withColumn("match", F.coalesce(F.lower("ground_truth") == F.lower("ai_detected"), F.lit(False)))


def incident_scorecard(incidents_df: DataFrame, attribution_df: DataFrame) -> DataFrame:
    """Per incident: matches out of five fields, accuracy %, pass flag.

    One join of the incident log with its attribution and a projection — the
    five case-insensitive comparisons are summed inline.
    """
    j = incidents_df.join(attribution_df, "incident_id", "left")
    hits = [
        F.coalesce(F.lower(F.col(gt)) == F.lower(F.coalesce(F.col(det), F.lit(UNKNOWN))), F.lit(False)).cast("bigint")
        for _, gt, det in SCORED_FIELDS
    ]
    matches = sum(hits[1:], hits[0])
    total = F.lit(len(SCORED_FIELDS)).cast("bigint")
    acc = F.round(matches * F.lit(100.0) / total).cast("int")
    return j.select(
        "incident_id",
        root_cause_label(*[F.col(c) for c in ("platform", "app_version", "region", "provider", "error_code")]).alias("root_cause"),
        root_cause_label(*[F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in DETECTED]).alias("detected_root_cause"),
        matches.alias("matches"), total.alias("total_fields"),
        acc.alias("accuracy"),
        (acc >= PASS_ACCURACY).alias("passed"),
    )


def attribution_labels(attribution_df: DataFrame) -> DataFrame:
    """The detected root cause of each incident as the release-log label."""
    return attribution_df.select("incident_id", root_cause_label(*[F.col(c) for c in DETECTED]).alias("root_cause"))


def root_cause_rank(tagged_failures: DataFrame, k: int = 3) -> DataFrame:
    """Deterministic ranked root causes: segment × error code with the largest
    excess of failures in the window over the same window a day earlier.

    ``excess_share`` is the cause's part of all positive excess; confidence is High from one half, Medium from
    one fifth of it.
    """
    g = error_counts_now_vs_prev(tagged_failures).withColumn(
        "excess", F.col("error_count") - F.col("prev_error_count")).where(F.col("excess") > 0)
    # top k and sum of each part of the groups, then of the parts' at most RANK_PARTS * k rows: one read, no task with all groups
    order = [F.col("excess").desc(), F.col("error_count").desc(), *[F.col(c).asc_nulls_last() for c in ERROR_KEYS]]
    part = Window.partitionBy("_part")
    best = g.withColumn("_part", F.pmod(F.xxhash64(*ERROR_KEYS), F.lit(RANK_PARTS))).select(
        "*", F.row_number().over(part.orderBy(*order)).alias("_rn"), F.sum("excess").over(part).alias("_sum")).where(F.col("_rn") <= k)
    best = best.withColumn("_total", F.sum(F.when(F.col("_rn") == 1, F.col("_sum"))).over(Window.partitionBy()))
    top = best.orderBy(*order).limit(k)
    share = round_half_up(ratio("excess", "_total"), 4)
    ranked = top.select(
        *ERROR_KEYS, "error_count", "prev_error_count", "excess", share.alias("excess_share"),
    )
    ranked = number_rows(ranked, [-F.col("excess"), -F.col("error_count"), *[F.col(c) for c in ERROR_KEYS]])
    confidence = F.when(F.col("excess_share") >= 0.5, "High").when(F.col("excess_share") >= 0.2, "Medium").otherwise("Low")
    return ranked.select(
        "*", confidence.alias("confidence"),
        root_cause_label(*[F.col(c) for c in ERROR_KEYS]).alias("label"),
    )
