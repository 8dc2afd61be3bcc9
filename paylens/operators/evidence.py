"""Evidence text, template lines, alert payloads and model-answer parsing.

The reference renders small result sets to text on the driver (pandas
``to_csv``, f-strings, ``json.dumps``).  Here the text is built by column
expressions and ordered string aggregation, so it is produced where the data
is.  Every text aggregate runs over an already top-k-limited or
dimension-bounded result (≤ 15 rows per section), never over raw events.

Numbers are printed with fixed decimals (rates ``%.4f``, money ``%.2f``) so
the text is the same in every engine; the reference's Python float repr is
not reproduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.config import BUCKET_MINUTES
from paylens.operators.topk import number_rows

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Evidence section titles, in prompt order.
SECTION_TITLES = [
    "Drill-down by Platform + App Version",
    "Drill-down by Platform + Version + Region",
    "Drill-down by Provider (fail rate)",
    "Top Error Codes During Anomaly Window",
    "Baseline Error Codes (Same Window Yesterday)",
]
EVIDENCE_SEP = "|"
# Alert-card line templates.
DRILL_LINE = "• **%s %s | %s | %s** → %s: %d errors, %d users"
LOG_LINE = "`%s` | %s | %s | %s | $%s"
APP_SEGMENT_LINE = "  %s %s | %s | %s: fail_rate=%s, fails=%d/%d"
APP_ERROR_LINE = "  %s: %d errors"
ANOMALY_CARD_TEMPLATE = "red"
ACCURACY_CARD_TITLE = "📊 Accuracy Report: %d%%"
INSIGHT_LINE = "• Root Cause #%d: %s"
DRILL_CARD_TITLE = "🔬 Root Cause Drill-Down"
DRILL_CARD_TEMPLATE = "yellow"
DRILL_CARD_SEGMENTS = "**Top Error Segments During Incident**\n"
DRILL_CARD_LOGS = "**Sample Error Logs (%s)**\n"
DRILL_CARD_NOTE = "Showing top 5 segments | Window: %s → %s"
RELEASE_CARD_TITLE = "🚀 New Version Released: %s"
RELEASE_CARD_TEXT = "**Platform**: %s\n**Region**: %s\n**Incident**: %s → %s\n**Status**: 🔴 Anomaly Detected"
HOUR_MINUTE = "HH:mm"
MATCH_MARK, MISS_MARK = "✅", "❌"
ALERT_CARD_METRIC = "Payment Success Rate"
ALERT_CARD_WINDOW = "**Anomaly Window**: %s → %s\n**Metric**: %s\n**Avg Z-Score**: %s\n**Estimated Revenue Loss**: $%s"
ALERT_CARD_IMPACT = ("**Impact Summary**\n• Affected Users: %s (%s%% of DAU)\n"
                     "• Anomaly Buckets: %s (x%dmin intervals)\n• Status: 🔴 Active")
ALERT_CARD_BUTTONS = (("🔍 Run RCA Agent", "primary", "run_rca"), ("📊 View Dashboard", "default", "view_dashboard"))
ROOT_CAUSE_CARD_TEMPLATE = "orange"
ROOT_CAUSE_CARD_TEXT = "**Anomaly**: %s → %s\n\n%s"
ROOT_CAUSE_CARD_BUTTONS = (("🔬 Deep Dive", "primary", "drill_down"), ("📝 Generate Report", "default", "gen_report"))
INSIGHT_CARD_TITLE = "🤖 AI Agent: Root Cause Analysis"
REPORT_CARD_TITLE = "📋 Incident Report — Auto-Generated"
REPORT_CARD_TEMPLATE = "green"
REPORT_CARD_STATUS = "**Status**: ✅ Resolved\n**Generated at**: %s"
REPORT_CARD_BUTTONS = (("📤 Export to Confluence", "primary", "export_confluence"), ("🔄 Regenerate", "default", "regenerate"))
# Card markup tags of the chat-card format.
CARD_TEXT_TAG = "lark_md"
# ---------------------------------------------------------------------------

# Titles of our own: the reference's hold a product name.
ANOMALY_CARD_TITLE = "🚨 Alert: Payment Anomaly Detected"
ROOT_CAUSE_CARD_TITLE = "🤖 Root Cause Analysis"
CAUSE_LINE = "%d. %s (%d more failures than the day before, share %.4f, confidence %s)"

TS_TEXT = "yyyy-MM-dd HH:mm:ss"


def _fmt(df: DataFrame, name: str, digits: dict[str, int]) -> Column:
    """Column as text; NULL → empty field (as a CSV writer does)."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        # format_string renders NULL as the text "null"; keep NULL instead
        s = F.when(c.isNotNull(), F.format_string(f"%.{digits.get(name, 4)}f", c))
    elif isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        s = F.date_format(c, TS_TEXT)
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit(""))


def quoted(field: Column, sep: str = EVIDENCE_SEP) -> Column:
    """A field as CSV writers write it: in quotes, inner quotes doubled, if it holds the separator, a quote or a line break."""
    special = field.contains(sep) | field.contains('"') | field.contains("\n") | field.contains("\r")
    return F.when(special, F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def table_text(df: DataFrame, order: Sequence[Column], digits: dict[str, int] | None = None) -> DataFrame:
    """One row ``(n_rows, text)``: header line plus one ``|``-separated line per
    row, rows in ``order`` (ascending keys; negate a numeric key for DESC).  Fields are
    quoted where needed (:func:`quoted`), so a CSV reader gives the table back."""
    digits = digits or {}
    cols = df.columns
    line = F.concat_ws(EVIDENCE_SEP, *[quoted(_fmt(df, c, digits)) for c in cols])
    keyed = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)], line.alias("line")).alias("e"))
    agg = keyed.agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list("e")).alias("es"))
    header = F.array(F.concat_ws(EVIDENCE_SEP, *[quoted(F.lit(c)) for c in cols]))
    lines = F.transform(F.col("es"), lambda e: e["line"])
    return agg.select("n_rows", F.array_join(F.concat(header, lines), "\n").alias("text"))


def evidence_text(sections: Sequence[tuple[str, DataFrame, Sequence[Column], dict[str, int]]]) -> DataFrame:
    """The evidence bundle: one row per labelled table ``(section, title, n_rows, text)``."""
    out = None
    for i, (title, df, order, digits) in enumerate(sections, start=1):
        t = table_text(df, order, digits).select(
            F.lit(i).alias("section"), F.lit(title).alias("title"), "n_rows", "text")
        out = t if out is None else out.unionByName(t)
    return out


def evidence_bundle(evidence: DataFrame) -> DataFrame:
    """All sections as one prompt-ready text (sections in order)."""
    block = F.concat(F.lit("## Evidence: "), F.col("title"), F.lit("\n"), F.col("text"))
    agg = evidence.agg(F.array_sort(F.collect_list(F.struct("section", block.alias("b")))).alias("bs"),
                       F.sum("n_rows").alias("n_rows"))
    return agg.select("n_rows", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("evidence"))


# -- template lines ---------------------------------------------------------------

def drill_lines(error_drill: DataFrame) -> DataFrame:
    line = F.format_string(DRILL_LINE, "platform", "app_version", "region", "provider", "error_code",
                           "error_count", "affected_users")
    order = [-F.col("error_count"), *[F.col(c) for c in ("platform", "app_version", "region", "provider", "error_code")]]
    return _numbered(error_drill, "segment_error", line, order)


def log_lines(samples: DataFrame) -> DataFrame:
    line = F.format_string(LOG_LINE, F.date_format("event_ts", TS_TEXT), "user_id", "provider", "error_code",
                           F.format_string("%.2f", "amount"))
    return _numbered(samples, "sample_log", line, [F.col("event_ts"), F.col("event_id")])


def app_segment_lines(segments: DataFrame) -> DataFrame:
    line = F.format_string(APP_SEGMENT_LINE, "platform", "app_version", "region", "provider",
                           F.format_string("%.4f", "fail_rate"), "fails", "attempts")
    order = [-F.col("fail_rate"), *[F.col(c) for c in ("platform", "app_version", "region", "provider")]]
    return _numbered(segments, "app_segment", line, order)


def app_error_lines(errors: DataFrame) -> DataFrame:
    line = F.format_string(APP_ERROR_LINE, "error_code", "cnt")
    return _numbered(errors, "app_error", line, [-F.col("cnt"), F.col("error_code")])


def _numbered(df: DataFrame, kind: str, line: Column, order: Sequence[Column]) -> DataFrame:
    # df is a top-k result (≤ 10 rows)
    lines = df.select(*[k.alias(f"_o{i}") for i, k in enumerate(order)], line.alias("line"))
    n = number_rows(lines, [F.col(f"_o{i}") for i in range(len(order))], "line_no")
    return n.select(F.lit(kind).alias("kind"), "line_no", "line")


# -- alert payloads -------------------------------------------------------------

_TEXT = T.StructType([T.StructField("tag", T.StringType()), T.StructField("content", T.StringType())])


_BUTTON = T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("text", _TEXT), T.StructField("type", T.StringType()),
    T.StructField("value", T.StructType([T.StructField("action", T.StringType())]))])


def _element(tag: str, text: Column | None = None, elements: Column | None = None,
             actions: Column | None = None) -> Column:
    # Every card element has the same struct type; fields a tag does not use
    # are NULL and to_json omits them.
    return F.struct(
        F.lit(tag).alias("tag"),
        (text if text is not None else F.lit(None)).cast(_TEXT).alias("text"),
        (elements if elements is not None else F.lit(None)).cast(T.ArrayType(_TEXT)).alias("elements"),
        (actions if actions is not None else F.lit(None)).cast(T.ArrayType(_BUTTON)).alias("actions"),
    )


def _div(content: Column) -> Column:
    return _element("div", F.struct(F.lit(CARD_TEXT_TAG).alias("tag"), content.alias("content")))


def _hr() -> Column:
    return _element("hr")


def _note(text: Column) -> Column:
    return _element("note", elements=F.array(F.struct(F.lit("plain_text").alias("tag"), text.alias("content"))))


def _actions(buttons: Sequence[tuple[str, str, str]]) -> Column:
    return _element("action", actions=F.array(*[
        F.struct(F.lit("button").alias("tag"),
                 F.struct(F.lit("plain_text").alias("tag"), F.lit(text).alias("content")).alias("text"),
                 F.lit(kind).alias("type"), F.struct(F.lit(action).alias("action")).alias("value"))
        for text, kind, action in buttons]))


def _card(title: Column, template: Column, elements: Sequence[Column]) -> Column:
    card = F.struct(
        F.struct(F.lit(True).alias("wide_screen_mode")).alias("config"),
        F.struct(F.struct(title.alias("content"), F.lit("plain_text").alias("tag")).alias("title"),
                 template.alias("template")).alias("header"),
        F.array(*elements).alias("elements"),
    )
    return F.to_json(F.struct(F.lit("interactive").alias("msg_type"), card.alias("card")))


def anomaly_alert_payload(impact: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """The anomaly alert card from :func:`paylens.operators.impact.impact_summary`.

    Emitted only when the day has a rate anomaly (the reference fails
    otherwise).  A missing revenue row turns the first block into ``N/A``,
    as the reference's conditional does.
    """
    s = F.col("anomaly_start").cast("string")
    e = F.col("anomaly_end").cast("string")
    first = F.when(
        F.col("revenue_loss_usd").isNotNull(),
        F.format_string(ALERT_CARD_WINDOW, s, e, F.lit(ALERT_CARD_METRIC), F.col("avg_z_score").cast("string"),
                        F.format_number("revenue_loss_usd", 2)),
    ).otherwise(F.lit("N/A"))
    second = F.format_string(
        ALERT_CARD_IMPACT, F.format_number("affected_users", 0), F.col("dau_pct").cast("string"),
        F.col("anomaly_buckets").cast("string"), F.lit(int(minutes)))
    payload = _card(F.lit(ANOMALY_CARD_TITLE), F.lit(ANOMALY_CARD_TEMPLATE),
                    [_div(first), _hr(), _div(second), _hr(), _actions(ALERT_CARD_BUTTONS)])
    return impact.where(F.col("anomaly_start").isNotNull()).select(
        F.lit("anomaly_alert").alias("kind"), F.lit(None).cast("int").alias("incident_id"), payload.alias("payload"))


def _lines_text(kind: str) -> Column:
    # ordered join of one kind's numbered lines (≤ 5 rows per kind)
    picked = F.filter(F.col("ls"), lambda x: x["kind"] == kind)
    return F.array_join(F.transform(F.array_sort(picked), lambda x: x["line"]), "\n")


def drilldown_payload(lines: DataFrame, window: DataFrame, log_segment: str = "iOS 1.2.7") -> DataFrame:
    """The drill-down card: top error segments and sample logs of the window.

    ``lines`` are :func:`drill_lines` / :func:`log_lines` rows; the window is
    one row (``window_start``, ``window_end``).  Everything is folded by one
    global aggregate over the ≤ 10 line rows and the window row (a union, no
    join); an empty window gives no card.
    """
    ls = lines.where(F.col("kind").isin("segment_error", "sample_log")).select(
        F.struct(F.col("kind"), F.col("line_no"), F.col("line")).alias("l"),
        F.lit(None).cast("timestamp_ntz").alias("s"), F.lit(None).cast("timestamp_ntz").alias("e"))
    w = window.select(F.lit(None).cast(ls.schema["l"].dataType).alias("l"),
                      F.col("window_start").alias("s"), F.col("window_end").alias("e"))
    g = ls.unionByName(w).agg(F.collect_list("l").alias("ls"), F.max("s").alias("s"), F.max("e").alias("e"))
    seg = F.concat(F.lit(DRILL_CARD_SEGMENTS), _lines_text("segment_error"))
    logs = F.concat(F.format_string(DRILL_CARD_LOGS, F.lit(log_segment)), _lines_text("sample_log"))
    note = F.format_string(DRILL_CARD_NOTE, F.col("s").cast("string"), F.col("e").cast("string"))
    payload = _card(F.lit(DRILL_CARD_TITLE), F.lit(DRILL_CARD_TEMPLATE), [_div(seg), _hr(), _div(logs), _hr(), _note(note)])
    return g.where(F.col("s").isNotNull()).select(
        F.lit("drilldown").alias("kind"), F.lit(None).cast("int").alias("incident_id"), payload.alias("payload"))


def release_payloads(incidents_df: DataFrame) -> DataFrame:
    """One release card per incident of the log (times as ``HH:mm``)."""
    text = F.format_string(RELEASE_CARD_TEXT, "platform", "region", F.date_format("incident_start", HOUR_MINUTE),
                           F.date_format("incident_end", HOUR_MINUTE))
    payload = _card(F.format_string(RELEASE_CARD_TITLE, "app_version"), F.lit("red"), [_div(text)])
    return incidents_df.select(F.lit("release").alias("kind"), "incident_id", payload.alias("payload"))


def insight_lines(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numbered root-cause lines of each parsed answer (``transform`` with the
    element index — no explode, no per-row Python)."""
    lines = F.transform(F.coalesce("insights", F.array().cast("array<string>")),
                        lambda x, i: F.format_string(INSIGHT_LINE, i + 1, x))
    return parsed.select(*keep, F.size(F.coalesce("insights", F.array())).alias("n_insights"),
                         F.array_join(lines, "\n").alias("text"))


def insight_cards(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One card per parsed answer from its :func:`insight_lines`, whole text."""
    payload = _card(F.lit(INSIGHT_CARD_TITLE), F.lit(ROOT_CAUSE_CARD_TEMPLATE), [_div(F.col("text"))])
    return lines.select(*keep, payload.alias("payload"))


def root_cause_card(ranked: DataFrame, window: DataFrame) -> DataFrame:
    """The root-cause card: the window and the ranked causes (≤ k rows, folded); none without a window."""
    line = F.format_string(CAUSE_LINE, "rank", "label", "excess", "excess_share", "confidence")
    rows = ranked.select(F.struct("rank", line.alias("line")).alias("l"),
                         F.lit(None).cast("timestamp_ntz").alias("s"), F.lit(None).cast("timestamp_ntz").alias("e"))
    w = window.select(F.lit(None).cast(rows.schema["l"].dataType).alias("l"),
                      F.col("window_start").alias("s"), F.col("window_end").alias("e"))
    g = rows.unionByName(w).agg(F.array_sort(F.collect_list("l")).alias("ls"), F.max("s").alias("s"), F.max("e").alias("e"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    content = F.format_string(ROOT_CAUSE_CARD_TEXT, F.col("s").cast("string"), F.col("e").cast("string"), text)
    payload = _card(F.lit(ROOT_CAUSE_CARD_TITLE), F.lit(ROOT_CAUSE_CARD_TEMPLATE),
                    [_div(content), _hr(), _actions(ROOT_CAUSE_CARD_BUTTONS)])
    return g.where(F.col("s").isNotNull()).select(F.lit("root_cause").alias("kind"), payload.alias("payload"))


def report_card(report: DataFrame, generated_at, text_col: str = "evidence") -> DataFrame:
    """The report card around a report text of any length."""
    status = F.lit(REPORT_CARD_STATUS % generated_at)
    payload = _card(F.lit(REPORT_CARD_TITLE), F.lit(REPORT_CARD_TEMPLATE),
                    [_div(F.col(text_col)), _hr(), _div(status), _actions(REPORT_CARD_BUTTONS)])
    return report.select(F.lit("report").alias("kind"), payload.alias("payload"))


def accuracy_payloads(fields: DataFrame, scorecard: DataFrame) -> DataFrame:
    """One accuracy card per incident from the per-field comparison."""
    mark = F.when(F.col("match"), F.lit(MATCH_MARK)).otherwise(F.lit(MISS_MARK))
    line = F.concat(mark, F.lit(" "), F.col("field"), F.lit(": GT="), F.coalesce(F.col("ground_truth"), F.lit("None")),
                    F.lit(" vs AI="), F.col("ai_detected"))
    order = F.when(F.col("field") == "Platform", 1).when(F.col("field") == "App Version", 2) \
        .when(F.col("field") == "Region", 3).when(F.col("field") == "Provider", 4).otherwise(5)
    text = fields.groupBy("incident_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))),
                                 lambda x: x["l"]), "\n").alias("comp_text"))
    j = scorecard.join(text, "incident_id")
    template = F.when(F.col("accuracy") >= 80, F.lit("green")).otherwise(F.lit("red"))
    payload = _card(F.format_string(ACCURACY_CARD_TITLE, "accuracy"), template, [_div(F.col("comp_text"))])
    return j.select(F.lit("accuracy_report").alias("kind"), "incident_id", payload.alias("payload"))


# -- model answer parsing -----------------------------------------------------------

ANSWER_SCHEMA = T.StructType([
    T.StructField("insights", T.ArrayType(T.StringType())),
    T.StructField("detected_platform", T.StringType()),
    T.StructField("detected_version", T.StringType()),
    T.StructField("detected_region", T.StringType()),
    T.StructField("detected_provider", T.StringType()),
    T.StructField("detected_error", T.StringType()),
])
ANSWER_FIELDS = [f.name for f in ANSWER_SCHEMA.fields if f.name != "insights"]


def parse_answer(df: DataFrame, text_col: str, fallback: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Parse a model answer: the greedy outermost ``{…}`` (across lines) as
    JSON; without braces the whole text is the only insight and the fields come
    from ``fallback`` columns (e.g. top-1 scalar subqueries) for the fields.

    Malformed JSON gives ``parse_ok = false`` and NULL fields instead of an
    exception.  The regex runs over the whole text.
    """
    text = F.col(text_col)
    j = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.from_json(j, ANSWER_SCHEMA, {"mode": "PERMISSIVE"})
    has_json = j != F.lit("")
    cols = [
        F.when(has_json, F.lit("json")).otherwise(F.lit("fallback")).alias("source"),
        F.when(has_json, F.json_object_keys(j).isNotNull()).otherwise(F.lit(True)).alias("parse_ok"),
        F.when(has_json, parsed["insights"]).otherwise(F.array(text)).alias("insights"),
    ]
    for f in ANSWER_FIELDS:
        cols.append(F.when(has_json, parsed[f]).otherwise(fallback[f]).alias(f))
    return df.select(*keep, F.length(text).alias("answer_chars"), *cols)

