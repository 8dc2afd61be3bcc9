"""DuckDB SQL of the queries of :mod:`paylens.plans.extended`, on the CTEs of :mod:`paylens.plans.oracle`."""

from __future__ import annotations

from paylens.operators.islands import GAP
from paylens.operators.sketches import error_bound
from paylens.plans.extended import AWKWARD_NOTE
from paylens.plans.oracle import AS_OF, AS_OF_TS, CENTS, CTES, DIV, FROM_CENTS, KEYS4, KEYS5, R, build

DIMS = ("platform", "app_version", "region", "provider")
COLS = ", ".join(DIMS)
FAIL = "payment_status = 'fail'"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _islands(src: str) -> str:
    return f"""
        SELECT metric, CAST(no AS INTEGER) AS island, MIN(bucket_5m) AS anomaly_start, MAX(bucket_5m) AS anomaly_end,
          CAST(COUNT(*) AS BIGINT) AS anomaly_buckets,
          {R(f"CAST(SUM({CENTS('z_score')}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) / 100.0", 2)} AS avg_z_score,
          {FROM_CENTS(f"SUM({CENTS('impact_estimated')})")} AS total_impact_usd
        FROM (SELECT *, SUM(is_new) OVER (PARTITION BY metric ORDER BY bucket_5m) AS no
              FROM (SELECT *, CASE WHEN bucket_5m - lag(bucket_5m) OVER (PARTITION BY metric ORDER BY bucket_5m)
                      <= INTERVAL {GAP * 5} MINUTE THEN 0 ELSE 1 END AS is_new FROM {src}))
        GROUP BY metric, no"""


CTES["islands"] = (_islands("(SELECT * FROM anomaly WHERE is_anomaly)"), ["anomaly"])
CTES["islands_day"] = (_islands(f"(SELECT * FROM anomaly WHERE is_anomaly AND CAST(bucket_5m AS DATE) = {AS_OF})"), ["anomaly"])
CTES["kpi_islands"] = ("""
        SELECT k.* FROM kpi_5m k JOIN islands_day i ON i.metric = 'pay_success_rate'
          AND k.bucket_5m BETWEEN i.anomaly_start AND i.anomaly_end""", ["kpi_5m", "islands_day"])
CTES["pay_islands"] = ("""
        SELECT p.* FROM silver_payments p JOIN islands_day i ON i.metric = 'pay_success_rate'
          AND p.event_ts BETWEEN i.anomaly_start AND i.anomaly_end""", ["silver_payments", "islands_day"])

# the chain from the incident log to its scores, for the appended log
for name, needs in (("inc_pay", ["silver_payments", "inc_log"]), ("attribution", ["inc_log", "log_inc_pay"])):
    CTES[f"log_{name}"] = (CTES[name][0].replace("JOIN incidents i", "JOIN inc_log i").replace(
        "FROM incidents i", "FROM inc_log i").replace("FROM inc_pay", "FROM log_inc_pay"), needs)
CTES["log_fields"] = (CTES["fields"][0].replace("incidents i", "inc_log i").replace("attribution a", "log_attribution a"),
                      ["inc_log", "log_attribution"])

# greedy choice of disjoint causes over the cube of the leaves
CTES["leaf"] = (f"""
        SELECT {COLS}, CAST(COUNT(*) FILTER (WHERE tag = 'now') AS BIGINT) AS now_attempts,
          CAST(COUNT(*) FILTER (WHERE tag = 'now' AND {FAIL}) AS BIGINT) AS now_fails,
          CAST(COUNT(*) FILTER (WHERE tag = 'prev') AS BIGINT) AS prev_attempts,
          CAST(COUNT(*) FILTER (WHERE tag = 'prev' AND {FAIL}) AS BIGINT) AS prev_fails
        FROM (SELECT *, 'now' AS tag FROM pay_win UNION ALL SELECT *, 'prev' FROM pay_prev) GROUP BY {COLS}""", ["pay_win", "pay_prev"])
CTES["whole"] = ("""
        SELECT SUM(prev_fails) AS f, SUM(prev_attempts) AS n, SUM(now_fails) AS nf, SUM(now_attempts) AS nn FROM leaf""", ["leaf"])
_PAST = "CASE WHEN n > 0 THEN CAST(f AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0::DOUBLE END"
for k in (1, 2, 3):
    src = "leaf" if k == 1 else f"rest{k - 1}"
    inside = " AND ".join(f"(b.fixed & {8 >> i} = 0 OR l.{d} IS NOT DISTINCT FROM b.{d})" for i, d in enumerate(DIMS))
    CTES[f"best{k}"] = (f"""
        SELECT {k} AS cause, fixed, {COLS}, now_attempts, now_fails, prev_attempts, prev_fails,
          {R('e', 2)} AS expected, {R('x', 2)} AS excess, {R('CASE WHEN x > 0 THEN x * x / (e + 1.0::DOUBLE) ELSE 0.0 END', 4)} AS score
        FROM (SELECT *, CAST(now_fails AS DOUBLE) - e AS x
              FROM (SELECT g.*, CAST(now_attempts AS DOUBLE) * ((CAST(prev_fails AS DOUBLE) + ({_PAST}) * 10.0::DOUBLE)
                      / CAST(prev_attempts + 10 AS DOUBLE)) AS e
                    FROM (SELECT CAST(15 - GROUPING({COLS}) AS INTEGER) AS fixed, {COLS},
                            CAST(SUM(now_attempts) AS BIGINT) AS now_attempts, CAST(SUM(now_fails) AS BIGINT) AS now_fails,
                            CAST(SUM(prev_attempts) AS BIGINT) AS prev_attempts, CAST(SUM(prev_fails) AS BIGINT) AS prev_fails
                          FROM {src} GROUP BY CUBE ({COLS})) g, whole WHERE fixed > 0))
        WHERE x > 0 AND {R('x * x / (e + 1.0::DOUBLE)', 4)} > 0
        ORDER BY score DESC, bit_count(fixed), {', '.join(f'{d} ASC NULLS FIRST' for d in DIMS)}, fixed LIMIT 1""", [src, "whole"])
    CTES[f"rest{k}"] = (f"""
        SELECT l.* FROM {src} l WHERE NOT EXISTS (SELECT 1 FROM best{k} b WHERE {inside})""", [src, f"best{k}"])
CTES["causes"] = ("SELECT * FROM best1 UNION ALL SELECT * FROM best2 UNION ALL SELECT * FROM best3", ["best1", "best2", "best3"])


def _lattice() -> str:
    inside = " AND ".join(f"(b.fixed & {8 >> i} = 0 OR p.{d} IS NOT DISTINCT FROM b.{d})" for i, d in enumerate(DIMS))
    part = " || ' + ' || ".join(f"CASE WHEN fixed & {8 >> i} = 0 THEN '*' ELSE COALESCE({d}, '') END" for i, d in enumerate(DIMS))
    total = "(SELECT CAST(nf AS DOUBLE) - CASE WHEN n > 0 THEN CAST(nn AS DOUBLE) * CAST(f AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0 END FROM whole)"
    return f"""
        SELECT c.cause, CAST(bit_count(fixed) AS INTEGER) AS level, fixed, {COLS}, t.error_code, now_attempts, now_fails,
          prev_attempts, prev_fails, expected, excess, score,
          CASE WHEN {total} > 0 THEN {R(f'excess / {total}', 4)} END AS excess_share, {part} AS segment
        FROM causes c LEFT JOIN (
          SELECT cause, error_code FROM (
            SELECT b.cause, p.error_code, row_number() OVER (PARTITION BY b.cause ORDER BY COUNT(*) DESC, p.error_code ASC NULLS FIRST) AS rn
            FROM pay_win p JOIN causes b ON {inside} WHERE p.{FAIL} GROUP BY b.cause, p.error_code) WHERE rn = 1) t USING (cause)"""


def _quoted(x: str) -> str:
    special = " OR ".join(f"contains({x}, {c})" for c in ("'|'", "'\"'", "chr(10)", "chr(13)"))
    return f"CASE WHEN {special} THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


def more_sql() -> dict[str, str]:
    spans = {
        "minute": ("incident_start", "incident_start + INTERVAL 59 SECOND"), "hour": ("incident_start", "incident_end"),
        "day": ("date_trunc('day', incident_start)", "date_trunc('day', incident_start) + INTERVAL 86399 SECOND"),
        "month": ("incident_start - INTERVAL 15 DAY", "incident_start + INTERVAL 15 DAY"),
    }
    windows = " UNION ALL ".join(f"SELECT incident_id, '{k}' AS span, {a} AS s, {b} AS e FROM inc_log" for k, (a, b) in spans.items())
    fields = [("CAST(event_id AS VARCHAR)", "event_id"), ("props", "props"), ("event_type || '|' || CAST(user_id AS VARCHAR)", "kind|user"),
              ("event_type || chr(10) || event_type", "lines"), ("printf('%.2f', value)", "value")]
    header = "|".join(f'"{n}"' if "|" in n else n for _, n in fields)
    line = " || '|' || ".join(f"COALESCE({_quoted(x)}, '')" for x, _ in fields)
    label = "printf('%s %s + %s + %s: %s spike', {0}, {1}, {2}, {3}, {4})".format
    return {
        "user_impact_sketch": build(f"""
            SELECT affected_users, total_dau,
              CASE WHEN total_dau > 0 THEN {R(DIV('affected_users', 'total_dau') + ' * 100', 1)} ELSE 0.0 END AS dau_pct,
              {error_bound()}::DOUBLE AS rel_error
            FROM (SELECT CAST(COUNT(DISTINCT user_id) AS BIGINT) AS affected_users FROM silver_payments, bounds
                  WHERE {FAIL} AND time_bucket(INTERVAL 5 MINUTE, event_ts) BETWEEN astart AND aend),
                 (SELECT CAST(COUNT(DISTINCT user_id) AS BIGINT) AS total_dau FROM silver_game_events
                  WHERE event_ts >= {AS_OF_TS} AND event_ts < {AS_OF_TS} + INTERVAL 1 DAY)""",
            ["silver_payments", "silver_game_events", "bounds"]),
        "segment_users_sketch": build(f"""
            SELECT CAST(4 - bit_count(GROUPING({COLS})) AS INTEGER) AS drill_level, {COLS},
              CAST(COUNT(DISTINCT user_id) AS BIGINT) AS affected_users
            FROM silver_payments WHERE {FAIL} GROUP BY ROLLUP ({COLS})""", ["silver_payments"]),
        "refresh_gold_incremental": build("SELECT * FROM anomaly", ["anomaly"]),
        "window_volume": build(f"""
            SELECT incident_id, span, CAST(COUNT(*) AS BIGINT) AS attempts, CAST(COUNT(*) FILTER (WHERE {FAIL}) AS BIGINT) AS fails,
              MIN(event_ts) AS first_ts, MAX(event_ts) AS last_ts
            FROM silver_payments p JOIN ({windows}) w ON p.event_ts BETWEEN w.s AND w.e GROUP BY ALL""", ["silver_payments", "inc_log"]),
        "log_scorecard": build(f"""
            SELECT i.incident_id, {label('i.platform', 'i.app_version', 'i.region', 'i.provider', 'i.error_code')} AS root_cause,
              {label('a.detected_platform', 'a.detected_version', 'a.detected_region', 'a.detected_provider', 'a.detected_error')} AS detected_root_cause,
              m.matches, CAST(5 AS BIGINT) AS total_fields, CAST(round(m.matches * 100.0 / 5) AS INTEGER) AS accuracy,
              m.matches * 100.0 / 5 >= 80 AS passed
            FROM inc_log i JOIN log_attribution a USING (incident_id)
            JOIN (SELECT incident_id, CAST(SUM(CASE WHEN match THEN 1 ELSE 0 END) AS BIGINT) AS matches FROM log_fields GROUP BY 1) m
              USING (incident_id)""", ["inc_log", "log_attribution", "log_fields"]),
        "anomaly_islands": build("SELECT * FROM islands", ["islands"]),
        "island_drill_provider": build(
            f"SELECT {COLS}, CAST(SUM(pay_attempts) AS BIGINT) AS attempts, CAST(SUM(pay_fail) AS BIGINT) AS fails, "
            f"{R(DIV('SUM(pay_fail)', 'SUM(pay_attempts)'), 4)} AS fail_rate FROM kpi_islands GROUP BY ALL "
            f"ORDER BY fail_rate DESC NULLS LAST, {KEYS4} LIMIT 10", ["kpi_islands"]),
        "island_top_errors": build(
            f"SELECT {COLS}, error_code, CAST(COUNT(*) AS BIGINT) AS error_count FROM pay_islands WHERE {FAIL} GROUP BY ALL "
            f"ORDER BY error_count DESC, {KEYS5} LIMIT 15", ["pay_islands"]),
        "root_cause_lattice": build(_lattice(), ["causes", "whole", "pay_win"]),
        "ingest_quarantine": build("""
            SELECT reason, columns, CAST(COUNT(*) AS BIGINT) AS lines, CAST(SUM(id) AS BIGINT) AS ids
            FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'unreadable record' WHEN event_id % 89 = 0 THEN 'value of the wrong type'
                    ELSE 'accepted' END AS reason,
                    CASE WHEN event_id % 97 <> 0 AND event_id % 89 = 0 THEN 'amount' ELSE '' END AS columns, event_id AS id FROM silver_payments)
            GROUP BY ALL""", ["silver_payments"]),
        "gold_ordered": build("SELECT * FROM kpi_5m", ["kpi_5m"]),
        "sql_segment_failures": build(f"""
            SELECT {COLS}, error_code, CAST(COUNT(*) AS BIGINT) AS error_count, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS affected_users
            FROM silver_payments WHERE {FAIL} AND CAST(event_ts AS DATE) = {AS_OF} GROUP BY ALL""", ["silver_payments"]),
        "sql_bound_values": build(f"""
            SELECT platform, CAST(COUNT(*) AS BIGINT) AS attempts, {_literal(AWKWARD_NOTE)} AS note
            FROM silver_payments WHERE region <> {_literal(AWKWARD_NOTE)} GROUP BY platform""", ["silver_payments"]),
        "sql_day_function": build(f"""
            SELECT platform, app_version, CAST(COUNT(*) AS BIGINT) AS attempts, CAST(COUNT(*) FILTER (WHERE {FAIL}) AS BIGINT) AS fails
            FROM silver_payments WHERE CAST(event_ts AS DATE) = {AS_OF} GROUP BY ALL""", ["silver_payments"]),
        "export_quoted": f"""
            SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, '{header}' || chr(10) || string_agg({line}, chr(10) ORDER BY event_id) AS text
            FROM (SELECT * FROM events ORDER BY event_id LIMIT 50)""",
    }
