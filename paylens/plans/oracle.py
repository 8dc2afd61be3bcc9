"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each entry is written directly in SQL against the driver's tables (views
``events customer nation region conversations``), independently of the
Spark code: the adapter, cube, self-join baseline, window restriction by
scalar bounds, top-k with explicit tie-breakers.  Shared steps are CTEs; an
oracle query is ``WITH <the CTEs it needs> SELECT ...``.

Conventions shared with the Spark side (see ``paylens.functions``):
``R(x, k)`` rounds half-up with a relative tie nudge; payments are summed as
exact decimals and rounded once, rounded amounts in integer cents; baseline moments are exact integers (HUGEINT here, DECIMAL(38,0) in
Spark).
"""

from __future__ import annotations

from paylens import config as C

AS_OF = f"DATE '{C.AS_OF.isoformat()}'"
AS_OF_TS = f"TIMESTAMP '{C.AS_OF.isoformat()} 00:00:00'"


def R(x: str, k: int) -> str:
    return f"(round(({x}) * (1.0 + 1e-13::DOUBLE), {k}) + 0.0)"


def DIV(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))"


def CENTS(x: str) -> str:
    return f"CAST(round(({x}) * 100) AS BIGINT)"


def FROM_CENTS(x: str) -> str:
    return f"(CAST({x} AS DOUBLE) / 100.0)"


KEYS4 = "platform ASC NULLS LAST, app_version ASC NULLS LAST, region ASC NULLS LAST, provider ASC NULLS LAST"
KEYS5 = KEYS4 + ", error_code ASC NULLS LAST"
DEVICES = "['Galaxy_S24', 'Pixel_8', 'OnePlus_12']"
CODES = "['TOKEN_EXPIRED', 'NETWORK_TIMEOUT', 'PROVIDER_ERROR', 'INSUFFICIENT_FUNDS', 'CARD_DECLINED']"


def _stats(n: str, sx: str, sq: str, scale: float) -> tuple[str, str]:
    mean = f"CASE WHEN {n} > 0 THEN CAST({sx} AS DOUBLE) / CAST({n} AS DOUBLE) / {scale} END"
    std = (f"CASE WHEN {n} > 1 THEN sqrt(CAST(CAST({n} AS HUGEINT) * {sq} - CAST({sx} AS HUGEINT) * {sx} AS DOUBLE)"
           f" / (CAST({n} AS DOUBLE) * CAST({n} - 1 AS DOUBLE))) / {scale} END")
    return mean, std


_M_PSR, _S_PSR = _stats("n", "sx_bp", "sq_bp", 10000.0)
_M_REV, _S_REV = _stats("n", "sx_ct", "sq_ct", 100.0)

# name -> (sql, dependencies)
CTES: dict[str, tuple[str, list[str]]] = {
    "geo": ("""
        SELECT c.c_custkey, r.r_name FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey""", []),
    "p_dims": ("""
        SELECT e.event_id, e.ts, e.user_id AS uid, e.event_type, e.value,
               TRY_CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k,
               CASE WHEN e.user_id % 2 = 0 THEN 'iOS' ELSE 'Android' END AS platform,
               CASE WHEN e.user_id % 4 < 2 THEN '1.2.6' ELSE '1.2.7' END AS app_version,
               g.r_name AS region
        FROM events e JOIN geo g ON e.user_id = g.c_custkey""", ["geo"]),
    "p_prov": ("""
        SELECT *, CASE WHEN k % 2 = 0 THEN 'Stripe' WHEN platform = 'iOS' THEN 'ApplePay' ELSE 'GooglePay' END AS provider
        FROM p_dims""", ["p_dims"]),
    "p_inc": ("""
        SELECT *,
          (ts >= TIMESTAMP '2024-01-20 10:00:00' AND ts < TIMESTAMP '2024-01-20 14:00:00'
            AND (platform = 'iOS' OR app_version = '1.2.7')) AS in_a,
          (ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00'
            AND platform = 'iOS' AND app_version = '1.2.7' AND region = 'ASIA' AND provider = 'Stripe') AS in_b
        FROM p_prov""", ["p_prov"]),
    "p_fail": ("""
        SELECT *, (event_type = 'error' OR ((in_a OR in_b) AND event_type <> 'purchase')) AS failed FROM p_inc""",
               ["p_inc"]),
    "silver_payments": (f"""
        SELECT event_id, ts AS event_ts, 'u_' || lpad(CAST(uid AS VARCHAR), 6, '0') AS user_id,
          value AS amount, 'USD' AS currency, provider,
          CASE WHEN failed THEN 'fail' ELSE 'success' END AS payment_status,
          CASE WHEN failed THEN
            CASE WHEN in_b THEN 'PROVIDER_ERROR'
                 WHEN in_a AND k % 4 < 3 THEN 'TOKEN_EXPIRED'
                 ELSE {CODES}[CAST(k % 5 + 1 AS INTEGER)] END
          END AS error_code,
          platform, app_version, region,
          CASE WHEN platform = 'iOS' THEN 'iPhone' || CAST(13 + uid % 3 AS VARCHAR)
               ELSE {DEVICES}[CAST(uid % 3 + 1 AS INTEGER)] END AS device_model
        FROM p_fail""", ["p_fail"]),
    "silver_game_events": ("""
        SELECT event_id, event_ts, user_id, region, platform, device_model, app_version,
          unnest(['login', 'purchase_attempt',
                  CASE WHEN payment_status = 'success' THEN 'purchase_success' ELSE 'purchase_fail' END]) AS event_name
        FROM silver_payments""", ["silver_payments"]),
    "kpi_raw": ("""
        SELECT time_bucket(INTERVAL '__W__ minutes', event_ts) AS bucket_5m, platform, app_version, region, provider,
          CAST(round(SUM(CASE WHEN payment_status = 'success' THEN CAST(amount AS DECIMAL(28, 6)) ELSE 0 END), 2) AS DOUBLE) AS revenue,
          CAST(COUNT(*) AS BIGINT) AS pay_attempts,
          CAST(COUNT(*) FILTER (WHERE payment_status = 'success') AS BIGINT) AS pay_success,
          CAST(COUNT(*) FILTER (WHERE payment_status = 'fail') AS BIGINT) AS pay_fail
        FROM silver_payments GROUP BY ALL""", ["silver_payments"]),
    "kpi_5m": (f"""
        SELECT bucket_5m, platform, app_version, region, provider, revenue,
          pay_attempts, pay_success, pay_fail, {R(DIV('pay_success', 'pay_attempts'), 4)} AS pay_success_rate
        FROM kpi_raw""", ["kpi_raw"]),
    "overall_raw": (f"""
        SELECT bucket_5m, CAST(SUM({CENTS('revenue')}) AS BIGINT) AS rev_cents,
          CAST(SUM(pay_attempts) AS BIGINT) AS pay_attempts, CAST(SUM(pay_success) AS BIGINT) AS pay_success,
          CAST(SUM(pay_fail) AS BIGINT) AS pay_fail
        FROM kpi_5m GROUP BY bucket_5m""", ["kpi_5m"]),
    "overall_5m": (f"""
        SELECT bucket_5m, {FROM_CENTS('rev_cents')} AS revenue, pay_attempts, pay_success, pay_fail,
          {R(DIV('pay_success', 'pay_attempts'), 4)} AS pay_success_rate
        FROM overall_raw""", ["overall_raw"]),
    "with_tod": ("""
        SELECT *, CAST(floor((hour(bucket_5m) * 60 + minute(bucket_5m)) / __W__) AS INTEGER) AS tod_key,
          CAST(bucket_5m AS DATE) AS dt
        FROM overall_5m""", ["overall_5m"]),
    "moments": ("""
        SELECT bucket_5m, tod_key, dt, revenue AS actual_revenue, pay_success_rate AS actual_psr,
          pay_attempts AS actual_attempts,
          CAST(round(pay_success_rate * 10000) AS BIGINT) AS x_bp, CAST(round(revenue * 100) AS BIGINT) AS x_ct
        FROM with_tod""", ["with_tod"]),
    "pairs_other": ("""
        SELECT a.bucket_5m, any_value(a.actual_revenue) AS actual_revenue, any_value(a.actual_psr) AS actual_psr,
          any_value(a.actual_attempts) AS actual_attempts, COUNT(*) AS n,
          SUM(b.x_bp) AS sx_bp, SUM(CAST(b.x_bp AS HUGEINT) * b.x_bp) AS sq_bp,
          SUM(b.x_ct) AS sx_ct, SUM(CAST(b.x_ct AS HUGEINT) * b.x_ct) AS sq_ct
        FROM moments a JOIN moments b ON a.tod_key = b.tod_key AND a.dt <> b.dt
        GROUP BY a.bucket_5m""", ["moments"]),
    "pairs_prev": ("""
        SELECT a.bucket_5m, any_value(a.actual_revenue) AS actual_revenue, any_value(a.actual_psr) AS actual_psr,
          any_value(a.actual_attempts) AS actual_attempts, COUNT(*) AS n,
          SUM(b.x_bp) AS sx_bp, SUM(CAST(b.x_bp AS HUGEINT) * b.x_bp) AS sq_bp,
          SUM(b.x_ct) AS sx_ct, SUM(CAST(b.x_ct AS HUGEINT) * b.x_ct) AS sq_ct
        FROM moments a JOIN moments b ON a.tod_key = b.tod_key AND b.dt < a.dt
        GROUP BY a.bucket_5m""", ["moments"]),
}


def _baselines_sql(src: str) -> str:
    return f"""
        SELECT bucket_5m, actual_revenue, actual_psr, actual_attempts,
          {_M_PSR} AS baseline_psr, {_S_PSR} AS std_psr, {_M_REV} AS baseline_revenue, {_S_REV} AS std_revenue
        FROM {src}"""


def _anomaly_sql(src: str) -> str:
    z_p = "CASE WHEN std_psr > 0 THEN (actual_psr - baseline_psr) / std_psr END"
    z_r = "CASE WHEN std_revenue > 0 THEN (actual_revenue - baseline_revenue) / std_revenue END"
    return f"""
        SELECT bucket_5m, 'pay_success_rate' AS metric, actual_psr AS actual, {R('baseline_psr', 4)} AS baseline,
          {R(f'COALESCE({z_p}, 0.0)', 2)} AS z_score,
          COALESCE({z_p} < {C.Z_THRESHOLD}, false) AS is_anomaly,
          {R(f'CASE WHEN actual_psr < baseline_psr THEN (baseline_psr - actual_psr) * actual_attempts * {C.AVG_PURCHASE_VALUE} ELSE 0.0 END', 2)} AS impact_estimated
        FROM {src}
        UNION ALL
        SELECT bucket_5m, 'revenue' AS metric, actual_revenue AS actual, {R('baseline_revenue', 2)} AS baseline,
          {R(f'COALESCE({z_r}, 0.0)', 2)} AS z_score,
          COALESCE({z_r} < {C.Z_THRESHOLD}, false) AS is_anomaly,
          {R('CASE WHEN actual_revenue < baseline_revenue THEN baseline_revenue - actual_revenue ELSE 0.0 END', 2)} AS impact_estimated
        FROM {src}"""


CTES.update({
    "baselines": (_baselines_sql("pairs_other"), ["pairs_other"]),
    "baselines_prev": (_baselines_sql("pairs_prev"), ["pairs_prev"]),
    "anomaly": (_anomaly_sql("baselines"), ["baselines"]),
    "anomaly_prev": (_anomaly_sql("baselines_prev"), ["baselines_prev"]),
    "bounds": (f"""
        SELECT MIN(bucket_5m) AS astart, MAX(bucket_5m) AS aend FROM anomaly
        WHERE is_anomaly AND CAST(bucket_5m AS DATE) = {AS_OF} AND metric = 'pay_success_rate'""", ["anomaly"]),
    "awin": (f"""
        SELECT metric, MIN(bucket_5m) AS anomaly_start, MAX(bucket_5m) AS anomaly_end, COUNT(*) AS anomaly_buckets,
          {R('CAST(SUM(CAST(round(z_score * 100) AS BIGINT)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) / 100.0', 2)} AS avg_z_score,
          {FROM_CENTS(f"SUM({CENTS('impact_estimated')})")} AS total_impact_usd
        FROM anomaly WHERE is_anomaly AND CAST(bucket_5m AS DATE) = {AS_OF} GROUP BY metric""", ["anomaly"]),
    "kpi_win": ("""
        SELECT k.* FROM kpi_5m k, bounds b WHERE k.bucket_5m BETWEEN b.astart AND b.aend""", ["kpi_5m", "bounds"]),
    "pay_win": ("""
        SELECT p.* FROM silver_payments p, bounds b WHERE p.event_ts BETWEEN b.astart AND b.aend""",
                ["silver_payments", "bounds"]),
    "pay_prev": ("""
        SELECT p.* FROM silver_payments p, bounds b
        WHERE p.event_ts BETWEEN b.astart - INTERVAL 1 DAY AND b.aend - INTERVAL 1 DAY""",
                 ["silver_payments", "bounds"]),
    "err_now_prev": ("""
        SELECT platform, app_version, region, provider, error_code,
          CAST(SUM(CASE WHEN tag = 'now' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
          CAST(SUM(CASE WHEN tag = 'prev' THEN 1 ELSE 0 END) AS BIGINT) AS prev_error_count
        FROM (SELECT *, 'now' AS tag FROM pay_win UNION ALL SELECT *, 'prev' AS tag FROM pay_prev)
        WHERE payment_status = 'fail' GROUP BY ALL""", ["pay_win", "pay_prev"]),
    "user_impact": (f"""
        SELECT a.affected_users, t.total_dau,
          CASE WHEN t.total_dau > 0 THEN {R(DIV('a.affected_users', 't.total_dau') + ' * 100', 1)} ELSE 0.0 END AS dau_pct
        FROM (SELECT CAST(COUNT(DISTINCT user_id) AS BIGINT) AS affected_users FROM pay_win WHERE payment_status = 'fail') a,
             (SELECT CAST(COUNT(DISTINCT user_id) AS BIGINT) AS total_dau FROM silver_game_events
              WHERE event_ts >= {AS_OF_TS} AND event_ts < {AS_OF_TS} + INTERVAL 1 DAY) t""",
                    ["pay_win", "silver_game_events"]),
    "impact_summary": ("""
        SELECT p.anomaly_start, p.anomaly_end,
          CAST(date_diff('minute', p.anomaly_start, p.anomaly_end) + 5 AS BIGINT) AS duration_minutes,
          p.anomaly_buckets, p.avg_z_score, p.total_impact_usd AS estimated_impact_usd,
          r.total_impact_usd AS revenue_loss_usd, u.affected_users, u.total_dau, u.dau_pct
        FROM user_impact u
        LEFT JOIN (SELECT * FROM awin WHERE metric = 'pay_success_rate') p ON true
        LEFT JOIN (SELECT * FROM awin WHERE metric = 'revenue') r ON true""", ["user_impact", "awin"]),
    "incidents": ("""
        SELECT * FROM (VALUES
          (1, 'iOS', '1.2.7', 'ASIA', 'Stripe', 'PROVIDER_ERROR', 0.8,
           TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-12 23:59:59', CAST(NULL AS INTEGER)),
          (2, 'iOS', '1.2.7', 'EUROPE', 'Stripe', 'TOKEN_EXPIRED', 0.8,
           TIMESTAMP '2024-01-20 10:00:00', TIMESTAMP '2024-01-20 13:59:59', CAST(NULL AS INTEGER)),
          (3, 'Android', '1.2.6', 'AMERICA', 'GooglePay', 'CARD_DECLINED', 0.2,
           TIMESTAMP '2025-06-01 10:00:00', TIMESTAMP '2025-06-01 10:30:00', CAST(NULL AS INTEGER))
        ) t(incident_id, platform, app_version, region, provider, error_code, fail_rate,
            incident_start, incident_end, rows_inserted)""", []),
    "inc_pay": ("""
        SELECT i.incident_id, p.* FROM silver_payments p JOIN incidents i
          ON p.event_ts BETWEEN i.incident_start AND i.incident_end""", ["silver_payments", "incidents"]),
    "attribution": (f"""
        SELECT i.incident_id,
          COALESCE(s.platform, 'unknown') AS detected_platform, COALESCE(s.app_version, 'unknown') AS detected_version,
          COALESCE(s.region, 'unknown') AS detected_region, COALESCE(s.provider, 'unknown') AS detected_provider,
          COALESCE(e.error_code, 'unknown') AS detected_error
        FROM incidents i
        LEFT JOIN (
          SELECT * FROM (
            SELECT incident_id, platform, app_version, region, provider,
              row_number() OVER (PARTITION BY incident_id ORDER BY
                {R(DIV('SUM(CASE WHEN payment_status = \'fail\' THEN 1 ELSE 0 END)', 'COUNT(*)'), 4)} DESC NULLS LAST,
                {KEYS4}) AS rn
            FROM inc_pay GROUP BY incident_id, platform, app_version, region, provider) WHERE rn = 1
        ) s ON s.incident_id = i.incident_id
        LEFT JOIN (
          SELECT * FROM (
            SELECT incident_id, error_code,
              row_number() OVER (PARTITION BY incident_id ORDER BY COUNT(*) DESC, error_code ASC NULLS LAST) AS rn
            FROM inc_pay WHERE payment_status = 'fail' GROUP BY incident_id, error_code) WHERE rn = 1
        ) e ON e.incident_id = i.incident_id""", ["incidents", "inc_pay"]),
    "fields": ("""
        SELECT i.incident_id, f.field, f.ground_truth, f.ai_detected,
          COALESCE(lower(f.ground_truth) = lower(f.ai_detected), false) AS match
        FROM incidents i JOIN attribution a ON a.incident_id = i.incident_id,
        LATERAL (VALUES
          ('Platform', i.platform, a.detected_platform),
          ('App Version', i.app_version, a.detected_version),
          ('Region', i.region, a.detected_region),
          ('Provider', i.provider, a.detected_provider),
          ('Error Code', i.error_code, a.detected_error)) f(field, ground_truth, ai_detected)""",
               ["incidents", "attribution"]),
})


def _label(p: str, v: str, r: str, pr: str, e: str) -> str:
    return f"printf('%s %s + %s + %s: %s spike', {p}, {v}, {r}, {pr}, {e})"


def build(select: str, needs: list[str], minutes: int = 5) -> str:
    """``WITH`` the transitive closure of ``needs`` (dependency order) + ``select``;
    ``minutes`` is the bucket width of the KPI cube."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({CTES[n][0]}\n)" for n in order).replace("__W__", str(int(minutes)))
    return f"WITH {ctes}\n{select}" if ctes else select


def _text_section(i: int, title: str, src: str, cols: list[tuple[str, str]], order: str) -> str:
    header = "|".join(c for c, _ in cols)
    parts = []
    for c, kind in cols:
        if kind == "s":
            parts.append(f"COALESCE(CAST({c} AS VARCHAR), '')")
        elif kind.startswith("f"):
            parts.append(f"COALESCE(printf('%.{kind[1:]}f', {c}), '')")
    line = " || '|' || ".join(parts)
    return (f"SELECT {i} AS section, '{title}' AS title, CAST(COUNT(*) AS BIGINT) AS n_rows, "
            f"'{header}' || CASE WHEN COUNT(*) > 0 THEN chr(10) || string_agg({line}, chr(10) ORDER BY {order}) ELSE '' END AS text "
            f"FROM ({src})")


def _sections() -> str:
    dv = ("SELECT platform, app_version, CAST(SUM(pay_attempts) AS BIGINT) AS attempts, CAST(SUM(pay_success) AS BIGINT) AS success, "
          f"CAST(SUM(pay_fail) AS BIGINT) AS fails, {R(DIV('SUM(pay_success)', 'SUM(pay_attempts)'), 4)} AS success_rate, "
          f"{FROM_CENTS('SUM(' + CENTS('revenue') + ')')} AS revenue FROM kpi_win GROUP BY platform, app_version")
    dr = ("SELECT platform, app_version, region, CAST(SUM(pay_attempts) AS BIGINT) AS attempts, "
          "CAST(SUM(pay_success) AS BIGINT) AS success, CAST(SUM(pay_fail) AS BIGINT) AS fails, "
          f"{R(DIV('SUM(pay_success)', 'SUM(pay_attempts)'), 4)} AS success_rate FROM kpi_win GROUP BY ALL "
          "ORDER BY success_rate ASC NULLS LAST, platform ASC NULLS LAST, app_version ASC NULLS LAST, region ASC NULLS LAST LIMIT 10")
    dp = ("SELECT platform, app_version, region, provider, CAST(SUM(pay_attempts) AS BIGINT) AS attempts, "
          f"CAST(SUM(pay_fail) AS BIGINT) AS fails, {R(DIV('SUM(pay_fail)', 'SUM(pay_attempts)'), 4)} AS fail_rate "
          f"FROM kpi_win GROUP BY ALL ORDER BY fail_rate DESC NULLS LAST, {KEYS4} LIMIT 10")
    te = ("SELECT platform, app_version, region, provider, error_code, CAST(COUNT(*) AS BIGINT) AS error_count FROM {src} "
          f"WHERE payment_status = 'fail' GROUP BY ALL ORDER BY error_count DESC, {KEYS5} LIMIT 15")
    s4 = [("platform", "s"), ("app_version", "s")]
    s5 = [("platform", "s"), ("app_version", "s"), ("region", "s"), ("provider", "s"), ("error_code", "s")]
    k2 = "platform, app_version"
    k3 = "platform, app_version, region"
    k4 = "platform, app_version, region, provider"
    k5 = k4 + ", error_code"
    secs = [
        _text_section(1, "Drill-down by Platform + App Version", dv,
                      s4 + [("attempts", "s"), ("success", "s"), ("fails", "s"), ("success_rate", "f4"), ("revenue", "f2")],
                      f"success_rate, {k2}"),
        _text_section(2, "Drill-down by Platform + Version + Region", dr,
                      s4 + [("region", "s"), ("attempts", "s"), ("success", "s"), ("fails", "s"), ("success_rate", "f4")],
                      f"success_rate, {k3}"),
        _text_section(3, "Drill-down by Provider (fail rate)", dp,
                      s4 + [("region", "s"), ("provider", "s"), ("attempts", "s"), ("fails", "s"), ("fail_rate", "f4")],
                      f"-fail_rate, {k4}"),
        _text_section(4, "Top Error Codes During Anomaly Window", te.format(src="pay_win"),
                      s5 + [("error_count", "s")], f"-error_count, {k5}"),
        _text_section(5, "Baseline Error Codes (Same Window Yesterday)", te.format(src="pay_prev"),
                      s5 + [("error_count", "s")], f"-error_count, {k5}"),
    ]
    return "\nUNION ALL\n".join(secs)


CTES["evidence"] = (_sections(), ["kpi_win", "pay_win", "pay_prev"])


def _topk_fail_rate(src: str, k: int) -> str:
    return (f"SELECT platform, app_version, region, provider, CAST(SUM(CASE WHEN payment_status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS fails, "
            f"CAST(COUNT(*) AS BIGINT) AS attempts, {R(DIV('SUM(CASE WHEN payment_status = ' + chr(39) + 'fail' + chr(39) + ' THEN 1 ELSE 0 END)', 'COUNT(*)'), 4)} AS fail_rate "
            f"FROM {src} GROUP BY ALL ORDER BY fail_rate DESC NULLS LAST, {KEYS4} LIMIT {k}")


def _drill_lines() -> str:
    drill = (f"SELECT platform, app_version, region, provider, error_code, COUNT(*) AS error_count, "
             f"COUNT(DISTINCT user_id) AS affected_users FROM pay_win WHERE payment_status = 'fail' GROUP BY ALL "
             f"ORDER BY error_count DESC, {KEYS5} LIMIT 5")
    logs = ("SELECT event_id, event_ts, user_id, provider, error_code, amount FROM pay_win "
            "WHERE payment_status = 'fail' AND platform = 'iOS' AND app_version = '1.2.7' ORDER BY event_ts, event_id LIMIT 5")
    seg = _topk_fail_rate("pay_win", 5)
    errs = ("SELECT error_code, COUNT(*) AS cnt FROM pay_win WHERE payment_status = 'fail' GROUP BY ALL "
            "ORDER BY cnt DESC, error_code ASC NULLS LAST LIMIT 5")
    return f"""
        SELECT 'segment_error' AS kind, CAST(row_number() OVER (ORDER BY error_count DESC, {KEYS5}) AS INTEGER) AS line_no,
          printf('• **%s %s | %s | %s** → %s: %d errors, %d users', platform, app_version, region, provider, error_code,
                 error_count, affected_users) AS line
        FROM ({drill})
        UNION ALL
        SELECT 'sample_log', CAST(row_number() OVER (ORDER BY event_ts, event_id) AS INTEGER),
          printf('`%s` | %s | %s | %s | $%s', strftime(event_ts, '%Y-%m-%d %H:%M:%S'), user_id, provider, error_code,
                 printf('%.2f', amount))
        FROM ({logs})
        UNION ALL
        SELECT 'app_segment', CAST(row_number() OVER (ORDER BY fail_rate DESC, {KEYS4}) AS INTEGER),
          printf('  %s %s | %s | %s: fail_rate=%s, fails=%d/%d', platform, app_version, region, provider,
                 printf('%.4f', fail_rate), fails, attempts)
        FROM ({seg})
        UNION ALL
        SELECT 'app_error', CAST(row_number() OVER (ORDER BY cnt DESC, error_code ASC NULLS LAST) AS INTEGER),
          printf('  %s: %d errors', error_code, cnt)
        FROM ({errs})"""


NL = "chr(10)"
HR = "json_object('tag', 'hr')"


def _card(title: str, template: str, elements: list[str]) -> str:
    return ("CAST(json_object('msg_type', 'interactive', 'card', json_object("
            "'config', json_object('wide_screen_mode', true), "
            f"'header', json_object('title', json_object('content', {title}, 'tag', 'plain_text'), 'template', {template}), "
            f"'elements', [{', '.join(elements)}])) AS VARCHAR)")


def _div(content: str) -> str:
    return f"json_object('tag', 'div', 'text', json_object('tag', 'lark_md', 'content', {content}))"


def _q(text: str) -> str:
    return "'" + text + "'"


def _buttons(buttons: list[tuple[str, str, str]]) -> str:
    each = [f"json_object('tag', 'button', 'text', json_object('tag', 'plain_text', 'content', '{text}'), 'type', '{kind}', "
            f"'value', json_object('action', '{action}'))" for text, kind, action in buttons]
    return f"json_object('tag', 'action', 'actions', [{', '.join(each)}])"


def _answers() -> str:
    """Answers written from the incident log (clean, within text, broken) and what parsing must give."""
    label = _label("platform", "app_version", "region", "provider", "error_code")
    cols = [("detected_platform", "platform"), ("detected_version", "app_version"), ("detected_region", "region"),
            ("detected_provider", "provider"), ("detected_error", "error_code")]
    body = ("'{\"insights\": [\"' || label || '\", \"second\"]'"
            + "".join(f" || ', \"{f}\": \"' || {c} || '\"'" for f, c in cols) + " || '}'")
    fields = ", ".join(f"CASE WHEN kind < 2 THEN {c} END AS {f}" for f, c in cols)
    return (f"SELECT incident_id, CAST(length(CASE kind WHEN 0 THEN {body} WHEN 1 THEN 'Analysis:' || chr(10) || {body} "
            "|| chr(10) || 'Done.' ELSE '{\"insights\": [\"' || label || ']}' END) AS INTEGER) AS answer_chars, "
            f"'json' AS source, kind < 2 AS parse_ok, CASE WHEN kind < 2 THEN [label, 'second'] END AS insights, {fields} "
            f"FROM (SELECT *, {label} AS label, incident_id % 3 AS kind FROM inc_log)")


def _note(text: str) -> str:
    return f"json_object('tag', 'note', 'elements', [json_object('tag', 'plain_text', 'content', {text})])"


def _alert_payload() -> str:
    first = (f"CASE WHEN revenue_loss_usd IS NOT NULL THEN '**Anomaly Window**: ' || CAST(anomaly_start AS VARCHAR) "
             f"|| ' → ' || CAST(anomaly_end AS VARCHAR) || {NL} || '**Metric**: Payment Success Rate' || {NL} "
             f"|| '**Avg Z-Score**: ' || CAST(avg_z_score AS VARCHAR) || {NL} || '**Estimated Revenue Loss**: $' "
             f"|| format('{{:,.2f}}', revenue_loss_usd) ELSE 'N/A' END")
    second = (f"'**Impact Summary**' || {NL} || '• Affected Users: ' || format('{{:,}}', affected_users) || ' (' "
              f"|| CAST(dau_pct AS VARCHAR) || '% of DAU)' || {NL} || '• Anomaly Buckets: ' "
              f"|| CAST(anomaly_buckets AS VARCHAR) || ' (x5min intervals)' || {NL} || '• Status: 🔴 Active'")
    alert = (f"SELECT 'anomaly_alert' AS kind, CAST(NULL AS INTEGER) AS incident_id, "
             f"{_card(chr(39) + '🚨 Alert: Payment Anomaly Detected' + chr(39), chr(39) + 'red' + chr(39), [_div(first), HR, _div(second), HR, _buttons([('🔍 Run RCA Agent', 'primary', 'run_rca'), ('📊 View Dashboard', 'default', 'view_dashboard')])])} AS payload "
             "FROM impact_summary WHERE anomaly_start IS NOT NULL")
    seg = (f"'**Top Error Segments During Incident**' || {NL} || (SELECT COALESCE(string_agg(line, {NL} ORDER BY line_no), '') "
           "FROM alert_lines WHERE kind = 'segment_error')")
    logs = (f"'**Sample Error Logs (iOS 1.2.7)**' || {NL} || (SELECT COALESCE(string_agg(line, {NL} ORDER BY line_no), '') "
            "FROM alert_lines WHERE kind = 'sample_log')")
    note = "'Showing top 5 segments | Window: ' || CAST(astart AS VARCHAR) || ' → ' || CAST(aend AS VARCHAR)"
    drill = (f"SELECT 'drilldown', CAST(NULL AS INTEGER), "
             f"{_card(chr(39) + '🔬 Root Cause Drill-Down' + chr(39), chr(39) + 'yellow' + chr(39), [_div(seg), HR, _div(logs), HR, _note(note)])} "
             "FROM bounds WHERE astart IS NOT NULL AND aend IS NOT NULL")
    rel_text = (f"'**Platform**: ' || platform || {NL} || '**Region**: ' || region || {NL} || '**Incident**: ' "
                f"|| strftime(incident_start, '%H:%M') || ' → ' || strftime(incident_end, '%H:%M') || {NL} "
                "|| '**Status**: 🔴 Anomaly Detected'")
    release = (f"SELECT 'release', incident_id, "
               f"{_card(chr(39) + '🚀 New Version Released: ' + chr(39) + ' || app_version', chr(39) + 'red' + chr(39), [_div(rel_text)])} "
               "FROM incidents")
    order = ("CASE field WHEN 'Platform' THEN 1 WHEN 'App Version' THEN 2 WHEN 'Region' THEN 3 "
             "WHEN 'Provider' THEN 4 ELSE 5 END")
    acc = (f"SELECT 'accuracy_report', incident_id, "
           f"{_card(chr(39) + '📊 Accuracy Report: ' + chr(39) + ' || CAST(accuracy AS VARCHAR) || ' + chr(39) + '%' + chr(39), 'CASE WHEN accuracy >= 80 THEN ' + chr(39) + 'green' + chr(39) + ' ELSE ' + chr(39) + 'red' + chr(39) + ' END', [_div('comp_text')])} "
           "FROM (SELECT incident_id, CAST(round(SUM(CASE WHEN match THEN 1 ELSE 0 END) * 100.0 / COUNT(*)) AS INTEGER) AS accuracy, "
           f"string_agg(CASE WHEN match THEN '✅' ELSE '❌' END || ' ' || field || ': GT=' || COALESCE(ground_truth, 'None') "
           f"|| ' vs AI=' || ai_detected, {NL} ORDER BY {order}) AS comp_text FROM fields GROUP BY incident_id)")
    return "\nUNION ALL\n".join([alert, drill, release, acc])


def oracle_sql() -> dict[str, str]:
    a = "anomaly"
    day = f"CAST(bucket_5m AS DATE) = {AS_OF}"
    q: dict[str, str] = {
        "silver_payments": build("SELECT * FROM silver_payments", ["silver_payments"]),
        "silver_game_events": build("SELECT * FROM silver_game_events", ["silver_game_events"]),
        "silver_payments_bucketed": build("SELECT * FROM silver_payments", ["silver_payments"]),
        "table_counts": build(
            "SELECT 'silver_game_events' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count FROM silver_game_events "
            "UNION ALL SELECT 'silver_payments', CAST(COUNT(*) AS BIGINT) FROM silver_payments",
            ["silver_game_events", "silver_payments"]),
        "validate_segment_status": build(
            f"SELECT platform, app_version, region, provider, payment_status, CAST(COUNT(*) AS BIGINT) AS cnt "
            f"FROM silver_payments WHERE event_ts >= {AS_OF_TS} AND hour(event_ts) BETWEEN 9 AND 11 "
            "AND platform = 'iOS' AND app_version = '1.2.7' AND region = 'ASIA' GROUP BY ALL", ["silver_payments"]),
        "validate_hourly_success": build(
            "SELECT CAST(hour(event_ts) AS INTEGER) AS hr, CAST(COUNT(*) AS BIGINT) AS total, "
            "CAST(SUM(CASE WHEN payment_status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS success, "
            f"{R(DIV('SUM(CASE WHEN payment_status = ' + chr(39) + 'success' + chr(39) + ' THEN 1 ELSE 0 END)', 'COUNT(*)') + ' * 100', 2)} AS success_rate_pct "
            f"FROM silver_payments WHERE event_ts >= {AS_OF_TS} GROUP BY 1", ["silver_payments"]),
        "bucketize": build(
            "SELECT event_id, event_ts, time_bucket(INTERVAL '5 minutes', event_ts) AS bucket_5m, platform, app_version, "
            "region, provider, amount, payment_status, error_code FROM silver_payments", ["silver_payments"]),
        "kpi_5m": build("SELECT * FROM kpi_5m", ["kpi_5m"]),
        "kpi_extent": build("SELECT CAST(COUNT(*) AS BIGINT) AS total_rows, MIN(bucket_5m) AS earliest, "
                            "MAX(bucket_5m) AS latest FROM kpi_5m", ["kpi_5m"]),
        "overall_5m": build("SELECT * FROM overall_5m", ["overall_5m"]),
        "overall_direct": build("SELECT * FROM overall_5m", ["overall_5m"]),
        "tod_key": build("SELECT * FROM with_tod", ["with_tod"]),
        "baselines": build("SELECT * FROM baselines", ["baselines"]),
        "baselines_window": build("SELECT * FROM baselines", ["baselines"]),
        "anomaly": build(f"SELECT * FROM {a}", [a]),
        "anomaly_join": build(f"SELECT * FROM {a}", [a]),
        "anomaly_previous_days": build("SELECT * FROM anomaly_prev", ["anomaly_prev"]),
        "anomaly_60m": build(f"SELECT * FROM {a}", [a], minutes=60),
        "anomaly_rows": build(f"SELECT * FROM {a} WHERE is_anomaly", [a]),
        "anomaly_summary": build(
            f"SELECT metric, CAST(COUNT(*) AS BIGINT) AS anomaly_count, MIN(bucket_5m) AS first_anomaly, "
            f"MAX(bucket_5m) AS last_anomaly, {FROM_CENTS('SUM(' + CENTS('impact_estimated') + ')')} AS total_estimated_impact "
            f"FROM {a} WHERE is_anomaly GROUP BY metric", [a]),
        "metric_series": build(
            f"SELECT bucket_5m, actual, baseline, z_score, is_anomaly, impact_estimated FROM {a} "
            f"WHERE metric = 'pay_success_rate' AND {day}", [a]),
        "metric_series_revenue": build(
            f"SELECT bucket_5m, actual, baseline, z_score, is_anomaly, impact_estimated FROM {a} "
            f"WHERE metric = 'revenue' AND {day}", [a]),
        "anomaly_markers": build(f"SELECT bucket_5m, metric, actual FROM {a} WHERE is_anomaly AND {day}", [a]),
        "anomaly_windows": build("SELECT * FROM awin", ["awin"]),
        "anomaly_bounds": build("SELECT * FROM bounds", ["bounds"]),
        "drill_version": build(
            "SELECT platform, app_version, CAST(SUM(pay_attempts) AS BIGINT) AS attempts, CAST(SUM(pay_success) AS BIGINT) AS success, "
            f"CAST(SUM(pay_fail) AS BIGINT) AS fails, {R(DIV('SUM(pay_success)', 'SUM(pay_attempts)'), 4)} AS success_rate, "
            f"{FROM_CENTS('SUM(' + CENTS('revenue') + ')')} AS revenue FROM kpi_win GROUP BY platform, app_version",
            ["kpi_win"]),
        "drill_region": build(
            "SELECT platform, app_version, region, CAST(SUM(pay_attempts) AS BIGINT) AS attempts, "
            "CAST(SUM(pay_success) AS BIGINT) AS success, CAST(SUM(pay_fail) AS BIGINT) AS fails, "
            f"{R(DIV('SUM(pay_success)', 'SUM(pay_attempts)'), 4)} AS success_rate FROM kpi_win GROUP BY ALL "
            "ORDER BY success_rate ASC NULLS LAST, platform ASC NULLS LAST, app_version ASC NULLS LAST, region ASC NULLS LAST LIMIT 10",
            ["kpi_win"]),
        "drill_provider": build(
            "SELECT platform, app_version, region, provider, CAST(SUM(pay_attempts) AS BIGINT) AS attempts, "
            f"CAST(SUM(pay_fail) AS BIGINT) AS fails, {R(DIV('SUM(pay_fail)', 'SUM(pay_attempts)'), 4)} AS fail_rate "
            f"FROM kpi_win GROUP BY ALL ORDER BY fail_rate DESC NULLS LAST, {KEYS4} LIMIT 10", ["kpi_win"]),
        "drill_all": build(
            "SELECT CAST(CASE WHEN GROUPING(region) = 1 THEN 2 WHEN GROUPING(provider) = 1 THEN 3 ELSE 4 END AS INTEGER) AS drill_level, "
            "platform, app_version, region, provider, CAST(SUM(pay_attempts) AS BIGINT) AS attempts, "
            "CAST(SUM(pay_success) AS BIGINT) AS success, CAST(SUM(pay_fail) AS BIGINT) AS fails, "
            f"{R(DIV('SUM(pay_success)', 'SUM(pay_attempts)'), 4)} AS success_rate, "
            f"{R(DIV('SUM(pay_fail)', 'SUM(pay_attempts)'), 4)} AS fail_rate, "
            f"{FROM_CENTS('SUM(' + CENTS('revenue') + ')')} AS revenue FROM kpi_win "
            "GROUP BY GROUPING SETS ((platform, app_version), (platform, app_version, region), "
            "(platform, app_version, region, provider))", ["kpi_win"]),
        "top_errors": build(
            "SELECT platform, app_version, region, provider, error_code, CAST(COUNT(*) AS BIGINT) AS error_count FROM pay_win "
            f"WHERE payment_status = 'fail' GROUP BY ALL ORDER BY error_count DESC, {KEYS5} LIMIT 15", ["pay_win"]),
        "top_errors_prev_day": build(
            "SELECT platform, app_version, region, provider, error_code, CAST(COUNT(*) AS BIGINT) AS error_count FROM pay_prev "
            f"WHERE payment_status = 'fail' GROUP BY ALL ORDER BY error_count DESC, {KEYS5} LIMIT 15", ["pay_prev"]),
        "error_delta": build("SELECT *, error_count - prev_error_count AS delta FROM err_now_prev", ["err_now_prev"]),
        "segment_vs_rest": build(
            "SELECT bucket_5m, affected_fails, affected_attempts, healthy_fails, healthy_attempts, "
            f"{DIV('affected_fails', 'greatest(affected_attempts, 1)')} AS affected_fail_rate, "
            f"{DIV('healthy_fails', 'greatest(healthy_attempts, 1)')} AS healthy_fail_rate FROM ("
            "SELECT bucket_5m, "
            "CAST(SUM(CASE WHEN platform = 'iOS' AND app_version = '1.2.7' AND region = 'ASIA' THEN pay_fail ELSE 0 END) AS BIGINT) AS affected_fails, "
            "CAST(SUM(CASE WHEN platform = 'iOS' AND app_version = '1.2.7' AND region = 'ASIA' THEN pay_attempts ELSE 0 END) AS BIGINT) AS affected_attempts, "
            "CAST(SUM(CASE WHEN NOT (platform = 'iOS' AND app_version = '1.2.7' AND region = 'ASIA') THEN pay_fail ELSE 0 END) AS BIGINT) AS healthy_fails, "
            "CAST(SUM(CASE WHEN NOT (platform = 'iOS' AND app_version = '1.2.7' AND region = 'ASIA') THEN pay_attempts ELSE 0 END) AS BIGINT) AS healthy_attempts "
            f"FROM kpi_5m WHERE {day} GROUP BY bucket_5m)", ["kpi_5m"]),
        "error_distribution": build(
            "SELECT error_code, CAST(COUNT(*) AS BIGINT) AS cnt FROM pay_win WHERE payment_status = 'fail' "
            "AND platform = 'iOS' AND app_version = '1.2.7' GROUP BY error_code", ["pay_win"]),
        "segment_fail_rate": build(_topk_fail_rate("pay_win", 10), ["pay_win"]),
        "errors_by_provider": build(
            "SELECT platform, app_version, provider, error_code, CAST(COUNT(*) AS BIGINT) AS cnt FROM pay_win "
            "WHERE payment_status = 'fail' GROUP BY ALL ORDER BY cnt DESC, platform ASC NULLS LAST, "
            "app_version ASC NULLS LAST, provider ASC NULLS LAST, error_code ASC NULLS LAST LIMIT 10", ["pay_win"]),
        "error_drill_users": build(
            "SELECT platform, app_version, region, provider, error_code, CAST(COUNT(*) AS BIGINT) AS error_count, "
            "CAST(COUNT(DISTINCT user_id) AS BIGINT) AS affected_users FROM pay_win WHERE payment_status = 'fail' "
            f"GROUP BY ALL ORDER BY error_count DESC, {KEYS5} LIMIT 5", ["pay_win"]),
        "sample_failures": build(
            "SELECT event_ts, user_id, provider, error_code, amount FROM pay_win WHERE payment_status = 'fail' "
            "AND platform = 'iOS' AND app_version = '1.2.7' ORDER BY event_ts, event_id LIMIT 5", ["pay_win"]),
        "top_error_codes": build(
            "SELECT error_code, CAST(COUNT(*) AS BIGINT) AS cnt FROM pay_win WHERE payment_status = 'fail' "
            "GROUP BY ALL ORDER BY cnt DESC, error_code ASC NULLS LAST LIMIT 5", ["pay_win"]),
        "fail_rate_by_platform": build(
            "SELECT CAST(event_ts AS DATE) AS dt, platform, CAST(COUNT(*) AS BIGINT) AS attempts, "
            "CAST(SUM(CASE WHEN payment_status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS fails, "
            f"{R(DIV('SUM(CASE WHEN payment_status = ' + chr(39) + 'fail' + chr(39) + ' THEN 1 ELSE 0 END)', 'COUNT(*)'), 4)} AS fail_rate "
            "FROM silver_payments GROUP BY ALL", ["silver_payments"]),
        "user_impact": build("SELECT * FROM user_impact", ["user_impact"]),
        "impact_summary": build("SELECT * FROM impact_summary", ["impact_summary"]),
        "attribution": build("SELECT * FROM attribution", ["attribution"]),
        "scorecard_fields": build("SELECT * FROM fields", ["fields"]),
        "incident_scorecard": build(
            f"SELECT g.incident_id, {_label('i.platform', 'i.app_version', 'i.region', 'i.provider', 'i.error_code')} AS root_cause, "
            f"{_label('a.detected_platform', 'a.detected_version', 'a.detected_region', 'a.detected_provider', 'a.detected_error')} AS detected_root_cause, "
            "g.matches, g.total_fields, CAST(round(g.matches * 100.0 / g.total_fields) AS INTEGER) AS accuracy, "
            f"CAST(round(g.matches * 100.0 / g.total_fields) AS INTEGER) >= {C.PASS_ACCURACY} AS passed "
            "FROM (SELECT incident_id, CAST(COUNT(*) FILTER (WHERE match) AS BIGINT) AS matches, "
            "CAST(COUNT(*) AS BIGINT) AS total_fields FROM fields GROUP BY incident_id) g "
            "JOIN incidents i ON i.incident_id = g.incident_id JOIN attribution a ON a.incident_id = g.incident_id",
            ["fields", "incidents", "attribution"]),
        "root_cause_label": build(
            f"SELECT incident_id, {_label('detected_platform', 'detected_version', 'detected_region', 'detected_provider', 'detected_error')} AS root_cause "
            "FROM attribution", ["attribution"]),
        "root_cause_rank": build(
            "SELECT * FROM ranked", ["ranked"]),
        "evidence_text": build("SELECT * FROM evidence", ["evidence"]),
        "evidence_bundle": build(
            "SELECT CAST(SUM(n_rows) AS BIGINT) AS n_rows, string_agg('## Evidence: ' || title || chr(10) || text, "
            "chr(10) || chr(10) ORDER BY section) AS evidence FROM evidence", ["evidence"]),
        "evidence_lines": build(_drill_lines(), ["pay_win"]),
        "alert_payload": build(_alert_payload(), ["impact_summary", "bounds", "alert_lines", "incidents", "fields"]),
        "parse_answer": build(
            "SELECT c.conv_id, c.turn, CAST(length(c.text) AS INTEGER) AS answer_chars, "
            "CASE WHEN j <> '' THEN 'json' ELSE 'fallback' END AS source, "
            "CASE WHEN j <> '' THEN json_valid(j) ELSE true END AS parse_ok, "
            "CASE WHEN j <> '' THEN CASE WHEN json_valid(j) THEN CAST(json_extract(j, '$.insights') AS VARCHAR[]) END "
            "ELSE [c.text] END AS insights, "
            + ", ".join(
                f"CASE WHEN j <> '' THEN CASE WHEN json_valid(j) THEN json_extract_string(j, '$.{f}') END "
                f"ELSE COALESCE((SELECT {src} FROM top_seg), 'unknown') END AS {f}"
                for f, src in [("detected_platform", "platform"), ("detected_version", "app_version"),
                               ("detected_region", "region"), ("detected_provider", "provider")])
            + ", CASE WHEN j <> '' THEN CASE WHEN json_valid(j) THEN json_extract_string(j, '$.detected_error') END "
            "ELSE COALESCE((SELECT error_code FROM top_err), 'unknown') END AS detected_error "
            "FROM (SELECT *, regexp_extract(text, '(?s)\\{.*\\}', 0) AS j FROM conversations WHERE role = 'assistant') c",
            ["top_seg", "top_err"]),
        "insight_lines": build(
            "SELECT conv_id, turn, n_insights, text FROM insights", ["insights"]),
        "insight_cards": build(
            f"SELECT conv_id, turn, {_card(_q('🤖 AI Agent: Root Cause Analysis'), _q('orange'), [_div('text')])} AS payload "
            "FROM insights", ["insights"]),
        "root_cause_card": build(
            "SELECT 'root_cause' AS kind, "
            + _card(_q('🤖 Root Cause Analysis'), _q('orange'), [
                _div("'**Anomaly**: ' || CAST(astart AS VARCHAR) || ' → ' || CAST(aend AS VARCHAR) || chr(10) || chr(10) || "
                     "(SELECT COALESCE(string_agg(printf('%d. %s (%d more failures than the day before, share %s, confidence %s)', "
                     "rank, label, excess, printf('%.4f', excess_share), confidence), chr(10) ORDER BY rank), '') FROM ranked)"),
                HR, _buttons([("🔬 Deep Dive", "primary", "drill_down"), ("📝 Generate Report", "default", "gen_report")])])
            + " AS payload FROM bounds WHERE astart IS NOT NULL AND aend IS NOT NULL", ["bounds", "ranked"]),
        "report_card": build(
            "SELECT 'report' AS kind, "
            + _card(_q("📋 Incident Report — Auto-Generated"), _q("green"), [
                _div("evidence"), HR,
                _div(f"'**Status**: ✅ Resolved' || chr(10) || '**Generated at**: {C.AS_OF.isoformat()}'"),
                _buttons([("📤 Export to Confluence", "primary", "export_confluence"), ("🔄 Regenerate", "default", "regenerate")])])
            + " AS payload FROM (SELECT string_agg('## Evidence: ' || title || chr(10) || text, chr(10) || chr(10) "
            "ORDER BY section) AS evidence FROM evidence)", ["evidence"]),
        "ingest_payments": build("SELECT *, CAST([] AS VARCHAR[]) AS rejected FROM silver_payments", ["silver_payments"]),
        "ingest_game_events": build("SELECT *, CAST([] AS VARCHAR[]) AS rejected FROM silver_game_events",
                                    ["silver_game_events"]),
        "silver_named": build("SELECT * FROM silver_payments", ["silver_payments"]),
        "incident_log": build(
            "SELECT *, row_number() OVER (ORDER BY incident_start DESC, incident_id DESC) = 1 AS latest FROM inc_log",
            ["inc_log"]),
        "parse_answer_json": build(_answers(), ["inc_log"]),
        "fail_rate_per_platform": build(
            "SELECT platform, CAST(COUNT(*) AS BIGINT) AS attempts, "
            "CAST(COUNT(*) FILTER (WHERE payment_status = 'fail') AS BIGINT) AS fails, "
            + R(DIV("COUNT(*) FILTER (WHERE payment_status = 'fail')", "COUNT(*)"), 4)
            + " AS fail_rate FROM silver_payments GROUP BY platform", ["silver_payments"]),
        "gold_named_summary": build(
            f"SELECT metric, CAST(COUNT(*) AS BIGINT) AS anomaly_count, MIN(bucket_5m) AS first_anomaly, "
            f"MAX(bucket_5m) AS last_anomaly, round(SUM(impact_estimated), 2) AS total_estimated_impact "
            f"FROM {a} WHERE is_anomaly GROUP BY metric", [a]),
        "refresh_gold": build(f"SELECT * FROM {a}", [a]),
        "gold_stream": build(f"SELECT * FROM {a}", [a]),
        "sink_overwrite": build("SELECT * FROM silver_payments", ["silver_payments"]),
        "sink_append": build("SELECT * FROM silver_payments", ["silver_payments"]),
        "kpi_5m_stream": build("SELECT * FROM kpi_5m", ["kpi_5m"]),
    }
    return q


CTES["alert_lines"] = (_drill_lines(), ["pay_win"])
CTES["top_seg"] = (_topk_fail_rate("pay_win", 1), ["pay_win"])
CTES["top_err"] = ("SELECT error_code FROM pay_win WHERE payment_status = 'fail' GROUP BY ALL "
                   "ORDER BY COUNT(*) DESC, error_code ASC NULLS LAST LIMIT 1", ["pay_win"])
CTES["ranked"] = (
    "SELECT CAST(row_number() OVER (ORDER BY excess DESC, error_count DESC, "
    f"{KEYS5}) AS INTEGER) AS rank, platform, app_version, region, provider, error_code, error_count, prev_error_count, excess, "
    f"{R('CAST(excess AS DOUBLE) / CAST(total AS DOUBLE)', 4)} AS excess_share, "
    f"CASE WHEN {R('CAST(excess AS DOUBLE) / CAST(total AS DOUBLE)', 4)} >= 0.5 THEN 'High' "
    f"WHEN {R('CAST(excess AS DOUBLE) / CAST(total AS DOUBLE)', 4)} >= 0.2 THEN 'Medium' ELSE 'Low' END AS confidence, "
    f"{_label('platform', 'app_version', 'region', 'provider', 'error_code')} AS label FROM ("
    "SELECT *, error_count - prev_error_count AS excess, "
    "(SELECT SUM(error_count - prev_error_count) FROM err_now_prev WHERE error_count - prev_error_count > 0) AS total "
    f"FROM err_now_prev WHERE error_count - prev_error_count > 0 ORDER BY excess DESC, error_count DESC, {KEYS5} LIMIT 3)", ["err_now_prev"])
CTES["insights"] = ("""
        SELECT conv_id, turn, CAST(len(ins) AS INTEGER) AS n_insights,
          array_to_string([printf('• Root Cause #%d: %s', i, ins[i]) FOR i IN range(1, len(ins) + 1)], chr(10)) AS text
        FROM (SELECT conv_id, turn, COALESCE(CASE WHEN j = '' THEN [text] WHEN json_valid(j)
                THEN CAST(json_extract(j, '$.insights') AS VARCHAR[]) END, CAST([] AS VARCHAR[])) AS ins
              FROM (SELECT *, regexp_extract(text, '(?s)\\{.*\\}', 0) AS j FROM conversations WHERE role = 'assistant'))""",
                    [])
CTES["inc_log"] = (f"""
        SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(hour AS DATE)) AS INTEGER) AS incident_id,
          platform, app_version, region, provider, error_code, {R(DIV('fails', 'attempts'), 4)} AS fail_rate,
          hour AS incident_start, hour + INTERVAL 3599 SECOND AS incident_end, CAST(NULL AS INTEGER) AS rows_inserted
        FROM (
          SELECT *, row_number() OVER (PARTITION BY CAST(hour AS DATE) ORDER BY fails DESC, hour, platform NULLS FIRST,
            app_version NULLS FIRST, region NULLS FIRST, provider NULLS FIRST) AS rn
          FROM (
            SELECT date_trunc('hour', event_ts) AS hour, platform, app_version, region, provider,
              COUNT(*) FILTER (WHERE payment_status = 'fail') AS fails, COUNT(*) AS attempts,
              MIN(error_code) FILTER (WHERE payment_status = 'fail') AS error_code
            FROM silver_payments WHERE event_ts IS NOT NULL GROUP BY ALL)
          WHERE fails > 0)
        WHERE rn = 1""", ["silver_payments"])
