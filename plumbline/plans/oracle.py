"""Plain SQL for every catalogue query, written independently of the operators.

Rules are stated over the given tables with joins and subqueries where the
operators use windows, and integers (cents) where they use decimals.
"""

from __future__ import annotations

from plumbline.plans import derived as d

ORACLE: dict[str, str] = {}

SENTINEL = "TIMESTAMP '9999-12-31 23:59:59'"
EXPIRED_AT = "TIMESTAMP '2002-06-01 12:00:00'"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def _values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns}) WHERE ended IS NULL"


_M = """
SELECT event_id, user_id, ts,
  CASE event_type
    WHEN 'purchase' THEN 'lob=retail/src_sys_nm=alpha/dataset=purchase'
    WHEN 'click'    THEN 'lob=retail/src_sys_nm=alpha/dataset=click'
    WHEN 'view'     THEN 'lob=commercial/src_sys_nm=beta/dataset=view'
    WHEN 'signup'   THEN 'lob=commercial/src_sys_nm=gamma/dataset=signup'
    ELSE 'src_sys_nm=omni/dataset=error' END AS dataset_name,
  CAST(ts AS DATE) AS partition_date,
  CASE WHEN event_id % 11 = 0 OR (event_type = 'error' AND CAST(ts AS DATE) = DATE '2024-01-20')
       THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN '   '
       WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS tag,
  CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN ts + INTERVAL 40 DAY
       WHEN event_type = 'view' AND event_id % 8 = 0 THEN ts - INTERVAL 4000 DAY
       ELSE ts END AS event_ts,
  CASE WHEN event_id % 5 = 0 THEN 'junk' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
    AS source_event_timestamp,
  '{"' || CASE event_type WHEN 'click' THEN 'clicks' ELSE 'amount' END || '": ' || CAST(event_id % 100 AS VARCHAR)
    || ', "details": {"price": ' || CASE event_type WHEN 'error' THEN '"none"' ELSE CAST(event_id % 17 AS VARCHAR) END
    || ', "code": "X"}}' AS event_attribute,
  props
FROM events"""

_RUNS_ALL = f"""
SELECT *, CASE WHEN dqs_score IS NULL THEN 'UNKNOWN' WHEN dqs_score >= 80 THEN 'PASS'
               WHEN dqs_score >= 50 THEN 'WARN' ELSE 'FAIL' END AS check_status,
       CAST(dqs_score * 100 AS BIGINT) AS cents
FROM (
  SELECT o_orderkey AS run_id,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE 'lob=' || lower(c_mktsegment) || '/' END
      || CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE 'src_sys_nm=' || lower(n_name) || '/' END
      || 'dataset=c' || CAST(c_custkey AS VARCHAR) AS dataset_name,
    CAST(o_orderdate AS DATE) AS partition_date,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'LOB_LEGACY'
         WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE 'LOB_' || c_mktsegment END AS lookup_code,
    CASE WHEN o_orderkey % 29 <> 0
         THEN CAST((3000 + (o_orderkey * 7919) % 7001) / 100.0 AS DECIMAL(5,2)) END AS dqs_score,
    CAST(o_orderkey % 7 AS INTEGER) AS rerun_number,
    CASE WHEN c_mktsegment <> 'FURNITURE'
         THEN CAST(c_nationkey AS BIGINT) * 10000 + year(o_orderdate) END AS orchestration_run_id,
    CASE WHEN o_orderkey % 50 = 0 THEN 'late delivery' END AS error_message,
    CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 48 AS INTEGER))
      + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS create_date,
    CASE WHEN o_orderkey % 10 = 3 THEN TIMESTAMP '2002-01-01 00:00:00' ELSE {SENTINEL} END AS expiry_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

_LINES = """
SELECT l_orderkey, l_linenumber, MAX(l_quantity) AS qty, MAX(l_tax) AS tax,
       MAX(l_returnflag) AS flag, MAX(l_linestatus) AS line_status
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

_LINE_EXPIRY = f"CASE WHEN tax > 0.07 THEN TIMESTAMP '2002-01-01 00:00:00' ELSE {SENTINEL} END AS expiry_date"

_NUMERICS_ALL = f"""
SELECT l_orderkey * 10 + l_linenumber AS metric_id, l_orderkey AS run_id,
  CASE l_linenumber WHEN 1 THEN 'FRESHNESS' WHEN 2 THEN 'VOLUME' WHEN 3 THEN 'SCHEMA' WHEN 4 THEN 'OPS'
    WHEN 5 THEN 'DISTRIBUTION' WHEN 6 THEN 'TIMESTAMP_SANITY' ELSE 'DQS_SCORE' END AS check_type,
  CASE l_linenumber WHEN 1 THEN 'hours_since_update' WHEN 2 THEN 'row_count'
    WHEN 3 THEN 'added_fields_count' WHEN 4 THEN 'null_rate_pct::value' WHEN 5 THEN 'order.value.mean'
    WHEN 6 THEN 'future_pct.event_ts' ELSE 'composite_score' END AS metric_name,
  CASE WHEN l_linenumber = 2 THEN qty * 1000 ELSE qty END AS metric_value, {_LINE_EXPIRY}
FROM lines"""

_DETAILS_ALL = f"""
SELECT l_orderkey * 10 + l_linenumber AS detail_id, l_orderkey AS run_id,
  CASE l_linenumber WHEN 1 THEN 'FRESHNESS' WHEN 2 THEN 'VOLUME' WHEN 3 THEN 'SCHEMA' WHEN 4 THEN 'OPS'
    WHEN 5 THEN 'SCHEMA' WHEN 6 THEN 'DQS_SCORE' ELSE 'BREAKING_CHANGE' END AS check_type,
  CASE l_linenumber WHEN 1 THEN 'freshness_status' WHEN 2 THEN 'volume_status'
    WHEN 3 THEN 'schema_status' WHEN 4 THEN 'ops_status' WHEN 5 THEN 'eventAttribute_format'
    WHEN 6 THEN 'dqs_score_breakdown' ELSE 'breaking_change_status' END AS detail_type,
  CASE WHEN l_linenumber = 5 THEN CASE WHEN code <= 4 THEN '"parquet"' WHEN code <= 6 THEN '"AVRO"' ELSE 'orc' END
       WHEN code = 5 THEN 'not json'
       ELSE '{{"status": "' || stat || '", "reason": "r' || CAST(code AS VARCHAR) || '"}}' END AS detail_value,
  CASE WHEN l_linenumber <> 5 AND code <> 5 THEN stat END AS detail_status, {_LINE_EXPIRY}
FROM (SELECT *, CAST(qty AS INTEGER) % 8 AS code,
        CASE WHEN CAST(qty AS INTEGER) % 8 <= 3 THEN 'PASS' WHEN CAST(qty AS INTEGER) % 8 <= 5 THEN 'WARN'
             WHEN CAST(qty AS INTEGER) % 8 = 6 THEN 'FAIL' ELSE 'NOT_RUN' END AS stat
      FROM lines)"""

CTE = {
    "m": _M,
    "runs_all": _RUNS_ALL,
    "runs": f"SELECT * FROM runs_all WHERE expiry_date = {SENTINEL}",
    "lines": _LINES,
    "numerics_all": _NUMERICS_ALL,
    "numerics": f"SELECT * FROM numerics_all WHERE expiry_date = {SENTINEL}",
    "details_all": _DETAILS_ALL,
    "details": f"SELECT * FROM details_all WHERE expiry_date = {SENTINEL}",
    "config": _values(
        d.CHECK_CONFIG, "id, dataset_pattern, check_type, enabled, explosion_level, ended"
    ) + " AND enabled",
    "enrichment": _values(
        d.ENRICHMENT,
        "id, dataset_pattern, lookup_code, custom_weights, sla_hours, explosion_level, ended",
    ),
    "lob_lookup": _values(d.LOB_LOOKUP, "id, lookup_code, lob_name, owner, classification, ended"),
    "names": "SELECT dataset_name FROM m UNION SELECT dataset_name FROM runs_all",
    "history": """
SELECT dataset_name, partition_date, check_type, metric_name, metric_value FROM (
  SELECT r.dataset_name, r.partition_date, n.check_type, n.metric_name, n.metric_value,
         ROW_NUMBER() OVER (PARTITION BY r.dataset_name, r.partition_date, n.check_type, n.metric_name
                            ORDER BY r.rerun_number DESC, r.run_id DESC) AS rn
  FROM numerics n JOIN runs r ON n.run_id = r.run_id) WHERE rn = 1""",
    "latest": """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name
    ORDER BY partition_date DESC, rerun_number DESC, run_id DESC) AS rn
  FROM runs WHERE lookup_code IS NOT NULL) WHERE rn = 1""",
    "latest_any": """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name
    ORDER BY partition_date DESC, rerun_number DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1""",
    "newest": "SELECT MAX(partition_date) AS d FROM runs",
    "yearly": "SELECT * REPLACE (CAST(date_trunc('year', partition_date) AS DATE) AS partition_date) FROM runs",
    "newest_year": "SELECT MAX(partition_date) AS d FROM yearly",
    "src": """
SELECT *, CASE WHEN trim(x) <> '' THEN x END AS src_sys_nm, CASE WHEN trim(y) <> '' THEN y END AS src_group
FROM (SELECT *, regexp_extract(dataset_name, 'src_sys_nm=([^/]*)', 1) AS x,
        regexp_extract(dataset_name, 'src_sys_nm=([^/]+)/', 1) AS y FROM runs)""",
    "pairs": "SELECT DISTINCT dataset_name, partition_date, src_sys_nm FROM src",
    "day_runs": """
SELECT run_id, dataset_name, partition_date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name, partition_date
                               ORDER BY rerun_number DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1""",
    "fields": """
SELECT r.run_id, r.dataset_name, r.partition_date, 'f' || CAST(l_linenumber AS VARCHAR) AS field_path,
  'type=' || CASE flag WHEN 'A' THEN 'bigint' WHEN 'N' THEN 'double' ELSE 'string' END
    || ',nullable=' || CASE line_status WHEN 'O' THEN 'true' ELSE 'false' END AS descriptor
FROM lines JOIN day_runs r ON l_orderkey = r.run_id""",
    "headers": """
SELECT dataset_name, partition_date, 'sha256:' || sha256(stored) AS schema_hash,
  CASE WHEN run_id % 9 = 0 THEN NULL WHEN run_id % 13 = 0 THEN '"text"' ELSE stored END AS schema_json
FROM (SELECT run_id, dataset_name, partition_date,
        '{"type": "struct", "fields": "' || string_agg(field_path || ':' || descriptor, ';'
           ORDER BY field_path || ':' || descriptor) || '"}' AS stored
      FROM fields GROUP BY run_id, dataset_name, partition_date)""",
    "chain": """
SELECT h.*, b.partition_date AS baseline_date, b.schema_hash AS baseline_hash, b.schema_json AS baseline_json
FROM headers h LEFT JOIN headers b ON b.dataset_name = h.dataset_name
 AND b.partition_date = (SELECT MAX(p.partition_date) FROM headers p
                         WHERE p.dataset_name = h.dataset_name AND p.partition_date < h.partition_date)""",
    "drift": """
SELECT COALESCE(a.dataset_name, b.dataset_name) AS dataset_name,
  COALESCE(a.partition_date, b.partition_date) AS partition_date,
  COALESCE(a.field_path, b.field_path) AS field_path, b.descriptor AS before, a.descriptor AS after,
  CASE WHEN b.field_path IS NULL THEN 'added' WHEN a.field_path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT f.dataset_name, f.partition_date, f.field_path, f.descriptor FROM fields f
      JOIN chain c USING (dataset_name, partition_date) WHERE c.baseline_date IS NOT NULL) a
FULL OUTER JOIN
     (SELECT c.dataset_name, c.partition_date, f.field_path, f.descriptor FROM fields f
      JOIN chain c ON c.dataset_name = f.dataset_name AND c.baseline_date = f.partition_date) b
  ON a.dataset_name = b.dataset_name AND a.partition_date = b.partition_date AND a.field_path = b.field_path
WHERE a.descriptor IS DISTINCT FROM b.descriptor""",
    "counts": "SELECT dataset_name, partition_date, COUNT(*) AS row_count FROM m GROUP BY ALL",
    "stale": """
SELECT dataset_name, partition_date, latest_event,
  CASE WHEN latest_event IS NOT NULL THEN
    GREATEST(0, floor(epoch(CAST(partition_date AS TIMESTAMP) + INTERVAL 30 HOUR) - epoch(latest_event)))
      / CAST(3600 AS DOUBLE) END AS hours_since_update
FROM (SELECT dataset_name, partition_date, MAX(TRY_CAST(source_event_timestamp AS TIMESTAMP)) AS latest_event
      FROM m GROUP BY ALL)""",
    "rates": """
SELECT dataset_name, partition_date, column_name, column_ordinal, row_count, null_count, blank_count,
  CAST(100 AS DOUBLE) * null_count / row_count AS null_rate_pct,
  CAST(100 AS DOUBLE) * blank_count / row_count AS empty_rate_pct
FROM (
  SELECT dataset_name, partition_date, 'event_id' AS column_name, 0 AS column_ordinal, COUNT(*) AS row_count,
    COUNT(*) - COUNT(event_id) AS null_count, CAST(NULL AS BIGINT) AS blank_count FROM m GROUP BY ALL
  UNION ALL SELECT dataset_name, partition_date, 'user_id', 1, COUNT(*),
    COUNT(*) - COUNT(user_id), CAST(NULL AS BIGINT) FROM m GROUP BY ALL
  UNION ALL SELECT dataset_name, partition_date, 'value', 2, COUNT(*),
    COUNT(*) - COUNT(value), CAST(NULL AS BIGINT) FROM m GROUP BY ALL
  UNION ALL SELECT dataset_name, partition_date, 'tag', 3, COUNT(*),
    COUNT(*) - COUNT(tag), COUNT(*) FILTER (WHERE trim(tag) = '') FROM m GROUP BY ALL
  UNION ALL SELECT dataset_name, partition_date, 'event_ts', 4, COUNT(*),
    COUNT(*) - COUNT(event_ts), CAST(NULL AS BIGINT) FROM m GROUP BY ALL
  UNION ALL SELECT dataset_name, partition_date, 'source_event_timestamp', 5, COUNT(*),
    COUNT(*) - COUNT(source_event_timestamp), COUNT(*) FILTER (WHERE trim(source_event_timestamp) = '') FROM m GROUP BY ALL
  UNION ALL SELECT dataset_name, partition_date, 'event_attribute', 6, COUNT(*),
    COUNT(*) - COUNT(event_attribute), COUNT(*) FILTER (WHERE trim(event_attribute) = '') FROM m GROUP BY ALL
  UNION ALL SELECT dataset_name, partition_date, 'props', 7, COUNT(*),
    COUNT(*) - COUNT(props), COUNT(*) FILTER (WHERE trim(props) = '') FROM m GROUP BY ALL)""",
    "stats": """
SELECT dataset_name, partition_date, column_path, COALESCE(AVG(v), 0) AS mean,
  COALESCE(STDDEV_POP(v), 0) AS stddev, COALESCE(QUANTILE_DISC(v, 0.5), 0) AS p50,
  COALESCE(QUANTILE_DISC(v, 0.95), 0) AS p95, COUNT(v) AS sample_count
FROM (SELECT dataset_name, partition_date, 'event_id' AS column_path, CAST(event_id AS DOUBLE) AS v FROM m
      UNION ALL SELECT dataset_name, partition_date, 'user_id', CAST(user_id AS DOUBLE) FROM m
      UNION ALL SELECT dataset_name, partition_date, 'value', value FROM m)
GROUP BY dataset_name, partition_date, column_path""",
    "ts_counts": """
SELECT dataset_name, partition_date, 'event_ts' AS column_name, COUNT(event_ts) AS non_null_rows,
  COUNT(*) FILTER (WHERE event_ts > CAST(partition_date AS TIMESTAMP) + INTERVAL 1 DAY) AS future_count,
  COUNT(*) FILTER (WHERE event_ts < CAST(partition_date AS TIMESTAMP) - INTERVAL 10 YEAR) AS stale_count
FROM m GROUP BY ALL""",
    "ts_judged": """
SELECT *, CASE WHEN non_null_rows = 0 THEN 0 ELSE CAST(future_count AS DOUBLE) / non_null_rows END AS future_pct,
  CASE WHEN non_null_rows = 0 THEN 0 ELSE CAST(stale_count AS DOUBLE) / non_null_rows END AS stale_pct
FROM ts_counts""",
    "targets": "SELECT DISTINCT dataset_name, partition_date FROM runs_all WHERE partition_date >= DATE '2001-01-01'",
    "expired_ids": "SELECT run_id FROM runs JOIN targets USING (dataset_name, partition_date)",
}

# which named queries each one reads
NEEDS = {
    "runs": ["runs_all"], "numerics_all": ["lines"], "numerics": ["numerics_all"],
    "details_all": ["lines"], "details": ["details_all"], "names": ["m", "runs_all"],
    "history": ["numerics", "runs"], "latest": ["runs"], "latest_any": ["runs"], "newest": ["runs"],
    "yearly": ["runs"], "newest_year": ["yearly"],
    "src": ["runs"], "pairs": ["src"], "day_runs": ["runs"], "fields": ["lines", "day_runs"],
    "headers": ["fields"], "chain": ["headers"], "drift": ["fields", "chain"], "counts": ["m"],
    "stale": ["m"], "rates": ["m"], "stats": ["m"], "ts_counts": ["m"], "ts_judged": ["ts_counts"],
    "targets": ["runs_all"], "expired_ids": ["runs", "targets"],
}


def sql(reads: str, body: str) -> str:
    """Prefix ``body`` with the named queries it reads, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in reads.split():
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in ordered)
    body = body.strip()
    if not head:
        return body
    for own in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(own):
            return f"{own}{head},\n{body[len(own):]}"
    return f"WITH {head}\n{body}"


def oracle(name: str, reads: str, body: str) -> None:
    ORACLE[name] = sql(reads, body)


def near(expr: str, digits: int = 4) -> str:
    return f"ROUND({expr} + 1e-9, {digits})"


def average(cents: str, digits: int = 2) -> str:
    """Half-up average of non-negative cents; NULL without values."""
    step = 10 ** (2 - digits)
    s, n = f"CAST(SUM({cents}) AS BIGINT)", f"(COUNT({cents}) * {step})"
    return (
        f"CASE WHEN COUNT({cents}) > 0 THEN CAST((2 * {s} + {n}) // (2 * {n}) AS DOUBLE) "
        f"/ {10 ** digits} END"
    )


def rolling(source: str, key: str, value: str, keep: str) -> str:
    """``keep`` columns of ``source`` with statistics of the 30 earlier rows of the key."""
    same = " AND ".join(f"p.{k} = c.{k}" for k in key.split())
    return f"""
SELECT {keep}, AVG(v) AS baseline_mean, STDDEV_POP(v) AS baseline_stddev, COUNT(v) AS baseline_count
FROM (SELECT c.*, CAST(p.{value} AS DOUBLE) AS v,
        ROW_NUMBER() OVER (PARTITION BY {', '.join('c.' + k for k in key.split())}, c.partition_date
                           ORDER BY p.partition_date DESC) AS age
      FROM {source} c LEFT JOIN {source} p ON {same} AND p.partition_date < c.partition_date)
WHERE age <= 30 GROUP BY ALL"""


BASE = f"{near('baseline_mean')} AS baseline_mean, {near('baseline_stddev')} AS baseline_stddev, baseline_count"


def banded(n: str, deviation: str, warn: str, fail: str, first=("FALSE", "", "")) -> str:
    condition, first_status, first_reason = first
    status = (
        f"CASE WHEN {condition} THEN '{first_status}' WHEN {n} < 2 THEN 'PASS' WHEN {deviation} <= {warn} THEN 'PASS' "
        f"WHEN {deviation} <= {fail} THEN 'WARN' ELSE 'FAIL' END AS status"
    )
    reason = (
        f"CASE WHEN {condition} THEN '{first_reason}' WHEN {n} < 2 THEN 'baseline_unavailable' "
        f"WHEN {deviation} <= {warn} THEN 'within_baseline' "
        f"WHEN {deviation} <= {fail} THEN 'above_warn_threshold' ELSE 'above_fail_threshold' END AS reason"
    )
    return f"{status}, {reason}"


# ---- monitored rows ---------------------------------------------------------

oracle("chk_volume_rowcount", "counts", "SELECT * FROM counts")

_VOLUME = banded(
    "baseline_count", "ABS(row_count - baseline_mean)",
    "GREATEST(baseline_stddev, 1, baseline_mean * CAST(0.05 AS DOUBLE))",
    "GREATEST(2 * baseline_stddev, 1, baseline_mean * CAST(0.10 AS DOUBLE))",
)
oracle("chk_volume_status", "counts", f"""
SELECT dataset_name, partition_date, row_count,
  CASE WHEN baseline_count >= 2 AND baseline_mean > 0
       THEN {near('(row_count - baseline_mean) / baseline_mean * 100')} ELSE 0 END AS pct_change,
  {near('COALESCE(baseline_stddev, 0)')} AS row_count_stddev, {BASE}, {_VOLUME}
FROM ({rolling('counts', 'dataset_name', 'row_count', 'dataset_name, partition_date, row_count')})""")

oracle("chk_zero_row", "", """
WITH o AS (SELECT 'src_sys_nm=n' || CAST(c_nationkey AS VARCHAR) AS dataset_name,
             CAST(o_orderdate AS DATE) AS partition_date
           FROM orders JOIN customer ON o_custkey = c_custkey),
span AS (SELECT n.dataset_name, (SELECT MIN(partition_date) FROM o) AS a, (SELECT MAX(partition_date) FROM o) AS b
         FROM (SELECT DISTINCT dataset_name FROM o) n),
expected AS (SELECT dataset_name, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS partition_date FROM span)
SELECT e.dataset_name, e.partition_date, COUNT(o.dataset_name) AS row_count,
  CASE WHEN COUNT(o.dataset_name) = 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN COUNT(o.dataset_name) = 0 THEN 'zero_rows' ELSE 'has_rows' END AS reason
FROM expected e LEFT JOIN o ON o.dataset_name = e.dataset_name AND o.partition_date = e.partition_date
GROUP BY 1, 2""")

oracle("chk_freshness_hours", "stale", "SELECT * FROM stale")

_FRESH = banded(
    "baseline_count", "hours_since_update",
    "baseline_mean + GREATEST(baseline_stddev, CAST(0.5 AS DOUBLE))",
    "baseline_mean + GREATEST(2 * baseline_stddev, 1)",
    ("hours_since_update IS NULL", "NOT_RUN", "no_parseable_timestamps"),
)
oracle("chk_freshness_status", "stale", f"""
SELECT dataset_name, partition_date, latest_event, hours_since_update, {BASE}, {_FRESH}
FROM ({rolling('stale', 'dataset_name', 'hours_since_update',
               'dataset_name, partition_date, latest_event, hours_since_update')})""")

oracle("chk_ops_null_rate", "rates", """
SELECT dataset_name, partition_date, column_name, row_count, null_count, null_rate_pct FROM rates""")
oracle("chk_ops_empty_rate", "rates", """
SELECT dataset_name, partition_date, column_name, row_count, blank_count, empty_rate_pct
FROM rates WHERE column_name IN ('tag', 'source_event_timestamp', 'event_attribute', 'props')""")

_NULL_RATE = banded(
    "baseline_count", "null_rate_pct", "baseline_mean + GREATEST(baseline_stddev, 1)",
    "baseline_mean + GREATEST(2 * baseline_stddev, 5)", ("null_rate_pct = 100", "FAIL", "all_null_column"),
)
_OPS = f"""
SELECT *, CASE WHEN reason = 'all_null_column' THEN 'critical' WHEN status = 'FAIL' THEN 'fail'
               WHEN status = 'WARN' THEN 'warn' END AS severity
FROM (SELECT *, {_NULL_RATE} FROM ({rolling('rates', 'dataset_name column_name', 'null_rate_pct',
  'dataset_name, partition_date, column_name, column_ordinal, null_rate_pct')}))"""
oracle("chk_ops_anomalies", "rates", f"""
SELECT dataset_name, partition_date, column_name, null_rate_pct, {BASE}, severity, status, reason
FROM ({_OPS}) WHERE severity IS NOT NULL""")
oracle("chk_ops_status", "rates", f"""
SELECT dataset_name, partition_date, COUNT(*) AS total_columns, COUNT(severity) AS flagged_columns,
  CAST(SUM(baseline_count) AS BIGINT) AS baseline_sample_count,
  CASE WHEN bool_or(severity IN ('critical', 'fail')) THEN 'FAIL' WHEN COUNT(severity) > 0 THEN 'WARN'
       ELSE 'PASS' END AS status,
  CASE WHEN bool_or(severity = 'critical') THEN 'all_null_column'
       WHEN bool_or(severity = 'fail') THEN 'above_fail_threshold'
       WHEN bool_or(severity = 'warn') THEN 'above_warn_threshold'
       WHEN MAX(baseline_count) < 2 THEN 'baseline_unavailable' ELSE 'within_baseline' END AS reason
FROM ({_OPS}) GROUP BY 1, 2""")

oracle("chk_dist_stats", "stats", f"""
SELECT dataset_name, partition_date, column_path, {near('mean')} AS mean, {near('stddev')} AS stddev,
  sample_count FROM stats""")
oracle("chk_dist_percentiles", "stats", "SELECT dataset_name, partition_date, column_path, p50, p95 FROM stats")

_SHIFT = """
SELECT s.*, b.mean AS baseline_mean, b.stddev AS baseline_stddev,
  CASE WHEN b.stddev = 0 THEN ABS(s.mean - b.mean) ELSE ABS((s.mean - b.mean) / b.stddev) END AS z_score
FROM stats s LEFT JOIN stats b ON b.dataset_name = s.dataset_name AND b.column_path = s.column_path
 AND b.partition_date = (SELECT MAX(p.partition_date) FROM stats p WHERE p.dataset_name = s.dataset_name
                         AND p.column_path = s.column_path AND p.partition_date < s.partition_date)"""
_SHIFT_JUDGED = f"""
SELECT *, CASE WHEN baseline_mean IS NULL THEN 'PASS'
    WHEN baseline_stddev = 0 THEN CASE WHEN mean = baseline_mean THEN 'PASS' ELSE 'WARN' END
    WHEN z_score > 3 THEN 'FAIL' WHEN z_score > 2 THEN 'WARN' ELSE 'PASS' END AS status
FROM ({_SHIFT})"""
oracle("chk_dist_shift", "stats", f"""
SELECT dataset_name, partition_date, column_path, {near('mean')} AS mean, {near('stddev')} AS stddev, sample_count,
  {near('baseline_mean')} AS baseline_mean, {near('baseline_stddev')} AS baseline_stddev,
  {near('z_score')} AS z_score, status,
  CASE WHEN baseline_mean IS NULL THEN 'baseline_unavailable'
       WHEN status = 'PASS' THEN 'within_baseline' ELSE 'distribution_shift_detected' END AS reason
FROM ({_SHIFT_JUDGED})""")
oracle("chk_dist_summary", "stats", f"""
SELECT dataset_name, partition_date,
  CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status,
  COUNT(*) AS total_columns_analyzed, COUNT(*) FILTER (WHERE status <> 'PASS') AS shifted_columns,
  CAST(NULL AS VARCHAR) AS reason
FROM ({_SHIFT_JUDGED}) GROUP BY 1, 2""")

oracle("json_top_level_paths", "m", """
SELECT DISTINCT dataset_name, 'event_attribute.' || k AS column_path
FROM (SELECT dataset_name, event_attribute AS j, unnest(json_keys(event_attribute)) AS k FROM m)
GROUP BY dataset_name, k
HAVING bool_and(json_type(j, '$.' || k) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL'))
   AND bool_or(json_type(j, '$.' || k) <> 'NULL')
UNION ALL
SELECT DISTINCT dataset_name, 'props.' || k AS column_path
FROM (SELECT dataset_name, props AS j, unnest(json_keys(props)) AS k FROM m)
GROUP BY dataset_name, k
HAVING bool_and(json_type(j, '$.' || k) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL'))
   AND bool_or(json_type(j, '$.' || k) <> 'NULL')""")
oracle("json_nested_paths", "m", """
WITH RECURSIVE walk(dataset_name, path, j) AS (
  SELECT dataset_name, 'event_attribute.' || k, json_extract(event_attribute, '$.' || k)
  FROM (SELECT dataset_name, event_attribute, unnest(json_keys(event_attribute)) AS k FROM m)
  UNION ALL
  SELECT dataset_name, 'props.' || k, json_extract(props, '$.' || k)
  FROM (SELECT dataset_name, props, unnest(json_keys(props)) AS k FROM m)
  UNION ALL
  SELECT dataset_name, path || '.' || k, json_extract(j, '$.' || k)
  FROM (SELECT dataset_name, path, j, unnest(json_keys(j)) AS k FROM walk WHERE json_type(j) = 'OBJECT'))
SELECT dataset_name, path AS column_path FROM walk GROUP BY 1, 2
HAVING bool_and(json_type(j) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL'))
   AND bool_or(json_type(j) <> 'NULL')""")

_JSON_VALUES = """
SELECT dataset_name, partition_date, 'event_attribute.amount' AS column_path, 1 AS depth,
  TRY_CAST(json_extract_string(event_attribute, '$.amount') AS DOUBLE) AS v
FROM m WHERE dataset_name NOT LIKE '%dataset=click'
UNION ALL SELECT dataset_name, partition_date, 'event_attribute.clicks', 1,
  TRY_CAST(json_extract_string(event_attribute, '$.clicks') AS DOUBLE) FROM m WHERE dataset_name LIKE '%dataset=click'
UNION ALL SELECT dataset_name, partition_date, 'event_attribute.details.price', 2,
  TRY_CAST(json_extract_string(event_attribute, '$.details.price') AS DOUBLE) FROM m WHERE dataset_name NOT LIKE '%dataset=error'
UNION ALL SELECT dataset_name, partition_date, 'props.k', 1,
  TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM m"""
for _name, _wanted in (
    ("chk_dist_json", "TRUE"),
    ("chk_dist_json_levels", "(dataset_name LIKE 'lob=commercial/%' OR dataset_name LIKE 'lob=retail/%' AND depth = 1)"),
):
    oracle(_name, "m", f"""
SELECT dataset_name, partition_date, column_path, {near('COALESCE(AVG(v), 0)')} AS mean,
  {near('COALESCE(STDDEV_POP(v), 0)')} AS stddev, COALESCE(QUANTILE_DISC(v, 0.5), 0) AS p50,
  COALESCE(QUANTILE_DISC(v, 0.95), 0) AS p95, COUNT(v) AS sample_count
FROM ({_JSON_VALUES}) WHERE {_wanted} GROUP BY 1, 2, 3""")

_TS_STATUS = """
CASE WHEN future_pct > CAST(0.05 AS DOUBLE) OR stale_pct > CAST(0.05 AS DOUBLE) THEN 'FAIL' ELSE 'PASS' END"""
oracle("chk_ts_sanity", "ts_judged", f"""
SELECT *, {_TS_STATUS} AS status,
  CASE WHEN future_pct > CAST(0.05 AS DOUBLE) AND stale_pct > CAST(0.05 AS DOUBLE)
         THEN 'future_timestamps_exceed_threshold_and_stale_timestamps_exceed_threshold'
       WHEN future_pct > CAST(0.05 AS DOUBLE) THEN 'future_timestamps_exceed_threshold'
       WHEN stale_pct > CAST(0.05 AS DOUBLE) THEN 'stale_timestamps_exceed_threshold' END AS reason
FROM ts_judged""")
oracle("chk_ts_sanity_summary", "ts_judged", f"""
SELECT dataset_name, partition_date, MIN(status) AS status, COUNT(*) AS total_columns_analyzed,
  COUNT(*) FILTER (WHERE status = 'FAIL') AS failed_columns, CAST(NULL AS VARCHAR) AS reason
FROM (SELECT *, {_TS_STATUS} AS status FROM ts_judged) GROUP BY 1, 2""")

_STRING_COLUMNS = ("tag", "source_event_timestamp", "event_attribute", "props")
_OTHER_COLUMNS = ("event_id", "user_id", "value", "event_ts")
_NULLS = " UNION ALL ".join(
    f"SELECT dataset_name, partition_date, 'OPS' AS check_type, 'null_rate_pct::{x}' AS metric_name, "
    f"CAST(100 AS DOUBLE) * (COUNT(*) - COUNT({x})) / COUNT(*) AS metric_value FROM m GROUP BY 1, 2"
    for x in (*_STRING_COLUMNS, *_OTHER_COLUMNS)
)
_BLANKS = " UNION ALL ".join(
    f"SELECT dataset_name, partition_date, 'OPS', 'empty_string_rate_pct::{x}', "
    f"CAST(100 AS DOUBLE) * COUNT(*) FILTER (WHERE trim({x}) = '') / COUNT(*) FROM m GROUP BY 1, 2"
    for x in _STRING_COLUMNS
)
_STATS_LONG = " UNION ALL ".join(
    f"SELECT dataset_name, partition_date, 'DISTRIBUTION' AS check_type, column_path || '.{name}' AS metric_name, "
    f"CAST({column} AS DOUBLE) AS metric_value FROM stats"
    for name, column in (("mean", "mean"), ("stddev", "stddev"), ("p50", "p50"), ("p95", "p95"), ("count", "sample_count"))
)
_ALL_METRICS = f"""
{_NULLS} UNION ALL {_BLANKS} UNION ALL {_STATS_LONG}
UNION ALL SELECT dataset_name, partition_date, 'VOLUME', 'row_count', CAST(row_count AS DOUBLE) FROM counts
UNION ALL SELECT dataset_name, partition_date, 'FRESHNESS', 'hours_since_update', hours_since_update FROM stale
UNION ALL SELECT dataset_name, partition_date, 'TIMESTAMP_SANITY', 'future_pct.event_ts', future_pct FROM ts_judged
UNION ALL SELECT dataset_name, partition_date, 'TIMESTAMP_SANITY', 'stale_pct.event_ts', stale_pct FROM ts_judged"""
oracle("profile_metrics", "stats counts stale ts_judged", f"""
SELECT dataset_name, partition_date, check_type, metric_name, {near('metric_value')} AS metric_value
FROM ({_ALL_METRICS})""")

oracle("profile_month_quantiles", "m", """
SELECT dataset_name, CAST(date_trunc('month', partition_date) AS DATE) AS month, column_path, COUNT(v) AS sample_count,
  COUNT(v) AS row_count, TRUE AS p50_close, TRUE AS p95_close
FROM (SELECT dataset_name, partition_date, unnest(['event_id', 'user_id', 'value']) AS column_path,
        unnest([CAST(event_id AS DOUBLE), CAST(user_id AS DOUBLE), value]) AS v FROM m)
GROUP BY 1, 2, 3 HAVING COUNT(v) > 0""")
oracle("profile_lineitem", "", f"""
SELECT 'src_sys_nm=s' || CAST(l_suppkey AS VARCHAR) AS dataset_name,
  CAST(date_trunc('year', l_shipdate) AS DATE) AS partition_date, column_path,
  {near('AVG(v)')} AS mean, {near('STDDEV_POP(v)')} AS stddev, QUANTILE_DISC(v, 0.5) AS p50,
  QUANTILE_DISC(v, 0.95) AS p95, COUNT(v) AS sample_count
FROM (SELECT l_suppkey, l_shipdate, 'l_quantity' AS column_path, l_quantity AS v FROM lineitem
      UNION ALL SELECT l_suppkey, l_shipdate, 'l_extendedprice', l_extendedprice FROM lineitem
      UNION ALL SELECT l_suppkey, l_shipdate, 'l_discount', l_discount FROM lineitem
      UNION ALL SELECT l_suppkey, l_shipdate, 'l_tax', l_tax FROM lineitem)
GROUP BY 1, 2, 3""")

# ---- history ----------------------------------------------------------------

# the second reads kept states instead of all history
for _name in ("hist_rolling_baseline", "hist_kept_baseline"):
    oracle(_name, "history", f"""
SELECT dataset_name, partition_date, check_type, metric_name, metric_value, {BASE}
FROM ({rolling('history', 'dataset_name check_type metric_name', 'metric_value',
               'dataset_name, partition_date, check_type, metric_name, metric_value')})""")
oracle("hist_latest_column_stats", "stats", f"""
SELECT s.dataset_name, s.partition_date, s.column_path, {near('b.mean')} AS baseline_mean,
  {near('b.stddev')} AS baseline_stddev, b.p50 AS baseline_p50, b.p95 AS baseline_p95,
  CAST(b.sample_count AS DOUBLE) AS baseline_count
FROM stats s JOIN stats b ON b.dataset_name = s.dataset_name AND b.column_path = s.column_path
 AND b.partition_date = (SELECT MAX(p.partition_date) FROM stats p WHERE p.dataset_name = s.dataset_name
                         AND p.column_path = s.column_path AND p.partition_date < s.partition_date)""")
oracle("hist_prev_schema", "chain", """
SELECT dataset_name, partition_date, schema_hash, baseline_date, baseline_hash, baseline_json FROM chain""")
oracle("chk_schema_hash", "headers", """
SELECT dataset_name, partition_date, schema_json, 'sha256:' || sha256(schema_json) AS schema_hash
FROM headers WHERE schema_json IS NOT NULL""")
oracle("chk_schema_drift", "drift", "SELECT * FROM drift")

_LISTED = ", ".join(
    f"COUNT(*) FILTER (WHERE change = '{k}') AS {k}_n, "
    f"COALESCE(string_agg(field_path, ',' ORDER BY field_path) FILTER (WHERE change = '{k}'), '') AS {k}_f"
    for k in ("added", "removed", "changed")
)
_KINDED = ", ".join(
    f"CASE WHEN kind = 'fields' THEN COALESCE({k}_n, 0) WHEN kind = 'hash' THEN {1 if k == 'changed' else 0} "
    f"ELSE 0 END AS {k}_count, CASE WHEN kind = 'fields' THEN COALESCE({k}_f, '') "
    f"WHEN kind = 'hash' THEN '{'$schema' if k == 'changed' else ''}' ELSE '' END AS {k}_fields"
    for k in ("added", "removed", "changed")
)
oracle("chk_schema_status", "chain drift", f"""
SELECT dataset_name, partition_date, schema_hash, baseline_hash, CAST(added_count AS BIGINT) AS added_count,
  CAST(removed_count AS BIGINT) AS removed_count, CAST(changed_count AS BIGINT) AS changed_count,
  added_fields, removed_fields, changed_fields,
  CASE WHEN removed_count + changed_count > 0 THEN 'FAIL' WHEN added_count > 0 THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN baseline_hash IS NULL THEN 'baseline_unavailable'
       WHEN removed_count + changed_count > 0 THEN 'schema_breaking_change'
       WHEN added_count > 0 THEN 'schema_additive_change' ELSE 'no_schema_drift' END AS reason
FROM (SELECT *, {_KINDED} FROM (
  SELECT c.*, x.*  EXCLUDE (dataset_name, partition_date),
    CASE WHEN c.baseline_hash IS NULL THEN 'none' WHEN c.baseline_hash = c.schema_hash THEN 'same'
         WHEN c.baseline_json IS NULL THEN 'hash' ELSE 'fields' END AS kind
  FROM chain c LEFT JOIN (SELECT dataset_name, partition_date, {_LISTED} FROM drift GROUP BY 1, 2) x
    ON x.dataset_name = c.dataset_name AND x.partition_date = c.partition_date))""")
oracle("chk_breaking_change", "chain drift", """
SELECT c.dataset_name, c.partition_date,
  CASE WHEN usable AND n > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN NOT usable THEN 'baseline_unavailable' WHEN n > 0 THEN 'breaking_changes_detected'
       ELSE 'no_breaking_changes' END AS reason,
  CASE WHEN usable THEN COALESCE(n, 0) ELSE 0 END AS removed_count,
  CASE WHEN usable THEN COALESCE(f, '') ELSE '' END AS removed_fields
FROM (SELECT *, COALESCE(baseline_json LIKE '{"type": "struct"%', FALSE) AS usable FROM chain) c
LEFT JOIN (SELECT dataset_name, partition_date, COUNT(*) AS n, string_agg(field_path, ',' ORDER BY field_path) AS f
           FROM drift WHERE change = 'removed' GROUP BY 1, 2) r
  ON r.dataset_name = c.dataset_name AND r.partition_date = c.partition_date""")

# ---- configuration ----------------------------------------------------------


def lowest(value: str, source: str, name: str, wanted: str) -> str:
    return (
        f"(SELECT e.{value} FROM {source} e WHERE {name} LIKE e.dataset_pattern AND {wanted} "
        f"ORDER BY e.id LIMIT 1)"
    )


oracle("cfg_enabled_checks", "names config", """
SELECT DISTINCT n.dataset_name, g.check_type FROM names n JOIN config g ON n.dataset_name LIKE g.dataset_pattern
WHERE g.check_type <> 'NOT_DEPLOYED'""")
oracle("cfg_lookup_enrichment", "names enrichment", f"""
SELECT raw_code, COALESCE({lowest('lookup_code', 'enrichment', "'src_sys_nm=' || raw_code", 'e.lookup_code IS NOT NULL')}, raw_code) AS lookup_code
FROM (SELECT DISTINCT regexp_extract(dataset_name, 'src_sys_nm=([^/]*)', 1) AS raw_code FROM names
      WHERE dataset_name LIKE '%src_sys_nm=%')""")
oracle("cfg_sla_hours", "names enrichment", f"""
SELECT * FROM (SELECT dataset_name,
  CAST({lowest('sla_hours', 'enrichment', 'dataset_name', 'e.sla_hours IS NOT NULL')} AS DOUBLE) AS sla_hours FROM names)
WHERE sla_hours IS NOT NULL""")
oracle("cfg_explosion_level", "names config", f"""
SELECT dataset_name, CASE WHEN l IN (0, 1, 2) THEN l ELSE 0 END AS explosion_level
FROM (SELECT dataset_name,
  {lowest('explosion_level', 'config', 'dataset_name', "e.check_type = 'DISTRIBUTION'")} AS l FROM names)""")

_WEIGHTS = f"""
SELECT dataset_name, w, k FROM (SELECT dataset_name,
  {lowest('custom_weights', 'enrichment', 'dataset_name', 'e.custom_weights IS NOT NULL')} AS w FROM names),
  (VALUES ('FRESHNESS'), ('VOLUME'), ('SCHEMA'), ('OPS')) AS t(k)"""
_DEFAULT_WEIGHT = "CASE k WHEN 'FRESHNESS' THEN 0.3 WHEN 'VOLUME' THEN 0.3 ELSE 0.2 END"
_WEIGHT = (
    f"CAST(CASE WHEN w IS NULL THEN {_DEFAULT_WEIGHT} "
    f"ELSE CAST(json_extract_string(w, '$.' || k) AS DOUBLE) END AS DOUBLE)"
)
oracle("cfg_score_weights", "names enrichment", f"""
SELECT dataset_name, k AS check_type, {_WEIGHT} AS weight FROM ({_WEIGHTS})
WHERE w IS NULL OR json_extract_string(w, '$.' || k) IS NOT NULL""")
oracle("chk_orphan_detection", "names config", """
SELECT dataset_name, CASE WHEN hit THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN hit THEN 'check_config_present' ELSE 'no_check_config' END AS reason
FROM (SELECT dataset_name, EXISTS (SELECT 1 FROM config g WHERE n.dataset_name LIKE g.dataset_pattern) AS hit
      FROM names n)""")
oracle("ref_lob_resolution", "runs lob_lookup", """
SELECT r.run_id, r.lookup_code, COALESCE(l.lob_name, 'N/A') AS lob_name, COALESCE(l.owner, 'N/A') AS owner,
  COALESCE(l.classification, 'N/A') AS classification
FROM runs r LEFT JOIN lob_lookup l ON l.lookup_code = r.lookup_code""")
oracle("chk_classification_weighted", "runs lob_lookup", """
SELECT r.run_id, r.lookup_code, l.classification,
  CAST(CASE l.classification WHEN 'Tier 1 Critical' THEN 2.0 WHEN 'Tier 2 Standard' THEN 1.0
       ELSE CASE WHEN l.classification IS NOT NULL THEN 0.5 END END AS DOUBLE) AS multiplier,
  'PASS' AS status,
  CASE WHEN l.classification IS NULL THEN 'no_classification_found' ELSE 'classification_captured' END AS reason
FROM runs r LEFT JOIN lob_lookup l ON l.lookup_code = r.lookup_code""")

# ---- score and store --------------------------------------------------------

_SCORED = """
SELECT run_id, check_type AS k,
  CAST(CASE MAX(detail_status) WHEN 'PASS' THEN 100 WHEN 'WARN' THEN 50 WHEN 'FAIL' THEN 0 END AS DOUBLE) AS s
FROM details
WHERE (check_type, detail_type) IN (('FRESHNESS', 'freshness_status'), ('VOLUME', 'volume_status'),
                                    ('SCHEMA', 'schema_status'), ('OPS', 'ops_status'))
GROUP BY run_id, check_type"""
# one column per check, so that sums run in a fixed order
_CHECKS = ("FRESHNESS", "VOLUME", "SCHEMA", "OPS")


def weighted(scored: str) -> str:
    """Wide rows with score, weight, normalized weight and contribution per check."""
    wide = ", ".join(
        f"MAX(CASE WHEN k = '{k}' THEN s END) AS s_{k}, MAX(CASE WHEN k = '{k}' THEN wt END) AS w_{k}"
        for k in _CHECKS
    )
    total = " + ".join(f"CASE WHEN s_{k} IS NULL THEN 0 ELSE w_{k} END" for k in _CHECKS)
    n = " + ".join(f"CASE WHEN s_{k} IS NULL THEN 0 ELSE 1 END" for k in _CHECKS)
    used = ", ".join(
        f"CASE WHEN s_{k} IS NOT NULL THEN CASE WHEN total <= 0 THEN CAST(1 AS DOUBLE) ELSE w_{k} END END AS u_{k}"
        for k in _CHECKS
    )
    norm = ", ".join(f"u_{k} / CASE WHEN total <= 0 THEN n ELSE total END AS n_{k}" for k in _CHECKS)
    return (
        f"SELECT *, {norm} FROM (SELECT *, {used} FROM (SELECT *, {total} AS total, {n} AS n "
        f"FROM (SELECT run_id, {wide} FROM ({scored}) GROUP BY run_id)))"
    )


def scored_runs(scored: str) -> str:
    total = " + ".join(f"COALESCE(n_{k} * s_{k}, 0)" for k in _CHECKS)
    missing = ", ".join(f"CASE WHEN s_{k} IS NULL THEN '{k}' END" for k in _CHECKS)
    return f"""
SELECT run_id, {near('x')} AS composite_score, n AS available_checks, unavailable_checks,
  CASE WHEN n = 0 THEN 'NOT_RUN' WHEN x >= 80 THEN 'PASS' WHEN x >= 50 THEN 'WARN' ELSE 'FAIL' END AS status,
  CASE WHEN n = 0 THEN 'all_checks_unavailable' WHEN n = 4 THEN 'composite_computed' ELSE 'partial_checks' END AS reason
FROM (SELECT *, CASE WHEN n > 0 THEN LEAST(100, GREATEST(0, {total})) END AS x,
        concat_ws(',', {missing}) AS unavailable_checks FROM ({weighted(scored)}))"""


_DEFAULT_SCORED = f"SELECT run_id, k, s, CAST({_DEFAULT_WEIGHT} AS DOUBLE) AS wt FROM ({_SCORED})"
oracle("dq_score", "details", scored_runs(_DEFAULT_SCORED))
_CUSTOM_SCORED = f"""
SELECT q.run_id, q.k, q.s, COALESCE({_WEIGHT.replace("|| k", "|| q.k").replace("CASE k", "CASE q.k")}, 0) AS wt
FROM ({_SCORED}) q JOIN (SELECT run_id,
  {lowest('custom_weights', 'enrichment', 'r.dataset_name', 'e.custom_weights IS NOT NULL')} AS w
  FROM runs r) x ON x.run_id = q.run_id"""
oracle("dq_score_custom_weights", "details runs enrichment", scored_runs(_CUSTOM_SCORED))
oracle("dq_score_breakdown", "details", " UNION ALL ".join(
    f"SELECT run_id, '{k}' AS check_type, s_{k} AS score, u_{k} AS weight, {near(f'n_{k}')} AS normalized_weight, "
    f"{near(f'n_{k} * s_{k}')} AS contribution FROM ({weighted(_DEFAULT_SCORED)}) WHERE s_{k} IS NOT NULL"
    for k in _CHECKS
))
oracle("run_status_derivation", "runs details numerics", """
SELECT r.run_id, COALESCE(d.detail_status, 'UNKNOWN') AS check_status, n.metric_value AS dqs_score
FROM runs r
LEFT JOIN details d ON d.run_id = r.run_id AND d.check_type = 'DQS_SCORE' AND d.detail_type = 'dqs_score_breakdown'
LEFT JOIN numerics n ON n.run_id = r.run_id AND n.check_type = 'DQS_SCORE' AND n.metric_name = 'composite_score'""")

oracle("active_runs", "runs", "SELECT * EXCLUDE (cents) REPLACE (CAST(dqs_score AS DOUBLE) AS dqs_score) FROM runs")
oracle("rerun_expire_runs", "runs_all targets", f"""
SELECT r.run_id, r.dataset_name, r.partition_date, r.rerun_number,
  CASE WHEN hit THEN {EXPIRED_AT} ELSE r.expiry_date END AS expiry_date,
  CASE WHEN hit THEN r.rerun_number + 1 END AS next_rerun_number
FROM (SELECT *, expiry_date = {SENTINEL} AND partition_date >= DATE '2001-01-01' AS hit FROM runs_all) r""")
for _kind, _id in (("numeric", "metric"), ("detail", "detail")):
    _name = "metric_name" if _kind == "numeric" else "detail_type"
    oracle(f"rerun_expire_{_kind}", f"{_kind}s_all expired_ids", f"""
SELECT {_id}_id, run_id, check_type, {_name},
  CASE WHEN expiry_date = {SENTINEL} AND run_id IN (SELECT run_id FROM expired_ids)
       THEN {EXPIRED_AT} ELSE expiry_date END AS expiry_date
FROM {_kind}s_all""")
oracle("rerun_numbers", "runs targets", """
SELECT t.dataset_name, t.partition_date, MAX(r.rerun_number) AS previous_rerun_number,
  COALESCE(MAX(r.rerun_number), 0) + 1 AS rerun_number
FROM targets t LEFT JOIN runs r ON r.dataset_name = t.dataset_name AND r.partition_date = t.partition_date
GROUP BY 1, 2""")
oracle("rerun_next_number", "runs_all", """
SELECT dataset_name, partition_date, COALESCE(MAX(rerun_number), -1) + 1 AS next_rerun_number
FROM runs_all GROUP BY 1, 2""")
oracle("orchestration_rollup", "runs", """
SELECT orchestration_run_id, COUNT(*) AS total_datasets, COUNT(*) FILTER (WHERE check_status = 'PASS') AS passed_datasets,
  COUNT(*) FILTER (WHERE check_status = 'FAIL') AS failed_datasets,
  CASE WHEN bool_or(check_status = 'FAIL') THEN 'completed_with_errors' ELSE 'completed' END AS run_status,
  CASE WHEN bool_or(check_status = 'FAIL')
       THEN CAST(COUNT(*) FILTER (WHERE check_status = 'FAIL') AS VARCHAR) || ' failed' END AS error_summary
FROM runs WHERE orchestration_run_id IS NOT NULL GROUP BY 1""")

# ---- cross-dataset checks ---------------------------------------------------

oracle("chk_sla_countdown", "runs enrichment", f"""
SELECT run_id, dataset_name, partition_date, sla_hours, left_over AS hours_remaining,
  {near('sla_hours * CAST(0.2 AS DOUBLE)')} AS warn_threshold,
  CASE WHEN left_over < 0 THEN 'FAIL' WHEN left_over <= sla_hours * CAST(0.2 AS DOUBLE) THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN left_over < 0 THEN 'sla_breached' WHEN left_over <= sla_hours * CAST(0.2 AS DOUBLE) THEN 'approaching_sla'
       ELSE 'within_sla' END AS reason
FROM (SELECT *, sla_hours - datesub('hour', CAST(partition_date AS TIMESTAMP), create_date) AS left_over
  FROM (SELECT *, CAST({lowest('sla_hours', 'enrichment', 'r.dataset_name', 'e.sla_hours IS NOT NULL')} AS DOUBLE) AS sla_hours
        FROM runs r)) WHERE sla_hours IS NOT NULL""")

oracle("chk_source_health", "src pairs", f"""
WITH stat AS (
  SELECT k.src_sys_nm, k.partition_date, CAST(SUM(h.cents) AS DOUBLE) / 100 / COUNT(h.cents) AS score,
    COUNT(DISTINCT h.dataset_name) AS n
  FROM (SELECT DISTINCT src_sys_nm, partition_date FROM pairs WHERE src_sys_nm IS NOT NULL) k
  JOIN src h ON h.src_group = k.src_sys_nm AND h.cents IS NOT NULL
   AND h.partition_date BETWEEN k.partition_date - 7 AND k.partition_date
  GROUP BY 1, 2)
SELECT p.dataset_name, p.partition_date, p.src_sys_nm, {near('s.score')} AS aggregate_score, s.n AS dataset_count,
  CASE WHEN s.score < 60 THEN 'FAIL' WHEN s.score < 75 THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN p.src_sys_nm IS NULL THEN 'no_source_system_segment'
       WHEN s.n IS NULL THEN 'no_history_available' END AS reason
FROM pairs p LEFT JOIN stat s ON s.src_sys_nm = p.src_sys_nm AND s.partition_date = p.partition_date""")

oracle("chk_correlation", "src pairs", f"""
WITH dropped AS (
  SELECT DISTINCT r.dataset_name, r.partition_date
  FROM src r JOIN (
    SELECT a.run_id, SUM(h.cents) AS s, COUNT(h.cents) AS n FROM src a JOIN src h
      ON h.dataset_name = a.dataset_name AND h.cents IS NOT NULL
     AND h.partition_date BETWEEN a.partition_date - 8 AND a.partition_date - 1
    GROUP BY 1) b ON b.run_id = r.run_id
  WHERE r.cents * b.n < b.s - 1000 * b.n),
stat AS (
  SELECT src_group, src.partition_date, COUNT(DISTINCT src.dataset_name) AS total,
    COUNT(DISTINCT dropped.dataset_name) AS bad
  FROM src LEFT JOIN dropped ON dropped.dataset_name = src.dataset_name AND dropped.partition_date = src.partition_date
  WHERE cents IS NOT NULL AND src_group IS NOT NULL GROUP BY 1, 2)
SELECT p.dataset_name, p.partition_date, p.src_sys_nm, total AS total_dataset_count,
  bad AS correlated_dataset_count, {near('CAST(bad AS DOUBLE) / total')} AS correlation_ratio,
  CASE WHEN bad * 2 >= total THEN 'FAIL' WHEN bad * 4 >= total THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN p.src_sys_nm IS NULL THEN 'no_source_system_segment' WHEN total IS NULL THEN 'no_current_day_data' END AS reason
FROM pairs p LEFT JOIN stat s ON s.src_group = p.src_sys_nm AND s.partition_date = p.partition_date""")

oracle("chk_lineage", "src pairs", """
WITH stat AS (
  SELECT k.src_sys_nm, k.partition_date, COUNT(DISTINCT h.dataset_name) AS n,
    COUNT(DISTINCT CASE WHEN h.cents < 6000 OR h.check_status = 'FAIL' THEN h.dataset_name END) AS bad
  FROM (SELECT DISTINCT src_sys_nm, partition_date FROM pairs WHERE src_sys_nm IS NOT NULL) k
  JOIN src h ON h.partition_date = k.partition_date AND h.cents IS NOT NULL
   AND NOT contains(h.dataset_name, 'src_sys_nm=' || k.src_sys_nm || '/')
  GROUP BY 1, 2)
SELECT p.dataset_name, p.partition_date, p.src_sys_nm, n AS upstream_dataset_count, bad AS upstream_failed_count,
  CASE WHEN bad > 0 THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN p.src_sys_nm IS NULL THEN 'no_source_system_segment' WHEN n IS NULL THEN 'no_upstream_datasets' END AS reason
FROM pairs p LEFT JOIN stat s ON s.src_sys_nm = p.src_sys_nm AND s.partition_date = p.partition_date""")

oracle("chk_cross_destination", "src", f"""
SELECT k.dataset_name, k.partition_date, d.n AS destination_count, {near('d.mean')} AS mean_score,
  {near('d.dev')} AS max_deviation, d.bad AS inconsistent_destination_count,
  CASE WHEN d.bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN d.n IS NULL THEN 'single_destination' END AS reason
FROM (SELECT DISTINCT COALESCE(src_sys_nm, 'unknown') AS dataset_name, partition_date FROM src) k
LEFT JOIN (
  SELECT name, partition_date, COUNT(*) AS n, ANY_VALUE(mean) AS mean, MAX(ABS(dqs_score - mean)) AS dev,
    COUNT(*) FILTER (WHERE ABS(CAST(dqs_score AS DOUBLE) - mean) > 15) AS bad
  FROM (SELECT COALESCE(src_sys_nm, 'unknown') AS name, partition_date, dqs_score,
          CAST(SUM(dqs_score) OVER w AS DOUBLE) / COUNT(*) OVER w AS mean
        FROM src WHERE dqs_score IS NOT NULL
        WINDOW w AS (PARTITION BY COALESCE(src_sys_nm, 'unknown'), partition_date))
  GROUP BY 1, 2 HAVING COUNT(*) > 1) d ON d.name = k.dataset_name AND d.partition_date = k.partition_date""")

oracle("chk_inferred_sla", "enrichment", f"""
WITH h AS MATERIALIZED (
  SELECT 'lob=supply/src_sys_nm=s' || CAST(l_suppkey AS VARCHAR) || '/dataset=delivery' AS dataset_name,
    CAST(l_shipdate AS DATE) AS partition_date, MAX(l_quantity) AS hours_since_update FROM lineitem GROUP BY 1, 2),
own AS (SELECT * FROM h WHERE NOT EXISTS (
  SELECT 1 FROM enrichment e WHERE h.dataset_name LIKE e.dataset_pattern AND e.sla_hours IS NOT NULL)),
stat AS (
  SELECT a.dataset_name, a.partition_date, a.hours_since_update, COUNT(b.hours_since_update) AS n,
    AVG(b.hours_since_update) AS mean, STDDEV_POP(b.hours_since_update) AS dev
  FROM own a LEFT JOIN own b ON b.dataset_name = a.dataset_name
   AND b.partition_date BETWEEN a.partition_date - 30 AND a.partition_date - 1
  GROUP BY 1, 2, 3),
judged AS (SELECT *, n + 1 >= 7 AS ok, mean + 2 * dev AS inferred FROM stat)
SELECT dataset_name, partition_date, hours_since_update, CASE WHEN ok THEN n ELSE n + 1 END AS data_points,
  CASE WHEN ok THEN {near('mean')} END AS mean_hours, CASE WHEN ok THEN {near('dev')} END AS stddev_hours,
  CASE WHEN ok THEN {near('inferred')} END AS inferred_sla_hours,
  CASE WHEN ok THEN {near('hours_since_update - inferred')} END AS deviation_from_inferred,
  CASE WHEN NOT ok THEN 'PASS' WHEN hours_since_update > inferred THEN 'FAIL'
       WHEN inferred > 0 AND hours_since_update - inferred > -inferred * CAST(0.2 AS DOUBLE) THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN NOT ok THEN 'insufficient_history' END AS reason
FROM judged""")

# ---- reports ----------------------------------------------------------------

oracle("fn_source_system", "names", """
SELECT dataset_name, NULLIF(regexp_extract(dataset_name, 'src_sys_nm=([^/]*)', 1), '') AS for_checks,
  COALESCE(list_filter(string_split(dataset_name, '/'), lambda s: starts_with(s, 'src_sys_nm='))[1][12:], 'unknown') AS for_display,
  split_part(split_part(dataset_name, 'src_sys_nm=', 2), '/', 1) AS for_ranking
FROM names""")
oracle("rpt_latest_run", "latest", """
SELECT run_id, dataset_name, lookup_code, check_status, CAST(dqs_score AS DOUBLE) AS dqs_score, partition_date FROM latest""")

_STATUS_COUNTS = """COUNT(*) FILTER (WHERE check_status = 'PASS') AS healthy_count,
  COUNT(*) FILTER (WHERE check_status = 'WARN') AS degraded_count,
  COUNT(*) FILTER (WHERE check_status = 'FAIL') AS critical_count"""
oracle("rpt_summary_totals", "latest", f"SELECT COUNT(*) AS total_datasets, {_STATUS_COUNTS} FROM latest")
oracle("rpt_lob_summary", "latest", f"""
SELECT lookup_code, COUNT(*) AS dataset_count, {average('cents')} AS aggregate_score, {_STATUS_COUNTS}
FROM latest GROUP BY 1""")


def trend(key: str, days: int, source: str = "runs", where: str = "TRUE") -> str:
    return f"""
SELECT v.{key}, v.partition_date AS day, {average('v.cents')} AS avg_score
FROM {source} v JOIN (SELECT {key}, MAX(partition_date) AS d FROM {source} WHERE {where} GROUP BY 1) x ON x.{key} = v.{key}
WHERE v.partition_date >= x.d - {days - 1} GROUP BY 1, 2"""


oracle("rpt_lob_trend", "runs", trend("lookup_code", 7))
oracle("rpt_dataset_trend", "runs", trend("dataset_name", 90))
oracle("rpt_last_run", "runs newest", """
SELECT d AS last_run_at, (SELECT COALESCE(bool_or(check_status = 'FAIL'), FALSE) FROM runs WHERE partition_date = d) AS run_failed,
  epoch(TIMESTAMP '2001-08-01 23:00:00') - epoch(CAST(d AS TIMESTAMP)) >= 24 * 3600 AS is_stale FROM newest""")


def lob_view(days: int, where: str) -> str:
    present = ", ".join(
        f"CASE WHEN EXISTS (SELECT 1 FROM numerics n WHERE n.run_id = l.run_id AND n.check_type = '{k}') "
        f"THEN l.check_status END AS {k.lower()}_status"
        for k in ("FRESHNESS", "VOLUME", "SCHEMA")
    )
    return f"""
SELECT l.lookup_code, l.run_id AS dataset_id, l.dataset_name, CAST(l.dqs_score AS DOUBLE) AS dqs_score, l.check_status,
  l.partition_date, t.trend, {present}
FROM latest l JOIN (
  SELECT dataset_name, string_agg(COALESCE(CAST(avg_score AS VARCHAR), 'null'), ',' ORDER BY day) AS trend
  FROM ({trend('dataset_name', days)}) GROUP BY 1) t ON t.dataset_name = l.dataset_name
WHERE {where}"""


oracle("rpt_lob_datasets", "latest numerics", lob_view(90, "TRUE"))
oracle("rpt_lob_datasets_one", "latest numerics", lob_view(30, "l.lookup_code = 'LOB_BUILDING'"))

_PREVIOUS = """
SELECT dataset_name, metric_value AS previous_row_count FROM (
  SELECT r.dataset_name, n.metric_value, ROW_NUMBER() OVER (PARTITION BY r.dataset_name
    ORDER BY r.partition_date DESC, r.rerun_number DESC, r.run_id DESC) AS rn
  FROM runs r JOIN numerics n ON n.run_id = r.run_id AND n.check_type = 'VOLUME' AND n.metric_name = 'row_count')
WHERE rn = 2"""
oracle("rpt_previous_row_count", "runs numerics", _PREVIOUS)
oracle("rpt_row_count_before", "runs numerics", """
WITH v AS (SELECT * FROM (
  SELECT r.run_id, r.dataset_name, r.partition_date, n.metric_value, ROW_NUMBER() OVER (
    PARTITION BY r.dataset_name, r.partition_date ORDER BY r.rerun_number DESC, r.run_id DESC) AS rn
  FROM runs r JOIN numerics n ON n.run_id = r.run_id AND n.check_type = 'VOLUME') WHERE rn = 1)
SELECT a.run_id, a.metric_value AS row_count, b.metric_value AS previous_row_count
FROM v a LEFT JOIN v b ON b.dataset_name = a.dataset_name AND b.partition_date =
  (SELECT MAX(p.partition_date) FROM v p WHERE p.dataset_name = a.dataset_name AND p.partition_date < a.partition_date)""")

oracle("rpt_dataset_detail", "runs runs_all numerics details lob_lookup", f"""
SELECT r.run_id AS dataset_id, r.dataset_name, r.lookup_code AS lob_id,
  COALESCE(NULLIF(regexp_extract(r.dataset_name, '(^|/)src_sys_nm=([^/]*)', 2), ''), 'unknown') AS source_system,
  CASE WHEN f.detail_value IS NULL THEN 'Unknown' WHEN lower(f.detail_value) LIKE '%parquet%' THEN 'Parquet'
       WHEN lower(f.detail_value) LIKE '%avro%' THEN 'Avro' ELSE 'Orc' END AS format,
  '/prod/datalake/' || r.dataset_name || '/partition_date=' || strftime(r.partition_date, '%Y%m%d') AS hdfs_path,
  CASE WHEN r.orchestration_run_id IS NOT NULL
       THEN '/prod/nation_' || CAST(r.orchestration_run_id // 10000 AS VARCHAR) END AS parent_path,
  r.partition_date, v.metric_value AS row_count, p.previous_row_count, r.create_date AS last_updated,
  r.rerun_number, CAST(r.dqs_score AS DOUBLE) AS dqs_score, r.check_status, r.error_message,
  COALESCE(l.lob_name, 'N/A') AS lob_name, COALESCE(l.owner, 'N/A') AS owner,
  COALESCE(l.classification, 'N/A') AS classification
FROM runs r
LEFT JOIN numerics v ON v.run_id = r.run_id AND v.check_type = 'VOLUME'
LEFT JOIN details f ON f.run_id = r.run_id AND f.detail_type = 'eventAttribute_format'
LEFT JOIN ({_PREVIOUS}) p ON p.dataset_name = r.dataset_name
LEFT JOIN lob_lookup l ON l.lookup_code = r.lookup_code""")

oracle("rpt_metrics_by_check", "runs numerics details", """
SELECT r.run_id, k.check_type, r.check_status AS status,
  COALESCE((SELECT string_agg(n.metric_name || '=' || CAST(CAST(n.metric_value AS BIGINT) AS VARCHAR), ';' ORDER BY n.metric_name)
   FROM numerics n WHERE n.run_id = r.run_id AND n.check_type = k.check_type), '') AS numeric_metrics,
  COALESCE((SELECT string_agg(x.detail_type || '=' || x.detail_value, ';' ORDER BY x.detail_type)
   FROM details x WHERE x.run_id = r.run_id AND x.check_type = k.check_type), '') AS detail_metrics
FROM runs r JOIN (SELECT run_id, check_type FROM numerics UNION SELECT run_id, check_type FROM details) k
  ON k.run_id = r.run_id""")

oracle("rpt_search", "latest_any", """
SELECT run_id AS dataset_id, dataset_name, lookup_code AS lob_id, CAST(dqs_score AS DOUBLE) AS dqs_score, check_status,
  CASE WHEN starts_with(lower(dataset_name), 'src_sys_nm=nation_1/') THEN 0 ELSE 1 END AS sort_order
FROM latest_any WHERE contains(lower(dataset_name), 'src_sys_nm=nation_1/')
ORDER BY sort_order, dataset_name LIMIT 10""")
oracle("rpt_find_dataset", "latest_any", """
SELECT run_id, dataset_name, check_status, CAST(dqs_score AS DOUBLE) AS dqs_score, partition_date
FROM latest_any WHERE contains(lower(dataset_name), 'nation_17/') ORDER BY dataset_name LIMIT 1""")

_MONTHLY = f"""
SELECT lookup_code AS lob_id, strftime(partition_date, '%Y-%m') AS month, {average('cents')} AS avg_score
FROM runs WHERE lookup_code IS NOT NULL AND dqs_score IS NOT NULL AND partition_date >= DATE '2001-05-01'
GROUP BY 1, 2"""
oracle("rpt_lob_monthly", "runs", _MONTHLY)
oracle("rpt_lob_monthly_pivot", "runs", f"""
SELECT lob_id, """ + ", ".join(
    f"MAX(CASE WHEN month = '{m}' THEN avg_score END) AS m_{m.replace('-', '_')}"
    for m in ("2001-05", "2001-06", "2001-07")
) + f" FROM ({_MONTHLY}) GROUP BY 1")
oracle("rpt_source_accountability", "newest_year", f"""
SELECT split_part(split_part(dataset_name, 'src_sys_nm=', 2), '/', 1) AS src_sys_nm, COUNT(*) AS dataset_count,
  {average('cents')} AS avg_score, COUNT(*) FILTER (WHERE check_status = 'PASS') AS healthy_count,
  COUNT(*) FILTER (WHERE check_status = 'FAIL') AS critical_count
FROM yearly, newest_year WHERE partition_date = d AND dataset_name LIKE '%src_sys_nm=%' GROUP BY 1""")
oracle("rpt_improvement_delta", "runs", f"""
SELECT lob_id, {average('b')} AS baseline_score, {average('c')} AS current_score,
  CASE WHEN COUNT(b) > 0 AND COUNT(c) > 0 THEN
    CAST(sign(CAST(SUM(c) AS BIGINT) * COUNT(b) - CAST(SUM(b) AS BIGINT) * COUNT(c)) AS DOUBLE) *
    ((2 * ABS(CAST(SUM(c) AS BIGINT) * COUNT(b) - CAST(SUM(b) AS BIGINT) * COUNT(c)) + COUNT(b) * COUNT(c))
      // (2 * COUNT(b) * COUNT(c))) / 100 END AS delta
FROM (SELECT lookup_code AS lob_id,
        CASE WHEN partition_date < DATE '2001-06-01' THEN cents END AS b,
        CASE WHEN partition_date BETWEEN DATE '2001-07-01' AND DATE '2001-07-31' THEN cents END AS c
      FROM runs WHERE lookup_code IS NOT NULL AND cents IS NOT NULL AND partition_date >= DATE '2001-05-01')
GROUP BY 1 HAVING COUNT(b) + COUNT(c) > 0""")

_TYPES = """COALESCE((SELECT string_agg(DISTINCT n.check_type, ',' ORDER BY n.check_type)
   FROM numerics n WHERE n.run_id = r.run_id), '')"""
oracle("rpt_latest_failures", "newest_year numerics", f"""
SELECT r.run_id, r.dataset_name, r.partition_date, COALESCE(r.lookup_code, 'UNKNOWN') AS lob,
  CAST(r.dqs_score AS DOUBLE) AS dqs_score, {_TYPES} AS check_types
FROM yearly r, newest_year WHERE r.partition_date = d AND r.check_status = 'FAIL'""")
oracle("rpt_failures_by_lob", "newest_year", """
SELECT COALESCE(lookup_code, 'UNKNOWN') AS lob, partition_date, COUNT(*) AS failure_count,
  (SELECT COUNT(DISTINCT dataset_name) FROM yearly, newest_year WHERE partition_date = d) AS total_datasets
FROM yearly, newest_year WHERE partition_date = d AND check_status = 'FAIL' GROUP BY 1, 2""")
oracle("rpt_trend_direction", "latest_any runs numerics", f"""
WITH t AS MATERIALIZED ({trend('dataset_name', 90)}),
e AS (SELECT dataset_name, arg_max(avg_score, day) AS z, arg_min(avg_score, day) AS a, COUNT(*) AS n
      FROM (SELECT dataset_name, day, COALESCE(avg_score, -1) AS avg_score FROM t) GROUP BY 1)
SELECT r.dataset_name, r.partition_date, CAST(r.dqs_score AS DOUBLE) AS current_score, r.check_status,
  e.n AS history_points,
  CASE WHEN n < 2 OR z < 0 OR a < 0 THEN 'stable' WHEN z - a > 2 THEN 'improving'
       WHEN z - a < -2 THEN 'degrading' ELSE 'stable' END AS trend,
  CASE WHEN r.check_status = 'PASS' THEN '' ELSE {_TYPES} END AS flagged_checks
FROM latest_any r JOIN e ON e.dataset_name = r.dataset_name""")
oracle("rpt_lob_compare", "latest numerics", f"""
SELECT ROW_NUMBER() OVER (ORDER BY avg_score NULLS LAST, lookup_code) AS lob_rank, *
FROM (SELECT lookup_code, {average('cents')} AS avg_score, COUNT(*) AS dataset_count,
        COUNT(*) FILTER (WHERE check_status = 'FAIL') AS failing_count,
        COALESCE((SELECT string_agg(DISTINCT n.check_type, ',' ORDER BY n.check_type) FROM numerics n JOIN latest r
          ON r.run_id = n.run_id WHERE r.check_status = 'FAIL' AND r.lookup_code = l.lookup_code), '') AS failing_checks
      FROM latest l GROUP BY 1)""")
oracle("rpt_run_check_failures", "runs details", """
SELECT orchestration_run_id, x.check_type, COUNT(*) AS failure_count FROM details x JOIN runs r ON r.run_id = x.run_id
WHERE orchestration_run_id IS NOT NULL AND check_status <> 'PASS' GROUP BY 1, 2""")
oracle("rpt_run_failed_datasets", "runs", """
SELECT orchestration_run_id, dataset_name, partition_date, run_id, check_status FROM runs
WHERE orchestration_run_id IS NOT NULL AND check_status <> 'PASS'""")
oracle("rpt_lob_header", "latest", f"""
SELECT lookup_code, COUNT(*) AS dataset_count, CAST({average('cents', 0)} AS BIGINT) AS avg_score,
  (200 * COUNT(*) FILTER (WHERE check_status = 'PASS') + COUNT(*)) // (2 * COUNT(*)) AS passing_rate,
  MAX(partition_date) AS last_run
FROM latest GROUP BY 1""")
oracle("rpt_worst_first", "latest", """
SELECT lookup_code, dataset_name, CAST(dqs_score AS DOUBLE) AS dqs_score,
  RANK() OVER (PARTITION BY lookup_code ORDER BY dqs_score NULLS LAST) AS position FROM latest""")
oracle("rpt_score_band", "runs", """
WITH s AS MATERIALIZED (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name, partition_date
    ORDER BY rerun_number DESC, run_id DESC) AS rn FROM runs WHERE cents IS NOT NULL) WHERE rn = 1)
SELECT a.dataset_name, a.partition_date, CAST(a.dqs_score AS DOUBLE) AS dqs_score,
  CASE WHEN a.cents >= 8000 THEN 'healthy' WHEN a.cents >= 6000 THEN 'degraded' ELSE 'critical' END AS band,
  CAST(a.cents - b.cents AS DOUBLE) / 100 AS delta,
  CASE WHEN a.cents > b.cents THEN 'up' WHEN a.cents < b.cents THEN 'down' WHEN a.cents = b.cents THEN 'flat' END AS direction
FROM s a LEFT JOIN s b ON b.dataset_name = a.dataset_name AND b.partition_date =
  (SELECT MAX(p.partition_date) FROM s p WHERE p.dataset_name = a.dataset_name AND p.partition_date < a.partition_date)""")

# ---- files and the daily run ------------------------------------------------

_SRC = "regexp_extract(dataset_name, 'src_sys_nm=([^/]*)', 1)"
oracle("src_file_inventory", "m", f"""
SELECT DISTINCT strftime(partition_date, '%Y%m%d') AS raw_date, {_SRC} AS src_sys_nm, TRUE AS has_bytes FROM m""")
oracle("src_format_detect", "m enrichment", f"""
SELECT 'src_sys_nm=' || raw_code AS dataset_name, partition_date, raw_code,
  COALESCE({lowest('lookup_code', 'enrichment', "'src_sys_nm=' || raw_code", 'e.lookup_code IS NOT NULL')}, raw_code) AS lookup_code,
  'PARQUET' AS format, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS reason
FROM (SELECT DISTINCT {_SRC} AS raw_code, partition_date FROM m)""")
oracle("src_parquet_partitioned", "m", f"""
SELECT 'src_sys_nm=' || {_SRC} AS dataset_name, partition_date, COUNT(*) AS row_count,
  CAST(SUM(event_id) AS BIGINT) AS id_sum, COUNT(value) AS value_count, MAX(event_ts) AS latest
FROM m GROUP BY 1, 2""")
oracle("store_rerun_roundtrip", "runs_all numerics_all details_all expired_ids", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CASE WHEN x.expiry_date = {SENTINEL} AND x.run_id IN (SELECT run_id FROM expired_ids) "
    f"THEN {EXPIRED_AT} ELSE x.expiry_date END AS expiry_date, COUNT(*) AS row_count "
    f"FROM {t}_all x JOIN runs_all r ON r.run_id = x.run_id GROUP BY 1, 2"
    for t in ("runs", "numerics", "details")
))

def _rerun_rows(table: str) -> str:
    """Rows of one table after two reruns of the failed runs: original, first and second."""
    failed = f"SELECT run_id FROM runs_all WHERE check_status = 'FAIL' AND expiry_date = {SENTINEL}"
    # expiry by key also ends other active runs of a failed run's dataset and date
    hit = (f"SELECT a.run_id FROM runs_all a WHERE a.expiry_date = {SENTINEL} AND EXISTS (SELECT 1 FROM runs_all f "
           f"WHERE f.run_id IN ({failed}) AND f.dataset_name = a.dataset_name "
           f"AND date_trunc('quarter', f.partition_date) = date_trunc('quarter', a.partition_date))")
    rows = f"SELECT x.run_id, x.expiry_date FROM {table}_all x JOIN runs_all r ON r.run_id = x.run_id"
    ended = lambda at, ids: f"CASE WHEN expiry_date = {SENTINEL} AND run_id IN ({ids}) THEN TIMESTAMP '{at}' ELSE expiry_date END"
    return " UNION ALL ".join((
        f"SELECT run_id, {ended('2002-01-15 00:00:00', hit)} AS expiry_date FROM ({rows})",
        f"SELECT run_id + 1000000000, {ended('2002-02-15 00:00:00', failed)} FROM ({rows}) WHERE run_id IN ({failed})",
        f"SELECT run_id + 2000000000, expiry_date FROM ({rows}) WHERE run_id IN ({failed})",
    ))


oracle("store_rerun_partial", "runs_all numerics_all details_all", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, run_id, expiry_date, COUNT(*) AS row_count FROM ({_rerun_rows(t)}) GROUP BY 2, 3"
    for t in ("runs", "numerics", "details")
))

_PATH = "'/prod/nation_' || CAST(orchestration_run_id // 10000 AS VARCHAR) || '/' || CAST(orchestration_run_id % 10000 AS VARCHAR)"
_BEGUN = ", ".join(f"CAST(NULL AS {t}) AS {x}" for x, t in (
    ("end_time", "TIMESTAMP"), ("total_datasets", "BIGINT"), ("passed_datasets", "BIGINT"), ("failed_datasets", "BIGINT"),
    ("not_run_datasets", "BIGINT"), ("error_summary", "VARCHAR")))
_FINISHED = f"""
SELECT parent_path, CASE WHEN f + n > 0 THEN 'completed_with_errors' ELSE 'completed' END AS run_status,
  TIMESTAMP '1999-01-01 03:00:00' AS start_time, TIMESTAMP '1999-01-01 04:30:00' AS end_time, total AS total_datasets,
  p AS passed_datasets, f AS failed_datasets, n AS not_run_datasets,
  CASE WHEN f > 0 AND n > 0 THEN CAST(f AS VARCHAR) || ' failed, ' || CAST(n AS VARCHAR) || ' not run'
       WHEN f > 0 THEN CAST(f AS VARCHAR) || ' failed' WHEN n > 0 THEN CAST(n AS VARCHAR) || ' not run' END AS error_summary
FROM (SELECT a.parent_path, COUNT(r.run_id) AS total, COUNT(*) FILTER (WHERE r.check_status = 'PASS') AS p,
        COUNT(*) FILTER (WHERE r.check_status = 'FAIL') AS f, COUNT(*) FILTER (WHERE r.check_status = 'UNKNOWN') AS n
      FROM paths a LEFT JOIN (SELECT *, {_PATH} AS parent_path FROM runs WHERE orchestration_run_id IS NOT NULL) r
        ON r.parent_path = a.parent_path
      WHERE a.parent_path NOT LIKE '%1998' GROUP BY 1)"""
_STARTED = f"SELECT parent_path, 'running' AS run_status, TIMESTAMP '1999-01-01 03:00:00' AS start_time, {_BEGUN} FROM paths"
_COLUMNS = "parent_path, run_status, start_time, end_time, total_datasets, passed_datasets, failed_datasets, not_run_datasets, error_summary"
oracle("orchestration_lifecycle", "runs_all runs", f"""
WITH paths AS (SELECT DISTINCT {_PATH} AS parent_path FROM runs_all WHERE orchestration_run_id IS NOT NULL),
begun AS ({_STARTED}), finished AS (SELECT {_COLUMNS} FROM ({_FINISHED}) UNION ALL SELECT {_COLUMNS} FROM begun WHERE parent_path LIKE '%1998')
SELECT {_COLUMNS}, {SENTINEL} AS expiry_date, 'begun' AS moment FROM begun
UNION ALL SELECT {_COLUMNS}, {SENTINEL}, 'finished' FROM finished
UNION ALL SELECT {_COLUMNS}, CASE WHEN parent_path LIKE '%1992' THEN TIMESTAMP '1999-01-02 03:00:00' ELSE {SENTINEL} END, 'again' FROM finished
UNION ALL SELECT parent_path, 'running', TIMESTAMP '1999-01-02 03:00:00', {_BEGUN}, {SENTINEL}, 'again' FROM paths WHERE parent_path LIKE '%1992'""")


def _replaced_rows(table: str) -> str:
    """Rows of one table after the failed runs of a year ran again in one commit."""
    failed = f"SELECT run_id FROM runs_all WHERE check_status = 'FAIL' AND expiry_date = {SENTINEL}"
    hit = (f"SELECT a.run_id FROM runs_all a WHERE a.expiry_date = {SENTINEL} AND EXISTS (SELECT 1 FROM runs_all f "
           f"WHERE f.run_id IN ({failed}) AND f.dataset_name = a.dataset_name "
           f"AND date_trunc('year', f.partition_date) = date_trunc('year', a.partition_date))")
    number = "r.rerun_number" if table == "runs" else "NULL"
    rows = f"SELECT x.run_id, x.expiry_date, {number} AS n FROM {table}_all x JOIN runs_all r ON r.run_id = x.run_id"
    ends = f"expiry_date = {SENTINEL} AND run_id IN ({hit})"
    return (f"SELECT run_id, CASE WHEN {ends} THEN TIMESTAMP '2002-01-15 00:00:00' ELSE expiry_date END AS expiry_date, "
            f"CASE WHEN {ends} THEN CAST(n + 1 AS INTEGER) END AS next_rerun_number FROM ({rows}) "
            f"UNION ALL SELECT run_id + 1000000000, expiry_date, CAST(NULL AS INTEGER) FROM ({rows}) WHERE run_id IN ({failed})")


oracle("store_compacted", "runs_all numerics_all details_all", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, run_id, expiry_date, next_rerun_number, COUNT(*) AS row_count FROM ({_replaced_rows(t)}) GROUP BY 2, 3, 4"
    for t in ("runs", "numerics", "details")
))

_DAILY_STATUS = f"""
SELECT dataset_name, partition_date, 'VOLUME' AS k, status FROM (SELECT *, {_VOLUME} FROM
  ({rolling('counts', 'dataset_name', 'row_count', 'dataset_name, partition_date, row_count')}))
UNION ALL SELECT dataset_name, partition_date, 'FRESHNESS', status FROM (SELECT *, {_FRESH} FROM
  ({rolling('stale', 'dataset_name', 'hours_since_update', 'dataset_name, partition_date, hours_since_update')}))
UNION ALL SELECT dataset_name, partition_date, 'OPS', CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL'
  WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END FROM ({_OPS}) GROUP BY 1, 2
UNION ALL SELECT dataset_name, partition_date, 'SCHEMA', 'PASS' FROM counts"""
_DAILY_SCORED = f"""
SELECT dataset_name || '@' || CAST(partition_date AS VARCHAR) AS run_id, k,
  CAST(CASE status WHEN 'PASS' THEN 100 WHEN 'WARN' THEN 50 WHEN 'FAIL' THEN 0 END AS DOUBLE) AS s,
  COALESCE({_WEIGHT}, 0) AS wt
FROM ({_DAILY_STATUS}) JOIN (SELECT dataset_name,
  {lowest('custom_weights', 'enrichment', 'c.dataset_name', 'e.custom_weights IS NOT NULL')} AS w
  FROM (SELECT DISTINCT dataset_name FROM counts) c) USING (dataset_name)"""
oracle("daily_run", "counts stale rates enrichment", f"""
SELECT split_part(run_id, '@', 1) AS dataset_name, CAST(split_part(run_id, '@', 2) AS DATE) AS partition_date,
  status AS check_status, ROUND(composite_score, 2) AS dqs_score
FROM ({scored_runs(_DAILY_SCORED)})""")

# runs of the daily run in the place of the order runs, for the checks over run history
_DAILY_RUNS = sql("counts stale rates enrichment", f"""
SELECT ROW_NUMBER() OVER () AS run_id, x.*, {lowest('lookup_code', 'enrichment', 'x.dataset_name', 'e.lookup_code IS NOT NULL')} AS lookup_code,
  0 AS rerun_number, {SENTINEL} AS expiry_date
FROM (SELECT split_part(run_id, '@', 1) AS dataset_name, CAST(split_part(run_id, '@', 2) AS DATE) AS partition_date, status AS check_status,
        CAST(ROUND(composite_score, 2) AS DECIMAL(5,2)) AS dqs_score, CAST(ROUND(composite_score * 100) AS BIGINT) AS cents, composite_score, reason
      FROM ({scored_runs(_DAILY_SCORED)})) x""")


def _over_daily_runs(name: str) -> str:
    return ORACLE[name].replace(CTE["runs_all"].strip(), _DAILY_RUNS)


_DAILY_SLA = f"""
SELECT dataset_name, partition_date, sla_hours - datesub('hour', CAST(partition_date AS TIMESTAMP), TIMESTAMP '2024-01-31 06:00:00') AS hours_remaining, sla_hours
FROM (SELECT *, CAST({lowest('sla_hours', 'enrichment', 'x.dataset_name', 'e.sla_hours IS NOT NULL')} AS DOUBLE) AS sla_hours FROM counts x)
WHERE sla_hours IS NOT NULL"""
# hours that no row gives are not stored
_DAILY_INFERRED = ORACLE["chk_inferred_sla"].replace(
    ORACLE["chk_inferred_sla"].split("h AS MATERIALIZED (")[1].split("),\nown")[0], "SELECT dataset_name, partition_date, hours_since_update FROM stale WHERE hours_since_update IS NOT NULL")
_DAILY_CLASS = f"""
SELECT r.dataset_name, r.partition_date, l.classification, CASE WHEN l.classification = 'Tier 1 Critical' THEN 2.0
  WHEN l.classification = 'Tier 2 Standard' THEN 1.0 WHEN l.classification IS NOT NULL THEN 0.5 END AS multiplier
FROM ({_DAILY_RUNS}) r LEFT JOIN lob_lookup l ON l.lookup_code = r.lookup_code"""


def _numbers(source: str, check: str, *columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset_name, partition_date, '{check}', '{x}', CAST({x} AS DOUBLE) FROM ({source}) WHERE {x} IS NOT NULL" for x in columns)


_JSON_STATS = ORACLE["chk_dist_json_levels"]
_FULL_NUMBERS = " UNION ALL ".join([
    f"SELECT * FROM ({_ALL_METRICS}) WHERE metric_value IS NOT NULL AND (check_type <> 'TIMESTAMP_SANITY' OR dataset_name LIKE 'lob=%')",
    *(f"SELECT dataset_name, partition_date, 'DISTRIBUTION', column_path || '.{n}', CAST({x} AS DOUBLE) FROM ({_JSON_STATS})"
      for n, x in (("mean", "mean"), ("stddev", "stddev"), ("p50", "p50"), ("p95", "p95"), ("count", "sample_count"))),
    _numbers(ORACLE["chk_volume_status"], "VOLUME", "pct_change", "row_count_stddev"),
    _numbers("SELECT * FROM counts", "ZERO_ROW", "row_count"),
    _numbers("SELECT dataset_name, partition_date, 0 AS added_fields_count, 0 AS removed_fields_count, 0 AS changed_fields_count FROM counts",
             "SCHEMA", "added_fields_count", "removed_fields_count", "changed_fields_count"),
    _numbers(_DAILY_SLA, "SLA_COUNTDOWN", "hours_remaining"),
    _numbers(_DAILY_INFERRED, "INFERRED_SLA", "inferred_sla_hours", "deviation_from_inferred"),
    _numbers(f"SELECT dataset_name, partition_date, multiplier AS classification_weighted_score FROM ({_DAILY_CLASS})",
             "CLASSIFICATION_WEIGHTED", "classification_weighted_score"),
    _numbers(_over_daily_runs("chk_source_health"), "SOURCE_SYSTEM_HEALTH", "aggregate_score", "dataset_count"),
    _numbers(_over_daily_runs("chk_correlation"), "CORRELATION", "correlated_dataset_count", "correlation_ratio"),
    _numbers(_over_daily_runs("chk_lineage"), "LINEAGE", "upstream_dataset_count", "upstream_failed_count"),
    _numbers(_DAILY_RUNS, "DQS_SCORE", "composite_score"),
])
oracle("daily_run_numerics", "stats counts stale ts_judged enrichment lob_lookup", f"""
SELECT dataset_name, partition_date, check_type, metric_name, {near('metric_value')} AS metric_value FROM ({_FULL_NUMBERS})""")


def _judgements(source: str, check: str, detail: str) -> str:
    return f"SELECT dataset_name, partition_date, '{check}' AS check_type, '{detail}' AS detail_type, status, reason FROM ({source})"


oracle("daily_run_details", "stats counts stale ts_judged enrichment lob_lookup", " UNION ALL ".join([
    _judgements(ORACLE["chk_volume_status"], "VOLUME", "volume_status"),
    _judgements(ORACLE["chk_freshness_status"], "FRESHNESS", "freshness_status"),
    _judgements(ORACLE["chk_ops_status"], "OPS", "ops_status"),
    _judgements(f"SELECT * FROM ({ORACLE['chk_ts_sanity']}) WHERE dataset_name LIKE 'lob=%'", "TIMESTAMP_SANITY", "timestamp_sanity.event_ts"),
    _judgements(f"SELECT * FROM ({ORACLE['chk_ts_sanity_summary']}) WHERE dataset_name LIKE 'lob=%'", "TIMESTAMP_SANITY", "timestamp_sanity_summary"),
    _judgements(f"""SELECT *, CASE WHEN hours_remaining < 0 THEN 'FAIL' WHEN hours_remaining <= sla_hours * CAST(0.2 AS DOUBLE) THEN 'WARN' ELSE 'PASS' END AS status,
      CASE WHEN hours_remaining < 0 THEN 'sla_breached' WHEN hours_remaining <= sla_hours * CAST(0.2 AS DOUBLE) THEN 'approaching_sla'
      ELSE 'within_sla' END AS reason FROM ({_DAILY_SLA})""", "SLA_COUNTDOWN", "sla_countdown_status"),
    _judgements(_DAILY_INFERRED, "INFERRED_SLA", "inferred_sla_status"),
    _judgements(f"""SELECT *, 'PASS' AS status, CASE WHEN classification IS NULL THEN 'no_classification_found' ELSE 'classification_captured' END
      AS reason FROM ({_DAILY_CLASS})""", "CLASSIFICATION_WEIGHTED", "classification_weighted_status"),
    _judgements(_over_daily_runs("chk_source_health"), "SOURCE_SYSTEM_HEALTH", "source_system_health_status"),
    _judgements(_over_daily_runs("chk_correlation"), "CORRELATION", "correlation_status"),
    _judgements(_over_daily_runs("chk_lineage"), "LINEAGE", "lineage_status"),
    _judgements(f"SELECT dataset_name, partition_date, check_status AS status, reason FROM ({_DAILY_RUNS})", "DQS_SCORE", "dqs_score_breakdown"),
]))

_MIXED = """
WITH ev AS (SELECT partition_date, event_id AS id, value, tag FROM m),
od AS (SELECT CAST(date_trunc('year', CAST(o_orderdate AS DATE)) AS DATE) AS partition_date, o_orderkey AS id,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders),
li AS (SELECT CAST(date_trunc('year', CAST(l_shipdate AS DATE)) AS DATE) AS partition_date, l_orderkey AS id, l_quantity,
         CASE WHEN l_linenumber > 1 THEN l_returnflag END AS flag FROM lineitem),
"""
_NULLS = " UNION ALL ".join(
    f"SELECT 'src_sys_nm={t}' AS dataset_name, partition_date, 'OPS' AS check_type, 'null_rate_pct::{x}' AS metric_name, "
    f"ROUND(CAST(100 AS DOUBLE) * (COUNT(*) - COUNT({x})) / COUNT(*), 6) AS metric_value FROM {t}"
    + (" WHERE partition_date >= DATE '2024-01-15'" if x == "tag" else "") + " GROUP BY partition_date"
    for t, names in (("ev", ("id", "value", "tag")), ("od", ("id", "price")), ("li", ("id", "l_quantity", "flag"))) for x in names
)
oracle("run_mixed_schemas", "m", _MIXED + f"""
days AS (SELECT 'src_sys_nm=ev' AS dataset_name, partition_date, COUNT(*) AS n FROM ev GROUP BY 2
  UNION ALL SELECT 'src_sys_nm=od', partition_date, COUNT(*) FROM od GROUP BY 2
  UNION ALL SELECT 'src_sys_nm=li', partition_date, COUNT(*) FROM li GROUP BY 2),
gained AS (SELECT MIN(partition_date) AS day FROM ev WHERE partition_date >= DATE '2024-01-15'
  AND EXISTS (SELECT 1 FROM ev WHERE partition_date < DATE '2024-01-15'))
SELECT * FROM ({_NULLS})
UNION ALL SELECT dataset_name, partition_date, 'VOLUME', 'row_count', CAST(n AS DOUBLE) FROM days
UNION ALL SELECT dataset_name, partition_date, 'SCHEMA', k || '_fields_count',
  CASE WHEN k = 'added' AND dataset_name = 'src_sys_nm=ev' AND partition_date = (SELECT day FROM gained) THEN 1.0 ELSE 0.0 END
FROM days, (SELECT unnest(['added', 'removed', 'changed']) AS k)""")
oracle("run_with_bad_dataset", "m", _MIXED + """
days AS (SELECT DISTINCT 'src_sys_nm=ev' AS dataset_name, partition_date FROM ev
  UNION ALL SELECT DISTINCT 'src_sys_nm=od', partition_date FROM od UNION ALL SELECT DISTINCT 'src_sys_nm=li', partition_date FROM li)
SELECT dataset_name, partition_date, TRUE AS was_run, CAST(NULL AS VARCHAR) AS error_message FROM days
UNION ALL SELECT 'src_sys_nm=notes', DATE '2024-01-10', FALSE, 'unsupported_format'
UNION ALL SELECT 'src_sys_nm=broken', DATE '2024-01-10', FALSE, 'execution_error'""")
