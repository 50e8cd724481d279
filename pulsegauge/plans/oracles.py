"""The registered queries once more as plain SQL, for checking results with another engine."""

from __future__ import annotations

AS_OF_US = 1_705_320_000_000_000
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
ALERT_US = 12 * HOUR_US

EV = "ev AS (SELECT event_type AS metric, epoch_us(ts) AS event_us, ts, value, props FROM events)"

EV_SOME = EV.replace("FROM events", "FROM events WHERE event_id % 3 <> 0")


def r(expr: str) -> str:
    """A computed number in single precision, as the queries report it."""
    return f"CAST(round({expr}, 9) AS FLOAT)"


def window(source: str = "ev", interval: str = "6 hours", name: str = "s") -> str:
    return f"""{name} AS (SELECT *, count(*) OVER w AS window_count, avg(value) OVER w AS mean,
      coalesce(var_samp(value) OVER w, 0.0) AS variance, coalesce(stddev_samp(value) OVER w, 0.0) AS stddev
      FROM {source} WINDOW w AS (PARTITION BY metric ORDER BY ts
        RANGE BETWEEN INTERVAL '{interval}' PRECEDING AND CURRENT ROW))"""


def banded(interval: str = "6 hours") -> str:
    """Window rows with floor-index bounds at 5 and 95 percent."""
    return f"""l AS (SELECT *, count(*) OVER w AS window_count, avg(value) OVER w AS mean,
      stddev_samp(value) OVER w AS stddev, list_sort(list(value) OVER w) AS vs
      FROM ev WINDOW w AS (PARTITION BY metric ORDER BY ts
        RANGE BETWEEN INTERVAL '{interval}' PRECEDING AND CURRENT ROW)),
    p AS (SELECT *, vs[CAST(floor(window_count * 5.0 / 100) AS INT) + 1] AS lower_bound,
      vs[CAST(least(floor(window_count * 95.0 / 100), window_count - 1) AS INT) + 1] AS upper_bound
      FROM l WHERE window_count >= 20)"""


EVENT_ID = """substr(sha256(metric || ':' || (event_us // 1000000)::VARCHAR || '.' ||
    CASE WHEN event_us % 1000000 = 0 THEN '0' ELSE rtrim(lpad((event_us % 1000000)::VARCHAR, 6, '0'), '0') END
    || ':' || value::VARCHAR), 1, 16)"""
IDS = f"ids AS (SELECT *, {EVENT_ID} AS event_id FROM s)"
ZHIT = "window_count >= 5 AND stddev > 0 AND abs((value - mean) / stddev) >= 3"
Z = f"z AS (SELECT *, (value - mean) / stddev AS z_score FROM s WHERE {ZHIT})"
ZID = f"""z AS (SELECT *, (value - mean) / stddev AS z_score,
    'anomaly-' || substr(sha256('z-score:' || event_id), 1, 16) AS anomaly_id FROM ids WHERE {ZHIT})"""
WITH_Z = f"WITH {EV}, {window()}, {Z}"
WITH_ZID = f"WITH {EV}, {window()}, {IDS}, {ZID}"
ISO = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_us % 1000000 = 0 THEN ''
    ELSE '.' || lpad((event_us % 1000000)::VARCHAR, 6, '0') END"""

ISO_US = ISO.replace("event_us", "us")
SECONDS = "(us // 1000000)::VARCHAR || '.' || lpad((us % 1000000)::VARCHAR, 6, '0')"

STATS_SQL = f"""WITH {EV}, {window()} SELECT metric, event_us, value, window_count,
  {r('mean')} AS mean, {r('variance')} AS variance, {r('stddev')} AS stddev FROM s"""


def snapshot(seconds_back: int) -> str:
    return f"""SELECT metric, count(v) AS window_count, coalesce(avg(v), 0.0) AS mean,
      coalesce(var_samp(v), 0.0) AS variance, coalesce(stddev_samp(v), 0.0) AS stddev
      FROM (SELECT metric, CASE WHEN event_us BETWEEN {AS_OF_US - seconds_back * 1_000_000} AND {AS_OF_US}
        THEN value END AS v FROM ev) GROUP BY metric"""


FLAGGED_Z = f"""SELECT metric, event_us, value, window_count, {r('mean')} AS mean, {r('stddev')} AS stddev,
  {r('z_score')} AS z_score FROM z"""

# What the message generator does to a row, and what the checks must say about it.
MESSAGES = """m AS (SELECT event_id AS row_num, event_type, user_id % 8 AS form, value, props, ts,
    epoch_us(ts) AS us, CASE WHEN value < 2 THEN '' ELSE event_type END AS metric FROM events),
  judged AS (SELECT *, CASE
    WHEN value BETWEEN 2 AND 4 THEN 'invalid_json'
    WHEN value BETWEEN 5 AND 6 THEN 'missing_field'
    WHEN value BETWEEN 7 AND 7.5 THEN 'not_an_object'
    WHEN form = 5 THEN 'timestamp_range'
    WHEN form IN (2, 3) THEN 'timestamp_format'
    WHEN metric = '' THEN 'metric_length'
    WHEN value > 200 THEN 'value_type'
    WHEN value > 150 THEN 'value_not_finite'
    WHEN form = 6 THEN 'meta_not_object' END AS reason FROM m),
  good AS (SELECT row_num, metric, us - CASE WHEN form = 4 THEN 7200000000 ELSE 0 END AS event_us,
    make_timestamp(us - CASE WHEN form = 4 THEN 7200000000 ELSE 0 END) AS ts, value, props
    FROM judged WHERE reason IS NULL)"""

# The text of a message as the generator builds it from a row of ``judged``.
STAMP = f"""CASE form WHEN 0 THEN '"' || {ISO_US} || 'Z"' WHEN 1 THEN {SECONDS} WHEN 2 THEN '"' || {SECONDS} || '"'
  WHEN 3 THEN '"' || substr({ISO_US}, 1, 7) || '"' WHEN 4 THEN '"' || {ISO_US} || '+02:00"' WHEN 5 THEN '100.0'
  ELSE '"' || {ISO_US} || '"' END"""
WHOLE = f"""'{{"timestamp": ' || {STAMP} || ', "metric": "' || metric || '", "value": ' ||
  CASE WHEN value > 200 THEN '"high"' WHEN value > 150 THEN '1e309' WHEN value > 120 THEN '"' || value::VARCHAR || '"'
    ELSE value::VARCHAR END || ', "meta": ' || CASE WHEN form = 6 THEN '[1]' ELSE props END || '}}'"""
RAW = f"""CASE WHEN value BETWEEN 2 AND 4 THEN substr({WHOLE}, 1, 20)
  WHEN value BETWEEN 5 AND 6 THEN '{{"timestamp": ' || {STAMP} || '}}'
  WHEN value BETWEEN 7 AND 7.5 THEN '[' || {WHOLE} || ']' ELSE {WHOLE} END"""


def limiter(key: str) -> str:
    """Greedy minimum interval as a recursion from one sent alert to the next."""
    return f"""a AS (SELECT {key} AS k, metric, event_us, value, anomaly_id FROM z),
      sent AS (SELECT k, min(event_us) AS sent_us FROM a GROUP BY k
        UNION ALL
        SELECT sent.k, (SELECT min(a.event_us) FROM a WHERE a.k = sent.k AND a.event_us >= sent.sent_us + {ALERT_US})
        FROM sent WHERE EXISTS (SELECT 1 FROM a WHERE a.k = sent.k AND a.event_us >= sent.sent_us + {ALERT_US})),
      first_of AS (SELECT k, event_us, min(anomaly_id) AS anomaly_id FROM a GROUP BY k, event_us),
      verdict AS (SELECT a.metric, a.event_us, a.value,
        (sent.sent_us IS NOT NULL AND first_of.anomaly_id IS NOT NULL) AS sent
        FROM a LEFT JOIN sent ON a.k = sent.k AND a.event_us = sent.sent_us
        LEFT JOIN first_of ON first_of.k = a.k AND first_of.event_us = a.event_us AND first_of.anomaly_id = a.anomaly_id)"""


RECURSIVE_ZID = WITH_ZID.replace("WITH ", "WITH RECURSIVE ", 1)
ROUNDED = f"""q AS (SELECT anomaly_id, metric, event_us, ts, value, {r('mean')} AS mean, {r('stddev')} AS stddev,
  {r('z_score')} AS z_score FROM z)"""
WATERMARK = f"(SELECT ((max(epoch_us(ts)) - {HOUR_US}) // 1000) * 1000 FROM events)"
RETAINED = f"event_us >= {AS_OF_US - 6 * HOUR_US}"

RECORDS = f"""WITH {EV}, {window()}, {IDS}, {ZID}, {banded()},
  b AS (SELECT *, {EVENT_ID} AS event_id FROM p WHERE value < lower_bound OR value > upper_bound)
  SELECT anomaly_id, event_id, metric, value, {r('mean')} AS mean, {r('stddev')} AS stddev,
    {r('variance')} AS variance, {r('z_score')} AS z_score, 3.0::DOUBLE AS threshold,
    NULL::DOUBLE AS lower_bound, NULL::DOUBLE AS upper_bound, NULL::DOUBLE AS lower_percentile,
    NULL::DOUBLE AS upper_percentile, event_us, true AS is_anomaly, 'z-score' AS detection_method,
    window_count, event_us AS detected_us, props AS event_meta FROM z
  UNION ALL
  SELECT 'anomaly-' || substr(sha256('percentile:' || event_id), 1, 16), event_id, metric, value, {r('mean')},
    {r('stddev')}, NULL, NULL, NULL, lower_bound, upper_bound, 5.0::DOUBLE, 95.0::DOUBLE, event_us, true,
    'percentile', window_count, event_us, props FROM b"""

RUNS = """lines AS (SELECT l_orderkey, count(*) AS event_count, CAST(trunc(sum(l_quantity)) AS BIGINT) - 20 AS anomaly_count
    FROM lineitem GROUP BY l_orderkey),
  runs AS (SELECT o_orderkey::VARCHAR AS key, coalesce(event_count, 0) AS event_count,
    coalesce(anomaly_count, -20) AS anomaly_count, CASE o_orderstatus WHEN 'F' THEN 'failed'
    WHEN 'O' THEN 'running' ELSE 'parked' END AS status FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)"""

ORACLES: dict[str, str] = {
    "window_stats": STATS_SQL,
    "window_stats_sliced": STATS_SQL,
    "window_stats_bucketed": STATS_SQL,
    "window_stats_frame": STATS_SQL,
    "window_stats_tied": f"""WITH li AS (SELECT l_returnflag AS metric, l_shipdate AS ts, epoch_us(l_shipdate) AS event_us,
        l_extendedprice AS value FROM lineitem), {window('li', '7 days')}
      SELECT metric, event_us, value, window_count, {r('mean')} AS mean, {r('stddev')} AS stddev FROM s""",
    "snapshot_stats": f"""WITH {EV} SELECT metric, window_count, {r('mean')} AS mean, {r('variance')} AS variance,
      {r('stddev')} AS stddev FROM ({snapshot(6 * 3600)})""",
    "snapshot_stats_listed": f"""WITH {EV}, names AS (SELECT metric FROM ev UNION SELECT o_orderpriority FROM orders)
      SELECT names.metric, coalesce(window_count, 0) AS window_count, {r('coalesce(mean, 0)')} AS mean,
      {r('coalesce(variance, 0)')} AS variance, {r('coalesce(stddev, 0)')} AS stddev
      FROM names LEFT JOIN ({snapshot(6 * 3600)}) AS x ON names.metric = x.metric""",
    "latest_state": f"""WITH {EV}, {window()} SELECT metric, event_us, window_count, {r('mean')} AS mean,
      {r('variance')} AS variance, {r('stddev')} AS stddev FROM s
      WHERE event_us = (SELECT max(e.event_us) FROM ev e WHERE e.metric = s.metric)""",
    "retention": f"WITH {EV} SELECT metric, event_us, value FROM ev WHERE {RETAINED}",
    "retention_one_metric": f"WITH {EV} SELECT metric, event_us, value FROM ev WHERE {RETAINED} OR metric <> 'error'",
    "rolling_mean": f"""WITH {EV}, w AS (SELECT *, avg(value) OVER (PARTITION BY metric ORDER BY event_us
        ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS m FROM ev)
      SELECT metric, event_us, value, {r('m')} AS rolling_mean FROM w""",
    "zscore_anomalies": f"{WITH_Z} {FLAGGED_Z}",
    "zscore_scores": f"""WITH {EV}, {window()} SELECT metric, event_us, value,
      CASE WHEN window_count >= 5 AND stddev <> 0 THEN {r('(value - mean) / stddev')} END AS z_score,
      coalesce({ZHIT}, false) AS is_anomaly,
      CASE WHEN window_count < 5 THEN 'insufficient_data' WHEN stddev = 0 THEN 'zero_stddev' END AS skip_reason FROM s""",
    "zscore_anomalies_orders": f"""WITH o AS (SELECT o_orderpriority AS metric, o_orderdate AS ts,
        epoch_us(o_orderdate) AS event_us, o_totalprice AS value FROM orders), {window('o', '30 days')}
      SELECT metric, event_us, value, window_count, {r('mean')} AS mean, {r('stddev')} AS stddev,
      {r('(value - mean) / stddev')} AS z_score FROM s
      WHERE window_count >= 5 AND stddev > 0 AND abs((value - mean) / stddev) >= 2""",
    "percentile_anomalies": f"""WITH {EV}, {banded()} SELECT metric, event_us, value, window_count, {r('mean')} AS mean,
      {r('stddev')} AS stddev, lower_bound, upper_bound FROM p WHERE value < lower_bound OR value > upper_bound""",
    "percentile_anomalies_thinned": f"""WITH {EV}, {banded('5 days')} SELECT metric, event_us, value, window_count,
      lower_bound, upper_bound FROM p WHERE value < lower_bound OR value > upper_bound""",
    "window_percentiles": f"WITH {EV}, {banded()} SELECT metric, event_us, lower_bound, upper_bound FROM p",
    "percentile_with_nulls": f"""WITH {EV_SOME}, {banded()} SELECT metric, event_us, value, window_count, lower_bound,
      upper_bound FROM p WHERE value < lower_bound OR value > upper_bound""",
    "detector_tally": f"""WITH {EV}, {window()}, {banded()}
      SELECT 'z-score' AS detection_method, (SELECT count(*) FROM ev) AS total_checked,
        (SELECT count(*) FROM s WHERE {ZHIT}) AS total_anomalies
      UNION ALL SELECT 'percentile', (SELECT count(*) FROM ev),
        (SELECT count(*) FROM p WHERE value < lower_bound OR value > upper_bound)""",
    "candidate_scores": f"""WITH {EV}, {window()}, c AS (SELECT metric, event_us, 2 * value AS value, window_count,
        CASE WHEN window_count >= 5 AND stddev > 0 THEN (2 * value - mean) / stddev END AS z FROM s)
      SELECT metric, event_us, value, window_count, {r('z')} AS z_score, coalesce(abs(z) >= 2.5, false) AS is_anomaly FROM c""",
    "candidate_snapshot_scores": f"""WITH {EV}, snap AS ({snapshot(10 * 86400)}), c AS (SELECT ev.metric, event_us, value,
        window_count, CASE WHEN window_count >= 5 AND stddev > 0 THEN (value - mean) / stddev END AS z
        FROM ev JOIN snap ON ev.metric = snap.metric)
      SELECT metric, event_us, value, window_count, {r('z')} AS z_score, coalesce(abs(z) >= 3, false) AS is_anomaly FROM c""",
    "anomaly_records": RECORDS,
    "recent_anomalies": f"""{WITH_ZID} SELECT anomaly_id AS event_id, metric, value, event_us, {r('z_score')} AS z_score,
      event_us AS detected_us FROM z ORDER BY event_us DESC, anomaly_id LIMIT 100""",
    "live_feed": f"{WITH_ZID} SELECT anomaly_id, metric, value, event_us FROM z ORDER BY event_us DESC, anomaly_id LIMIT 100",
    "validated_events": f"WITH {MESSAGES} SELECT row_num, metric, event_us, value, replace(props, ' ', '') AS meta_json FROM good",
    "quarantine": f"WITH {MESSAGES} SELECT 'events' AS source, row_num, reason, {RAW} AS raw FROM judged WHERE reason IS NOT NULL",
    "quarantine_reasons": f"WITH {MESSAGES} SELECT reason, count(*) AS rows FROM judged WHERE reason IS NOT NULL GROUP BY reason",
    "validate_tally": f"""WITH {MESSAGES} SELECT count(*) AS consumed, count(*) FILTER (reason IS NULL) AS valid,
      count(*) FILTER (reason IS NOT NULL) AS invalid, count(*) FILTER (reason IS NULL AND metric <> 'signup') AS pushed,
      count(*) FILTER (reason IS NULL AND metric = 'signup') AS failed FROM judged""",
    "event_id_hash": f"WITH {EV} SELECT {EVENT_ID} AS event_id, metric, event_us, value FROM ev",
    "dedupe": f"WITH {EV} SELECT {EVENT_ID} AS event_id, metric, event_us, value, props AS meta_json FROM ev",
    "dedupe_shipments": """SELECT DISTINCT l_returnflag AS metric, epoch_us(l_shipdate) AS event_us,
      l_extendedprice AS value FROM lineitem""",
    "backlog": f"SELECT count(*) AS queue_size FROM events WHERE epoch_us(ts) >= {AS_OF_US}",
    "run_rules": f"""WITH {RUNS} SELECT key, 'status' AS rule, status AS found FROM runs WHERE status = 'parked'
      UNION ALL SELECT key, 'anomaly_count', anomaly_count::VARCHAR FROM runs WHERE anomaly_count < 0
      UNION ALL SELECT key, 'anomaly_count_exceeds', anomaly_count::VARCHAR FROM runs WHERE anomaly_count > event_count""",
    "status_rules": """SELECT o_orderkey::VARCHAR AS key, 'status' AS rule, 'lost' AS found FROM orders
      WHERE o_orderstatus NOT IN ('F', 'O')""",
    "result_rules": """SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS key, 'anomaly_score' AS rule,
      round(l_tax * 20 - 0.1, 2)::VARCHAR AS found FROM lineitem WHERE NOT (round(l_tax * 20 - 0.1, 2) BETWEEN 0 AND 1)""",
    "empty_batches": """SELECT c_custkey AS batch_id FROM customer
      WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "distinct_metrics": "SELECT DISTINCT event_type AS metric FROM events",
    "batch_metrics": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS batch_id, count(*) AS event_count,
      array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS metrics FROM orders GROUP BY 1""",
    "tracked_metric_count": "SELECT count(DISTINCT event_type) AS metrics_tracked FROM events",
    "dashboard_counters": f"""{WITH_Z} SELECT count(*) AS total_anomalies,
      count(*) FILTER ({AS_OF_US} - event_us < {5 * DAY_US}) AS recent_anomalies FROM z""",
    "run_summary": f"""{WITH_Z}, e AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_us, value FROM ev),
      runs AS (SELECT run_id, count(*) AS event_count, min(event_us) AS started_us, max(event_us) AS completed_us,
        CASE WHEN max(value) > 350 THEN 'failed' WHEN run_id = '2024-01-30' THEN 'running' ELSE 'completed' END AS status
        FROM e GROUP BY run_id),
      hits AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS anomaly_count FROM z GROUP BY 1)
      SELECT runs.run_id, event_count, coalesce(anomaly_count, 0) AS anomaly_count, started_us,
        CASE WHEN status <> 'running' THEN completed_us END AS completed_us, status
      FROM runs LEFT JOIN hits ON runs.run_id = hits.run_id""",
    "processor_summary": f"""WITH RECURSIVE {MESSAGES}, {window('good')}, {IDS}, {ZID}, {limiter(chr(39) * 2)} SELECT
      (SELECT count(*) FROM good) AS total_processed,
      (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS total_errors,
      (SELECT count(DISTINCT metric) FROM good) AS metrics_tracked,
      (SELECT count(*) FROM s WHERE {ZHIT}) AS total_anomalies,
      (SELECT count(*) FROM good WHERE event_us >= {AS_OF_US}) AS queue_size,
      (SELECT count(*) FROM good) AS detector_total_checked, (SELECT count(*) FROM z) AS detector_total_anomalies,
      2.0::DOUBLE AS detector_threshold, 5 AS detector_min_count,
      (SELECT count(*) FROM verdict) AS alert_total_broadcasted, (SELECT count(*) FILTER (sent) FROM verdict) AS alert_total_emails_sent,
      0::BIGINT AS alert_total_errors,
      (SELECT {r('avg(value)')} FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000)) AS avg_processing_time_ms""".replace(">= 3", ">= 2"),
    "fifo_order": f"WITH {EV} SELECT metric, event_us, value FROM ev ORDER BY metric, event_us",
    "alert_rate_limit": f"{RECURSIVE_ZID}, {limiter(chr(39) * 2)} SELECT metric, event_us, value, sent FROM verdict",
    "alert_rate_limit_by_metric": f"{RECURSIVE_ZID}, {limiter('metric')} SELECT metric, event_us, value, sent FROM verdict",
    "alert_tally": f"""{RECURSIVE_ZID}, {limiter(chr(39) * 2)} SELECT count(*) AS total_broadcasted,
      count(*) FILTER (sent) AS total_emails_sent, 0::BIGINT AS total_errors FROM verdict""",
    "alert_text": f"""{WITH_ZID}, {ROUNDED} SELECT anomaly_id, 'Anomaly Alert: ' || metric AS subject,
      'Anomaly Detected!' || chr(10) || chr(10) || 'Metric: ' || metric || chr(10) ||
      'Value: ' || printf('%.2f', value) || chr(10) || 'Mean: ' || printf('%.2f', mean) || chr(10) ||
      'Std Dev: ' || printf('%.2f', stddev) || chr(10) || 'Z-Score: ' || printf('%.2f', z_score) || chr(10) ||
      'Threshold: 3.00' || chr(10) || chr(10) || 'Detection Method: z-score' || chr(10) ||
      'Timestamp: ' || {ISO} || chr(10) || 'Detected At: ' || {ISO} AS body FROM q""",
    "alert_details": f"""{WITH_ZID}, {ROUNDED} SELECT anomaly_id, 'Anomaly Detected: ' || metric AS subject,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS detected, printf('%.2f', value) AS observed, printf('%.2f', z_score) AS z,
      printf('%.2f', mean) AS historical_mean, printf('%.2f', stddev) AS standard_deviation,
      {r('abs(value - mean)')} AS deviation,
      printf('%.2f', abs(value - mean)) || ' (' || printf('%.1f', abs(z_score)) || 'σ)' AS deviation_label FROM q""",
    "alert_recipients": f"""{WITH_ZID} SELECT anomaly_id, unnest(['ops@example.org', 'lead@example.org']) AS recipient FROM z""",
    "display_rows": f"""WITH {EV}, {window()}, {IDS}, {ZID}, {banded()},
      b AS (SELECT *, {EVENT_ID} AS event_id FROM p WHERE value < lower_bound OR value > upper_bound)
      SELECT anomaly_id, metric AS metric_text, printf('%.2f', value) AS value_text, printf('%.2f', {r('mean')}) AS mean_text,
        printf('%.2f', {r('stddev')}) AS stddev_text, printf('%.2f', {r('z_score')}) AS z_score_text FROM z
      UNION ALL SELECT 'anomaly-' || substr(sha256('percentile:' || event_id), 1, 16), metric, printf('%.2f', value),
        printf('%.2f', {r('mean')}), printf('%.2f', {r('stddev')}), 'N/A' FROM b""",
    "alert_messages": f"""{WITH_ZID} SELECT 'anomalies' AS channel, anomaly_id AS key, '{{"anomaly_id":"' || anomaly_id ||
      '","metric":"' || metric || '","value":' || value::VARCHAR || ',"event_us":' || event_us::VARCHAR ||
      ',"window_count":' || window_count::VARCHAR || '}}' AS value FROM z""",
    "topic_messages": f"""WITH {EV} SELECT metric AS key, '{{"timestamp":"' || {ISO} || '","metric":"' || metric ||
      '","value":' || value::VARCHAR || ',"meta":' || replace(props, ' ', '') || '}}' AS value FROM ev""",
    "file_events": f"WITH {EV} SELECT metric, event_us, value, replace(props, ' ', '') AS meta_json FROM ev WHERE value <= 300",
    "csv_quoted_newlines": f"WITH {EV} SELECT metric, event_us, value, '{{\"p\":' || replace(props, ' ', '') || '}}' AS meta_json FROM ev",
    "json_files": f"WITH {EV} SELECT metric, event_us, value, replace(props, ' ', '') AS meta_json FROM ev",
    "upload_report": f"""WITH {EV}, f AS (SELECT 'kind=' || metric || '/day=' || strftime(ts, '%Y-%m-%d') AS file, count(*) AS total_rows,
        count(*) FILTER (value <= 150) AS success_count, count(*) FILTER (value > 150) AS error_count FROM ev GROUP BY 1)
      SELECT file, true AS success, total_rows, success_count, error_count,
        CAST(CASE WHEN error_count <= 10 THEN error_count ELSE 0 END AS INTEGER) AS errors_listed,
        CASE WHEN error_count > 10 THEN 'Too many errors to display (' || error_count || ' total)' END AS errors_note,
        NULL::VARCHAR AS file_error FROM f
      UNION ALL SELECT 'absent.csv', false, 0, 0, 0, 0, NULL, 'File not found'
      UNION ALL SELECT 'data.xml', false, 0, 0, 0, 0, NULL, 'Invalid file format. Supported: CSV, JSON, TXT'""",
    "upload_totals": """SELECT count(*) FILTER (value <= 300) AS total_success_count,
      count(*) FILTER (value > 300) AS total_error_count FROM events""",
    "result_store": f"{WITH_ZID} SELECT anomaly_id, metric, event_us, value, window_count + 1000 AS window_count FROM z",
    "result_by_id": f"""{WITH_ZID} SELECT anomaly_id, metric, event_us, value, window_count + 1000 AS window_count FROM z
      WHERE anomaly_id = (SELECT min(anomaly_id) FROM z)""",
    "retention_rewrite": f"WITH {EV} SELECT metric, event_us, value FROM ev WHERE {RETAINED}",
    "event_store_range": f"""WITH {EV} SELECT metric, event_us, value FROM ev
      WHERE event_us BETWEEN {AS_OF_US - 5 * DAY_US} AND {AS_OF_US + 5 * DAY_US}""",
    "stream_window_stats": f"{STATS_SQL} WHERE event_us <= {WATERMARK}",
    "stream_restarted": STATS_SQL,
    "stream_arrival_scores": f"{WITH_Z} {FLAGGED_Z}",
    "stream_percentile_anomalies": f"""WITH {EV}, {banded()} SELECT metric, event_us, value, window_count, lower_bound,
      upper_bound FROM p WHERE (value < lower_bound OR value > upper_bound) AND event_us <= {WATERMARK}""",
    "stream_ingest": f"""WITH {MESSAGES} SELECT coalesce(reason, metric) AS metric, count(*) AS rows FROM judged GROUP BY 1""",
    "stream_progress": f"""WITH {MESSAGES} SELECT 0::BIGINT AS late_rows, count(*) AS consumed,
      count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NOT NULL) AS invalid FROM judged""",
    "stream_micro_batches": f"{WITH_Z} {FLAGGED_Z}",
    "stream_feed": f"{WITH_ZID} SELECT anomaly_id, metric, value, event_us FROM z ORDER BY event_us DESC, anomaly_id LIMIT 100",
    "stream_alerts": f"""{RECURSIVE_ZID}, {limiter(chr(39) * 2)} SELECT count(*) AS total_broadcasted,
      count(*) FILTER (sent) AS total_emails_sent, 0::BIGINT AS total_errors FROM verdict""",
    "stream_dedupe": f"WITH {EV} SELECT metric, event_us, value FROM ev",
}
