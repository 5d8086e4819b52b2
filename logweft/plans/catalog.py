"""Every operator as a query over the driver's tables, each with its DuckDB equivalent.

The tables hold no server logs, so ``events`` gives the lines of one
(``log_lines``), which go through the parser; the SQL side builds the same
lines.  Events are minutes apart, so spans of seconds become minutes or hours.
``catalog_files`` has the queries over files that are written and read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, rules
from ..functions.parse import in_window, parse_lines, session_label
from ..functions.schema import LogSchema
from ..functions.signals import RetrievalSignals
from ..operators import coverage, detect, evidence, followup, profile, references, spans, tables
from ..operators.gaps import minute
from ..operators.tables import folder, stored
from ..sources import files
from . import sql as adhoc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SCHEMA = LogSchema(rf"({rules.TIMESTAMPS[0][0]})", rules.TIMESTAMPS[0][1], rules.THREADS[0], (rules.SESSION_KEYS[0],))
SIGNALS = RetrievalSignals()


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Events that one task makes into lines and parses.
TASK_ROWS = 100_000


def dealt(spark: SparkSession, sf: str, each: int | None = None) -> DataFrame:
    """``events`` in ranges of event_id of about ``each`` rows, one for a core at least.

    A row group of Parquet is read by one task however many rows it has, and
    what is done to a line costs far more than to move it.
    """
    rows = table(spark, sf, "events")
    return rows.repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-rows.count() // (each or TASK_ROWS))), "event_id")


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(source_path, source_file, line_no, raw): each event as a line of a server's log."""
    # The generator keeps conditions on a line above it: Spark would take them below the exchange, and make the line there.
    return dealt(spark, sf).select(F.lit("/logs/server.log").alias("source_path"), F.lit("server.log").alias("source_file"), (F.col("event_id") + 1).alias("line_no"), F.explode(F.array(F.expr("""
        date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') || ' [http-nio-exec-' || (user_id % 16) || '] ' || CASE event_type
        WHEN 'view' THEN 'INFO com.shop.View.java:' || get_json_object(props, '$.k') || ' - entry, txId=' || event_id
        WHEN 'purchase' THEN 'INFO com.shop.Order.java:' || get_json_object(props, '$.k') || ' - exit, lapse(ms)=' || CAST(floor(value * 100) AS BIGINT)
        WHEN 'click' THEN 'WARN com.shop.Auth.java:7 RoleValidator getRelationsByObj - entry Count = ' || (CAST(get_json_object(props, '$.k') AS BIGINT) * 100) || ' rows returned'
        WHEN 'error' THEN 'ERROR com.shop.Db.java:9 java.sql.SQLException: jdbc pool ORA-' || (10000 + CAST(get_json_object(props, '$.k') AS BIGINT)) || ' HTTP 500 user=u' || user_id
        ELSE 'INFO Server statistics={jvm.threadCount=' || CAST(floor(value) AS BIGINT) || ', dbcp.ActiveConnections=' || (CAST(get_json_object(props, '$.k') AS BIGINT) % 30) || ', am.auth.responseTime=' || CAST(floor(value * 10) AS BIGINT) || ', serverName=node' || (CAST(get_json_object(props, '$.k') AS BIGINT) % 3) || '} createIndexTask scheduled' END"""))).alias("raw"))


#: The same lines in DuckDB, and their tables; queries below start with WITH and this.
L = r"""e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
l AS (SELECT event_id + 1 AS line_no, date_trunc('milliseconds', ts) AS ts, 'http-nio-exec-' || (user_id % 16) AS thread, event_type,
strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' [http-nio-exec-' || (user_id % 16) || '] ' || CASE event_type
WHEN 'view' THEN 'INFO com.shop.View.java:' || k || ' - entry, txId=' || event_id
WHEN 'purchase' THEN 'INFO com.shop.Order.java:' || k || ' - exit, lapse(ms)=' || CAST(floor(value * 100) AS BIGINT)
WHEN 'click' THEN 'WARN com.shop.Auth.java:7 RoleValidator getRelationsByObj - entry Count = ' || (k * 100) || ' rows returned'
WHEN 'error' THEN 'ERROR com.shop.Db.java:9 java.sql.SQLException: jdbc pool ORA-' || (10000 + k) || ' HTTP 500 user=u' || user_id
ELSE 'INFO Server statistics={jvm.threadCount=' || CAST(floor(value) AS BIGINT) || ', dbcp.ActiveConnections=' || (k % 30) || ', am.auth.responseTime=' || CAST(floor(value * 10) AS BIGINT) || ', serverName=node' || (k % 3) || '} createIndexTask scheduled' END AS raw FROM e),
log AS (SELECT line_no, ts AS timestamp, thread, raw AS raw_line, contains(lower(raw), 'lapse') AS has_latency, contains(lower(raw), 'jdbc') AS has_jdbc, contains(lower(raw), 'ldap') AS has_ldap, contains(lower(raw), 'hibernate') AS has_hibernate,
contains(lower(raw), 'connection wait') AS has_connection_wait, contains(lower(raw), 'staleobject') AS has_staleobject, contains(lower(raw), 'sql') AS has_sql, regexp_matches(lower(raw), 'count|rows|returned') AS has_count_rows,
(contains(raw, ' - entry') OR regexp_matches(lower(raw), 'rolevalidator|checkcredentialrole|getrelationsbyobj|getcredential')) AS has_entry_authz, contains(lower(raw), 'rest:') AS has_rest, regexp_matches(lower(raw), 'scheduled|createindex|batch|cron') AS has_scheduled,
CASE WHEN contains(raw, '.java:') OR contains(raw, '(') THEN nullif(regexp_extract(raw, '([A-Za-z][A-Za-z0-9_\.]*(?:\.java)?:\d+)', 1), '') END AS method_sig,
CASE WHEN contains(lower(raw), 'lapse') THEN TRY_CAST(nullif(regexp_extract(raw, 'lapse\(ms\)\s*=\s*(\d+)', 1), '') AS BIGINT) END AS latency_ms,
CASE WHEN regexp_matches(lower(raw), 'count|rows|returned') THEN TRY_CAST(nullif(regexp_extract(raw, '(?i)\b(Count|rows?|returned|result\s*(count|size)?)\s*[:=]?\s*(\d{3,})', 3), '') AS BIGINT) END AS result_count,
CASE WHEN regexp_matches(lower(raw), 'scheduled|createindex|batch|cron') THEN nullif(regexp_extract(raw, '([A-Za-z0-9_]+(?:TO|Job|Index|Task)[A-Za-z0-9_]*)', 1), '') END AS scheduled_op_name FROM l),
met AS (SELECT timestamp, thread, name AS metric_name, v AS metric_value, raw_line, line_no FROM (SELECT *, split_part(p, '=', 1) AS name, TRY_CAST(substr(p, instr(p, '=') + 1) AS DOUBLE) AS v FROM (SELECT *, unnest(regexp_extract_all(raw_line, '[a-zA-Z][\w.]+=[^,\s{}]+')) AS p FROM log WHERE contains(raw_line, 'Server statistics') OR contains(raw_line, 'msg='))) WHERE v IS NOT NULL),
piv AS (SELECT timestamp, max(CASE WHEN metric_name = 'jvm.threadCount' THEN metric_value END) AS thread_count, max(CASE WHEN metric_name = 'dbcp.ActiveConnections' THEN metric_value END) AS active_conns, max(CASE WHEN metric_name = 'am.auth.responseTime' THEN metric_value END) AS response_time,
max(CASE WHEN metric_name = 'hibernate.sessionCount' THEN metric_value END) AS hibernate_sessions, max(CASE WHEN metric_name = 'am.tomcat.thread.busy.count' THEN metric_value END) AS busy_threads, max(CASE WHEN metric_name = 'eventManager.threadPoolQueueSize' THEN metric_value END) AS queue_size FROM met GROUP BY timestamp)"""


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(log_lines(spark, sf), SCHEMA)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return spans.request_documents(parsed(spark, sf), SIGNALS, keep=stored)


#: Folders that queries share, by the session, what is in them and the files that it was made of.
_MADE: dict[tuple, str] = {}


def made(spark: SparkSession, sf: str, what: str, make: Callable[[], str]) -> str:
    """The folder that ``make`` has written from ``events``: once for a session and the table's files, and anew if it is gone."""
    rows = table(spark, sf, "events")
    key = (spark.sparkContext.applicationId, what, sf, *sorted(rows.inputFiles()), rows.count())
    if key not in _MADE or not tables.exists(spark, _MADE[key]):
        _MADE[key] = make()
    return _MADE[key]


def loaded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The two log tables, parsed and written once for a session and its tables, as any analysis does before it asks."""
    def make() -> str:
        rows, at = parsed(spark, sf), folder(spark)
        tables.save(tables.log_events(rows, ["line_no"]), tables.server_metrics(rows), at)
        return at

    return tables.load(spark, made(spark, sf, "tables", make))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return loaded(spark, sf)[0]


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return loaded(spark, sf)[1]


def six(c: str) -> F.Column:
    return F.round(F.col(c).cast("double"), 6).alias(c)


# --- scans, parsing, extraction ---

@query(f"WITH {L} SELECT line_no, ts, thread, CASE WHEN regexp_matches(raw, 'txId=') THEN 'txId:' || regexp_extract(raw, 'txId=(\\S+)', 1) END AS session_label, raw AS clean FROM l")
def parse_log_lines(spark, sf):
    return parsed(spark, sf).select("line_no", "ts", "thread", session_label(F.col("clean"), SCHEMA).alias("session_label"), "clean")


@query(f"WITH {L} SELECT line_no, {', '.join(rules.FLAGS)} FROM log")
def flag_columns(spark, sf):
    return tables.log_events(parsed(spark, sf), ["line_no"]).select("line_no", *rules.FLAGS)


@query(f"WITH {L} SELECT line_no, method_sig, coalesce(latency_ms, -1) AS latency_ms, coalesce(result_count, -1) AS result_count, scheduled_op_name FROM log")
def extracted_values(spark, sf):
    return tables.log_events(parsed(spark, sf), ["line_no"]).select("line_no", "method_sig", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("latency_ms", "result_count")), "scheduled_op_name")


@query(f"WITH {L} SELECT timestamp, thread, metric_name, metric_value, CASE WHEN lower(metric_name) LIKE 'am.tomcat.%' THEN 'Tomcat' WHEN lower(metric_name) LIKE 'hibernate.%' THEN 'Hibernate' WHEN lower(metric_name) LIKE 'dbcp.%' THEN 'DBCP' WHEN contains(lower(metric_name), 'deliverymanager') THEN 'deliveryManager' WHEN lower(metric_name) LIKE 'eventmanager.%' THEN 'eventManager' ELSE 'System Information' END AS category FROM met")
def metric_rows(spark, sf):
    return tables.server_metrics(parsed(spark, sf)).select("timestamp", "thread", "metric_name", "metric_value", "category")


SIG = r"""sig AS (SELECT *, CASE WHEN NOT regexp_matches(raw_line, '(?i)\b(count|rows?|returned|lapse|rolevalidator|checkcredentialrole|getrelationsbyobj|getcredential|ucmrepository|eviction|cache|findbyfilter|ldap|jdbc|sql)') THEN NULL
WHEN regexp_matches(raw_line, '(?i)\b(Count|rows?|returned|result\s*(count|size)?)\s*[:=]?\s*(\d{3,})') THEN 'high_result_count' WHEN regexp_matches(raw_line, 'lapse\(ms\)\s*=\s*(\d{4,})') THEN 'extreme_latency'
WHEN regexp_matches(raw_line, '(?i)(RoleValidator|CheckCredentialRole|getRelationsByObj|getCredentialTO).*?(entry| - entry)') THEN 'authz_loop_candidate' WHEN regexp_matches(raw_line, '(?i)UCMRepository.*?(Request|Credential|Request\.java)') THEN 'heavy_repository_op'
WHEN regexp_matches(raw_line, '(?i)(Eviction|cache).*?(size|count)\s*=\s*(\d{3,})') THEN 'large_cache_event' WHEN regexp_matches(raw_line, '(?i)(findByFilter|LDAP|jdbc|SQL).*?(lapse|time|ms)\s*[:=]?\s*(\d{4,})') THEN 'slow_ldap_or_db' END AS signal_type,
CASE WHEN regexp_matches(raw_line, '(?i)\b(Count|rows?|returned|result\s*(count|size)?)\s*[:=]?\s*(\d{3,})') THEN CAST(regexp_extract(raw_line, '(?i)\b(Count|rows?|returned|result\s*(count|size)?)\s*[:=]?\s*(\d{3,})', 3) AS BIGINT) WHEN regexp_matches(raw_line, 'lapse\(ms\)\s*=\s*(\d{4,})') THEN CAST(regexp_extract(raw_line, 'lapse\(ms\)\s*=\s*(\d{4,})', 1) AS BIGINT) END AS captured_value FROM log)"""


@query(f"WITH {L}, {SIG} SELECT line_no, signal_type, coalesce(captured_value, -1) AS captured_value FROM sig WHERE signal_type IS NOT NULL")
def signal_classes(spark, sf):
    hit = parsed(spark, sf).withColumn("s", extract.high_signal(F.col("clean")))
    return hit.where("s.signal_type is not null").select("line_no", "s.signal_type", F.coalesce("s.captured_value", F.lit(-1)).cast("long").alias("captured_value"))


@query(f"WITH {L}, {SIG} SELECT timestamp, signal_type, captured_value, raw_line AS snippet, line_no FROM sig WHERE signal_type IS NOT NULL ORDER BY greatest(coalesce(captured_value, 0), 1) DESC, line_no LIMIT 80")
def prescan_candidates(spark, sf):
    return tables.signal_candidates(parsed(spark, sf)).select("timestamp", "signal_type", "captured_value", "snippet", "line_no")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS line_no, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))")
def line_explode(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("SELECT page_id, CAST(len(m) AS BIGINT) AS n_pairs, array_to_string(m, ';') AS pairs FROM (SELECT page_id, regexp_extract_all(html, '[a-zA-Z][A-Za-z0-9_.]+=[^,\\s{}]+') AS m FROM pages)")
def kv_extract_all(spark, sf):
    m = F.regexp_extract_all("html", F.lit(r"[a-zA-Z][A-Za-z0-9_.]+=[^,\s{}]+"), F.lit(0))
    return table(spark, sf, "pages").select("page_id", F.size(m).cast("long").alias("n_pairs"), F.array_join(m, ";").alias("pairs"))


@query(f"WITH {L} SELECT line_no, regexp_matches(raw, 'ERROR|Exception|FATAL|Failed|Refused|CRITICAL|Caused by:|stack trace') AS is_error, CAST(CASE WHEN regexp_matches(raw, 'ERROR|Exception|FATAL|Failed|Refused|CRITICAL') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(raw), ' - entry|:entry| entry,| - exit|:exit| exit,|lapse\\(ms\\)=') THEN 1 ELSE 0 END AS DOUBLE) AS anomaly_score FROM l")
def error_lines(spark, sf):
    c = F.col("clean")
    return parsed(spark, sf).select("line_no", extract.is_error(c, SIGNALS).alias("is_error"), extract.anomaly_score(c, SIGNALS).alias("anomaly_score"))


@query(f"WITH {L} SELECT line_no, replace(replace(replace(raw, '=', ' = '), '&', '+'), '+', ' ') AS decoded FROM l")
def url_decode(spark, sf):
    text = F.replace(F.replace(F.col("clean"), F.lit("="), F.lit("%20%3D+")), F.lit("&"), F.lit("%2B"))
    return parsed(spark, sf).select("line_no", extract.decode_urls(text).alias("decoded"))


@query(f"WITH {L} SELECT line_no, ts FROM l WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 23:59:59.999999')")
def window_filter_keep_nulls(spark, sf):
    from datetime import datetime

    return parsed(spark, sf).where(in_window(F.col("ts"), datetime(2024, 1, 5), datetime(2024, 1, 6, 23, 59, 59, 999999))).select("line_no", "ts")


@query(f"WITH {L} SELECT line_no, raw, line_no = 500 AS is_target FROM l WHERE line_no BETWEEN 495 AND 505")
def line_context(spark, sf):
    return files.window_around(log_lines(spark, sf), 500, 5).select("line_no", "raw", "is_target")


@query(f"WITH {L}, h AS (SELECT line_no AS hit FROM l WHERE contains(raw, 'ORA-10013') ORDER BY line_no LIMIT 3) SELECT hit AS line_no, string_agg(raw, chr(10) ORDER BY l.line_no) AS content FROM h JOIN l ON l.line_no BETWEEN hit - 2 AND hit + 2 GROUP BY hit")
def keyword_windows(spark, sf):
    return files.keyword_windows(log_lines(spark, sf), ["ora-10013"]).select("line_no", "content")


# --- detectors ---

@query("WITH o AS (SELECT ts AS timestamp, lag(ts) OVER (ORDER BY ts) AS prev_ts FROM events) SELECT timestamp, prev_ts, round((epoch_us(timestamp) - epoch_us(prev_ts)) / 1e6, 6) AS gap_seconds FROM o WHERE epoch_us(timestamp) - epoch_us(prev_ts) >= 120000000")
def log_gap(spark, sf):
    rows = detect.log_gap_rows(table(spark, sf, "events").select(F.col("ts").alias("timestamp")), top=None)
    return rows.withColumn("gap_seconds", F.round("gap_seconds", 6))


@query(f"WITH {L}, o AS (SELECT timestamp, lag(timestamp) OVER (ORDER BY timestamp) AS prev_ts FROM log) SELECT timestamp, prev_ts, round((epoch_us(timestamp) - epoch_us(prev_ts)) / 1e6, 6) AS gap_seconds FROM o WHERE epoch_us(timestamp) - epoch_us(prev_ts) >= 120000000 ORDER BY epoch_us(timestamp) - epoch_us(prev_ts) DESC, timestamp LIMIT 10")
def log_gap_top(spark, sf):
    return detect.log_gap_rows(events(spark, sf)).withColumn("gap_seconds", F.round("gap_seconds", 6))


@query(f"WITH {L} SELECT date_trunc('minute', timestamp) AS minute, count(*) AS lines_per_min FROM log GROUP BY 1")
def minute_rate(spark, sf):
    return detect.line_rate_rows(events(spark, sf), top=None)


@query(f"WITH {L} SELECT date_trunc('minute', timestamp) AS minute, count(*) AS lines_per_min FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def peak_rate(spark, sf):
    return detect.line_rate_rows(events(spark, sf))


@query(f"WITH {L}, m AS (SELECT date_trunc('hour', timestamp) AS minute, count(*) AS metric_rows FROM met GROUP BY 1), g AS (SELECT date_trunc('hour', timestamp) AS minute, count(*) AS log_rows FROM log GROUP BY 1) SELECT m.minute, metric_rows, coalesce(log_rows, 0) AS log_rows, round(coalesce(log_rows, 0) / metric_rows, 6) AS log_to_metric_ratio FROM m LEFT JOIN g USING (minute) WHERE metric_rows >= 12 AND coalesce(log_rows, 0) <= 15")
def metric_log_divergence(spark, sf):
    return detect.divergence_rows(metrics(spark, sf), events(spark, sf), unit="hour", least_metrics=12, most_logs=15, top=None).withColumn("log_to_metric_ratio", F.round("log_to_metric_ratio", 6))


@query(f"WITH {L}, d AS (SELECT timestamp, thread_count, active_conns, hibernate_sessions, thread_count - lag(thread_count) OVER (ORDER BY timestamp NULLS LAST) AS thread_delta, active_conns - lag(active_conns) OVER (ORDER BY timestamp NULLS LAST) AS conn_delta FROM piv WHERE thread_count IS NOT NULL OR active_conns IS NOT NULL) SELECT * FROM d WHERE (thread_delta > 5 AND conn_delta > 2) OR (thread_count > 100 AND active_conns > 20)")
def delta_correlation(spark, sf):
    return detect.correlation_rows(metrics(spark, sf), top=None)


@query(f"WITH {L}, b AS (SELECT min(timestamp) AS a, max(timestamp) AS z FROM log) SELECT count(DISTINCT CASE WHEN timestamp <= a + (z - a) / 3 THEN method_sig END) AS early_signatures, count(DISTINCT CASE WHEN timestamp >= a + 2 * (z - a) / 3 THEN method_sig END) AS late_signatures FROM log, b WHERE method_sig IS NOT NULL")
def endpoint_breadth(spark, sf):
    return detect.breadth_rows(events(spark, sf))


@query(f"WITH {L} SELECT timestamp, raw_line, result_count FROM log WHERE has_count_rows ORDER BY result_count DESC NULLS LAST, timestamp LIMIT 5")
def top_counts(spark, sf):
    return detect.result_count_rows(events(spark, sf))


@query(f"WITH {L}, b AS (SELECT timestamp, method_sig AS signature, count(*) OVER (PARTITION BY method_sig ORDER BY timestamp RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS burst FROM log WHERE has_entry_authz AND method_sig IS NOT NULL) SELECT * FROM b WHERE burst > 2")
def method_bursts(spark, sf):
    return detect.burst_rows(events(spark, sf), span=3_600, least=2, top=None)


@query(f"WITH {L} SELECT timestamp, thread_count, busy_threads, response_time FROM piv WHERE thread_count > 80 AND (busy_threads IS NULL OR busy_threads < thread_count * 0.3) AND (response_time IS NULL OR response_time > 500)")
def runtime_stall(spark, sf):
    return detect.stall_rows(metrics(spark, sf), top=None)


@query(f"WITH {L}, h AS (SELECT date_trunc('day', timestamp) AS hour_bucket, scheduled_op_name AS operation, count(*) AS n FROM log WHERE has_scheduled AND scheduled_op_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2) SELECT operation, count(DISTINCT hour_bucket) AS hours_seen, round(avg(n), 6) AS avg_occurrences, round(stddev(n), 6) AS std_occurrences FROM h GROUP BY 1 HAVING count(DISTINCT hour_bucket) >= 2 AND coalesce(stddev(n), 0) < 1000")
def recurring_ops(spark, sf):
    return detect.recurring_rows(events(spark, sf), unit="day", steady=1000, top=None).select("operation", "hours_seen", six("avg_occurrences"), six("std_occurrences"))


@query(f"WITH {L}, b AS (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY response_time) AS rt_p50, percentile_cont(0.5) WITHIN GROUP (ORDER BY thread_count) AS tc_p50, percentile_cont(0.5) WITHIN GROUP (ORDER BY active_conns) AS ac_p50 FROM piv) SELECT timestamp, response_time, thread_count, active_conns, queue_size, rt_p50, tc_p50, ac_p50 FROM piv, b WHERE (response_time > rt_p50 * 2 AND response_time > 200) OR thread_count > tc_p50 + 20 OR active_conns > ac_p50 + 5 OR queue_size > 10")
def onset_anchors(spark, sf):
    return detect.onset_rows(metrics(spark, sf), top=None)


@query(f"WITH {L} SELECT date_trunc('minute', timestamp) AS minute, max(thread_count) AS max_thread_count, max(active_conns) AS max_dbcp_active, max(hibernate_sessions) AS max_hibernate_sessions, max(response_time) AS max_response_time_ms FROM piv WHERE timestamp BETWEEN (SELECT min(timestamp) FROM met) - INTERVAL 3 MINUTE AND (SELECT min(timestamp) FROM met) + INTERVAL 5 MINUTE AND thread_count IS NOT NULL GROUP BY 1")
def onset_minute_metrics(spark, sf):
    rows = metrics(spark, sf)
    return detect.onset_minute_rows(tables.wide(rows), str(rows.agg(F.min("timestamp")).first()[0]))


@query(f"WITH {L} SELECT timestamp, timestamp AS ts, thread_count, active_conns AS dbcp_active_connections, response_time AS response_time_ms, response_time, CAST(NULL AS DOUBLE) AS dbcp_max_active FROM piv")
def wide_view(spark, sf):
    return tables.wide(metrics(spark, sf)).select("timestamp", "ts", "thread_count", "dbcp_active_connections", "response_time_ms", "response_time", "dbcp_max_active")


@query(f"WITH {L} SELECT date_trunc('hour', timestamp) AS hour, max(CASE WHEN metric_name = 'jvm.threadCount' THEN metric_value END) AS thread_count, max(CASE WHEN metric_name = 'dbcp.ActiveConnections' THEN metric_value END) AS active_conns FROM met GROUP BY 1")
def wide_pivot_hour(spark, sf):
    hourly = metrics(spark, sf).withColumn("hour", minute(F.col("timestamp"), "hour"))
    return tables.pivot(hourly, {"jvm.threadCount": "thread_count", "dbcp.ActiveConnections": "active_conns"}, "hour")


@query(f"WITH {L} SELECT timestamp, raw_line, latency_ms FROM log WHERE has_latency OR has_rest ORDER BY latency_ms DESC NULLS LAST, timestamp LIMIT 10")
def top_latency(spark, sf):
    return detect.onset_latency_rows(events(spark, sf), None)


@query(f"WITH {L} SELECT timestamp, raw_line FROM log WHERE has_jdbc OR has_ldap OR has_hibernate OR has_connection_wait OR has_staleobject")
def backend_signals(spark, sf):
    return detect.backend_rows(events(spark, sf), top=None)


@query(f"WITH {L} SELECT 'log' AS source, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS n FROM log UNION ALL SELECT 'metrics', min(timestamp), max(timestamp), count(*) FROM met")
def coverage_bounds(spark, sf):
    one = lambda df, name: tables.coverage(df).select(F.lit(name).alias("source"), "first_seen", "last_seen", "n")
    return one(events(spark, sf), "log").unionByName(one(metrics(spark, sf), "metrics"))


# --- profile ---

@query(f"WITH {L}, x AS (SELECT line_no, ts, thread, unnest(regexp_extract_all(raw, '\\b([A-Za-z_][A-Za-z0-9_.$]*(?:Exception|Error))\\b', 1)) AS exception FROM l), p AS (SELECT exception, thread, min(line_no) AS f FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY exception ORDER BY f, thread) AS k FROM p), t AS (SELECT exception, string_agg(thread, ',' ORDER BY thread) AS affected_threads FROM r WHERE k <= 10 GROUP BY 1), b AS (SELECT exception, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM x GROUP BY 1) SELECT exception, n, first_seen, last_seen, affected_threads FROM b JOIN t USING (exception)")
def exception_histogram(spark, sf):
    return profile.exceptions(parsed(spark, sf), SIGNALS).select("exception", F.col("count").alias("n"), "first_seen", "last_seen", F.array_join("affected_threads", ",").alias("affected_threads"))


@query(rf"""WITH {L}, m AS (SELECT line_no, 0 AS kind, 'property' AS type, unnest(x) AS value, unnest(range(0, len(x))) AS pos FROM (SELECT line_no, list_transform(regexp_extract_all(raw, '(?:^|[\s&])([a-zA-Z_][A-Za-z0-9_.$-]*\s*=\s*[^\s,;&]+)', 1), lambda v: regexp_replace(v, '\s*=\s*', '=')) AS x FROM l)
UNION ALL SELECT line_no, 4, 'error_code', unnest(x), unnest(range(0, len(x))) FROM (SELECT line_no, regexp_extract_all(raw, '\b([A-Z]{{3,6}}[-_]\d{{4,}}|\bcode=\d{{3,}}\b|\bextendedCode=\d+\b)', 1) AS x FROM l)
UNION ALL SELECT line_no, 5, 'http_status', 'HTTP ' || unnest(x), unnest(range(0, len(x))) FROM (SELECT line_no, regexp_extract_all(raw, '(?i)\bHTTP\s+(\d{{3}})\b', 1) AS x FROM l)
UNION ALL SELECT line_no, 7, 'session_id', 'txId=' || unnest(x), unnest(range(0, len(x))) FROM (SELECT line_no, regexp_extract_all(raw, '(?:txId|tx_id|TXID)[=:/]\s*(\S+)', 1) AS x FROM l)),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY line_no, kind, pos) AS k FROM m) SELECT type, value, line_no FROM f WHERE k = 1 ORDER BY line_no, kind, pos LIMIT 200""")
def diagnostic_entities(spark, sf):
    return profile.entities(parsed(spark, sf), SCHEMA).select("type", "value", "line_no")


SPANS = f"""WITH {L}, m AS (SELECT *, CAST(regexp_matches(lower(raw), ' - entry|:entry| entry,') AS INT) AS s, CAST(regexp_matches(lower(raw), ' - exit|:exit| exit,|lapse\\(ms\\)=') AS INT) AS x FROM l),
n AS (SELECT *, sum(s) OVER (PARTITION BY thread ORDER BY line_no) AS span FROM m), o AS (SELECT *, coalesce(sum(x) OVER (PARTITION BY thread, span ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)"""


@query(f"{SPANS} SELECT thread AS primary_key, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS line_count, max(x) = 0 AS unmatched_exit, md5(string_agg(raw, chr(10) ORDER BY line_no)) AS content_md5 FROM o WHERE span > 0 AND before = 0 GROUP BY thread, span")
def request_spans(spark, sf):
    docs = requests(spark, sf).where("key_type = 'api_request'")
    return docs.select("primary_key", "start_line", "end_line", F.col("line_count").cast("long").alias("line_count"), "unmatched_exit", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"{SPANS} SELECT line_no AS start_line, thread AS primary_key, regexp_matches(raw, 'ERROR|Exception') AS has_error_signal FROM o WHERE NOT (span > 0 AND before = 0) AND (regexp_matches(raw, 'ERROR|Exception|FATAL|Failed|Refused|CRITICAL') OR x = 1)")
def signal_events(spark, sf):
    return requests(spark, sf).where("key_type = 'api_signal_event'").select("start_line", "primary_key", "has_error_signal")


@query(f"{SPANS}, r AS (SELECT thread, s, x, sum(s - x) OVER (PARTITION BY thread ORDER BY line_no) AS run FROM m), p AS (SELECT sum(s) AS entries, sum(x) AS exits, greatest(0, -min(run)) AS ue FROM r GROUP BY thread) SELECT CAST(sum(exits - ue) AS BIGINT) AS matched_requests, CAST(sum(entries - (exits - ue)) AS BIGINT) AS unmatched_entries, CAST(sum(ue) AS BIGINT) AS unmatched_exits, round(CAST(sum(entries - (exits - ue)) + sum(ue) AS DOUBLE) / (sum(exits - ue) + sum(entries - (exits - ue)) + sum(ue)), 6) AS error_rate FROM p")
def request_health(spark, sf):
    return spans.request_health(parsed(spark, sf), SIGNALS).select(*(F.col(c).cast("long").alias(c) for c in ("matched_requests", "unmatched_entries", "unmatched_exits")), six("error_rate"))


@query(f"WITH {L}, g AS (SELECT thread, line_no, line_no - row_number() OVER (PARTITION BY thread ORDER BY line_no) AS run FROM l) SELECT thread, min(line_no) AS start_line, max(line_no) AS end_line FROM g GROUP BY thread, run")
def line_ranges_islands(spark, sf):
    return spans.islands(parsed(spark, sf), ["thread"], "line_no")


# --- evidence, coverage, follow-up: documents stand for evidence documents ---

def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")


@query("SELECT doc_id, max(CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM documents")
def neighbours(spark, sf):
    rows = documents(spark, sf).withColumn("seed", F.col("n_chars") % 7 == 0)
    return evidence.neighbours(rows, ["source"], "doc_id", "seed").select("doc_id", "near")


@query("WITH d AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 450), r AS (SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS used FROM d) SELECT * FROM r WHERE used <= 800000")
def budget_prefix(spark, sf):
    top = documents(spark, sf).orderBy(F.desc("n_chars"), "doc_id").limit(450)
    return evidence.budget_prefix(top, "doc_id", "n_chars", 800_000).select("doc_id", "used")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_seen_dedup(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return evidence.first_seen(rows, "key", "doc_id").select("doc_id")


@query("WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT doc_id, lang, n_chars FROM r WHERE k <= CASE lang WHEN 'en' THEN 8 WHEN 'de' THEN 3 WHEN 'fr' THEN 4 ELSE 2 END ORDER BY n_chars DESC, doc_id LIMIT 12")
def source_caps(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("lang").alias("source"), "n_chars")
    return followup.source_caps(rows, "n_chars", caps={"en": 8, "de": 3, "fr": 4}).select(F.col("item_id").alias("doc_id"), F.col("source").alias("lang"), "n_chars")


@query("WITH t AS (SELECT source, max(doc_id) AS total FROM documents GROUP BY 1), b AS (SELECT source, total, unnest(range(0, 4)) AS bucket FROM t), r AS (SELECT source, bucket, bucket * total // 4 + 1 AS first_line, (bucket + 1) * total // 4 AS last_line FROM b), s AS (SELECT source, doc_id AS line FROM documents WHERE n_chars % 5 = 0) SELECT r.source AS source_file, CAST(bucket AS BIGINT) AS bucket, CAST(first_line AS BIGINT) AS first_line, CAST(last_line AS BIGINT) AS last_line, count(line) AS selected FROM r LEFT JOIN s ON r.source = s.source AND line BETWEEN first_line AND last_line GROUP BY ALL")
def coverage_buckets(spark, sf):
    d = documents(spark, sf)
    totals = d.groupBy(F.col("source").alias("source_file")).agg(F.max("doc_id").alias("total_lines"))
    starts = d.where("n_chars % 5 = 0").select(F.col("source").alias("source_file"), F.col("doc_id").alias("line"))
    return coverage.bucket_counts(totals, starts).select("source_file", F.col("bucket").cast("long").alias("bucket"), F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), "selected")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_semi(spark, sf):
    picked = table(spark, sf, "labels").where("quality = 1")
    return coverage.chosen(documents(spark, sf).select("doc_id", "source"), picked, "doc_id")


@query("WITH t AS (SELECT doc_id AS text_id, 'see [REF_' || lang || '] and [REF_' || source || '], not [REF_none]' AS text FROM documents), r AS (SELECT lang AS id, min(doc_id) AS first_doc FROM documents GROUP BY 1 UNION ALL SELECT source, min(doc_id) FROM documents GROUP BY 1), m AS (SELECT text_id, unnest(x) AS ref_id, unnest(range(0, len(x))) AS position FROM (SELECT text_id, regexp_extract_all(text, '\\[(REF_[A-Za-z0-9_.\\-]+)\\]', 1) AS x FROM t)) SELECT text_id, ref_id, CAST(position AS BIGINT) AS position, coalesce(first_doc, -1) AS first_doc FROM m LEFT JOIN r ON ref_id = 'REF_' || id")
def ref_lookup(spark, sf):
    d = documents(spark, sf)
    texts = d.select(F.col("doc_id").alias("text_id"), F.format_string("see [REF_%s] and [REF_%s], not [REF_none]", "lang", "source").alias("text"))
    refs = d.select(F.explode(F.array("lang", "source")).alias("id"), "doc_id").groupBy("id").agg(F.min("doc_id").alias("first_doc")).select(F.concat(F.lit("REF_"), F.col("id")).alias("ref_id"), "first_doc", F.col("first_doc").alias("ord"))
    return references.cited(texts, refs).select("text_id", "ref_id", F.col("position").cast("long").alias("position"), F.coalesce("first_doc", F.lit(-1)).cast("long").alias("first_doc"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE n_chars > 2500) AS high_anomaly, count(*) FILTER (WHERE lang = 'en') AS iam_critical FROM documents")
def metadata_summary(spark, sf):
    rows = documents(spark, sf).select((F.col("n_chars") / 1000).alias("anomaly_score"), (F.col("lang") == "en").alias("iam_critical"))
    return coverage.summary(rows)


@query(f"WITH {L} SELECT thread, count(*) FILTER (WHERE has_count_rows) AS n_counts, max(latency_ms) AS worst FROM log GROUP BY 1")
def adhoc_sql(spark, sf):
    tables.register(*loaded(spark, sf))
    text = "-- latency by thread\nSELECT le.thread, COUNT(*) FILTER (WHERE has_count_rows = TRUE) AS n_counts, MAX(latency_ms) AS worst FROM log_events le GROUP BY le.thread"
    return adhoc.run(spark, text)


@query("SELECT p.event_id, coalesce(v.value, -1) AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def as_of_join(spark, sf):
    rows = table(spark, sf, "events")
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = rows.where("event_type = 'view'").select("user_id", "ts", "value")
    return adhoc.as_of(left, right, on="ts", by=["user_id"], value="value").select("event_id", F.coalesce("value", F.lit(-1.0)).alias("value"))


# --- benchmark pairs: scans of raw text against columns worked out once ---

#: The benchmark's own patterns of a method signature and of an operation.
SIG_RE, OP_RE = r"([A-Za-z0-9_\.]+(?:\.java)?:\d+)", r"([A-Za-z0-9_]+(?:TO|Job|Index|Task)[A-Za-z0-9_]*)"


def legacy(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("line_no", F.col("ts").alias("timestamp"), "thread", F.col("clean").alias("raw_line"))


@query(f"WITH {L} SELECT line_no, TRY_CAST(regexp_extract(raw, 'lapse\\(ms\\)=(\\d+)', 1) AS BIGINT) AS latency FROM l WHERE raw LIKE '%lapse(ms)%' ORDER BY latency DESC NULLS LAST, line_no LIMIT 50")
def legacy_top_extreme_latencies(spark, sf):
    rows = legacy(spark, sf).where(F.contains("raw_line", F.lit("lapse(ms)"))).select("line_no", F.regexp_extract("raw_line", r"lapse\(ms\)=(\d+)", 1).try_cast("bigint").alias("latency"))
    return rows.orderBy(F.desc_nulls_last("latency"), "line_no").limit(50)


@query(f"WITH {L} SELECT line_no, latency_ms FROM log WHERE has_latency ORDER BY latency_ms DESC NULLS LAST, line_no LIMIT 50")
def flag_top_extreme_latencies(spark, sf):
    return events(spark, sf).where("has_latency").select("line_no", "latency_ms").orderBy(F.desc_nulls_last("latency_ms"), "line_no").limit(50)


@query(f"WITH {L} SELECT line_no, TRY_CAST(regexp_extract(raw, '(\\d{{3,}})', 1) AS BIGINT) AS result_count FROM l WHERE raw LIKE '%Count%' OR raw LIKE '%rows%' OR raw LIKE '%returned%' ORDER BY result_count DESC NULLS LAST, line_no LIMIT 50")
def legacy_top_result_counts(spark, sf):
    rows = legacy(spark, sf).where("contains(raw_line, 'Count') or contains(raw_line, 'rows') or contains(raw_line, 'returned')").select("line_no", F.regexp_extract("raw_line", r"(\d{3,})", 1).try_cast("bigint").alias("result_count"))
    return rows.orderBy(F.desc_nulls_last("result_count"), "line_no").limit(50)


@query(f"WITH {L} SELECT line_no, result_count FROM log WHERE has_count_rows ORDER BY result_count DESC NULLS LAST, line_no LIMIT 50")
def flag_top_result_counts(spark, sf):
    return events(spark, sf).where("has_count_rows").select("line_no", "result_count").orderBy(F.desc_nulls_last("result_count"), "line_no").limit(50)


@query(f"WITH {L} SELECT line_no, regexp_extract(raw, '{SIG_RE}', 1) AS method_sig, count(*) OVER (PARTITION BY regexp_extract(raw, '{SIG_RE}', 1) ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS burst_count FROM l WHERE raw LIKE '% - entry%' OR raw LIKE '%RoleValidator%' ORDER BY burst_count DESC, line_no LIMIT 50")
def legacy_entry_authz_bursts(spark, sf):
    rows = legacy(spark, sf).where("contains(raw_line, ' - entry') or contains(raw_line, 'RoleValidator')").withColumn("method_sig", F.regexp_extract("raw_line", SIG_RE, 1))
    return detect.burst_counts(rows.select("line_no", "method_sig", "timestamp"), "method_sig", 3_600, "burst_count").drop("timestamp").orderBy(F.desc("burst_count"), "line_no").limit(50)


@query(f"WITH {L} SELECT line_no, method_sig, count(*) OVER (PARTITION BY method_sig ORDER BY timestamp RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS burst_count FROM log WHERE has_entry_authz AND method_sig IS NOT NULL ORDER BY burst_count DESC, line_no LIMIT 50")
def flag_entry_authz_bursts(spark, sf):
    rows = events(spark, sf).where("has_entry_authz and method_sig is not null").select("line_no", "method_sig", "timestamp")
    return detect.burst_counts(rows, "method_sig", 3_600, "burst_count").drop("timestamp").orderBy(F.desc("burst_count"), "line_no").limit(50)


@query(f"WITH {L} SELECT line_no, raw AS raw_line FROM l WHERE raw ILIKE '%jdbc%' OR raw ILIKE '%ldap%' OR raw ILIKE '%hibernate%' OR raw ILIKE '%connection%wait%' OR raw ILIKE '%staleobject%' ORDER BY line_no LIMIT 200")
def legacy_backend_dependency_signals(spark, sf):
    return legacy(spark, sf).where(" or ".join(f"raw_line ilike '%{w}%'" for w in ("jdbc", "ldap", "hibernate", "connection%wait", "staleobject"))).select("line_no", "raw_line").orderBy("line_no").limit(200)


@query(f"WITH {L} SELECT line_no, raw_line FROM log WHERE has_jdbc OR has_ldap OR has_hibernate OR has_connection_wait OR has_staleobject ORDER BY line_no LIMIT 200")
def flag_backend_dependency_signals(spark, sf):
    return events(spark, sf).where("has_jdbc or has_ldap or has_hibernate or has_connection_wait or has_staleobject").select("line_no", "raw_line").orderBy("line_no").limit(200)


@query(f"WITH {L} SELECT count(DISTINCT regexp_extract(raw, '{SIG_RE}', 1)) AS endpoint_count FROM l WHERE ts > (SELECT max(ts) - INTERVAL '1 hour' FROM l)")
def legacy_endpoint_breadth_late(spark, sf):
    rows = legacy(spark, sf)
    last = rows.agg(F.max("timestamp").alias("last"))
    return rows.crossJoin(F.broadcast(last)).where("timestamp > last - interval 1 hour").agg(F.countDistinct(F.regexp_extract("raw_line", SIG_RE, 1)).alias("endpoint_count"))  # one row


@query(f"WITH {L} SELECT count(DISTINCT method_sig) AS endpoint_count FROM log WHERE timestamp > (SELECT max(timestamp) - INTERVAL '1 hour' FROM log)")
def flag_endpoint_breadth_late(spark, sf):
    rows = events(spark, sf).select("timestamp", "method_sig")
    return rows.crossJoin(F.broadcast(rows.agg(F.max("timestamp").alias("last")))).where("timestamp > last - interval 1 hour").agg(F.countDistinct("method_sig").alias("endpoint_count"))  # one row


@query(f"WITH {L} SELECT regexp_extract(raw, '{OP_RE}', 1) AS op_name, count(*) AS op_count FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def legacy_recurring_scheduled_ops(spark, sf):
    return legacy(spark, sf).groupBy(F.regexp_extract("raw_line", OP_RE, 1).alias("op_name")).agg(F.count("*").alias("op_count")).orderBy(F.desc("op_count"), "op_name").limit(50)


@query(f"WITH {L} SELECT scheduled_op_name AS op_name, count(*) AS op_count FROM log WHERE has_scheduled AND scheduled_op_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def flag_recurring_scheduled_ops(spark, sf):
    return events(spark, sf).where("has_scheduled and scheduled_op_name is not null").groupBy(F.col("scheduled_op_name").alias("op_name")).agg(F.count("*").alias("op_count")).orderBy(F.desc("op_count"), "op_name").limit(50)
