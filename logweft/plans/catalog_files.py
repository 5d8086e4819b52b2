"""Queries over real log files: written from ``events`` into the shared folder, read back by ``read_lines``, each format detected.

A log for each of six nodes, in as many files as it was rotated into, each node with its own timestamps; among the lines
are stack frames, line prefixes, noise, critical words, malformed escapes,
lines without a timestamp and lines over 2,000 characters.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, rules
from ..functions.parse import any_contains, in_window, parse_lines, session_label
from ..functions.schema import detect_hybrid
from ..operators import classify, coverage, detect, evidence, followup, profile, references, spans, tables
from ..sources import files, logs
from ..streaming import monitor
from . import sql as adhoc
from .catalog import SCHEMA, SIGNALS, L, dealt, documents, events, folder, log_lines, made, metrics, query, requests, six, stored, table

NODES = 6
#: Events between two rotations of the logs.
ROTATED = 250_000
#: Each node's way of writing times: for Spark and for DuckDB.
STAMPS = [
    ("yyyy-MM-dd HH:mm:ss.SSS", "%Y-%m-%d %H:%M:%S.%g"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss.SSS", "%Y-%m-%dT%H:%M:%S.%g"),
    ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"), ("M/d/yy H:mm:ss:SSS", "%-m/%-d/%y %-H:%M:%S:%g"), ("M/d/yyyy H:mm:ss:SSS", "%-m/%-d/%Y %-H:%M:%S:%g"),
]
WHOLE_SECONDS = (1, 3)
#: A line's text after its time and thread, the first case that fits; the same SQL in both engines but for ``rep``.
BODY = """CASE WHEN event_id % 401 = 0 THEN 'INFO long ' || {rep} || ' ERROR'
WHEN event_id % 29 = 0 THEN 'ERROR FooError and java.lang.BarException: keyId=WrapAEK'
WHEN event_id % 23 = 0 THEN 'INFO seen by BazError'
WHEN event_id % 19 = 0 THEN 'INFO Audit took 5 ms - entry'
WHEN event_id % 17 = 0 THEN 'WARN GET /a%2Fb%ZZ+c%26amp;d sessionId=s' || (event_id % 100)
WHEN event_id % 13 = 0 THEN 'WARN CryptoService slow: Connection refused'
WHEN event_type = 'view' THEN 'INFO REST:get - entry txId=' || event_id
WHEN event_type = 'purchase' THEN 'INFO REST:get - exit,lapse(ms)=' || (event_id % 90000)
WHEN event_type = 'error' THEN 'ERROR TokenException: Failed with ' || user_id || ' HTTP 500'
ELSE 'INFO Server statistics={{jvm.threadCount=' || (event_id % 200) || ', dbcp.ActiveConnections=' || (event_id % 30) || '}}' END"""


def log_folder(spark: SparkSession, sf: str) -> str:
    """The folder with the files, ``node=K/part...``; written once for a session and its tables.

    All logs are rotated after ``ROTATED`` events, so no task sorts or writes a whole log; the names of a log's files follow its order.
    """
    def make() -> str:
        rows = dealt(spark, sf, ROTATED).select("event_id", "event_type", "user_id", "ts", (F.col("event_id") % NODES).cast("int").alias("node"))
        stamp = reduce(lambda c, k: F.when(F.col("node") == k, F.date_format("ts", STAMPS[k][0])).otherwise(c), range(NODES), F.lit(""))
        body = F.expr(BODY.format(rep="repeat('x', 2500)"))
        line = F.concat(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("[Line "), F.col("event_id").cast("string"), F.lit("] "))).otherwise(""), stamp, F.lit(" [http-nio-80-exec-"), (F.col("user_id") % 4).cast("string"), F.lit("] "), body)
        first = F.when(F.col("event_id") % 31 == 0, F.concat(F.lit("no time here, event "), F.col("event_id").cast("string"))).otherwise(line)
        frame = F.when((F.col("event_type") == "error") & (F.col("event_id") % 31 != 0), F.concat(F.lit("    at com.shop.Db.run(Db.java:"), (F.col("event_id") % 50).cast("string"), F.lit(")")))
        lines = rows.select("node", "event_id", F.explode(F.filter(F.array(first, frame), lambda x: x.isNotNull())).alias("value"))
        at = folder(spark)
        lines.sortWithinPartitions("node", "event_id").select("value", "node").write.partitionBy("node").text(at)
        return at

    return made(spark, sf, "files", make)


def file_lines(spark: SparkSession, sf: str, node: int | None = None) -> DataFrame:
    """The lines of all nodes, or of one, of which only its own folder is read."""
    lines = files.read_lines(spark, log_folder(spark, sf) + ("" if node is None else f"/node={node}"), recursive=True, rotated=True)
    return lines.withColumn("node", F.regexp_extract("source_path", r"node=(\d+)", 1).cast("int")).withColumn("source_file", F.concat(F.lit("node"), F.col("node").cast("string")))


def schemas(lines: DataFrame) -> dict[int, object]:
    """Each node's schema, from the first lines of its file."""
    return {k: detect_hybrid(found) for k, found in sorted(files.samples(lines, "node").items())}


def file_parsed(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for k, schema in schemas(file_lines(spark, sf)).items():
        one = parse_lines(file_lines(spark, sf, k), schema)
        parts.append(one.withColumn("label", session_label(F.col("clean"), schema)))
    return reduce(DataFrame.unionByName, parts)


_STAMP = "CASE event_id % 6 " + " ".join(f"WHEN {k} THEN strftime(ts, '{d}')" for k, (_, d) in enumerate(STAMPS)) + " END"
#: The same files in DuckDB: lines of each node, with what the parser finds in them.
X = f"""ev AS (SELECT event_id, event_type, user_id, ts, CAST(event_id % 6 AS INTEGER) AS node FROM events),
li AS (SELECT node, event_id, 0 AS part, CASE WHEN event_id % 31 = 0 THEN NULL ELSE CASE WHEN node IN {WHOLE_SECONDS} THEN date_trunc('second', ts) ELSE date_trunc('milliseconds', ts) END END AS ts,
CASE WHEN event_id % 31 = 0 THEN NULL ELSE 'http-nio-80-exec-' || (user_id % 4) END AS thread, CASE WHEN event_id % 7 = 0 AND event_id % 31 <> 0 THEN '[Line ' || event_id || '] ' ELSE '' END AS prefix,
CASE WHEN event_id % 31 = 0 THEN 'no time here, event ' || event_id ELSE {_STAMP} || ' [http-nio-80-exec-' || (user_id % 4) || '] ' || {BODY.format(rep="repeat('x', 2500)")} END AS clean FROM ev
UNION ALL SELECT node, event_id, 1, NULL, NULL, '', '    at com.shop.Db.run(Db.java:' || (event_id % 50) || ')' FROM ev WHERE event_type = 'error' AND event_id % 31 <> 0),
x AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY event_id, part) AS line_no, prefix || clean AS raw,
CASE WHEN regexp_matches(clean, '^\\s*at\\s') THEN false ELSE regexp_matches(clean, 'ERROR|Exception|FATAL|Failed|Refused|CRITICAL') END AS is_error,
regexp_matches(clean, 'CryptoService|keyId=WrapAEK|WrapAEK|TokenException') AS is_critical, regexp_matches(clean, '(?i)Audit took \\d+|Connection\\s*(reset|refused)') AS is_noise FROM li)"""


@query(f"WITH {X} SELECT node, line_no, md5(raw) AS raw_md5 FROM x")
def read_log_files(spark, sf):
    return file_lines(spark, sf).select("node", "line_no", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


@query(f"WITH {X} SELECT node, CASE node {' '.join(f'WHEN {k} THEN {repr(f)}' for k, (_, f, _) in enumerate(rules.TIMESTAMPS))} END AS timestamp_fmt, CAST(0 AS BIGINT) AS thread_shape, TRUE AS is_multiline, string_agg(DISTINCT CASE WHEN clean LIKE '%txId=%' THEN 'txId' WHEN clean LIKE '%sessionId=%' THEN 'sesId' END, ',' ORDER BY CASE WHEN clean LIKE '%txId=%' THEN 'txId' WHEN clean LIKE '%sessionId=%' THEN 'sesId' END DESC) AS session_keys FROM x WHERE line_no <= 400 GROUP BY node")
def detect_log_formats(spark, sf):
    found = schemas(file_lines(spark, sf))
    rows = [(k, s.timestamp_fmt, rules.THREADS.index(s.thread_re), s.is_multiline, ",".join(name for _, name in s.session_keys)) for k, s in found.items()]
    return spark.createDataFrame(rows, "node int, timestamp_fmt string, thread_shape long, is_multiline boolean, session_keys string")


@query(f"WITH {X} SELECT node, line_no, ts, thread, md5(clean) AS clean_md5, CASE WHEN clean LIKE '%txId=%' THEN 'txId:' || regexp_extract(clean, 'txId=(\\S+)', 1) WHEN clean LIKE '%sessionId=%' THEN 'sesId:' || regexp_extract(clean, 'sessionId=(\\S+)', 1) END AS label FROM x")
def parse_log_files(spark, sf):
    return file_parsed(spark, sf).select("node", "line_no", "ts", "thread", F.md5(F.col("clean").cast("binary")).alias("clean_md5"), "label")


@query(f"WITH {X} SELECT node, line_no, least(length(clean), 2000) AS shown, contains(clean, ' ERROR') AS whole_line_counts FROM x WHERE length(clean) > 2000")
def long_lines(spark, sf):
    rows = tables.log_events(file_parsed(spark, sf).withColumn("error", F.contains("clean", F.lit(" ERROR"))), ["node", "line_no", "error", "clean"])
    return rows.where(F.length("clean") > 2000).select("node", "line_no", F.length("raw_line").cast("long").alias("shown"), F.col("error").alias("whole_line_counts"))


@query(f"WITH {X}, s AS (SELECT *, CASE WHEN is_critical THEN 4.0 ELSE 0 END + CASE WHEN is_error THEN 2.0 ELSE 0 END + CASE WHEN contains(clean, ' - entry') OR contains(clean, ' - exit') THEN 1.0 ELSE 0 END AS total FROM x) SELECT node, line_no, is_error, is_critical, is_noise, CAST(CASE WHEN is_noise THEN least(total, 1.0) ELSE total END AS DOUBLE) AS anomaly_score FROM s")
def line_scores(spark, sf):
    c = F.col("clean")
    return file_parsed(spark, sf).select("node", "line_no", extract.is_error(c, SIGNALS).alias("is_error"), extract.is_critical(c, SIGNALS).alias("is_critical"), extract.is_noise(c, SIGNALS).alias("is_noise"), extract.anomaly_score(c, SIGNALS).alias("anomaly_score"))


@query(f"WITH {X} SELECT node, line_no, md5(replace(replace(replace(replace(clean, '%26amp;', '&'), '%2F', '/'), '+', ' '), '%20', ' ')) AS decoded_md5 FROM x")
def decode_log_files(spark, sf):
    return file_parsed(spark, sf).select("node", "line_no", F.md5(extract.decode_urls(F.col("clean")).cast("binary")).alias("decoded_md5"))


RANGES = """(SELECT node, min(line_no) AS a, max(line_no) AS z FROM (SELECT node, line_no, line_no - row_number() OVER (PARTITION BY node ORDER BY line_no) AS run FROM {of}) GROUP BY node, run)"""
TEXTS = "SELECT node, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '-' || z END, ', ' ORDER BY a) FILTER (WHERE k <= 8) || CASE WHEN count(*) > 8 THEN ', ... +' || (count(*) - 8) || ' ranges' ELSE '' END AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY a) AS k FROM {ranges}) GROUP BY node"


@query(f"WITH {X}, sev AS (SELECT * FROM x WHERE regexp_matches(clean, 'ERROR|FATAL|CRITICAL')), thr AS (SELECT * FROM x WHERE thread IS NOT NULL), r1 AS ({TEXTS.format(name='error_ranges', ranges=RANGES.format(of='sev'))}), r2 AS ({TEXTS.format(name='thread_ranges', ranges=RANGES.format(of='thr'))}) SELECT node, error_ranges, thread_ranges FROM r1 JOIN r2 USING (node)")
def line_ranges(spark, sf):
    rows = file_parsed(spark, sf).select("node", "line_no", "thread", "clean")
    severe = rows.where(any_contains(F.col("clean"), rules.SEVERITIES))
    texts = [spans.range_texts(spans.islands(part.select("node", "line_no"), ["node"], "line_no"), ["node"], name) for part, name in ((severe, "error_ranges"), (rows.where("thread is not null"), "thread_ranges"))]
    return texts[0].join(texts[1], "node")


@query(f"WITH {X} SELECT node, line_no FROM x WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 23:59:59.999999')")
def window_of_log_files(spark, sf):
    from ..functions.dates import query_context

    context = query_context("", "2024-01-05", "06/01/2024")  # dates only: whole days, in both ways of writing them
    return file_parsed(spark, sf).where(in_window(F.col("ts"), context.start, context.end)).select("node", "line_no")


@query(f"WITH {X} SELECT node, count(*) AS total_lines, count(*) FILTER (WHERE is_error) AS error_line_count, min(ts) AS first_seen, max(ts) AS last_seen FROM x GROUP BY node")
def profile_totals(spark, sf):
    rows = file_parsed(spark, sf)
    return reduce(DataFrame.unionByName, [profile.totals(rows.where(F.col("node") == k), SIGNALS).select(F.lit(k).alias("node"), "*") for k in range(NODES)])


@query(f"WITH {X}, h AS (SELECT node, line_no, ts, thread, unnest(regexp_extract_all(clean, '\\b([A-Za-z_][A-Za-z0-9_.$]*(?:Exception|Error))\\b', 1)) AS exception FROM x WHERE is_error OR is_critical) SELECT exception, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM h GROUP BY 1")
def exceptions_of_log_files(spark, sf):
    return profile.exceptions(file_parsed(spark, sf), SIGNALS).select("exception", F.col("count").alias("n"), "first_seen", "last_seen")


@query(f"WITH {X}, m AS (SELECT node, max(line_no) AS z FROM x GROUP BY node) SELECT node, line_no, md5(raw) AS raw_md5 FROM x JOIN m USING (node) WHERE line_no <= 7 OR line_no > z - 7")
def edge_lines(spark, sf):
    return files.edges(file_lines(spark, sf)).select("node", "line_no", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


@query(f"WITH {X} SELECT coalesce(thread, '') AS thread, count(*) AS n, count(*) FILTER (WHERE contains(lower(clean), 'lapse')) AS with_latency, (SELECT count(*) FROM x y WHERE contains(y.clean, 'Server statistics')) * 2 AS metric_rows FROM x GROUP BY 1")
def saved_tables(spark, sf):
    """Both tables written as a pair, read back and registered."""
    rows, at = file_parsed(spark, sf), folder(spark)
    tables.save(tables.log_events(rows), tables.server_metrics(rows), at)
    log, met = tables.load(spark, at)
    return log.groupBy("thread").agg(F.count("*").alias("n"), F.count_if("has_latency").alias("with_latency")).crossJoin(F.broadcast(met.agg(F.count("*").alias("metric_rows"))))  # one row


# --- the log source with its index, and log events with a skip index ---

def log_index(spark: SparkSession, sf: str, node: int, schema) -> str:
    return logs.build_index(spark, f"{log_folder(spark, sf)}/node={node}", schema, f"{folder(spark)}/index", range_bytes=65_536, rotated=True)


@query(f"WITH {X} SELECT node, line_no, ts, md5(raw) AS raw_md5 FROM x WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-05 01:00:00')")
def log_source_window(spark, sf):
    """An hour of six nodes through the source: only ranges that can hold it, or lines without a time, are read."""
    parts = []
    for k, schema in schemas(file_lines(spark, sf)).items():
        rows = logs.read_window(spark, log_index(spark, sf, k, schema), schema, datetime(2024, 1, 5), datetime(2024, 1, 5, 1))
        parts.append(rows.select(F.lit(k).alias("node"), "line_no", "ts", F.md5(F.col("raw").cast("binary")).alias("raw_md5")))
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {L} SELECT timestamp, thread, md5(raw_line) AS raw_md5 FROM log WHERE method_sig = 'com.shop.View.java:7' AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-21'")
def indexed_lookup(spark, sf):
    """All lines of one method in some days, by the skip index."""
    at = folder(spark)
    tables.save_indexed(events(spark, sf), at)
    return tables.find(spark, at, "method_sig", "com.shop.View.java:7", ("2024-01-03", "2024-01-20")).select("timestamp", "thread", F.md5(F.col("raw_line").cast("binary")).alias("raw_md5"))


# --- streams: the lines of six nodes, replayed in files, some of which bring lines of long ago ---

SLICES = 5
#: Which file a line comes in: six days each, and every 97th line two files late.
SLICE = f"least(div_(day(ts) - 1, 6), {SLICES - 1}) + CASE WHEN event_id % 97 = 0 AND day(ts) <= 18 THEN 2 ELSE 0 END"


def replay_folder(spark: SparkSession, sf: str) -> str:
    """``slice=I/node=K``: files that arrive one slice after the other, each line with its number, and a last line from much later."""
    def make() -> str:
        when = table(spark, sf, "events").select((F.col("event_id") + 1).alias("line_no"), F.expr(SLICE.replace("div_(day(ts) - 1, 6)", "(day(ts) - 1) div 6")).alias("slice"))
        lines = log_lines(spark, sf).join(when, "line_no").select("slice", "line_no", ((F.col("line_no") - 1) % NODES).alias("node"), F.concat(F.lit("[Line "), F.col("line_no").cast("string"), F.lit("] "), "raw").alias("value"))
        end = spark.createDataFrame([(SLICES, 0, 0, "[Line 0] 2025-01-01 00:00:00.000 [end] INFO closed")], lines.schema)
        at = folder(spark)
        lines = stored(lines.unionByName(end))
        for k in range(SLICES + 1):  # one after the other: a stream takes files by their age
            lines.where(F.col("slice") == k).repartition(NODES, "node").sortWithinPartitions("node", "line_no").select("value", "node").write.partitionBy("node").text(f"{at}/slice={k}")
        return at

    return made(spark, sf, "replay", make)


def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """The parsed stream, a slice in each batch."""
    rows = monitor.read_log_stream(spark, replay_folder(spark, sf), SCHEMA, recursiveFileLookup="true", maxFilesPerTrigger=str(NODES))
    return rows.withColumns({"line_no": F.regexp_extract("raw", r"^\[Line (\d+)\]", 1).cast("long"), "source_path": F.concat(F.lit("node"), F.regexp_extract("source_path", r"node=(\d+)", 1))})


def streamed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """What a query over a stream has written once all files are in."""
    at = folder(spark)
    running = monitor.start_into(df, f"{at}/out", f"{at}/checkpoint")
    running.awaitTermination()
    return monitor.emitted(spark, f"{at}/out", df)


#: The replay in DuckDB.  A batch drops what lies behind the newest time of all batches up to the second last, less the lateness allowed.
STREAM = f"""WITH {L}, b AS (SELECT l.*, (line_no - 1) % {NODES} AS node, CAST({SLICE.replace("event_id", "(line_no - 1)").replace("div_(day(ts) - 1, 6)", "(day(ts) - 1) // 6")} AS BIGINT) AS batch FROM l),
mark AS (SELECT x.batch, (SELECT max(y.ts) FROM b y WHERE y.batch <= x.batch - 2) AS newest FROM (SELECT DISTINCT batch FROM b) x)"""


@query(f"{STREAM}, r AS (SELECT b.*, date_trunc('hour', ts) AS hour, newest FROM b JOIN mark USING (batch)) SELECT hour AS minute, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(raw, 'ERROR|Exception|FATAL|Failed|Refused|CRITICAL')) AS errors FROM r WHERE newest IS NULL OR hour + INTERVAL 1 HOUR > newest - INTERVAL 1 DAY GROUP BY 1")
def stream_minute_counts(spark, sf):
    """Hours of all six nodes, in append mode: lines that come more than a day late are dropped."""
    return streamed(monitor.minute_counts(replayed(spark, sf), late="1 day", width="1 hour"), spark).select(F.col("minute").cast("timestamp_ntz").alias("minute"), "lines", "errors")


@query(f"{STREAM}, r AS (SELECT b.*, date_trunc('day', ts) - k * INTERVAL 1 DAY AS start, newest, nullif(regexp_extract(raw, '([A-Za-z][A-Za-z0-9_\\.]*(?:\\.java)?:\\d+)', 1), '') AS sig FROM b JOIN mark USING (batch), range(5) t(k) WHERE contains(raw, '.java:') OR contains(raw, '(')) SELECT start, sig AS method_sig, count(*) AS burst FROM r WHERE sig IS NOT NULL AND (newest IS NULL OR start + INTERVAL 5 DAY > newest - INTERVAL 1 DAY) GROUP BY 1, 2 HAVING count(*) > 3")
def stream_sliding_counts(spark, sf):
    """Method signatures seen more than three times in five days, every day, over the lines of six nodes."""
    got = monitor.bursts(replayed(spark, sf), span="5 days", slide="1 day", least=3, late="1 day")
    return streamed(got, spark).select(F.col("start").cast("timestamp_ntz").alias("start"), "method_sig", "burst")


@query(f"""{STREAM}, m AS (SELECT *, CAST(regexp_matches(lower(raw), ' - entry|:entry| entry,') AS INT) AS s, CAST(regexp_matches(lower(raw), ' - exit|:exit| exit,|lapse\\(ms\\)=') AS INT) AS x FROM b),
n AS (SELECT *, sum(s) OVER (PARTITION BY node, thread ORDER BY line_no) AS span FROM m), o AS (SELECT *, coalesce(sum(x) OVER (PARTITION BY node, thread, span ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT 'node' || node AS source_path, thread, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS lines, max(x) = 0 AS unmatched_exit FROM o WHERE span > 0 AND before = 0 GROUP BY node, thread, span""")
def stream_open_requests(spark, sf):
    """Requests of every node and thread as keyed state with event-time timers; lines that come late within 20 days are put in order."""
    spark.conf.set(*monitor.STORE)
    got = monitor.open_requests(replayed(spark, sf), SIGNALS, late="20 days", idle="100 days")
    return streamed(got, spark)


# --- requests: identifiers in the order in which requests end, metadata, line references ---

FLUSH = f"""WITH {L}, m AS (SELECT *, CAST(regexp_matches(lower(raw), ' - entry|:entry| entry,') AS INT) AS s, CAST(regexp_matches(lower(raw), ' - exit|:exit| exit,|lapse\\(ms\\)=') AS INT) AS x FROM l),
n AS (SELECT *, sum(s) OVER (PARTITION BY thread ORDER BY line_no) AS span FROM m), o AS (SELECT *, coalesce(sum(x) OVER (PARTITION BY thread, span ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
q AS (SELECT thread, span, min(line_no) AS start_line, max(line_no) AS end_line, max(x) AS closed, count(*) AS n FROM o WHERE span > 0 AND before = 0 GROUP BY thread, span),
f AS (SELECT *, CASE WHEN closed = 1 THEN end_line ELSE lead(start_line) OVER (PARTITION BY thread ORDER BY start_line) END AS flush FROM q)"""


@query(f"{FLUSH} SELECT start_line, thread || '_req_' || (row_number() OVER (ORDER BY flush NULLS LAST, start_line) - 1) AS request_span_id FROM f")
def request_span_ids(spark, sf):
    return requests(spark, sf).where("key_type = 'api_request'").select("start_line", "request_span_id")


@query(f"{FLUSH}, single AS (SELECT line_no FROM o WHERE NOT (span > 0 AND before = 0) AND (regexp_matches(raw, 'ERROR|Exception|FATAL|Failed|Refused|CRITICAL') OR x = 1)) SELECT start_line, thread AS request_key, 'request' AS request_level FROM f UNION ALL SELECT line_no, 'error_line', 'line' FROM single")
def request_metadata(spark, sf):
    return evidence.metadata_rows(requests(spark, sf)).select("start_line", "request_key", "request_level")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'lines ' || doc_id || '-' || (doc_id + 2) WHEN doc_id % 4 = 1 THEN 'lines 7, 9' WHEN doc_id % 4 = 2 AND doc_id % 3 = 0 THEN 'line ' || doc_id WHEN doc_id % 4 = 2 THEN 'lines ' || doc_id || '-' || (doc_id + 5) ELSE 'lines unavailable' END AS line_ref FROM documents")
def line_references(spark, sf):
    i = F.col("doc_id")
    rows = documents(spark, sf).select("doc_id", F.when(i % 4 == 0, F.concat_ws("-", i, i + 2)).otherwise("").alias("error_line_ranges"), F.when(i % 4 < 2, "7, 9").alias("line_ranges"), F.when(i % 4 == 2, i).alias("start_line"), F.when(i % 4 == 2, F.when(i % 3 == 0, i).otherwise(i + 5)).alias("end_line"))
    return rows.select("doc_id", references.line_reference_column().alias("line_ref"))


# --- evidence ---

def evidence_documents(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    content = F.concat(F.when(i % 5 == 0, F.concat(F.lit("boot\nTokenException:  key "), (i % 40).cast("string"), F.lit(" +%41\n"))).otherwise(""), F.col("text"))
    return documents(spark, sf).select(
        i.alias("row_id"), F.col("source").alias("source_file"), F.concat(F.lit("/logs/"), "source").alias("source_path"), F.col("lang").alias("primary_key"), F.when(i % 3 == 0, "api_signal_event").otherwise("api_request").alias("key_type"), content.alias("content"),
        (F.col("n_chars") % 50 / 10).cast("double").alias("anomaly_score"), (i % 4 == 0).alias("signal_candidate"), (i % 10 == 0).alias("iam_critical"), (i % 5 == 0).alias("has_error_signal"), i.alias("start_line"), (i + 1).alias("end_line"),
        F.concat(i.cast("string"), F.lit("-"), (i + 1).cast("string")).alias("line_ranges"), F.lit("").alias("error_line_ranges"), F.lit("s").alias("start_time"), F.lit("e").alias("end_time"))


MARKS = "|".join(["Exception", "Error", "Failed", "FATAL", "CRITICAL", "SecurityException", "SessionInvalid", "Caused by:"])
EVIDENCE = rf"""WITH d AS (SELECT doc_id AS row_id, coalesce(source, '') AS source_file, coalesce(lang, '') AS pk, doc_id % 3 = 0 AS ev, CASE WHEN doc_id % 5 = 0 THEN 'boot' || chr(10) || 'TokenException:  key ' || (doc_id % 40) || ' +%41' || chr(10) ELSE '' END || coalesce(text, '') AS content,
CAST(n_chars % 50 AS DOUBLE) / 10 AS score, doc_id % 4 = 0 AS sig, doc_id % 10 = 0 AS iam, doc_id % 5 = 0 AS err FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY sig DESC, iam DESC, err DESC, score DESC, row_id) <= 180 AS seed FROM d),
nb AS (SELECT *, max(CAST(seed AS INT)) OVER (PARTITION BY source_file, pk ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY seed DESC, sig DESC, iam DESC, err DESC, score DESC, row_id) - 1 AS rank FROM nb WHERE near),
c AS (SELECT *, regexp_matches(content, '{MARKS}') AS bad FROM r WHERE rank < 450),
t AS (SELECT *, CASE WHEN length(content) > CASE WHEN bad THEN 8000 ELSE 2000 END THEN substr(content, 1, CASE WHEN bad THEN 8000 ELSE 2000 END) || chr(10) || '... [truncated] ...' ELSE content END AS shown FROM c),
g AS (SELECT *, CASE WHEN bad THEN nullif(lower(trim(regexp_replace(list_filter(string_split(shown, chr(10)), lambda y: regexp_matches(y, '{MARKS}'))[1], '\s+', ' ', 'g'))), '') END AS same FROM t),
u AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY rank) AS k FROM g),
b AS (SELECT rank, row_id, '--- Request [score=' || printf('%.2f', score) || '] [REF_' || source_file || '_' || pk || '_' || rank || '] [source=' || CASE WHEN NOT seed THEN 'neighbour' WHEN sig THEN 'ranked:signal' ELSE 'ranked:fallback' END || '] [file=' || source_file || '] [request_key=' || CASE WHEN ev THEN 'error_line' ELSE pk END || '] [type=api_request] [lines ' || row_id || '-' || (row_id + 1) || '] [s -> e] ---' || chr(10) || 'Chunk Reference: [REF_' || source_file || '_' || pk || '_' || rank || ']' || chr(10) || 'Original Log Reference: ' || source_file || ', lines ' || row_id || '-' || (row_id + 1) || chr(10) AS head, shown FROM u WHERE same IS NULL OR k = 1)"""


@query(EVIDENCE + " SELECT rank, row_id, md5(head) AS head_md5, md5(array_to_string(list_transform(string_split(shown, chr(10)), lambda y: CASE WHEN contains(y, '%') OR contains(y, '+') THEN url_decode(replace(y, '+', ' ')) ELSE y END), chr(10))) AS body_md5 FROM b")
def evidence_order(spark, sf):
    """Ranks, headers, bodies as cut and decoded, and first-error-line repeats, the budget wide enough for all."""
    got = evidence.select_evidence(evidence_documents(spark, sf), max_chars=100_000_000)
    at = F.instr(F.col("block"), F.concat(F.lit("\nOriginal Log Reference: "), F.col("source_file")))
    head_end = F.instr(F.substring(F.col("block"), at + 1, F.lit(10_000)), F.lit("\n")) + at
    body = F.substring(F.col("block"), head_end + 1, F.lit(1_000_000))
    return got.select(F.col("rank").cast("long").alias("rank"), "row_id", F.md5(F.substring(F.col("block"), F.lit(1), head_end).cast("binary")).alias("head_md5"), F.md5(body.cast("binary")).alias("body_md5"))


@query("WITH f AS (SELECT doc_id AS position, source AS source_file, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS text FROM documents), b AS (SELECT position, chr(10) || chr(10) || repeat('=', 50) || chr(10) || '=== FILE: ' || source_file || ' | Category: api_request/x | Status: ok | Chunks: 3 | High-anomaly: 1 ===' || chr(10) || repeat('=', 50) || chr(10) || CASE WHEN length(text) > 6000 THEN substr(text, 1, 6000) || chr(10) || '... [Findings Truncated for Conciseness] ...' ELSE text END || chr(10) AS t FROM f WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND position % 13 <> 0), r AS (SELECT *, coalesce(sum(length(t)) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT position, md5(CASE WHEN length(t) > 600000 - before THEN substr(t, 1, CAST(600000 - before AS BIGINT)) || chr(10) || '... [Evidence Truncated — Budget Limit Reached] ...' ELSE t END) AS text_md5 FROM r WHERE before <= 600000")
def report_budget(spark, sf):
    """Findings of many files within the report's budgets: the file that crosses it is cut, not dropped."""
    i = F.col("doc_id")
    rows = documents(spark, sf).select(i.alias("position"), F.col("source").alias("source_file"), F.lit("api_request").alias("category"), F.lit("x").alias("subcategory"), F.lit("ok").alias("status"), F.lit(3).alias("chunk_count"), F.lit(1).alias("high_count"), (i % 13 != 0).alias("valid"), F.when(i % 11 == 0, "").otherwise(F.col("text")).alias("text"))
    return evidence.report(rows, file_cap=6_000).select("position", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- follow-ups ---

PROMPT = "'seen [REF_' || lang || '] ' || substr(text, 1, 400) || ' [REF_' || source || ' x] ' || substr(text, 401, 2000)"
ITEMS = f"WITH p AS (SELECT doc_id, {PROMPT} AS prompt, n_chars FROM documents), m AS (SELECT doc_id, prompt, n_chars, unnest(list_distinct(regexp_extract_all(prompt, '\\[(REF_[^\\]]+)\\]', 1))) AS item FROM p), i AS (SELECT doc_id, item, n_chars, substr(prompt, instr(prompt, '[' || item || ']'), 900) AS snippet FROM m), h AS (SELECT *, len(regexp_extract_all(lower(snippet), 'password')) + len(regexp_extract_all(lower(snippet), 'the')) + len(regexp_extract_all(lower(snippet), 'ref\\.x')) AS n_hits FROM i)"


def prompt_items(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    prompts = d.select(F.col("doc_id").cast("string").alias("source_file"), F.expr(PROMPT).alias("prompt"))
    items = followup.reference_items(prompts).withColumn("doc_id", F.col("source_file").cast("long"))
    return items.drop("anomaly_score").join(d.select("doc_id", (F.col("n_chars") / 1000).alias("anomaly_score")), "doc_id")


@query(f"{ITEMS}, r AS (SELECT *, least(1.0, 0.45 + 0.2 * n_hits) AS rel FROM h) SELECT doc_id, item, CAST(n_hits AS BIGINT) AS n_hits, round(CAST(rel AS DOUBLE), 6) AS relevance, round(CAST(rel + CASE WHEN contains(lower(snippet), 'password') THEN 0.08 ELSE 0 END + CASE WHEN n_chars / 1000.0 >= 2.5 THEN 0.08 ELSE 0 END AS DOUBLE), 6) AS fused FROM r")
def followup_candidates(spark, sf):
    """Every citation of every stored prompt, with or without a hit; hits count in its snippet."""
    got = followup.fused(followup.candidates(prompt_items(spark, sf), ["password", "the", "ref.x"]), ["PassWord"])
    return got.select("doc_id", F.col("item_id").alias("item"), F.col("n_hits").cast("long").alias("n_hits"), six("relevance"), six("fused"))


@query(f"{ITEMS} SELECT doc_id, item, CAST(0.65 AS DOUBLE) AS relevance FROM h")
def followup_without_terms(spark, sf):
    return followup.candidates(prompt_items(spark, sf), []).select("doc_id", F.col("item_id").alias("item"), six("relevance"))


@query("WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT doc_id, lang FROM r WHERE k <= CASE lang WHEN 'en' THEN 8 WHEN 'de' THEN 3 ELSE 2 END ORDER BY n_chars DESC, doc_id LIMIT 12")
def source_caps_unknown(spark, sf):
    """Two of every source that has no cap of its own."""
    rows = documents(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("lang").alias("source"), "n_chars")
    return followup.source_caps(rows, "n_chars", caps={"en": 8, "de": 3}).select(F.col("item_id").alias("doc_id"), F.col("source").alias("lang"))


@query("WITH r AS (SELECT doc_id, n_chars, '[' || doc_id || '] (api_ref) ' || substr(text, 1, 900) AS t, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents), s AS (SELECT *, sum(length(t) + 2) OVER (ORDER BY k) AS used FROM r WHERE k <= 12) SELECT md5(string_agg(t, chr(10) || chr(10) ORDER BY k)) AS block_md5 FROM s WHERE used <= 5000")
def followup_block(spark, sf):
    items = documents(spark, sf).select(F.col("doc_id").alias("item_id"), F.lit("api_ref").alias("source"), F.col("text").alias("snippet"), "n_chars").orderBy(F.desc("n_chars"), "item_id").limit(12)
    return followup.block_of(items, [F.desc("n_chars"), F.asc("item_id")], cap=5_000).select(F.md5(F.col("block").cast("binary")).alias("block_md5"))


# --- detectors with their own order and limit, supplements, scores ---

@query(f"WITH {L}, m AS (SELECT date_trunc('hour', timestamp) AS minute, count(*) AS metric_rows FROM met GROUP BY 1), g AS (SELECT date_trunc('hour', timestamp) AS minute, count(*) AS log_rows FROM log GROUP BY 1) SELECT m.minute, metric_rows, coalesce(log_rows, 0) AS log_rows FROM m LEFT JOIN g USING (minute) WHERE metric_rows >= 2 AND coalesce(log_rows, 0) <= 100000 ORDER BY metric_rows DESC, m.minute LIMIT 10")
def metric_log_divergence_top(spark, sf):
    return detect.divergence_rows(metrics(spark, sf), events(spark, sf), unit="hour", most_logs=100_000).select("minute", "metric_rows", "log_rows")


@query(f"WITH {L}, d AS (SELECT timestamp, thread_count, active_conns, hibernate_sessions, thread_count - lag(thread_count) OVER (ORDER BY timestamp) AS thread_delta, active_conns - lag(active_conns) OVER (ORDER BY timestamp) AS conn_delta FROM piv WHERE thread_count IS NOT NULL OR active_conns IS NOT NULL) SELECT * FROM d WHERE (thread_delta > 5 AND conn_delta > 2) OR (thread_count > 100 AND active_conns > 20) ORDER BY timestamp LIMIT 15")
def delta_correlation_top(spark, sf):
    return detect.correlation_rows(metrics(spark, sf))


@query(f"WITH {L}, b AS (SELECT timestamp, method_sig AS signature, count(*) OVER (PARTITION BY method_sig ORDER BY timestamp RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS burst FROM log WHERE has_entry_authz AND method_sig IS NOT NULL) SELECT * FROM b WHERE burst > 2 ORDER BY burst DESC, timestamp, signature LIMIT 10")
def method_bursts_top(spark, sf):
    return detect.burst_rows(events(spark, sf), span=3_600, least=2)


@query(f"WITH {L} SELECT timestamp, thread_count, busy_threads, response_time FROM piv WHERE thread_count > 80 AND (busy_threads IS NULL OR busy_threads < thread_count * 0.3) AND (response_time IS NULL OR response_time > 500) ORDER BY response_time DESC NULLS LAST, timestamp LIMIT 10")
def runtime_stall_top(spark, sf):
    return detect.stall_rows(metrics(spark, sf))


STEADY = "h AS (SELECT date_trunc('day', timestamp) AS d, scheduled_op_name AS operation, count(*) AS n FROM log WHERE has_scheduled AND scheduled_op_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {L}, {STEADY} SELECT operation, count(DISTINCT d) AS hours_seen, round(avg(n), 6) AS avg_occurrences FROM h GROUP BY 1 HAVING count(DISTINCT d) >= 2 AND coalesce(stddev(n), 0) < 12 ORDER BY 2 DESC, 1 LIMIT 10")
def recurring_ops_top(spark, sf):
    """The spread decides: operations of an unsteady rate are left out."""
    return detect.recurring_rows(events(spark, sf), unit="day", steady=12).select("operation", "hours_seen", six("avg_occurrences"))


@query(f"WITH {L}, b AS (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY response_time) AS rt, percentile_cont(0.5) WITHIN GROUP (ORDER BY thread_count) AS tc, percentile_cont(0.5) WITHIN GROUP (ORDER BY active_conns) AS ac FROM piv) SELECT timestamp, response_time, thread_count, active_conns, queue_size FROM piv, b WHERE (response_time > rt * 2 AND response_time > 200) OR thread_count > tc + 20 OR active_conns > ac + 5 OR queue_size > 10 ORDER BY timestamp LIMIT 20")
def onset_anchors_top(spark, sf):
    return detect.onset_rows(metrics(spark, sf)).select("timestamp", "response_time", "thread_count", "active_conns", "queue_size")


@query(f"WITH {L} SELECT timestamp, raw_line FROM log WHERE has_jdbc OR has_ldap OR has_hibernate OR has_connection_wait OR has_staleobject ORDER BY timestamp, raw_line LIMIT 15")
def backend_signals_top(spark, sf):
    return detect.backend_rows(events(spark, sf))


ONSET = "2024-01-05T12:00:00"
AROUND = "timestamp BETWEEN TIMESTAMP '2024-01-05 12:00:00' - INTERVAL 3 MINUTE AND TIMESTAMP '2024-01-05 12:00:00' + INTERVAL 10 MINUTE"


@query(f"WITH {L}, a AS (SELECT 'onset_extreme_latencies' AS name, timestamp, raw_line FROM log WHERE (has_latency OR has_rest) AND {AROUND} ORDER BY latency_ms DESC NULLS LAST, timestamp LIMIT 10), b AS (SELECT 'onset_backend_dependency_signals' AS name, timestamp, raw_line FROM log WHERE (has_jdbc OR has_ldap OR has_hibernate OR has_connection_wait OR has_staleobject OR has_sql) AND {AROUND} ORDER BY timestamp, raw_line LIMIT 15), w AS (SELECT 'metrics_coverage' AS name, min(timestamp) AS timestamp, CAST(count(*) AS VARCHAR) AS raw_line FROM piv) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM w")
def evidence_supplements(spark, sf):
    log, wide = events(spark, sf), tables.wide(metrics(spark, sf))
    with_onset, without = detect.supplements(log, wide, ONSET), detect.supplements(log, wide, None)
    named = lambda d, n, t, c: d[n].select(F.lit(n).alias("name"), F.col(t).alias("timestamp"), F.col(c).cast("string").alias("raw_line"))
    return reduce(DataFrame.unionByName, [named(with_onset, "onset_extreme_latencies", "timestamp", "raw_line"), named(with_onset, "onset_backend_dependency_signals", "timestamp", "raw_line"), named(without, "metrics_coverage", "first_seen", "snapshots")])


WEIGHTS = ", ".join(f"('{f}', '{a}', {w})" for t in (rules.FAMILY_WEIGHTS, rules.PRESCAN_BONUS) for f, ws in t.items() for a, w in ws.items())
KIND = "CASE event_type WHEN 'view' THEN 'log_gap' WHEN 'click' THEN 'high_volume_indicator' WHEN 'error' THEN 'slow_ldap_or_db' WHEN 'purchase' THEN 'metric_correlation' ELSE 'extreme_latency' END"


@query(f"WITH s AS (SELECT {KIND} AS f, count(*) * 5.0 / (SELECT count(*) FROM events) AS amount FROM events GROUP BY 1), w(f, archetype, weight) AS (VALUES {WEIGHTS}), a(archetype) AS (VALUES {', '.join(f'({a!r})' for a in rules.ARCHETYPES)}), t AS (SELECT archetype, least(1.0, CAST(coalesce(sum(amount * weight), 0) AS DOUBLE)) AS score FROM a LEFT JOIN (SELECT * FROM s JOIN w USING (f)) USING (archetype) GROUP BY 1), b AS (SELECT list(score ORDER BY score DESC) AS v FROM t) SELECT archetype, round(CASE WHEN archetype = 'mixed_compound' AND v[1] > 0.4 AND v[2] > 0.35 THEN least(1.0, (v[1] + v[2]) / 2) ELSE score END, 6) AS score FROM t, b")
def archetype_scores(spark, sf):
    """Families by strength, pre-scan hits as bonuses, and the compound rule, in one query."""
    rows = table(spark, sf, "events")
    n = rows.agg(F.count("*").alias("_n"))
    gains = rows.groupBy(F.expr(KIND).alias("kind")).agg(F.count("*").alias("_k")).crossJoin(F.broadcast(n)).select("kind", (F.col("_k") * 5.0 / F.col("_n")).alias("amount"))  # one row
    return classify.archetype_scores(gains).select("archetype", six("score"))


# --- ad-hoc SQL: each correction on a statement that needs it ---

def registered(spark: SparkSession, sf: str, text: str) -> DataFrame:
    tables.register(events(spark, sf), metrics(spark, sf))
    return adhoc.run(spark, text)


@query(f"WITH {L} SELECT count(*) AS n, max(thread_count) AS most FROM piv WHERE thread_count > 50")
def sql_means_wide(spark, sf):
    return registered(spark, sf, "SELECT COUNT(*) AS n, MAX(server_metrics.thread_count) AS most FROM server_metrics WHERE thread_count > 50")


@query(f"WITH {L} SELECT max(CASE WHEN metric_name = 'jvm.threadCount' THEN metric_value END) AS thread_count, count(*) AS n FROM met")
def sql_pivots_itself(spark, sf):
    return registered(spark, sf, "SELECT MAX(CASE WHEN metric_name = 'jvm.threadCount' THEN metric_value END) AS thread_count, COUNT(*) AS n FROM server_metrics sm WHERE sm.ts IS NOT NULL")


@query(f"WITH {L} SELECT thread, min(timestamp) AS first_seen, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 3) AS span FROM log GROUP BY 1")
def sql_times(spark, sf):
    return registered(spark, sf, "WITH t AS (SELECT le.thread, le.ts AS at FROM log_events le) SELECT thread, MIN(at) AS first_seen, ROUND(EXTRACT(EPOCH FROM (MAX(at) - MIN(at))), 3) AS span FROM t GROUP BY thread")


@query(f"WITH {L} SELECT thread, max(TRY_CAST(regexp_extract(raw_line, 'lapse\\(ms\\)=(\\d+)', 1) AS INTEGER)) AS worst FROM log GROUP BY 1")
def sql_casts_extracts(spark, sf):
    return registered(spark, sf, r"SELECT thread, MAX(CAST(regexp_extract(raw_line, 'lapse\\(ms\\)=(\\d+)', 1) AS INT)) AS worst FROM log_events GROUP BY thread")


@query(f"WITH {L} SELECT time_bucket(INTERVAL '6 hours', timestamp) AS bucket, count(*) AS n FROM log GROUP BY 1")
def sql_time_buckets(spark, sf):
    return registered(spark, sf, "SELECT time_bucket(INTERVAL '6' HOUR, timestamp) AS bucket, COUNT(*) AS n FROM log_events GROUP BY 1")


@query(f"WITH {L} SELECT 'log_events: ' || (SELECT count(*) FROM log) || ' rows, ' || (SELECT strftime(min(timestamp), '%Y-%m-%d') FROM log) AS bounds")
def sql_bounds(spark, sf):
    said = adhoc.bounds(events(spark, sf), tables.wide(metrics(spark, sf)))
    return said.select(F.regexp_extract("bounds", r"^(log_events: \d+ rows, \d{4}-\d\d-\d\d)", 1).alias("bounds"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n_chars / 1000.0 > 2.5) AS high FROM documents")
def metadata_top(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("row_id"), (F.col("n_chars") / 1000).alias("anomaly_score"), F.lit(False).alias("iam_critical"))
    return coverage.summary(rows).select(F.col("total").alias("n"), F.col("high_anomaly").alias("high"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8")
def top_scored_rows(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("anomaly_score"))
    return coverage.top_rows(rows, 8).select(F.col("row_id").alias("doc_id"), F.col("anomaly_score").alias("n_chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id WHEN doc_id % 3 = 1 THEN 4 ELSE 9 END AS first_line, CASE WHEN doc_id % 3 = 0 THEN doc_id + 7 WHEN doc_id % 3 = 1 THEN 12 ELSE 11 END AS last_line FROM documents")
def selected_bounds(spark, sf):
    """A row's lines: by its error ranges, else its ranges, else its start and end."""
    i = F.col("doc_id")
    rows = documents(spark, sf).select("doc_id", F.when(i % 3 == 0, F.concat((i + 7).cast("string"), F.lit(", "), i.cast("string"))).otherwise("").alias("error_line_ranges"), F.when(i % 3 < 2, "4-6, 12").otherwise("").alias("line_ranges"), F.lit(9).alias("start_line"), F.lit(11).alias("end_line"))
    first, last = coverage.row_bounds()
    return rows.select("doc_id", first.cast("long").alias("first_line"), last.cast("long").alias("last_line"))


# --- entities of every kind, diagnostic text ---

ENTITY_LINE = """CASE event_id % 8 WHEN 0 THEN 'set a= ' || (event_id % 50) WHEN 1 THEN 'see conf/app' || (event_id % 9) || '.yml' WHEN 2 THEN 'path: /etc/x' || (event_id % 7) || '.cfg'
WHEN 3 THEN 'id 3F2504e0-4f89-41d3-9a0c-0305e82c33' || lpad(CAST(event_id % 60 AS VARCHAR(2)), 2, '0') WHEN 4 THEN 'failed ERR-' || (1000 + event_id % 20) WHEN 5 THEN 'got http  ' || (400 + event_id % 10) || ' twice'
WHEN 6 THEN 'tok ' || repeat('Q', 30) || chr(65 + CAST(event_id % 20 AS INTEGER)) || ' end' ELSE 'txId: ' || (event_id % 40) END"""


@query("""WITH n AS (SELECT event_id AS line_no, event_id % 8 AS k, event_id AS i FROM events), m AS (
SELECT line_no, 0 AS kind, 'property' AS type, 'a=' || (i % 50) AS value FROM n WHERE k = 0 UNION ALL SELECT line_no, 1, 'file_path', 'conf/app' || (i % 9) || '.yml' FROM n WHERE k = 1
UNION ALL SELECT line_no, 1, 'file_path', 'etc/x' || (i % 7) || '.cfg' FROM n WHERE k = 2 UNION ALL SELECT line_no, 2, 'file_path', '/etc/x' || (i % 7) || '.cfg' FROM n WHERE k = 2
UNION ALL SELECT line_no, 3, 'uuid', '3F2504e0-4f89-41d3-9a0c-0305e82c33' || lpad(CAST(i % 60 AS VARCHAR), 2, '0') FROM n WHERE k = 3 UNION ALL SELECT line_no, 4, 'error_code', 'ERR-' || (1000 + i % 20) FROM n WHERE k = 4
UNION ALL SELECT line_no, 5, 'http_status', 'HTTP ' || (400 + i % 10) FROM n WHERE k = 5 UNION ALL SELECT line_no, 6, 'token_id', repeat('Q', 30) || chr(CAST(65 + i % 20 AS INTEGER)) FROM n WHERE k = 6
UNION ALL SELECT line_no, 7, 'session_id', 'txId=' || (i % 40) FROM n WHERE k = 7),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY line_no, kind) AS r FROM m) SELECT type, value, line_no FROM f WHERE r = 1 ORDER BY line_no, kind LIMIT 200""")
def entities_of_every_kind(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.expr(ENTITY_LINE.replace("VARCHAR(2)", "STRING")).alias("clean"))
    return profile.entities(rows, SCHEMA).select("type", "value", "line_no")


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  at a.B(C.java:1)' ELSE lang || chr(10) || source END AS said FROM documents")
def diagnostic_text(spark, sf):
    """Blank lines and stack frames left out; a text of nothing else is kept as it is."""
    text = F.when(F.col("doc_id") % 9 == 0, F.lit("  at a.B(C.java:1)")).otherwise(F.concat("lang", F.lit("  \n   at com.X.y(Z.java:"), F.col("doc_id").cast("string"), F.lit(")\n\n\t... 12 more\n  "), "source", F.lit(" ")))
    return documents(spark, sf).select("doc_id", extract.diagnostic_text(text).alias("said"))


@query(f"""WITH {L}, gap AS (SELECT max((epoch_us(timestamp) - epoch_us(prev)) / 1e6) AS g FROM (SELECT timestamp, lag(timestamp) OVER (ORDER BY timestamp) AS prev FROM log)),
dv AS (SELECT max(m) AS m FROM (SELECT date_trunc('minute', timestamp) AS t, count(*) AS m FROM met GROUP BY 1) LEFT JOIN (SELECT date_trunc('minute', timestamp) AS t, count(*) AS n FROM log GROUP BY 1) USING (t) WHERE m >= 2 AND coalesce(n, 0) <= 1),
d AS (SELECT timestamp, thread_count, active_conns, thread_count - lag(thread_count) OVER (ORDER BY timestamp) AS td, active_conns - lag(active_conns) OVER (ORDER BY timestamp) AS cd FROM piv WHERE thread_count IS NOT NULL OR active_conns IS NOT NULL),
co AS (SELECT count(*) AS c, count(*) FILTER (WHERE td > 0 AND cd > 0) AS moved FROM (SELECT * FROM d WHERE (td > 5 AND cd > 2) OR (thread_count > 100 AND active_conns > 20) ORDER BY timestamp LIMIT 15)),
b AS (SELECT min(timestamp) AS a, max(timestamp) AS z FROM log), br AS (SELECT count(DISTINCT CASE WHEN timestamp <= a + (z - a) / 3 THEN method_sig END) AS early, count(DISTINCT CASE WHEN timestamp >= a + 2 * (z - a) / 3 THEN method_sig END) AS late FROM log, b),
bu AS (SELECT max(n) AS n FROM (SELECT count(*) OVER (PARTITION BY method_sig ORDER BY timestamp RANGE BETWEEN INTERVAL 30 SECOND PRECEDING AND CURRENT ROW) AS n FROM log WHERE has_entry_authz AND method_sig IS NOT NULL) WHERE n > 5),
st AS (SELECT least(10, count(*)) AS n FROM piv WHERE thread_count > 80 AND (busy_threads IS NULL OR busy_threads < thread_count * 0.3) AND (response_time IS NULL OR response_time > 500)),
f AS (SELECT 'log_gap' AS family, CASE WHEN g >= 120 THEN g / 360 END AS s FROM gap UNION ALL SELECT 'runtime_stall_indicator', m / 10.0 FROM dv UNION ALL SELECT 'metric_correlation', CASE WHEN c > 0 THEN moved / c + 0.2 END FROM co
UNION ALL SELECT 'endpoint_breadth', CASE WHEN late / greatest(early, 1) > 3 THEN late / greatest(early, 1) / 10 WHEN late <= 3 AND early <= 5 THEN 0.6 ELSE 0.35 END FROM br UNION ALL SELECT 'high_volume_indicator', least(5, count(*)) / 5 FROM log WHERE has_count_rows
UNION ALL SELECT 'high_volume_indicator', n / 50 FROM bu UNION ALL SELECT 'high_volume_indicator', max(n) / 5000 FROM (SELECT count(*) AS n FROM log GROUP BY date_trunc('minute', timestamp)) UNION ALL SELECT 'runtime_stall_indicator', CASE WHEN n > 0 THEN n / 5 + 0.2 END FROM st)
SELECT family, round(CAST(greatest(0, least(1, s)) AS DOUBLE), 6) AS strength FROM f WHERE s IS NOT NULL AND least(1, s) >= 0.3""")
def signals_found(spark, sf):
    """All detectors together, by strength."""
    found = detect.signal_frame(spark, detect.broad_signals(events(spark, sf), metrics(spark, sf)))
    return found.select(F.col("signal_family").alias("family"), six("strength"))
