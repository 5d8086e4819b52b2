import importlib
import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from logweft.functions import rules
from logweft.functions.dates import query_context
from logweft.functions.parse import in_window, parse_lines
from logweft.functions.schema import detect
from logweft.functions.signals import RetrievalSignals
from logweft.operators import tables
from logweft.plans import catalog, catalog_files, sql, workflow  # noqa: F401  importing registers the queries over files
from logweft.sources import files, logs, prompts
from logweft.streaming import monitor

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

LOG = [
    "2026-02-25 15:51:35.286 [http-nio-80-exec-1] INFO Server statistics={jvm.threadCount=120, dbcp.ActiveConnections=25, am.auth.responseTime=900, serverName=a}",
    "2026-02-25 15:51:36.000 [http-nio-80-exec-2] INFO com.a.Bar.java:123 REST:get - entry, txId=1",
    "2026-02-25 15:51:37.000 [http-nio-80-exec-2] ERROR java.lang.TokenException: code=500, \"quoted\"",
    "    at com.a.Bar(Bar.java:5)",
    "2026-02-25 15:51:38.000 [http-nio-80-exec-2] INFO REST:get - exit,lapse(ms)=97550",
    "2026-02-25 15:51:40.000 [http-nio-80-exec-3] WARN hibernate connection wait",
    "2026-02-25 15:58:40.000 [http-nio-80-exec-1] INFO msg={jvm.threadCount=180, dbcp.ActiveConnections=40} Count = 6891 rows returned",
    "2026-02-25 15:58:41.000 [http-nio-80-exec-1] INFO k=999 plain",
]


@pytest.fixture
def log(tmp_path):
    p = tmp_path / "logs" / "server.LOG"
    p.parent.mkdir()
    p.write_text("\n".join(LOG) + "\n")
    (p.parent / "notes.md").write_text("no log")
    return str(p)


def rows(df):
    as_text = lambda v: "" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(as_text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_catalogue_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), c.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_text_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(__spark_entry__)
    assert set(again.queries()) == set(catalog.QUERIES)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = "".join(f"line {i}\r\n" if i % 3 else f"line {i}\n" for i in range(5000))
    for n in ("a", "b"):
        (tmp_path / f"{n}.log").write_bytes(text.encode() + b"\xff last")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.read_lines(spark, str(tmp_path), recursive=True)
        assert got.rdd.getNumPartitions() > 4
        assert got.where(F.col("raw") != F.concat(F.lit("line "), F.col("line_no") - 1)).collect()[0].raw == "� last"
        assert got.groupBy("source_file").agg(F.countDistinct("line_no").alias("n"), F.max("line_no").alias("m")).distinct().count() == 2
        assert sorted(r.line_no for r in files.window_around(got.where("source_file = 'a.log'"), 5, 2).collect()) == [3, 4, 5, 6, 7]
        assert files.window_around(got, 9000, 2).count() == 0
        assert files.edges(got.where("source_file = 'a.log'"), 2).count() == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_and_uploads(tmp_path, log):
    folder = str(tmp_path / "logs")
    assert files.find_logs(folder) == [log] and files.find_logs(log) == [log] and files.split_by_size([log], 1) == ([], [log])
    (tmp_path / "my-Ticket.md").write_text("broken")
    assert [p.endswith("my-Ticket.md") for p in files.find_tickets([str(tmp_path), str(tmp_path)])] == [True]
    assert "broken" in files.ticket_text(files.find_tickets([str(tmp_path)])) and files.size_text(550_000_000) == "524.5 MB"
    got = files.save_uploads({"../../x.log": b"1"}, str(tmp_path / "up")) + files.save_uploads({"x.log": b"2"}, str(tmp_path / "up"))
    assert [p.rpartition("/")[2] for p in got] == ["x.log", "x_2.log"]
    with pytest.raises(ValueError):
        files.saved_name("x.exe", set())
    assert files.debug_sections("=== a ===\n1\n=== b ===\n2") == {"a": "1", "b": "2"}


def test_tables_of_a_log(spark, log, tmp_path):
    parsed = workflow.parsed_file(spark, log)[1]
    events, metrics = tables.log_events(parsed), tables.server_metrics(parsed)
    assert events.columns == tables.LOG_EVENTS and events.count() == 8 and metrics.count() == 5
    assert events.where("timestamp is null").count() == 1 and events.where("contains(raw_line, '\"quoted\"')").count() == 1
    wide = tables.wide(metrics).orderBy("timestamp").collect()
    assert [(w.thread_count, w.dbcp_active_connections, w.response_time_ms) for w in wide] == [(120, 25, 900), (180, 40, None)]
    assert {r.signal_type for r in tables.signal_candidates(parsed).collect()} == {"extreme_latency", "high_result_count"}
    for k in (events, events.limit(3)):
        tables.save(k, metrics, str(tmp_path / "t"))
    assert tables.load(spark, str(tmp_path / "t"))[0].count() == 3 and spark.table("server_metrics_wide").count() == 2
    half = next((tmp_path / "t").iterdir()).with_name("v9")  # a save that was not finished does not count
    (half / "log_events").mkdir(parents=True)
    assert tables.load(spark, str(tmp_path / "t"))[0].count() == 3
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path / "none"))


def test_api_analysis(spark, log, tmp_path):
    text, reports = workflow.run_pipeline(spark, [log], folder=str(tmp_path / "out"))
    r = reports[0]
    assert r.status == "ok" and r.profile["total_lines"] == 8 and "java.lang.TokenException" in r.profile["critical_signals"]
    assert r.profile["request_lifecycle_health"] == {"matched_requests": 1, "unmatched_entries": 0, "unmatched_exits": 0, "error_rate": 0.0}
    assert "server.LOG, lines" in text and r.references and "=== USER PROMPT ===" in open(r.artifacts["evidence"]).read()
    context = workflow.analysis_context("", log, "", "", text, reports)
    assert "REF_server.LOG" in workflow.answer(spark, "which exception?", context) and "Total: 1" in workflow.metadata_summary(context)
    whole, quarters = workflow.coverage_tables(context)
    assert whole[0]["total_lines_scanned"] == 8 and len(quarters) == 4 and workflow.answer(spark, " ", context) == "Please give a question."
    said = lambda m: '{"ask_type": "errors", "entities": ["TokenException"], "confidence": 0.9}' if "Read a follow-up" in m[0]["content"] else "it failed"
    assert workflow.answer(spark, "what went wrong with the token of the second thread, and who called it?", context, said).startswith("it failed\n\n### Evidence Table")
    assert "name an error" in workflow.answer(spark, "what went wrong with the token of the second thread, and who called it?", context)
    assert sum(b.selected for b in workflow.file_coverage(r).collect()) == len(r.row_ids)
    bad, _ = workflow.run_pipeline(spark, [log], context=query_context("", "2020-01-01"))
    assert "pre_log_boundary" in bad
    assert workflow.run_pipeline(spark, [str(tmp_path / "none")])[0] == "No log files."


def test_server_analysis_and_followup(spark, log, tmp_path):
    spark.catalog.clearCache()
    _, reports = workflow.run_pipeline(spark, [log], mode="server_monitoring", ticket="slow login", folder=str(tmp_path / "out"))
    s = reports[0].state
    assert s.classification["primary"]["archetype"] and s.onset["degradation_start"] and s.verdicts == ["PASS"] and "97550" in s.report and "Ticket" in s.report and not s.errors
    trace = [json.loads(x) for x in (tmp_path / "out" / "debug" / "debug_evidence_server.LOG.trace.jsonl").read_text().splitlines()]
    assert "=== ARCHETYPE CLASSIFICATION ===" in (tmp_path / "out" / "debug" / "debug_evidence_server.LOG.txt").read_text() and "6891" in s.summary
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert [t["step"] for t in trace] == list(range(1, len(trace) + 1))
    replies = iter(["```sql\nSELECT count(*) AS n FROM log_events\n```", "```sql\nDROP TABLE x\n```", "FINAL_ANSWER: 8 lines"])
    answer, done = workflow.followup_sql(spark, "how many?", lambda m: next(replies))
    assert answer == "8 lines" and [d.rows for d in done] == [1, -1] and "| 8 |" in done[0].text


def test_workflow_with_a_model(spark, log):
    said, verdicts = [], iter(["RETRY", "FAIL", "RECLASSIFY", "pass"])

    def ask(messages):
        said.append(messages[0]["content"])
        if "Choose the archetype" in said[-1]:
            return '{"primary": {"archetype": "db_connection_pressure", "confidence": 0.8}}'
        if "Name the patterns" in said[-1]:
            return '{"rejections": [{"operation": "nightlyJob", "reason": "steady"}]}'
        if "Judge" in said[-1]:
            return next(verdicts)
        return "SELECT count(*) FROM log_events" if "Gather" in said[-1] else "text [REF_unknown_1]"

    s = workflow.run_pipeline(spark, [log], mode="server_monitoring", ask=ask)[1][0].state
    second = s.archetype
    assert s.verdicts == ["RETRY", "FAIL", "RECLASSIFY", "PASS"] and second != "db_connection_pressure"
    assert len({id(x) for x in s.evidence}) == len(s.evidence) > len(s.known) == 4  # four rounds ask the same four things, which run once
    assert {x.package for x in s.evidence} == {second} and any(x.rows == 1 for x in s.evidence) and s.red_herrings[-1]["operation"] == "nightlyJob"

    def broken(messages):
        if "Judge" in messages[0]["content"] or "incident report" in messages[0]["content"]:
            raise RuntimeError("no model")
        return "{}"

    s = workflow.run_pipeline(spark, [log], mode="server_monitoring", ask=broken)[1][0].state
    assert s.verdicts == ["PASS"] and s.report.startswith("# Incident report") and len(s.errors) == 2


def test_replies_of_a_model_are_checked(spark, log):
    assert workflow.judged({"archetype": "db_connection_pressure", "confidence": 2, "more": 1}, {"db_connection_pressure": 0.4}) == {"archetype": "db_connection_pressure", "confidence": 0.4}
    assert [workflow.judged(x, {}) for x in (None, [], "x", {"archetype": "none of ours"}, {"archetype": ["db_connection_pressure"][0:0]})] == [None] * 5
    assert workflow.moment("2026-02-25T15:58:40") == "2026-02-25 15:58:40" and workflow.moment(" 2026-02-25 15:58:40.5 ") == "2026-02-25 15:58:40.5"
    assert [workflow.moment(x) for x in (None, 5, "2026-02-25", "2026-13-25 15:58:40", "2026-02-25 15:58:40' or reflect('a', 'b')")] == [None] * 5

    def odd(messages):
        text = messages[0]["content"]
        return '{"primary": ["x"], "degradation_start": "2026-02-25 15:58:40\' + 1", "rejections": "all", "reason": 3}' if "incident report" not in text and "Judge" not in text else "[1, 2]"

    s = workflow.run_pipeline(spark, [log], mode="server_monitoring", ask=odd)[1][0].state
    assert s.classification["classification_method"] == "deterministic_only" and s.onset["reason"] == "3" and "+ 1" not in str(s.onset["degradation_start"]) and not s.errors


@pytest.mark.parametrize("text,ok", [
    ("SELECT 'updated, deleted' AS x", True), ("-- c\nWITH a AS (SELECT 1) SELECT * FROM a", True), ("/* c */ select 1;", True), ("SELECT raw_line AS copy FROM log_events", True),
    ("SELECT sum(latency_ms) OVER w FROM log_events WINDOW w AS (PARTITION BY thread)", True), ("SELECT * FROM log_events WHERE thread IN (SELECT thread FROM server_metrics)", True), ("SELECT * FROM VALUES (1), (2) AS t(x)", True),
    ("WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a) SELECT * FROM b JOIN log_events ON true", True), ("SELECT w FROM log_events LATERAL VIEW explode(split(raw_line, ' ')) v AS w", True),
    ("DELETE FROM t", False), ("UPDATE t SET a=1", False), ("INSERT INTO log_events VALUES (1)", False), ("WITH a AS (SELECT 1) UPDATE t SET x=1", False), ("WITH a AS (SELECT 1) INSERT INTO log_events SELECT * FROM a", False), ("select 1; pragma x", False),
    ("-- only", False), ("", False), (None, False), ("/* open", False), ("select 1 from (", False), ("CREATE VIEW v AS SELECT 1", False), ("SHOW TABLES", False), ("EXPLAIN SELECT 1", False), ("SET a=b", False),
    ("SELECT * FROM text.`/etc/hostname`", False), ("SELECT * FROM parquet.`/data`", False), ("SELECT * FROM elsewhere", False), ("SELECT * FROM default.log_events", False), ("SELECT (SELECT max(x) FROM elsewhere)", False),
    ("WITH a AS (SELECT * FROM elsewhere) SELECT 1", False), ("SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/x`)", False), ("SELECT 1 FROM (WITH z AS (SELECT 1) SELECT * FROM z) JOIN z", False), ("WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", False),
    ("SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", False), ("SELECT reflect('java.lang.System', 'exit', 1)", False), ("SELECT 1 ORDER BY try_reflect('a', 'b')", False), ("SELECT input_file_name() FROM log_events", False),
    ("SELECT sum(1) OVER w FROM log_events WINDOW w AS (PARTITION BY reflect('a', 'b'))", False), ("SELECT transform(array(1), x -> reflect('a', 'b'))", False), ("SELECT * FROM range(5)", False), ("SELECT * FROM IDENTIFIER('log_events')", False),
    ("SELECT TRANSFORM(raw_line) USING 'cat' FROM log_events", False), ("SELECT current_user()", False), ("SELECT no_such_function(1)", False), ("EXECUTE IMMEDIATE 'SELECT 1'", False), ("TABLE log_events", True),
    ("SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.dir')", False), ("SELECT IDENTIFIER('java_' || 'method')('java.lang.System', 'getProperty', 'user.dir')", False), ("SELECT IDENTIFIER('try_' || 'reflect')('a', 'b')", False),
    ("SELECT 1 WHERE IDENTIFIER('reflect')('a', 'b') = 1", False), ("SELECT IDENTIFIER('thread') FROM log_events", False), ("SELECT sum(IDENTIFIER('abs')(1)) OVER (ORDER BY 1) FROM log_events", False), ("SELECT :p", False), ("SELECT x FROM VALUES (IDENTIFIER('reflect')('a', 'b')) AS t(x)", False),
    ("SELECT thread, count(*) FROM log_events GROUP BY ROLLUP (thread) HAVING count(*) > 1 ORDER BY 2 DESC NULLS LAST", True), ("SELECT trim(BOTH 'x' FROM thread), substring(thread FROM 1 FOR 2), timestampdiff(SECOND, timestamp, timestamp) FROM log_events WHERE thread LIKE ANY ('a', 'b') AND latency_ms IS DISTINCT FROM 1", True),
    ("SELECT lag(latency_ms) OVER (ORDER BY timestamp RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first(thread) IGNORE NULLS, percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms), transform(array(1), x -> x + 1)[0], CAST('1' AS INT), struct(1, 2) FROM log_events GROUP BY ALL", True),
])
def test_guard(spark, text, ok):
    assert (sql.rejection(spark, text) is None) == ok, sql.rejection(spark, text)
    assert ok or sql.execute(spark, text).rows == -1


def test_guard_looks_at_what_names_mean(spark, log, tmp_path):
    """A registered function of other code, and a name that came to mean something else, are refused on the analysed plan."""
    from pyspark.sql.types import StringType

    parsed = workflow.parsed_file(spark, log)[1]
    tables.register(tables.log_events(parsed), tables.server_metrics(parsed))
    spark.udf.register("shout", lambda x: x, StringType())
    (tmp_path / "f").write_text("secret")
    for text in ("SELECT shout(thread) FROM log_events", "SELECT thread FROM log_events WHERE shout('a') = 'a'"):
        assert sql.rejection(spark, text) and sql.execute(spark, text).rows == -1
        assert sql.analysed(spark, text)[0] is None
    for text in (f"SELECT * FROM text.`{tmp_path}/f`", "SELECT * FROM range(3)", "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", f"SELECT 1 WHERE EXISTS (SELECT * FROM text.`{tmp_path}/f`)"):
        assert sql.analysed(spark, text)[0] is None, text
    text = "WITH a AS (SELECT thread FROM log_events), b AS (SELECT * FROM a) SELECT count(*) AS n FROM a JOIN b ON a.thread = b.thread WHERE a.thread IN (SELECT thread FROM server_metrics)"
    assert sql.analysed(spark, text)[1] is None and sql.execute(spark, text).rows == 1


@pytest.mark.parametrize("text,want", [
    ("SELECT thread_count FROM server_metrics", "SELECT thread_count FROM server_metrics_wide AS server_metrics"),
    ("SELECT m.thread_count FROM server_metrics m -- server_metrics", "SELECT m.thread_count FROM server_metrics_wide m -- server_metrics"),
    ("SELECT cast(regexp_extract(a, 'x', 1) AS INT), CAST(a AS INT), 'CAST(regexp_extract' FROM log_events", "SELECT TRY_cast(regexp_extract(a, 'x', 1) AS INT), CAST(a AS INT), 'CAST(regexp_extract' FROM log_events"),
    ("SELECT le.ts FROM log_events le WHERE le.ts > '2024' AND raw_line = 'le.ts'", "SELECT le.timestamp FROM log_events le WHERE le.timestamp > '2024' AND raw_line = 'le.ts'"),
    ("SELECT max(CASE WHEN metric_name = 'a' THEN metric_value END) AS thread_count FROM server_metrics sm", "SELECT max(CASE WHEN metric_name = 'a' THEN metric_value END) AS thread_count FROM server_metrics sm"),
    ("SELECT sm.ts FROM server_metrics sm", "SELECT sm.timestamp FROM server_metrics sm"), ("SELECT sm.ts, thread_count FROM server_metrics sm", "SELECT sm.ts, thread_count FROM server_metrics_wide sm"),
    ("SELECT EXTRACT(EPOCH FROM (le.ts - b)) FROM log_events le", "SELECT (-timestampdiff(MICROSECOND, le.timestamp, b) / 1e6D) FROM log_events le"),
])
def test_rewrites(spark, text, want):
    got = sql.read(spark, text)
    assert got.reason is None and got.ready() == want


def test_empty_groups_are_null_before_they_are_cast(spark, log):
    """A line without a match costs no failed cast; texts, names and what is shown of a statement stay."""
    parsed = workflow.parsed_file(spark, log)[1]
    tables.register(tables.log_events(parsed), tables.server_metrics(parsed))
    text = r"SELECT CAST(regexp_extract(raw_line, 'lapse\\(ms\\)=(\\d+)', 1) AS INT), CAST(regexp_extract(raw_line, 'no such', 0) AS STRING) AS s, line FROM (SELECT le.*, upper(raw_line) AS line FROM log_events le)"
    statement = sql.read(spark, text)
    plain, got = spark.sql(statement.ready()), sql.run(spark, text)
    assert got.columns == plain.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert {r.s for r in got.collect()} == {""} and sql.execute(spark, text).sql == statement.ready()
    plan = catalog_files.sql_casts_extracts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and "try_cast(regexp_extract(" not in plan


def test_dialect_runs(spark, log):
    parsed = workflow.parsed_file(spark, log)[1]
    tables.register(tables.log_events(parsed), tables.server_metrics(parsed))
    got = sql.execute(spark, "SELECT time_bucket(INTERVAL 1 MINUTE, timestamp) AS m, COUNT(*)::DOUBLE AS n FROM log_events GROUP BY 1")
    assert got.rows == 3, got.text
    assert sql.execute(spark, "SELECT nothing FROM log_events").rows == -1
    sql.register_functions(spark)
    assert spark.sql("SELECT time_bucket(INTERVAL '5' MINUTE, timestamp_ntz'2026-02-25 15:58:40') AS b").first().b.minute == 55
    assert sql.execute(spark, "SELECT EXTRACT(EPOCH FROM (max(le.ts) - min(le.ts))) AS s, EXTRACT(epoch FROM TIMESTAMP_NTZ'1970-01-01 00:00:07') AS t FROM log_events le").text.splitlines()[-1] == "| 426.0 | 7.0 |".replace("426.0", str(425.714))
    assert sql.execute(spark, "SELECT COUNT(*) AS n FROM server_metrics WHERE server_metrics.thread_count > 100").text.splitlines()[-1] == "| 2 |"
    assert sql.shown(spark.range(60), 50)[0] == 60 and sql.shown(spark.range(60), 50)[1].endswith("... (10 more rows)") and "log_events: 8 rows" in sql.observation_bounds(spark.table("log_events"), spark.table("server_metrics_wide"))


def test_command_line_and_reports(spark, log, tmp_path):
    from logweft.__main__ import main
    from logweft.plans import report

    assert "TokenException" in main([log, "--out", str(tmp_path / "out")]) and (tmp_path / "out" / "reports" / "report.md").exists()
    from logweft.__main__ import converse

    analyze = lambda paths: workflow.analysis_context("", paths[0], "", "", *workflow.run_pipeline(spark, paths))
    assert converse(spark, analyze, ["what?"]).startswith("Analyse logs first") and "not found" in converse(spark, analyze, ["analyze /none/x.log", "exit", "more"])
    assert "REF_server.LOG" in converse(spark, analyze, [f"analyze '{log}'", "coverage", "", "which exception?", "quit"])
    md, js = report.write_benchmark(str(tmp_path / "b"), {"q": (10.0, 1.0), "z": (1.0, 0.0)}, {"load": 2.0})
    assert "| q | 10.0 | 1.0 | 10.0x |" in open(md).read() and json.load(open(js))["pairs"]["q"]["ratio"] == 10


def test_prompts(tmp_path):
    (tmp_path / "p.md").write_text("---\nid: a\n---\nHello {{ name }}\n---\nid: b\n---\nBye\n")
    assert prompts.render(prompts.load_fragment(str(tmp_path / "p.md"), "a"), name="you") == "Hello you"
    with pytest.raises(ValueError):
        prompts.fragments("---\nid: a\n---\nx\n---\nid: a\n---\ny\n")
    with pytest.raises(KeyError):
        prompts.render("{{x}}")


def test_streams_late_lines_and_restart(spark, tmp_path):
    """Hours in append mode with lines that come too late, and requests as keyed state over a restart, against plain versions."""
    from datetime import datetime, timedelta

    spark.conf.set(*monitor.STORE)
    r, start = random.Random(3), datetime(2024, 1, 1)
    marks = [" - entry", " - exit", " x", " x", " ERROR boom"]
    lines = [(k, start + timedelta(minutes=7 * k), f"t{r.randint(0, 2)}", r.choice(marks)) for k in range(400)]
    files = [[x for x in lines if x[0] // 100 == f and x[0] % 41] for f in range(4)]
    files[3] += [x for x in lines if not x[0] % 41 and x[0] < 300]  # from the first files, in the last one
    files[3] += [x for x in lines if not x[0] % 41 and x[0] >= 300]
    folder = tmp_path / "in"
    schema = "source_path string, thread string, ts timestamp_ntz, line_no long, clean string"

    def arrive(rows):
        spark.createDataFrame([("f", t, at, k, "line" + mark) for k, at, t, mark in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))

    def ended(what, like):
        q = monitor.start_into(like, str(tmp_path / what), str(tmp_path / f"cp-{what}"))
        q.awaitTermination()
        return q

    for rows in files[:2]:
        arrive(rows)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    hours = monitor.minute_counts(source, late="2 hours", width="1 hour")
    requests = monitor.open_requests(source, RetrievalSignals(), late="40 days", idle="400 days")
    ended("requests", requests)
    assert not monitor.emitted(spark, str(tmp_path / "requests"), requests).count()  # nothing is certain yet
    for rows in [*files[2:], [(10**6, start + timedelta(days=1000), "end", " x")]]:
        arrive(rows)
    ended("requests", requests)
    want, state = set(), {}
    for k, _, t, mark in sorted(lines):
        if mark == " - entry":
            if t in state:
                want.add((t, *state.pop(t), True))
            state[t] = [k, k, 0]
        if t in state:
            state[t][1:] = [k, state[t][2] + 1]
            if mark == " - exit":
                want.add((t, *state.pop(t), False))
    want |= {(t, *x, True) for t, x in state.items()}
    assert {(x.thread, x.start_line, x.end_line, x.lines, x.unmatched_exit) for x in monitor.emitted(spark, str(tmp_path / "requests"), requests).collect()} == want

    q = ended("hours", hours)
    newest, counts, lost = [None] * 5, {}, 0
    for b, rows in enumerate(files):
        newest[b] = max([x[1] for x in rows] + ([newest[b - 1]] if b else []))
        for _, at, _, _ in rows:
            hour = at.replace(minute=0)
            if b >= 2 and hour + timedelta(hours=1) <= newest[b - 2] - timedelta(hours=2):
                lost += 1
            else:
                counts[hour] = counts.get(hour, 0) + 1
    got = {x.minute: x.lines for x in monitor.emitted(spark, str(tmp_path / "hours"), hours).collect()}
    assert got == counts and lost and monitor.dropped(q) == lost
    number = max(int(p.name.split("=")[1]) for p in (tmp_path / "hours").iterdir() if p.name.startswith("batch="))
    before = monitor.emitted(spark, str(tmp_path / "hours"), hours).count()
    again = spark.read.parquet(str(tmp_path / "hours" / f"batch={number}")).collect()
    spark.createDataFrame(again, hours.schema).write.mode("overwrite").parquet(str(tmp_path / "hours" / f"batch={number}"))  # a batch that is repeated
    assert monitor.emitted(spark, str(tmp_path / "hours"), hours).count() == before


def test_log_source(spark, tmp_path):
    """Lines of ranges of any size, numbered as read_lines does; a window opens only its ranges; appended lines arrive as a stream."""
    from datetime import datetime

    r = random.Random(11)
    text = "".join((f"2026-02-25 {10 + k // 60:02d}:{k % 60:02d}:00.000 [http-nio-80-exec-1] " if r.random() < 0.97 or k > 300 else "loose ") + "x" * r.choice([0, 3, 200]) + "é" + r.choice(["\n", "\r\n", "\n\n", "\r"]) for k in range(600))
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "b.log").write_bytes(b"no end \xff of line")
    (tmp_path / "c.log").write_bytes(b"")
    (tmp_path / "d.bin").write_bytes(b"no log\n")
    logs.register(spark)
    want = sorted((x.source_path.rsplit("/", 1)[-1], x.line_no, x.raw) for x in files.read_lines(spark, [str(tmp_path / f"{n}.log") for n in "abc"]).collect())
    schema = detect(text.splitlines())
    for size in (1, 7, 100, 5_000, 10**7):
        if size >= 7:
            index = logs.build_index(spark, str(tmp_path), schema, str(tmp_path / f"index{size}"), size)
            got = sorted((x.source_file, x.line_no, x.raw) for x in logs.read_indexed(spark, index).collect())
            assert got == want, size
        lines = [x for a in range(0, len(text.encode()) + 3, size * 97) for part in logs.lines_of(str(tmp_path / "a.log"), a, a + size * 97) for x in part]
        assert len(lines) == sum(f == "a.log" for f, _, _ in want)
    index = str(tmp_path / "index5000")
    start, end = datetime(2026, 2, 25, 16, 0), datetime(2026, 2, 25, 16, 30)
    window = logs.read_window(spark, index, schema, start, end)
    rows = {(x.source_file, x.line_no) for x in window.collect()}
    whole = parse_lines(logs.read_indexed(spark, index), schema).where(in_window(F.col("ts"), start, end))
    assert rows == {(x.source_file, x.line_no) for x in whole.collect()}
    known = spark.read.parquet(index).collect()
    near = [x for x in known if x.first_ts and x.last_ts >= start and x.first_ts <= end]
    only = logs.read_indexed(spark, index, (F.col("last_ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("first_ts") <= F.lit(end).cast("timestamp_ntz")))
    assert only.rdd.getNumPartitions() == len(near) <= 3 < len(known) and only.count() == sum(x.lines for x in near)
    assert logs.read_indexed(spark, index).count() == len(want)

    folder = tmp_path / "grow"
    folder.mkdir()
    stream = spark.readStream.format("logs").option("path", str(folder)).option("rangeBytes", "64").load().select("source_file", "raw")
    for part, upto in (("one\ntwo\nthr", ["one", "two"]), ("ee\nfour\n", ["one", "two", "three", "four"])):
        with open(folder / "g.log", "a") as f:
            f.write(part)
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "grown")).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"got/batch={n}"))).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(x.raw for x in spark.read.parquet(str(tmp_path / "got/batch=*")).collect()) == sorted(upto)


def test_skip_index(spark, tmp_path):
    """A point lookup opens only files that can hold the value, and of those only row groups whose Bloom filter does."""
    rows = spark.range(20_000).select(F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id)").alias("timestamp"), F.concat(F.lit("m"), F.col("id") % 50).alias("method_sig"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("job"), F.col("id") % 70)).alias("scheduled_op_name"), F.lit("t").alias("thread"), F.col("id").cast("string").alias("raw_line"), *(F.lit(False).alias(c) for c in rules.FLAGS), F.lit(1).cast("long").alias("latency_ms"), F.lit(1).cast("long").alias("result_count"))
    tables.save_indexed(rows.select(*tables.LOG_EVENTS), str(tmp_path))
    got = tables.find(spark, str(tmp_path), "method_sig", "m7", ("2024-01-02", "2024-01-09"))
    assert {int(x.raw_line) for x in got.collect()} == {k for k in range(7, 20_000, 50) if 1440 <= k < 1440 * 9}
    every = spark.read.parquet(f"{tmp_path}/files")
    hit = tables.find(spark, str(tmp_path), "method_sig", "m7")
    assert {int(x.raw_line) for x in hit.collect()} == set(range(7, 20_000, 50)) and len(hit.inputFiles()) < every.count()
    assert {int(x.raw_line) for x in tables.find(spark, str(tmp_path), "scheduled_op_name", "job9").collect()} == {k for k in range(20_000) if k % 3 == 0 and k % 70 == 9}
    assert tables.find(spark, str(tmp_path), "method_sig", "zzz").count() == 0 and tables.find(spark, str(tmp_path), "method_sig", "m7x").count() == 0
    with pytest.raises(ValueError):
        tables.find(spark, str(tmp_path), "thread", "t")

    def rows_scanned(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    bounds = every.where("least_method_sig < most_method_sig").first()
    absent = tables.find(spark, str(tmp_path), "method_sig", bounds.least_method_sig + "!")  # within the bounds of a file, in no row group
    assert len(absent.inputFiles()) >= 1 and rows_scanned(absent) == 0
    assert 400 <= rows_scanned(hit) < 20_000




def _nodes(df, name):
    """The plan's lines of one node, and their places from the root."""
    text = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [(k, x) for k, x in enumerate(text) if x.lstrip(" :+-").startswith(name)]


def test_lines_of_one_row_group_are_parsed_by_all_cores(spark):
    """The table is one row group, which one task reads; lines are made and tested behind an exchange."""
    got = catalog.parsed(spark, SF)
    assert len({p for (p,) in got.select(F.spark_partition_id()).distinct().collect()}) == spark.sparkContext.defaultParallelism
    plan = tables.server_metrics(got)
    (moved, _), tests = _nodes(plan, "Exchange")[0], _nodes(plan, "Filter")
    assert tests and all(k < moved for k, _ in tests)


def test_a_line_is_lowered_once_and_each_regex_runs_once(spark):
    """Flags share one lower-case line, and a value's regex is not run again for the test of its emptiness."""
    lines = spark.createDataFrame([("x", None, None)], "clean string, ts timestamp_ntz, thread string").repartition(2)
    plan = tables.log_events(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("regexp_extract(") == 4


def test_a_log_is_written_by_many_tasks(spark):
    """Each node's log is rotated: no task sorts a whole one, and names follow the order of lines."""
    import os
    import re

    at = catalog_files.log_folder(spark, SF)
    for k in range(catalog_files.NODES):
        parts = sorted(x for x in os.listdir(f"{at}/node={k}") if x.startswith("part-"))
        assert len(parts) == spark.sparkContext.defaultParallelism
        text = "".join(open(f"{at}/node={k}/{x}").read() for x in parts)
        seen = [int(x) for x in re.findall(r"no time here, event (\d+)", text)]
        assert seen == sorted(seen) and seen


def test_rotated_logs_are_one_log(spark, tmp_path):
    """Lines are numbered through the files of a folder, by read_lines and by an index of small ranges."""
    for node in "ab":
        (tmp_path / node).mkdir()
        for part in range(3):
            (tmp_path / node / f"part-{part}.log").write_text("".join(f"2026-02-25 15:51:35.286 {node} {part * 100 + k + 1}\n" for k in range(100)))
    want = sorted((n, k, str(k)) for n in "ab" for k in range(1, 301))
    told = lambda df: sorted((x.raw.split()[2], x.line_no, x.raw.split()[3]) for x in df.collect())
    got = files.read_lines(spark, str(tmp_path), recursive=True, rotated=True)
    assert told(got) == want and {x.source_path.rsplit("/", 1)[-1] for x in got.select("source_path").collect()} == {"a", "b"}
    index = logs.build_index(spark, str(tmp_path), detect(["2026-02-25 15:51:35.286 a 1"]), str(tmp_path / "index"), 200, rotated=True)
    assert told(logs.read_indexed(spark, index)) == want


def test_small_ranges_are_read_once_and_shared(tmp_path, monkeypatch):
    """A range reads little more than itself, and many ranges do not make a task each."""
    path = str(tmp_path / "a.log")
    (tmp_path / "a.log").write_text(("x" * 99 + "\n") * 5_000)
    read, real = [], logs._open

    class Counted:
        def __init__(self, f):
            self.f = f

        __enter__ = lambda self: self
        __exit__ = lambda self, *_: self.f.close()
        size = lambda self: self.f.size()
        seek = lambda self, n: self.f.seek(n)

        def read(self, n):
            read.append(len(got := self.f.read(n)))
            return got

    monkeypatch.setattr(logs, "_open", lambda p: Counted(real(p)))
    ranges = logs._cut(path, 0, 500_000, 10_000)
    assert sum(len(x) for r in ranges for x in logs.lines_of(path, r.range_start, r.range_end)) == 5_000
    assert sum(read) < 2 * 500_000
    tasks = logs._shared(ranges)
    assert [r for t in tasks for r in t.ranges] == ranges and logs.TASKS <= len(tasks) <= 2 * logs.TASKS
    assert [len(t.ranges) for t in logs._shared(ranges[:3])] == [1, 1, 1]


def test_a_node_is_parsed_from_its_own_files(spark):
    """Six nodes are parsed in as many reads of a node's own folder, not of all."""
    every = [f.rsplit("/", 2)[1] for f in catalog_files.file_lines(spark, SF).inputFiles()]
    scans = [x for _, x in _nodes(catalog_files.file_parsed(spark, SF), "FileScan")]
    assert len(set(every)) == catalog_files.NODES and scans and all("node=" in x for x in scans)


def test_loaded_tables_are_written_by_all_cores(spark):
    """What the detectors and ad-hoc statements read lies in as many files as there are cores, at least."""
    for df in catalog.loaded(spark, SF):
        assert len(df.inputFiles()) >= spark.sparkContext.defaultParallelism
