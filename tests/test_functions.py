import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweft.functions import dates, extract, parse, rules, schema, signals, text
from logweft.functions.signals import RetrievalSignals

PLAIN = """2024-01-15 09:23:45.123 [main] INFO server up txId=7
2024-01-15 09:23:46.000 [worker-1] ERROR java.lang.NullPointerException: x
    at a.b.C(Server.java:142)
    ... 5 more
2024-01-15 09:23:47.500 [worker-1] WARN slow""".split("\n")


def one(spark, column, *values, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {name} string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_detection_votes_for_formats():
    s = schema.detect(PLAIN)
    assert s.timestamp_fmt == "%Y-%m-%d %H:%M:%S.%f" and s.thread_re == rules.THREADS[5] and [k for _, k in s.session_keys] == ["txId"]
    none = schema.detect(["no time", "here"])
    assert none.timestamp_re == "(NOTIMESTAMP)" and none.timestamp_fmt == "" and none.thread_re is None


def test_hybrid_detection_asks_only_when_unsure():
    asked = []
    s = schema.detect_hybrid(PLAIN, lambda t: asked.append(t) or "{}")
    assert not asked and s.is_multiline and s.confidence > 0.9
    got = schema.detect_hybrid(["12|a", "13|b"], lambda t: asked.append(t) or '{"timestamp_re": "(\\\\d+)", "timestamp_fmt": "%s"}')
    assert asked and got.timestamp_re == r"(\d+)"
    assert schema.detect_hybrid(["x"], lambda t: "not json").timestamp_fmt == ""


@pytest.mark.parametrize("k,raw,want", [
    (0, "2025-09-12 14:27:45.798 x", datetime(2025, 9, 12, 14, 27, 45, 798000)), (1, "2025-09-12 14:27:45 x", datetime(2025, 9, 12, 14, 27, 45)),
    (2, "a 2025-09-12T14:27:45.798", datetime(2025, 9, 12, 14, 27, 45, 798000)), (3, "09/12/2025 14:27:45", datetime(2025, 9, 12, 14, 27, 45)),
    (4, "[11/24/25 3:59:01:674 BNT]", datetime(2025, 11, 24, 3, 59, 1, 674000)), (4, "[1/4/75 3:59:01:674 BNT]", datetime(1975, 1, 4, 3, 59, 1, 674000)),
    (5, "[11/24/2025 13:59:01:674 BNT]", datetime(2025, 11, 24, 13, 59, 1, 674000)), (0, "2025-02-30 14:27:45.798", None), (0, "none", None),
])
def test_timestamps(spark, k, raw, want):
    p, fmt, _ = rules.TIMESTAMPS[k]
    assert one(spark, parse.timestamp_of(F.col("x"), schema.LogSchema(f"({p})", fmt)), raw) == [want]


def test_clean_thread_and_label(spark):
    s = schema.LogSchema(thread_re=rules.THREADS[5], session_keys=tuple(rules.SESSION_KEYS))
    assert one(spark, parse.clean_line(F.col("x")), "[Line 12] abc\r", "abc") == ["abc", "abc"]
    assert one(spark, parse.thread_of(F.col("x"), s), "a [w-1] b", "none") == ["w-1", None]
    assert one(spark, parse.session_label(F.col("x"), s), "sesId: 9 txId=8", "iid/7", "no") == ["txId:8", "iid:7", None]


def test_window_keeps_lines_without_time(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-01 00:00:00'), (timestamp_ntz'2024-01-03 00:00:00'), (null) as t(ts)")
    assert df.where(parse.in_window(F.col("ts"), datetime(2024, 1, 1), datetime(2024, 1, 2))).count() == 2


LINES = [
    "10:00 com.a.Bar.java:123 REST:get - exit,lapse(ms)=124517", "x Count = 6891 rows returned", "RoleValidator getRelationsByObj - entry", "ldap lapse(ms)=5", "createIndexAllAvailableCredentialTO scheduled lapse(ms)=1", "heartbeat", "account discount recounted",
]


def test_flags_and_values(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "clean string")
    got = df.select(*(c.alias(n) for n, c in (extract.flags(F.col("clean")) | extract.values(F.col("clean"))).items())).collect()
    assert sum(r.has_latency for r in got) == 3 and max(r.latency_ms or 0 for r in got) == 124517
    assert got[1].result_count == 6891 and got[2].has_entry_authz and got[0].has_rest and got[4].scheduled_op_name == "createIndexAllAvailableCredentialTO"
    assert "Bar.java:123" in got[0].method_sig and not any(got[5][n] for n in ("has_latency", "has_sql", "has_scheduled"))
    assert got[6].has_count_rows  # any word that holds count


def test_metric_pairs_and_numbers(spark):
    got = one(spark, extract.metric_pairs(F.col("x")), "Server statistics={jvm.threadCount=12, a.b=1_000, n=4, name=node, bad=1d, e=1e3, x.y=.5}", "")
    assert [(p.name, p.value) for p in got[0]] == [("jvm.threadCount", 12.0), ("a.b", 1000.0), ("x.y", 0.5)] and got[1] == []
    assert one(spark, extract.category(F.col("x")), "am.tomcat.thread.busy.count", "DBCP.All", "x.deliveryManagerQ", "eventManager.a", "jvm.x") == ["Tomcat", "DBCP", "deliveryManager", "eventManager", "System Information"]


def test_high_signals(spark):
    got = one(spark, extract.high_signal(F.col("x")), *LINES)
    assert [(g.signal_type, g.captured_value) if g else None for g in got] == [("extreme_latency", 124517), ("high_result_count", 6891), ("authz_loop_candidate", None), (None, None), (None, None), None, None]
    assert one(spark, extract.snippet(F.col("x"), 3), "abcd", "abc") == ["abc...", "abc"]


def test_scores_and_text(spark):
    s = RetrievalSignals()
    score = extract.anomaly_score(F.col("x"), s)
    assert one(spark, score, "ERROR WrapAEK - entry", "ERROR x", "a - exit", "ERROR ConnectException", "quiet") == [7.0, 2.0, 1.0, 1.0, 0.0]
    assert one(spark, extract.diagnostic_text(F.col("x")), "a\n\n  at b.c(D.java:1)\n ... 3 more\nb ", " at x") == ["a\nb", " at x"]
    assert one(spark, extract.decode_urls(F.col("x")), "a%20b+c%26amp;d", "bad %zz %41", "plain") == ["a b c&d", "bad %zz A", "plain"] == [text.decode_urls(t) for t in ("a%20b+c%26amp;d", "bad %zz %41", "plain")]


def test_configuration_merges_by_type(tmp_path):
    (tmp_path / "c.json").write_text('{"error_keywords": ["Boom"], "noise_patterns": ["ok", "(bad"], "iam_critical_keywords": "no list", "api_request_boundaries": {"start_markers": [">>"]}}')
    s = signals.load_signals(str(tmp_path / "c.json"))
    assert s.error_keywords == ["Boom"] and s.noise_patterns == ["ok"] and s.iam_keywords == rules.IAM_KEYWORDS and s.start_markers == [">>"] and s.end_markers == rules.END_MARKERS
    assert signals.load_signals(str(tmp_path / "none.json")) == RetrievalSignals()
    assert s.subcategory("Why TokenException?") == "known_error" and s.subcategory("slow") == "unknown_error"


def test_query_times():
    assert dates.parse_query_datetime("2024-01-02", end=True) == datetime(2024, 1, 2, 23, 59, 59, 999999)
    assert dates.parse_query_datetime("03/04/2024") == datetime(2024, 4, 3) and dates.parse_query_datetime("2024-01-02T03:04:05Z").tzinfo
    assert dates.parse_query_datetime("nonsense") is None
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 3)
    check = lambda s, e: dates.validate(dates.query_context("", s, e), a, b)
    assert check("", "") == check("2024-01-02", "") == check("2024-01-02", "2025-01-01") == "ok"
    assert check("2023-12-31", "2024-01-02") == "pre_log_boundary" and check("2024-01-03", "2024-01-02") == "invalid_time" and check("2024-02-01", "") == "invalid_date"
    assert dates.validate(dates.query_context("", "2024-01-02"), None, None) == "no_log_timestamps"


def test_json_in_replies():
    assert text.first_json('so {bad} ```json\n{"a": {"b": 1}}\n``` {"c": 2}') == {"a": {"b": 1}} and text.first_json("none") is None
    assert text.preview("a\n b", 10) == "a b" and text.table_cell("a|b\nc") == "a\\|b c"


def test_patterns_of_the_load_find_what_their_plain_forms_do(spark):
    """Patterns that do not try starts inside a word give the same groups, and a long word costs no square of its length."""
    plain = {
        "METRIC_PAIR": r"([a-zA-Z][\w.]+)=([^,\s{}]+)", "METHOD_SIG": r"([A-Za-z][A-Za-z0-9_\.]*(?:\.java)?:\d+)", "SCHEDULED_OP": r"([A-Za-z0-9_]+(?:TO|Job|Index|Task)[A-Za-z0-9_]*)",
        "RESULT_COUNT": r"(?i)\b(Count|rows?|returned|result\s*(count|size)?)\s*[:=]?\s*(\d{3,})",
    }
    r = random.Random(5)
    bits = ["a", "Z", "9", "_", ".", ":", "=", " ", "{", ",", "é", "ſ", "TO", "Job", "Task", "Index", ".java", "count", "Rows", "returned", "result size", "12", "345"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(4_000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    every = lambda p: F.regexp_extract_all("x", F.lit(parse.unicode(p)), F.lit(0))
    for name, old in plain.items():
        new = getattr(rules, name)
        group = 3 if name == "RESULT_COUNT" else 1
        pairs = df.select(every(old).alias("a"), every(new).alias("b"), F.regexp_extract("x", parse.unicode(old), group).alias("c"), F.regexp_extract("x", parse.unicode(new), group).alias("d"))
        assert pairs.where("size(a) > 0").count() > 50 and pairs.where("a <> b or c <> d").count() == 0, name
    began = time.process_time()
    for name in ("METRIC_PAIR", "METHOD_SIG", "SCHEDULED_OP"):
        assert re.search(getattr(rules, name), "a" * 60_000) is None
    assert time.process_time() - began < 1  # the plain forms take minutes


def test_words_are_looked_for_in_one_diagnostic_text(spark):
    """The text without stack frames is worked out once, not for each word."""
    df = spark.createDataFrame([("x",)], "x string")
    s = RetrievalSignals()
    for column in (extract.is_error(F.col("x"), s), extract.is_critical(F.col("x"), s)):
        assert df.select(column.alias("y"))._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
