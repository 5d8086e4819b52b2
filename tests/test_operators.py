"""Order-dependent operators against plain sequential versions on random input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logweft.functions import rules
from logweft.functions.schema import LogSchema
from logweft.functions.signals import RetrievalSignals
from logweft.operators import classify, coverage, detect, evidence, followup, gaps, profile, references, spans, tables

S = RetrievalSignals()


def traces(seed, n):
    r, out = random.Random(seed), []
    for f in range(n):
        for k in range(r.randint(1, 40)):
            bits = [" - entry"] * (r.random() < 0.25) + [" - exit"] * (r.random() < 0.3) + [" ERROR boom"] * (r.random() < 0.3)
            out.append((f"/f{f}", f"f{f}", k + 1, None, r.choice(["a", "b", None]), "line" + "".join(bits)))
    return out


def fold(rows):
    """Requests and events of one file, line by line."""
    open_, docs = {}, []
    for _, _, no, _, thread, clean in rows:
        t = thread or "no_thread"
        start, end = " - entry" in clean, " - exit" in clean
        if start:
            if t in open_:
                docs.append(("api_request", t, open_.pop(t), True))
            open_[t] = [no]
        elif t in open_:
            open_[t].append(no)
        elif end or "ERROR" in clean:
            docs.append(("api_signal_event", t, [no], False))
            continue
        if t in open_ and end:
            docs.append(("api_request", t, open_.pop(t), False))
    return docs + [("api_request", t, x, True) for t, x in open_.items()]


SCHEMA = "source_path string, source_file string, line_no long, ts timestamp_ntz, thread string, clean string"


def test_request_spans_against_fold(spark):
    rows = traces(1, 25)
    got = spans.request_documents(spark.createDataFrame(rows, SCHEMA), S).collect()
    want = {(f, k, t, x[0], x[-1], len(x), u) for f in {r[0] for r in rows} for k, t, x, u in fold([r for r in rows if r[0] == f])}
    assert {(r.source_path, r.key_type, r.primary_key, r.start_line, r.end_line, r.line_count, r.unmatched_exit) for r in got} == want
    order = [(-r.anomaly_score, r.start_time, r.source_path) for r in sorted(got, key=lambda r: r.row_id)]
    assert order == sorted(order) and sorted(r.row_id for r in got) == list(range(len(got)))


@pytest.mark.parametrize("block", [1, 3, 7])
def test_spans_of_one_thread_in_many_blocks(spark, block):
    """A file of one thread, cut into blocks of a few lines: as the fold has it, and identifiers in the order in which requests end."""
    rows = [(p, f, no, ts, "a", clean) for p, f, no, ts, _, clean in traces(5, 12)]
    got = spans.request_documents(spark.createDataFrame(rows, SCHEMA), S, block=block).collect()
    for path in {r[0] for r in rows}:
        folded = fold([r for r in rows if r[0] == path])
        mine = [r for r in got if r.source_path == path]
        assert {(r.key_type, r.start_line, r.end_line, r.line_count, r.unmatched_exit) for r in mine} == {(k, x[0], x[-1], len(x), u) for k, _, x, u in folded}
        for kind, prefix in (("api_request", "a_req_"), ("api_signal_event", "event_")):
            assert {r.request_span_id: r.start_line for r in mine if r.key_type == kind} == {f"{prefix}{n}": x[0] for n, x in enumerate(x for k, _, x, _ in folded if k == kind)}
    health = [spans.health(spark.createDataFrame([(1, k, int(" - entry" in r[5]), int(" - exit" in r[5])) for k, r in enumerate(rows)], "k int, n long, s int, e int"), ["k"], "n", "s", "e", b).first() for b in (block, 10**6)]
    assert health[0] == health[1]


def test_spans_of_one_thread_are_dealt(spark):
    """The blocks of one thread are different groups of the scan."""
    rows = spark.range(1, 4001).select(F.lit("/f").alias("source_path"), F.lit("f").alias("source_file"), F.col("id").alias("line_no"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("t").alias("thread"), F.when(F.col("id") % 10 == 1, "x - entry").otherwise("x").alias("clean"))
    numbered = spans.number_spans(rows.withColumn("k", F.lit(1)), ["k"], "line_no", F.col("clean").contains("entry"), F.lit(False), 100)
    assert numbered.agg(F.max("span_no")).first()[0] == 400
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert numbered.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_islands_over_blocks(spark):
    r = random.Random(9)
    rows = [(k, n) for k in "ab" for n in range(1, 300) if r.random() < 0.8]
    for block in (1, 4, 50, 10**6):
        got = {tuple(x) for x in spans.islands(spark.createDataFrame(rows, "k string, n long"), ["k"], "n", block).collect()}
        want = set()
        for k in "ab":
            own = sorted({n for j, n in rows if j == k})
            first = [n for n in own if n - 1 not in set(own)]
            last = [n for n in own if n + 1 not in set(own)]
            want |= {(k, a, z) for a, z in zip(first, last)}
        assert got == want
    texts = {x.k: x.t for x in spans.range_texts(spans.islands(spark.createDataFrame(rows, "k string, n long"), ["k"], "n"), ["k"], "t").collect()}
    assert texts == {x.k: x.t for x in spark.createDataFrame(rows, "k string, n long").groupBy("k").agg(spans.compact_ranges(F.collect_list("n")).alias("t")).collect()}


@pytest.mark.parametrize("few", [1, 40, 10_000])
def test_exact_quantiles(spark, monkeypatch, few):
    """Against sorting, with frequent values, nulls, an even and an odd number of values, and none."""
    from statistics import median

    monkeypatch.setattr(gaps, "FEW", few)
    monkeypatch.setattr(gaps, "RANGES", 8)
    r = random.Random(few)
    columns = {"a": [r.gauss(0, 1e6) for _ in range(801)], "b": [float(r.choice([1, 1, 1, 2, 5])) for _ in range(900)], "c": [None] * 5, "d": [r.choice([None, -1.5, r.random() ** 20]) for _ in range(900)], "e": [7.0], "f": [1.0, 2.0], "g": [float(k // 2) for k in range(1000)]}
    n = max(map(len, columns.values()))
    rows = list(zip(*(v + [None] * (n - len(v)) for v in columns.values())))
    got = gaps.quantiles(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(4), list(columns))
    for c, values in columns.items():
        real = [v for v in values if v is not None]
        assert got[c] == (pytest.approx(median(real)) if real else None), c


def test_interval_lookup(spark):
    """20,000 ranges: built at once, right at every cut, and about even."""
    import time

    cuts = sorted({k * 3 for k in range(20_000)})
    t = time.time()
    column = gaps.range_of(F.col("v"), cuts)
    plan = spark.range(0, 60_010).select(F.col("id").alias("v")).withColumn("r", column)
    plan._jdf.queryExecution().optimizedPlan()
    assert time.time() - t < 3
    got = plan.where("r <> least(v div 3 + 1, 20000)").count()
    assert got == 0
    assert [x.r for x in spark.createDataFrame([(None,), (-1,), (0,)], "v long").select(gaps.range_of(F.col("v"), cuts).alias("r")).collect()] == [20_000, 0, 1]
    values = spark.range(400_000).select((F.col("id") * F.col("id") % 1_000_003).alias("v"))
    sizes = values.groupBy(gaps.place(values, "v", 2_000).alias("r")).count().agg(F.max("count"), F.min("count"), F.count("*")).first()
    assert sizes[0] < 400 and sizes[1] > 100 and sizes[2] == 2_000


def test_request_health_against_counter(spark):
    rows = traces(2, 20)
    open_, m, ux = {}, 0, 0
    for p, _, _, _, t, c in rows:
        k = (p, t)
        if " - entry" in c:
            open_[k] = open_.get(k, 0) + 1
        if " - exit" in c:
            if open_.get(k, 0) > 0:
                open_[k], m = open_[k] - 1, m + 1
            else:
                ux += 1
    got = spans.request_health(spark.createDataFrame(rows, SCHEMA), S).first()
    assert (got.matched_requests, got.unmatched_exits, got.unmatched_entries) == (m, ux, sum(open_.values()))


def test_compact_ranges(spark):
    r = random.Random(3)
    sets = [[1, 2, 3, 5, 6], [], [7], *([r.randint(1, 60) for _ in range(r.randint(0, 40))] for _ in range(40))]

    def plain(xs):
        out = []
        for x in sorted(set(xs)):
            if out and out[-1][1] == x - 1:
                out[-1][1] = x
            else:
                out.append([x, x])
        return ", ".join(f"{a}-{b}" if a != b else str(a) for a, b in out[:8]) + (f", ... +{len(out) - 8} ranges" if len(out) > 8 else "")

    df = spark.createDataFrame(list(enumerate(sets)), "i long, x array<long>")
    assert [x[0] for x in df.orderBy("i").select(spans.compact_ranges(F.col("x"))).collect()] == [plain(x) for x in sets]


def test_neighbours_budget_first_seen_caps(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.random() < 0.15, r.randint(1, 30), r.choice(["api_ref", "raw_log", "debug", "else"])) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, g string, seed boolean, size long, source string")
    near = {x.i for x in evidence.neighbours(df, ["g"], "i", "seed").where("near").collect()}
    want = set()
    for g in "ab":
        own = [x for x in rows if x[1] == g]
        want |= {own[j][0] for k, x in enumerate(own) if x[2] for j in range(max(0, k - 2), min(len(own), k + 3))}
    assert near == want
    total, kept = 0, []
    for x in rows:
        total += x[3]
        if total > 300:
            break
        kept.append(x[0])
    assert [x.i for x in evidence.budget_prefix(df, "i", "size", 300).orderBy("i").collect()] == kept
    assert {x.i for x in evidence.first_seen(df, "size", "i").collect()} == {min(y[0] for y in rows if y[3] == s) for s in {y[3] for y in rows}}
    best, used = [], {}
    for x in sorted(rows, key=lambda x: (-x[3], x[0])):
        if used.get(x[4], 0) < rules.SOURCE_CAP.get(x[4], 2):
            used[x[4]] = used.get(x[4], 0) + 1
            best.append(x[0])
    got = followup.source_caps(df.withColumnRenamed("i", "item_id"), "size").collect()
    assert [x.item_id for x in got] == best[:12]


def test_entities_against_fold(spark):
    r = random.Random(5)
    parts = ["a=1", "A=1", "conf/x.yml", "file: /etc/app.cfg", "x.properties", "ABC-1234", "code=500", "HTTP 500", "http  404", "3f2504e0-4f89-41d3-9a0c-0305e82c3301", "Q" * 30, "txId=77"]
    lines = [" ".join(r.choices(parts, k=r.randint(0, 6))) for _ in range(80)]
    schema = LogSchema(session_keys=(rules.SESSION_KEYS[0],))
    seen, want = set(), []

    def add(kind, value, key):
        if key not in seen and ("v", value.lower()) not in seen:
            seen.update({key, ("v", value.lower())})
            want.append((kind, value))

    for line in lines:
        for kind, p, at, prefix in rules.ENTITIES:
            for m in re.finditer(p, line):
                v = f"{m[1]}={m[2]}" if at is None else prefix + m[1]
                add(kind, v[:80] if kind == "token_id" else v, (kind, v[:40] if kind == "token_id" else v.lower()))
        for p, k in schema.session_keys:
            for m in re.finditer(p, line):
                add("session_id", f"{k}={m[1]}", (k, m[1].lower()))
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, clean string")
    assert [(x.type, x.value) for x in profile.entities(df, schema).collect()] == want[:200]
    assert profile.entities(df, schema, most=3).count() == 3


def test_first_of_two_keys_against_fold(spark):
    """Rows that share one key or the other, in chains, so that one that goes leaves room for a later one."""
    r = random.Random(6)
    for n in (1, 8, 60, 200):
        rows = [(k, r.randint(0, n // 2), r.randint(0, n // 2)) for k in range(n)] + [(n + k, 10**6 + k // 2, 10**7 + (k + 1) // 2) for k in range(12)]
        seen_a, seen_b, want = set(), set(), []
        for p, a, b in rows:
            if a not in seen_a and b not in seen_b:
                seen_a.add(a)
                seen_b.add(b)
                want.append(p)
        df = spark.createDataFrame(rows, "p long, a long, b long")
        assert sorted(x.p for x in profile.first_of_two(df, "a", "b", "p").collect()) == want
        assert sorted(x.p for x in profile.first_of_two(df, "a", "b", "p", 5).collect())[:5] == want[:5]
    assert profile.first_of_two(df.limit(0), "a", "b", "p").count() == 0


def test_total_before(spark):
    r = random.Random(2)
    rows = [(k, r.randint(0, 50)) for k in r.sample(range(10_000), 300)]
    got = {x.p: x.t for x in gaps.total_before(spark.createDataFrame(rows, "p long, n long"), "p", "n", "t").collect()}
    assert got == {p: sum(n for q, n in rows if q < p) for p, _ in rows}


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_context_over_block_edges(spark, monkeypatch, block):
    from logweft.sources import files

    monkeypatch.setattr(files, "BLOCK_LINES", block)
    r = random.Random(block)
    lines = [(f"/{p}", k, "hit" if r.random() < 0.2 else "x") for p in "ab" for k in range(1, 40)] + [("/c", k, "x") for k in range(1, 10)] + [("/d", 1, "hit")]
    df = spark.createDataFrame(lines, "source_path string, line_no long, raw string")
    got = {(x.source_path, x.line_no): x.content for x in files.keyword_windows(df, ["HIT"]).collect()}
    want = {}
    for p in "abd":
        own = {k: raw for q, k, raw in lines if q == f"/{p}"}
        for k in [k for k, raw in own.items() if raw == "hit"][:3]:
            want[f"/{p}", k] = "\n".join(own[j] for j in range(k - 2, k + 3) if j in own)
    assert got == want
    assert sorted((x.source_path, x.line_no) for x in files.edges(df, 5).collect()) == sorted((p, k) for p, k, _ in lines if k <= 5 or k > {"/a": 39, "/b": 39, "/c": 9, "/d": 1}[p] - 5)


def seed_tables(spark):
    events = spark.sql("""select timestamp_ntz'2026-02-25 15:50:00' + make_dt_interval(0, 0, 0, s) as timestamp, 't' as thread, raw as raw_line, false has_latency, false has_jdbc, false has_ldap, false has_hibernate, false has_connection_wait,
        false has_staleobject, false has_sql, c > 0 has_count_rows, true has_entry_authz, false has_rest, false has_scheduled, 'A:1' method_sig, cast(null as bigint) latency_ms, nullif(c, 0) result_count, cast(null as string) scheduled_op_name
        from values (0, 'a', 5000L), (5, 'b', 0L), (300, 'c', 0L), (600, 'd', 7000L) as t(s, raw, c)""")
    metrics = spark.sql("select timestamp_ntz'2026-02-25 15:50:00' + make_dt_interval(0, 0, m, 0) as timestamp, '' thread, n as metric_name, v as metric_value, 'x' category, '' raw_line from values (0, 'jvm.threadCount', 100D), (0, 'dbcp.ActiveConnections', 5D), (1, 'jvm.threadCount', 120D), (1, 'dbcp.ActiveConnections', 25D), (2, 'am.auth.responseTime', 900D), (2, 'jvm.threadCount', 130D) as t(m, n, v)")
    return events, metrics


def test_detectors_on_seed_tables(spark):
    events, metrics = seed_tables(spark)
    gaps = detect.log_gap_rows(events).collect()
    assert [round(r.gap_seconds) for r in gaps] == [300, 295]
    assert detect.correlation_rows(metrics).count() == 1 and detect.stall_rows(metrics).count() == 3
    assert detect.breadth_rows(events).first().asDict() == {"early_signatures": 1, "late_signatures": 1}
    found = detect.broad_signals(events, metrics)
    assert {s.signal_family for s in found} >= {"log_gap", "high_volume_indicator", "metric_correlation", "endpoint_breadth", "runtime_stall_indicator"}
    assert [s.strength for s in found] == sorted((s.strength for s in found), reverse=True) and all(0.3 <= s.strength <= 1 for s in found)
    assert detect.signal_frame(spark, found).count() == len(found)
    bad = []
    detect.broad_signals(events.drop("method_sig"), metrics, errors=bad)
    assert bad and all(":" in b for b in bad)
    wide = tables.wide(metrics)
    assert wide.columns == rules.WIDE_COLUMNS and wide.count() == 3
    assert set(detect.supplements(events, wide, "2026-02-25T15:51:00.000000")) == {"onset_minute_metrics", "onset_extreme_latencies", "onset_backend_dependency_signals"}
    assert len(detect.supplements(events, wide, None)) == 3


def test_stitched_lag_is_lag(spark):
    from pyspark.sql.window import Window

    from logweft.operators.gaps import with_previous

    df = spark.range(3000).select((F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, 0, 0, pmod(id * 7919, 1500))")).alias("t"))
    plain = df.select("t", F.lag("t").over(Window.orderBy("t")).alias("p"))
    assert with_previous(df, "t", "p", partitions=7).select("t", "p").exceptAll(plain).count() == 0
    assert with_previous(df.where("false"), "t").count() == 0


def test_lag_of_values_and_as_of(spark):
    from logweft.operators.gaps import lagged
    from logweft.plans import sql

    df = spark.range(900).select(F.when(F.col("id") < 899, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(id * 7919, 9001))")).alias("t"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("v"))
    rows = sorted(df.collect(), key=lambda r: (r.t is None, r.t))
    want = {(r.t, r.v, p.v) for p, r in zip(rows, rows[1:])} | {(rows[0].t, rows[0].v, None)}
    assert {tuple(r) for r in lagged(df, "t", ["v"], partitions=7).select("t", "v", "prev_v").collect()} == want
    r = random.Random(8)
    left = [(i, r.choice(["hot"] * 8 + ["a", "b", None]), r.randint(0, 400)) for i in range(300)]
    right = [(r.choice(["hot"] * 8 + ["a", None]), 2 * k, r.choice([None, k])) for k in range(200)]
    got = sql.as_of(spark.createDataFrame(left, "i long, k string, at long"), spark.createDataFrame(right, "k string, at long, v long"), on="at", by=["k"], value="v").collect()
    assert {(x.i, x.v) for x in got} == {(i, next((v for q, t, v in reversed(right) if q == k and t <= at and v is not None), None) if k else None) for i, k, at in left} and len(got) == len(left)


def test_bursts_against_counts(spark):
    r = random.Random(9)
    rows = [(r.choice(["hot"] * 6 + ["x"]), r.randint(0, 4_000_000) / 1000) for _ in range(500)]
    df = spark.createDataFrame(rows, "key string, s double").withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(s as decimal(18, 6)))"))
    got = detect.burst_counts(df, "key", 30, "n").collect()
    assert len(got) == len(rows) and all(x.n == sum(k == x.key and x.s - 30 <= s <= x.s for k, s in rows) for x in got)


def test_scores_and_classification(spark):
    sig = [detect.Signal("high_volume_indicator", "x", 0.9)]
    s = classify.scores(spark, sig, [{"signal_type": "authz_loop_candidate"}])
    assert s["high_volume_cardinality"] == 1.0 and s["mixed_compound"] > 0.2 and list(s) == rules.ARCHETYPES
    got = classify.classify({"global_runtime_stall": 0.9, "high_volume_cardinality": 0.2, "thread_pool_pressure": 0.0, "db_connection_pressure": 0.0, "mixed_compound": 0.8}, sig)
    assert got["primary"]["archetype"] == "global_runtime_stall" and got["secondary"]["archetype"] == "mixed_compound" and got["classification_method"] == "deterministic_only" and len(got["rejected_hypotheses"]) == 3
    both = classify.scores(spark, [detect.Signal("runtime_stall_indicator", "a", 0.9), detect.Signal("high_volume_indicator", "b", 0.8)])
    assert abs(both["mixed_compound"] - 0.765) < 1e-9
    assert classify.scores(spark, []) == dict.fromkeys(rules.ARCHETYPES, 0.0) and classify.onset([])["degradation_start"] is None


def test_coverage_buckets(spark):
    starts = spark.createDataFrame([("f", 10), ("f", 77), ("f", 910)], "source_file string, line long")
    total = spark.createDataFrame([("f", 1000)], "source_file string, total_lines long")
    got = coverage.bucket_counts(total, starts).orderBy("bucket").collect()
    assert [(r.first_line, r.last_line, r.selected) for r in got] == [(1, 250, 2), (251, 500, 0), (501, 750, 0), (751, 1000, 1)]
    odd = spark.createDataFrame([("f", 7)], "source_file string, total_lines long")
    every = spark.createDataFrame([("f", k) for k in range(1, 8)], "source_file string, line long")
    assert [(r.first_line, r.last_line, r.selected) for r in coverage.bucket_counts(odd, every).orderBy("bucket").collect()] == [(1, 1, 1), (2, 3, 2), (4, 5, 2), (6, 7, 2)]
    assert coverage.range_bounds("3-7, 12") == (3, 12) and coverage.range_bounds("") is None


def test_references():
    refs = [{"ref_id": "REF_a b.log_http-1_1", "source_path": "/x.log", "source_file": "x.log", "line_ranges": "1-3", "start_line": 1}, {"ref_id": "REF_2", "source_path": "/x.log", "source_file": "x.log", "line_ranges": "1-3"}, {"ref_id": "REF_3", "source_file": "y.log"}]
    assert references.line_reference(refs[0]) == "lines 1-3" and references.line_reference({}) == "lines unavailable"
    place = "- Original Log Reference: [x.log, lines 1-3](vscode://file/x.log:1) [\N{PAGE FACING UP}](file:///x.log)"
    text = references.rewrite("plain\nsee [REF_a b.log_http-1_1] and [REF_2], not [REF_q].\n[REF_3]\n[REF_2] again", refs)
    assert text == f"plain\nsee and, not [REF_q].\n{place}\n- Original Log Reference: y.log, lines unavailable\nagain\n{place.replace('x.log:1', 'x.log')}\n"
    assert references.rewrite("a  b", []) == "a  b"
    assert references.strip_marks("High [REF_1][REF_2] during 15:52.\n\nNo verified [REF_8].") == "High during 15:52.\n\nNo verified.\n"
    assert references.space_causes("Cause 1: a. Confidence: High. Cause 2: b. Supporting Evidence: x.") == "Cause 1: a. \nConfidence: High. \n\nCause 2: b. \nSupporting Evidence: x.\n"
    assert references.file_uri("/a b.log") == "file:///a%20b.log" and references.editor_uri("/a", 3) == "vscode://file/a:3"


DOC = "row_id long, source_file string, source_path string, primary_key string, key_type string, content string, anomaly_score double, line_ranges string, error_line_ranges string, signal_candidate boolean, iam_critical boolean, has_error_signal boolean, start_line long, end_line long, start_time string, end_time string"


def doc(i, content, score=0.0, signal=False, kind="api_request"):
    return (i, "x.log", "/x.log", f"t{i}", kind, content, score, "1-2", "", signal, False, signal, i, i + 1, "a", "b")


def test_evidence_keeps_within_budget(spark):
    docs = spark.createDataFrame([doc(i, "w" * 1000 + str(i), float(i)) for i in range(10)], DOC)
    got = evidence.collected(evidence.select_evidence(docs, top=5, max_chars=2_500))
    assert len(got.references) == 2 and len(got.text) <= 2_502 and got.row_ids == [9, 8]


def test_evidence_repeats_and_truncation(spark):
    rows = [
        doc(0, "boot\nTokenException:  no   key\nfirst tail", 9.0, True), doc(1, "other\n tokenexception: no key", 8.0), doc(2, "TokenException: no key\nanother tail", 7.0, True),
        doc(3, "benign", 6.0), doc(4, "benign", 5.0, kind="api_signal_event"), doc(5, "Error " + "e" * 9_000, 4.0), doc(6, "b" * 3_000, 3.0), doc(7, "%41 Failed+x", 2.0),
    ]
    got = evidence.select_evidence(spark.createDataFrame(rows, DOC)).collect()
    assert [r.row_id for r in got] == [0, 1, 3, 4, 5, 6, 7]  # 2 repeats the first error line of 0; 1 has no mark of an error
    assert [r["rank"] for r in got] == [0, 2, 3, 4, 5, 6, 7]
    text = {r.row_id: r.block for r in got}
    assert text[0].startswith("--- Request [score=9.00] [REF_x.log_t0_0] [source=ranked:signal] [file=x.log] [request_key=t0] [type=api_request] [lines 1-2] [a -> b] ---\nChunk Reference: [REF_x.log_t0_0]\nOriginal Log Reference: x.log, lines 1-2\nboot\n")
    assert "[request_key=error_line]" in text[4] and "[source=ranked:fallback]" in text[3] and text[7].endswith("\nA Failed x")
    assert text[5].endswith("e" * 10 + "\n... [truncated] ...") and text[5].count("e" * 7_994) == 1 and text[6].endswith("\n" + "b" * 2_000 + "\n... [truncated] ...")


def test_report_cuts_where_the_budget_ends(spark):
    def plain(rows, file_cap, cap):
        out = ""
        for _, name, c, sub, status, n, high, valid, text in rows:
            if not valid or not text.strip():
                continue
            text = text if len(text) <= file_cap else text[:file_cap] + rules.FINDINGS_TRUNCATED
            out += f"\n\n{'=' * 50}\n=== FILE: {name} | Category: {c}/{sub} | Status: {status} | Chunks: {n} | High-anomaly: {high} ===\n{'=' * 50}\n{text}\n"
            if len(out) > cap:
                return out[:cap] + rules.EVIDENCE_TRUNCATED
        return out

    rows = [(k, f"f{k}", "api_request", "x", "ok", k, 0, k != 2, "" if k == 4 else "y" * (90 * k + 1)) for k in range(9)]
    schema = "position long, source_file string, category string, subcategory string, status string, chunk_count long, high_count long, valid boolean, text string"
    for file_cap, cap in ((200, 900), (10_000, 900), (50, 10_000), (200, 1)):
        got = "".join(r.text for r in evidence.report(spark.createDataFrame(rows, schema), file_cap=file_cap, cap=cap).orderBy("position").collect())
        assert got == plain(rows, file_cap, cap)


def test_followups(spark):
    assert followup.fallback_intent("When did it start?").ask_type == "timeline" and followup.fallback_intent("") is None
    broad = followup.fallback_intent("what are the other problems")
    assert (broad.ask_type, broad.confidence, broad.must_include) == ("summary", 0.62, rules.ISSUE_TERMS[:6]) and broad.broad
    assert followup.fallback_intent("who called the login service of the second node at night?") is None and followup.fallback_intent("why?").confidence == 0.55
    assert followup.fallback_intent("and?", [{"role": "user", "content": "the exception"}]).ask_type == "errors"
    assert followup.search_terms(broad, "other Problems")[:3] == ["what", "are", "the"] and "denied" in followup.search_terms(broad, "other problems")
    items = [{"item_id": i, "source": "api_ref", "source_file": "f" + str(i % 4), "fused": 1.0 - i / 10, "snippet": "s" * 50, "relevance": 0.5, "anomaly_score": 0.0} for i in range(12)]
    assert [x["item_id"] for x in followup.broad_choice(items)] == [0, 1, 2, 3, 4, 5]  # six of this source when the question is broad
    assert len(followup.evidence_block(items[:1], cap=30)) == 30 and followup.evidence_block(items, cap=140) == "\n\n".join(f"[{k}] (api_ref) {'s' * 50}" for k in range(2))
    assert "| 0 | api_ref |" in followup.evidence_table(items[:1]) and followup.evidence_table([]).startswith("No evidence")
    prompt = "see [REF_a] A timeout and a Timeout [REF_b] fine [REF_a] timeout " + "x" * 900
    ready = followup.candidates(followup.reference_items(spark.createDataFrame([("f", prompt)], "source_file string, prompt string")), ["timeout"])
    assert {(r.item_id, r.n_hits, round(r.relevance, 6)) for r in ready.collect()} == {("REF_a", 3, 1.0), ("REF_b", 1, 0.65)}
    none = followup.candidates(followup.reference_items(spark.createDataFrame([("f", prompt)], "source_file string, prompt string")), ["nothing (like) it"])
    assert {r.relevance for r in none.collect()} == {0.45}
    df = spark.createDataFrame([("x", "api_ref", "f", "A timeout", 3.0), ("y", "raw_log", "f", "fine", 0.0), ("z", "else", "f", "", 0.0)], "item_id string, source string, source_file string, snippet string, anomaly_score double")
    got = {r.item_id: r for r in followup.fused(followup.candidates(df, ["timeout"]), ["timeout", ""]).collect()}
    assert abs(got["x"].fused - (0.65 + 0.08 + 0.08)) < 1e-9 and abs(got["y"].fused - 0.3 * 0.75) < 1e-9 and abs(got["z"].fused - 0.45 * 0.5) < 1e-9


def test_exceptions_on_loud_lines_only(spark):
    lines = ["INFO FooError seen", "ERROR BarException and BarException", "INFO HSM QuxError", "  at a.BazException.x(Y.java:1)"]
    df = spark.createDataFrame([(i, None, f"t{i}", x) for i, x in enumerate(lines)], "line_no long, ts timestamp_ntz, thread string, clean string")
    assert {(r.exception, r["count"]) for r in profile.exceptions(df, S).collect()} == {("BarException", 2), ("QuxError", 1), ("a.BazException", 1)}


def test_competing_kinds():
    kinds = dict(zip(rules.ARCHETYPES, (0.9, 0.5, 0.3, 0.25, 0.1)))
    found = classify.classify(kinds, [])
    assert classify.competing(found) == [rules.ARCHETYPES[1], rules.ARCHETYPES[2], rules.ARCHETYPES[3]]
    alone = classify.classify(dict.fromkeys(rules.ARCHETYPES, 0.0) | {"mixed_compound": 1.0}, [])
    assert classify.competing(alone) == rules.COMPETING["mixed_compound"]
    assert set(rules.COMPETING) == set(rules.ARCHETYPES) and all(k not in v and set(v) <= set(rules.ARCHETYPES) for k, v in rules.COMPETING.items())


def test_requests_of_a_stream_against_a_row_loop():
    """The processor of open requests, batch by batch with rows in any order, timers after each, against one loop over the sorted rows."""
    from types import SimpleNamespace

    from logweft.streaming.monitor import Requests

    class Held:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def clear(self):
            self.value = None

        def update(self, value):
            self.value = value

        put = update

        def appendList(self, rows):
            self.value = [*(self.value or []), *rows]

    r = random.Random(11)
    for idle in (3, 10**6):
        for _ in range(150):
            rows = [(k // 2, k, r.random() < 0.3, r.random() < 0.3) for k in range(r.randint(1, 30)) if r.random() < 0.6]
            want, current = [], None
            for at, line, start, end in rows:
                if current and at - current[3] > idle:
                    want.append((*current[:3], True))
                    current = None
                if start:
                    if current:
                        want.append((*current[:3], True))
                    current = [line, line, 0, at]
                if current:
                    current[1:] = [line, current[2] + 1, at]
                    if end:
                        want.append((*current[:3], False))
                        current = None
            if current:
                want.append((*current[:3], True))
            timers: set[int] = set()
            state = Requests(idle)
            state.init(SimpleNamespace(getListState=lambda *_: Held(), getValueState=lambda *_: Held(), registerTimer=timers.add))
            got, mark, todo = [], -1, list(rows)
            while todo or timers:
                batch = [x for x in todo if r.random() < 0.5 or x == todo[0]]
                todo = [x for x in todo if x not in batch]
                r.shuffle(batch)
                if batch:
                    list(state.handleInputRows(("f", "t"), iter([dict(zip(("at_ms", "line_no", "is_start", "is_end"), x)) for x in batch]), None))
                mark = min([x[0] for x in todo], default=10**9) - 1  # nothing later than this is still to come
                while due := sorted(t for t in timers if t <= mark):
                    timers.discard(due[0])
                    got += [(x.start_line, x.end_line, x.lines, x.unmatched_exit) for x in state.handleExpiredTimer(("f", "t"), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None)]  # noqa: B023
            assert got == want, (idle, rows)


def test_waiting_rows_are_packed_in_the_state():
    """A batch of a thread's rows is an element of the state for each PACKED rows, not for each row."""
    from types import SimpleNamespace

    from logweft.streaming import monitor

    kept: list = []
    state = monitor.Requests(10)
    state.init(SimpleNamespace(getListState=lambda *_: SimpleNamespace(appendList=kept.extend), getValueState=lambda *_: None, registerTimer=lambda _: None))
    rows = [{"at_ms": k, "line_no": k, "is_start": k % 3 == 0, "is_end": k % 5 == 0} for k in range(50_000)]
    list(state.handleInputRows(("f", "t"), iter(rows), None))
    assert len(kept) == 3


@pytest.mark.parametrize("least", [120, 0.5, 7.000001])
def test_silences_between_buckets_are_those_between_lines(spark, least):
    """Every silence as a plain pass finds it; what is ordered are buckets of time, not lines."""
    r = random.Random(9)
    at, times = -5_000_000_000, []
    for _ in range(800):
        at += r.choice([0, 1, 400_000, 499_999, 500_000, 7_000_000, 7_000_001, 119_999_999, 120_000_000, 900_000_000])
        times.append(at)
    df = spark.createDataFrame([(t,) for t in r.sample(times, len(times))] + [(None,)], "t long").repartition(3).select(F.expr("timestampadd(MICROSECOND, t, timestamp_ntz'1970-01-01 00:00:00')").alias("timestamp"))
    got = detect.log_gap_rows(df, least=least, top=None)
    micros = [F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") for c in ("prev_ts", "timestamp")]
    want = [(a, b) for a, b in zip(times, times[1:]) if (b - a) / 1e6 >= least]
    assert want and sorted(map(tuple, got.select(*micros).collect())) == want
    assert "min(timestamp" in got._jdf.queryExecution().optimizedPlan().toString()


def test_breadth_takes_a_row_for_each_signature(spark):
    """Signatures are counted by their first and last line, and lines without one belong to the log's span."""
    r = random.Random(3)
    rows = [(r.choice([None, *"abcdefgh"]), r.choice([None, *range(900)])) for _ in range(60)] + [(None, 0), (None, 899)]
    df = spark.createDataFrame(rows, "method_sig string, t long").select("method_sig", F.expr("timestampadd(SECOND, t, timestamp_ntz'2024-01-01 00:00:00')").alias("timestamp"))
    timed = [(m, t) for m, t in rows if m and t is not None]
    got = detect.breadth_rows(df)
    assert got.first().asDict() == {"early_signatures": len({m for m, t in timed if t <= 899 / 3}), "late_signatures": len({m for m, t in timed if t >= 899 * 2 / 3})}
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_looked_through_once(spark):
    """Words are looked for in one text of a document, whatever their number."""
    kept = []
    rows = spark.createDataFrame(traces(1, 1), "source_path string, source_file string, line_no long, ts timestamp_ntz, thread string, clean string")
    spans.request_documents(rows, S, keep=lambda df: kept.append(df) or df)
    assert kept[0]._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4
