"""Structural detectors over log_events and server_metrics.

Each ``*_rows`` function is a DataFrame query; thresholds are parameters whose
defaults are the production values.  ``signals`` turns their few result rows
into scored signals.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .gaps import lagged, minute, number_of, place, quantiles, seconds, with_previous
from .tables import pivot

#: Spans in one stretch of time that is counted apart.
STRETCH = 20


def log_gap_rows(events: DataFrame, *, least: float = rules.GAP_SECONDS, top: int | None = 10) -> DataFrame:
    """Silences between consecutive log lines, the longest first.

    Lines in one bucket of time of ``least`` seconds are nearer than that, so
    a silence lies between the last line of a bucket and the first of the
    next: buckets are ordered, and not lines.
    """
    at = events.where("timestamp is not null").select("timestamp")
    width = int(least * 1_000_000)
    if width > 0:
        buckets = at.groupBy(F.floor(number_of(at, "timestamp") / width).alias("_bucket")).agg(F.min("timestamp").alias("timestamp"), F.max("timestamp").alias("_last"))
        led = lagged(buckets, "timestamp", ["_last"]).withColumnRenamed("prev__last", "prev_ts")
    else:
        led = with_previous(at, "timestamp")
    out = led.where("prev_ts is not null").select("timestamp", "prev_ts", seconds("prev_ts", "timestamp").alias("gap_seconds")).where(F.col("gap_seconds") >= least)
    return out if top is None else out.orderBy(F.desc("gap_seconds"), "timestamp").limit(top)


def per_minute(rows: DataFrame, count: str, unit: str = "minute") -> DataFrame:
    return rows.groupBy(minute(F.col("timestamp"), unit).alias("minute")).agg(F.count("*").alias(count))


def divergence_rows(metrics: DataFrame, events: DataFrame, *, unit: str = "minute", least_metrics: int = 2, most_logs: int = 1, top: int | None = 10) -> DataFrame:
    """Minutes in which metrics went on while the log fell silent."""
    joined = per_minute(metrics, "metric_rows", unit).join(per_minute(events, "log_rows", unit), "minute", "left")
    rows = joined.select("minute", "metric_rows", F.coalesce("log_rows", F.lit(0)).alias("log_rows")).where((F.col("metric_rows") >= least_metrics) & (F.col("log_rows") <= most_logs))
    out = rows.withColumn("log_to_metric_ratio", F.col("log_rows").cast("double") / F.col("metric_rows"))
    return out if top is None else out.orderBy(F.desc("metric_rows"), F.asc_nulls_last("minute")).limit(top)


def correlation_rows(metrics: DataFrame, *, deltas: tuple[float, float] = (5, 2), levels: tuple[float, float] = (100, 20), top: int | None = 15) -> DataFrame:
    """Snapshots in which threads and connections rose together or are both high.

    Snapshots are pivoted, one row per timestamp, before each looks at the one
    before it.  Ranges of time are cut at quantiles of the metrics' own
    times, so nothing is pivoted for them.
    """
    p = pivot(metrics, {"jvm.threadCount": "thread_count", "dbcp.ActiveConnections": "active_conns", "hibernate.sessionCount": "hibernate_sessions"}).where("thread_count is not null or active_conns is not null")
    near = lagged(p, "timestamp", ["thread_count", "active_conns"], range_=place(metrics, "timestamp"))
    d = near.select(*p.columns, (F.col("thread_count") - F.col("prev_thread_count")).alias("thread_delta"), (F.col("active_conns") - F.col("prev_active_conns")).alias("conn_delta"))
    out = d.where(((F.col("thread_delta") > deltas[0]) & (F.col("conn_delta") > deltas[1])) | ((F.col("thread_count") > levels[0]) & (F.col("active_conns") > levels[1])))
    return out if top is None else out.orderBy(F.asc_nulls_last("timestamp")).limit(top)


def breadth_rows(events: DataFrame) -> DataFrame:
    """Distinct method signatures in the first and in the last third of the log's span: one row."""
    # A signature is early if its first line is, and late if its last one is; lines without one count for the bounds.
    per = events.groupBy("method_sig").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    bounds = per.agg(F.min("first").alias("t_min"), F.max("last").alias("t_max"))
    cuts = bounds.select((F.col("t_min") + (F.col("t_max") - F.col("t_min")) / 3).alias("early_to"), (F.col("t_min") + (F.col("t_max") - F.col("t_min")) * 2 / 3).alias("late_from"))
    near = per.where("method_sig is not null").crossJoin(F.broadcast(cuts))  # one row
    return near.agg(F.count(F.when(F.col("first") <= F.col("early_to"), 1)).alias("early_signatures"), F.count(F.when(F.col("last") >= F.col("late_from"), 1)).alias("late_signatures"))


def result_count_rows(events: DataFrame, *, top: int = 5) -> DataFrame:
    return events.where("has_count_rows").orderBy(F.desc_nulls_last("result_count"), F.asc_nulls_last("timestamp")).limit(top).select("timestamp", "raw_line", "result_count")


def burst_counts(rows: DataFrame, key: str, span: int, out: str, at: str = "timestamp") -> DataFrame:
    """``rows`` (``at`` not null) with how many rows of their key lie within ``span`` seconds before each, itself included.

    A key's time is cut into stretches of ``STRETCH`` spans, which are counted
    apart, so one very frequent key does not meet in one task; a row near a
    stretch's end is lent to the next one.
    """
    width = span * STRETCH * 1_000_000
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {at})")
    own, upto = F.floor(micros / width), F.floor((micros + span * 1_000_000) / width)
    dealt = rows.withColumn("_own", own).withColumn("_stretch", F.explode(F.sequence("_own", upto)))
    count = F.expr(f"count(*) over (partition by {key}, _stretch order by {at} range between interval {span} seconds preceding and current row)")
    return dealt.withColumn(out, count).where("_stretch = _own").drop("_stretch", "_own")


def burst_rows(events: DataFrame, *, span: int = 30, least: int = 5, top: int | None = 10, authz_only: bool = True) -> DataFrame:
    """Lines of one method signature within ``span`` seconds before each, itself included."""
    src = events.where("method_sig is not null and timestamp is not null" + (" and has_entry_authz" if authz_only else "")).select("timestamp", F.col("method_sig").alias("signature"))
    out = burst_counts(src, "signature", span, "burst").where(F.col("burst") > least)
    return out if top is None else out.orderBy(F.desc("burst"), "timestamp", "signature").limit(top)


def line_rate_rows(events: DataFrame, *, unit: str = "minute", top: int | None = 5) -> DataFrame:
    out = per_minute(events, "lines_per_min", unit)
    return out if top is None else out.orderBy(F.desc("lines_per_min"), F.asc_nulls_last("minute")).limit(top)


def stall_rows(metrics: DataFrame, *, threads: float = 80, busy_share: float = 0.3, response: float = 500, top: int | None = 10) -> DataFrame:
    """Many threads, few of them busy, slow answers."""
    p = pivot(metrics, {"jvm.threadCount": "thread_count", "am.tomcat.thread.busy.count": "busy_threads", "am.auth.responseTime": "response_time"})
    out = p.where((F.col("thread_count") > threads) & (F.col("busy_threads").isNull() | (F.col("busy_threads") < F.col("thread_count") * busy_share)) & (F.col("response_time").isNull() | (F.col("response_time") > response)))
    return out if top is None else out.orderBy(F.desc_nulls_last("response_time"), F.asc_nulls_last("timestamp")).limit(top)


def recurring_rows(events: DataFrame, *, unit: str = "hour", least: int = 2, steady: float = 1.5, top: int | None = 10) -> DataFrame:
    """Scheduled operations that recur at a steady rate: hours seen, mean and spread of their hourly counts."""
    ops = events.where("has_scheduled and scheduled_op_name is not null and scheduled_op_name <> ''")
    hourly = ops.groupBy(minute(F.col("timestamp"), unit).alias("hour_bucket"), F.col("scheduled_op_name").alias("operation")).agg(F.count("*").alias("occurrences"), F.avg(F.length("raw_line")).alias("avg_line_len")).where(F.col("occurrences") >= least)
    out = hourly.groupBy("operation").agg(F.countDistinct("hour_bucket").alias("hours_seen"), F.avg("occurrences").alias("avg_occurrences"), F.stddev_samp("occurrences").alias("std_occurrences")).where((F.col("hours_seen") >= 2) & (F.coalesce("std_occurrences", F.lit(0.0)) < steady))
    return out if top is None else out.orderBy(F.desc("hours_seen"), "operation").limit(top)


def onset_rows(metrics: DataFrame, *, response: float = 200, threads: float = 20, conns: float = 5, queue: float = 10, top: int | None = 20) -> DataFrame:
    """The first snapshots that leave the medians of the whole log behind."""
    p = pivot(metrics, {"am.auth.responseTime": "response_time", "jvm.threadCount": "thread_count", "dbcp.ActiveConnections": "active_conns", "eventManager.threadPoolQueueSize": "queue_size"})
    p = p.persist()
    try:
        mid = {c: F.lit(v).cast("double") for c, v in quantiles(p, ["response_time", "thread_count", "active_conns"]).items()}
    finally:
        p.unpersist()
    p = p.withColumns({"rt_p50": mid["response_time"], "tc_p50": mid["thread_count"], "ac_p50": mid["active_conns"]})
    out = p.where(
        ((F.col("response_time") > F.col("rt_p50") * 2) & (F.col("response_time") > response)) | (F.col("thread_count") > F.col("tc_p50") + threads) | (F.col("active_conns") > F.col("ac_p50") + conns) | (F.col("queue_size") > queue))
    return out if top is None else out.orderBy(F.asc_nulls_last("timestamp")).limit(top)


# --- supplements around an onset ---

def _between(onset: str, before: int, after: int) -> Column:
    """Whether a row is within some minutes of a time, which is a value here and never a part of a statement."""
    at = F.lit(onset).cast("timestamp_ntz")
    return F.col("timestamp").between(at - F.expr(f"interval {before} minutes"), at + F.expr(f"interval {after} minutes"))


def onset_minute_rows(wide: DataFrame, onset: str) -> DataFrame:
    """Per minute, the peaks of four metrics from 3 minutes before to 5 after the onset."""
    near = wide.where(_between(onset, 3, 5) & F.col("thread_count").isNotNull())
    return near.groupBy(minute(F.col("timestamp")).alias("minute")).agg(F.max("thread_count").alias("max_thread_count"), F.max("dbcp_active_connections").alias("max_dbcp_active"), F.max("hibernate_sessions").alias("max_hibernate_sessions"), F.max("response_time_ms").alias("max_response_time_ms"))


def _around(events: DataFrame, onset: str | None) -> DataFrame:
    return events if onset is None else events.where(_between(onset, 3, 10))


def onset_latency_rows(events: DataFrame, onset: str | None, *, top: int = 10) -> DataFrame:
    return _around(events, onset).where("has_latency or has_rest").orderBy(F.desc_nulls_last("latency_ms"), F.asc_nulls_last("timestamp")).limit(top).select("timestamp", "raw_line", "latency_ms")


def backend_rows(events: DataFrame, onset: str | None = None, *, top: int | None = 15) -> DataFrame:
    """Lines that name a backend; without an onset the bare word sql does not count."""
    flags = ["has_jdbc", "has_ldap", "has_hibernate", "has_connection_wait", "has_staleobject", *(["has_sql"] if onset else [])]
    out = _around(events, onset).where(" or ".join(flags)).select("timestamp", "raw_line")
    return out if top is None else out.orderBy(F.asc_nulls_last("timestamp"), "raw_line").limit(top)


def supplements(events: DataFrame, metrics_wide: DataFrame, onset: str | None) -> dict[str, DataFrame]:
    """Three queries around an onset (19 characters at least), or three over the whole log."""
    if onset and len(onset) >= 19:
        onset = onset.replace("T", " ")
        return {"onset_minute_metrics": onset_minute_rows(metrics_wide, onset).orderBy("minute"), "onset_extreme_latencies": onset_latency_rows(events, onset), "onset_backend_dependency_signals": backend_rows(events, onset)}
    cover = metrics_wide.agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("snapshots"))
    return {"metrics_coverage": cover, "top_extreme_latencies": onset_latency_rows(events, None), "backend_dependency_signals": backend_rows(events, None)}


# --- signals ---

@dataclass
class Signal:
    signal_family: str
    summary: str
    strength: float
    observations: list[str] = field(default_factory=list)
    timestamp_start: str = ""
    timestamp_end: str = ""
    signal_id: str = ""

    def __post_init__(self) -> None:
        self.strength = max(0.0, min(1.0, self.strength))
        self.signal_id = self.signal_id or hashlib.sha1(f"{self.signal_family}|{self.summary}".encode()).hexdigest()[:12]


def _signal(family: str, summary: str, strength: float, rows: list, start: Any = None, end: Any = None, shown: int = 5) -> Signal:
    return Signal(family, summary, strength, [str(r.asDict()) for r in rows[:shown]], "" if start is None else str(start), "" if end is None else str(end))


def broad_signals(events: DataFrame, metrics: DataFrame, *, least: float = rules.MIN_STRENGTH, errors: list[str] | None = None) -> list[Signal]:
    """Every detector's signal of at least the given strength, the strongest first.

    A detector that fails is recorded in ``errors`` and the others go on; only
    this composite does so.
    """
    found: list[Signal] = []

    def attempt(name: str, f) -> None:
        try:
            got = f()
            found.extend(got if isinstance(got, list) else [got] if got else [])
        except Exception as e:  # noqa: BLE001
            if errors is None:
                raise
            errors.append(f"{name}: {e}")

    def gap():
        if r := log_gap_rows(events).collect():
            return _signal("log_gap", f"Longest silence of the log: {r[0].gap_seconds:.0f} s between lines", r[0].gap_seconds / (3 * rules.GAP_SECONDS), r, r[0].prev_ts, r[0].timestamp)

    def divergence():
        if r := divergence_rows(metrics, events).collect():
            return _signal("runtime_stall_indicator", "Metrics go on while the log falls silent", r[0].metric_rows / 10, r, r[0].minute)

    def correlation():
        if r := correlation_rows(metrics).collect():
            moved = sum((x.thread_delta or 0) > 0 and (x.conn_delta or 0) > 0 for x in r)
            return _signal("metric_correlation", f"Threads and connections rise together in {moved} of {len(r)} snapshots", moved / len(r) + 0.2, r, r[0].timestamp, r[-1].timestamp)

    def breadth():
        r = breadth_rows(events).collect()
        early, late = r[0].early_signatures, r[0].late_signatures
        ratio = late / max(early, 1)
        if ratio > 3:
            return _signal("endpoint_breadth", f"More endpoints late in the log ({early} to {late} signatures)", ratio / 10, r)
        narrow = late <= 3 and early <= 5
        return _signal("endpoint_breadth", f"{'Few' if narrow else 'Moderately many'} endpoints (early {early}, late {late})", 0.6 if narrow else 0.35, r)

    def volume():
        out = []
        if r := result_count_rows(events).collect():
            out.append(_signal("high_volume_indicator", f"Large result counts ({len(r)} lines)", len(r) / 5, r, r[-1].timestamp, r[0].timestamp))
        if r := burst_rows(events).collect():
            out.append(_signal("high_volume_indicator", f"Burst of one method ({r[0].burst} within 30 s)", r[0].burst / 50, r, r[-1].timestamp, r[0].timestamp))
        if r := line_rate_rows(events).collect():
            out.append(_signal("high_volume_indicator", f"Peak of {r[0].lines_per_min} lines a minute", r[0].lines_per_min / 5000, r, r[-1].minute, r[0].minute))
        return out

    def stall():
        if r := stall_rows(metrics).collect():
            return _signal("runtime_stall_indicator", "Many threads, few of them busy, slow answers", len(r) / 5 + 0.2, r, r[0].timestamp)

    for name, f in (("log_gap", gap), ("divergence", divergence), ("correlation", correlation), ("breadth", breadth), ("volume", volume), ("stall", stall)):
        attempt(name, f)
    return sorted((s for s in found if s.strength >= least), key=lambda s: -s.strength)


def signal_frame(spark, signals: list[Signal]) -> DataFrame:
    schema = "signal_family string, summary string, strength double, observations array<string>, timestamp_start string, timestamp_end string, signal_id string"
    return spark.createDataFrame([tuple(asdict(s).values()) for s in signals], schema)
