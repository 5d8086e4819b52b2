"""The two log tables, the pivoted view, and how they are kept."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, rules

LOG_EVENTS = ["timestamp", "thread", "raw_line", *rules.FLAGS, "method_sig", "latency_ms", "result_count", "scheduled_op_name"]
SERVER_METRICS = ["timestamp", "thread", "metric_name", "metric_value", "category", "raw_line"]


def log_events(parsed: DataFrame, carry: list[str] = ()) -> DataFrame:
    """One row per parsed line (clean, ts, thread): flags and values come from the whole line, raw_line is cut.

    The lower-case line and the flags are columns of their own before they are
    used, so each is worked out once for a line.
    """
    clean = F.col("clean")
    base = parsed.select(*carry, F.col("ts").alias("timestamp"), F.coalesce("thread", F.lit("")).alias("thread"), F.substring(clean, 1, rules.RAW_LINE_CHARS).alias("raw_line"), clean.alias("_clean"), F.lower(clean).alias("_low"))
    whole = F.col("_clean")
    flagged = base.withColumns(extract.flags(whole, F.col("_low")))
    return flagged.withColumns(extract.values(whole, {n: F.col(n) for n in rules.FLAGS})).select(*carry, *LOG_EVENTS)


def server_metrics(parsed: DataFrame) -> DataFrame:
    """One row per numeric name=value pair of the lines that carry metrics."""
    clean = F.col("clean")
    rows = parsed.where(extract.has_metrics(clean)).select("ts", "thread", "clean", F.explode(extract.metric_pairs(clean)).alias("m"))
    return rows.select(F.col("ts").alias("timestamp"), F.coalesce("thread", F.lit("")).alias("thread"), F.col("m.name").alias("metric_name"), F.col("m.value").alias("metric_value"), extract.category(F.col("m.name")).alias("category"), F.substring(clean, 1, rules.RAW_LINE_CHARS).alias("raw_line"))


def signal_candidates(parsed: DataFrame, most: int = rules.PRESCAN_MAX) -> DataFrame:
    """The strongest high-signal lines: timestamp, signal_type, captured_value, snippet, raw_line, line_no."""
    hit = parsed.withColumn("_s", extract.high_signal(F.col("clean"))).where(F.col("_s.signal_type").isNotNull())
    rows = hit.select(F.col("ts").alias("timestamp"), F.col("_s.signal_type").alias("signal_type"), F.col("_s.captured_value").alias("captured_value"), extract.snippet(F.col("clean")).alias("snippet"), F.col("clean").alias("raw_line"), "line_no")
    return rows.orderBy(extract.signal_score(F.col("captured_value")).desc(), "line_no").limit(most)


def pivot(metrics: DataFrame, columns: dict[str, str], by: str = "timestamp") -> DataFrame:
    """The greatest value of each named metric for each ``by``."""
    return metrics.groupBy(by).agg(*(F.max(F.when(F.col("metric_name") == m, F.col("metric_value"))).alias(c) for m, c in columns.items()))


def wide(metrics: DataFrame) -> DataFrame:
    """One row per timestamp with the 14 known metrics as columns, two aliases and a guarded ratio."""
    ratio = F.when(F.col("tomcat_current_threads") > 0, F.col("tomcat_busy_threads") / F.col("tomcat_current_threads"))
    more = {"ts": F.col("timestamp"), "dbcp_max_active": F.lit(None).cast("double"), "response_time": F.col("response_time_ms"), "tomcat_current_threads_busy_ratio": ratio}
    return pivot(metrics, rules.METRIC_COLUMNS).withColumns(more).select(*rules.WIDE_COLUMNS)


def register(events: DataFrame, metrics: DataFrame) -> None:
    """The tables and the view under the names that ad-hoc SQL uses."""
    events.createOrReplaceTempView("log_events")
    metrics.createOrReplaceTempView("server_metrics")
    wide(metrics).createOrReplaceTempView("server_metrics_wide")


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see; a temporary one only where Spark runs in this one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="logweft-")
    return f"{base.rstrip('/')}/logs-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again: lineage ends here."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


READY = "_READY"


def _versions(spark: SparkSession, folder: str):
    """The file system, and the folder's finished versions, oldest first."""
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = home.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [x.getPath().toString() for x in fs.listStatus(home)] if fs.exists(home) else []
    return fs, sorted(p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, READY)))


#: Columns of log_events that point lookups ask for: each file has Bloom filters of them.
LOOKED_UP = ("method_sig", "scheduled_op_name")


def save(events: DataFrame, metrics: DataFrame, folder: str) -> dict[str, dict]:
    """Both tables as Parquet, near in time within a file, so that row-group statistics prune; Bloom filters serve point lookups.

    They go into a new version of the folder, which counts only once both are
    whole and its mark is written: a reader sees the old pair or the new one.
    Older versions are removed afterwards.  What there is to know of a table
    (n, first_seen, last_seen) is observed while it is written, without a scan
    of its own, and returned by the table's name.
    """
    spark = events.sparkSession
    target = f"{folder}/v{time.time_ns():020d}"
    seen = {}
    for name, rows, order in (("log_events", events, ["timestamp"]), ("server_metrics", metrics, ["timestamp", "metric_name"])):
        seen[name] = Observation()
        watched = rows.observe(seen[name], F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
        writer = watched.sortWithinPartitions(*order).write
        for c in LOOKED_UP if name == "log_events" else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{target}/{name}")
    fs, old = _versions(spark, folder)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(target, READY)).close()
    for p in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)
    return {name: o.get for name, o in seen.items()}


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The last saved pair, registered again."""
    if not (done := _versions(spark, folder)[1]):
        raise FileNotFoundError(f"{folder}: no saved tables")
    events, metrics = spark.read.parquet(f"{done[-1]}/log_events"), spark.read.parquet(f"{done[-1]}/server_metrics")
    register(events, metrics)
    return events, metrics


class Kept:
    """Frames that are used more than once, persisted while a ``with`` block runs and let go at its end."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist())
        return self.frames[-1]

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        while self.frames:
            self.frames.pop().unpersist()


def coverage(rows: DataFrame, at: str = "timestamp") -> DataFrame:
    """first_seen, last_seen and n."""
    return rows.agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))


# --- log events with a skip index: days as partitions, files near in what is looked up, and a table of what each file holds ---

def save_indexed(events: DataFrame, folder: str) -> None:
    """``log_events`` by day, and within a day in files and row groups near in method_sig, with Bloom filters and a table of each file's least and greatest values.

    Rows are cut into ranges of (day, method_sig, time), so neither a large day
    nor a frequent signature makes a large file.
    """
    spark = events.sparkSession
    dated = events.withColumn("day", F.to_date("timestamp"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = dated.repartitionByRange(n, "day", "method_sig", "timestamp").sortWithinPartitions("day", "method_sig", "timestamp").write.partitionBy("day")
    for c in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows").withColumn("file", F.col("_metadata.file_path"))
    known = [f(c).alias(f"{name}_{c}") for c in (*LOOKED_UP, "timestamp") for name, f in (("least", F.min), ("most", F.max))]
    rows.groupBy("file", "day").agg(*known, F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")  # a row for each file


def find(spark: SparkSession, folder: str, column: str, value: str, days: tuple[str, str] | None = None) -> DataFrame:
    """The rows with a value of one of ``LOOKED_UP``, in some days: only files whose bounds hold the value are opened, and of those the row groups whose Bloom filter does."""
    if column not in LOOKED_UP:
        raise ValueError(f"{column}: there is no index of it")
    files = spark.read.parquet(f"{folder}/files").where(F.lit(value).between(F.col(f"least_{column}"), F.col(f"most_{column}")))
    if days:
        files = files.where(F.col("day").between(*(F.lit(d).cast("date") for d in days)))
    paths = [r.file for r in files.select("file").collect()]
    rows = spark.read.option("basePath", f"{folder}/rows")
    whole = rows.parquet(*paths) if paths else rows.parquet(f"{folder}/rows").limit(0)
    return whole.where(F.col(column) == value).select(*LOG_EVENTS)
