"""The log tables over a stream: the same expressions on unbounded input, with watermarks, keyed state and a sink that counts a repeated batch once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import extract
from ..functions.parse import parse_lines
from ..functions.schema import LogSchema
from ..functions.signals import RetrievalSignals

#: Waiting rows in one element of the state.
PACKED = 20_000
#: Keyed state with timers needs this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_log_stream(spark: SparkSession, folder: str, schema: LogSchema, **options: str) -> DataFrame:
    """Parsed lines of text files as they arrive in a folder, the oldest file first."""
    lines = spark.readStream.options(**options).text(folder).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("raw"))
    return parse_lines(lines, schema)


def start_into(stream: DataFrame, folder: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Writes what a query emits, a folder for each batch; its number names the folder, so a batch repeated after a failure replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def emitted(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """All rows that a query has written so far, each batch once."""
    return spark.read.schema(like.schema).parquet(f"{folder}/batch=*")


def dropped(query: StreamingQuery) -> int:
    """Rows that stateful operators have dropped as too late, over the query's recent batches.

    Before an aggregation rows of one key and window are combined, so there
    they count as one for each task.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def minute_counts(parsed: DataFrame, *, late: str = "2 minutes", width: str = "1 minute") -> DataFrame:
    """Lines and error lines per tumbling window; later lines than the watermark are left out."""
    rows = parsed.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp"))
    error = extract.is_error(F.col("clean"), RetrievalSignals())
    return rows.withWatermark("at", late).groupBy(F.window("at", width)).agg(F.count("*").alias("lines"), F.count_if(error).alias("errors")).select(F.col("window.start").alias("minute"), "lines", "errors")


def bursts(parsed: DataFrame, *, span: str = "30 seconds", slide: str = "5 seconds", least: int = 5, late: str = "1 minute") -> DataFrame:
    """Method signatures seen more than ``least`` times in a sliding window; every line moves the watermark on, also those without a signature."""
    rows = parsed.withColumn("method_sig", extract.values(F.col("clean"))["method_sig"]).where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    # A condition on the time stays above the watermark; without it the filter would be moved below.
    named = rows.where(F.when(F.col("at").isNotNull(), F.col("method_sig")).isNotNull())
    return named.groupBy(F.window("at", span, slide), "method_sig").agg(F.count("*").alias("burst")).where(F.col("burst") > least).select(F.col("window.start").alias("start"), "method_sig", "burst")


class Requests(StatefulProcessor):
    """Requests of one thread, from entry to exit, in the order of (time, line).

    Rows wait in a list, ``PACKED`` of them in one element (two integers each:
    time, and line with its marks), as an element of the state costs far more
    than what it holds.  They wait until the watermark has passed them, which a timer
    tells, so rows that arrive out of order within the allowed lateness are
    taken in order.  What stays is one open request for a thread, as a value;
    another timer lets it go as unmatched once its thread has been silent for
    ``idle_ms`` of event time.  Both live in the state store and survive a
    restart.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getValueState("open", "start_line long, end_line long, lines long, last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        latest = None
        while new := [(r["at_ms"], r["line_no"] * 4 + r["is_start"] * 2 + r["is_end"]) for r in islice(rows, PACKED)]:
            self.waiting.appendList([(np.array(new, np.int64).tobytes(),)])
            latest = max(new)[0] if latest is None else max(latest, max(new)[0])
        if latest is not None:
            self.handle.registerTimer(latest + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = np.frombuffer(b"".join(bytes(x[0]) for x in self.waiting.get()) if self.waiting.exists() else b"", np.int64).reshape(-1, 2)
        due = held[:, 0] <= now
        if due.any():
            rest = held[~due]
            packs = [(rest[k : k + PACKED].tobytes(),) for k in range(0, len(rest), PACKED)]
            self.waiting.put(packs) if packs else self.waiting.clear()
        ready = held[due]
        ready = ready[np.lexsort((ready[:, 1], ready[:, 0]))]
        current = list(self.open.get()) if self.open.exists() else None
        for at, packed in zip(*ready.T.tolist(), strict=True):
            line, is_start, is_end = packed >> 2, packed & 2, packed & 1
            if current and at - current[3] > self.idle_ms:
                yield self._row(key, current, True)
                current = None
            if is_start:
                if current:
                    yield self._row(key, current, True)
                current = [line, line, 0, at]
            if current:
                current[1:] = [line, current[2] + 1, at]
                if is_end:
                    yield self._row(key, current, False)
                    current = None
        if current and now - current[3] > self.idle_ms:
            yield self._row(key, current, True)
            current = None
        if current:
            self.open.update(tuple(current))
            self.handle.registerTimer(current[3] + self.idle_ms + 1)
        elif self.open.exists():
            self.open.clear()

    def _row(self, key: Any, request: list, unmatched: bool) -> Row:
        return Row(source_path=key[0], thread=key[1], start_line=request[0], end_line=request[1], lines=request[2], unmatched_exit=unmatched)


def open_requests(parsed: DataFrame, signals: RetrievalSignals, *, late: str = "1 minute", idle: str = "10 minutes") -> DataFrame:
    """Requests as they end, per file and thread: (source_path, thread, start_line, end_line, lines, unmatched_exit).

    ``parsed`` has ``line_no``; lines without a time cannot be placed in event
    time and are left out, as are those that come later than ``late`` behind the
    newest.  State is the lines of the last ``late`` and one open request for
    each thread.
    """
    spark, clean = parsed.sparkSession, F.col("clean")
    if spark.conf.get(STORE[0], "") != STORE[1]:
        raise ValueError(f"open requests need {STORE[0]}={STORE[1]}")
    rows = parsed.where("ts is not null").select("source_path", F.coalesce("thread", F.lit("no_thread")).alias("thread"), F.col("ts").cast("timestamp").alias("at"), "line_no", extract.has_marker(clean, signals.start_markers).alias("is_start"), extract.has_marker(clean, signals.end_markers).alias("is_end"))
    rows = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    millis = spark.sql(f"SELECT timestampdiff(MILLISECOND, timestamp_ntz'2000-01-01', timestamp_ntz'2000-01-01' + interval {idle})").first()[0]
    schema = "source_path string, thread string, start_line long, end_line long, lines long, unmatched_exit boolean"
    return rows.groupBy("source_path", "thread").transformWithState(Requests(millis), schema, "append", "eventTime")
