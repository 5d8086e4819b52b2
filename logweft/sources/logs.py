r"""Log files as a data source, ``format("logs")``: lines of byte ranges, pruned by what an index knows of each range.

A range holds the lines whose first byte lies in it, so ranges are read apart
and no line is lost or read twice.  ``build_index`` counts a range's lines and
takes its first and last time once, in one distributed pass; readers with the
index number lines absolutely, and conditions on ``first_ts``, ``last_ts`` and
``untimed`` can be pushed down to whole ranges before any byte is read.  As a
stream the source hands out whatever was appended to its files, up to the last
line end, in ranges of the same size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.parse import in_window, parse_lines
from ..functions.schema import LogSchema
from .files import folder_of

RANGE_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 8 * 1024 * 1024
#: Ranges that an index may have with a task for each; more of them share about as many tasks, or one for every ``RANGE_BYTES``.
TASKS = 16
SCHEMA = "source_path string, source_file string, range_start bigint, line_no bigint, raw string, first_ts timestamp_ntz, last_ts timestamp_ntz, untimed bigint"
INDEX = "source_path string, range_start bigint, range_end bigint, first_line bigint, lines bigint, first_ts timestamp_ntz, last_ts timestamp_ntz, untimed bigint"
#: What a range is known by, and may be pruned on.
KNOWN = ("source_path", "source_file", "range_start", "first_ts", "last_ts", "untimed")


@dataclass
class Range(InputPartition):
    source_path: str
    range_start: int
    range_end: int
    first_line: int | None = None
    first_ts: datetime | None = None
    last_ts: datetime | None = None
    untimed: int | None = None

    def known(self, column: str) -> Any:
        return self.source_path.rsplit("/", 1)[-1] if column == "source_file" else getattr(self, column)


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[Range]


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's log files, sorted."""
    system, inner = fs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and (x is info or x.extension.lower() in {s.lstrip(".") for s in rules.LOG_SUFFIXES}))


def lines_of(path: str, start: int, end: int) -> Iterator[list[bytes]]:
    r"""The lines whose first byte is in [start, end), some at a time; ``\n``, ``\r`` and ``\r\n`` end lines, ranges are cut at ``\n`` only."""
    with _open(path) as f:
        size = f.size()
        at, held = start, b""
        if start:
            f.seek(start - 1)
            at = start - 1
        else:
            f.seek(0)
        skipping, stop = start > 0, False
        while not stop:
            # Little more than the range: small ranges would else read the file many times over.
            block = f.read(min(BLOCK_BYTES, max(end - at, 4_096)))
            if skipping:  # up to the first line that starts here
                cut = block.find(b"\n") + 1
                if not cut:
                    at += len(block)
                    if not block or at >= end:
                        return
                    continue
                block, at, skipping = block[cut:], at + cut, False
                if at >= end:
                    return
            text, begin = held + block, at - len(held)
            at += len(block)
            if at >= end:  # the line that begins before the end goes on to its own end
                last = text.find(b"\n", max(0, end - 1 - begin))
                if last >= 0:
                    text, stop = text[: last + 1], True
            if at >= size:
                stop = True
            if stop:
                held = b""
            else:
                last = text.rfind(b"\n") + 1
                text, held = text[:last], text[last:]
            if begin == 0 and text.startswith(b"\xef\xbb\xbf"):
                text = text[3:]
            if text:
                parts = re.split(rb"\r\n|\n|\r", text)
                yield parts[:-1] if parts[-1] == b"" else parts


def _batches(part: Range) -> Iterator[pa.RecordBatch]:
    line = 0 if part.first_line is None else part.first_line - 1
    for found in lines_of(part.source_path, part.range_start, part.range_end):
        for k in range(0, len(found), 20_000):
            raw = [x.decode("utf-8", "replace") for x in found[k : k + 20_000]]
            n = len(raw)
            same = lambda v, kind: pa.array([v] * n, kind)  # noqa: E731, B023
            ts = pa.timestamp("us")
            yield pa.RecordBatch.from_arrays(
                [same(part.source_path, pa.string()), same(part.known("source_file"), pa.string()), same(part.range_start, pa.int64()), pa.array(range(line + 1, line + n + 1), pa.int64()), pa.array(raw, pa.string()), same(part.first_ts, ts), same(part.last_ts, ts), same(part.untimed, pa.int64())],
                ["source_path", "source_file", "range_start", "line_no", "raw", "first_ts", "last_ts", "untimed"])
            line += n


def _cut(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, a, min(a + size, end)) for a in range(start, end, size)]


def _shared(found: list[Range]) -> list[InputPartition]:
    """Partitions of neighbouring ranges: one for each of few ranges, and of many so many together that a task does not cost more than what it reads."""
    most = 0 if len(found) <= TASKS else min(RANGE_BYTES, sum(r.range_end - r.range_start for r in found) // TASKS)
    out: list[Ranges] = []
    size = 0
    for r in found:
        n = r.range_end - r.range_start
        if not out or size + n > most:
            out.append(Ranges([]))
            size = 0
        out[-1].ranges.append(r)
        size += n
    return out or [Ranges([])]


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.pushed = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kinds = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNull, IsNotNull)
            if self.options.get("prune") == "true" and isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in KNOWN and ("index" in self.options or f.attribute[0] in ("source_path", "source_file")):
                self.pushed.append(f)
            else:
                yield f

    def _passes(self, part: Range) -> bool:
        for f in self.pushed:
            v = part.known(f.attribute[0])
            if isinstance(f, (IsNull, IsNotNull)):
                if (v is None) != isinstance(f, IsNull):
                    return False
            elif v is None:
                return False
            elif not {EqualTo: v == f.value, GreaterThan: v > f.value, GreaterThanOrEqual: v >= f.value, LessThan: v < f.value, LessThanOrEqual: v <= f.value}[type(f)]:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        if "index" in self.options:
            system, inner = fs.FileSystem.from_uri(self.options["index"])
            known = ds.dataset(inner, filesystem=system, format="parquet").to_table().to_pylist()  # a row for each range
            found = [Range(r["source_path"], r["range_start"], r["range_end"], r["first_line"], r["first_ts"], r["last_ts"], r["untimed"]) for r in known]
        else:
            size = int(self.options.get("rangebytes", RANGE_BYTES))
            found = [r for path, n in files_under(self.options["path"]) for r in _cut(path, 0, n, size)]
        return _shared([r for r in found if self._passes(r)])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from _batches(one)


class LogStreamReader(DataSourceStreamReader):
    """An offset says how many bytes of each file are taken; an unfinished last line waits."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: upto for path, size in files_under(self.options["path"]) if (upto := self._whole(path, size))}

    @staticmethod
    def _whole(path: str, size: int) -> int:
        with _open(path) as f:
            upto = size
            while upto:
                start = max(0, upto - 65_536)
                f.seek(start)
                if (at := f.read(upto - start).rfind(b"\n")) >= 0:
                    return start + at + 1
                upto = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        size = int(self.options.get("rangebytes", RANGE_BYTES))
        return [r for path, upto in sorted(end.items()) for r in _cut(path, start.get(path, 0), upto, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition)


class LogSource(DataSource):
    """Options: ``path`` (a file or a folder, any file system that Arrow opens), ``rangeBytes``, ``index``, ``prune``.

    ``prune`` takes conditions into the source.  Spark keeps what a source has
    taken with the frame that was loaded, also for other conditions on it, so
    this is for a frame that is filtered in one way only (``read_window`` loads
    one for each of its conditions); without it conditions are left to Spark.

    Without an index and in streams ``line_no`` counts from the start of its
    range, and what an index knows is null.
    """

    @classmethod
    def name(cls) -> str:
        return "logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def build_index(spark: SparkSession, path: str, schema: LogSchema, folder: str, range_bytes: int = RANGE_BYTES, *, rotated: bool = False) -> str:
    """What there is to know of each range, written to ``folder``: one pass over the files, one row for each range.

    ``rotated`` numbers lines through the files of a folder, as ``files.read_lines`` does.
    """
    register(spark)
    lines = spark.read.format("logs").option("path", path).option("rangeBytes", str(range_bytes)).load()
    ts = F.col("ts")
    found = parse_lines(lines, schema).groupBy("source_path", "range_start").agg(F.count("*").alias("lines"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_if(ts.isNull()).alias("untimed"))
    by = Window.partitionBy("source_path").orderBy("range_start")
    log = Window.partitionBy(folder_of(F.col("source_path"))).orderBy("source_path", "range_start") if rotated else by
    first = F.coalesce(F.sum("lines").over(log.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    end = F.coalesce(F.lead("range_start").over(by), F.col("range_start") + range_bytes)  # a range in the middle of a long line has no row and is left out
    known = found.select("source_path", "range_start", end.alias("range_end"), first.alias("first_line"), "lines", "first_ts", "last_ts", "untimed")
    known.coalesce(1).write.mode("overwrite").parquet(folder)
    return folder


def read_indexed(spark: SparkSession, index: str, only: Column | None = None) -> DataFrame:
    """All lines, numbered absolutely, with what is known of their ranges; with ``only``, lines of the ranges for which it holds, and no other range is opened."""
    register(spark)
    source = spark.read.format("logs").option("index", index)
    return source.load() if only is None else source.option("prune", "true").load().where(only)


def read_window(spark: SparkSession, index: str, schema: LogSchema, start: datetime, end: datetime) -> DataFrame:
    """Parsed lines of a time window, and those without a time, from the ranges that can hold either.

    Ranges that overlap the window are read whole; of the others only those
    with lines that have no time.
    """
    a, b = (F.lit(t.replace(tzinfo=None)).cast("timestamp_ntz") for t in (start, end))
    first, last, loose = F.col("first_ts"), F.col("last_ts"), F.col("untimed") > 0
    near = read_indexed(spark, index, (last >= a) & (first <= b))
    others = [loose & (last < a), loose & (first > b), first.isNull()]
    far = reduce(DataFrame.unionByName, [read_indexed(spark, index, only) for only in others])
    parsed = parse_lines(near, schema).where(in_window(F.col("ts"), start, end))
    return parsed.unionByName(parse_lines(far, schema).where("ts is null"))
