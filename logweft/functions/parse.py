"""Lines to typed columns: all native expressions, one projection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .schema import LogSchema


def unicode(pattern: str) -> str:
    r"""Java's \w, \d, \s and \b know all letters only if told so."""
    return "(?U)" + pattern


def has(text: Column, pattern: str) -> Column:
    return text.rlike(unicode(pattern))


def group(text: Column, pattern: str, index: int) -> Column:
    """A group of the first match, or null (Spark itself gives '')."""
    return F.nullif(F.regexp_extract(text, unicode(pattern), index), F.lit(""))


def any_contains(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def clean_line(raw: Column) -> Column:
    return F.rtrim(F.regexp_replace(raw, rules.LINE_PREFIX, ""), F.lit("\r\n"))


def timestamp_of(clean: Column, schema: LogSchema) -> Column:
    """The line's first timestamp as timestamp_ntz; null where there is none or it is no date."""
    if not schema.timestamp_fmt:
        return F.lit(None).cast("timestamp_ntz")
    text = F.nullif(F.regexp_extract(clean, schema.timestamp_re, 1), F.lit(""))
    if schema.spark_format is None:
        return text.try_cast("timestamp_ntz")
    text = F.regexp_replace(text, r":(\d{3})$", ".$1")
    at = F.try_to_timestamp(text, F.lit(schema.spark_format)).cast("timestamp_ntz")
    if "%y" in schema.timestamp_fmt:  # two-digit years from 69 on are of the last century
        at = F.when(F.year(at) > 2068, at - F.expr("INTERVAL '100' YEAR")).otherwise(at)
    return at


def thread_of(clean: Column, schema: LogSchema) -> Column:
    return group(clean, schema.thread_re, 1) if schema.thread_re else F.lit(None).cast("string")


def session_label(clean: Column, schema: LogSchema) -> Column:
    """``key:value`` of the first configured key that the line has."""
    labels = [F.concat(F.lit(k + ":"), group(clean, p, 1)) for p, k in schema.session_keys]
    return F.coalesce(*labels) if labels else F.lit(None).cast("string")


def parse_lines(lines: DataFrame, schema: LogSchema, raw: str = "raw") -> DataFrame:
    """``lines`` with clean, ts (timestamp_ntz) and thread (null if none)."""
    out = lines.withColumn("clean", clean_line(F.col(raw)))
    return out.withColumns({"ts": timestamp_of(F.col("clean"), schema), "thread": thread_of(F.col("clean"), schema)})


def in_window(ts: Column, start: datetime | None, end: datetime | None) -> Column:
    """Inclusive at both ends; lines without a timestamp stay."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= F.lit(start.replace(tzinfo=None)).cast("timestamp_ntz"))
    if end is not None:
        keep = keep & (ts <= F.lit(end.replace(tzinfo=None)).cast("timestamp_ntz"))
    return ts.isNull() | keep
