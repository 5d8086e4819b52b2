"""How selected evidence covers its files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def bounds(text: Column) -> tuple[Column, Column]:
    """The least and greatest line of a range text such as 3-7, 12."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.array_min(numbers), F.array_max(numbers)


def range_bounds(text: str | None) -> tuple[int, int] | None:
    found = [int(x) for x in re.findall(r"\d+", text or "")]
    return (min(found), max(found)) if found else None


def row_bounds() -> tuple[Column, Column]:
    """A row's lines: error ranges, else ranges, else start and end."""
    e, r = bounds(F.col("error_line_ranges")), bounds(F.col("line_ranges"))
    return F.coalesce(e[0], r[0], F.col("start_line")), F.coalesce(e[1], r[1], F.col("end_line"))


def buckets(totals: DataFrame, n: int = 4) -> DataFrame:
    """(source_file, bucket, first_line, last_line): even parts of each file (source_file, total_lines)."""
    i = F.col("bucket")
    return totals.select("source_file", "total_lines", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket")).select("source_file", "bucket", (F.expr(f"bucket * total_lines div {n}") + 1).alias("first_line"), F.expr(f"(bucket + 1) * total_lines div {n}").alias("last_line")).where(i.isNotNull())


def bucket_counts(totals: DataFrame, starts: DataFrame, n: int = 4) -> DataFrame:
    """Each bucket with how many of ``starts`` (source_file, line) fall into it, none included.

    A line's bucket is worked out, so this is an equi-join of counts and no range join.
    """
    own = starts.join(totals, "source_file").where(F.col("line").between(1, F.col("total_lines")))
    part = F.expr(f"(line * {n} - 1) div total_lines").cast("int")
    counts = own.groupBy("source_file", part.alias("bucket")).agg(F.count("*").alias("selected"))
    return buckets(totals, n).join(counts, ["source_file", "bucket"], "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def chosen(metadata: DataFrame, selected: DataFrame, key: str = "row_id") -> DataFrame:
    """Metadata of the selected rows."""
    return metadata.join(selected.select(key), key, "left_semi")


def summary(metadata: DataFrame, high: float = rules.HIGH_SCORE) -> DataFrame:
    """rows, high-scored rows and critical rows: one row."""
    return metadata.agg(F.count("*").alias("total"), F.count_if(F.col("anomaly_score") > high).alias("high_anomaly"), F.count_if("iam_critical").alias("iam_critical"))


def top_rows(metadata: DataFrame, n: int) -> DataFrame:
    return metadata.orderBy(F.desc("anomaly_score"), "row_id").limit(n)
