"""What the text operators share: a shared work folder and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WordHashes(dict):
    """64-bit hashes of words, kept while a worker meets them again; bounded in entries and in their length, with no effect on results."""

    MOST, LONGEST = 250_000, 64

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = got
        return got


#: One table for all operators of a worker.
HASHES = WordHashes()


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the cluster's shared folder, which is ``spark.checkpoint.dir``.

    Where that setting is absent and Spark runs in this one process (tests, a
    laptop), a temporary folder serves; on a cluster its absence is an error,
    as executors cannot see the driver's own folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="logweft-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here.

    The files are in storage that every executor sees, so losing executors
    costs a reread and no recomputation.
    """
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``lower`` also changes other letters, so it serves only texts that are
    all ASCII (as many bytes as characters); it is the much faster of the two.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def numbered(rows: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """``rows``, written in the order of (``group``, ``order``), with ``_row``, an id that ascends in this order.

    Rows are cut into ranges, so a group with most of the rows spans many
    tasks; ``places`` counts inside groups.  What compares equal in all of
    ``order`` gets its ids in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    return saved(cut.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), what)


def places(rows: DataFrame, group: str) -> DataFrame:
    """Rows of ``numbered`` (any of its columns, ``_part`` and ``_row`` among them) with ``place``, their number in the group from 0, and ``of``, the size of the group.

    The only table joined has a row for each group and each range that the
    group is in, so a large group is counted range by range.
    """
    parts = rows.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    inside = Window.partitionBy(group)
    earlier = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(inside).alias("of"))
    kept = [c for c in rows.columns if c not in ("_part", "place", "of")]
    return rows.join(parts, [group, "_part"]).select(*kept, (F.col("_row") - F.col("_first") + F.col("_before")).alias("place"), "of")


def group_key(value: Column) -> Column:
    """A value of any simple type as a text that is never null and sorts null first, then as the value's own text does, bytewise."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, block: int = 256) -> Column:
    """The running sums of an array of numbers, each with all before it.

    Blocks are summed apart and then moved on by what comes before them: what
    is copied on the way grows with the block and with the number of blocks,
    not with the square of the numbers, and the expression is a small one.
    """
    empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("sums"))
    first = F.sequence(F.lit(0), F.size(numbers) - 1, F.lit(block))  # of each block
    blocks = F.transform(first, lambda i: F.aggregate(F.slice(numbers, i + 1, F.lit(block)), empty, lambda a, x: F.struct((a["n"] + x).alias("n"), F.array_append(a["sums"], a["n"] + x).alias("sums"))))
    moved = F.aggregate(blocks, empty, lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.concat(a["sums"], F.transform(b["sums"], lambda x: x + a["n"])).alias("sums")))
    return F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(moved["sums"])
