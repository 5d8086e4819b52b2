"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the 128-bit hash (MD5) of the line stripped of blanks and with
A-Z lower-cased.  The state is a set of runs, each a table bucketed and sorted
by key, with one row (key, n, last) for each key that it holds: in how many
documents the key was seen up to then, and the largest id among them.

A batch is brought down to one row for each of its keys and merged with the
runs, the newest first.  What no run has is new and enters with its own
counts; what a run has is brought up to date from there.  Both make one more
run of level 0, so the newest row of a key is the true one.  ``fanout`` runs
of a level are merged into one of the next: all rows of the newest run, and of
each older one those whose key no newer run has (anti-joins).  All runs have
the same buckets, so a batch is shuffled once and no run ever is.

Runs hold hashes and counts only; texts are shuffled once, at the end, to lose
their lines.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, let, removed, saved, work_dir

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 7, 3
RUN = "key binary, n long, last long"
#: So many keys of one text are looked through one by one.
FEW = 64


class LineRuns:
    """Levelled sorted runs: bucketed tables whose files are in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.home, self.name = work_dir(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.written}"
        self.paths[table] = f"{self.home}/level{level}-{self.written}"
        rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", self.paths[table]).saveAsTable(table)
        self.written += 1
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(table)

    def newest(self) -> list[str]:
        """All runs: a lower level is newer than a higher one, and within a level the last."""
        return [t for level in self.levels for t in reversed(level)]

    def add(self, batch: DataFrame) -> None:
        """Merge a batch of (key, n, last), one row for each key, with the runs, and write what comes of it as a run."""
        rows, found = batch, []
        for k, table in enumerate(self.newest()):
            run = self.spark.table(table).select("key", F.struct("n", "last").alias(f"_run{k}"))
            rows, found = rows.join(run, "key", "left"), [*found, f"_run{k}"]
        if found:
            known = F.coalesce(*found)  # the newest run's; null if no run has the key
            rows = rows.select("key", (F.col("n") + F.coalesce(known["n"], F.lit(0))).alias("n"), F.greatest("last", known["last"]).alias("last"))
        self._write(rows, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)

    def compact(self, level: int) -> None:
        """Merge a level's runs into one run of the next level."""
        tables, self.levels[level] = self.levels[level][::-1], []
        self._write(self._merged(tables), level + 1)
        for t in tables:
            self._drop(t)

    def _merged(self, tables: list[str]) -> DataFrame:
        """The newest row of each key of some runs, the newest run first.

        The parts have no key in common, so nothing is grouped here.
        """
        def unseen(k: int) -> DataFrame:
            return reduce(lambda rows, newer: rows.join(self.spark.table(newer).select("key"), "key", "left_anti"), tables[:k], self.spark.table(tables[k]))

        return reduce(DataFrame.unionByName, map(unseen, range(len(tables))))

    def totals(self) -> DataFrame:
        """One row per key over all batches."""
        tables = self.newest()
        return self._merged(tables) if tables else self.spark.createDataFrame([], RUN)

    def _drop(self, table: str) -> None:
        """Forgets a run and deletes its files, which an external table would leave."""
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        removed(self.spark, self.paths.pop(table))

    def close(self) -> None:
        """Forgets and deletes all runs; what was read from them must have been written before."""
        for t in self.newest():
            self._drop(t)
        removed(self.spark, self.home)
        self.levels = []


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def keys_of(lines: Column, min_chars: int) -> Column:
    """For each line its key in hexadecimal digits, or null if the key is too short."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(bare, lambda x: F.when(F.length(x) >= min_chars, F.md5(ascii_lower(x).cast("binary"))))


def repeated_keys(docs: DataFrame, *, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> tuple[DataFrame, DataFrame, int]:
    """(id, key) of all long lines, each key once for a row; (key, n, last) of those in ``min_docs`` rows or more; rows of the first."""
    spark = docs.sparkSession
    key = F.explode(F.array_distinct(F.filter(keys_of(split_lines(F.col(text_col)), min_chars), lambda k: k.isNotNull())))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key")).select("id", F.unhex("key").alias("key"), F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))
    pairs_at = work_dir(spark, "line-keys")
    rows.write.partitionBy("batch").parquet(pairs_at)  # a batch reads its own files only
    pairs = spark.read.schema("id long, key binary, batch int").parquet(pairs_at)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(pairs.where(F.col("batch") == b).groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")))
    often = saved(runs.totals().where(F.col("n") >= min_docs), "line-repeated")
    runs.close()
    return pairs.select("id", "key"), often, pairs.count()


def dropped(pairs: DataFrame, often: DataFrame, total: int) -> DataFrame:
    """(id, keys): for each document the keys that it loses, in hexadecimal digits.

    A key in more than a 2000th of the rows is broadcast (there are under 2000
    such keys, whatever the data); the others meet in a join none of whose
    keys is frequent.
    """
    hot = total // 2000 + 1
    lost = [pairs.join(side(often), "key").where(F.col("last") != F.col("id")).select("id", "key") for side in (lambda o: F.broadcast(o.where(F.col("n") > hot)), lambda o: o.where(F.col("n") <= hot))]
    return reduce(DataFrame.unionByName, lost).groupBy("id").agg(F.collect_set(F.lower(F.hex("key"))).alias("keys"))


def without(lines: Column, keys: Column) -> Column:
    """``lines`` (line, key) whose key is null or not among ``keys``.

    Many keys are dealt by their first two digits, so that a long text of
    repeated lines takes a 256th of the comparisons.
    """
    few = F.filter(lines, lambda z: z["key"].isNull() | ~F.array_contains(keys, z["key"]))
    head = lambda k: F.conv(F.substring(k, 1, 2), 16, 10).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda d: F.filter(keys, lambda k: head(k) == d))
    many = let(dealt, lambda b: F.filter(lines, lambda z: z["key"].isNull() | ~F.array_contains(F.get(b, head(z["key"])), z["key"])))
    return F.when(F.size(keys) <= FEW, few).otherwise(many)


def cut(docs: DataFrame, *, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(row, text, lines, gone): each row of ``docs`` as a struct without its text, the text that stays, and how many lines it had and lost."""
    pairs, often, total = repeated_keys(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs, batches=batches, fanout=fanout)
    lost = dropped(pairs, often, total).select(F.col("id").alias("lost_id"), "keys")
    held = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(True).alias("_"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col)).alias("row"))
    joined = held.join(lost, F.col("id") == F.col("lost_id"), "left")
    lines = split_lines(F.col("text"))
    both = F.arrays_zip(lines.alias("line"), keys_of(lines, min_chars).alias("key"))
    kept = F.transform(without(both, F.col("keys")), lambda z: z["line"])
    done = joined.select("row", "text", F.when(F.col("keys").isNotNull(), kept).alias("kept"), F.size(lines).cast("long").alias("lines"))
    gone = F.coalesce(F.when(F.col("kept").isNotNull(), F.col("lines") - F.size("kept")), F.lit(0)).cast("long")
    return done.select("row", F.coalesce(F.array_join("kept", "\n"), F.col("text")).alias("text"), "lines", gone.alias("gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, rows and columns as they were, without the repeated lines of its texts.

    A key of ``min_chars`` code points or more that is in ``min_docs`` rows or
    more loses all its lines except in the rows with the largest id that holds
    it.  Ids are whole numbers (anything that casts to one).  Rows with one id
    count as a document each.  A row with a null id counts too but loses
    nothing; a null text is one empty line and stays null.  Extra columns are
    carried in a struct, so no name of theirs can clash.
    """
    done = cut(docs, id_col=id_col, text_col=text_col, **options)
    return done.select(*((F.col("text") if c == text_col else F.col("row")[f"c{k}"]).alias(c) for k, c in enumerate(docs.columns)))


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col``, n_lines (before), n_dropped, kept_text; rules as in ``dedup_lines``, a null text becomes empty."""
    done = cut(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    return done.select(F.col("row")["c0"].alias(id_col), F.col("lines").alias("n_lines"), F.col("gone").alias("n_dropped"), F.coalesce(F.col("text"), F.lit("")).alias("kept_text"))
