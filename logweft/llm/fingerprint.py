"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Every five-word shingle is hashed once.  The top bits of a hash name its bin,
and a bin keeps its least hash: with the hashes sorted, that is the first of
each bin.  An empty bin takes the value of another, found by probing the bins
in a pseudo-random order of its own until one is filled; the order is the same
for every document, so like documents borrow alike.  It is a permutation
(``START + t * STEP``, odd steps), so a filled bin is always found, and how far
along a bin is can be told without probing.  Of each bin's value the
low ``BITS`` bits are kept.  Two fingerprints agree by chance in 1 of 2^BITS
bins, which the estimate corrects for.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from ..operators import gaps
from .common import let

BINS_LOG2, BITS, WORDS = 7, 8, 5
BINS = 1 << BINS_LOG2
#: For each bin where its probing starts and how it steps (odd), drawn once from a fixed seed.
_RNG = random.Random(20240229)
START, STEP = [_RNG.randrange(BINS) for _ in range(BINS)], [_RNG.randrange(BINS) | 1 for _ in range(BINS)]
#: So many probes are tried one by one; where all fail, the first filled bin along the order is worked out instead.
TRIED = 16


def words_of(text: Column) -> Column:
    """Words between blanks, A-Z and other letters lower-cased."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingle_hashes(words: Column) -> Column:
    """Sorted hashes of all runs of five words; fewer words are one shingle, none are none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WORDS))))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < WORDS, F.array(F.xxhash64(words))).otherwise(F.sort_array(runs))


def bin_of(h: Column) -> Column:
    return F.shiftright(h, 64 - BINS_LOG2) + BINS // 2


def densified(least: Column) -> Column:
    """From each filled bin's least hash to the low bits of all bins."""
    starts, steps, backs = (F.array(*map(F.lit, x)) for x in (START, STEP, [pow(a, -1, BINS) for a in STEP]))
    wrapped = lambda c: c.bitwiseAND(F.lit(BINS - 1))

    def filled(bins: Column) -> Column:
        def value(j: Column) -> Column:
            at = j.cast("int")
            probes = [F.try_element_at(bins, wrapped(F.get(starts, at) + t * F.get(steps, at)).cast("bigint")) for t in range(TRIED)]  # short-circuits at the first filled bin
            turn = lambda h: wrapped((bin_of(h) - F.get(starts, at)) * F.get(backs, at))
            first = F.array_min(F.transform(least, lambda h: F.struct(turn(h).alias("turn"), h.alias("h"))))["h"]
            return F.coalesce(F.try_element_at(bins, j), *probes, first)

        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), lambda j: value(j).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))

    return let(F.map_from_arrays(F.transform(least, bin_of), least), filled)


def bits(text: Column) -> Column:
    """The fingerprint as an array of BINS small integers; empty for a text without words."""
    def firsts(hashes: Column) -> Column:
        return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(F.get(hashes, i - 1)) != bin_of(h)))

    least = let(let(words_of(text), shingle_hashes), firsts)
    return let(least, lambda m: F.when(F.size(m) == 0, F.array().cast("array<int>")).otherwise(densified(m)))


def packed(b: Column) -> Column:
    """The fingerprint as hexadecimal digits, BITS / 4 for each bin."""
    return F.array_join(F.transform(b, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two texts without words are alike, one without is unlike the rest."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (hexadecimal) of every whole text; nulls as empty; other columns are not read."""
    return docs.select(F.col(id_col).alias("_id"), packed(bits(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("fingerprint")).withColumnRenamed("_id", id_col)


def ranges_of(rows: DataFrame, column: str, ranges: int) -> Column:
    """Which of about ``ranges`` ranges of a column of any ordered type a row is in, counted from 0; nulls are in -1.

    Numbers and times are cut at approximate quantiles, other types at the
    values of a random sample of some 20 for each range, which alone comes to the driver.
    """
    kind = rows.schema[column].dataType
    if isinstance(kind, (NumericType, TimestampType, TimestampNTZType, DateType)):
        place = gaps.place(rows.where(F.col(column).isNotNull()), column, ranges)
    else:
        n = rows.count()
        drawn = [r[0] for r in rows.where(F.col(column).isNotNull()).select(column).sample(min(1.0, 20 * ranges / max(n, 1)), 7).distinct().orderBy(column).collect()]
        cuts = F.array(*map(F.lit, [drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if drawn else [])).cast(ArrayType(kind))
        onward = lambda at, step: F.when((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= F.col(column)), at + step).otherwise(at)
        place = F.aggregate(F.array(*(F.lit(2**k) for k in range(ranges.bit_length(), -1, -1))), F.lit(0), onward)
    return F.when(F.col(column).isNull(), -1).otherwise(place)


def with_next(rows: DataFrame, id_col: str, carried: list[str], partitions: int) -> DataFrame:
    """``rows`` with next_<c> for each carried column: of the row with the next id, and after the last of the first.

    Rows are shuffled once by ranges of ids, and a window runs inside each
    range; the last row of a range takes the first of the next one, which is
    told by the ranges' numbers.  Nulls come first; rows with one id are
    ordered by the carried columns.
    """
    place = ranges_of(rows, id_col, 4 * partitions)
    ranged = rows.withColumn("_range", place).repartition(partitions, "_range")
    order = [F.asc_nulls_first(id_col), *(F.asc_nulls_first(c) for c in carried)]
    inside = Window.partitionBy("_range").orderBy(*order)
    held = F.struct(*carried)
    led = ranged.withColumns({"_next": F.lead(held).over(inside), "_first": F.row_number().over(inside) == 1})
    every = Window.orderBy("_range")  # the numbers of the ranges, no texts
    ring = rows.select(place.alias("_range")).distinct().select("_range", F.coalesce(F.lead("_range").over(every), F.first("_range").over(every)).alias("_after"))
    edges = led.where("_first").select(F.col("_range").alias("_after"), held.alias("_edge")).join(ring, "_after").select("_range", "_edge")
    joined = led.join(edges, "_range").withColumn("_next", F.coalesce("_next", "_edge"))
    return joined.select(*rows.columns, *(F.col("_next")[c].alias(f"next_{c}") for c in carried))


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has its last quarter (rounded down, code points) replaced
    by the first as many of the next document by ascending id; after the last
    comes the first, and a lone document is its own next.  Ids may be of any
    type that can be ordered; null ids come first, rows that share an id go by
    their texts, so repeated rows are each other's next.  Null texts are
    empty, and have the fingerprint of an empty text.  An empty table gives an
    empty one.  Other columns are not read, so they cannot clash.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("bits", bits(F.col("text")))
    near = with_next(rows, "id", ["text", "bits"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    done = edited.withColumn("edited_bits", bits(F.col("edited")))
    return done.select(F.col("id").alias(id_col), n.cast("long").alias("n_chars"), "edited", packed(F.col("bits")).alias("fingerprint"), packed(F.col("edited_bits")).alias("edited_fingerprint"), likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"))
