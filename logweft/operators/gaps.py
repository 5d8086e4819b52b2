"""Orders over whole tables without one task that sees all rows: ranges of values, the row before, dense numbers, exact quantiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

#: Values that selection takes to the driver once a range holds no more.
FEW = 10_000
#: Ranges that selection cuts a range into.
RANGES = 64


def lagged(rows: DataFrame, at: str, carry: list[str], partitions: int | None = None, range_: Column | None = None) -> DataFrame:
    """``rows`` with prev_<c> of the carried columns, as LAG over a global order of ``at`` (nulls last) gives them.

    Values are cut into ranges at approximate quantiles (exactness is not
    needed of them); LAG runs inside each range, and the first row of a range
    takes the last of the ranges before, from a table with one row for each
    range.  Where ``at`` repeats, rows carry what is equal among them.
    ``range_`` gives the ranges where a cheaper frame has been cut already.
    """
    ranged = rows.withColumn("_range", place(rows, at, partitions) if range_ is None else range_)
    held, inside = F.struct(*carry), Window.partitionBy("_range").orderBy(F.asc_nulls_last(at))
    led = ranged.withColumns({"_prev": F.lag(held).over(inside), "_first": F.row_number().over(inside) == 1})
    last = ranged.groupBy("_range").agg(F.max_by(held, at).alias("_last"))
    edge = last.select(F.col("_range").alias("_of"), F.lag("_last").over(Window.orderBy("_range")).alias("_edge"))  # one row for each range
    joined = led.join(F.broadcast(edge), F.col("_range") == F.col("_of"))
    before = F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_prev"))
    return joined.select(*rows.columns, *(before[c].alias(f"prev_{c}") for c in carry))


def number_of(rows: DataFrame, at: str) -> Column:
    """A column that can be ordered as a number: times in microseconds, dates in days."""
    kind = rows.schema[at].dataType
    if isinstance(kind, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{at}`)")
    return F.unix_micros(at) if isinstance(kind, TimestampType) else F.unix_date(at) if isinstance(kind, DateType) else F.col(at)


def place(rows: DataFrame, at: str, partitions: int | None = None) -> Column:
    """Which of ``partitions`` ranges of about as many rows each a row's ``at`` (a time or a number) is in; nulls are in the last.

    The cuts are quantiles that are off by a tenth of a range at most.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = number_of(rows, at)
    shares = F.expr(f"cast(split('{','.join(str(i / n) for i in range(1, n))}', ',') as array<double>)")
    cuts = rows.select(F.percentile_approx(value, shares, max(10_000, 10 * n))).first()[0] if n > 1 else []
    return range_of(value, sorted(set(cuts or [])))


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are at or below the value; all for null.

    A binary search over one array of constants: the expression is as large for
    20,000 cuts as for two.
    """
    if not cuts:
        return F.lit(0)
    kind = "bigint" if isinstance(cuts[0], int) else "double"
    table = F.expr(f"cast(split('{','.join(map(str, cuts))}', ',') as array<{kind}>)")  # folded to one constant
    steps = F.expr(f"cast(split('{','.join(str(2**k) for k in range(len(cuts).bit_length() - 1, -1, -1))}', ',') as array<int>)")
    onward = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) <= value), at + step).otherwise(at)
    return F.when(value.isNull(), len(cuts)).otherwise(F.aggregate(steps, F.lit(0), onward))


def with_previous(rows: DataFrame, at: str, out: str = "prev_ts", partitions: int | None = None) -> DataFrame:
    """``rows`` (``at`` not null) with the value of ``at`` in the row before."""
    return lagged(rows, at, [at], partitions).withColumnRenamed(f"prev_{at}", out)


def numbered(rows: DataFrame, order: list[Column], name: str, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist, within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with a dense number from 0 along a total order, for each ``within`` (columns without nulls) on its own.

    Rows are range-partitioned by (``within``, the order), so one large group
    spans many tasks; each partition counts its groups, and only these counts
    meet.  Counting and numbering must see the same partitions, so the frame
    is kept; whoever passes ``keep`` lets it go.
    """
    by = [*map(F.col, within), *order]
    parts = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    parts = keep(parts)
    sizes = parts.groupBy(*within, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*within, "_part", "_first", base.alias("_base"))
    joined = parts.join(starts if within else F.broadcast(starts), [*within, "_part"])  # a row for each partition, if there are no groups
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_base")).alias(name))


def total_before(rows: DataFrame, at: str, size: str, out: str) -> DataFrame:
    """``rows`` (``at`` unique and not null) with the sum of ``size`` over all rows before it: sums inside ranges, and a row for each range for what comes before."""
    ranged = rows.withColumn("_range", place(rows, at))
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("_sum"))
    upto = Window.unboundedPreceding, -1
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(*upto)), F.lit(0)).alias("_base"))  # one row for each range
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_range").orderBy(at).rowsBetween(*upto)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(base), "_range").select(*rows.columns, (F.col("_inside") + F.col("_base")).alias(out))


def quantiles(rows: DataFrame, columns: list[str], at: float = 0.5) -> dict[str, float | None]:
    """Exact continuous quantiles of some numeric columns, as PERCENTILE_CONT gives them; None where a column has no value.

    Distributed selection: approximate quantiles cut a range into ranges, their
    rows are counted, and only the range that holds the wanted rank is looked
    at again.  Each round keeps about one row in 64, whatever the values'
    distribution; a cut that is very frequent is a range of its own, and what
    comes to the driver are counts and, at the end, ``FEW`` values.
    """
    counts = rows.agg(*(F.count(c).alias(c) for c in columns)).first()
    wanted = {(c, k): None for c in columns if counts[c] for k in {int((counts[c] - 1) * at), min(int((counts[c] - 1) * at) + 1, counts[c] - 1)}}
    # Where each rank is sought: the open interval, how many values are in it, and the rank among them.
    sought = {t: (None, None, counts[t[0]], t[1]) for t in wanted}
    while sought:
        places = {(c, lo, hi): n for (c, _), (lo, hi, n, _) in sought.items()}
        small = [p for p, n in places.items() if n <= FEW]
        large = [p for p, n in places.items() if n > FEW]
        held: dict[tuple, list[float]] = {p: [] for p in small}
        if small:
            for p, v in _values(rows, small).collect():
                held[small[p]].append(v)
        split = _split(rows, large) if large else {}
        for t, (lo, hi, _, rank) in list(sought.items()):
            p = (t[0], lo, hi)
            if p in held:
                wanted[t] = sorted(held[p])[rank]
                del sought[t]
                continue
            for a, b, n in split[p]:
                if rank < n:
                    break
                rank -= n
            if a == b:
                wanted[t] = a
                del sought[t]
            else:
                sought[t] = (lo if a is None else a, hi if b is None else b, n, rank)
    out: dict[str, float | None] = {}
    for c in columns:
        if not counts[c]:
            out[c] = None
            continue
        k = (counts[c] - 1) * at
        low, high = wanted[c, int(k)], wanted[c, min(int(k) + 1, counts[c] - 1)]
        out[c] = low + (high - low) * (k - int(k))
    return out


def _within(place: tuple) -> Column:
    column, low, high = place
    v = F.col(column)
    return v.isNotNull() & (F.lit(True) if low is None else v > low) & (F.lit(True) if high is None else v < high)


def _values(rows: DataFrame, places: list[tuple]) -> DataFrame:
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("p"), F.when(_within(p), F.col(p[0]).cast("double")).alias("v")) for k, p in enumerate(places))), lambda x: x["v"].isNotNull())
    return rows.select(F.explode(found).alias("x")).select("x.p", "x.v")


def _split(rows: DataFrame, places: list[tuple]) -> dict[tuple, list[tuple[float | None, float | None, int]]]:
    """For each open interval its ranges in order: (a, b, count), a = b for the cuts themselves, None for the interval's own ends."""
    shares = [i / RANGES for i in range(1, RANGES)]
    sketches = rows.agg(*(F.percentile_approx(F.when(_within(p), F.col(p[0]).cast("double")), shares, 10_000).alias(f"c{k}") for k, p in enumerate(places))).first()
    cuts = [sorted(set(sketches[k])) for k in range(len(places))]
    slot = lambda v, c: range_of(v, c) * 2 - F.when(F.array_contains(F.array(*map(F.lit, c)), v), 1).otherwise(0)  # noqa: E731  odd: a cut itself
    found = _values(rows, places)
    cases = F.when(F.col("p") == 0, slot(F.col("v"), cuts[0]))
    for k in range(1, len(places)):
        cases = cases.when(F.col("p") == k, slot(F.col("v"), cuts[k]))
    counted = {(r.p, r.s): r.n for r in found.groupBy("p", cases.alias("s")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for k, p in enumerate(places):
        ends = [None, *cuts[k], None]
        out[p] = [((ends[s // 2], ends[s // 2 + 1]) if s % 2 == 0 else (ends[s // 2 + 1],) * 2) + (counted.get((k, s), 0),) for s in range(2 * len(cuts[k]) + 1)]
    return out


def seconds(a: str, b: str) -> Column:
    """Seconds from column ``a`` to column ``b``, fractions included."""
    return F.expr(f"timestampdiff(MICROSECOND, {a}, {b}) / 1e6D")


def minute(at: Column, unit: str = "minute") -> Column:
    return F.date_trunc(unit, at).cast("timestamp_ntz")
