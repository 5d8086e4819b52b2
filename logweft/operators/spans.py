"""Request spans: each thread's lines from an entry mark to the next exit mark, by a segmented scan.

Per file and thread, in line order, a running count of starts numbers the
spans, and a line is inside a request while no end has come before it in its
span.  All remaining lines are single events, kept where they signal something.

A thread's lines are taken in blocks of line numbers.  What a block does to
those after it is small and composes: how many starts it has, and whether it
leaves a request open, closed or as it was.  So blocks are scanned apart, their
summaries are added up in order, and each block finishes with what it inherits:
a file of one thread is dealt over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extract, parse, rules
from ..functions.signals import RetrievalSignals
from .gaps import numbered

#: Line numbers in a block.
BLOCK = 50_000


def _blocks(order: str, block: int | None) -> Column:
    return F.floor(F.col(order) / (block or BLOCK))


def number_spans(rows: DataFrame, keys: list[str], order: str, is_start: Column, is_end: Column, block: int | None = None) -> DataFrame:
    """``rows`` (keys without nulls) with _start, _end, span_no (0: before any start) and in_request."""
    cut = [*keys, "_block"]
    out = rows.withColumns({"_block": _blocks(order, block), "_start": is_start.cast("int"), "_end": is_end.cast("int")})
    out = out.withColumn("_mark", F.when(F.col("_end") == 1, False).when(F.col("_start") == 1, True))  # whether a request is open after the line
    by = Window.partitionBy(*cut).orderBy(order)
    inside = out.withColumns({"_n": F.sum("_start").over(by.rowsBetween(Window.unboundedPreceding, 0)), "_open": F.last("_mark", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))})
    left = out.groupBy(*cut).agg(F.sum("_start").alias("_starts"), F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(order))).alias("_leaves"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    inherited = left.select(*cut, F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_before"), F.last("_leaves", ignorenulls=True).over(earlier).alias("_came"))
    joined = inside.join(inherited, cut)
    is_open = (F.col("_start") == 1) | F.coalesce("_open", "_came", F.lit(False))
    return joined.select(*rows.columns, "_start", "_end", (F.col("_n") + F.col("_before")).alias("span_no"), is_open.alias("in_request"))


def compact_ranges(numbers: Column, most: int = 8) -> Column:
    """An array of line numbers from 1 as 1-3, 5-6 and so on, at most ``most`` ranges and how many more.

    A range starts where the number before is missing and ends where the next
    one is, so starts and ends pair off: linear in the numbers.
    """
    def ranges(n: Column) -> Column:
        starts = F.filter(n, lambda x, i: (i == 0) | (F.get(n, i - 1) != x - 1))
        ends = F.filter(n, lambda x, i: (i == F.size(n) - 1) | (F.get(n, i + 1) != x + 1))
        return F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))

    sorted_ = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0))).cast("array<bigint>")
    shown = F.transform(F.array(F.get(F.transform(F.array(sorted_), ranges), F.lit(0))), lambda r: F.concat(F.array_join(F.slice(r, 1, most), ", "), F.when(F.size(r) > most, F.concat(F.lit(", ... +"), (F.size(r) - most).cast("string"), F.lit(" ranges"))).otherwise("")))
    return F.get(shown, F.lit(0))


def islands(rows: DataFrame, keys: list[str], number: str, block: int | None = None) -> DataFrame:
    """(keys, start_line, end_line) of each run of consecutive numbers (keys without nulls).

    Runs are found inside blocks of numbers; only a block's first and last run
    can go on in a neighbour, and those are put together in a second step.
    """
    size = block or BLOCK
    cut = [*keys, "_block"]
    one = rows.select(*keys, number, _blocks(number, block).alias("_block")).distinct().withColumn("_run", F.col(number) - F.row_number().over(Window.partitionBy(*cut).orderBy(number)))
    runs = one.groupBy(*cut, "_run").agg(F.min(number).alias("start_line"), F.max(number).alias("end_line"))
    edge = (F.col("start_line") % size == 0) | (F.col("end_line") % size == size - 1)
    by = Window.partitionBy(*keys).orderBy("start_line")  # two rows for each block
    ends = runs.where(edge).withColumn("_new", F.when(F.lag("end_line").over(by) == F.col("start_line") - 1, 0).otherwise(1)).withColumn("_place", F.sum("_new").over(by))
    whole = ends.groupBy(*keys, "_place").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_place")
    return runs.where(~edge).select(*keys, "start_line", "end_line").unionByName(whole)


def range_texts(ranges: DataFrame, keys: list[str], name: str, most: int = 8) -> DataFrame:
    """(keys, ``name``) for a table of ``islands``: the first ``most`` of each key as text, and how many more.

    The first of a key are kept by a bounded rank, and the rest are only counted.
    """
    first = ranges.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("start_line"))).where(F.col("_k") <= most)
    text = F.when(F.col("start_line") == F.col("end_line"), F.col("start_line").cast("string")).otherwise(F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")))
    shown = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", text.alias("t")))), lambda x: x["t"]), ", ").alias("_shown"))
    more = F.col("_n") - most
    counted = ranges.groupBy(*keys).agg(F.count("*").alias("_n"))
    return shown.join(counted, keys).select(*keys, F.when(more > 0, F.concat("_shown", F.lit(", ... +"), more.cast("string"), F.lit(" ranges"))).otherwise(F.col("_shown")).alias(name))


def error_lines(lines: Column, s: RetrievalSignals) -> Column:
    """Numbers of the lines with a severity; where there are none, of the error-bearing ones."""
    severe = F.filter(lines, lambda x: _any(x["clean"], rules.SEVERITIES))
    bearing = F.filter(lines, lambda x: _any(x["clean"], s.error_keywords) & ~x["clean"].rlike(rules.STACK_FRAME))
    chosen = F.when(F.size(severe) > 0, severe).otherwise(bearing)
    return F.transform(chosen, lambda x: x["line_no"])


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def iso(t: Column) -> Column:
    """ISO text, with microseconds only if there are any; empty for null."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.when(F.date_trunc("second", t) == t, whole).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit(""))


def request_documents(parsed: DataFrame, signals: RetrievalSignals, label: Column | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist, block: int | None = None) -> DataFrame:
    """Requests and single events of parsed lines (source_path, source_file, line_no, ts, thread, clean), scored and ordered.

    Lines outside a query's window are filtered before.  rank follows score
    (highest first), start time as text, then the order in which requests end;
    ties go to the earlier line.  Documents are put together once; both orders
    (identifiers within a file, ranks over all) are worked out on keys and
    scores, and met again on file and first line.  ``keep`` holds the documents
    and the numbered keys.
    """
    thread = F.coalesce(F.nullif(F.col("thread"), F.lit("")), F.lit("no_thread"))
    rows = parsed.select("source_path", "source_file", "line_no", "ts", "clean", thread.alias("primary_key"), (label if label is not None else F.lit(None).cast("string")).alias("_label"))
    starts, ends = extract.has_marker(F.col("clean"), signals.start_markers), extract.has_marker(F.col("clean"), signals.end_markers)
    rows = number_spans(rows, ["source_path", "primary_key"], "line_no", starts, ends, block)
    words = [*signals.iam_keywords, *signals.error_keywords]
    loud = parse.any_contains(F.col("clean"), words)  # cheap, and necessary for what follows
    kept = rows.where(F.col("in_request") | (F.col("_end") == 1) | (loud & extract.told(F.col("clean"), words)))
    # A request that no exit ends is let go at the thread's next entry: each entry tells its line to the span before.
    kept = kept.withColumn("_tells", F.explode(F.when((F.col("_start") == 1) & (F.col("span_no") > 1), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    own = lambda c: F.when(~F.col("_tells"), c)
    unit = F.when(F.col("in_request"), F.concat(F.lit("r"), F.col("span_no") - F.col("_tells").cast("int"))).otherwise(F.concat(F.lit("e"), F.col("line_no")))
    grouped = kept.groupBy("source_path", "source_file", "primary_key", "in_request", unit.alias("_unit")).agg(
        F.array_sort(F.collect_list(own(F.struct("line_no", "clean")))).alias("_lines"), F.max(own(F.col("_end"))).alias("_matched"), F.min(own(F.col("ts"))).alias("_t0"), F.max(own(F.col("ts"))).alias("_t1"),
        F.min(own(F.col("line_no"))).alias("start_line"), F.max(own(F.col("line_no"))).alias("end_line"), F.count(own(F.lit(1))).alias("line_count"), F.array_sort(F.collect_set(own(F.col("_label")))).alias("_labels"),
        F.min(F.when(F.col("_tells"), F.col("line_no"))).alias("_next"))
    text = grouped.withColumn("content", F.array_join(F.transform("_lines", lambda x: x["clean"]), "\n"))
    c = F.col("content")
    # What words are looked for in is a column of its own before they are, so it is worked out once for a document.
    told = text.withColumns({"_told": extract.diagnostic_text(c), "_edge": extract.has_marker(c, [*signals.start_markers, *signals.end_markers])})
    edge = F.col("_edge")
    flagged = told.withColumns({"iam_critical": parse.any_contains(F.col("_told"), signals.iam_keywords), "has_error_signal": parse.any_contains(F.col("_told"), signals.error_keywords)})
    flagged = flagged.withColumn("anomaly_score", extract.anomaly_score(c, signals, F.col("iam_critical"), F.col("has_error_signal"), edge))
    done = flagged.select(
        "content", "source_file", "source_path", "primary_key", F.when(F.col("in_request"), "api_request").otherwise("api_signal_event").alias("key_type"), F.when(F.col("in_request"), "request").otherwise("line").alias("chunk_level"),
        (F.col("in_request") & (F.col("_matched") == 0)).alias("unmatched_exit"), iso(F.col("_t0")).alias("start_time"), iso(F.col("_t1")).alias("end_time"), F.col("line_count").cast("int"), "start_line", "end_line",
        compact_ranges(F.transform("_lines", lambda x: x["line_no"])).alias("line_ranges"), compact_ranges(error_lines(F.col("_lines"), signals)).alias("error_line_ranges"),
        F.array_join("_labels", ";").alias("session_labels"), F.size("_labels").alias("session_label_count"), (F.col("iam_critical") | F.col("has_error_signal") | edge).alias("signal_candidate"), "iam_critical", "has_error_signal", "anomaly_score", F.lit(0.0).alias("raw_distance"),
        F.when(F.col("in_request") & (F.col("_matched") == 0), F.col("_next")).otherwise(F.col("end_line")).alias("flush_line"))
    done = keep(done)
    # A line is in one unit, so file and first line name a document, and both orders are total.
    ends_at = F.asc_nulls_last("flush_line")
    slim = done.select("source_path", "start_line", "primary_key", "key_type", "flush_line", "anomaly_score", "start_time")
    in_file = numbered(slim, [ends_at, F.asc("start_line")], "_count", keep, ("source_path", "key_type"))
    ranked = numbered(in_file, [F.desc("anomaly_score"), F.asc("start_time"), F.asc("source_path"), ends_at, F.asc("start_line")], "row_id", keep)
    count = F.col("_count").cast("string")
    names = F.when(F.col("key_type") == "api_request", F.concat("primary_key", F.lit("_req_"), count)).otherwise(F.concat(F.lit("event_"), count))
    return done.join(ranked.select("source_path", "start_line", names.alias("request_span_id"), "row_id"), ["source_path", "start_line"]).select(*done.columns, "request_span_id", "row_id")


def request_health(parsed: DataFrame, signals: RetrievalSignals) -> DataFrame:
    """Requests matched, entries and exits without a partner, and the error rate: one row.

    Per thread an exit takes an open entry if there is one.  The running sum of
    entries less exits shows by its lowest point how many exits had none.
    """
    thread = F.coalesce(F.nullif(F.col("thread"), F.lit("")), F.lit("__no_thread__"))
    clean = F.col("clean")
    rows = parsed.select("source_path", "line_no", thread.alias("_t"), extract.has_marker(clean, signals.start_markers).cast("int").alias("_s"), extract.has_marker(clean, signals.end_markers).cast("int").alias("_e")).where("_s + _e > 0")
    return health(rows, ["source_path", "_t"], "line_no", "_s", "_e")


def health(rows: DataFrame, keys: list[str], order: str, start: str, end: str, block: int | None = None) -> DataFrame:
    """Counts over ``rows`` (keys without nulls).  Of a block of lines, what counts is its sum of entries less exits and the lowest point on the way: sums add up, lowest points by the sum before them."""
    cut = [*keys, "_block"]
    step = F.col(start) - F.col(end)
    out = rows.withColumn("_block", _blocks(order, block))
    run = out.withColumn("_run", F.sum(step).over(Window.partitionBy(*cut).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    blocks = run.groupBy(*cut).agg(F.sum(start).alias("_entries"), F.sum(end).alias("_exits"), F.min("_run").alias("_low"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    low = F.col("_low") + F.coalesce(F.sum(F.col("_entries") - F.col("_exits")).over(earlier), F.lit(0))
    per = blocks.withColumn("_low", low).groupBy(*keys).agg(F.sum("_entries").alias("entries"), F.sum("_exits").alias("exits"), F.greatest(F.lit(0), -F.min("_low")).alias("ue"))
    one = per.agg(F.coalesce(F.sum(F.col("exits") - F.col("ue")), F.lit(0)).alias("matched_requests"), F.coalesce(F.sum(F.col("entries") - (F.col("exits") - F.col("ue"))), F.lit(0)).alias("unmatched_entries"), F.coalesce(F.sum("ue"), F.lit(0)).alias("unmatched_exits"))
    total = F.col("matched_requests") + F.col("unmatched_entries") + F.col("unmatched_exits")
    return one.withColumn("error_rate", F.when(total > 0, (F.col("unmatched_entries") + F.col("unmatched_exits")) / total).otherwise(0.0))
