"""Selection of evidence: seeds, their neighbours, a ranked and deduplicated block within a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extract, rules
from ..functions.parse import any_contains, unicode
from .gaps import total_before
from .references import line_reference_column


def seeds(docs: DataFrame, top: int = rules.EVIDENCE_SEEDS) -> DataFrame:
    """``docs`` with is_seed: the best by candidate, critical, error, score; ties to the smaller row_id."""
    best = docs.orderBy(F.desc("signal_candidate"), F.desc("iam_critical"), F.desc("has_error_signal"), F.desc("anomaly_score"), "row_id").limit(top).select(F.col("row_id").alias("_seed"))
    return docs.join(F.broadcast(best), F.col("row_id") == F.col("_seed"), "left").withColumn("is_seed", F.col("_seed").isNotNull()).drop("_seed")  # ``top`` rows


def neighbours(docs: DataFrame, keys: list[str], order: str, flag: str, radius: int = rules.EVIDENCE_RADIUS) -> DataFrame:
    """``docs`` with near: a flagged row within ``radius`` places in its group's order."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    return docs.withColumn("near", F.max(F.col(flag).cast("int")).over(frame) == 1)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")


def budget_prefix(rows: DataFrame, order: str, size: str, cap: int) -> DataFrame:
    """Rows along ``order`` until their sizes first exceed the cap; bounded inputs only, as it is one ordered run."""
    run = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.col(size).cast("bigint")).over(run)).where(F.col("used") <= cap)


RANKED_BY = ["signal_candidate", "iam_critical", "has_error_signal", "anomaly_score"]


def ranked(docs: DataFrame, top: int, radius: int, most: int) -> DataFrame:
    """At most ``most`` documents, seeds and neighbours, with is_seed and their rank from 0.

    Seeds and neighbours are found on keys and scores alone; contents are
    looked up for the few that are chosen.
    """
    slim = docs.select("row_id", "source_file", "primary_key", *RANKED_BY)
    order = [F.desc("is_seed"), *map(F.desc, RANKED_BY), F.asc("row_id")]
    near = neighbours(seeds(slim, top), ["source_file", "primary_key"], "row_id", "is_seed", radius).where("near").orderBy(*order).limit(most)
    best = near.select("row_id", "is_seed", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint").alias("rank"))  # ``most`` rows
    return docs.join(F.broadcast(best), "row_id")


@dataclass
class Evidence:
    text: str
    row_ids: list[int]
    references: list[dict]


def has_mark(text: Column) -> Column:
    return any_contains(text, rules.ERROR_MARKS)


def first_error_line(text: Column) -> Column:
    """The first line with an error mark, blanks made one and lower-cased; null if there is none or nothing is left of it."""
    line = F.get(F.filter(F.split(text, "\n"), has_mark), F.lit(0))
    return F.nullif(F.lower(F.trim(F.regexp_replace(line, unicode(r"\s+"), " "))), F.lit(""))


def select_evidence(docs: DataFrame, *, top: int = rules.EVIDENCE_SEEDS, radius: int = rules.EVIDENCE_RADIUS, most: int = rules.EVIDENCE_MAX, max_chars: int = rules.EVIDENCE_CHARS, requests: bool = True) -> DataFrame:
    """rank, row_id, ref_id, block, used of the chosen documents, in rank order.

    Of error documents with the same first error line only the first is shown;
    the others use up a rank but no budget.  Other documents are never
    repeats.  The first block that does not fit ends the evidence.
    """
    ranked_docs = ranked(docs, top, radius, most)
    cut = lambda n: F.when(F.length("content") > n, F.concat(F.substring("content", 1, n), F.lit(rules.TRUNCATED))).otherwise(F.col("content"))
    rows = ranked_docs.withColumn("_error", has_mark(F.col("content"))).withColumn("_shown", F.when(F.col("_error"), cut(rules.ERROR_CHARS)).otherwise(cut(rules.BENIGN_CHARS)))
    rows = rows.withColumns({"ref_id": F.concat_ws("_", F.lit("REF"), "source_file", "primary_key", F.col("rank").cast("string")), "line_ref": line_reference_column()})
    source = F.when(~F.col("is_seed"), "neighbour").when(F.col("signal_candidate"), "ranked:signal").otherwise("ranked:fallback")
    request = F.lit(requests) & F.col("key_type").isin("api_request", "api_signal_event")
    key = F.when(F.col("key_type") == "api_signal_event", "error_line").otherwise(F.col("primary_key"))
    tag = lambda name, c: F.concat(F.lit(f"[{name}="), c, F.lit("] "))
    head = F.concat(
        F.when(request, "--- Request ").otherwise("--- Chunk "), tag("score", F.format_string("%.2f", "anomaly_score")), F.concat(F.lit("["), "ref_id", F.lit("] ")), tag("source", source), tag("file", F.col("source_file")),
        F.when(request, F.concat(tag("request_key", key), F.lit("[type=api_request] "))).otherwise(tag("key", F.col("primary_key"))), F.concat(F.lit("["), "line_ref", F.lit("] [")), F.coalesce("start_time", F.lit("")), F.lit(" -> "), F.coalesce("end_time", F.lit("")),
        F.lit("] ---\nChunk Reference: ["), "ref_id", F.lit("]\nOriginal Log Reference: "), "source_file", F.lit(", "), "line_ref", F.lit("\n"))
    rows = rows.withColumn("block", F.concat(head, extract.decode_urls(F.col("_shown"))))
    # A document that repeats none is a class of its own.
    rows = rows.withColumn("_same", F.coalesce(F.concat(F.lit("e"), F.when(F.col("_error"), first_error_line(F.col("_shown")))), F.concat(F.lit("r"), F.col("rank").cast("string"))))
    kept = budget_prefix(first_seen(rows, "_same", "rank").withColumn("_size", F.length("block")), "rank", "_size", max_chars)
    return kept.select("rank", "row_id", "ref_id", "block", "used", "source_file", "source_path", "start_line", "end_line", "line_ranges", "error_line_ranges", "line_ref").orderBy("rank")


def collected(selected: DataFrame) -> Evidence:
    """The block's text, row ids and references; bounded by the budget."""
    rows = selected.collect()
    names = ("ref_id", "source_file", "source_path", "start_line", "end_line", "line_ranges", "error_line_ranges", "line_ref")
    return Evidence("\n\n".join(r.block for r in rows), [r.row_id for r in rows], [{n: r[n] for n in names} for r in rows])


def metadata_rows(docs: DataFrame) -> DataFrame:
    """Document metadata under the names that follow-ups use."""
    event = F.col("key_type") == "api_signal_event"
    renamed = docs.withColumn("request_key", F.when(event, "error_line").otherwise(F.col("primary_key"))).withColumn("request_level", F.col("chunk_level"))
    return renamed.drop("content", "primary_key", "chunk_level")


def report(findings: DataFrame, *, file_cap: int = rules.REDUCE_FILE_CHARS, cap: int = rules.REDUCE_CHARS) -> DataFrame:
    """(position, text) of per-file findings (position, source_file, category, subcategory, status, chunk_count, high_count, valid, text).

    Files without findings or with an invalid window are left out.  Findings
    over ``file_cap`` are cut and marked; the file that crosses ``cap`` in all
    is cut there and marked, and ends the report.
    """
    bar, own = "=" * 50, F.col("text")
    body = F.when(F.length(own) > file_cap, F.concat(F.substring(own, 1, file_cap), F.lit(rules.FINDINGS_TRUNCATED))).otherwise(own)
    head = F.format_string(f"\n\n{bar}\n=== FILE: %s | Category: %s/%s | Status: %s | Chunks: %d | High-anomaly: %d ===\n{bar}\n", "source_file", "category", "subcategory", "status", "chunk_count", "high_count")
    said = findings.where(F.col("valid") & (F.trim(F.regexp_replace(own, r"\s+", " ")) != ""))
    one = said.select("position", F.concat(head, body, F.lit("\n")).alias("text"))
    # Sizes say which files fit; texts are looked up for those, which the budget bounds.
    sizes = total_before(one.select("position", F.length("text").cast("bigint").alias("_size")), "position", "_size", "_before").where(F.col("_before") <= cap)
    before = one.join(F.broadcast(sizes.select("position", "_before")), "position")
    left = (F.lit(cap) - F.col("_before")).cast("int")
    text = F.when(F.length("text") > left, F.concat(F.substring(F.col("text"), F.lit(1), left), F.lit(rules.EVIDENCE_TRUNCATED))).otherwise(F.col("text"))
    return before.select("position", text.alias("text"))
