"""A file's evidence profile: totals, exceptions, diagnostic entities, request health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extract, rules
from ..functions.parse import unicode
from ..functions.schema import LogSchema
from ..functions.signals import RetrievalSignals
from .spans import request_health
from .tables import stored


def totals(parsed: DataFrame, signals: RetrievalSignals) -> DataFrame:
    """total_lines, error_line_count, first_seen, last_seen."""
    return parsed.agg(F.count("*").alias("total_lines"), F.count_if(extract.is_error(F.col("clean"), signals)).alias("error_line_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def exceptions(parsed: DataFrame, signals: RetrievalSignals, most_threads: int = 10) -> DataFrame:
    """Per exception class on error-bearing or critical lines: count, first and last time seen, and the first ``most_threads`` threads, sorted.

    A thread counts by its first line for the class, so only (class, thread)
    pairs are ranked, never lines.
    """
    clean = F.col("clean")
    loud = parsed.where(extract.is_error(clean, signals) | extract.is_critical(clean, signals))
    hits = loud.select("line_no", "ts", "thread", F.explode(F.regexp_extract_all("clean", F.lit(unicode(rules.EXCEPTION_CLASS)), F.lit(1))).alias("exception"))
    base = hits.groupBy("exception").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    pairs = hits.where("thread is not null and thread <> ''").groupBy("exception", "thread").agg(F.min("line_no").alias("_line"))
    rank = F.row_number().over(Window.partitionBy("exception").orderBy("_line", "thread"))
    named = pairs.withColumn("_k", rank).where(F.col("_k") <= most_threads).groupBy("exception").agg(F.sort_array(F.collect_list("thread")).alias("affected_threads"))
    return base.join(named, "exception", "left").withColumn("affected_threads", F.coalesce("affected_threads", F.array().cast("array<string>")))


def entity_matches(clean: Column, schema: LogSchema | None = None) -> Column:
    """array<struct(type, kind, at, value, key)> of a line's entities: kind and at give the order, key is what is deduplicated."""
    parts = []

    def add(kind: int, type_: str, values: Column, shown, key) -> None:
        parts.append(F.transform(values, lambda v, i: F.struct(F.lit(type_).alias("type"), F.lit(kind).alias("kind"), i.alias("at"), shown(v).alias("value"), key(v).alias("key"))))

    for k, (type_, pattern, at, prefix) in enumerate(rules.ENTITIES):
        found = F.regexp_extract_all(clean, F.lit(unicode(pattern)), F.lit(0 if at is None else at))
        if type_ == "property":
            add(k, type_, F.transform(found, _pair), _same, _lowered("kv:"))
        elif type_ == "token_id":
            add(k, type_, found, _cut80, _token_key)
        elif type_ == "http_status":
            add(k, type_, F.transform(found, _http), _same, _lowered("http:"))
        else:
            add(k, type_, found, _same, _lowered({"file_path": "path:", "uuid": "uuid:", "error_code": "errcode:"}[type_]))
    for k, (pattern, key) in enumerate(schema.session_keys if schema else ()):
        values = F.transform(F.regexp_extract_all(clean, F.lit(unicode(pattern)), F.lit(1)), _prefixed(key + "="))
        add(len(rules.ENTITIES) + k, "session_id", values, _same, _lowered(f"session:{key}:"))
    return F.concat(*parts)


def _same(v: Column) -> Column:
    return v


def _pair(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r"^[\s&]+", ""), r"^([^=\s]+)\s*=\s*", "$1=")


def _cut80(v: Column) -> Column:
    return F.substring(v, 1, 80)


def _token_key(v: Column) -> Column:
    return F.concat(F.lit("token:"), F.substring(v, 1, 40))


def _http(v: Column) -> Column:
    return F.concat(F.lit("HTTP "), v)


def _lowered(prefix: str):
    return lambda v: F.concat(F.lit(prefix), F.lower(v))


def _prefixed(prefix: str):
    return lambda v: F.concat(F.lit(prefix), v)


def entities(parsed: DataFrame, schema: LogSchema | None = None, most: int = rules.ENTITY_MAX) -> DataFrame:
    """The first ``most`` entities: type, value, line_excerpt, line_no.

    In order, an entity is kept unless its value, lower-cased, or its typed key
    is that of one kept before.
    """
    rows = parsed.select("line_no", F.substring("clean", 1, 200).alias("line_excerpt"), F.explode(entity_matches(F.col("clean"), schema)).alias("m")).select("line_no", "line_excerpt", "m.*")
    place = F.struct("line_no", "kind", "at")
    firsts = rows.groupBy(F.lower("value").alias("_v"), "key").agg(F.min_by(F.struct("type", "value", "line_excerpt", "line_no", "kind", "at"), place).alias("x"), F.min(place).alias("_p"))
    return first_of_two(firsts, "_v", "key", "_p", most).select("x.*").orderBy("line_no", "kind", "at").limit(most).select("type", "value", "line_excerpt", "line_no", "kind", "at")


def first_of_two(rows: DataFrame, a: str, b: str, place: str, most: int | None = None) -> DataFrame:
    """The rows that stay if, in the order of ``place`` (unique), each is kept unless its ``a`` or its ``b`` is that of one kept before.

    A row that comes first of its ``a`` and of its ``b`` is kept whatever
    happens elsewhere, and everything that shares either with it goes; what is
    left is looked at again until nothing is.  A round decides at least the
    first row of all, and in practice nearly all rows, as chains of rows that
    share one key with the next are short.  Each round's remainder is written,
    so plans do not grow.  With ``most``, rounds end once the first ``most``
    rows are certain.
    """
    left, kept = stored(rows), None
    while True:
        firsts = left.join(left.groupBy(a).agg(F.min(place).alias("_a")), a).join(left.groupBy(b).agg(F.min(place).alias("_b")), b)
        new = stored(firsts.where((F.col(place) == F.col("_a")) & (F.col(place) == F.col("_b"))).select(*rows.columns))
        kept = new if kept is None else kept.unionByName(new)
        left = stored(left.join(new.select(a), a, "left_anti").join(new.select(b), b, "left_anti"))
        open_from = left.agg(F.min(place)).first()[0]
        if open_from is None:
            return kept
        if most is not None:
            bound = left.agg(F.min(place).alias("_open"))  # one row
            certain = kept.join(F.broadcast(bound), F.col(place) < F.col("_open")).limit(most).count()
            if certain >= most:
                return kept


def profile(parsed: DataFrame, signals: RetrievalSignals, schema: LogSchema | None = None) -> dict:
    """The whole profile as one JSON-safe record; only bounded results reach the driver."""
    t = totals(parsed, signals).first()
    iso = lambda x: x.isoformat() if x else ""
    seen = exceptions(parsed, signals).orderBy(F.desc("count"), "exception").collect()  # a row for each exception class
    h = request_health(parsed, signals).first()
    return {
        "total_lines": t.total_lines, "time_range": {"start": iso(t.first_seen), "end": iso(t.last_seen)}, "error_line_count": t.error_line_count,
        "critical_signals": {r.exception: {"count": r["count"], "first_seen": iso(r.first_seen), "last_seen": iso(r.last_seen), "affected_threads": list(r.affected_threads)} for r in seen},
        "diagnostic_entities_extracted": [{"type": r.type, "value": r.value, "line_excerpt": r.line_excerpt} for r in entities(parsed, schema).collect()],
        "request_lifecycle_health": {"matched_requests": h.matched_requests, "unmatched_entries": h.unmatched_entries, "unmatched_exits": h.unmatched_exits, "error_rate": round(h.error_rate, 4)},
    }

