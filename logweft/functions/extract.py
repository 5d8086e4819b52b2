"""Flags, values, metrics and signals of a line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .parse import any_contains, group, has, unicode
from .signals import RetrievalSignals


def flags(clean: Column, low: Column | None = None) -> dict[str, Column]:
    """The flags of a line; ``low`` is the line in lower case, where that is a column already."""
    low = F.lower(clean) if low is None else low
    out = {name: any_contains(low, words) for name, words in rules.FLAGS.items()}
    out["has_entry_authz"] = F.contains(clean, F.lit(rules.ENTRY_MARK)) | out["has_entry_authz"]
    return out


def values(clean: Column, f: dict[str, Column] | None = None) -> dict[str, Column]:
    """method_sig, latency_ms, result_count, scheduled_op_name; each regex runs once, and only where a cheap test (``f``: the flags, where they are columns already) passes."""
    f = flags(clean) if f is None else f
    gate = F.contains(clean, F.lit(".java:")) | F.contains(clean, F.lit("("))
    # NULLIF stands outside the condition: inside, Spark would run the regex for the test and again for the value.
    found = lambda test, pattern, index: F.nullif(F.when(test, F.regexp_extract(clean, unicode(pattern), index)), F.lit(""))
    return {
        "method_sig": found(gate, rules.METHOD_SIG, 1),
        "latency_ms": found(f["has_latency"], rules.LATENCY_MS, 1).try_cast("bigint"),
        "result_count": found(f["has_count_rows"], rules.RESULT_COUNT, 3).try_cast("bigint"),
        "scheduled_op_name": found(f["has_scheduled"], rules.SCHEDULED_OP, 1),
    }


def category(metric: Column) -> Column:
    low, out = F.lower(metric), F.lit(rules.OTHER_CATEGORY)
    for kind, mark, name in reversed(rules.CATEGORIES):
        test = (F.contains if kind == "part" else F.startswith)(low, F.lit(mark))
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def number(text: Column) -> Column:
    """A float as Python reads it: digits may be parted by single underscores; 1d is none."""
    shape = r"^\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\s*$|(?i)^\s*[+-]?(?:nan|inf|infinity)\s*$"
    return F.when(text.rlike(shape), F.trim(F.replace(text, F.lit("_"), F.lit(""))).try_cast("double"))


def metric_pairs(clean: Column) -> Column:
    """array<struct(name, value)> of the line's numeric name=value pairs, in order."""
    pairs = F.transform(F.regexp_extract_all(clean, F.lit(unicode(rules.METRIC_PAIR)), F.lit(0)), lambda m: F.struct(F.substring_index(m, "=", 1).alias("name"), number(F.substring(m, F.instr(m, F.lit("=")) + 1, F.length(m))).alias("value")))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def has_metrics(clean: Column) -> Column:
    return F.contains(clean, F.lit("Server statistics")) | F.contains(clean, F.lit("msg="))


def high_signal(clean: Column) -> Column:
    """struct(signal_type, captured_value) of the first high-signal pattern that fits, or null."""
    kind = value = F.lit(None)
    for name, pattern, at in reversed(rules.HIGH_SIGNALS):
        fits = has(clean, pattern)
        number_ = group(clean, pattern, at).try_cast("bigint") if at else F.lit(None).cast("bigint")
        kind, value = F.when(fits, F.lit(name)).otherwise(kind), F.when(fits, number_).otherwise(value)
    return F.when(has(clean, rules.QUICK_REJECT), F.struct(kind.alias("signal_type"), value.alias("captured_value")))


def signal_score(captured: Column) -> Column:
    return F.greatest(F.coalesce(captured, F.lit(0)), F.lit(1)).cast("bigint")


def snippet(clean: Column, chars: int = 300) -> Column:
    return F.concat(F.substring(clean, 1, chars), F.when(F.length(clean) > chars, "...").otherwise(""))


def diagnostic_text(text: Column) -> Column:
    """Without blank lines and stack frames; the text itself if nothing else is left."""
    rest = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(unicode(rules.STACK_FRAME)))
    return F.coalesce(F.nullif(F.array_join(F.transform(rest, lambda x: F.trim(x)), "\n"), F.lit("")), text)


def told(text: Column, words: list[str]) -> Column:
    """Whether the diagnostic text has any of the words; as the one element of an array it is worked out once, not for each word."""
    return F.exists(F.array(diagnostic_text(text)), lambda x: any_contains(x, words))


def is_error(text: Column, s: RetrievalSignals) -> Column:
    return told(text, s.error_keywords)


def is_critical(text: Column, s: RetrievalSignals) -> Column:
    return told(text, s.iam_keywords)


def is_noise(text: Column, s: RetrievalSignals) -> Column:
    out = F.lit(False)
    for p in s.noise_patterns:
        out = out | text.rlike("(?iU)" + p)
    return out


def has_marker(text: Column, markers: list[str]) -> Column:
    return any_contains(F.lower(text), [m.lower() for m in markers])


def anomaly_score(text: Column, s: RetrievalSignals, critical: Column | None = None, error: Column | None = None, edge: Column | None = None) -> Column:
    """4 for a critical keyword, 2 for an error, 1 for a request boundary; noise is worth 1 at most, and is looked for only where there is more."""
    critical, error = is_critical(text, s) if critical is None else critical, is_error(text, s) if error is None else error
    edge = has_marker(text, [*s.start_markers, *s.end_markers]) if edge is None else edge
    total = F.when(critical, rules.IAM_BOOST).otherwise(0.0) + F.when(error, rules.ERROR_BOOST).otherwise(0.0) + F.when(edge, rules.BOUNDARY_BOOST).otherwise(0.0)
    return F.when((total > rules.NOISE_CAP) & is_noise(text, s), F.lit(rules.NOISE_CAP)).otherwise(total)


def decode_urls(text: Column) -> Column:
    """Each line's %XX escapes decoded as UTF-8, with + for a blank and three entities first.

    A line with a malformed escape is decoded around it: its bad percent signs
    are escaped themselves before decoding.
    """
    def one(line: Column) -> Column:
        x = line
        for a, b in (("%26amp;", "&"), ("%26gt;", ">"), ("%26lt;", "<")):
            x = F.replace(x, F.lit(a), F.lit(b))
        safe = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(F.contains(x, F.lit("%")) | F.contains(x, F.lit("+")), F.coalesce(F.try_url_decode(safe), x)).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")
