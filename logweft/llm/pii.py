r"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

All of it is column expressions over whole texts.  A kind's matches come from
one pass of its pattern; where there are any, a split by the same pattern
gives what stands between them, and running lengths give code point offsets.
Context is put together from the pieces beside a match, never by counting from
the text's beginning, so a text's cost grows with its length and not with the
square of its matches.

The patterns find what the plain ones in ``PLAIN`` find, in time linear in the
text: looking behind makes every run of digits or name characters start once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

#: The base kinds in their order, with the plain patterns that define them (fixed values).
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPAN = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"
#: Characters before and after a span in which context words count; so many matches, none shorter than 5, lie within.
NEAR, BESIDE = 48, 10


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str | None  # a string without which the pattern cannot match
    score: float
    words: tuple[str, ...]
    base: bool = True
    least: float = 0.0


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, ("mail", "contact", "write to")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, ("ip", "host", "server", "address")),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", None, 0.8, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.8, ("phone", "call", "tel", "mobile")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", None, 0.8, ("iban", "account", "bank", "transfer"), False, 0.6),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, ("ssn", "social security", "tax id"), False, 0.6),
]
BASE = [k.name for k in KINDS if k.base]


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?:\.0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?){3}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def find(text: Column, kind: Kind) -> Column:
    """array<struct(kind, start, end, text, score)> of one kind, by start."""
    none = F.array().cast(SPAN)
    pattern = F.lit(kind.pattern)
    left, right = lambda c: F.substring(c, 1, NEAR), lambda c: F.right(c, F.lit(NEAR))

    def around(pieces: Column, i: Column) -> Column:
        """A match (at 2i + 1 of gap, match, gap ...) with the NEAR characters on each side of it."""
        k = 2 * i + 1
        gap, after = F.get(pieces, k - 1), F.get(pieces, k + 1)
        first = F.greatest(k - 2 * BESIDE - 1, F.lit(0))
        far_before = right(F.array_join(F.transform(F.slice(pieces, first + 1, k - first), right), ""))
        far_after = left(F.array_join(F.transform(F.slice(pieces, k + 2, 2 * BESIDE + 1), left), ""))
        return F.concat(F.when(F.length(gap) >= NEAR, right(gap)).otherwise(far_before), F.get(pieces, k), F.when(F.length(after) >= NEAR, left(after)).otherwise(far_after))

    def spans(pieces: Column, ends: Column, hits: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            near = reduce(lambda a, b: a | b, [F.contains(F.lower(around(pieces, i)), F.lit(w)) for w in kind.words])
            score = F.lit(kind.score) + F.when(near, F.lit((1 - kind.score) * 0.75)).otherwise(F.lit(0.0))
            made = F.struct(F.lit(kind.name).alias("kind"), F.get(ends, 2 * i).alias("start"), F.get(ends, 2 * i + 1).alias("end"), hit.alias("text"), score.alias("score"))
            return F.when(valid(kind.name, hit), made)

        found = F.filter(F.transform(hits, span), lambda s: s.isNotNull() & (s["score"] >= kind.least))
        return found.cast(SPAN)

    def placed(hits: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        pieces = F.flatten(F.zip_with(gaps, hits, lambda g, h: F.array(g, F.coalesce(h, F.lit("")))))
        found = let(pieces, lambda p: let(running(F.transform(p, lambda x: F.length(x))), lambda e: spans(p, e, hits)))
        return F.when(F.size(hits) > 0, found).otherwise(none)

    all_of = F.regexp_extract_all(text, pattern, F.lit(0))
    found = let(all_of, placed)
    return found if kind.hint is None else F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(none)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and spans: array<struct(kind, start, end, text, score)>, by kind as listed, then start.

    Base kinds are kept whatever their score; the method's own kinds (iban,
    ssn) need a valid checksum or a context word.  Null and empty texts have
    no spans.  Each row stands on its own, so null and repeated ids pass;
    other columns are not read, so they cannot clash.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.select(F.col("id").alias(id_col), F.concat(*(find(F.col("text"), k) for k in KINDS)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
