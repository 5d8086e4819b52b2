"""Query times: parsing and validation, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, time

from . import rules


def parse_query_datetime(text: str | None, formats: list[str] = (), *, end: bool = False) -> datetime | None:
    """Date-only forms first (an end date means its last microsecond), then ISO, then the known formats and a schema's."""
    text = (text or "").strip()
    if not text:
        return None
    for f in rules.DATE_FORMATS:
        try:
            d: date = datetime.strptime(text, f).date()
            return datetime.combine(d, time(23, 59, 59, 999999) if end else time())
        except ValueError:
            continue
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        pass
    for f in [*rules.DATETIME_FORMATS, *formats]:
        try:
            return datetime.strptime(text, f)
        except ValueError:
            continue
    return None


@dataclass(frozen=True)
class QueryContext:
    text: str = ""
    start: datetime | None = None
    end: datetime | None = None
    start_raw: str = ""
    end_raw: str = ""
    errors: tuple[str, ...] = field(default=())


def query_context(text: str = "", start: str = "", end: str = "", formats: list[str] = ()) -> QueryContext:
    a, b = parse_query_datetime(start, formats), parse_query_datetime(end, formats, end=True)
    bad = tuple(n for n, raw, got in (("start", start, a), ("end", end, b)) if raw.strip() and got is None)
    return QueryContext(text, a, b, start, end, bad)


def validate(ctx: QueryContext, first: datetime | None, last: datetime | None) -> str:
    """ok, invalid_date, invalid_time, no_log_timestamps or pre_log_boundary; times compare without zones.

    A bound that cannot be read is an invalid_date.
    A start before the log's first line is refused, an end after its last is not.
    """
    if ctx.errors:
        return "invalid_date"
    a, b = (x.replace(tzinfo=None) if x else None for x in (ctx.start, ctx.end))
    if a is None and b is None:
        return "ok"
    if first is None or last is None:
        return "no_log_timestamps"
    if a and b and a > b:
        return "invalid_time"
    if any(x and x < first for x in (a, b)):
        return "pre_log_boundary"
    if a and a > last:
        return "invalid_date" if a.date() > last.date() else "invalid_time"
    return "ok"
