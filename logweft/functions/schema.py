"""What a log's lines look like, inferred on the driver from a bounded sample of lines."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from . import rules

SAMPLE_LINES = 1_200


@dataclass(frozen=True)
class LogSchema:
    """Patterns that drive the parsing expressions; one object per source, never shipped as rows."""

    timestamp_re: str = rules.NO_TIMESTAMP
    timestamp_fmt: str = ""
    thread_re: str | None = None
    session_keys: tuple[tuple[str, str], ...] = ()
    stack_trace_re: str | None = rules.STACK_FRAME
    is_multiline: bool = False
    confidence: float = field(default=0.0, compare=False)

    @property
    def spark_format(self) -> str | None:
        """The Spark pattern for the strptime format; None means a plain cast."""
        return next((s for _, f, s in rules.TIMESTAMPS if f == self.timestamp_fmt), None)


def _is_continuation(line: str) -> bool:
    return bool(re.match(rules.STACK_FRAME, line)) or not line.strip()


def _share(pattern: str, lines: list[str]) -> float:
    return sum(bool(re.search(pattern, x)) for x in lines) / len(lines) if lines else 0.0


def detect(lines: list[str]) -> LogSchema:
    """The first timestamp shape on over 30 % of 200 lines, the first thread shape on over 20 %, every session key seen in 400."""
    voters = [x for x in lines if not _is_continuation(x)][:200]
    shape = next(((p, f) for p, f, _ in rules.TIMESTAMPS if _share(p, voters) > 0.3), None)
    thread = next((p for p in rules.THREADS if _share(p, voters) > 0.2), None)
    keys = tuple((p, k) for p, k in rules.SESSION_KEYS if any(re.search(p, x) for x in lines[:400]))
    return LogSchema(f"({shape[0]})" if shape else rules.NO_TIMESTAMP, shape[1] if shape else "", thread, keys)


def confidence(schema: LogSchema, lines: list[str]) -> float:
    """0.5 for the share of timestamps, 0.3 for that of threads, 0.2 for any session key."""
    voters = [x for x in lines if not _is_continuation(x)][:200]
    stamped = _share(schema.timestamp_re, voters) if schema.timestamp_fmt else 0.0
    threaded = _share(schema.thread_re, voters) if schema.thread_re else 0.0
    return 0.5 * stamped + 0.3 * threaded + 0.2 * bool(schema.session_keys)


def continuation_share(schema: LogSchema, lines: list[str]) -> tuple[float, bool]:
    """Share of untimestamped or indented lines, and whether any line is a stack frame."""
    if not lines:
        return 0.0, False
    frames = [bool(re.match(rules.STACK_FRAME, x)) for x in lines]
    loose = [f or x[:1] in " \t" or not (schema.timestamp_fmt and re.search(schema.timestamp_re, x)) for f, x in zip(frames, lines, strict=True)]
    return sum(loose) / len(lines), any(frames)


def detect_hybrid(lines: list[str], ask: Callable[[str], str] | None = None, *, multiline: bool = True) -> LogSchema:
    """``detect``, then a second opinion from ``ask`` where confidence is under one half.

    ``ask`` gets the sample and answers with JSON (timestamp_re, timestamp_fmt,
    thread_re); an answer that is not valid, or whose patterns do not compile,
    is ignored.  Multi-line mode is off where continuation lines are under 1 %
    or over 80 %.
    """
    found = detect(lines)
    score = confidence(found, lines)
    if score < 0.5 and ask is not None:
        try:
            got = json.loads(ask("\n".join(lines[:50])))
            for p in (got.get("timestamp_re"), got.get("thread_re")):
                if p:
                    re.compile(p)
            second = replace(found, timestamp_re=got.get("timestamp_re") or found.timestamp_re, timestamp_fmt=got.get("timestamp_fmt") or found.timestamp_fmt, thread_re=got.get("thread_re") or found.thread_re)
            if confidence(second, lines) > score:
                found, score = second, confidence(second, lines)
        except (ValueError, AttributeError, re.error):
            pass
    loose, frames = continuation_share(found, lines)
    is_multi = multiline and 0.01 <= loose <= 0.8 and (frames or loose > 0.15)
    return replace(found, is_multiline=is_multi, confidence=round(score, 4))
