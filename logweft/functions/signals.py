"""Retrieval configuration: keyword lists, noise patterns and request markers, merged over defaults."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from . import rules


@dataclass(frozen=True)
class RetrievalSignals:
    iam_keywords: list[str] = field(default_factory=lambda: list(rules.IAM_KEYWORDS))
    error_keywords: list[str] = field(default_factory=lambda: list(rules.ERROR_KEYWORDS))
    noise_patterns: list[str] = field(default_factory=lambda: list(rules.NOISE_PATTERNS))
    known_errors: list[str] = field(default_factory=lambda: list(rules.KNOWN_ERROR_KEYWORDS))
    start_markers: list[str] = field(default_factory=lambda: list(rules.START_MARKERS))
    end_markers: list[str] = field(default_factory=lambda: list(rules.END_MARKERS))

    def subcategory(self, question: str) -> str:
        """known_error if the question names a known one, else unknown_error."""
        low = question.lower()
        return "known_error" if any(k in low for k in self.known_errors) else "unknown_error"


def _strings(x: object) -> list[str] | None:
    return [str(v) for v in x] if isinstance(x, list) and all(isinstance(v, str) for v in x) else None


def load_config(path: str | None) -> dict:
    """The JSON file's keys, each only if of the right type; a missing or broken file gives none."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    except (OSError, ValueError):
        return {}
    if not isinstance(got, dict):
        return {}
    lists = {k: v for k in ("iam_critical_keywords", "error_keywords", "noise_patterns", "api_known_error_keywords") if (v := _strings(got.get(k))) is not None}
    marks = got.get("api_request_boundaries")
    if isinstance(marks, dict):
        lists["api_request_boundaries"] = {k: v for k in ("start_markers", "end_markers") if (v := _strings(marks.get(k))) is not None}
    if isinstance(got.get("search_strategy"), str):
        lists["search_strategy"] = got["search_strategy"]
    return lists


def load_signals(path: str | None = None) -> RetrievalSignals:
    """Signals from a configuration file over the defaults; noise patterns that do not compile are left out."""
    got = load_config(path)
    base = RetrievalSignals()
    noise = []
    for p in got.get("noise_patterns", base.noise_patterns):
        try:
            re.compile(p)
            noise.append(p)
        except re.error:
            continue
    marks = got.get("api_request_boundaries", {})
    return RetrievalSignals(
        got.get("iam_critical_keywords", base.iam_keywords), got.get("error_keywords", base.error_keywords), noise,
        [k.lower() for k in got.get("api_known_error_keywords", base.known_errors)],
        marks.get("start_markers", base.start_markers), marks.get("end_markers", base.end_markers),
    )
