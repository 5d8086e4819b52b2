"""Written forms of a benchmark's and a run's results."""

from __future__ import annotations

import json
from pathlib import Path


def benchmark_markdown(pairs: dict[str, tuple[float, float]], phases: dict[str, float] | None = None) -> str:
    """pairs: query -> median milliseconds of its scanning and its precomputed form."""
    lines = ["# Benchmark", "", "| query | scan ms | columns ms | ratio |", "|---|---|---|---|"]
    lines += [f"| {n} | {a:.1f} | {b:.1f} | {a / b:.1f}x |" if b else f"| {n} | {a:.1f} | {b:.1f} | - |" for n, (a, b) in pairs.items()]
    if phases:
        lines += ["", "| phase | ms |", "|---|---|", *(f"| {n} | {v:.1f} |" for n, v in phases.items()), f"| total | {sum(phases.values()):.1f} |"]
    return "\n".join(lines) + "\n"


def write_benchmark(folder: str, pairs: dict[str, tuple[float, float]], phases: dict[str, float] | None = None) -> tuple[str, str]:
    """The report as Markdown and as JSON."""
    home = Path(folder)
    home.mkdir(parents=True, exist_ok=True)
    (home / "benchmark.md").write_text(benchmark_markdown(pairs, phases), encoding="utf-8")
    rows = {n: {"scan_ms": a, "columns_ms": b, "ratio": a / b if b else None} for n, (a, b) in pairs.items()}
    (home / "benchmark.json").write_text(json.dumps({"pairs": rows, "phases": phases or {}}, indent=1), encoding="utf-8")
    return str(home / "benchmark.md"), str(home / "benchmark.json")


def write_report(text: str, path: str) -> str:
    """A run's report as Markdown."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
    return str(target)
