"""python -m logweft [--mode server_monitoring] [--from T] [--to T] [--ticket FILE] [--question TEXT] [--config FILE] [--out FOLDER] [PATH...]

Without a path it reads commands until the input ends or says exit:
``analyze PATH``, ``coverage``, or a follow-up question about the last analysis.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from .functions.dates import query_context
from .functions.signals import load_signals
from .plans import report, workflow
from .sources import files


def main(args: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="logweft", description="Analyse log files.")
    p.add_argument("paths", nargs="*")
    p.add_argument("--mode", choices=["api_request", "server_monitoring"], default="api_request")
    p.add_argument("--from", dest="start", default="")
    p.add_argument("--to", dest="end", default="")
    p.add_argument("--question", default="")
    p.add_argument("--ticket", action="append", default=[])
    p.add_argument("--config")
    p.add_argument("--out", default="outputs")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()

    def analyze(paths: list[str]) -> workflow.AnalysisContext:
        ticket = files.ticket_text(files.find_tickets(a.ticket))
        text, reports = workflow.run_pipeline(
            spark, paths, mode=a.mode, context=query_context(a.question, a.start, a.end), signals=load_signals(a.config),
            ticket=ticket, progress=lambda m: print(f"  {m}"), folder=a.out)
        print(report.write_report(text, f"{a.out}/reports/report.md"))
        return workflow.analysis_context(a.question, ",".join(paths), a.start, a.end, text, reports, ticket)

    return analyze(a.paths).report if a.paths else converse(spark, analyze)


def converse(spark: SparkSession, analyze: Callable[[list[str]], workflow.AnalysisContext], said: Iterable[str] = sys.stdin) -> str:
    """Commands and questions in turn; the last reply is returned."""
    context, out = None, ""
    for line in map(str.strip, said):
        command, _, rest = line.partition(" ")
        if command.lower() in ("exit", "quit"):
            break
        if command.lower() == "analyze":
            path = rest.strip().strip("\"'")
            context = analyze([path]) if os.path.exists(path) else context
            out = context.report if os.path.exists(path) else f"Path not found: {path}"
        elif line and context is None:
            out = "Analyse logs first: analyze PATH"
        elif line.lower() == "coverage":
            out = workflow.metadata_summary(context)
        elif line:
            out = workflow.answer(spark, line, context)
        if line:
            print(out)
    return out


if __name__ == "__main__":
    main()
