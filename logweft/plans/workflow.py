"""The two analyses end to end, and follow-ups; a language model is an optional callable.

``ask(messages) -> str`` narrates; without it every step uses its deterministic
form, and so do the tests.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import QueryContext, validate
from ..functions.parse import in_window, parse_lines, session_label
from ..functions.schema import LogSchema, detect_hybrid
from ..functions.signals import RetrievalSignals
from ..functions.text import first_json
from ..operators import classify, coverage, detect, evidence, followup, profile, references, spans, tables
from ..sources import files
from . import sql, wording

#: Files of an API analysis that are worked on together.
AT_ONCE = 4
Ask = Callable[[list[dict[str, str]]], str]
Progress = Callable[[str], None]


@dataclass
class FileReport:
    path: str
    mode: str
    status: str = "ok"
    reason: str = ""
    subcategory: str = "unclassified"
    schema: LogSchema | None = None
    profile: dict[str, Any] = field(default_factory=dict)
    findings: str = ""
    system_prompt: str = ""
    user_prompt: str = ""
    references: list[dict] = field(default_factory=list)
    row_ids: list[int] = field(default_factory=list)
    chunk_count: int = 0
    high_count: int = 0
    metadata: DataFrame | None = None
    state: WorkflowState | None = None
    artifacts: dict[str, str] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return os.path.basename(self.path)


@dataclass
class WorkflowState:
    """All that the server analysis knows; it lives on the driver, the tables do not."""

    path: str = ""
    log_rows: int = 0
    metric_rows: int = 0
    signals: list[detect.Signal] = field(default_factory=list)
    candidates: list[dict] = field(default_factory=list)
    prescores: dict[str, float] = field(default_factory=dict)
    classification: dict[str, Any] = field(default_factory=dict)
    onset: dict[str, Any] = field(default_factory=dict)
    red_herrings: list[dict] = field(default_factory=list)
    evidence: list[sql.Executed] = field(default_factory=list)
    verdicts: list[str] = field(default_factory=list)
    report: str = ""
    ticket: str = ""
    ticket_notes: str = ""
    summary: str = ""
    errors: list[str] = field(default_factory=list)
    trace: list[dict] = field(default_factory=list)
    step: int = 0
    #: Results by what was asked, so that another round of evidence runs nothing twice.
    known: dict[str, sql.Executed] = field(default_factory=dict)

    @property
    def archetype(self) -> str:
        return self.classification["primary"]["archetype"]

    def once(self, asked: str, run: Callable[[], sql.Executed]) -> sql.Executed:
        """A result, worked out at its first use; each use has a record of its own, as it speaks for the archetype then in question."""
        if asked not in self.known:
            self.known[asked] = run()
        return replace(self.known[asked])

    def note(self, phase: str, decision: str, **more: Any) -> None:
        self.step += 1
        self.trace.append({"step": self.step, "phase": phase, "decision": decision} | more)


def parsed_file(spark: SparkSession, path: str, ask: Ask | None = None) -> tuple[LogSchema, DataFrame]:
    """The file's schema from its first lines, and its parsed lines with ``label``."""
    lines = files.read_lines(spark, path)
    schema = detect_hybrid(files.sample(lines), (lambda text: ask(wording.told("schema", sample=text))) if ask else None)
    return schema, parse_lines(lines, schema).withColumn("label", session_label(F.col("clean"), schema))


def analyze_file(spark: SparkSession, path: str, *, mode: str = "api_request", context: QueryContext | None = None, signals: RetrievalSignals | None = None, ticket: str = "", ask: Ask | None = None, progress: Progress = lambda _: None, folder: str | None = None) -> FileReport:
    """One file: schema, coverage and window, then the analysis of its mode. The lines are read once and kept while it lasts."""
    out = FileReport(path, mode)
    if os.path.getsize(path) > rules.MAX_FILE_BYTES:
        out.status, out.reason = "skipped_file_too_large", files.size_text(os.path.getsize(path))
        return out
    progress(f"Reading {out.name}")
    signals, context = signals or RetrievalSignals(), context or QueryContext()
    out.schema, parsed = parsed_file(spark, path, ask)
    out.subcategory = signals.subcategory(context.text)
    with tables.Kept() as keep:
        parsed = keep(parsed)
        seen = tables.coverage(parsed, "ts").first()  # the one scan that fills what is kept
        out.reason = validate(context, seen.first_seen, seen.last_seen)
        if out.reason != "ok":
            out.status = "invalid_window"
            return out
        if folder:
            out.artifacts = artifact_paths(folder, out.name)
        parsed = parsed.where(in_window(F.col("ts"), context.start, context.end))
        try:
            if mode == "server_monitoring":
                out.state = server_workflow(parsed, path=path, ticket=ticket, ask=ask, progress=progress, artifacts=out.artifacts)
                out.findings, out.chunk_count = out.state.report, out.state.log_rows
            else:
                api_analysis(out, parsed, signals, context, ask, progress, keep)
        except Exception as e:  # noqa: BLE001  one file's failure is reported and does not end the run
            out.status, out.reason = "failed", f"{type(e).__name__}: {e}"
    return out


def api_analysis(out: FileReport, parsed: DataFrame, signals: RetrievalSignals, context: QueryContext, ask: Ask | None, progress: Progress, keep: tables.Kept) -> None:
    """Profile, requests, evidence, and findings that cite it."""
    progress("Profiling")
    out.profile = profile.profile(parsed, signals, out.schema)
    docs = keep(spans.request_documents(parsed, signals, F.col("label"), keep))
    progress("Selecting evidence")
    chosen = evidence.collected(evidence.select_evidence(docs))
    counts = coverage.summary(docs).first()
    out.references, out.row_ids, out.chunk_count, out.high_count = chosen.references, chosen.row_ids, counts.total, counts.high_anomaly
    out.metadata = evidence.metadata_rows(docs)
    shown = json.dumps(out.profile, indent=1)
    told = wording.told("map", scope=wording.scope(out.mode), file=out.name, category=out.mode, subcategory=out.subcategory, question=context.text, profile=shown, evidence=chosen.text)
    out.system_prompt, out.user_prompt = told[0]["content"], told[1]["content"]
    if out.artifacts:
        write_text(out.artifacts["evidence"], f"=== EVIDENCE PROFILE ===\n{shown}\n\n=== SYSTEM PROMPT ===\n{out.system_prompt}\n\n=== USER PROMPT ===\n{out.user_prompt}\n")
    out.findings = ask(told) if ask else f"{context.text}\n{shown}\n\n{chosen.text}"


def run_pipeline(spark: SparkSession, paths: list[str], *, mode: str = "api_request", context: QueryContext | None = None, signals: RetrievalSignals | None = None, ticket: str = "", ask: Ask | None = None, progress: Progress = lambda _: None, folder: str | None = None) -> tuple[str, list[FileReport]]:
    """All log files below the paths; an invalid window stops the run, a failed file does not.

    Files of an API analysis go to the cluster a few at a time, so that the
    small jobs of one fill the gaps of another; the server analysis registers
    its tables by name and takes one file after the other.
    """
    found = [f for p in paths for f in files.find_logs(p)]
    one = partial(analyze_file, spark, mode=mode, context=context, signals=signals, ticket=ticket, ask=ask, progress=progress, folder=folder)
    reports: list[FileReport] = []
    with ThreadPoolExecutor(AT_ONCE if mode == "api_request" else 1) as pool:
        tasks = [pool.submit(one, f) for f in found]
        for t in tasks:
            reports.append(t.result())
            if reports[-1].status == "invalid_window":
                pool.shutdown(cancel_futures=True)
                return f"The query window does not fit the log: {reports[-1].reason}", reports
    return consolidate(spark, reports, ask, mode=mode), reports


FINDINGS = "position long, source_file string, category string, subcategory string, status string, chunk_count long, high_count long, valid boolean, text string"


def consolidate(spark: SparkSession, reports: list[FileReport], ask: Ask | None = None, *, mode: str = "api_request") -> str:
    """One report of all files that have findings, within its budgets, as Markdown; citations become places in the logs."""
    if not reports:
        return "No log files."
    rows = [(k, r.name, r.mode, r.subcategory, r.status, r.chunk_count, r.high_count, r.status != "invalid_window", r.findings) for k, r in enumerate(reports)]
    text = "".join(r.text for r in evidence.report(spark.createDataFrame(rows, FINDINGS)).orderBy("position").collect())
    if not text.strip():
        failed = [r for r in reports if r.status != "ok"]
        return "\n".join(["# Analysis failed", *(f"- {r.name}: {r.status} ({r.reason})" for r in failed)]) if failed else "No critical anomalies in any file."
    head = "# Log analysis"
    if ask:
        try:
            text, head = ask(wording.told("reduce", scope=wording.scope(mode), findings=text)), ""
        except Exception as e:  # noqa: BLE001  the findings are worth more than the model's failure
            head, text = f"# Report not written\n\nThe language model failed: {e}", text[: rules.BENIGN_CHARS]
    refs = [x for r in reports for x in r.references]
    done = references.space_causes(references.strip_marks(text)) if mode == "server_monitoring" else references.rewrite(text, refs)
    return f"{head}\n\n{done}".strip()


# --- server monitoring ---

def server_workflow(parsed: DataFrame, *, path: str = "", ticket: str = "", ask: Ask | None = None, progress: Progress = lambda _: None, artifacts: dict[str, str] | None = None) -> WorkflowState:
    """Load, diagnose, classify, date, weed out, gather evidence, judge, report; one code path for all of it.

    With ``artifacts`` the two tables are written first and every query, now
    and in follow-ups, reads their columns; without, they are kept until the
    end and worked out again if asked for later.
    """
    spark, s = parsed.sparkSession, WorkflowState(path=path, ticket=ticket)
    with tables.Kept() as keep:
        events, metrics = tables.log_events(parsed), tables.server_metrics(parsed)
        if artifacts:
            seen = tables.save(events, metrics, artifacts["tables"])
            s.log_rows, s.metric_rows = seen["log_events"]["n"], seen["server_metrics"]["n"]
            events, metrics = tables.load(spark, artifacts["tables"])
        else:
            events, metrics = keep(events), keep(metrics)
            tables.register(events, metrics)
        for phase in (_load, _diagnose, _classify, _date, _weed_out, _evidence, _report):
            progress(PROGRESS[phase.__name__])
            phase(spark, s, parsed, events, metrics, ask)
    if artifacts:
        write_artifacts(s, artifacts["evidence"])
    return s


PROGRESS = {"_load": "Loading", "_diagnose": "Running diagnostics", "_classify": "Classifying", "_date": "Dating the onset", "_weed_out": "Rejecting red herrings", "_evidence": "Gathering evidence", "_report": "Writing the report"}


def _load(spark, s: WorkflowState, parsed, events, metrics, ask) -> None:
    s.candidates = [r.asDict() for r in tables.signal_candidates(parsed).collect()]
    if not s.log_rows:  # else observed while the tables were written
        s.log_rows, s.metric_rows = events.count(), metrics.count()
    s.note("initialize", "loaded", lines=s.log_rows, metrics=s.metric_rows)


def _diagnose(spark, s: WorkflowState, parsed, events, metrics, ask) -> None:
    s.signals = detect.broad_signals(events, metrics, errors=s.errors)
    s.note("broad_diagnostics", "signals", n=len(s.signals))


def _reply(text: str) -> dict:
    """The first JSON object of a model's reply; empty if there is none."""
    got = first_json(text)
    return got if isinstance(got, dict) else {}


def judged(said: Any, prescores: dict[str, float]) -> dict[str, Any] | None:
    """An archetype as a model states it: a known name, and a confidence from 0 to 1, else the score that it had before; None for anything else."""
    if not isinstance(said, dict) or said.get("archetype") not in rules.ARCHETYPES:
        return None
    sure = said.get("confidence")
    fits = isinstance(sure, (int, float)) and not isinstance(sure, bool) and 0 <= sure <= 1
    return {"archetype": said["archetype"], "confidence": float(sure) if fits else prescores.get(said["archetype"], 0.0)} | ({"reason": str(said["reason"])} if said.get("reason") else {})


def moment(said: Any) -> str | None:
    """A time as a model states it, if it is one to the second; nothing else may come near a query."""
    found = re.fullmatch(r"(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d(?:\.\d{1,6})?)", said.strip()) if isinstance(said, str) else None
    try:
        return datetime.fromisoformat(f"{found[1]} {found[2]}") and f"{found[1]} {found[2]}" if found else None
    except ValueError:
        return None


def _classify(spark, s: WorkflowState, parsed, events, metrics, ask) -> None:
    s.prescores = classify.scores(spark, s.signals, s.candidates)
    s.classification = classify.classify(s.prescores, s.signals)
    if ask:
        lines = "\n".join(f"{c['signal_type']} {c['captured_value'] or ''}: {c['snippet']}" for c in s.candidates[:12])
        got = _reply(ask(wording.told("classification", kinds=wording.kinds(), scores=wording.as_json(s.prescores), signals=wording.as_json([asdict(x) for x in s.signals], 12), candidates=lines)))
        if primary := judged(got.get("primary"), s.prescores):
            s.classification |= {"primary": primary, "classification_method": "hybrid"}
            if (secondary := judged(got.get("secondary"), s.prescores)) and secondary["archetype"] != primary["archetype"]:
                s.classification["secondary"] = secondary
    s.note("classification", s.archetype)


def _date(spark, s: WorkflowState, parsed, events, metrics, ask) -> None:
    s.onset = classify.onset([r.asDict() for r in detect.onset_rows(metrics).collect()])
    if ask:
        got = _reply(ask(wording.told("onset", classification=wording.as_json(s.classification), signals=wording.as_json([asdict(x) for x in s.signals], 10), anchors=wording.as_json(s.onset["anchors"], 15))))
        if at := moment(got.get("degradation_start")):
            s.onset["degradation_start"] = at
        if got.get("reason"):
            s.onset["reason"] = str(got["reason"])
    s.note("onset", str(s.onset["degradation_start"]))


def _weed_out(spark, s: WorkflowState, parsed, events, metrics, ask) -> None:
    recurring = [r.asDict() for r in detect.recurring_rows(events).collect()]
    s.red_herrings = classify.red_herrings(recurring)
    if ask:
        got = _reply(ask(wording.told("red_herrings", classification=wording.as_json(s.classification), recurring=wording.as_json(recurring, 10))))
        known = {r["operation"] for r in s.red_herrings}
        s.red_herrings += [{"operation": str(x["operation"]), "reason": str(x.get("reason", "")), "hours_seen": None} for x in (got["rejections"] if isinstance(got.get("rejections"), list) else []) if isinstance(x, dict) and x.get("operation") and x["operation"] not in known]
    s.note("red_herrings", f"{len(s.red_herrings)} rejected")


def _evidence(spark, s: WorkflowState, parsed, events, metrics, ask) -> None:
    """Gather and judge until the verdict is PASS, or what it asks for was already tried."""
    wide, retries, turns = tables.wide(metrics), rules.CRITIC_RETRIES, rules.RECLASSIFICATIONS
    while True:
        gather(spark, s, events, wide, ask)
        verdict = critic(s, ask)
        s.verdicts.append(verdict)
        s.note("critic", verdict)
        if verdict == "RECLASSIFY" and turns and s.classification.get("secondary"):
            turns, stale = turns - 1, s.archetype
            s.evidence = [x for x in s.evidence if x.package != stale]  # gathered for what is given up
            s.classification["primary"], s.classification["secondary"] = s.classification["secondary"], s.classification["primary"]
            s.note("classification", s.archetype)
        elif verdict == "RETRY" and retries:
            retries -= 1
        elif verdict != "FAIL" or s.step >= rules.WORKFLOW_STEPS - 3:
            return


def _report(spark, s: WorkflowState, parsed, events, metrics, ask) -> None:
    s.report = synthesis(s, ask)
    if s.ticket:
        s.ticket_notes = ask(wording.told("ticket", report=s.report, ticket=s.ticket[: rules.TICKET_CHARS])) if ask else f"Ticket on file ({len(s.ticket)} characters)."
        s.report += f"\n\n## Ticket\n\n{s.ticket_notes}"
        s.note("ticket", "added")
    s.summary = summary(s)
    s.report += f"\n\n## Summary\n\n{s.summary}"
    s.note("summary", "written")


def gather(spark: SparkSession, s: WorkflowState, events: DataFrame, wide: DataFrame, ask: Ask | None) -> None:
    """Up to three turns of up to three queries from the model, then the fixed supplements; all belong to the archetype in question."""
    before = len(s.evidence)
    for _ in range(rules.EVIDENCE_TURNS if ask else 0):
        reply = ask(wording.told("evidence", archetype=s.archetype, competing=", ".join(classify.competing(s.classification)), schema=wording.SCHEMA, onset=s.onset.get("degradation_start"), executed=sql.executed_table(s.evidence), results="\n".join(x.text for x in s.evidence[-rules.QUERIES_PER_TURN :])))
        queries = sql.blocks(reply, rules.QUERIES_PER_TURN)
        if not queries:
            break
        done = [s.once(q, lambda q=q: sql.execute(spark, q)) for q in queries]
        s.evidence += done
        s.note("evidence", "queries", llm_output=reply, sql_blocks=queries, observations=[x.text for x in done])
    onset = s.onset.get("degradation_start")
    for name, df in detect.supplements(events, wide, onset).items():
        s.evidence.append(s.once(f"{name} {onset}", lambda name=name, df=df: _supplement(name, df)))
    for x in s.evidence[before:]:
        x.package = s.archetype
    s.note("evidence", "gathered", queries=len(s.evidence))


def _supplement(name: str, df: DataFrame) -> sql.Executed:
    n, text = sql.shown(df)
    return sql.Executed(name, n, text[: rules.EVIDENCE_RESULT_CHARS])


def critic(s: WorkflowState, ask: Ask | None) -> str:
    """PASS, RETRY, FAIL or RECLASSIFY by the model's word; without a model, or if it fails, the evidence passes."""
    if not ask:
        return "PASS"
    try:
        said = ask(wording.told("critic", classification=wording.as_json(s.classification), competing=", ".join(classify.competing(s.classification)), rejected=len(s.red_herrings), executed=sql.executed_table(s.evidence))).upper()
    except Exception as e:  # noqa: BLE001
        s.errors.append(f"critic: {e}")
        return "PASS"
    return next((v for v in ("RECLASSIFY", "FAIL", "RETRY") if v in said), "PASS")


def synthesis(s: WorkflowState, ask: Ask | None) -> str:
    """The report from what is known; the same facts go to the model if there is one, and are the report if it fails."""
    p = s.classification["primary"]
    parts = [
        "# Incident report", f"Type: {p['archetype']} (confidence {p['confidence']})", f"Began: {s.onset.get('degradation_start') or 'not determined'}",
        "## Signals", *(f"- {x.signal_family} {x.strength:.2f}: {x.summary}" for x in s.signals),
        "## Candidates", *(f"- {c['signal_type']} {c['captured_value'] or ''}: {c['snippet'][:160]}" for c in s.candidates[:10]),
        "## Not the cause", *(f"- {r['operation']} ({r['reason']})" for r in s.red_herrings),
        "## Evidence", *(f"### {x.sql.splitlines()[0][:80]} ({x.rows} rows)\n{x.text}" for x in s.evidence),
    ]
    facts = "\n".join(parts)
    if ask:
        try:
            return ask(wording.told("synthesis", kinds=wording.kinds(), file=os.path.basename(s.path), facts=facts))
        except Exception as e:  # noqa: BLE001
            s.errors.append(f"synthesis: {e}")
    return facts


def summary(s: WorkflowState) -> str:
    """What was found without any model: the strongest pattern (bursts and counts before latencies), type, onset, and what it rests on."""
    p = s.classification["primary"]
    first = next((c for c in s.candidates if c["signal_type"] in ("high_result_count", "authz_loop_candidate")), s.candidates[0] if s.candidates else None)
    lines = []
    if first:
        lines += [f"**Primary pattern:** {first['signal_type']} (first seen: {first['timestamp']})", *([f"**Peak value:** {first['captured_value']}"] if first["captured_value"] else []), f"**Key line:** {first['snippet'][:200]}"]
    lines.append(f"**Incident type:** {p['archetype']} (confidence: {float(p.get('confidence') or 0):.0%})")
    if s.onset.get("degradation_start"):
        lines.append(f"**Incident onset:** {s.onset['degradation_start']}")
    lines.append(f"**Evidence base:** {len(s.evidence)} SQL queries, {s.log_rows:,} log events, {s.metric_rows:,} metric rows; verdicts {', '.join(s.verdicts) or 'none'}")
    return "\n".join(lines)


def write_text(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def write_artifacts(s: WorkflowState, path: str) -> tuple[str, str]:
    """The analysis as text in sections, and beside it the trace as JSON lines."""
    told = lambda v: json.dumps(v, indent=1, default=str)
    sections = [
        ("SERVER MONITORING", f"File: {os.path.basename(s.path)}\nMetric rows: {s.metric_rows} | Log event rows: {s.log_rows}"),
        *([("TICKET CONTEXT", s.ticket[:2_000] + ("..." if len(s.ticket) > 2_000 else ""))] if s.ticket else []),
        ("ARCHETYPE CLASSIFICATION", told(s.classification)), ("ONSET ANALYSIS", told(s.onset)), ("RED HERRINGS", told(s.red_herrings)),
        ("TRANSCRIPT", "\n".join(f"--- Step {t['step']} | Phase: {t['phase']} ---\n" + "\n".join([t["decision"], *([t["llm_output"]] if t.get("llm_output") else []), *(f"SQL[{i}]: {q}" for i, q in enumerate(t.get("sql_blocks", []))), *t.get("observations", [])]) for t in s.trace)),
        ("QUERIES", sql.executed_table(s.evidence)), ("FINAL REPORT", s.report),
    ]
    trace = os.path.splitext(path)[0] + ".trace.jsonl"
    write_text(trace, "".join(json.dumps(t, default=str) + "\n" for t in s.trace))
    return write_text(path, "".join(f"=== {title} ===\n{body}\n\n" for title, body in sections)), trace


def artifact_paths(root: str, name: str) -> dict[str, str]:
    """Where a file's artifacts go below the output folder."""
    stem = os.path.splitext(os.path.basename(name))[0]
    return {"evidence": f"{root}/debug/debug_evidence_{os.path.basename(name)}.txt", "report": f"{root}/reports/{stem}.md", "tables": f"{root}/tables/{stem}", "uploads": f"{root}/uploads/{stem}"}


# --- follow-ups ---

@dataclass
class AnalysisContext:
    """What a session of follow-ups goes back to."""

    question: str
    path: str
    start: str
    end: str
    report: str
    entries: list[FileReport]
    ticket: str = ""
    created_at: str = ""


def analysis_context(question: str, path: str, start: str, end: str, report: str, reports: list[FileReport], ticket: str = "") -> AnalysisContext:
    """The context of a finished run; reports without a file are left out."""
    return AnalysisContext(question, path, start, end, report, [r for r in reports if r.path], ticket, datetime.now(UTC).isoformat())


def followup_sql(spark: SparkSession, question: str, ask: Ask | None, steps: int = rules.FOLLOWUP_STEPS, *, history: list[dict[str, str]] | None = None, ticket: str = "", progress: Progress = lambda _: None) -> tuple[str, list[sql.Executed]]:
    """Queries and results in turn until the model gives its answer, plain text, or the steps run out."""
    if ask is None:
        return "No language model; ask with SQL.", []
    done: list[sql.Executed] = []
    said = wording.told("followup_sql", schema=wording.SCHEMA, ticket=wording.ticket_block(ticket), history=followup.history_text(history), followup=question)
    for k in range(steps):
        progress(f"Step {k + 1}")
        reply = ask(said)
        if (answer := sql.final_answer(reply)) is not None:
            return answer, done
        queries = sql.blocks(reply, 2)
        if not queries and not sql.delegates(reply):
            return reply.strip(), done
        got = [sql.execute(spark, q, limit=rules.FOLLOWUP_RESULT_CHARS) for q in queries]
        done += got
        said += [{"role": "assistant", "content": reply}, *([{"role": "user", "content": "\n\n".join(x.text for x in got)}] if got else wording.told("followup_sql_retry"))]
    return "No answer within the steps.\n" + sql.executed_table(done), done


def read_intent(context: AnalysisContext, question: str, history: list[dict[str, str]] | None, ask: Ask | None) -> followup.Intent | None:
    """The model's reading if it is confident enough, else the one by the question's words, if it has one."""
    plain = followup.fallback_intent(question, history)
    if ask is None:
        return plain
    try:
        got = first_json(ask(wording.told("intent", question=context.question[:1_200], report=context.report[:5_000], history=followup.history_text(history), followup=question))) or {}
        strings = lambda k: [t for x in got.get(k) or [] if (t := str(x).strip())]
        intent = followup.Intent(str(got.get("ask_type", "other")).strip().lower() or "other", strings("entities"), strings("must_include"), strings("primary_keys"), max(0.0, min(1.0, float(got.get("confidence", 0.0)))), str(got.get("notes", "")).strip())
    except Exception:  # noqa: BLE001  whatever went wrong with the model, the words of the question remain
        return plain
    return intent if intent.confidence >= rules.INTENT_FLOOR else plain


def answer(spark: SparkSession, question: str, context: AnalysisContext, ask: Ask | None = None, *, history: list[dict[str, str]] | None = None, k: int = 10, progress: Progress = lambda _: None) -> str:
    """SQL if every report is of server monitoring, else retrieval over the evidence that the analysis was given."""
    if not question.strip():
        return "Please give a question."
    if not context.entries:
        return "No stored evidence; run an analysis first."
    if all(r.mode == "server_monitoring" for r in context.entries):
        return followup_sql(spark, question, ask, history=history, ticket=context.ticket, progress=progress)[0]
    intent = read_intent(context, question, history, ask)
    if intent is None:
        return "I could not tell what is asked; please name an error, a time range, a thread or a key."
    prompts = spark.createDataFrame([(r.name, r.user_prompt) for r in context.entries if r.mode == "api_request"], "source_file string, prompt string")
    ready = followup.fused(followup.candidates(followup.reference_items(prompts), followup.search_terms(intent, question)), intent.named)
    if intent.broad:
        chosen = followup.broad_choice([r.asDict() for r in ready.collect()], k)  # a few hundred marks for each prompt
    else:
        chosen = [r.asDict() for r in followup.source_caps(ready, k=k).collect()]
    if not chosen:
        return "There is not enough evidence for that; please name an error, a time range, a thread or a key."
    block, table = followup.evidence_block(chosen), followup.evidence_table(chosen)
    if ask is None:
        return f"{block}\n\n{table}"
    try:
        text = ask(wording.told("answer", citation="[REF_...] marks", question=context.question, ticket="", history=followup.history_text(history), followup=question, intent=wording.intent_json(intent), evidence=block)).strip()
    except Exception as e:  # noqa: BLE001
        text = f"No answer: the language model failed ({e})."
    return f"{text}\n\n{table}"


def file_coverage(report: FileReport, buckets: int = 4) -> DataFrame:
    """How the selected rows of an API analysis spread over their file."""
    spark = report.metadata.sparkSession
    total = spark.createDataFrame([(report.name, report.profile["total_lines"])], "source_file string, total_lines long")
    return coverage.bucket_counts(total, selected_lines(report).select("source_file", F.col("first").alias("line")), buckets)


def selected_lines(report: FileReport) -> DataFrame:
    spark = report.metadata.sparkSession
    first, last = coverage.row_bounds()
    return coverage.chosen(report.metadata, spark.createDataFrame([(i,) for i in report.row_ids], "row_id long")).select("source_file", first.alias("first"), last.alias("last"))


def coverage_tables(context: AnalysisContext) -> tuple[list[dict], list[dict]]:
    """A row for each file, and one for each quarter of its lines: how much of it the selected evidence covers."""
    rows, quarters = [], []
    for r in (x for x in context.entries if x.metadata is not None):
        at = selected_lines(r).agg(F.min("first").alias("a"), F.max("last").alias("z"), F.count("*").alias("n")).first()
        span = r.profile.get("time_range", {})
        rows.append({"file_name": r.name, "total_lines_scanned": r.profile["total_lines"], "timestamp_start": span.get("start", ""), "timestamp_end": span.get("end", ""), "metadata_rows_available": r.chunk_count, "selected_evidence_items": at.n, "earliest_selected_line": at.a or "", "latest_selected_line": at.z or ""})
        quarters += [{"file_name": r.name, "line_range": f"{b.first_line}-{b.last_line}", "selected_evidence_items": b.selected} for b in file_coverage(r).orderBy("bucket").collect()]
    return rows, quarters


def metadata_summary(context: AnalysisContext, k: int = 8) -> str:
    """Counts over all requests and events of the run, and the highest-scored of them, as Markdown."""
    frames = [r.metadata for r in context.entries if r.metadata is not None]
    if not frames:
        return "No metadata rows in this analysis."
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    n = coverage.summary(every).first()
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    top = [f"| {cell(r.source_file)} | {r.anomaly_score:.3f} | {cell(r.request_key)[:40]} | {r.start_time} -> {r.end_time} |" for r in coverage.top_rows(every, k).collect()]
    return "\n".join(["### Metadata Summary", f"- Total: {n.total}", f"- High scores (>{rules.HIGH_SCORE}): {n.high_anomaly}", f"- IAM-critical: {n.iam_critical}", "", "### Top scores", "| File | Score | Key | Time |", "|---|---:|---|---|", *top])
