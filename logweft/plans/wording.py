"""What a language model is told in each step: a system text and a user text, filled from what is known.

A deployment can put its own sections (see ``sources.prompts``) in place of
any text here; each is named after its step.
"""

from __future__ import annotations

import json

from ..functions import rules
from ..operators.followup import Intent
from ..sources.prompts import render

#: What tells the kinds of incident apart: what shows it, what merely follows from it, where to look.
KINDS = {
    "global_runtime_stall": ("the log falls silent while metrics go on; many threads, few of them busy; all endpoints slow at once", "full pools and queues that fill after the silence began; jobs at a fixed hour", "gaps, log rate against metric rate, threads against busy threads"),
    "high_volume_cardinality": ("large result counts; bursts of one method; one operation behind the line rate", "pools that fill during the burst; large but steady caches", "the first large count, loops over records, whose request it was"),
    "thread_pool_pressure": ("queues near their limit; rejected tasks; all workers active before answers slow down", "queues that grow after another trigger; steady queues far below the limit", "queue size and active workers over time, rejections"),
    "db_connection_pressure": ("active connections near the maximum; waits for a connection; slow directory or database calls", "connections that rise with the number of threads after a stall", "pool figures, lines that name a backend, their latencies"),
    "mixed_compound": ("two of these at once, neither explained by the other", "a single cause with several effects", "which of them began first"),
}
#: What statements may use.
SCHEMA = (
    "log_events(timestamp, thread, raw_line, has_latency, has_jdbc, has_ldap, has_hibernate, has_connection_wait, has_staleobject, has_sql, has_count_rows, has_entry_authz, has_rest, has_scheduled, method_sig, latency_ms, result_count, scheduled_op_name); "
    "server_metrics(timestamp, thread, metric_name, metric_value, category, raw_line); server_metrics_wide(" + ", ".join(rules.WIDE_COLUMNS) + ")"
)
TEXTS: dict[str, tuple[str, str]] = {
    "schema": ("You infer log formats. Answer in JSON with timestamp_re, timestamp_fmt (strptime) and thread_re.", "{{sample}}"),
    "map": (
        "Explain the failures in this log from its profile and evidence only. Cite every claim with the [REF_...] mark of its evidence. {{scope}}",
        "File: {{file}}\nKind: {{category}}/{{subcategory}}\nQuestion: {{question}}\n\nProfile:\n{{profile}}\n\nEvidence:\n{{evidence}}",
    ),
    "reduce": ("Merge the findings of all files into one report of ranked causes, with evidence, confidence and what would raise it. Keep the [REF_...] marks. {{scope}}", "{{findings}}"),
    "classification": (
        "Choose the archetype of an incident from scored signals. The archetypes:\n{{kinds}}\nAnswer in JSON: primary and secondary, each with archetype, confidence and supporting_signals, and rejected_hypotheses.",
        "Scores:\n{{scores}}\n\nSignals:\n{{signals}}\n\nLines that stand out:\n{{candidates}}",
    ),
    "onset": ("Date the beginning of an incident and tell causes from symptoms. Answer in JSON with degradation_start and reason.", "Classification:\n{{classification}}\n\nSignals:\n{{signals}}\n\nFirst abnormal snapshots:\n{{anchors}}"),
    "red_herrings": ("Name the patterns that are not the cause. Answer in JSON with rejections, each with operation and reason.", "Classification:\n{{classification}}\n\nRecurring operations:\n{{recurring}}"),
    "evidence": ("Gather evidence for or against the archetype {{archetype}}, and what tells it from {{competing}}, with at most three read-only SQL statements in fenced blocks. Tables: {{schema}}", "Onset: {{onset}}\n\nSo far:\n{{executed}}\n\n{{results}}"),
    "critic": ("Judge whether the evidence carries the classification. Answer PASS, RETRY (more of it), FAIL (none of it helps) or RECLASSIFY.", "Classification:\n{{classification}}\n\nCompeting: {{competing}}\n\nRejected as causes: {{rejected}}\n\nStatements:\n{{executed}}"),
    "synthesis": ("Write the incident report from these facts: what happened, why, and what speaks against it. The archetypes:\n{{kinds}}", "File: {{file}}\n\n{{facts}}"),
    "ticket": ("Relate the report to the support ticket: what it confirms, what it does not.", "{{report}}\n\nTicket:\n{{ticket}}"),
    "intent": ("Read a follow-up question. Answer in JSON with ask_type, entities, primary_keys, must_include, confidence (0 to 1) and notes.", "Analysis of: {{question}}\n\nReport:\n{{report}}\n\nChat:\n{{history}}\n\nFollow-up: {{followup}}"),
    "answer": ("Answer from the evidence only, and say so where it does not suffice. Cite {{citation}}.", "Analysis of: {{question}}\n\n{{ticket}}Chat:\n{{history}}\n\nFollow-up: {{followup}}\nRead as: {{intent}}\n\nEvidence:\n{{evidence}}"),
    "followup_sql": ("Answer with read-only SQL in fenced blocks, two at most in a turn, and then with FINAL_ANSWER: and the answer. The statements are run for you. Tables: {{schema}}", "{{ticket}}Chat:\n{{history}}\n\n{{followup}}"),
    "followup_sql_retry": ("", "Do not leave the statements to me: give them as SQL and they are run, or answer with FINAL_ANSWER:."),
}


def told(step: str, own: dict[str, tuple[str, str]] | None = None, **known: object) -> list[dict[str, str]]:
    """The messages of a step; ``own`` texts go before the built-in ones."""
    system, user = (own or {}).get(step, TEXTS[step])
    parts = [("system", render(system, **known)), ("user", render(user, **known))]
    return [{"role": role, "content": text} for role, text in parts if text]


def scope(mode: str) -> str:
    return "Speak of requests and sessions, not of server metrics." if mode == "api_request" else "Leave internal marks out of the text."


def kinds() -> str:
    return "\n".join(f"- {k}: shown by {a}. Follows without being it: {b}. Look at: {c}." for k, (a, b, c) in KINDS.items())


def as_json(value: object, most: int | None = None) -> str:
    return json.dumps(value[:most] if most and isinstance(value, list) else value, indent=1, default=str)


def ticket_block(ticket: str, most: int = 1_200) -> str:
    return f"Support ticket:\n{ticket[:most]}{'...' if len(ticket) > most else ''}\n\n" if ticket else ""


def intent_json(intent: Intent) -> str:
    return json.dumps({"ask_type": intent.ask_type, "entities": intent.entities, "primary_keys": intent.primary_keys, "must_include": intent.must_include, "confidence": intent.confidence, "notes": intent.notes})
