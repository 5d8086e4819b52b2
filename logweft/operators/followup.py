"""Follow-up questions over stored evidence: intent, candidates, fusion, budgets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules


@dataclass
class Intent:
    ask_type: str
    entities: list[str] = field(default_factory=list)
    must_include: list[str] = field(default_factory=list)
    primary_keys: list[str] = field(default_factory=list)
    confidence: float = 0.0
    notes: str = ""

    @property
    def broad(self) -> bool:
        """Whether it asks for what else there is, by its own words."""
        said = " ".join([self.notes, *self.entities, *self.must_include]).lower()
        return self.ask_type in ("summary", "errors", "anomalies") and any(w in said for w in rules.BROAD_WORDS)

    @property
    def named(self) -> list[str]:
        return [*self.entities, *self.must_include, *self.primary_keys]


def history_text(turns: list[dict[str, str]] | None) -> str:
    """The last turns of a chat, each and all within their limits."""
    said = [(str(t.get("role", "user")).strip().lower(), str(t.get("content", "")).strip()) for t in (turns or [])[-rules.HISTORY_TURNS :]]
    lines = [f"{'User' if who == 'user' else 'Assistant'}: {text[: rules.HISTORY_TURN_CHARS]}" for who, text in said if text]
    return ("\n".join(lines) or "(no prior chat turns)")[: rules.HISTORY_CHARS]


def fallback_intent(question: str, history: list[dict[str, str]] | None = None) -> Intent | None:
    """What a short or a broad question asks for, by its words and the chat's; None for an empty or a long, specific one."""
    text = question.strip()
    low = text.lower()
    broad = bool(rules.BROAD_WORDS & set(re.findall(r"[a-z0-9_./:-]{2,}", low)))
    if not text or not broad and len(text) > rules.SHORT_QUESTION:
        return None
    said = f"{low} {history_text(history).lower()}"
    kind = "summary" if broad else next((k for k, words in rules.QUESTION_CLASSES if any(w in said for w in words)), "summary")
    entities = re.findall(r"[A-Za-z0-9_./:-]{3,}", text)[:10]
    return Intent(kind, entities, rules.ISSUE_TERMS[:6] if broad else [], [], rules.BROAD_CONFIDENCE if broad else rules.SHORT_CONFIDENCE, "by the question's words")


def search_terms(intent: Intent, question: str) -> list[str]:
    """At most 30 terms, each once whatever its case: of the intent, of the question, and of issues if it is a broad one."""
    terms = [*intent.entities, *intent.primary_keys, *intent.must_include, *re.findall(r"[A-Za-z0-9_./:-]{3,}", question)]
    if intent.ask_type in ("summary", "errors", "anomalies") and any(w in question.lower() for w in rules.BROAD_WORDS):
        terms += rules.ISSUE_TERMS
    first: dict[str, str] = {}
    for t in map(str.strip, terms):
        if t:
            first.setdefault(t.lower(), t)
    return list(first.values())[: rules.MOST_TERMS]


def hits(text: Column, terms: list[str]) -> Column:
    """How often the terms occur, any case, each without overlaps."""
    low, out = F.lower(text), F.lit(0)
    for t in terms:
        plain = re.sub(r"([^\w\s])", r"\\\1", t.lower())
        out = out + F.regexp_count(low, F.lit(plain))
    return out


def reference_items(prompts: DataFrame, *, text: str = "prompt", chars: int = rules.FOLLOWUP_ITEM_CHARS) -> DataFrame:
    """(item_id, source, source_file, position, snippet, anomaly_score): each citation mark of a stored prompt, at its first place, with the text from there on."""
    marks = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rules.CITATION), F.lit(1)))
    each = prompts.select("source_file", F.col(text).alias("_text"), F.posexplode(marks).alias("position", "item_id"))
    start = F.instr(F.col("_text"), F.concat(F.lit("["), F.col("item_id"), F.lit("]")))
    return each.select("item_id", F.lit("api_ref").alias("source"), "source_file", "position", F.substring(F.col("_text"), start, F.lit(chars)).alias("snippet"), F.lit(0.0).alias("anomaly_score"))


def candidates(items: DataFrame, terms: list[str]) -> DataFrame:
    """Every item with n_hits of the terms in its snippet and relevance in 0 to 1; one without a hit stays, at the base."""
    n = hits(F.col("snippet"), terms)
    base = F.when(F.col("source") == "raw_log", rules.RAW_RELEVANCE).otherwise(rules.REF_RELEVANCE)
    gain = F.col("n_hits") if terms else F.when(F.col("source") == "raw_log", 0).otherwise(1)
    return items.withColumn("n_hits", n).withColumn("relevance", F.least(F.lit(1.0), base + rules.HIT_RELEVANCE * gain))


def fused(rows: DataFrame, entities: list[str]) -> DataFrame:
    """With fused: relevance by source weight, and a little for each entity in the snippet and for a high score."""
    weight = F.lit(rules.OTHER_WEIGHT)
    for s, w in rules.SOURCE_WEIGHT.items():
        weight = F.when(F.col("source") == s, w).otherwise(weight)
    named, low = F.lit(0), F.lower("snippet")
    for e in entities:
        if e:
            named = named + F.contains(low, F.lit(e.lower())).cast("int")
    return rows.withColumn("fused", F.col("relevance") * weight + rules.ENTITY_BONUS * named + F.when(F.col("anomaly_score") >= rules.HIGH_SCORE, rules.ENTITY_BONUS).otherwise(0.0))


def source_caps(rows: DataFrame, score: str = "fused", k: int = rules.FOLLOWUP_ITEMS, caps: dict[str, int] | None = None, other: int = rules.OTHER_CAP) -> DataFrame:
    """The best ``k``, 12 at most, with so many of each source and ``other`` of any unknown one; ties to the smaller item_id."""
    cap, k = F.lit(other), max(1, min(k, rules.FOLLOWUP_ITEMS))
    for s, c in (rules.SOURCE_CAP if caps is None else caps).items():
        cap = F.when(F.col("source") == s, c).otherwise(cap)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(score), "item_id"))
    return rows.withColumn("_k", place).where(F.col("_k") <= cap).drop("_k").orderBy(F.desc(score), "item_id").limit(k)


def broad_choice(items: list[dict], k: int = rules.FOLLOWUP_ITEMS) -> list[dict]:
    """Greedy over a short list for a broad question: a source's and a file's share; what is refused uses up nothing."""
    out, by_source, by_file = [], {}, {}
    for x in sorted(items, key=lambda x: (-x["fused"], x["item_id"])):
        s, f = x["source"], x["source_file"]
        cap = min(rules.SOURCE_CAP.get(s, rules.OTHER_CAP), rules.BROAD_CAP.get(s, rules.FOLLOWUP_ITEMS))
        if len(out) < min(k, rules.FOLLOWUP_ITEMS) and by_source.get(s, 0) < cap and by_file.get(f, 0) < rules.BROAD_PER_FILE:
            out.append(x)
            by_source[s], by_file[f] = by_source.get(s, 0) + 1, by_file.get(f, 0) + 1
    return out


def evidence_block(items: list[dict], cap: int = rules.FOLLOWUP_CHARS, each: int = rules.FOLLOWUP_ITEM_CHARS) -> str:
    """Whole items, blank lines between, while they fit (two characters more for each); only a first one that is too long is cut."""
    texts = [f"[{x['item_id']}] ({x['source']}) {x['snippet'][:each]}" for x in items]
    if texts and len(texts[0]) + 2 > cap:
        return texts[0][:cap]
    kept, used = [], 0
    for t in texts:
        used += len(t) + 2
        if used > cap:
            break
        kept.append(t)
    return "\n\n".join(kept)


def block_of(items: DataFrame, order: list[Column], cap: int = rules.FOLLOWUP_CHARS, each: int = rules.FOLLOWUP_ITEM_CHARS) -> DataFrame:
    """``evidence_block`` of a few chosen items (item_id, source, snippet) in a total order, as one row (block); no row if there are none."""
    text = F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("] ("), "source", F.lit(") "), F.substring("snippet", 1, each))
    by = Window.orderBy(*order)  # what a follow-up has chosen: a dozen rows
    rows = items.select("*", text.alias("_t")).select("_t", F.row_number().over(by).alias("_k"), F.sum(F.length("_t") + 2).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_used"))
    shown = F.when((F.col("_k") == 1) & (F.col("_used") > cap), F.substring("_t", 1, cap)).otherwise(F.col("_t"))
    kept = rows.where((F.col("_used") <= cap) | (F.col("_k") == 1)).groupBy().agg(F.array_sort(F.collect_list(F.struct("_k", shown.alias("t")))).alias("x"))
    return kept.where(F.size("x") > 0).select(F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("block"))


def evidence_table(items: list[dict]) -> str:
    """The chosen items as a Markdown table."""
    if not items:
        return "No evidence items were selected."
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    rows = [f"| {cell(x['item_id'])} | {cell(x['source'])} | {cell(x['source_file'])} | {x['relevance']:.3f} | {x['anomaly_score']:.3f} | {cell(x['snippet'][:320])} |" for x in items]
    return "\n".join(["### Evidence Table", "| REF ID | Source | File | Relevance | Anomaly | Excerpt |", "|---|---|---|---:|---:|---|", *rows])
