"""Archetype scores from signals and pre-scan hits; a few rows, so the last steps are on the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from .detect import Signal


def weight_table(spark: SparkSession) -> DataFrame:
    """(kind, archetype, weight): what a signal family, by its strength, and a pre-scan hit, each as it is, add to an archetype."""
    rows = [(f, a, w) for table in (rules.FAMILY_WEIGHTS, rules.PRESCAN_BONUS) for f, ws in table.items() for a, w in ws.items()]
    return spark.createDataFrame(rows, "kind string, archetype string, weight double")


def archetype_scores(gains: DataFrame) -> DataFrame:
    """(archetype, score) for all archetypes from (kind, amount): signal families with their strengths, pre-scan types with 1 for each hit.

    Scores are capped weighted sums; no amount is negative, so capping once is
    capping always.  If the best is over 0.4 and the next over 0.35, the
    compound archetype gets their mean.
    """
    spark = gains.sparkSession
    every = spark.createDataFrame([(a,) for a in rules.ARCHETYPES], "archetype string")
    sums = gains.groupBy("kind").agg(F.sum("amount").alias("amount")).join(F.broadcast(weight_table(spark)), "kind").groupBy("archetype").agg(F.sum(F.col("amount") * F.col("weight")).alias("total"))  # a fixed table of under 20 rows
    scored = every.join(sums, "archetype", "left").select("archetype", F.least(F.lit(1.0), F.coalesce("total", F.lit(0.0))).alias("score"))
    best = F.sort_array(F.collect_list("score").over(Window.partitionBy(F.lit(0))), asc=False)  # one row for each archetype
    mean = F.least(F.lit(1.0), (best[0] + best[1]) / 2)
    compound = (F.col("archetype") == "mixed_compound") & (best[0] > 0.4) & (best[1] > 0.35)
    return scored.select("archetype", F.when(compound, mean).otherwise(F.col("score")).alias("score"))


def scores(spark: SparkSession, signals: list[Signal], hits: list[dict] = ()) -> dict[str, float]:
    """All archetypes' scores in their declared order."""
    gains = [(s.signal_family, s.strength) for s in signals] + [(h.get("signal_type", ""), 1.0) for h in hits]
    got = {r.archetype: r.score for r in archetype_scores(spark.createDataFrame(gains, "kind string, amount double")).collect()}
    return {a: got[a] for a in rules.ARCHETYPES}


def classify(prescores: dict[str, float], signals: list[Signal]) -> dict[str, Any]:
    """Primary, secondary and rejected archetypes by score; ties keep the declared order."""
    order = sorted(prescores, key=lambda a: -prescores[a])
    ids = [s.signal_id for s in signals]

    def named(a: str, n: int) -> dict[str, Any]:
        return {"archetype": a, "confidence": round(prescores[a], 2), "supporting_signals": ids[:n]}

    best = prescores[order[0]]
    return {
        "primary": named(order[0], 5),
        "secondary": named(order[1], 3) if prescores[order[1]] > 0.3 else None,
        "rejected_hypotheses": [named(a, 0) | {"rejection_reason": "scores lower than the first two"} for a in order[2:] if prescores[a] < best - 0.15],
        "classification_method": "deterministic_only",
        "rationale": "From the scores of structural signals; no language model took part.",
    }


def competing(classification: dict[str, Any]) -> list[str]:
    """What evidence has to tell the primary from: the second and the first two rejected ones if their scores count at all, or else what the kind is easily taken for."""
    second, rejected = classification.get("secondary"), classification.get("rejected_hypotheses", [])[:2]
    named = [x["archetype"] for x, least in ((second, 0.3), *((x, 0.2) for x in rejected)) if x and x["confidence"] > least]
    return named or rules.COMPETING[classification["primary"]["archetype"]]


def onset(anchors: list[dict], most: int = 5) -> dict[str, Any]:
    """The first anchor is where it began; up to ``most`` are kept."""
    return {"degradation_start": str(anchors[0]["timestamp"]) if anchors else None, "anchors": anchors[:most]}


def red_herrings(recurring: list[dict], most: int = 3) -> list[dict]:
    return [{"operation": r["operation"], "reason": "cadence_scheduled", "hours_seen": r["hours_seen"]} for r in recurring[:most]]
