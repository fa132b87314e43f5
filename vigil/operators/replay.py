"""Replay and audit tables of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import codes, r4

#: Rules in policy order with the tier columns before and after them.
STEPS = (
    ("RISK_BAND", None, "t0"), ("HIGH_CONSEQUENCE", "t0", "t1"), ("HIGH_CRITICALITY_ACTION", "t1", "t2"), ("PERFORMANCE_CONTRADICTION", "t2", "t3"), ("UNVERIFIED_EVIDENCE", "t3", "t4"), ("HIGH_RESPONSIBILITY_RISK", "t4", "t5"),
    ("LOW_DETECTOR_CONFIDENCE", "t5", "t6"), ("CRITICAL_PII", "t6", "t7"), ("SEVERE_TOXICITY", "t7", "t8"), ("COST_ONLY_CAP", "t8", "t9"), ("LOW_CONFIDENCE_HIGH_RISK", "t9", "t10"),
)


def steps(decided: DataFrame) -> DataFrame:
    """Rule steps that moved the tier, with tier before and after, from a frame that still has the tier columns."""
    every = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), (F.col(a) if a else F.lit(0)).alias("before"), F.col(b).alias("after")) for i, (n, a, b) in enumerate(STEPS)))
    rows = decided.select("interaction_id", F.inline(every)).filter((F.col("step") == 0) | (F.col("before") != F.col("after")))
    name = lambda c: F.element_at(F.array(*map(F.lit, C.TIERS)), F.col(c) + 1)
    return rows.select("interaction_id", "step", "rule", name("before").alias("from_tier"), name("after").alias("to_tier"))


def oversight_rules(found: DataFrame) -> DataFrame:
    """How often each rule was the step that ended at HUMAN_REVIEW or BLOCK."""
    last = Window.partitionBy("interaction_id").orderBy(F.desc("step"))
    end = found.withColumn("r", F.row_number().over(last)).filter("r = 1 and to_tier in ('HUMAN_REVIEW', 'BLOCK')")
    return end.groupBy("rule", "to_tier").agg(F.count(F.lit(1)).alias("n"))


def dimensions(d: DataFrame) -> DataFrame:
    """A row for each decision and dimension: risk, weight, contribution, whether dominant."""
    each = F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(f"{n}_risk").alias("risk"), F.lit(w).alias("weight")) for n, w in C.FUSION.items()))
    return d.select("interaction_id", "dominant_dimension", F.inline(each)).select("interaction_id", "dimension", r4(F.col("risk")).alias("risk"), "weight", r4(F.col("risk") * F.col("weight")).alias("contribution"), (F.col("dimension") == F.col("dominant_dimension")).alias("dominant"))


def audit(d: DataFrame) -> DataFrame:
    """A flat line for each decision."""
    band = F.when(F.col("decision_confidence") >= 0.65, "high").when(F.col("decision_confidence") < 0.45, "low").otherwise("medium")
    return d.select("interaction_id", "application", "decision", r4(F.col("overall_risk")).alias("risk"), band.alias("confidence_band"), F.concat_ws(" > ", "base_tier", "decision").alias("path"), F.size(codes("triggered_rules")).alias("rules"), "reason_codes")


def investigation(incidents: DataFrame, status: DataFrame, effective: DataFrame) -> DataFrame:
    """Incident, current status and decision in force of each incident."""
    joined = incidents.select("interaction_id", "incident_id", "severity").join(status, "interaction_id", "left").join(effective.select("interaction_id", "effective", "overridden"), "interaction_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("OPEN")))
