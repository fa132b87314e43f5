"""Recommendations that follow from patterns, each waiting for a person: nothing here changes a setting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.patterns import SEVERITY_RANK

# fixed values: what a pattern asks for, and the order of kinds
TYPE_OF = {
    "HIGH_OVERRIDE_PATTERN": "REVIEW_POLICY", "REPEATED_BLOCK": "REVIEW_POLICY", "POLICY_RULE_DOMINANCE": "REVIEW_POLICY", "REPEATED_VERIFY": "REVIEW_VERIFICATION_THRESHOLD",
    "DEEP_ROUTING_CONCENTRATION": "REVIEW_VERIFICATION_THRESHOLD", "RISK_CONCENTRATION": "REVIEW_APPLICATION", "DETECTOR_DOMINANCE": "REVIEW_DETECTOR", "LOW_CONFIDENCE_CLUSTER": "REVIEW_DETECTOR",
    "CROSS_APPLICATION_PATTERN": "REVIEW_DETECTOR", "INCIDENT_SURGE": "INVESTIGATE_DRIFT",
}
TYPES = ("REVIEW_POLICY", "REVIEW_VERIFICATION_THRESHOLD", "INVESTIGATE_DRIFT", "REVIEW_APPLICATION", "REVIEW_DETECTOR", "NO_ACTION")
OPEN, SIMULATED, APPROVED, REJECTED = "RECOMMENDED_FOR_REVIEW", "SIMULATED", "APPROVED", "REJECTED"
APPROVALS = "recommendation_id string, decision string, reviewer string, seq long"


def recommendation_id(kind, application):
    return F.concat(F.lit("REC-"), F.upper(F.substring(F.sha1(F.concat_ws("|", kind, F.coalesce(application, F.lit("GLOBAL")))), 1, 10)))


def recommendations(patterns: DataFrame, overrides: DataFrame, safe: DataFrame | None = None) -> DataFrame:
    """(recommendation_id, recommendation, application, severity, patterns, incident_count, transitions, status).

    Patterns are grouped by what they ask for and by application (null: all), with the gravest severity and their
    incidents summed. Overrides add to the policy of their application, MEDIUM if no pattern speaks of it. With ``safe``,
    the calibration's best safe candidate (a row or none), threshold reviews are simulated. Without any there is one row,
    NO_ACTION.
    """
    spark = patterns.sparkSession
    kinds = F.broadcast(spark.createDataFrame(list(TYPE_OF.items()), "type string, recommendation string"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, SEVERITY_RANK)), s).cast("int")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    said = patterns.join(kinds, "type").select(
        "recommendation", F.explode_outer("applications").alias("application"), "pattern_id", rank(F.col("severity")).alias("rank"), "incident_count", null("string", "transition")
    )
    # an override by itself is MEDIUM; beside a pattern it adds no severity
    over = overrides.select(
        F.lit("REVIEW_POLICY").alias("recommendation"), "application", null("string", "pattern_id"), null("int", "rank"), F.col("n").alias("incident_count"),
        F.concat_ws(" -> ", "original_decision", "reviewer").alias("transition"),
    )
    merged = said.unionByName(over).groupBy("recommendation", "application").agg(
        F.coalesce(F.min("rank"), F.lit(2)).alias("rank"), F.array_join(F.array_sort(F.collect_set("pattern_id")), ",").alias("patterns"), F.sum("incident_count").alias("incident_count"),
        F.array_join(F.array_sort(F.collect_set("transition")), ",").alias("transitions"),
    )
    nothing = merged.agg(F.count(F.lit(1)).alias("c")).filter("c = 0").select(
        F.lit("NO_ACTION").alias("recommendation"), null("string", "application"), F.lit(4).alias("rank"), F.lit("").alias("patterns"), F.lit(0).cast("long").alias("incident_count"),
        F.lit("").alias("transitions"),
    )
    out = merged.unionByName(nothing).withColumn("severity", F.element_at(F.array(*map(F.lit, SEVERITY_RANK)), F.col("rank"))).withColumn("status", F.lit(OPEN))
    if safe is not None:
        any_safe = safe.agg((F.count(F.lit(1)) > 0).alias("_safe"))
        simulated = (F.col("recommendation") == "REVIEW_VERIFICATION_THRESHOLD") & F.col("_safe")
        out = out.join(F.broadcast(any_safe), F.lit(True)).withColumn("status", F.when(simulated, SIMULATED).otherwise(OPEN))  # one row
    key = recommendation_id(F.col("recommendation"), F.col("application")).alias("recommendation_id")
    return out.select(key, "recommendation", "application", "severity", "patterns", "incident_count", "transitions", "status")


def approvals_overlay(recs: DataFrame, log: DataFrame) -> DataFrame:
    """Recommendations with what people decided of them; the log (``APPROVALS``) is append-only and its last entry holds."""
    last = log.groupBy("recommendation_id").agg(F.max_by(F.struct("decision", "reviewer"), "seq").alias("a"))
    decided = F.when(F.col("a.decision") == "APPROVED_FOR_EVALUATION", APPROVED).when(F.col("a").isNotNull(), REJECTED)
    return recs.join(last, "recommendation_id", "left").withColumn("status", F.coalesce(decided, F.col("status"))).withColumn("reviewer", F.col("a.reviewer")).drop("a")


def report(recs: DataFrame, patterns: DataFrame, drift: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row of counters, and the one observation to look at first: a drift signal, else the gravest pattern."""
    count = lambda df, c, name: df.agg(F.coalesce(c, F.lit(0)).cast("long").alias(name))
    moving = drift.filter("signal <> 'STABLE'")
    first = F.struct((F.col("signal") != "POTENTIAL_DRIFT").alias("later"), (-F.abs("delta")).alias("less"), "scope", "metric")
    seen = moving.agg(F.min(first).alias("s")).select(F.concat_ws(" ", "s.scope", "s.metric").alias("drift_seen"))
    rank = F.array_position(F.array(*map(F.lit, SEVERITY_RANK)), F.col("severity"))
    top = patterns.agg(F.min(F.struct(rank.alias("r"), (-F.col("incident_count")).alias("less"), "type", "subject")).alias("p")).select(F.concat_ws(" ", "p.type", "p.subject").alias("pattern_seen"))
    parts = [
        count(patterns, F.count(F.lit(1)), "patterns"), count(moving, F.count(F.lit(1)), "drift_signals"), count(drift, F.count_if(F.col("signal") == "POTENTIAL_DRIFT"), "potential_drift"),
        count(overrides, F.sum("n"), "reviewer_overrides"), count(recs, F.count(F.lit(1)), "recommendations"), count(recs, F.count_if(F.col("status") == APPROVED), "approved_for_evaluation"),
        count(recs, F.count_if(F.col("status") == REJECTED), "rejected"), seen, top,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    observed = F.when(F.col("drift_seen") != "", F.col("drift_seen")).when(F.col("pattern_seen") != "", F.col("pattern_seen")).otherwise("NONE")
    return out.withColumn("observation", observed).withColumn("production_configuration", F.lit("UNCHANGED")).drop("drift_seen", "pattern_seen")
