"""Incidents: which decisions are incidents, how they cluster, which patterns and drifts they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import before, codes, cut_key, mean, r4

DRIFT_BAND, DRIFT_AT, DRIFT_SAMPLES = 0.05, 0.15, 15
REPEATED, SHARE, DEEP_SHARE, SURGE = 3, 0.50, 0.85, 1.5
DIMENSIONS = ("performance", "responsibility", "cost")


def triggers() -> Column:
    risk, has = F.col("overall_risk"), F.array_contains(codes("reason_codes"), "HIGH_CONSEQUENCE")
    rules = (("BLOCK", F.col("decision") == "BLOCK"), ("HUMAN_REVIEW", F.col("decision") == "HUMAN_REVIEW"), ("MULTI_RISK", F.col("multi_risk")), ("HIGH_CONSEQUENCE_WITH_ELEVATED_RISK", has & (risk >= C.ELEVATED_RISK)))
    return F.concat_ws(",", *(F.when(c, n) for n, c in rules))


def severity() -> Column:
    risk, high = F.col("overall_risk"), F.col("overall_risk") >= C.ELEVATED_RISK
    critical = (F.col("decision") == "BLOCK") | (risk >= C.CRITICAL_RISK) | F.array_contains(codes("reason_codes"), "CRITICAL_PII")
    elevated = (F.col("decision") == "HUMAN_REVIEW") | ((F.col("consequence_score") >= C.HIGH_CONSEQUENCE) & high) | (F.col("multi_risk") & high)
    return F.when(critical, "CRITICAL").when(elevated, "HIGH").otherwise("MEDIUM")


def signature() -> Column:
    """The structured parts that incidents of a cluster share."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(F.array_sort(codes(c)), ","), F.lit("")), F.lit("-"))
    parts = [("app", F.col("application")), ("dim", F.col("dominant_dimension")), ("tier", F.col("decision")), ("verify", F.col("verification_path")), ("reasons", listed("reason_codes")),
             ("rules", listed("tier_changing_rules")), ("cons", F.col("consequence_band")), ("crit", F.col("criticality_band"))]
    return F.concat_ws("|", *(F.concat(F.lit(f"{n}:"), c) for n, c in parts))


def incidents(d: DataFrame) -> DataFrame:
    """One row for each incident, with an id from the interaction's."""
    found = d.withColumn("triggers", triggers()).filter("triggers <> ''").withColumn("severity", severity()).withColumn("signature", signature())
    key = F.upper(F.substring(F.sha1(F.col("interaction_id").cast("string")), 1, 10))
    return found.withColumn("incident_id", F.concat(F.lit("INC-"), key))


def with_reviews(found: DataFrame, actions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Latest reviewer signal and first feedback outcome of each incident; both sides are reduced to a row an interaction first.

    A MODIFY without a tier does not overwrite an earlier signal.
    """
    named = F.when(F.col("action") == "MODIFY_DECISION", F.col("reviewer_decision")).when(F.col("action").isin("APPROVE_DECISION", "REJECT_DECISION"), F.col("action"))
    latest = actions.withColumn("signal", named).filter("signal is not null").groupBy("interaction_id").agg(F.max_by("signal", "action_id").alias("reviewer_signal"))
    first = feedback.groupBy("interaction_id").agg(F.min_by("outcome", F.struct("feedback_id", "outcome")).alias("feedback_outcome"))
    return found.join(latest, "interaction_id", "left").join(first, "interaction_id", "left")


def digest(found: DataFrame) -> DataFrame:
    """Counts by severity, application and trigger in one long table."""
    rows = found.select(F.inline(F.concat(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")), F.struct(F.lit("application").alias("kind"), F.col("application").alias("name"))),
        F.transform(codes("triggers"), lambda x: F.struct(F.lit("trigger").alias("kind"), x.alias("name"))))))
    return rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def clusters(found: DataFrame) -> DataFrame:
    """Incidents by signature. No member lists: a surge puts most incidents under one signature."""
    out = found.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n"), mean("overall_risk").alias("mean_risk"), F.max("overall_risk").alias("max_risk"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.first("application").alias("application"), F.first("decision").alias("decision"), mean("decision_confidence").alias("mean_confidence"),
    )
    return out.withColumn("recurring", F.col("n") >= REPEATED)


def riskiest(found: DataFrame, n: int = 3) -> DataFrame:
    """The riskiest incidents of each cluster, ties to the smaller id."""
    best = Window.partitionBy("signature").orderBy(F.desc("overall_risk"), "interaction_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("signature", "rank", "interaction_id", "overall_risk")


def top_codes(found: DataFrame, column: str = "reason_codes", n: int = 3) -> DataFrame:
    """Most frequent codes of each cluster, ties by name."""
    counted = found.select("signature", F.explode(codes(column)).alias("code")).groupBy("signature", "code").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("signature").orderBy(F.desc("n"), "code")
    return counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def pattern_severity(value: Column, limit: Column | float) -> Column:
    ratio = value / (F.lit(limit) if isinstance(limit, (int, float)) else limit)
    return F.when(ratio >= 1.6, "HIGH").when(ratio >= 1.25, "MEDIUM").otherwise("LOW")


def pattern_confidence(n: Column, effect: Column) -> Column:
    return r4(F.least(F.lit(1.0), 0.35 + 0.4 * F.least(F.lit(1.0), n / 12) + 0.35 * F.least(F.lit(1.0), effect)), 3)


def cluster_patterns(found: DataFrame) -> DataFrame:
    """Recurring clusters of one tier, and of low confidence."""
    c = clusters(found).filter("recurring")
    repeated = c.filter(F.col("decision").isin("BLOCK", "VERIFY")).select(F.concat(F.lit("REPEATED_"), "decision").alias("pattern"), "application", F.col("signature").alias("subject"), "n", F.lit(1.0).alias("effect"))
    unsure = c.filter(F.col("mean_confidence") < C.LOW_CONFIDENCE).select(F.lit("LOW_CONFIDENCE_CLUSTER").alias("pattern"), "application", F.col("signature").alias("subject"), "n", (1 - F.col("mean_confidence")).alias("effect"))
    return _graded(repeated.unionByName(unsure), REPEATED)


def _graded(patterns: DataFrame, limit: int) -> DataFrame:
    return patterns.withColumn("severity", pattern_severity(F.col("n"), limit)).withColumn("confidence", pattern_confidence(F.col("n"), F.col("effect"))).withColumn("effect", r4(F.col("effect")))


def dominance_patterns(found: DataFrame) -> DataFrame:
    """Rules, detectors and applications behind half of all incidents or more."""
    moves = found.select(F.explode(codes("tier_changing_rules")).alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n")).withColumn("pattern", F.lit("RULE_DOMINANCE"))
    dims = found.groupBy(F.col("dominant_dimension").alias("subject")).agg(F.count(F.lit(1)).alias("n")).withColumn("pattern", F.lit("DETECTOR_DOMINANCE"))
    apps = found.groupBy(F.col("application").alias("subject")).agg(F.count(F.lit(1)).alias("n")).withColumn("pattern", F.lit("RISK_CONCENTRATION"))
    every = moves.unionByName(dims).unionByName(apps)
    totals = every.groupBy("pattern").agg(F.sum("n").alias("total"))
    return every.join(F.broadcast(totals), "pattern").filter((F.col("n") / F.col("total") >= SHARE) & (F.col("total") >= 5)).select("pattern", "subject", "n", r4(F.col("n") / F.col("total")).alias("share"))


def deep_concentration(d: DataFrame) -> DataFrame:
    """Applications whose traffic almost always needs deep verification."""
    share = F.avg((F.col("verification_path") == "DEEP").cast("double"))
    return d.groupBy("application").agg(F.count(F.lit(1)).alias("n"), share.alias("share")).filter(F.col("share") >= DEEP_SHARE).withColumn("share", r4(F.col("share")))


def cross_application(found: DataFrame) -> DataFrame:
    """Signatures that two applications or more share."""
    bare = found.withColumn("subject", F.regexp_replace("signature", r"^app:[^|]*\|", ""))
    return bare.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("application").alias("applications")).filter("applications >= 2")


def attribution(found: DataFrame) -> DataFrame:
    """Shares of dimensions, tiers, codes and rules among the incidents of each application."""
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("name"))
    rows = found.select("application", F.inline(F.concat(F.array(pair("dimension", F.col("dominant_dimension")), pair("decision", F.col("decision"))),
        F.transform(codes("reason_codes"), lambda x: pair("code", x)), F.transform(codes("tier_changing_rules"), lambda x: pair("rule", x)))))
    totals = found.groupBy("application").agg(F.count(F.lit(1)).alias("total"))
    counted = rows.groupBy("application", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(totals), "application").select("application", "kind", "name", "n", r4(F.col("n") / F.col("total")).alias("share"))


def override_patterns(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewer tiers that differ from the system's, three times or more in an application."""
    joined = found.select("interaction_id", "application", F.col("decision").alias("original")).join(reviews, "interaction_id")
    changed = joined.filter(F.col("reviewer_decision").isNotNull() & (F.col("reviewer_decision") != F.col("original")))
    total = found.groupBy("application").agg(F.count(F.lit(1)).alias("total"))
    counted = changed.groupBy("application", "original", "reviewer_decision").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= REPEATED)
    return counted.join(F.broadcast(total), "application").select("application", "original", "reviewer_decision", "n", r4(F.col("n") / F.col("total")).alias("rate"))


def drift(d: DataFrame, top_rules: int = 5) -> DataFrame:
    """First half against second: means of all, of detectors and applications, and fire rates of the commonest rules.

    Fewer than four rows give no signals.
    """
    n = d.count()
    first = before(cut_key(d, n // 2)) if n >= 4 else F.lit(False)
    pair = lambda scope, metric, value: F.struct(scope.alias("scope"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    fixed = [pair(F.lit("global"), "average_risk", F.col("overall_risk")), pair(F.lit("global"), "intervention_rate", F.col("decision") != "ALLOW"), pair(F.lit("global"), "deep_rate", F.col("verification_path") == "DEEP"),
             pair(F.lit("global"), "incident_rate", triggers() != ""),
             *(pair(F.lit(f"detector:{x}"), "mean_risk", F.col(f"{x}_risk")) for x in DIMENSIONS), pair(F.concat(F.lit("application:"), "application"), "average_risk", F.col("overall_risk"))]
    common = [r["rule"] for r in d.select(F.explode(codes("tier_changing_rules")).alias("rule")).filter("rule <> 'RISK_BAND'").groupBy("rule").count().orderBy(F.desc("count"), "rule").limit(top_rules).collect()]
    fires = [pair(F.lit(f"policy_rule:{r}"), "fire_rate", F.array_contains(codes("tier_changing_rules"), r)) for r in common]
    rows = d.filter(F.lit(n >= 4)).select(first.alias("first"), F.inline(F.array(*fixed, *fires)))
    wide = rows.groupBy("scope", "metric").agg(*(F.avg(F.when(c, F.col("value"))).alias(n) for n, c in (("b", F.col("first")), ("r", ~F.col("first")))), F.count_if("first").alias("n_first"), F.count_if(~F.col("first")).alias("n_second"))
    delta, enough = F.col("r") - F.col("b"), (F.col("n_first") >= DRIFT_SAMPLES) & (F.col("n_second") >= DRIFT_SAMPLES)
    signal = F.when(F.abs(delta) <= DRIFT_BAND, "STABLE").when((F.abs(delta) >= DRIFT_AT) & enough, "POTENTIAL_DRIFT").otherwise("TREND")
    direction = F.when(F.abs(delta) <= DRIFT_BAND, "STABLE").when(delta > 0, "INCREASING").otherwise("DECREASING")
    return wide.filter("b is not null and r is not null").select("scope", "metric", r4(F.col("b")).alias("baseline"), r4(F.col("r")).alias("recent"), r4(delta).alias("delta"), direction.alias("direction"), signal.alias("signal"), enough.alias("sufficient"))
