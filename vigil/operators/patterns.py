"""All incident patterns as one table with the applications they hold for, and what lies behind each.

A pattern's incidents are those of its applications (of all, if it names none), found by joining the exploded
memberships. Nothing is listed by incident: a pattern has counts, and shares of what its incidents have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.columns import codes, mean, r4
from vigil.operators import incidents as I

#: Columns of the pattern table.
COLUMNS = ("pattern_id", "type", "subject", "severity", "incident_count", "applications")
SEVERITY_RANK = ("HIGH", "MEDIUM", "LOW", "INFO")


def pattern_id(kind: Column, subject: Column) -> Column:
    return F.concat(F.lit("PAT-"), F.upper(F.substring(F.sha1(F.concat_ws("|", kind, subject)), 1, 10)))


def readable(found: DataFrame) -> DataFrame:
    """Add ``label``: application, tier, dimension, the first two codes, and DEEP, as a person would read a signature."""
    deep = F.when(F.col("verification_path") == "DEEP", "DEEP")
    shown = lambda c: F.nullif(c, F.lit(""))
    return found.withColumn("label", F.concat_ws(" / ", "application", "decision", shown(F.col("dominant_dimension")), shown(F.array_join(F.slice(codes("reason_codes"), 1, 2), " / ")), deep))


def patterns(found: DataFrame, d: DataFrame) -> DataFrame:
    """Recurring clusters, dominant rules, detectors and applications, deep routing, and signatures of several applications.

    ``applications`` is empty for patterns of the whole traffic. Patterns of clusters, and of one application, name it.
    """
    one = lambda c: F.array(F.col(c))
    none = F.array().cast("array<string>")
    cl = I.cluster_patterns(found).select(F.col("pattern").alias("type"), F.col("subject"), "severity", F.col("n").alias("incident_count"), one("application").alias("applications"))
    ratio = I.pattern_severity(F.col("share"), I.SHARE)
    dom = I.dominance_patterns(found).select(
        F.when(F.col("pattern") == "RULE_DOMINANCE", "POLICY_RULE_DOMINANCE").otherwise(F.col("pattern")).alias("type"), "subject", ratio.alias("severity"), F.col("n").alias("incident_count"),
        F.when(F.col("pattern") == "RISK_CONCENTRATION", one("subject")).otherwise(none).alias("applications"),
    )
    deep = I.deep_concentration(d).select(
        F.lit("DEEP_ROUTING_CONCENTRATION").alias("type"), F.col("application").alias("subject"), I.pattern_severity(F.col("share"), I.DEEP_SHARE).alias("severity"),
        F.col("n").alias("incident_count"), one("application").alias("applications"),
    )
    bare = found.withColumn("subject", F.regexp_replace("signature", r"^app:[^|]*\|", ""))
    cross = bare.groupBy("subject").agg(F.count(F.lit(1)).alias("incident_count"), F.array_sort(F.collect_set("application")).alias("applications")).filter(F.size("applications") >= 2)
    cross = cross.select(F.lit("CROSS_APPLICATION_PATTERN").alias("type"), "subject", I.pattern_severity(F.col("incident_count"), I.REPEATED).alias("severity"), "incident_count", "applications")
    every = cl.unionByName(dom).unionByName(deep).unionByName(cross)
    return every.select(pattern_id(F.col("type"), F.col("subject")).alias("pattern_id"), *COLUMNS[1:])


def memberships(found: DataFrame, table: DataFrame) -> DataFrame:
    """(pattern_id, application) of every pattern; one that names no application has all that incidents come from."""
    apps = found.select("application").distinct()
    named = table.select("pattern_id", F.explode("applications").alias("application"))
    rest = table.filter(F.size("applications") == 0).select("pattern_id").join(F.broadcast(apps), F.lit(True))  # applications are few
    return named.unionByName(rest)


def attribution(found: DataFrame, table: DataFrame) -> DataFrame:
    """(pattern_id, kind, name, n, share, dominant) by pattern: dimensions, tiers, codes, rules, and whether reviewers spoke up.

    ``found`` has ``reviewer_signal``. Counts are made by application first, so a pattern of all applications adds up a few
    numbers and no incident is copied for each pattern that holds it. ``dominant`` is the first of its kind by share and name.
    """
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("name"))
    parts = F.concat(
        F.array(pair("dimension", F.col("dominant_dimension")), pair("decision", F.col("decision"))), F.transform(codes("reason_codes"), lambda x: pair("code", x)),
        F.transform(codes("tier_changing_rules"), lambda x: pair("rule", x)),
        F.when(F.col("reviewer_signal").isNotNull(), F.array(pair("override", F.lit("any")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
    )
    counted = found.select("application", F.inline(parts)).groupBy("application", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    totals = found.groupBy("application").agg(F.count(F.lit(1)).alias("total"))
    member = memberships(found, table)
    whole = member.join(totals, "application").groupBy("pattern_id").agg(F.sum("total").alias("total"))
    each = member.join(counted, "application").groupBy("pattern_id", "kind", "name").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("pattern_id", "kind").orderBy(F.desc("n"), "name")
    out = each.join(whole, "pattern_id").withColumn("dominant", F.row_number().over(best) == 1)
    return out.select("pattern_id", "kind", "name", "n", r4(F.col("n") / F.col("total")).alias("share"), "dominant")


def override_patterns(found: DataFrame, log: DataFrame, least: int = I.REPEATED, top: int = 4) -> DataFrame:
    """Where reviewers change or reject a tier three times or more: rate among reviews of that tier, commonest codes and rules.

    Actions on interactions without an incident count for the application 'unknown', without codes.
    """
    acted = log.filter(F.col("action").isin("MODIFY_DECISION", "REJECT_DECISION")).join(found.select("interaction_id", "application", "reason_codes", "tier_changing_rules"), "interaction_id", "left")
    acted = acted.withColumn("application", F.coalesce("application", F.lit("unknown")))
    changed = F.when(F.col("action") == "REJECT_DECISION", "REJECTED").when(F.col("reviewer_decision") != F.col("original_decision"), F.col("reviewer_decision"))
    keys = ["application", "original_decision", "reviewer"]
    rows = acted.withColumn("reviewer", changed)
    reviewed = rows.groupBy("application", "original_decision").agg(F.count(F.lit(1)).alias("reviewed"))
    over = rows.filter("reviewer is not null")
    counted = over.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)

    def commonest(column: str) -> DataFrame:
        each = over.select(*keys, F.explode(codes(column)).alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
        first = each.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "x"))).filter(F.col("r") <= top)
        return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda p: p["x"]), ",").alias(f"top_{column}"))

    out = counted.join(reviewed, ["application", "original_decision"]).join(commonest("reason_codes"), keys, "left").join(commonest("tier_changing_rules"), keys, "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(*keys, "n", r4(F.least(F.lit(1.0), F.col("n") / F.col("reviewed"))).alias("override_rate"), empty("top_reason_codes"), empty("top_tier_changing_rules"))


def cluster_details(found: DataFrame) -> DataFrame:
    """Clusters with their readable label, counts by verification path, and incidents that a reviewer has looked at."""
    return readable(found).groupBy("signature").agg(
        F.min("label").alias("label"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("verification_path") == "DEEP").alias("deep"), F.count_if(F.col("verification_path") != "DEEP").alias("fast"),
        F.count("reviewer_signal").alias("reviewed"), mean("overall_risk").alias("mean_risk"),
    )
