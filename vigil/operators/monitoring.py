"""Monitoring reports over the decisions table. Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import band, before, codes, cut_key, many, mean, mode, nearest_rank, one_row, r4, rate

def tier(name: str):
    return F.col("decision") == name


def snapshot(d: DataFrame) -> DataFrame:
    """One row: traffic, tiers, risk, latency and confidence."""
    whole = d.agg(
        F.count(F.lit(1)).alias("total"), *(many(tier(t)).alias(f"n_{t.lower()}") for t in C.TIERS), *(rate(tier(t)).alias(f"rate_{t.lower()}") for t in C.TIERS),
        mean("overall_risk").alias("mean_risk"), mean("latency_ms").alias("mean_latency"), mean("decision_confidence").alias("mean_confidence"), mean("cost_risk").alias("mean_cost_risk"),
        rate(F.col("decision_confidence") < C.LOW_CONFIDENCE).alias("low_confidence_rate"), rate(F.col("verification_path") == "FAST").alias("fast_rate"), rate(F.col("verification_path") == "DEEP").alias("deep_rate"),
        rate(F.col("consequence_band") == "high").alias("high_consequence_rate"), rate(F.col("criticality_band") == "high").alias("high_criticality_rate"), rate(F.col("multi_risk")).alias("multi_risk_rate"),
    )
    return one_row(whole, nearest_rank(d, [], "overall_risk", 0.95, "p95_risk"), nearest_rank(d, [], "latency_ms", 0.95, "p95_latency").withColumn("p95_latency", r4(F.col("p95_latency"))))


def percentiles(d: DataFrame) -> DataFrame:
    """Nearest-rank p50 and p95 of risk by application."""
    return nearest_rank(d, ["application"], "overall_risk", 0.50, "p50").join(nearest_rank(d, ["application"], "overall_risk", 0.95, "p95"), "application")


def risk_distribution(d: DataFrame) -> DataFrame:
    """Count and share of every risk bucket, empty ones too."""
    names = d.sparkSession.createDataFrame([(n, lo, hi) for n, lo, hi in C.BUCKETS], "bucket string, low double, high double")
    counted = d.groupBy(band("overall_risk", C.BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    rows = F.broadcast(names).join(counted, "bucket", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return rows.select("bucket", "low", "high", "n", r4(F.coalesce(F.try_divide("n", "total"), F.lit(0.0))).alias("share"))


def histograms(d: DataFrame) -> DataFrame:
    """Five equal bands of the four risks; values outside [0, 1] are left out."""
    long = d.unpivot("interaction_id", ["performance_risk", "responsibility_risk", "cost_risk", "overall_risk"], "dimension", "risk").filter("risk >= 0 and risk < 1.0001")
    return long.groupBy("dimension", F.least(F.floor(F.col("risk") * 5), F.lit(4)).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def application_summary(d: DataFrame) -> DataFrame:
    """Tier mix, risk, latency and dominant dimension of every application."""
    base = d.groupBy("application").agg(
        F.count(F.lit(1)).alias("total"), *(rate(tier(t)).alias(f"rate_{t.lower()}") for t in C.TIERS), mean("overall_risk").alias("mean_risk"), mean("decision_confidence").alias("mean_confidence"),
        mean("performance_risk").alias("mean_performance"), mean("responsibility_risk").alias("mean_responsibility"), mean("cost_risk").alias("mean_cost"), rate(F.col("verification_path") == "DEEP").alias("deep_rate"),
    )
    return base.join(nearest_rank(d, ["application"], "overall_risk", 0.95, "p95_risk"), "application").join(mode(d, ["application"], "dominant_dimension", "dominant_dimension"), "application")


def segment_metrics(d: DataFrame, key: str) -> DataFrame:
    """Risk, oversight and latency of every application or model; a null key counts as 'unknown'."""
    named = d.withColumn(key, F.coalesce(key, F.lit("unknown")))
    base = named.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), mean("overall_risk").alias("mean_risk"), rate(F.col("verification_path") == "DEEP").alias("deep_rate"), rate(tier("HUMAN_REVIEW")).alias("review_rate"),
        rate(tier("BLOCK")).alias("block_rate"), mean("latency_ms").alias("mean_latency"), many(F.col("decision_confidence") < C.LOW_CONFIDENCE).alias("low_confidence"),
    )
    return base.join(nearest_rank(named, [key], "overall_risk", 0.95, "p95_risk"), key)


def verification_by_application(d: DataFrame) -> DataFrame:
    fast = F.col("verification_path") == "FAST"
    return d.groupBy("application").agg(many(fast).alias("fast"), many(~fast).alias("deep"), r4(F.avg(F.when(fast, F.col("latency_ms")))).alias("fast_latency"), r4(F.avg(F.when(~fast, F.col("latency_ms")))).alias("deep_latency"))


def detectors(d: DataFrame) -> DataFrame:
    """Coverage, risk and weighted contribution of the three detectors."""
    long = d.select("dominant_dimension", F.inline(F.array(*(F.struct(F.lit(n).alias("detector"), F.col(f"{n}_risk").alias("risk"), F.lit(w).alias("weight")) for n, w in C.FUSION.items()))))
    return long.groupBy("detector").agg(
        F.count("risk").alias("coverage"), mean("risk").alias("mean_risk"), rate(F.col("risk") >= C.ELEVATED_RISK).alias("high_rate"), r4(F.avg(F.col("risk") * F.col("weight"))).alias("mean_contribution"),
        many(F.col("dominant_dimension") == F.col("detector")).alias("dominant"),
    )


def reason_codes(d: DataFrame) -> DataFrame:
    """How often every code occurs, and its share of interventions (at most 1)."""
    touched = d.agg(F.count_if(F.col("decision") != "ALLOW").alias("touched"))
    counted = d.select(F.explode(codes("reason_codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(touched)).select("code", "n", r4(F.least(F.lit(1.0), F.coalesce(F.try_divide("n", "touched"), F.lit(0.0)))).alias("share"))


def rule_behaviour(d: DataFrame) -> DataFrame:
    """Fired and tier-moving counts of every rule, and how often it was among the movers to oversight tiers."""
    fired = d.select(F.explode(codes("triggered_rules")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("fired"))
    moved = d.select("decision", F.explode(codes("tier_changing_rules")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("moved"), many(tier("HUMAN_REVIEW")).alias("to_review"), many(tier("BLOCK")).alias("to_block"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    rows = fired.join(moved, "rule", "full").crossJoin(F.broadcast(total)).na.fill(0, ["fired", "moved", "to_review", "to_block"])
    return rows.select("rule", "fired", r4(F.col("fired") / F.col("total")).alias("fire_rate"), "moved", "to_review", "to_block")


def verification_summary(d: DataFrame) -> DataFrame:
    """Deep-verification triggers with counts and shares of all traffic."""
    total = d.agg(F.count(F.lit(1)).alias("total"))
    counted = d.select(F.explode(codes("deep_trigger_reasons")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("reason", "n", r4(F.col("n") / F.col("total")).alias("share"))


def multi_turn(d: DataFrame) -> DataFrame:
    """Sessions, those of two turns or more, and the share that ever was blocked."""
    sessions = d.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_or(tier("BLOCK")).alias("critical"))
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), many(F.col("turns") >= 2).alias("multi_turn"), rate(F.col("critical")).alias("critical_share"), F.max("turns").alias("longest"))


def trend(d: DataFrame, unit: str = "hour") -> DataFrame:
    """Traffic and rates by hour or day."""
    return d.groupBy(F.date_trunc(unit, "timestamp").alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), mean("overall_risk").alias("mean_risk"), rate(tier("BLOCK")).alias("block_rate"), rate(tier("HUMAN_REVIEW")).alias("review_rate"), rate(F.col("verification_path") == "DEEP").alias("deep_rate")
    )


def windowed(d: DataFrame, start: str, end: str) -> DataFrame:
    """Rows inside an inclusive time window, and how many fall outside."""
    inside = F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return d.agg(many(inside).alias("inside"), many(~inside).alias("outside"), r4(F.avg(F.when(inside, F.col("overall_risk")))).alias("mean_risk"))


def risk_posture(d: DataFrame) -> DataFrame:
    """Mean and high-risk count of every dimension."""
    long = d.unpivot("interaction_id", ["performance_risk", "responsibility_risk", "cost_risk", "consequence_score"], "dimension", "risk")
    return long.groupBy("dimension").agg(mean("risk").alias("mean_risk"), many(F.col("risk") >= C.ELEVATED_RISK).alias("high"), F.max(r4(F.col("risk"))).alias("max_risk"))


def application_posture(d: DataFrame) -> DataFrame:
    out = d.groupBy("application").agg(F.count(F.lit(1)).alias("total"), mean("overall_risk").alias("mean_risk"), rate(F.col("decision").isin("HUMAN_REVIEW", "BLOCK")).alias("oversight_rate"))
    return out.withColumn("posture", F.when(F.col("mean_risk") >= 0.5, "HIGH").when(F.col("mean_risk") >= 0.25, "MODERATE").otherwise("LOW"))


def heatmap(d: DataFrame) -> DataFrame:
    """Application by dimension, long form."""
    dims = ["performance_risk", "responsibility_risk", "cost_risk", "overall_risk"]
    return d.groupBy("application").agg(*(mean(x).alias(x) for x in dims)).unpivot("application", dims, "dimension", "mean_risk")


def statistics(d: DataFrame) -> DataFrame:
    """Oversight rate, and mean, p50, p95 and maximum of risk and latency."""
    out = [d.agg(F.count(F.lit(1)).alias("total"), rate(F.col("decision").isin("HUMAN_REVIEW", "BLOCK")).alias("oversight_rate"), mean("overall_risk").alias("mean_risk"), F.max("overall_risk").alias("max_risk"), mean("latency_ms").alias("mean_latency"), r4(F.max("latency_ms")).alias("max_latency"), many(F.col("decision_confidence") < C.LOW_CONFIDENCE).alias("low_confidence"))]
    for name, column in (("risk", "overall_risk"), ("latency", "latency_ms")):
        for p in (50, 95):
            out.append(nearest_rank(d, [], column, p / 100, f"p{p}_{name}").withColumn(f"p{p}_{name}", r4(F.col(f"p{p}_{name}"))))
    return one_row(*out)


def dashboard(d: DataFrame) -> DataFrame:
    """Totals of cost and status, one row."""
    return d.agg(
        F.count(F.lit(1)).alias("total"), r4(F.sum("estimated_cost"), 2).alias("total_cost"), mean("estimated_cost").alias("mean_cost"), mean("efficiency").alias("mean_efficiency"),
        *(many(F.col("perf_status") == s).alias(f"n_{s.lower()}") for s in ("SUPPORTED", "UNVERIFIED", "CONTRADICTED")),
    )


def attention_signals(d: DataFrame) -> DataFrame:
    """Rates over their thresholds; CRITICAL at one and a half times the threshold. Low mean confidence counts the other way."""
    a = C.ATTENTION
    whole = d.agg(
        F.avg(tier("BLOCK").cast("double")).alias("high_block_rate"), F.avg(tier("HUMAN_REVIEW").cast("double")).alias("high_human_review_rate"), F.avg((F.col("verification_path") == "DEEP").cast("double")).alias("high_deep_verification_rate"),
        F.avg((F.col("overall_risk") >= 0.5).cast("double")).alias("high_risk_concentration"), F.avg("decision_confidence").alias("low_mean_confidence"),
    )
    limits = {"high_block_rate": a["block"], "high_human_review_rate": a["review"], "high_deep_verification_rate": a["deep"], "high_risk_concentration": a["concentration"], "low_mean_confidence": a["confidence"]}
    rows = whole.select(F.inline(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(k).alias("value"), F.lit(v).alias("threshold")) for k, v in limits.items()))))
    low = F.col("signal") == "low_mean_confidence"
    raised = rows.filter(F.when(low, F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold")))
    severity = F.when(~low & (F.col("value") >= F.col("threshold") * a["times"]), "CRITICAL").otherwise("WARNING")
    return raised.select("signal", r4(F.col("value")).alias("value"), "threshold", severity.alias("severity"))


def compare(d: DataFrame, first, metrics: dict, flat: float) -> DataFrame:
    """Metric, value in the first part, value in the second part, and direction."""
    parts = d.withColumn("_first", first).groupBy("_first").agg(*(F.avg(m).alias(n) for n, m in metrics.items()), F.count(F.lit(1)).alias("_n"))
    long = parts.select("_first", "_n", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics))))
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("_first"), F.col("value"))).alias("b"), F.max(F.when(~F.col("_first"), F.col("value"))).alias("r"), F.max(F.when(F.col("_first"), F.col("_n"))).alias("n_first"), F.max(F.when(~F.col("_first"), F.col("_n"))).alias("n_second"))
    delta = F.col("r") - F.col("b")
    direction = F.when(F.abs(delta) <= flat, "flat").when(delta > 0, "up").otherwise("down")
    return wide.select("metric", r4(F.col("b")).alias("baseline"), r4(F.col("r")).alias("recent"), r4(delta).alias("delta"), direction.alias("direction"), "n_first", "n_second")


def _metrics() -> dict:
    return {
        "average_risk": F.col("overall_risk"), "intervention_rate": (F.col("decision") != "ALLOW").cast("double"), "review_rate": tier("HUMAN_REVIEW").cast("double"), "block_rate": tier("BLOCK").cast("double"),
        "deep_rate": (F.col("verification_path") == "DEEP").cast("double"), "mean_confidence": F.col("decision_confidence"), "cost_risk": F.col("cost_risk"),
    }


def half_trend(d: DataFrame, flat: float = 0.05) -> DataFrame:
    """First half against second half in time order."""
    return compare(d, before(cut_key(d, d.count() // 2)), _metrics(), flat)


def recent_shift(d: DataFrame, share: float = 0.25, flat: float = 0.03) -> DataFrame:
    """The last quarter of traffic against the rest."""
    n = d.count()
    return compare(d, before(cut_key(d, n - max(1, round(share * n)))), _metrics(), flat)


def verification_cost(d: DataFrame) -> DataFrame:
    """By verification path (a missing one counts as deep): decisions, latency, and those whose semantic check was left out."""
    path = F.upper(F.coalesce("verification_path", F.lit("DEEP")))
    skipped = F.array_contains(codes("deep_trigger_reasons"), "DETERMINISTIC_HARD_BOUNDARY")
    return d.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"), mean("latency_ms").alias("mean_latency"), many(skipped).alias("bypassed"))


def kpis(d: DataFrame) -> DataFrame:
    """One row for a whole table and for each application: traffic, oversight, risk and cost."""
    agg = lambda g: g.agg(
        F.count(F.lit(1)).alias("total"), rate(F.col("decision") != "ALLOW").alias("intervention_rate"), rate(F.col("decision").isin("HUMAN_REVIEW", "BLOCK")).alias("oversight_rate"),
        mean("overall_risk").alias("mean_risk"), many(F.col("overall_risk") >= C.ELEVATED_RISK).alias("elevated"), r4(F.sum("estimated_cost"), 2).alias("total_cost"),
    )
    return agg(d.rollup("application")).withColumn("application", F.coalesce("application", F.lit("all")))


def detector_latency(d: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(detector, invocations, mean_ms, p95_ms, max_ms) of stored latency columns, given as detector -> column; nulls are no calls."""
    long = d.select(F.inline(F.array(*(F.struct(F.lit(n).alias("detector"), F.col(c).cast("double").alias("ms")) for n, c in columns.items())))).filter("ms is not null")
    base = long.groupBy("detector").agg(F.count(F.lit(1)).alias("invocations"), mean("ms").alias("mean_ms"), r4(F.max("ms")).alias("max_ms"))
    tail = nearest_rank(long, ["detector"], "ms", 0.95, "p95_ms")
    return base.join(tail, "detector").withColumn("p95_ms", r4(F.col("p95_ms")))


def of_application(d: DataFrame, application: str | None) -> DataFrame:
    """The rows of one application, or all of them if none is named."""
    return d if application is None else d.filter(F.col("application") == application)


def to_json(report: DataFrame, path: str) -> None:
    """A report as lines of JSON, nulls written out."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
