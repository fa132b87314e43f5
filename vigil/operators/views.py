"""Executive views and calibration grids built from the other reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import codes, many, mean, r4, rate
from vigil.operators import evaluation as E
from vigil.operators import incidents as I

AXES = {"risk": (0.10, 0.90), "confidence": (0.30, 0.95), "consequence": (0.30, 0.95), "criticality": (0.30, 0.95), "disagreement": (0.20, 0.80)}
STEP = 0.05


def overview(d: DataFrame) -> DataFrame:
    """One row: traffic, applications, models, sessions, risk and confidence."""
    return d.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("application").alias("applications"), F.count_distinct("model").alias("models"), F.count_distinct("session_id").alias("sessions"), mean("overall_risk").alias("mean_risk"),
        F.max("overall_risk").alias("max_risk"), mean("decision_confidence").alias("mean_confidence"), rate(F.col("decision") != "ALLOW").alias("intervention_rate"), rate(F.col("overall_risk") >= C.ELEVATED_RISK).alias("high_risk_share"),
    )


def detector_contribution(found: DataFrame) -> DataFrame:
    """How often each detector is high, and dominant, among incidents."""
    each = F.array(*(F.struct(F.lit(n).alias("detector"), F.col(f"{n}_risk").alias("risk")) for n in C.FUSION))
    rows = found.select("dominant_dimension", F.inline(each))
    return rows.groupBy("detector").agg(many(F.col("risk") >= C.ELEVATED_RISK).alias("high"), many(F.col("detector") == F.col("dominant_dimension")).alias("dominant"), mean("risk").alias("mean_risk"))


def recent(d: DataFrame, n: int = 25) -> DataFrame:
    """The latest decisions: a report of ``n`` rows."""
    return d.orderBy(F.desc("timestamp"), F.desc("interaction_id")).limit(n).select("interaction_id", "application", "decision", "overall_risk")


def focus(d: DataFrame) -> DataFrame:
    """The riskiest decision, ties to the first in time."""
    return d.orderBy(F.desc("overall_risk"), "timestamp", "interaction_id").limit(1).select("interaction_id", "application", "decision", "overall_risk")


def incident_order(found: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` gravest incidents: by severity, risk, time and id."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).otherwise(2)
    return found.orderBy(rank, F.desc("overall_risk"), "timestamp", "interaction_id").limit(n).select("incident_id", "severity", "overall_risk")


def timeline(d: DataFrame, log: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows at every stage of oversight, in fixed order."""
    stages = [("1 decided", d), ("2 intervened", d.filter("decision <> 'ALLOW'")), ("3 incident", I.incidents(d)), ("4 reviewed", log.join(d.select("interaction_id"), "interaction_id", "left_semi")), ("5 feedback", notes.join(d.select("interaction_id"), "interaction_id", "left_semi"))]
    out = None
    for name, df in stages:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def surge(d: DataFrame) -> DataFrame:
    """The incident rates of both halves, and whether the second is a surge: increasing, and one and a half times the first."""
    found = I.drift(d).filter("scope = 'global' and metric = 'incident_rate'")
    up = (F.col("direction") == "INCREASING") & (F.col("baseline") > 0) & (F.col("recent") >= I.SURGE * F.col("baseline"))
    return found.select("baseline", "recent", up.alias("surge"))


def axis_sweep(scored: DataFrame, axis: str) -> DataFrame:
    """Share of deep verification, and recall of risky rows, at every value of one gate with the others as they are."""
    low, high = AXES[axis]
    values = [round(low + STEP * i, 2) for i in range(round((high - low) / STEP) + 1)]
    gates = {
        "risk": lambda t: F.col("overall_risk") >= t, "confidence": lambda t: (F.col("confidence") < t) & (F.col("overall_risk") >= C.DEEP["floor"]),
        "consequence": lambda t: (F.col("consequence_score") >= t) | (F.greatest("financial_impact", "reversibility") >= C.DEEP["extreme"]), "criticality": lambda t: F.col("action_criticality") >= t, "disagreement": lambda t: F.col("disagreement") >= t,
    }
    rows = E.with_labels(scored).withColumn("gate", F.explode(F.array(*map(F.lit, values))))
    deep = F.col("perf_status") == "UNVERIFIED"
    for name, gate in gates.items():
        deep = deep | gate(F.col("gate") if name == axis else C.DEEP[name])
    return rows.groupBy("gate").agg(rate(deep).alias("deep_rate"), r4(F.coalesce(F.try_divide(F.count_if(deep & F.col("truly_risky")), F.count_if("truly_risky")), F.lit(0.0))).alias("recall"))


def recommend(sweep: DataFrame, least_recall: float = 0.90) -> DataFrame:
    """The value of least work among those of enough recall, the higher one on ties; else that of most recall."""
    good = F.col("recall") >= least_recall
    return sweep.orderBy(~good, F.when(good, F.col("deep_rate")).otherwise(-F.col("recall")), F.desc("gate")).limit(1).withColumn("safe", good)


def safe_cells(candidates: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` cells of the grid of least work among those without violations."""
    return E.violations(candidates).filter("violations = ''").orderBy("deep_rate", F.desc("recall"), "candidate").limit(n)


def whatif(candidates: DataFrame, current: int = 0) -> DataFrame:
    """Current against selected candidate, metric by metric, with direction."""
    chosen = E.select_candidate(candidates)
    metrics = ["deep_rate", "recall", "precision", "fpr", "review_rate"]
    long = lambda df, name: df.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics))))
    joined = long(candidates.filter(F.col("candidate") == current), "current").join(long(chosen, "selected"), "metric")
    return joined.withColumn("direction", F.when(F.col("selected") > F.col("current"), "up").when(F.col("selected") < F.col("current"), "down").otherwise("same"))


def categories(d: DataFrame, n: int = 10) -> DataFrame:
    """The commonest risk categories of interventions, ties by name."""
    each = d.filter("decision <> 'ALLOW'").select(F.explode(F.array_distinct(F.concat(codes("reason_codes"), F.array(F.concat(F.lit("DOMINANT_"), F.upper("dominant_dimension")))))).alias("category"))
    counted = each.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "category"))).filter(F.col("rank") <= n)
