"""Evaluation against labels, ablation, and calibration of thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import codes, many, r4, rate
from vigil.plans import decide as D

THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def _safe(a: Column, b: Column) -> Column:
    return r4(F.coalesce(F.try_divide(a, b), F.lit(0.0)))


def metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Precision, recall, F1, false-positive and -negative rate, accuracy; 0 where undefined."""
    return [
        _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), _safe(fp, fp + tn).alias("fpr"), _safe(fn, fn + tp).alias("fnr"),
        _safe(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    ]


def binary(df: DataFrame, truth: Column, said: Column, *keys: str) -> DataFrame:
    counted = df.groupBy(*keys).agg(many(truth & said).alias("tp"), many(~truth & said).alias("fp"), many(truth & ~said).alias("fn"), many(~truth & ~said).alias("tn"))
    return counted.select(*keys, "tp", "fp", "fn", "tn", *metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def confusion(df: DataFrame, truth: str, said: str, labels: Sequence[str]) -> DataFrame:
    """The full grid of labels with counts, empty cells too."""
    names = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth string, said string")
    counted = df.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counted, ["truth", "said"], "left").select("truth", "said", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def threshold_sweep(df: DataFrame, truth: Column, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Metrics at every threshold (score >= t): scores are counted first, so the sweep reads a small table."""
    histogram = df.groupBy(F.col(score).alias("score"), truth.alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    grid = histogram.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    said = F.col("score") >= F.col("threshold")
    part = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n)
    counted = grid.groupBy("threshold").agg(part(F.col("truth") & said, "tp"), part(~F.col("truth") & said, "fp"), part(F.col("truth") & ~said, "fn"), part(~F.col("truth") & ~said, "tn"))
    return counted.select("threshold", "tp", "fp", "fn", "tn", *metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def best_threshold(sweep: DataFrame, objective: str = "f1") -> DataFrame:
    return sweep.orderBy(F.desc(objective), "threshold").limit(1)


def with_labels(d: DataFrame) -> DataFrame:
    """Stand-in labels of the numeric adapter, and the tier expected for them.

    What is truly wrong with a row gives each dimension a fixed risk; the largest, with the stakes, falls into a band
    (limits belong to the lower one), and personal data always block.
    """
    if "triggered_rules" in d.columns:
        pii, toxic = (F.array_contains(codes("triggered_rules"), r) for r in ("CRITICAL_PII", "SEVERE_TOXICITY"))
    else:  # signals before any policy
        pii, toxic = F.col("critical_pii"), F.col("toxicity_risk") >= 0.85
    wrong = {
        "hallucination": F.col("perf_status") == "CONTRADICTED", "pii": pii, "toxicity": toxic,
        "bias": F.col("responsibility_risk") >= 0.7, "cost": F.col("cost_anomalies") != "",
    }
    given = {"hallucination": 0.80, "pii": 0.85, "toxicity": 0.75, "bias": 0.70, "cost": 0.75}
    risk = F.greatest(F.lit(0.05), *(F.when(c, given[k]).otherwise(0.05) for k, c in wrong.items()))
    label = 0.6 * risk + 0.4 * F.col("consequence_score")
    band = F.when(label <= 0.20, "ALLOW").when(label <= 0.40, "ANNOTATE").when(label <= 0.60, "VERIFY").when(label <= 0.85, "HUMAN_REVIEW").otherwise("BLOCK")
    any_wrong = reduce(Column.__or__, wrong.values())
    return d.withColumn("label_risk", r4(label)).withColumn("truly_risky", any_wrong).withColumn("expected", F.when(wrong["pii"], "BLOCK").otherwise(band))


def report(d: DataFrame) -> DataFrame:
    """One row: any-risk catch, abstention and coverage, exact tier matches."""
    truth, said = F.col("truly_risky"), F.col("decision") != "ALLOW"
    rates = d.agg(rate(F.col("decision").isin("VERIFY", "HUMAN_REVIEW")).alias("abstention_rate"), rate(~F.col("decision").isin("VERIFY", "HUMAN_REVIEW")).alias("coverage_rate"), rate(F.col("decision") == F.col("expected")).alias("exact_match"))
    return binary(d, truth, said).crossJoin(F.broadcast(rates))


def quadrants(d: DataFrame) -> DataFrame:
    risky, sure = F.col("overall_risk") >= C.EVALUATION["risk"], F.col("decision_confidence") >= C.EVALUATION["confidence"]
    return d.groupBy(F.when(risky, "high").otherwise("low").alias("risk"), F.when(sure, "high").otherwise("low").alias("confidence")).agg(F.count(F.lit(1)).alias("n"), many(F.col("truly_risky")).alias("truly_risky"))


def ablation(scored: DataFrame) -> DataFrame:
    """What single detectors, fusion, and the whole policy with and without confidence would catch, disturb and escalate.

    A flat score asks a person whenever it intervenes; the policies do so in their two highest tiers.
    """
    at = C.EVALUATION["binary"]
    full = with_labels(D.decide(scored))
    unaware = D.decide(scored, confidence_aware=False).select("interaction_id", F.col("decision").alias("unaware"))
    joined = full.select("interaction_id", "truly_risky", "decision", *(f"{x}_risk" for x in ("performance", "responsibility", "cost", "overall")), "consequence_score").join(unaware, "interaction_id")
    flat = {
        "performance_only": F.col("performance_risk"), "responsibility_only": F.col("responsibility_risk"), "cost_only": F.col("cost_risk"), "fused_only": F.col("overall_risk"),
        "fused_plus_consequence": 0.6 * F.col("overall_risk") + 0.4 * F.col("consequence_score"),
    }
    modes = [F.struct(F.lit(n).alias("mode"), (c >= at).alias("said"), (c >= at).alias("escalated")) for n, c in flat.items()]
    for name, tier in (("risk_only_no_confidence", F.col("unaware")), ("full_pipeline", F.col("decision"))):
        modes.append(F.struct(F.lit(name).alias("mode"), (tier != "ALLOW").alias("said"), tier.isin("HUMAN_REVIEW", "BLOCK").alias("escalated")))
    rows = joined.select("truly_risky", F.inline(F.array(*modes)))
    truth, said, up = F.col("truly_risky"), F.col("said"), F.col("escalated")
    kinds = {"tp": truth & said, "fp": ~truth & said, "fn": truth & ~said, "tn": ~truth & ~said, "escalated_n": up, "clean_escalated": ~truth & up, "risky_missed_by_escalation": truth & ~up}
    n = rows.groupBy("mode").agg(*(many(c).alias(k) for k, c in kinds.items()))
    c = {k: F.col(k) for k in kinds}
    total, clean = c["tp"] + c["fp"] + c["fn"] + c["tn"], c["fp"] + c["tn"]
    rates = {
        "intervention_rate": _safe(c["tp"] + c["fp"], total), "clean_disturbed_rate": _safe(c["fp"], clean), "human_escalation_rate": _safe(c["escalated_n"], total),
        "clean_human_escalation_rate": _safe(c["clean_escalated"], clean),
    }
    return n.select("mode", "tp", "fp", "fn", "tn", *metrics(*(c[k] for k in ("tp", "fp", "fn", "tn"))), *(v.alias(k) for k, v in rates.items()), "risky_missed_by_escalation")


def sweep(scored: DataFrame, risks: Sequence[float] = (0.35, 0.60, 0.85), confidences: Sequence[float] = (0.30, 0.60, 0.90)) -> DataFrame:
    """Deep-verification gates under every candidate: workload and what goes undetected. Rows meet a grid of nine."""
    rows = with_labels(D.decide(scored)).select("overall_risk", "confidence", "consequence_score", "action_criticality", "truly_risky", "decision")
    grid = [(i, r, c) for i, (r, c) in enumerate((r, c) for r in risks for c in confidences)]
    cells = F.array(*(F.struct(F.lit(i).alias("candidate"), F.lit(r).alias("risk_at"), F.lit(c).alias("confidence_at")) for i, r, c in grid))
    each = rows.select("*", F.inline(cells))
    deep = (F.col("overall_risk") >= F.col("risk_at")) | ((F.col("confidence") < F.col("confidence_at")) & (F.col("overall_risk") >= C.DEEP["floor"])) | (F.col("consequence_score") >= C.DEEP["consequence"]) | (F.col("action_criticality") >= C.DEEP["criticality"])
    touched = deep & (F.col("decision") != "ALLOW")
    return each.groupBy("candidate", "risk_at", "confidence_at").agg(
        rate(deep).alias("deep_rate"), _safe(F.count_if(touched & F.col("truly_risky")), F.count_if("truly_risky")).alias("recall"), _safe(F.count_if(touched & F.col("truly_risky")), F.count_if(touched)).alias("precision"),
        _safe(F.count_if(touched & ~F.col("truly_risky")), F.count_if(~F.col("truly_risky"))).alias("fpr"), rate(deep & F.col("decision").isin("HUMAN_REVIEW", "BLOCK")).alias("review_rate"),
    )


LIMITS = (("recall", ">=", 0.90), ("fpr", "<=", 0.60), ("review_rate", "<=", 0.70))


def violations(candidates: DataFrame) -> DataFrame:
    broken = [F.when((F.col(n) < v) if op == ">=" else (F.col(n) > v), n) for n, op, v in LIMITS]
    return candidates.withColumn("violations", F.concat_ws(",", *broken))


def select_candidate(candidates: DataFrame) -> DataFrame:
    """Safety first: among candidates without violations the least work, then recall, precision and name; else the safest."""
    ordered = violations(candidates).orderBy(F.col("violations") != "", F.when(F.col("violations") != "", -F.col("recall")), "deep_rate", F.desc("recall"), F.desc("precision"), "candidate")
    return ordered.limit(1)


def comparison(candidates: DataFrame, current: int = 0) -> DataFrame:
    """Every candidate against the current one."""
    base = candidates.filter(F.col("candidate") == current).select(*(F.col(c).alias(f"c_{c}") for c in ("deep_rate", "recall", "precision")))
    return candidates.crossJoin(F.broadcast(base)).select("candidate", *(r4(F.col(c) - F.col(f"c_{c}")).alias(f"delta_{c}") for c in ("deep_rate", "recall", "precision")))


def simulate_policies(scored: DataFrame) -> DataFrame:
    """Tier of every interaction under every policy profile, and whether profiles differ. Detector outputs are reused."""
    each = scored.withColumn("as_profile", F.explode(F.array(*map(F.lit, C.PROFILES))))
    tiers = D.decide(each, profile="as_profile").select("interaction_id", "as_profile", "t10")
    wide = tiers.groupBy("interaction_id").agg(*(F.max(F.when(F.col("as_profile") == p, F.col("t10"))).cast("int").alias(p) for p in C.PROFILES))
    return wide.withColumn("differs", F.greatest(*C.PROFILES) != F.least(*C.PROFILES))


def counterfactual(rows: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Decisions before and after changing whitelisted input columns; rules added and removed."""
    allowed = {"amount", "affected_entities", "tool_calls", "retry_count", "tokens_in", "tokens_out", "latency_ms", "action_type"}
    if unknown := set(changes) - allowed:
        raise ValueError(f"columns that may not be changed: {sorted(unknown)}")
    part = lambda df: D.decide(D.signals(df)).select("interaction_id", "decision", "overall_risk", "triggered_rules")
    old, new = part(rows), part(rows.withColumns({k: F.expr(v) for k, v in changes.items()})).withColumnsRenamed({c: f"new_{c}" for c in ("decision", "overall_risk", "triggered_rules")})
    listed = lambda c: F.filter(F.split(F.col(c), ","), lambda x: x != "")
    joined = old.join(new, "interaction_id")
    return joined.select(
        "interaction_id", "decision", "new_decision", r4(F.col("new_overall_risk") - F.col("overall_risk")).alias("delta"), F.array_join(F.array_sort(F.array_except(listed("new_triggered_rules"), listed("triggered_rules"))), ",").alias("added"),
        F.array_join(F.array_sort(F.array_except(listed("triggered_rules"), listed("new_triggered_rules"))), ",").alias("removed"),
    )


def against_labels(said: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: what a detector ``said`` (boolean) of the rows that a label tells the ``truth`` of. Rows without a label, and
    labels without a row, take no part; ratios without a base are null."""
    said_, truth = F.col("said"), F.col("truth")
    cells = {"tp": said_ & truth, "fp": said_ & ~truth, "fn": ~said_ & truth, "tn": ~said_ & ~truth}
    counts = labels.filter(truth.isNotNull()).join(said, key).agg(*(many(c).alias(n) for n, c in cells.items()))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", r4(F.try_divide(tp, tp + fp)).alias("precision"), r4(F.try_divide(tp, tp + fn)).alias("recall"), r4(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"))
