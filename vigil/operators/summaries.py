"""One-row and short summaries over decisions: verification, sessions, reviewers, comparison picks, posture, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import before, codes, cut_key, many, mean, r4, rate
from vigil.operators import incidents as I
from vigil.operators import monitoring as M
from vigil.operators import replay as P

# fixed values: shares of a rule among moves to BLOCK and of an application among risky traffic that stand out
RULE_SHARE, APPLICATION_SHARE, LEAST = 0.50, 0.50, 5
#: Metrics of which a fall, not a rise, makes things worse.
BETTER_HIGH = ("average_confidence",)


def bypassed() -> Column:
    return F.array_contains(codes("deep_trigger_reasons"), "DETERMINISTIC_HARD_BOUNDARY")


def verification(d: DataFrame, took: Column | None = None) -> DataFrame:
    """One row: fast and deep counts, rates and mean latency, bypasses among the deep ones and the time they saved.

    ``took`` is what verification took (the whole latency by default). A bypass saves what a full deep check takes on
    average; nothing is claimed (null) without bypasses or without a full deep check.
    """
    took = F.col("latency_ms") if took is None else took
    fast = F.upper(F.coalesce("verification_path", F.lit("DEEP"))) == "FAST"
    full = ~fast & ~bypassed() & (took > 0)
    part = d.agg(
        many(fast).alias("fast"), many(~fast).alias("deep"), rate(fast).alias("fast_rate"), rate(~fast).alias("deep_rate"),
        r4(F.avg(F.when(fast, took))).alias("mean_fast_ms"), r4(F.avg(F.when(~fast, took))).alias("mean_deep_ms"),
        many(~fast & bypassed()).alias("bypassed"), F.avg(F.when(full, took)).alias("_full"),
    )
    share = r4(F.coalesce(F.try_divide("bypassed", "deep"), F.lit(0.0)))
    saved = F.when((F.col("bypassed") > 0) & F.col("_full").isNotNull(), r4(F.col("bypassed") * F.round("_full", 6), 3))
    return part.withColumns({"bypassed_of_deep": share, "saved_ms": saved}).drop("_full")


def sessions(d: DataFrame) -> DataFrame:
    """One row: sessions, those of two turns or more, those of them with a critical turn, and all critical turns."""
    critical = (F.col("decision") == "BLOCK") | F.array_contains(codes("reason_codes"), "CRITICAL_PII")
    by = d.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(critical).alias("events"))
    several = F.col("turns") >= 2
    out = by.agg(F.count(F.lit(1)).alias("sessions"), many(several).alias("multi_turn"), many(several & (F.col("events") > 0)).alias("hit_floor"), F.coalesce(F.sum("events"), F.lit(0)).alias("critical_events"))
    return out.withColumn("hit_rate", r4(F.try_divide("hit_floor", "multi_turn")))


def reviewers(log: DataFrame) -> DataFrame:
    """(kind, name, n, share): overrides among reviews, tiers that reviewers chose, and changes of tier.

    ``log`` has the tier that each action was about; reviews are modifications, approvals and rejections.
    """
    acts = log.filter(F.col("action").isin("APPROVE_DECISION", "MODIFY_DECISION", "REJECT_DECISION"))
    rejected = F.col("action") == "REJECT_DECISION"
    chosen = F.when(~rejected, F.col("reviewer_decision"))
    moved = F.coalesce(chosen != F.col("original_decision"), F.lit(False))
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    every = F.array(
        F.when(rejected | moved, pair("override", F.lit("any"))), F.when(chosen.isNotNull(), pair("reviewer_decision", chosen)), F.when(moved, pair("transition", F.concat_ws(" -> ", "original_decision", chosen))),
    )
    total = acts.agg(F.count(F.lit(1)).alias("reviewed"))
    counted = acts.select(F.inline(F.filter(every, lambda x: x.isNotNull()))).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(total), F.lit(True)).select("kind", "name", "n", r4(F.col("n") / F.col("reviewed")).alias("share"))  # one row


def picks(d: DataFrame) -> DataFrame:
    """One row: the applications of highest risk, of most traffic, and of least oversight; ties to the first name."""
    by = d.groupBy("application").agg(mean("overall_risk").alias("risk"), F.count(F.lit(1)).alias("volume"), rate(F.col("decision").isin("HUMAN_REVIEW", "BLOCK")).alias("oversight"))
    first = lambda c, name: F.min(F.struct(c.alias("v"), "application"))["application"].alias(name)
    return by.agg(first(-F.col("risk"), "highest_risk"), first(-F.col("volume"), "highest_volume"), first(F.col("oversight"), "lowest_intervention"))


def posture(d: DataFrame) -> DataFrame:
    """One row: mean and high-risk count of each dimension, the dominant one (none without risk), and the trend of risk."""
    dims = ("performance", "responsibility", "cost", "overall")
    high = lambda n: many(F.col(f"{n}_risk") >= C.ELEVATED_RISK)
    one = d.agg(*(r4(F.avg(f"{n}_risk"), 6).alias(f"{n}_average") for n in dims), *(high(n).alias(f"{n}_high") for n in dims))
    best = F.array_min(F.array(*(F.struct((-F.col(f"{n}_average")).alias("less"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(dims[:3]))))
    one = one.withColumn("dominant_dimension", F.when(F.greatest(*(f"{n}_average" for n in dims[:3])) > 0, best["name"]))
    trend = M.half_trend(d).filter("metric = 'average_risk'").agg(F.max("direction").alias("risk_trend"))
    return one.join(F.broadcast(trend), F.lit(True))  # one row each


def escalated(turns: DataFrame) -> DataFrame:
    """One row over the session recurrence: sessions, those that ever escalated, and their share."""
    by = turns.groupBy("session_id").agg(F.bool_or("escalated").alias("up"), F.max("adjusted").alias("peak"))
    return by.agg(F.count(F.lit(1)).alias("sessions"), many(F.col("up")).alias("escalated"), rate(F.col("up")).alias("escalated_rate"), r4(F.avg("peak")).alias("mean_peak"))


def concentration(d: DataFrame) -> DataFrame:
    """(insight, subject, n, total, share, severity): the rule behind most moves to BLOCK, the application of most risky traffic.

    ``d`` still has the tier columns. Fewer than five such moves or rows say nothing, nor does traffic of one application.
    """
    moves = P.steps(d).filter("to_tier = 'BLOCK' and from_tier <> to_tier").groupBy(F.col("rule").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    risky = d.filter(F.col("overall_risk") >= C.ELEVATED_RISK).groupBy(F.col("application").alias("subject")).agg(F.count(F.lit(1)).alias("n"))

    def named(rows: DataFrame, insight: str, limit: float, several: bool) -> DataFrame:
        whole = rows.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        share = F.col("n") / F.col("total")
        kept = rows.join(F.broadcast(whole), F.lit(True)).filter((F.col("total") >= LEAST) & (share > limit) & (F.col("kinds") >= (2 if several else 1)))  # one row
        times = share / limit
        severity = F.when(times >= 1.6, "HIGH").when(times >= 1.25, "MEDIUM").otherwise("LOW")
        return kept.select(F.lit(insight).alias("insight"), "subject", "n", "total", r4(share).alias("share"), severity.alias("severity"))

    return named(moves, "RULE_DOMINANCE", RULE_SHARE, False).unionByName(named(risky, "RISK_CONCENTRATION", APPLICATION_SHARE, True))


def _halves(d: DataFrame, log: DataFrame) -> DataFrame:
    """Six metrics of the first half of the traffic and of the second; none of fewer than four rows."""
    n = d.count()
    changed = F.col("action").isin("APPROVE_DECISION", "MODIFY_DECISION") & (F.col("reviewer_decision") != F.col("original_decision"))
    over = log.filter((F.col("action") == "REJECT_DECISION") | F.coalesce(changed, F.lit(False)))
    marked = d.join(over.select("interaction_id").distinct().withColumn("_over", F.lit(1.0)), "interaction_id", "left")
    metrics = {
        "average_risk": F.col("overall_risk"), "average_confidence": F.col("decision_confidence"), "human_oversight_rate": F.col("decision").isin("HUMAN_REVIEW", "BLOCK").cast("double"),
        "deep_rate": (F.upper(F.coalesce("verification_path", F.lit("DEEP"))) == "DEEP").cast("double"),
        "incident_rate": (I.triggers() != "").cast("double"), "reviewer_override_rate": F.coalesce("_over", F.lit(0.0)),
    }
    return M.compare(marked.filter(F.lit(n >= 4)), before(cut_key(d, n // 2)) if n >= 4 else F.lit(False), metrics, I.DRIFT_BAND)


def _moves() -> dict[str, Column]:
    size, moved = F.abs("delta"), F.abs("delta") > I.DRIFT_BAND
    enough = (F.col("n_first") >= I.DRIFT_SAMPLES) & (F.col("n_second") >= I.DRIFT_SAMPLES)
    direction = F.when(~moved, "STABLE").when(F.col("delta") > 0, "INCREASING").otherwise("DECREASING")
    return {"moved": moved, "enough": enough, "drifts": moved & (size >= I.DRIFT_AT) & enough, "strong": moved & (size >= 2 * I.DRIFT_BAND), "direction": direction}


def trends(d: DataFrame, log: DataFrame) -> DataFrame:
    """(metric, baseline, current, delta, direction, label, severity): the first half of the traffic against the second.

    A large move over enough rows is potential drift (HIGH), one of twice the flat band a signal (MEDIUM if it makes
    things worse, else LOW), a smaller one a trend (LOW), none at all INFO. Fewer than four rows tell nothing.
    """
    m = _moves()
    worse = F.when(F.col("metric").isin(*BETTER_HIGH), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    label = F.when(m["drifts"], "POTENTIAL_DRIFT").when(m["strong"], "SIGNAL").otherwise("TREND")
    severity = F.when(m["drifts"], "HIGH").when(m["strong"] & worse, "MEDIUM").when(m["moved"], "LOW").otherwise("INFO")
    return _halves(d, log).select("metric", "baseline", F.col("recent").alias("current"), "delta", m["direction"].alias("direction"), label.alias("label"), severity.alias("severity"))


def drift_report(d: DataFrame, log: DataFrame) -> DataFrame:
    """Drift of the six metrics over all traffic, and of detectors, applications and the commonest rules by themselves."""
    m = _moves()
    signal = F.when(~m["moved"], "STABLE").when(m["drifts"], "POTENTIAL_DRIFT").otherwise("TREND")
    whole = _halves(d, log).select(F.lit("global").alias("scope"), "metric", "baseline", "recent", "delta", m["direction"].alias("direction"), signal.alias("signal"), m["enough"].alias("sufficient"))
    return whole.unionByName(I.drift(d).filter("scope <> 'global'"))


def timeline(d: DataFrame, log: DataFrame, found: DataFrame) -> DataFrame:
    """One event for each stage that an interaction went through, in a fixed order of stages, with its time and detail.

    A decision is made, perhaps becomes an incident, and is then acted on: each action is an event, in order of its id.
    """
    event = lambda order, stage, at, detail: (F.lit(order).alias("stage_order"), F.lit(stage).alias("stage"), at.cast("timestamp").alias("happened_at"), detail.alias("detail"))
    none = F.lit(0).cast("long").alias("seq")
    ts = F.col("timestamp")
    parts = [
        d.select("interaction_id", *event(1, "RECEIVED", ts, F.col("application")), none), d.select("interaction_id", *event(2, "VERIFIED", ts, F.col("verification_path")), none),
        d.select("interaction_id", *event(3, "DECIDED", ts, F.col("decision")), none), found.select("interaction_id", *event(4, "INCIDENT", ts, F.col("severity")), none),
        log.join(d.select("interaction_id"), "interaction_id", "left_semi").select("interaction_id", *event(5, "REVIEWED", ts, F.col("action")), F.col("action_id").cast("long").alias("seq")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("interaction_id").orderBy("stage_order", "seq", "detail")
    return out.select("interaction_id", F.row_number().over(order).alias("position"), "stage", "happened_at", "detail")
