"""Governance: reviewer actions and feedback against decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import before, cut_key, many, mean, r4, rate

STATUS = {"ACKNOWLEDGE": "ACKNOWLEDGED", "APPROVE_DECISION": "REVIEWED", "MODIFY_DECISION": "REVIEWED", "REJECT_DECISION": "REVIEWED", "ESCALATE": "ESCALATED", "CLOSE": "CLOSED"}
#: Actions that each status allows.
ALLOWED = {
    "OPEN": ("ACKNOWLEDGE", "APPROVE_DECISION", "MODIFY_DECISION", "REJECT_DECISION", "ESCALATE"), "ACKNOWLEDGED": ("APPROVE_DECISION", "MODIFY_DECISION", "REJECT_DECISION", "ESCALATE", "CLOSE"),
    "REVIEWED": ("ESCALATE", "CLOSE"), "ESCALATED": ("APPROVE_DECISION", "MODIFY_DECISION", "REJECT_DECISION", "CLOSE"), "CLOSED": (),
}
VERBS = {"F": "APPROVE_DECISION", "O": "MODIFY_DECISION", "P": "REJECT_DECISION"}


def actions(orders: DataFrame, traffic: int) -> DataFrame:
    """Adapter: orders as a log of reviewer actions on ``traffic`` interactions."""
    verb = F.when(F.col("o_orderstatus") == "F", "APPROVE_DECISION").when(F.col("o_orderstatus") == "O", "MODIFY_DECISION").otherwise("REJECT_DECISION")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    tier = F.element_at(F.array(*map(F.lit, C.TIERS)), rank)
    return orders.select(
        F.col("o_orderkey").alias("action_id"), (F.col("o_orderkey") % traffic).alias("interaction_id"), F.col("o_orderdate").alias("timestamp"), verb.alias("action"),
        F.when(verb == "MODIFY_DECISION", tier).alias("reviewer_decision"),
    )


def feedback(lineitem: DataFrame, traffic: int) -> DataFrame:
    """Adapter: line items as reviewer feedback."""
    outcome = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "N", "modified").otherwise("rejected")
    return lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("feedback_id"), (F.col("l_orderkey") % traffic).alias("interaction_id"), outcome.alias("outcome"))


def effective(d: DataFrame, log: DataFrame) -> DataFrame:
    """Decision in force: the latest MODIFY with a tier, else the system's."""
    last = log.filter("action = 'MODIFY_DECISION' and reviewer_decision is not null").groupBy("interaction_id").agg(F.max_by("reviewer_decision", "action_id").alias("modified"))
    out = d.join(last, "interaction_id", "left")
    return out.select("interaction_id", "application", "decision", F.coalesce("modified", "decision").alias("effective"), F.coalesce(F.col("modified") != F.col("decision"), F.lit(False)).alias("overridden"))


def status_of(action: Column) -> Column:
    return F.coalesce(*(F.when(action == a, s) for a, s in STATUS.items()))


def human_governance(d: DataFrame, log: DataFrame) -> DataFrame:
    """Interactions by current status: that of their last action, else OPEN."""
    last = log.groupBy("interaction_id").agg(F.max_by(status_of(F.col("action")), "action_id").alias("status"))
    return d.join(last, "interaction_id", "left").groupBy(F.coalesce("status", F.lit("OPEN")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def transition_check(log: DataFrame) -> DataFrame:
    """Actions that the status before them allows, or not, by status and action."""
    order = Window.partitionBy("interaction_id").orderBy("action_id")
    seen = log.withColumn("previous", F.coalesce(F.lag(status_of(F.col("action"))).over(order), F.lit("OPEN")))
    legal = F.lit(False)
    for status, verbs in ALLOWED.items():
        legal = legal | ((F.col("previous") == status) & F.col("action").isin(*verbs)) if verbs else legal
    missing = (F.col("action") == "MODIFY_DECISION") & F.col("reviewer_decision").isNull()
    return seen.withColumn("ok", legal & ~missing).groupBy("previous", "action").agg(F.count(F.lit(1)).alias("n"), many(~F.col("ok")).alias("violations"))


def reviewer_disagreement(d: DataFrame, log: DataFrame) -> DataFrame:
    """Modifications to another tier, by transition."""
    changed = log.filter("action = 'MODIFY_DECISION'").join(d.select("interaction_id", "decision"), "interaction_id").filter(F.col("reviewer_decision") != F.col("decision"))
    return changed.groupBy(F.concat_ws(" -> ", "decision", "reviewer_decision").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def application_comparison(d: DataFrame, log: DataFrame) -> DataFrame:
    """Rates of every application, with its override rate among reviewed interactions; actions without a decision are left out."""
    base = d.groupBy("application").agg(
        F.count(F.lit(1)).alias("total"), mean("overall_risk").alias("mean_risk"), mean("decision_confidence").alias("mean_confidence"), rate(F.col("decision") != "ALLOW").alias("intervention_rate"),
        rate(F.col("decision") == "HUMAN_REVIEW").alias("review_rate"), rate(F.col("decision") == "BLOCK").alias("block_rate"), rate(F.col("verification_path") == "DEEP").alias("deep_rate"), rate(F.col("multi_risk")).alias("multi_risk_rate"),
    )
    joined = log.join(d.select("interaction_id", "application", "decision"), "interaction_id")
    over = joined.groupBy("application").agg(F.count(F.lit(1)).alias("actions"), rate(F.coalesce((F.col("action") == "MODIFY_DECISION") & (F.col("reviewer_decision") != F.col("decision")), F.lit(False))).alias("override_rate"))
    return base.join(over, "application", "left").na.fill({"actions": 0})


def signals(d: DataFrame, log: DataFrame, notes: DataFrame) -> DataFrame:
    """Reviewer actions and feedback as one signal table with the decision's application, 'unknown' without one."""
    kinds = {"APPROVE_DECISION": "approval", "MODIFY_DECISION": "modification", "REJECT_DECISION": "rejection"}
    acted = log.select("interaction_id", F.lit("action").alias("source"), F.coalesce(*(F.when(F.col("action") == a, k) for a, k in kinds.items())).alias("kind"))
    noted = notes.select("interaction_id", F.lit("feedback").alias("source"), F.when(F.col("outcome") == "approved", "approval").when(F.col("outcome") == "modified", "modification").otherwise("rejection").alias("kind"))
    return acted.unionByName(noted).join(d.select("interaction_id", "application", "decision"), "interaction_id", "left").withColumn("application", F.coalesce("application", F.lit("unknown")))


def signal_summary(found: DataFrame) -> DataFrame:
    """Counts by application, by decision, by kind and over all, in one pass."""
    rows = found.groupingSets([["application"], ["decision"], ["kind"], []], "application", "decision", "kind").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), rate(F.col("kind") == "modification").alias("modification_rate"), rate(F.col("kind") == "rejection").alias("rejection_rate"))
    scope = F.when(F.col("g") == 3, "application").when(F.col("g") == 5, "decision").when(F.col("g") == 6, "kind").otherwise("all")
    return rows.select(scope.alias("scope"), F.coalesce("application", "decision", "kind", F.lit("-")).alias("name"), "n", "modification_rate", "rejection_rate")


def feedback_aggregate(notes: DataFrame, d: DataFrame) -> DataFrame:
    """Feedback on known interactions: outcomes, rates and different interactions."""
    known = notes.join(d.select("interaction_id"), "interaction_id", "left_semi")
    return known.agg(
        F.count(F.lit(1)).alias("n"), *(many(F.col("outcome") == o).alias(f"n_{o}") for o in ("approved", "modified", "rejected")), rate(F.col("outcome") == "approved").alias("approval_rate"),
        rate(F.col("outcome") != "approved").alias("override_rate"), F.count_distinct("interaction_id").alias("interactions"),
    )


def reviewer_confusion(d: DataFrame, log: DataFrame) -> DataFrame:
    """System tier by reviewer tier, and whether the reviewer went up or down."""
    joined = log.filter("reviewer_decision is not null").join(d.select("interaction_id", "decision"), "interaction_id")
    rank = lambda c: F.array_position(F.array(*map(F.lit, C.TIERS)), F.col(c))
    move = F.when(rank("reviewer_decision") > rank("decision"), "escalation").when(rank("reviewer_decision") < rank("decision"), "de-escalation").otherwise("same")
    return joined.groupBy("decision", "reviewer_decision", move.alias("move")).agg(F.count(F.lit(1)).alias("n"))


#: Rates of an application that stand out: code, rate, limit (fixed values).
STANDING_OUT = (("HIGH_OVERRIDE_RATE", "override_rate", 0.30), ("HIGH_HUMAN_REVIEW_RATE", "oversight_rate", 0.35), ("LOW_CONFIDENCE_TREND", "low_confidence_rate", 0.25), ("DEEP_ROUTING_CONCENTRATION", "deep_rate", 0.85))


def _overridden() -> Column:
    return F.coalesce((F.col("action") == "MODIFY_DECISION") & (F.col("reviewer_decision") != F.col("decision")), F.lit(False))


def insights(d: DataFrame, log: DataFrame, volume: int = 10) -> DataFrame:
    """Applications of some volume whose rates stand out, how far, and the three riskiest interactions as examples."""
    more = d.groupBy("application").agg(rate(F.col("decision").isin("HUMAN_REVIEW", "BLOCK")).alias("oversight_rate"), rate(F.col("decision_confidence") < C.LOW_CONFIDENCE).alias("low_confidence_rate"))
    rates = application_comparison(d, log).filter(F.col("total") >= volume).join(more, "application")
    found = F.inline(F.array(*(F.struct(F.lit(k).alias("insight"), F.col(c).alias("value"), F.lit(v).alias("threshold")) for k, c, v in STANDING_OUT)))
    rows = rates.select("application", found).filter("value > threshold")
    times = F.col("value") / F.col("threshold")
    rows = rows.withColumn("severity", F.when(times >= 1.6, "HIGH").when(times >= 1.25, "MEDIUM").otherwise("LOW"))
    best = Window.partitionBy("application").orderBy(F.desc("overall_risk"), "interaction_id")
    three = d.select("application", "interaction_id", F.row_number().over(best).alias("r")).filter("r <= 3")
    examples = three.groupBy("application").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "interaction_id"))), lambda x: x["interaction_id"].cast("string")), ",").alias("examples"))
    return rows.join(examples, "application")


def recommendations(d: DataFrame, log: DataFrame, volume: int = 10) -> DataFrame:
    """(recommendation, application, value): thresholds of all where people are asked often and seldom disagree, the policy
    of applications that reviewers overrule, the detectors of those that are unsure; NO_ACTION where there is none."""
    oversight = d.agg(rate(F.col("decision").isin("HUMAN_REVIEW", "BLOCK")).alias("value"))
    override = log.join(d.select("interaction_id", "decision"), "interaction_id").agg(rate(_overridden()).alias("override"))
    whole = oversight.crossJoin(F.broadcast(override)).filter("value > 0.35 and (override is null or override < 0.20)")  # one row each
    kinds = F.when(F.col("insight") == "HIGH_OVERRIDE_RATE", "REVIEW_POLICY").when(F.col("insight") == "LOW_CONFIDENCE_TREND", "REVIEW_DETECTOR")
    named = insights(d, log, volume).select(kinds.alias("recommendation"), "application", "value").filter("recommendation is not null")
    named = named.unionByName(whole.select(F.lit("REVIEW_THRESHOLD").alias("recommendation"), F.lit(None).cast("string").alias("application"), "value"))
    none = named.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("NO_ACTION").alias("recommendation"), F.lit(None).cast("string").alias("application"), F.lit(None).cast("double").alias("value"))
    return named.unionByName(none)


def overridden_by_half(d: DataFrame, actions: DataFrame) -> DataFrame:
    """Different overridden decisions of either half of the traffic, in time order."""
    over = actions.filter((F.col("action") == "MODIFY_DECISION") & F.col("reviewer_decision").isNotNull()).select("interaction_id").distinct()
    first = before(cut_key(d, d.count() // 2))
    halves = d.join(over, "interaction_id", "left_semi").select("interaction_id", F.when(first, "first").otherwise("second").alias("half")).distinct()
    names = d.sparkSession.createDataFrame([("first",), ("second",)], "half string")
    return names.join(halves.groupBy("half").agg(F.count(F.lit(1)).alias("overridden")), "half", "left").select("half", F.coalesce("overridden", F.lit(0)).cast("long").alias("overridden"))
