"""Decisions from texts: what a response says, checked against its context, meets cost, stakes, policy and its session.

The order is the engine's: responsibility, routing on a shallow check, the deep check where routing asks for it, fusion,
the session's carried risk, policy. Critical personal data decides by itself, so its texts are not checked against evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions import lexicons as L
from vigil.functions.columns import spread
from vigil.operators import grounding as G
from vigil.operators import responsibility as R
from vigil.operators import routing as V
from vigil.plans import decide as D
from vigil.streaming import session as X

#: A response that a hard boundary decides: risk, confidence; no claims, no evidence.
BYPASS_RISK, BYPASS_CONFIDENCE = 0.50, 0.30
KEY = "interaction_id"
#: Usage and action of a turn, for tables that hold texts only: sizes come from the texts, the rest from the ids.
USAGE: list[D.Layer] = [
    [
        ("application", "CASE session_id % 3 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(C.APPLICATIONS)) + " END"),
        ("model", "CASE session_id % 4 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(C.MODELS)) + " END"),
        ("action_type", f"CASE {KEY} % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(C.ACTIONS)) + " END"),
        ("tokens_in", "CAST(ceil((length(prompt) + length(context)) / 4e0) AS BIGINT)"), ("tokens_out", "CAST(ceil(length(response) / 4e0) AS BIGINT)"),
        ("tool_calls", "0"), ("retry_count", "0"), ("affected_entities", "1"),
        ("amount", "coalesce(array_max(transform(regexp_extract_all(response, '(?<![0-9])([0-9]{1,7})(?![0-9])', 1), x -> CAST(x AS DOUBLE))), 0e0)"),
    ],
    [("latency_ms", "100e0 + 4e0 * tokens_out")],
]
KEPT = "session_id timestamp application model action_type tokens_in tokens_out tool_calls retry_count affected_entities amount latency_ms".split()
SIGNALS = "pii_risk critical_pii toxicity_risk toxic_critical bias_risk resp_raw resp_conf pii_keys pii_severity cascade_outcome cascade_deep complexity".split()


def acting(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn and texts) with usage and action of ``USAGE``."""
    named = turns.withColumns({"session_id": F.col("conv_id"), KEY: F.col("conv_id") * 100_000 + F.col("turn"), "response": F.coalesce("response", F.lit(""))})
    return D.add(named, USAGE)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Every assistant turn as an interaction; a conversation is a session. Turns are numbered below 100 000."""
    t = G.turns(conversations)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + 3600 * F.col("conv_id") + F.col("turn"))
    return D.add(t.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 100_000 + F.col("turn")).alias(KEY), at.alias("timestamp"), "prompt", "context", F.coalesce("response", F.lit("")).alias("response")), USAGE)


def from_documents(documents: DataFrame, per_session: int = 10) -> DataFrame:
    """Every document as a response without prompt and context; ten ids in a row are a session. Null ids are left out."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    rows = spread(documents.filter("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id")
    text = F.coalesce("text", F.lit("")).alias("response")
    return D.add(rows.select(F.floor(F.col("doc_id") / per_session).alias("session_id"), F.col("doc_id").alias(KEY), at.alias("timestamp"), F.lit("").alias("prompt"), F.lit("").alias("context"), text), USAGE)


def from_documents_in_context(documents: DataFrame, per_session: int = 10) -> DataFrame:
    """Documents as responses with evidence: their own text, the next document of their source, or none, by turns of ids.

    So personal data, toxicity, claims that hold, claims that do not, and claims without evidence meet in one table.
    Null ids are left out, as in ``from_documents``.
    """
    named = documents.filter("doc_id IS NOT NULL").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    # a hundred ids of a source at a time: neighbours are near, and no source is one task
    near = Window.partitionBy("source", F.floor(F.col("doc_id") / 100)).orderBy("doc_id", "text")
    own, other = F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1
    rows = named.withColumn("context", F.when(own, F.col("text")).when(other, F.coalesce(F.lead("text").over(near), F.lit(""))).otherwise(""))
    rows = spread(rows.select("doc_id", "text", "context"), "doc_id")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    key = [F.floor(F.col("doc_id") / per_session).alias("session_id"), F.col("doc_id").alias(KEY), at.alias("timestamp")]
    return D.add(rows.select(*key, F.lit("").alias("prompt"), "context", F.col("text").alias("response")), USAGE)


def detected(rows: DataFrame) -> DataFrame:
    """Signals of every interaction at both depths, without its texts; ids name rows. One shuffle."""
    found = R.assess(rows, "response", "action_type")
    worst = F.array_max(F.transform("findings", lambda f: F.array_position(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), R.severity(f["subtype"], F.col("action_type")))))
    found = found.withColumns({"resp_raw": F.col("responsibility_risk"), "resp_conf": F.col("responsibility_confidence"), "pii_keys": R.entity_keys(F.col("findings")), "pii_severity": F.coalesce(worst.cast("int"), F.lit(0))})
    routed = V.cascade_by(found)
    # a hard boundary: no claims are looked for
    routed = routed.withColumn("response", F.when(~F.col("critical_pii"), F.col("response"))).withColumn("has_context", F.size(G.sentences(F.col("context"))) > 0)
    return G.graded(routed, [KEY], "response", "context", (G.SHALLOW, G.DEEP), [*KEPT, *SIGNALS, "has_context"])


def severe(rows: DataFrame) -> DataFrame:
    """What ``decisions`` says of toxicity alone, from interactions with their texts: (usage, toxicity_risk, severe, decision).

    A toxicity at its profile's limit blocks, and no later rule lowers that (``D.policy_layers``), so neither evidence nor
    cost nor the session takes part; ``decision`` is null for all other rows.
    """
    counted = rows.withColumns(R.toxicity(F.col("response")))
    risk, _ = R.toxicity_risk({k: F.col(f"n_{k}") for k in L.TOXIC})
    return D.blocked_by_toxicity(counted.select(KEY, "application", "action_type", "tokens_out", risk.alias("toxicity_risk")))


def _performance(depth: int) -> dict[str, Column]:
    """Performance inputs of the fusion at one depth, or those of a hard boundary."""
    hard = F.col("critical_pii")
    return {
        "perf_raw": F.when(hard, BYPASS_RISK).otherwise(F.col(f"performance_risk{depth}")), "perf_conf": F.when(hard, BYPASS_CONFIDENCE).otherwise(F.col(f"confidence{depth}")),
        "perf_status": F.when(hard, "UNVERIFIED").otherwise(F.col(f"status{depth}")), "evidence_quality": F.when(hard, 0.0).otherwise(F.col(f"evidence_quality{depth}")),
        "neutral_rate": F.when(hard, 0.0).otherwise(F.col(f"neutral_rate{depth}")), "evidence_available": ~hard & F.col("has_context"),
    }


def scored(signals: DataFrame) -> DataFrame:
    """Routing on the shallow check, then fused risk on the check that routing chose. ``signals`` is read twice: store it."""
    priced = D.add(signals, D.PRICE)
    base = D.add(priced.join(F.broadcast(D.baselines(priced)), list(D.SEGMENT), "left"), D.COST + D.STAKES)
    first = D.add(base.withColumns(_performance(G.SHALLOW)), D.FUSE)
    hard, gates = F.col("critical_pii"), F.col("deep_trigger_reasons")
    # a boundary that the cascade itself finds is for the policy to judge: it asks for no deeper check
    cascade = F.when(F.col("cascade_deep") & (F.col("cascade_outcome") != "VIOLATION"), "TIER1_CASCADE_COMPLEXITY")
    reasons = F.when(hard, "DETERMINISTIC_HARD_BOUNDARY").otherwise(F.concat_ws(",", F.when(gates != "", gates), cascade))
    routed = {"preliminary_risk": F.col("overall_risk"), "preliminary_confidence": F.col("confidence"), "routing_disagreement": F.col("disagreement"), "routing_reasons": reasons}
    first = first.withColumns(routed).withColumn("deep", F.col("routing_reasons") != "")
    shallow, deep = _performance(G.SHALLOW), _performance(G.DEEP)
    second = D.add(first.withColumns({k: F.when(F.col("deep"), deep[k]).otherwise(shallow[k]) for k in deep}), D.FUSE)
    return second.withColumns({"disagreement": F.col("routing_disagreement"), "deep_trigger_reasons": F.col("routing_reasons"), "verification_path": F.when(F.col("deep"), "DEEP").otherwise("FAST")})


OUT = [*D.DECISION, *SIGNALS, "preliminary_risk", "preliminary_confidence", "claims", "pre_session_risk", "session_risk", "session_escalated", "session_turn", "critical_trigger"]


def decisions(rows: DataFrame) -> DataFrame:
    """Decisions over scored interactions with the session's carried risk. ``rows`` is read twice: store it."""
    carried = X.batch(X.with_tiers(rows)).select(KEY, "adjusted", "session_risk", F.col("escalated").alias("session_escalated"), F.col("turn").alias("session_turn"))
    joined = rows.join(carried, KEY).withColumn("pre_session_risk", F.col("overall_risk")).withColumn("overall_risk", F.col("adjusted"))
    out = D.decide(joined)
    more = lambda c, name: F.concat_ws(",", F.when(F.col(c) != "", F.col(c)), F.when(F.col("session_escalated"), name))
    trigger = F.when(F.col("critical_pii"), "CRITICAL_PII").when(F.col("toxic_critical"), "SEVERE_TOXICITY").when(F.col("decision") == "BLOCK", "BLOCK")
    return out.withColumns({"triggered_rules": more("triggered_rules", "SESSION_RISK_ESCALATION"), "reason_codes": more("reason_codes", "SESSION_ESCALATION"), "critical_trigger": trigger}).select(*OUT)


def snapshots(decided: DataFrame) -> DataFrame:
    """One row for each session: peaks, entity keys, counts of reason codes, rules that moved a tier, critical turns and floor."""
    codes = F.array_distinct(F.split("reason_codes", ","))
    counted = decided.select("session_id", F.explode(codes).alias("code")).filter("code <> ''").groupBy("session_id", "code").agg(F.count(F.lit(1)).alias("n"))
    listed = counted.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "code", "n"))), ",").alias("reason_code_counts"))
    peaks = decided.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns_recorded"), *(F.max(f"{n}_risk").alias(f"peak_{n}_risk") for n in C.FUSION), F.count("critical_trigger").alias("critical_events"),
        F.when(F.count("critical_trigger") > 0, C.SESSION["floor"]).otherwise(0.0).alias("critical_floor"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pii_keys")))), ",").alias("pii_entity_keys"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("tier_changing_rules", ","))))), ",").alias("_rules"),
    )
    rules = F.array_join(F.filter(F.split("_rules", ","), lambda r: ~r.isin("", "RISK_BAND")), ",")
    return peaks.withColumn("tier_changing_rules", rules).drop("_rules").join(listed, "session_id", "left").withColumn("reason_code_counts", F.coalesce("reason_code_counts", F.lit("")))


def critical_turns(decided: DataFrame) -> DataFrame:
    """The critical turns of all sessions, with what made them so."""
    return decided.filter("critical_trigger IS NOT NULL").select("session_id", "session_turn", KEY, "decision", "critical_trigger", F.col("overall_risk").alias("risk_at_event"))
