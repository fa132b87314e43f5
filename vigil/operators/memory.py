"""What a session remembers before each of its turns: a snapshot of all earlier turns, as of that turn.

A turn only has memory columns if they say something: more than one earlier turn, or a critical one among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import codes

PEAKS = ("performance", "responsibility", "cost")
#: Columns that are null for turns without a memory worth showing.
COLUMNS = ("turns_recorded", "critical_events", "last_critical_turn", "critical_floor", "floor_applied", *(f"peak_{p}_risk" for p in PEAKS), "pii_entity_keys", "reason_code_counts", "tier_changing_rules")


def _firsts(decided: DataFrame, column: Column, value: str) -> DataFrame:
    """The turn at which each value of a list column first comes up in its session."""
    each = decided.select("session_id", "session_turn", F.explode(column).alias(value)).filter(F.col(value) != "")
    return each.groupBy("session_id", value).agg(F.min("session_turn").alias("session_turn"))


def _as_of(firsts: DataFrame, value: str, turns: DataFrame, name: str) -> DataFrame:
    """(session_id, session_turn, name): sorted values that came up before each turn.

    Only turns at which something new comes up add to a set, and a set holds different values only, however long a session.
    """
    added = firsts.groupBy("session_id", "session_turn").agg(F.collect_set(value).alias("_new"))
    before = Window.partitionBy("session_id").orderBy("session_turn").rowsBetween(Window.unboundedPreceding, -1)
    joined = turns.join(added, ["session_id", "session_turn"], "left")
    held = F.array_sort(F.flatten(F.collect_list("_new").over(before)))
    return joined.select("session_id", "session_turn", held.alias(name))


def _code_counts(decided: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, session_turn, counts): how often each reason code came up before a turn, as ``code:n`` in order.

    A code's running count is a window over its own turns; a turn then looks each of its session's codes up.
    """
    every = sorted(_code_names())
    hit = lambda c: F.sum(F.array_contains(codes("reason_codes"), c).cast("long"))
    before = Window.partitionBy("session_id").orderBy("session_turn").rowsBetween(Window.unboundedPreceding, -1)
    counted = decided.select("session_id", "session_turn", *(F.coalesce(hit(c).over(before), F.lit(0)).alias(f"_{c}") for c in every))
    shown = F.concat_ws(",", *(F.when(F.col(f"_{c}") > 0, F.concat_ws(":", F.lit(c), F.col(f"_{c}"))) for c in every))
    return turns.join(counted.select("session_id", "session_turn", shown.alias("reason_code_counts")), ["session_id", "session_turn"])


def _code_names() -> set[str]:
    """All reason codes that the policy can give; a fixed list, so counts are columns and not rows."""
    return {
        "HIGH_CONSEQUENCE", "CONTRADICTED_EVIDENCE", "LOW_VERIFICATION_COVERAGE", "HIGH_RESPONSIBILITY_RISK", "LOW_CONFIDENCE_HIGH_RISK", "CRITICAL_PII", "TOXICITY", "COST_SPIKE", "HIGH_PERFORMANCE_RISK", "MULTI_RISK",
        "HIGH_FINANCIAL_IMPACT", "IRREVERSIBLE_ACTION", "HIGH_BLAST_RADIUS", "AUTOMATED_EXTERNAL_ACTION", "RETRY_ANOMALY", "TOOL_LOOP", "LATENCY_ANOMALY", "SESSION_ESCALATION",
    }


def before_each_turn(decided: DataFrame) -> DataFrame:
    """(session_id, session_turn, interaction_id, ``COLUMNS``) for every decision, from the turns before it.

    ``decided`` has a turn number that is unique in its session. Its lists are comma-joined, entity keys an array.
    The floor was applied if a critical turn came before and the turn's own risk lay under it.
    """
    turns = decided.select("session_id", "session_turn")
    before = Window.partitionBy("session_id").orderBy("session_turn").rowsBetween(Window.unboundedPreceding, -1)
    critical = F.col("critical_trigger").isNotNull()
    events = F.count(F.when(critical, 1)).over(before)
    base = decided.select(
        "session_id", "session_turn", "interaction_id", F.count(F.lit(1)).over(before).alias("turns_recorded"), events.alias("critical_events"),
        F.max(F.when(critical, F.col("session_turn"))).over(before).alias("last_critical_turn"), F.when(events > 0, C.SESSION["floor"]).otherwise(0.0).alias("critical_floor"),
        ((events > 0) & (F.col("pre_session_risk") < C.SESSION["floor"])).alias("floor_applied"), *(F.max(f"{p}_risk").over(before).alias(f"peak_{p}_risk") for p in PEAKS),
    )
    keys = _as_of(_firsts(decided, F.col("pii_keys"), "k"), "k", turns, "pii_entity_keys")
    moved = F.filter(codes("tier_changing_rules"), lambda r: r != "RISK_BAND")
    rules = _as_of(_firsts(decided, moved, "r"), "r", turns, "tier_changing_rules")
    out = base
    for more in (keys, _code_counts(decided, turns), rules):
        out = out.join(more, ["session_id", "session_turn"])
    worth = (F.col("turns_recorded") > 1) | (F.col("critical_events") > 0)
    return out.select("session_id", "session_turn", "interaction_id", *(F.when(worth, F.col(c)).alias(c) for c in COLUMNS))
