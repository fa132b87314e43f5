"""Risk carried over the turns of a session, in batch and as a stream.

The recorded risk is the adjusted one and a block raises a floor, so policy sits inside the recurrence. All other inputs
of the policy are known before: the tier for every risk band (five) and either answer to "risky enough to doubt a block"
is worked out with columns, and the recurrence looks its tier up.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil import config as C
from vigil.plans import decide as D

S = C.SESSION
BOUNDS = ("allow", "annotate", "verify", "review")
STATE = "cumulative double, recent array<double>, floor double, turns long"
OUT = "session_id long, interaction_id long, turn long, raw double, session_risk double, adjusted double, high_risk_events int, escalated boolean, tier int, cumulative double, floor double"


def with_tiers(scored: DataFrame) -> DataFrame:
    """Only what the recurrence needs: raw risk, band bounds, and the tier for each band and doubt (ten numbers)."""
    layers = [[(n, e) for n, e in layer if n not in ("t0", "triggered_rules", "tier_changing_rules", "decision", "base_tier", "reason_codes", "decision_confidence")] for layer in D.policy_layers()]
    layers = [[(n, e.replace("overall_risk >= at_unsure_risk", "unsure")) for n, e in layer] for layer in layers if layer]
    profiles = scored.sparkSession.createDataFrame(D.profile_rows(), ", ".join(f"{n} {t}" for n, t in D.PROFILE))
    base = scored.withColumn("profile", F.expr(D.PROFILE_OF.format("application"))).join(F.broadcast(profiles), "profile")
    # every layer once for each case: the ten tiers stand side by side in the row
    cases = [(str(unsure).lower(), band) for unsure in (False, True) for band in range(5)]
    named = lambda e, k: re.sub(r"\bt(\d+)\b", rf"t\1_{k}", re.sub(r"\bunsure\b", cases[k][0], e))
    every = [[(f"t0_{k}", str(band)) for k, (_, band) in enumerate(cases)]]
    for layer in layers:
        own = [(n, e) for n, e in layer if not re.fullmatch(r"t\d+", n)]
        every.append(own + [(f"{n}_{k}", named(e, k)) for n, e in layer if re.fullmatch(r"t\d+", n) for k in range(len(cases))])
    out = D.add(base, every).withColumn("tiers", F.array(*(F.col(f"t10_{k}").cast("int") for k in range(len(cases)))))
    return out.select("session_id", "timestamp", "interaction_id", "overall_risk", "at_unsure_risk", F.expr("critical_pii OR toxic_critical").alias("critical"), "tiers", F.array(*(F.col(f"at_{b}") for b in BOUNDS)).alias("bounds"))


def advance(state: tuple, r) -> tuple[tuple, tuple]:
    """The state after one turn ``r``, and that turn's row."""
    cumulative, recent, floor, turns = state
    risk = min(1.0, max(0.0, r.overall_risk))
    high = sum(x >= S["high"] for x in recent) + (risk >= S["high"])
    escalated = high >= S["events"]
    session = min(S["history"] * cumulative + S["current"] * risk + (S["bump"] if escalated else 0.0), S["most"])
    adjusted = max(risk, session)
    if escalated:
        adjusted = min(adjusted + S["bump"], S["most"])
    adjusted = round(min(max(adjusted, floor), S["most"]), 4)
    band = bisect.bisect_left(list(r.bounds), adjusted)  # limits belong to the lower band
    tier = int(r.tiers[5 * (adjusted >= r.at_unsure_risk) + band])
    cumulative = S["decay"] * cumulative + (1 - S["decay"]) * adjusted
    recent = [*recent, adjusted][-S["window"] :]
    if tier == 4 or r.critical:
        floor = max(floor, S["floor"])
    row = (r.session_id, r.interaction_id, turns + 1, risk, round(session, 4), adjusted, int(high), bool(escalated), tier, round(cumulative, 6), floor)
    return (cumulative, recent, floor, turns + 1), row


def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """Advance a session by its next turns, in order of time and id. Returns the new state and a row for each turn."""
    out = []
    for r in rows.sort_values(["timestamp", "interaction_id"]).itertuples():
        state, row = advance(state, r)
        out.append(row)
    return state, out


START = (0.0, [], 0.0, 0)
NAMES = [x.strip().split(" ")[0] for x in OUT.split(",")]


def in_order(rows: DataFrame, key: str, order: list[str], start: tuple, step, schema: str) -> DataFrame:
    """``step`` (state, row) -> (state, out) over the rows of each ``key`` in ``order``, from ``start``.

    One shuffle on the key; a task reads its rows in order and carries one key's state from batch to batch, so a key of
    any length takes no memory. Null keys are one key. A step may give no output.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), start
        for frame in frames:
            out = []
            for r in frame.itertuples():
                now = getattr(r, key)
                now = None if pd.isna(now) else now
                if now != last:
                    last, state = now, start
                state, row = step(state, r)
                if row is not None:
                    out.append(row)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def batch(tiers: DataFrame) -> DataFrame:
    """Every turn with its session's risk; repeated rows are turns of their own."""
    return in_order(tiers, "session_id", ["timestamp", "interaction_id"], START, advance, OUT)


def stream(tiers: DataFrame) -> DataFrame:
    """The same over a stream: rows of a micro-batch are folded in order of time and id, later batches after them.

    State is bounded: a scalar, the last risks, a floor and a count for each session.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        rows = pd.concat(list(parts))
        after, out = fold((now[0], list(now[1]), now[2], now[3]), rows)
        state.update(after)
        yield pd.DataFrame(out, columns=NAMES)

    return tiers.groupBy("session_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def final_states(turns: DataFrame) -> DataFrame:
    """One row for each session: its state after the last turn."""
    return turns.groupBy("session_id").agg(F.max_by(F.struct("turn", "cumulative", "floor", "adjusted", "tier"), "turn").alias("s")).select("session_id", "s.*")


def routing_state(turns: DataFrame) -> DataFrame:
    """Session complexity over the turns of a conversation: 0.55 of the past, 0.70 of the turn, more after repeated doubt."""

    def step(state: tuple, r) -> tuple[tuple, tuple]:
        session, doubts, peak = state
        session = min(1.0, 0.55 * session + 0.70 * r.complexity)
        doubts = doubts + 1 if r.outcome == "AMBIGUOUS" else 0
        if doubts >= 2:
            session = min(1.0, session + 0.08)
        peak = max(peak, r.complexity)
        return (session, doubts, peak), (r.conv_id, r.turn, round(session, 6), doubts, peak)

    schema = "conv_id long, turn long, session_complexity double, consecutive_ambiguous int, peak_complexity double"
    return in_order(turns.select("conv_id", "turn", "complexity", "outcome"), "conv_id", ["turn"], (0.0, 0, 0.0), step, schema)


ROUTED = (
    "conv_id long, turn long, outcome string, verdict string, reason string, merged double, applied_threshold double, session_complexity double, peak_complexity double, consecutive_ambiguous int,"
    " every_turn_cleared boolean, high_stakes_seen boolean, carried_signals string"
)
#: Signals that a conversation carries, at most; session complexity from which thresholds are lowered, and by how much.
CARRIED, ELEVATED, LOWERED = 12, 0.60, 0.10


def route_turn(state: tuple, r) -> tuple[tuple, tuple]:
    """Route one turn on what it adds and on the conversation's bounded state, never on its history."""
    turns, all_clear, peak, session, doubts, stakes, carried = state
    threshold = max(0.0, r.threshold - LOWERED) if session >= ELEVATED else r.threshold
    clear, doubtful = r.outcome == "CLEARED", r.outcome == "AMBIGUOUS"
    said = ["DETERMINISTIC_CLEAR"] if clear else [x for x in r.signals.split(",") if x]
    merged = max(r.complexity, min(1.0, 0.55 * session + 0.70 * r.complexity))
    if r.outcome == "VIOLATION":
        verdict, reason, merged, score, high = "ROUTE_TO_DEEP", "DETERMINISTIC_HARD_BOUNDARY", None, 1.0, True
    elif clear and all_clear and session < threshold:
        verdict, reason, merged, score, high, said = "FAST_ALLOW", "INCREMENTAL_STABLE", None, 0.0, False, []
    else:
        up = merged >= threshold
        verdict, reason = ("ROUTE_TO_DEEP", "INCREMENTAL_ABOVE_THRESHOLD") if up else ("FAST_ALLOW", "INCREMENTAL_BELOW_THRESHOLD")
        score, high = r.complexity, any(x.startswith("HIGH_STAKES") for x in said)
    session = min(1.0, 0.55 * session + 0.70 * score)
    doubts = doubts + 1 if doubtful else 0
    if doubts >= 2:
        session = min(1.0, session + 0.08)
    state = (turns + 1, all_clear and clear, max(peak, score), session, doubts, stakes or high, tuple(dict.fromkeys((*carried, *said)))[-CARRIED:])
    merged = None if merged is None else round(merged, 6)
    row = (r.conv_id, r.turn, r.outcome, verdict, reason, merged, round(threshold, 6), round(session, 6), state[2], doubts, state[1], state[5], ",".join(state[6]))
    return state, row


def incremental(turns: DataFrame) -> DataFrame:
    """Incremental routing of all turns of conversations, from the cascade's outcome, signals, complexity and threshold."""
    rows = turns.select("conv_id", "turn", "outcome", "signals", "complexity", "threshold")
    return in_order(rows, "conv_id", ["turn"], (0, True, 0.0, 0.0, 0, False, ()), route_turn, ROUTED)


def monitor(decisions: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tier counts by time window and application; rows later than ``late`` are left out in a stream."""
    d = decisions.withWatermark("timestamp", late) if decisions.isStreaming else decisions
    return d.groupBy(F.window("timestamp", window), "application").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"), F.count_if(F.col("decision") == "HUMAN_REVIEW").alias("reviewed"))


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over all there is into a Parquet table, exactly once."""
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").outputMode(mode).trigger(availableNow=True).start(path).awaitTermination()
