"""Cascade with actions, calibration, session memory, traces, factor router, patterns and recommendations."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil import config as C
from vigil.operators import adaptive as AD
from vigil.operators import calibration as K
from vigil.operators import factors as FM
from vigil.operators import grounding as G
from vigil.operators import memory as MEM
from vigil.operators import patterns as PT
from vigil.operators import responsibility as R
from vigil.operators import routing as V
from vigil.operators import trace as TR

TURN = "application string, prompt string, response string, context string, action_type string, amount double"
CALM = ("Hi", "Sure, that is fine.", "Sure, that is fine. " * 6)


def routed(spark, *rows):
    df = spark.createDataFrame(list(rows), TURN)
    return [r.asDict() for r in V.cascade_by(df).collect()]


@pytest.mark.parametrize(("application", "forced"), [("customer_support", True), ("internal_knowledge_assistant", False), ("financial_agent", True), ("realtime_voice_agent", True), ("decision_support", True)])
def test_actions_are_checked_deeply_where_the_profile_says_so(spark, application, forced):
    rows = routed(spark, (application, *CALM, "information", 0.0), (application, *CALM, "refund", 0.0), (application, *CALM, "information", 5.0), (application, *CALM, "Info ", None), (application, *CALM, None, 0.0))
    assert [r["cascade_outcome"] for r in rows] == ["CLEARED", "AMBIGUOUS", "AMBIGUOUS", "CLEARED", "CLEARED"]
    assert [r["cascade_deep"] for r in rows] == [False, forced, forced, False, False]
    df = spark.createDataFrame([(application, *CALM, "refund", 0.0)], TURN)
    one = V.cascade(df, application if application in V.PROFILES else "default", V.is_action(F.col("action_type"), F.col("amount"))).first()
    assert one["signals"] == "SIDE_EFFECTING_ACTION" and one["action_flag"] == 1.0 and (one["threshold"] == 0.0) == forced
    assert one["reason"] == ("COMPLEXITY_ABOVE_THRESHOLD" if forced else "COMPLEXITY_BELOW_THRESHOLD")


# --- calibration

ROW = "interaction_id long, gate_risk double, gate_confidence double, gate_disagreement double, gate_missing boolean, consequence_score double, action_criticality double, extreme_factor double, fast_tier int, deep_tier int, risky boolean, fast_ms double, extra_ms double"


def checked(n, seed=1):
    r = random.Random(seed)
    x = lambda: r.choice([0.0, 0.1, 0.15, 0.35, 0.45, 0.6, 0.7, 0.85, 1.0, round(r.random(), 2)])
    return [(i, x(), x(), x(), r.random() < 0.1, x() / 2, x() / 2, x(), r.randrange(5), r.randrange(5), r.choice([True, False, None]), 1.0 + i % 3, 2.0 + i % 5) for i in range(n)]


def plain_sweep(rows, axes):
    out = {}
    for i, risk, dis, cons, crit, ext, conf, floor in K.grid(axes):
        tp = fp = fast = risky = n = 0
        tiers, ms = [0] * 5, 0.0
        for _, g_risk, g_conf, g_dis, missing, cs, ac, ex, ft, dt, truth, f_ms, e_ms in rows:
            if truth is None:
                continue
            deep = missing or g_risk >= risk or (g_conf < conf and g_risk >= floor) or cs >= cons or ac >= crit or ex >= ext or g_dis >= dis
            tier = dt if deep else ft
            n, risky, fast, ms = n + 1, risky + truth, fast + (not deep), ms + f_ms + (e_ms if deep else 0)
            tiers[tier] += 1
            tp, fp = tp + (truth and tier > 0), fp + (not truth and tier > 0)
        out[i] = (n, risky, *tiers, tp / max(tp + fp, 1), tp / risky if risky else 0, (risky - tp) / risky if risky else 0, tiers[3] / n, fast / n, ms / n)
    return out


def test_sweep_equals_rows_times_candidates(spark):
    rows = checked(400)
    axes = {"risk": (0.35, 0.2, 0.6), "confidence": (0.6, 0.7), "floor": (0.15, 0.3), "disagreement": (0.45, 0.9), "consequence": (0.3,), "criticality": (0.2, 0.6), "extreme": (0.85, 1.0)}
    got = {r["candidate"]: r for r in K.sweep(spark.createDataFrame(rows, ROW), axes).collect()}
    want = plain_sweep(rows, axes)
    assert got.keys() == want.keys() and len(got) == 1 + 3 * 2 * 2 * 2 * 1 * 2 * 2
    names = ("evaluation_count", "risky_count", *(t.lower() for t in C.TIERS), "precision", "recall", "missed_risk_rate", "human_review_rate", "fast_path_rate", "average_latency_ms")
    for i, w in want.items():
        assert [got[i][c] for c in names] == pytest.approx(list(w), abs=6e-5)
        assert got[i]["fast_path_rate"] + got[i]["deep_path_rate"] == pytest.approx(1, abs=1e-4)


def test_sweep_of_no_rows_and_of_wrong_axes(spark):
    none = K.sweep(spark.createDataFrame([], ROW), {"risk": (0.2,)}).collect()
    assert [(r["candidate"], r["evaluation_count"], r["recall"]) for r in none] == [(0, 0, 0.0), (1, 0, 0.0)]
    for bad in ({"speed": (0.1,)}, {"risk": (1.5,)}, {a: tuple(i / 10 for i in range(10)) for a in K.AXES}):
        with pytest.raises(ValueError):
            K.grid(bad)


def test_selection_keeps_to_the_limits(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0, 0.9, 0.0, 0.1, 0.2, 5.0), (1, 0.95, 0.9, 0.5, 0.05, 0.3, 0.6, 4.0), (2, 0.99, 0.5, 0.5, 0.01, 0.3, 0.9, 3.0), (3, 0.95, 0.9, 0.5, 0.05, 0.2, 0.6, 4.5)],
        "candidate int, recall double, precision double, false_positive_rate double, missed_risk_rate double, human_review_rate double, fast_path_rate double, average_latency_ms double")
    limits = (("recall", ">=", 0.9), ("precision", ">=", 0.8))
    assert K.select(rows, "MAX_FAST_PATH", limits).first()["candidate"] == 3  # ties: less review
    assert K.select(rows, "MIN_LATENCY", limits).first()["candidate"] == 1
    assert K.select(rows, limits=(("recall", ">=", 1.1),)).count() == 0
    assert {r["candidate"]: r["violations"] for r in K.violations(rows, limits).collect()}[2] == "precision"


# --- session memory

DECIDED = "session_id long, session_turn long, interaction_id long, pre_session_risk double, performance_risk double, responsibility_risk double, cost_risk double, critical_trigger string, pii_keys array<string>, reason_codes string, tier_changing_rules string"


def test_memory_equals_brute_force(spark):
    r = random.Random(7)
    names, rules = ["TOXICITY", "COST_SPIKE", "MULTI_RISK"], ["RISK_BAND", "HIGH_CONSEQUENCE", "CRITICAL_PII"]
    rows = []
    for s, n in ((1, 1), (2, 3), (3, 40), (None, 2)):
        for t in range(1, n + 1):
            pick = lambda xs: ",".join(sorted(x for x in xs if r.random() < 0.3))
            rows.append((s, t, len(rows), r.random(), r.random(), r.random(), r.random(), "BLOCK" if r.random() < 0.1 else None, [f"email:{r.randrange(4)}"] if r.random() < 0.3 else [], pick(names), pick(rules)))
    got = {x["interaction_id"]: x for x in MEM.before_each_turn(spark.createDataFrame([x for x in rows if x[0]], DECIDED)).collect()}
    for s, t, i, pre, *_ in (x for x in rows if x[0]):
        old = [x for x in rows if x[0] == s and x[1] < t]
        events = [x for x in old if x[7]]
        g = got[i]
        if len(old) <= 1 and not events:
            assert all(g[c] is None for c in MEM.COLUMNS)
            continue
        counts = {c: sum(c in x[9].split(",") for x in old) for c in names}
        assert (g["turns_recorded"], g["critical_events"], g["last_critical_turn"]) == (len(old), len(events), max((x[1] for x in events), default=None))
        assert (g["critical_floor"], g["floor_applied"]) == (0.75 if events else 0.0, bool(events) and pre < 0.75)
        assert g["peak_cost_risk"] == max(x[6] for x in old) and g["pii_entity_keys"] == sorted({k for x in old for k in x[8]})
        assert g["reason_code_counts"] == ",".join(f"{c}:{n}" for c, n in sorted(counts.items()) if n)
        assert g["tier_changing_rules"] == sorted({q for x in old for q in x[10].split(",") if q not in ("", "RISK_BAND")})


# --- traces


def test_what_one_sentence_shows_is_hidden_in_every_other(spark):
    said = "Asha Verma called today about this. Her mail is asha@mail.example and the card 4111 1111 1111 1111. Later Asha Verma was happy."
    rows = spark.createDataFrame([(1, "Who is Asha Verma?", said, "Asha Verma is a client of ours."), (2, "", "Nothing here.", ""), (3, None, None, None)], "interaction_id long, prompt string, response string, context string")
    rows = rows.withColumn("found", R.findings(F.coalesce("response", F.lit(""))))
    severity = F.transform("found", lambda f: F.lit(4))
    texts = rows.select("interaction_id", "prompt", "response", TR.finding_structs(F.col("found"), severity).alias("findings"))
    claims = G.evidence_table(rows.na.fill("", ["response", "context"]), ["interaction_id"], "response", "context", "found", lambda t, f: t)
    decided = spark.createDataFrame([(i, "BLOCK", 0.9, *range(5), 4, 4, 4, 4, 4, 4) for i in (1, 2, 3, 4)], "interaction_id long, decision string, overall_risk double, " + ", ".join(f"t{i} int" for i in range(11)))
    whole = TR.traces(decided, texts, claims).cache()
    stored = TR.stored(whole)
    assert TR.leaks(stored, whole).count() == 0 and stored.count() == 4
    record = json.loads({r["interaction_id"]: r["record"] for r in stored.collect()}[1])
    assert any(f["subtype"] == "person_name" for f in record["findings"]) and "Verma" not in json.dumps(record) and "asha@" not in json.dumps(record)
    assert len(record["claims"]) == 3 and [r["fired"] for r in record["rule_trace"]][:6] == [False, True, True, True, True, False]
    assert record["rule_trace"][2]["from_tier"] == "ANNOTATE" and record["rule_trace"][2]["tier_after"] == "VERIFY"
    back = {r["interaction_id"]: r for r in TR.restored(stored).collect()}
    safe = {r["interaction_id"]: r for r in TR.redacted(whole).collect()}
    assert back == safe and back[4]["claims"] == [] and back[3]["response"] is None
    # each claim by its own findings alone would leave the name readable
    alone = rows.filter("interaction_id = 1").select(F.explode(G.claims(F.col("response"))).alias("c")).select(R.redact(F.col("c"), R.findings(F.col("c"))).alias("x")).collect()
    assert any("Verma" in r["x"] for r in alone)


# --- factor router


def test_folded_weights_equal_the_two_sided_product(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 12))
    label = (x[:, 0] - 2 * x[:, 3] > 0).astype(int)
    rows = spark.createDataFrame([(int(i), [float(c) for c in v], int(y)) for i, (v, y) in enumerate(zip(x, label))], "i int, v array<double>, label int")
    f = FM.fit(rows, F.col("v"), F.col("label"), 12)
    weights, bias = FM.weights_of(f.table(spark))
    got = [q["s"] for q in rows.orderBy("i").select(FM.linear_score(F.col("v"), weights, bias).alias("s")).collect()]
    assert got == pytest.approx(list(f.two_sided(x)), abs=1e-12)
    assert np.mean((np.array(got) > 0.5) == label) > 0.95
    assert FM.fit(rows, F.col("v"), F.col("label"), 3).projection.shape == (12, 3)


def test_routing_document_and_scored_cascade(spark):
    rows = spark.createDataFrame([("Hi", "Fine 5 days.", "x", "refund", 60000.0, 0, 4), ("", None, "", "information", None, 1, 0)], "prompt string, response string, context string, action_type string, amount double, tool_calls int, retry_count int")
    found = [r["d"] for r in rows.select(FM.routing_document(rows).alias("d")).collect()]
    assert found == ["[prompt] Hi [response] Fine 5 days. [meta] action=refund amount=60000 tools=0 retries=4 [flags] high_value_action operational_anomaly side_effecting_action", "[prompt]  [response]  [meta] action=information amount=0 tools=1 retries=0 [flags] none"]
    one = rows.limit(1).withColumn("response", F.lit("See www.x.example for it."))
    assert FM.cascade(one, F.lit(0.49)).first()["verdict"] == "FAST_ALLOW" and FM.cascade(one, F.lit(0.5)).first()["reason"] == "COMPLEXITY_ABOVE_THRESHOLD"


# --- patterns and recommendations

INCIDENT = "interaction_id long, application string, decision string, dominant_dimension string, verification_path string, reason_codes string, tier_changing_rules string, reviewer_signal string, signature string, overall_risk double"
PATTERN = "pattern_id string, type string, subject string, severity string, incident_count long, applications array<string>"


def test_attribution_is_by_membership(spark):
    found = spark.createDataFrame([(1, "a", "BLOCK", "cost", "DEEP", "X,Y", "R", None, "s", 0.5), (2, "a", "BLOCK", "performance", "FAST", "X", "", "VERIFY", "s", 0.6), (3, "b", "VERIFY", "cost", "DEEP", "", "", None, "t", 0.7)], INCIDENT)
    table = spark.createDataFrame([("P1", "REPEATED_BLOCK", "s", "LOW", 2, ["a"]), ("P2", "DETECTOR_DOMINANCE", "cost", "HIGH", 3, []), ("P3", "CROSS_APPLICATION_PATTERN", "u", "LOW", 3, ["a", "b"])], PATTERN)
    got = {(r["pattern_id"], r["kind"], r["name"]): (r["n"], r["share"], r["dominant"]) for r in PT.attribution(found, table).collect()}
    assert got["P1", "code", "X"] == (2, 1.0, True) and got["P1", "dimension", "cost"] == (1, 0.5, True) and got["P1", "dimension", "performance"] == (1, 0.5, False)
    assert got["P2", "dimension", "cost"] == got["P3", "dimension", "cost"] == (2, 0.6667, True) and got["P2", "override", "any"] == (1, 0.3333, True)
    assert ("P1", "decision", "VERIFY") not in got and got["P3", "rule", "R"] == (1, 0.3333, True)
    labels = [r["label"] for r in PT.readable(found).orderBy("interaction_id").collect()]
    assert labels == ["a / BLOCK / cost / X / Y / DEEP", "a / BLOCK / performance / X", "b / VERIFY / cost / DEEP"]


def test_recommendations_group_overlay_and_fall_back(spark):
    over = "application string, original_decision string, reviewer string, n long"
    table = spark.createDataFrame([("P1", "REPEATED_BLOCK", "s", "LOW", 2, ["a"]), ("P2", "POLICY_RULE_DOMINANCE", "r", "HIGH", 5, []), ("P3", "CROSS_APPLICATION_PATTERN", "u", "MEDIUM", 3, ["a", "b"]), ("P4", "REPEATED_BLOCK", "t", "MEDIUM", 4, ["a"]),
                                  ("P5", "REPEATED_VERIFY", "t", "LOW", 4, ["b"]), ("P6", "NOT_KNOWN", "t", "LOW", 4, ["b"])], PATTERN)
    overrides = spark.createDataFrame([("a", "BLOCK", "ALLOW", 3), ("c", "VERIFY", "REJECTED", 6)], over)
    recs = AD.recommendations(table, overrides, spark.createDataFrame([(1,)], "candidate int"))
    got = {(r["recommendation"], r["application"]): r for r in recs.collect()}
    assert len(got) == 6
    policy = got["REVIEW_POLICY", "a"]
    assert (policy["severity"], policy["patterns"], policy["incident_count"], policy["transitions"]) == ("MEDIUM", "P1,P4", 9, "BLOCK -> ALLOW")
    assert got["REVIEW_POLICY", None]["severity"] == "HIGH" and got["REVIEW_POLICY", "c"]["severity"] == "MEDIUM" and got["REVIEW_VERIFICATION_THRESHOLD", "b"]["status"] == "SIMULATED"
    ids = {k: r["recommendation_id"] for k, r in got.items()}
    log = [(ids["REVIEW_POLICY", "a"], "APPROVED_FOR_EVALUATION", "x", 1), (ids["REVIEW_POLICY", "a"], "REJECTED", "y", 2), (ids["REVIEW_DETECTOR", "b"], "APPROVED_FOR_EVALUATION", "z", 1), ("REC-NONE", "REJECTED", "x", 9)]
    laid = AD.approvals_overlay(recs, spark.createDataFrame(log, AD.APPROVALS))
    status = {(r["recommendation"], r["application"]): (r["status"], r["reviewer"]) for r in laid.collect()}
    assert status["REVIEW_POLICY", "a"] == ("REJECTED", "y") and status["REVIEW_DETECTOR", "b"] == ("APPROVED", "z") and status["REVIEW_DETECTOR", "a"] == ("RECOMMENDED_FOR_REVIEW", None)
    none = AD.recommendations(table.limit(0), overrides.limit(0)).collect()
    assert [(r["recommendation"], r["severity"], r["status"]) for r in none] == [("NO_ACTION", "INFO", "RECOMMENDED_FOR_REVIEW")]
    drift = spark.createDataFrame([("global", "average_risk", 0.2, "TREND"), ("global", "deep_rate", -0.3, "POTENTIAL_DRIFT"), ("x", "y", 0.0, "STABLE")], "scope string, metric string, delta double, signal string")
    r = AD.report(laid, table, drift, overrides).first()
    assert (r["patterns"], r["drift_signals"], r["potential_drift"], r["reviewer_overrides"], r["approved_for_evaluation"], r["rejected"], r["observation"]) == (6, 2, 1, 9, 1, 1, "global deep_rate")
    assert AD.report(laid, table, drift.limit(0), overrides).first()["observation"] == "POLICY_RULE_DOMINANCE r"


def test_override_patterns_count_rejections_and_rates(spark):
    found = spark.createDataFrame([(i, "a", "BLOCK", "cost", "DEEP", "X,Y" if i % 2 else "X", "R", None, "s", 0.5) for i in range(8)], INCIDENT)
    log = [(i, "MODIFY_DECISION", "ALLOW", "BLOCK") for i in range(4)] + [(i, "REJECT_DECISION", None, "BLOCK") for i in (4, 5, 6)] + [(7, "MODIFY_DECISION", "BLOCK", "BLOCK"), (99, "REJECT_DECISION", None, "VERIFY"), (1, "APPROVE_DECISION", None, "BLOCK")]
    got = {(r["application"], r["original_decision"], r["reviewer"]): r for r in PT.override_patterns(found, spark.createDataFrame(log, "interaction_id long, action string, reviewer_decision string, original_decision string")).collect()}
    assert set(got) == {("a", "BLOCK", "ALLOW"), ("a", "BLOCK", "REJECTED")}
    one = got["a", "BLOCK", "ALLOW"]
    assert (one["n"], one["override_rate"], one["top_reason_codes"], one["top_tier_changing_rules"]) == (4, 0.5, "X,Y", "R")
    assert list(itertools.islice(sorted(r["n"] for r in got.values()), 2)) == [3, 4]


# --- incremental routing


def test_incremental_routing_of_a_conversation(spark):
    from vigil.streaming import session as X

    turns = [("CLEARED", "", 0.2, 0.5), ("CLEARED", "", 0.3, 0.5), ("AMBIGUOUS", "RESPONSE_TOO_LONG", 0.4, 0.5), ("AMBIGUOUS", "HIGH_STAKES_INTENT:refund,RESPONSE_TOO_LONG", 0.45, 0.5), ("CLEARED", "", 0.1, 0.5), ("VIOLATION", "PII_PATTERN:EMAIL", 0.1, 0.5)]
    rows = spark.createDataFrame([(1, t, *x) for t, x in enumerate(turns)] + [(2, 0, "AMBIGUOUS", "SIDE_EFFECTING_ACTION", 0.1, 0.0)], "conv_id long, turn long, outcome string, signals string, complexity double, threshold double")
    got = [r for r in X.incremental(rows).orderBy("conv_id", "turn").collect()]
    assert [r["reason"] for r in got] == ["INCREMENTAL_STABLE"] * 2 + ["INCREMENTAL_BELOW_THRESHOLD", "INCREMENTAL_BELOW_THRESHOLD", "INCREMENTAL_BELOW_THRESHOLD", "DETERMINISTIC_HARD_BOUNDARY", "INCREMENTAL_ABOVE_THRESHOLD"]
    # 0.7 * 0.4; 0.55 * 0.28 + 0.7 * 0.45 + 0.08 after two doubts; 0.55 * 0.549 + 0.07; all of 1 for a boundary
    assert [r["session_complexity"] for r in got][:6] == pytest.approx([0.0, 0.0, 0.28, 0.549, 0.37195, 0.904573], abs=2e-6)
    assert [r["merged"] for r in got] == [None, None, 0.4, 0.469, 0.37195, None, 0.1] and got[3]["high_stakes_seen"] and not got[2]["high_stakes_seen"]
    assert got[4]["carried_signals"] == "RESPONSE_TOO_LONG,HIGH_STAKES_INTENT:refund,DETERMINISTIC_CLEAR" and not got[4]["every_turn_cleared"]
    state = (0, True, 0.0, 0.0, 0, False, tuple(f"s{i}" for i in range(12)))
    after, _ = X.route_turn(state, rows.filter("conv_id = 2").toPandas().itertuples().__next__())
    assert len(after[6]) == 12 and after[6][-1] == "SIDE_EFFECTING_ACTION"
    lowered, row = X.route_turn((3, False, 0.9, 0.7, 1, False, ()), spark.createDataFrame([(1, 9, "AMBIGUOUS", "", 0.1, 0.5)], rows.schema).toPandas().itertuples().__next__())
    assert row[6] == 0.4 and row[3] == "ROUTE_TO_DEEP"


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_documents_in_context_meet_every_kind_of_evidence(spark):
    from vigil import queries as Q

    found = Q.QUERIES["d14_decisions_in_context"](spark, "/root/testdata/sf0.001").cache()
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id is not null").count()
    seen = lambda c: {r[0] for r in found.select(c).distinct().collect()}
    assert seen("verification_path") == {"FAST", "DEEP"}
    assert {"SUPPORTED", "PARTIALLY_SUPPORTED", "UNVERIFIED"} <= seen("perf_status")
    assert seen("critical_pii") == {True, False} and seen(F.col("toxicity_risk") > 0) == {True, False} and len(seen("decision")) >= 4
    hard = found.filter("critical_pii")
    assert hard.filter("deep_trigger_reasons <> 'DETERMINISTIC_HARD_BOUNDARY' OR claims > 0").count() == 0
    boundary = found.filter("cascade_outcome = 'VIOLATION' AND NOT critical_pii")
    assert boundary.filter("deep_trigger_reasons LIKE '%TIER1_CASCADE%'").count() == 0
    assert found.filter("cascade_outcome = 'AMBIGUOUS' AND cascade_deep AND NOT critical_pii AND deep_trigger_reasons NOT LIKE '%TIER1_CASCADE%'").count() == 0
    # whatever acts is checked deeply under the profiles that force it; only the internal assistant may answer fast
    assert found.filter("action_type <> 'information' AND application <> 'internal_knowledge_assistant' AND verification_path = 'FAST'").count() == 0


# --- evidence carried along a conversation


def talk(n, conv, seed):
    r = random.Random(seed)
    words = "warehouse opens nine morning refund card order arrives monday not closed seven price ten euros stays open".split()
    say = lambda: ". ".join(" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 3)))
    return [(conv, t, "assistant" if t % 2 else "user", None if r.random() < 0.05 else say()) for t in range(n)]


def test_evidence_in_order_equals_evidence_from_whole_contexts(spark):
    rows = spark.createDataFrame([*talk(60, 1, 1), *talk(7, 2, 2), (3, 1, "assistant", "The first says this. And that is all."), (None, 0, "assistant", "No conversation at all.")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, G.claim_results_in_order(rows).collect()))
    want = sorted(map(tuple, G.claim_results(G.turns(rows.filter("conv_id is not null")), ["conv_id", "turn"], "response", "context").collect()))
    assert got == want and len(got) > 40


def test_a_long_conversation_is_read_once(spark):
    rows = spark.createDataFrame([(1, t, "assistant" if t % 50 == 49 else "user", f"Item {t} costs {t % 97} euros at shop number {t % 31}.") for t in range(10_000)], "conv_id long, turn long, role string, text string")
    found = G.turn_evidence(rows)
    assert found.count() == 200 and found.filter("has_context").count() == 200
