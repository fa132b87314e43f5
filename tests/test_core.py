"""Rules of the risk jobs: fixtures, odd input, metamorphic checks, batch against stream, SQL against Spark."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import before, cut_key, nearest_rank, percentiles
from vigil.operators import evaluation as E
from vigil.operators import governance as G
from vigil.operators import grounding as T
from vigil.operators import incidents as I
from vigil.operators import monitoring as M
from vigil.operators import responsibility as R
from vigil.operators import routing as V
from vigil.operators import trace as TR
from vigil.plans import decide as D
from vigil.plans import texts as TX
from vigil.sources import tables as W
from vigil.streaming import session as X

START = datetime(2024, 1, 1)


def events(spark, n=400, seed=1):
    r = random.Random(seed)
    kinds = ["view", "click", "signup", "error", "purchase"]
    rows = [(i, START + timedelta(minutes=r.randint(0, 5000)), r.randint(0, 12), r.choice(kinds), round(r.random() * 300, 2), f'{{"k": {r.randint(0, 99)}}}') for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def stored(df, path):
    """Reports read a table, as in production, and not the plan that made it."""
    df.write.parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


@pytest.fixture(scope="module")
def decided(spark, tmp_path_factory):
    return stored(D.decisions(events(spark)), tmp_path_factory.mktemp("t") / "decisions")


def scored(spark, **over):
    """One row of signals with defaults that lead to ALLOW."""
    row = {
        "interaction_id": 1, "session_id": 1, "timestamp": START, "application": "customer_support", "overall_risk": 0.01, "consequence_score": 0.14, "financial_impact": 0.0, "reversibility": 0.05, "action_criticality": 0.18,
        "performance_risk": 0.02, "responsibility_risk": 0.0, "cost_risk": 0.0, "perf_status": "SUPPORTED", "confidence": 0.9, "resp_conf": 0.6, "critical_pii": False, "toxicity_risk": 0.0, "dominant_dimension": "performance",
        "action_automation": 0.5, "severity_floor": False, "multi_risk": False, "blast_radius": 0.01, "criticality_codes": "", "cost_anomalies": "", **{f"hit_{x}": False for x in (*D.RATIOS, "tools", "retries")},
    } | over
    return spark.createDataFrame(pd.DataFrame([row]))


def tier(spark, **over):
    return D.decide(scored(spark, **over)).select("decision", "triggered_rules").first()


def test_policy_scenarios(spark):
    assert tier(spark)["decision"] == "ALLOW"
    assert tier(spark, overall_risk=0.58, performance_risk=0.74, perf_status="CONTRADICTED")["decision"] == "VERIFY"
    assert tier(spark, overall_risk=0.64, responsibility_risk=0.72, critical_pii=True)["decision"] == "BLOCK"
    got = tier(spark, overall_risk=0.80, cost_risk=1.0, dominant_dimension="cost")
    assert got["decision"] == "VERIFY" and "COST_ONLY_CAP" in got["triggered_rules"]
    assert tier(spark, overall_risk=0.58, application="decision_support", performance_risk=0.74, perf_status="CONTRADICTED")["decision"] == "HUMAN_REVIEW"
    assert tier(spark, overall_risk=0.95, confidence=0.3)["decision"] == "HUMAN_REVIEW"  # a doubtful block goes to a person
    assert tier(spark, overall_risk=0.1, toxicity_risk=0.9)["decision"] == "BLOCK"
    assert tier(spark, application="nobody")["decision"] == "ALLOW"
    assert tier(spark, reversibility=0.9)["decision"] == "ANNOTATE"


def test_fusion_fixture(spark):
    row = {"perf_raw": 0.95, "resp_raw": 0.05, "cost_raw": 0.05, "action_criticality": 0.1, "perf_conf": 0.8, "resp_conf": 0.8, "cost_confidence": 0.7, "evidence_quality": 0.4, "neutral_rate": 0.5, "perf_status": "SUPPORTED", "evidence_available": True, "max_text_criticality": 0.0, "consequence_score": 0.1, "financial_impact": 0.0, "reversibility": 0.1}
    got = D.add(spark.createDataFrame(pd.DataFrame([row, row | {"perf_raw": 0.97, "resp_raw": 0.0, "cost_raw": 0.0}, row | {"perf_raw": 0.0, "resp_raw": 0.0, "cost_raw": 0.0}])), D.FUSE).collect()
    assert got[0]["overall_risk"] > 0.6 and got[1]["overall_risk"] >= 0.8 and got[1]["severity_floor"] and got[2]["overall_risk"] == 0.0
    # spread 0.4243 counts in full, evidence 0.6, half of the claims neutral, trust of the third row above the anchor
    assert got[0]["disagreement"] == pytest.approx(0.35 + 0.25 * 0.6 + 0.15 * 0.5 + 0.15 * max(0, (0.6 - got[0]["confidence"]) / 0.6), abs=1e-4)
    assert got[2]["disagreement"] == pytest.approx(0.25 * 0.6 + 0.15 * 0.5, abs=1e-4)


def test_cost_parts_and_baseline(spark):
    got = D.signals(D.interactions(events(spark))).select("input_cost", "output_cost", "tool_cost", "retry_cost", "estimated_cost", "cost_risk", "efficiency").toPandas()
    assert ((got[["input_cost", "output_cost", "tool_cost", "retry_cost"]].sum(axis=1) - got["estimated_cost"]).abs() < 1e-5).all()
    assert got["cost_risk"].between(0, 1).all() and got["efficiency"].between(0, 1).all()


def test_reports_do_not_depend_on_row_order(spark, decided):
    mixed = decided.orderBy(F.rand(3)).repartition(3)
    for report in (M.snapshot, M.application_summary, M.half_trend, I.drift, lambda d: I.clusters(I.incidents(d))):
        key = lambda df: sorted(map(str, df.collect()))
        assert key(report(decided)) == key(report(mixed))


def test_snapshot_equals_a_hand_aggregate(decided):
    rows, got = decided.collect(), M.snapshot(decided).first()
    assert got["total"] == len(rows) and sum(got[f"n_{t.lower()}"] for t in C.TIERS) == len(rows)
    assert got["mean_risk"] == pytest.approx(sum(r["overall_risk"] for r in rows) / len(rows), abs=1e-4)
    assert sum(got[f"rate_{t.lower()}"] for t in C.TIERS) == pytest.approx(1, abs=1e-3)
    risks = sorted(r["overall_risk"] for r in rows)
    assert got["p95_risk"] == risks[round(0.95 * (len(rows) - 1))]


def test_nearest_rank_rounds_half_even(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert nearest_rank(df, [], "v", 0.5, "p").first()["p"] == 3.0  # index 1.5 -> 2


def test_cut_key_equals_a_global_sort(decided):
    rows = sorted((r["timestamp"], r["interaction_id"]) for r in decided.select("timestamp", "interaction_id").collect())
    for i in (0, 1, 57, len(rows) - 1):
        assert cut_key(decided, i) == rows[i]
        assert decided.filter(before(cut_key(decided, i))).count() == i
    assert cut_key(decided, len(rows)) is None


@pytest.mark.parametrize("n", [0, 1])
def test_reports_on_next_to_nothing(spark, n, tmp_path):
    d = stored(D.decisions(events(spark, n)), tmp_path / "decisions")
    found, log = I.incidents(d), spark.createDataFrame([], "action_id long, interaction_id long, timestamp timestamp, action string, reviewer_decision string")
    for df in (M.snapshot(d), M.risk_distribution(d), M.application_summary(d), M.half_trend(d), M.attention_signals(d), I.clusters(found), I.drift(d), I.dominance_patterns(found), G.application_comparison(d, log), E.report(E.with_labels(d)), E.threshold_sweep(E.with_labels(d), F.col("truly_risky"), "overall_risk"), G.insights(d, log), G.recommendations(d, log)):
        df.collect()
    assert M.risk_distribution(d).count() == 4 and I.drift(d).count() == 0


def test_binary_metrics_and_confusion(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "t boolean, p boolean")
    got = E.binary(df, F.col("t"), F.col("p")).first()
    assert (got["tp"], got["fn"], got["precision"], got["recall"], got["f1"], got["fpr"]) == (1, 1, 1.0, 0.5, 0.6667, 0.0)
    grid = E.confusion(spark.createDataFrame([("ALLOW", "ALLOW"), ("BLOCK", "ALLOW"), ("ALLOW", "ALLOW")], "a string, b string"), "a", "b", C.TIERS)
    cells = {(r["truth"], r["said"]): r["n"] for r in grid.collect()}
    assert len(cells) == 25 and cells["ALLOW", "ALLOW"] == 2 and cells["BLOCK", "ALLOW"] == 1


def test_threshold_sweep_is_monotone(spark):
    df = spark.createDataFrame([(s, s > 0.5) for s in (0.9, 0.1, 0.6, 0.3, 0.8)], "s double, t boolean")
    rows = E.threshold_sweep(df, F.col("t"), "s", (0.2, 0.5, 0.7)).orderBy("threshold").collect()
    said = [r["tp"] + r["fp"] for r in rows]
    assert said == [4, 3, 2] and E.best_threshold(E.threshold_sweep(df, F.col("t"), "s", (0.2, 0.5, 0.7))).first()["threshold"] == 0.5


def test_session_scenario():
    """A calm turn, then the same contradiction again and again: the fourth turn escalates."""
    tiers = [int(t) for t in (0, 1, 2, 3, 4)] * 2
    rows = pd.DataFrame([{"session_id": 1, "timestamp": START + timedelta(minutes=i), "interaction_id": i, "overall_risk": r, "bounds": [0.22, 0.42, 0.60, 0.82], "at_unsure_risk": 0.6, "tiers": tiers, "critical": False} for i, r in enumerate([0.01, 0.58, 0.58, 0.58, 0.58])])
    state, out = X.fold(X.START, rows)
    got = pd.DataFrame(out, columns=X.NAMES)
    assert got["adjusted"].round(2).tolist() == [0.01, 0.58, 0.58, 0.73, 0.76]
    assert got["escalated"].tolist() == [False, False, False, True, True] and got["high_risk_events"].tolist() == [0, 1, 2, 3, 4]
    assert [C.TIERS[t] for t in got["tier"]] == ["ALLOW", "VERIFY", "VERIFY", "HUMAN_REVIEW", "HUMAN_REVIEW"]
    assert state[0] == pytest.approx(0.41, abs=0.01) and (got["adjusted"] >= rows["overall_risk"]).all()


def test_stream_equals_batch(spark, tmp_path):
    tiers = X.with_tiers(D.signals(D.interactions(events(spark, 120))))
    want = sorted(map(tuple, X.batch(tiers).collect()))
    tiers.coalesce(1).write.parquet(str(tmp_path / "in"))
    X.run_to_table(X.stream(spark.readStream.schema(tiers.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_sessions_in_order_with_repeated_rows_and_one_long_session(spark):
    """Repeated rows are turns of their own; state goes from batch to batch of a long session; equal to one fold."""
    tiers = X.with_tiers(D.signals(D.interactions(events(spark, 200)))).withColumn("session_id", F.when(F.col("interaction_id") % 3 > 0, 7).otherwise(F.col("session_id")).cast("long"))
    tiers = tiers.unionByName(tiers.filter("interaction_id = 10"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = X.batch(tiers).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [r for _, rows in tiers.toPandas().groupby("session_id") for r in X.fold(X.START, rows)[1]]
    assert len(got) == 201 and sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)


def test_session_tier_equals_policy_without_history(spark):
    """The first turn of a session has no history: its tier is the policy's own."""
    s = D.signals(D.interactions(events(spark)))
    first = X.batch(X.with_tiers(s)).filter("turn = 1 and adjusted = raw").select("interaction_id", "tier")
    joined = first.join(D.decide(s).select("interaction_id", "t10"), "interaction_id").collect()
    assert joined and all(r["tier"] == r["t10"] for r in joined)


def test_personal_data_scan():
    text = "Reach Jane Doe at jane.doe@mail.com or 4111 1111 1111 1111, SSN 123-45-6789, ACC-12345, at 12 Long Hill Road."
    kinds = [f["subtype"] for f in R.scan(text)]
    assert kinds == ["person_name", "email", "credit_card", "government_id", "account_id", "postal_address"]
    assert R.scan("Jane Doe says hello") == [] and R.scan(None) == [] and R.scan("") == []
    assert all(text[f["start"] : f["end"]] == f["matched"] for f in R.scan(text))


def test_responsibility_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "mail a.b@c.com now, you people are pathetic"), (2, None), (3, ""), (4, "older people tend to be less reliable")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in R.assess(rows).collect()}
    assert got[1]["pii_risk"] == 0.65 and got[1]["n_harassment"] == 2 and got[1]["toxicity_risk"] == 0.7 and got[2]["responsibility_risk"] == 0 and got[3]["pii_risk"] == 0
    assert got[4]["bias_risk"] > 0.7 and "POTENTIAL_BIAS_SIGNAL" in got[4]["responsibility_codes"]
    text = rows.filter("doc_id = 1").withColumn("f", R.findings(F.col("text")))
    assert text.select(R.redact(F.col("text"), F.col("f")).alias("t")).first()["t"].startswith("mail a***@c*** now")


def test_grounding(spark):
    rows = spark.createDataFrame([(1, "Refunds are accepted within 90 days of purchase.", "Our policy: refunds are accepted within 30 days of purchase."), (2, "Refunds are accepted within 30 days.", "Refunds are accepted within 30 days of purchase."), (3, "", "x"), (4, "Something without evidence here.", ""), (5, None, None)], "id long, response string, context string")
    got = {r["id"]: r for r in T.responses(rows, ["id"], "response", "context").collect()}
    assert got[1]["status"] == "CONTRADICTED" and got[1]["performance_risk"] >= 0.74
    assert got[2]["status"] == "SUPPORTED" and got[2]["performance_risk"] < 0.08 and got[2]["grounding_score"] == 1.0
    assert got[3]["claims"] == 0 and got[3]["performance_risk"] == 0.10 and got[5]["claims"] == 0
    assert got[4]["status"] == "UNVERIFIED" and got[4]["performance_risk"] == 0.5


def test_tfidf_ranks_and_repacks():
    scores = T.weighed(["the red cat sat", "a dog", "red cat"])("red cat")
    assert scores[2] == max(scores) and scores[1] == 0.0 and T.weighed(["", "x"])("a b") == [0.0, 0.0]
    parts = T.repack("word " * 300 + "y" * 1700, 800)
    assert all(len(p) <= 800 for p in parts) and "".join(parts).replace(" ", "") == "word" * 300 + "y" * 1700


def test_cascade(spark):
    rows = spark.createDataFrame([("Hi", "Sure, that is fine.", "It is fine."), ("Hi", "Mail me at a@b.com", "x"), ("How do I get a refund?", "It might take 5 days", "")], "prompt string, response string, context string")
    got = V.cascade(rows, "customer_support").select("verdict", "reason", "complexity").collect()
    assert [g["reason"] for g in got][:2] == ["DETERMINISTIC_CLEAR", "DETERMINISTIC_HARD_BOUNDARY"] and got[2]["complexity"] > got[0]["complexity"]
    assert V._fnv("") == 0xCBF29CE484222325 and V._fnv("a") == 0xAF63DC4C8601EC8C


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([("i1", START, "customer_support", "employee", "gemini-flash", "s", 'p "q", r\nx', "", "r", 1, 2, 3.0, 0, 0, "refund", 0.0, 1)], W.INTERACTION)
    for form in ("csv", "json", "parquet"):
        W.write_interactions(rows, str(tmp_path / form), form)
        back = W.read_interactions(spark, str(tmp_path / form), form).first()
        assert back["prompt"] == 'p "q", r\nx' and back["tokens_out"] == 2
    assert W.data_quality(rows.unionByName(rows.withColumn("tokens_in", F.lit(-1))), ["context"]).first()["skipped"] == 1
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "interaction_id long, v string, ingest_seq long")
    stored = spark.createDataFrame([(2,)], "interaction_id long")
    assert [tuple(r) for r in W.first_write_wins(stored, new).collect()] == [(1, "a", 1)]
    assert sorted(r["v"] for r in W.latest_write(new).collect()) == ["b", "c"]


def test_counterfactual_refuses_other_columns(spark):
    with pytest.raises(ValueError, match="may not be changed"):
        E.counterfactual(D.interactions(events(spark, 5)), {"perf_status": "'SUPPORTED'"})


def test_detectors_never_see_labels():
    from vigil.plans import decide

    names = {n for layer in decide.EVENTS + decide.PRICE + decide.COST + decide.STAKES + decide.FUSE + decide.policy_layers() for n, _ in layer}
    assert not names & {"truly_risky", "expected", "label_risk"}


@pytest.mark.parametrize("at", [0.0, 0.8, 1.0])
def test_bracketed_percentiles_are_exact(spark, at):
    rows = spark.range(60_000).select((F.col("id") % 30_000 == 0).alias("g"), F.rand(5).alias("x"), (F.col("id") % 7).alias("y"), F.when(F.col("id") % 3 == 0, F.rand(9)).alias("z"))
    got = {r["g"]: r for r in percentiles(rows, ["g"], ["x", "y", "z"], at).collect()}
    want = {r["g"]: r for r in rows.groupBy("g").agg(*(F.percentile(c, at).alias(c) for c in "xyz")).collect()}
    assert got.keys() == want.keys() and all(got[g][c] == pytest.approx(want[g][c], abs=1e-12) for g in want for c in "xyz")
    assert nearest_rank(rows.limit(0), [], "x", at, "p").first()["p"] is None


def said(spark, tmp_path, *conversations):
    """Decisions over conversations given as lists of texts, user and assistant by turns, by (conv_id, turn)."""
    rows = [(c, t, "assistant" if t % 2 else "user", text) for c, texts in enumerate(conversations) for t, text in enumerate(texts)]
    signals = stored(TX.detected(TX.from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), tmp_path / "signals")
    scored_ = stored(TX.scored(signals), tmp_path / "scored")
    decided_ = stored(TX.decisions(scored_), tmp_path / "decided")
    tiers = {r["interaction_id"]: C.TIERS[r["tier"]] for r in X.batch(X.with_tiers(scored_)).collect()}
    got = {divmod(r["interaction_id"], 100_000): r for r in decided_.collect()}
    assert {c * 100_000 + t: r["decision"] for (c, t), r in got.items()} == tiers  # the recurrence and the policy agree
    return got, decided_


CARD, THREAT = "Your card is 4111 1111 1111 1111 and it is fine.", "You will regret this, I will kill you."
FACTS = ["The warehouse in Pune opens at nine every morning. What are its hours?", "The warehouse in Pune opens at nine every morning."]


def test_decisions_from_texts(spark, tmp_path):
    got, decided_ = said(spark, tmp_path, ["Hello there", CARD, "Thanks", "You are welcome today."], ["Hello", THREAT, "Oh", "Fine then."], FACTS, ["", None])
    card, after, threat, fact, empty = got[0, 1], got[0, 3], got[1, 1], got[2, 1], got[3, 1]
    # a hard boundary: no claims looked for, fixed risk, deep path, and a floor under the session's later turns
    assert card["critical_pii"] and card["claims"] == 0 and card["perf_status"] == "UNVERIFIED" and card["deep_trigger_reasons"] == "DETERMINISTIC_HARD_BOUNDARY"
    assert card["verification_path"] == "DEEP" and "CRITICAL_PII" in card["triggered_rules"] and card["decision"] == "BLOCK" and card["critical_trigger"] == "CRITICAL_PII"
    assert card["pii_severity"] == 4 and card["pii_keys"] == ["credit_card:[REDACTED_CARD]"]
    assert after["overall_risk"] >= C.SESSION["floor"] > after["pre_session_risk"] and after["session_turn"] == 2
    assert threat["toxic_critical"] and threat["decision"] == "BLOCK" and "SEVERE_TOXICITY" in threat["triggered_rules"] and threat["critical_trigger"] == "SEVERE_TOXICITY"
    assert fact["perf_status"] == "SUPPORTED" and fact["performance_risk"] < 0.1 and fact["critical_trigger"] is None
    assert empty["claims"] == 0 and empty["decision_confidence"] is not None
    s = {r["session_id"]: r for r in TX.snapshots(decided_).collect()}
    assert s[0]["critical_floor"] == C.SESSION["floor"] and s[0]["pii_entity_keys"] == "credit_card:[REDACTED_CARD]" and s[0]["turns_recorded"] == 2 and "CRITICAL_PII" in s[0]["tier_changing_rules"]
    assert s[2]["critical_events"] == 0 and s[2]["critical_floor"] == 0.0
    assert {r["session_id"] for r in TX.critical_turns(decided_).collect()} >= {0, 1}


def test_text_decisions_of_an_empty_table(spark, tmp_path):
    got, decided_ = said(spark, tmp_path, [])
    assert got == {} and TX.snapshots(decided_).count() == 0


def test_severity_by_action(spark):
    rows = spark.createDataFrame([("email", "information"), ("email", "external_communication"), ("credit_card", None), ("person_name", None), ("postal_address", "refund")], "k string, a string")
    assert [r[0] for r in rows.select(R.severity(F.col("k"), F.col("a"))).collect()] == ["MEDIUM", "CRITICAL", "CRITICAL", "LOW", "HIGH"]


def test_evidence_table_is_redacted(spark):
    rows = spark.createDataFrame([(1, "Pay with card 4111 1111 1111 1111 today.", "Their card 4111 1111 1111 1111 works today."), (2, "No evidence for this.", ""), (3, "", "x y z")], "id long, response string, context string")
    rows = rows.withColumn("found", R.findings(F.col("response")))
    hidden = lambda text, found: TR.redact(text, TR.redactions(found, "matched", "redacted"))
    got = {r["id"]: r for r in T.evidence_table(rows, ["id"], "response", "context", "found", hidden).collect()}
    assert got[1]["claim"] == "Pay with card [REDACTED_CARD] today." and got[1]["evidence"] == "Their card [REDACTED_CARD] works today." and got[1]["similarity"] > 0
    assert got[2]["evidence"] == "" and got[2]["similarity"] == 0.0 and 3 not in got
