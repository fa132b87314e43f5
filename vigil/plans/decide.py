"""From usage metadata and detector signals to intervention decisions, as layers of column expressions.

Every layer adds columns that depend on the ones before; Catalyst folds them into one projection. The only joins are the
per-segment cost baseline (a row for each application and model) and the policy profiles (a row for each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import percentiles, r4
from vigil.functions.scalar import clamp, listed, lookup, num, rounded

Layer = list[tuple[str, str]]

#: Adapter: events as interactions, with stand-ins for the text detectors.
EVENTS: list[Layer] = [
    [
        ("interaction_id", "event_id"), ("session_id", "user_id"), ("k", "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT)"),
        ("application", "CASE event_type WHEN 'purchase' THEN 'decision_support' WHEN 'view' THEN 'internal_knowledge_assistant' WHEN 'click' THEN 'internal_knowledge_assistant' ELSE 'customer_support' END"),
        ("model", "CASE user_id % 4 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(C.MODELS)) + " END"),
        ("action_type", "CASE event_type WHEN 'view' THEN 'information' WHEN 'purchase' THEN 'refund' WHEN 'signup' THEN 'account_update' WHEN 'error' THEN 'external_communication' ELSE 'recommendation' END"),
    ],
    [
        ("tokens_in", "CAST(4 * k AS BIGINT)"), ("tokens_out", "CAST(floor(10 * value) AS BIGINT)"), ("latency_ms", "100e0 + 20e0 * value"),
        ("tool_calls", "k % 7"), ("retry_count", "k % 5"), ("amount", "5000e0 * value"), ("affected_entities", "1 + k"),
        ("perf_raw", "((37 * event_id) % 100) / 100e0"), ("resp_raw", "((53 * event_id) % 100) / 100e0"), ("perf_conf", "3e-1 + ((17 * event_id) % 60) / 100e0"),
        ("resp_conf", "3e-1 + ((17 * event_id) % 60) / 100e0"), ("toxicity_risk", "0e0"), ("critical_pii", "false"), ("toxic_critical", "false"),
        ("evidence_quality", "((41 * event_id) % 100) / 100e0"), ("neutral_rate", "((19 * event_id) % 10) / 10e0"),
        ("max_text_criticality", "CAST(NULL AS DOUBLE)"),
    ],
    [("perf_status", "CASE WHEN perf_raw >= 74e-2 THEN 'CONTRADICTED' WHEN perf_raw >= 35e-2 THEN 'UNVERIFIED' ELSE 'SUPPORTED' END")],
    [("evidence_available", "perf_status <> 'UNVERIFIED'")],
]

#: What a deeper check of the same events would say instead, and what either check takes.
EVENTS_DEEP: list[Layer] = [
    [
        ("perf_raw", "((61 * interaction_id) % 100) / 100e0"), ("perf_conf", "5e-1 + ((23 * interaction_id) % 45) / 100e0"),
        ("evidence_quality", "((29 * interaction_id) % 100) / 100e0"), ("neutral_rate", "((13 * interaction_id) % 10) / 10e0"),
    ],
    [("perf_status", "CASE WHEN perf_raw >= 74e-2 THEN 'CONTRADICTED' WHEN perf_raw >= 35e-2 THEN 'UNVERIFIED' ELSE 'SUPPORTED' END")],
]
EVENTS_TIMES: Layer = [("fast_ms", "1e0 + tokens_out / 100e0"), ("extra_ms", "2e0 + tokens_in / 100e0")]

PRICE: list[Layer] = [
    [
        ("input_cost", f"round(tokens_in / 1000e0 * ({lookup('model', C.RATE_IN, C.RATE_DEFAULT[0])}) + 1e-11, 6)"),
        ("output_cost", f"round(tokens_out / 1000e0 * ({lookup('model', C.RATE_OUT, C.RATE_DEFAULT[1])}) + 1e-11, 6)"),
        ("tool_cost", f"tool_calls * {num(C.TOOL_COST)}"), ("retry_cost", f"retry_count * {num(C.RETRY_COST)}"),
    ],
    [("estimated_cost", "round(input_cost + output_cost + tool_cost + retry_cost + 1e-11, 6)")],
]
SEGMENT = ("application", "model")
FITTED = ("tokens_in", "tokens_out", "latency_ms", "tool_calls", "retry_count", "estimated_cost")
RATIOS = ("tokens_in", "tokens_out", "latency_ms", "estimated_cost")

COST: list[Layer] = [
    [(f"base_{x}", f"greatest({num(C.STATIC[x])}, coalesce(fit_{x}, 0e0))") for x in RATIOS],
    [(f"ratio_{x}", f"{x} / base_{x}") for x in RATIOS] + [("ratio_tools", f"tool_calls / {num(C.MAX_TOOLS)}"), ("ratio_retries", f"retry_count / {num(C.MAX_RETRIES)}")],
    [(f"hit_{x}", f"ratio_{x} >= {num(C.MULTIPLIER[x])}") for x in RATIOS] + [("hit_tools", f"tool_calls > {C.MAX_TOOLS}"), ("hit_retries", f"retry_count > {C.MAX_RETRIES}")],
    [
        ("cost_raw", clamp(" + ".join(
            f"CASE WHEN hit_{x} THEN {num(C.PER_INDICATOR)} * (6e-1 + 4e-1 * least(2e0, {rounded(f'ratio_{x}', 3)} / {num(t)})) ELSE 0e0 END"
            for x, t in [*((x, C.MULTIPLIER[x]) for x in RATIOS), ("tools", 1.0), ("retries", 1.0)]))),
        ("retry_share", clamp("retry_cost / greatest(estimated_cost, 1e-9)")), ("tool_share", clamp("tool_cost / greatest(estimated_cost, 1e-9)")),
        ("cost_anomalies", listed(
            ("TOKEN_SPIKE", "hit_tokens_in OR hit_tokens_out"), ("RETRY_SPIKE", "hit_retries"), ("TOOL_LOOP", "hit_tools AND tool_calls >= 5 AND tokens_out < 60 * tool_calls"),
            ("TOOL_SPIKE", "hit_tools AND NOT (tool_calls >= 5 AND tokens_out < 60 * tool_calls)"), ("LATENCY_SPIKE", "hit_latency_ms"), ("COST_PER_SUCCESS_SPIKE", "hit_estimated_cost"))),
    ],
    [("cost_confidence", "CASE WHEN fit_estimated_cost IS NULL THEN 7e-1 ELSE 82e-2 END"), ("efficiency", rounded(clamp(f"({clamp('55e-2 * ' + clamp('1e0 / greatest(ratio_estimated_cost, 1e0)') + ' + 25e-2 * (1e0 - retry_share) + 2e-1 * (1e0 - least(1e0, tool_share * 15e-1))')}) * power(1e0 / (1 + retry_count), 4e-1)")))],
]

STAKES: list[Layer] = [
    [
        ("financial_impact", clamp(f"amount / {num(C.FINANCIAL_SCALE)}")), ("reversibility", lookup("action_type", C.REVERSIBILITY, 0.5)), ("sensitivity", lookup("action_type", C.SENSITIVITY, 0.5)),
        ("blast_radius", clamp(f"affected_entities / {num(C.BLAST_SCALE)}")), ("action_automation", lookup("action_type", C.AUTOMATION, 0.5)),
    ],
    [
        ("consequence_raw", clamp(" + ".join(f"{x} * {num(C.CONSEQUENCE[x])}" for x in C.FACTORS))),
        ("criticality_raw", clamp(" + ".join(f"{x} * {num(C.CRITICALITY[x])}" for x in C.FACTORS))),
    ],
    [
        ("consequence_score", rounded("consequence_raw")), ("action_criticality", rounded("criticality_raw")),
        ("consequence_band", f"CASE WHEN consequence_raw >= {num(C.BAND_HIGH)} THEN 'high' WHEN consequence_raw >= {num(C.BAND_MODERATE)} THEN 'moderate' ELSE 'low' END"),
        ("criticality_band", f"CASE WHEN criticality_raw >= {num(C.BAND_HIGH)} THEN 'high' WHEN criticality_raw >= {num(C.BAND_MODERATE)} THEN 'moderate' ELSE 'low' END"),
        ("criticality_codes", listed(
            ("HIGH_FINANCIAL_IMPACT", "financial_impact >= 8e-1"), ("IRREVERSIBLE_ACTION", "reversibility >= 8e-1"), ("HIGH_BLAST_RADIUS", "blast_radius >= 7e-1"),
            ("AUTOMATED_EXTERNAL_ACTION", "action_automation >= 8e-1 AND action_type IN ('external_communication', 'recommendation', 'refund', 'account_update')"))),
    ],
]

_P, _R, _X = "performance_risk", "responsibility_risk", "cost_risk"
FUSE: list[Layer] = [
    # how much the response matters: the action, or the claim that asserts most (null without claims)
    [("matters", f"greatest(action_criticality, {rounded('6e-1 * action_criticality + 4e-1 * max_text_criticality')})")],
    [
        (_P, clamp(f"CASE WHEN matters <= {num(C.BAND_MODERATE)} THEN perf_raw ELSE perf_raw + (1e0 - perf_raw) * perf_raw * ((matters - {num(C.BAND_MODERATE)}) / (1e0 - {num(C.BAND_MODERATE)})) * {num(C.AMPLIFICATION)} END")),
        (_R, clamp("resp_raw")), (_X, rounded("cost_raw")),
    ],
    [
        ("weighted", f"{num(0.4)} * {_P} + {num(0.4)} * {_R} + {num(0.2)} * {_X}"), ("worst", f"greatest({_P}, {_R}, {_X})"), ("mass", f"{_P} + {_R} + {_X}"),
        ("dominant_dimension", f"CASE WHEN {_P} >= {_R} AND {_P} >= {_X} THEN 'performance' WHEN {_R} >= {_X} THEN 'responsibility' ELSE 'cost' END"),
        ("multi_risk", f"(CASE WHEN {_P} >= {num(C.ELEVATED)} THEN 1 ELSE 0 END + CASE WHEN {_R} >= {num(C.ELEVATED)} THEN 1 ELSE 0 END + CASE WHEN {_X} >= {num(C.ELEVATED)} THEN 1 ELSE 0 END) >= 2"),
    ],
    [
        ("pull", f"CASE WHEN worst >= {num(C.SEVERITY_AT)} THEN {num(C.PULL)} ELSE {num(C.PULL_LOW)} END"), ("severity_floor", f"worst >= {num(C.FLOOR_AT)}"), ("mean_risk", "mass / 3e0"),
        ("trust", f"CASE WHEN mass < 1e-6 THEN {num(0.4)} * perf_conf + {num(0.4)} * resp_conf + {num(0.2)} * cost_confidence ELSE {_P} / mass * perf_conf + {_R} / mass * resp_conf + {_X} / mass * cost_confidence END"),
    ],
    [
        ("blended", "(1e0 - pull) * weighted + pull * worst"),
        ("spread", f"sqrt((({_P} - mean_risk) * ({_P} - mean_risk) + ({_R} - mean_risk) * ({_R} - mean_risk) + ({_X} - mean_risk) * ({_X} - mean_risk)) / 3e0)"),
    ],
    [
        ("overall_risk", rounded(clamp(f"CASE WHEN severity_floor THEN greatest(blended, {num(C.FLOOR)}) ELSE blended END"))),
        ("confidence", rounded(clamp("trust - 25e-2 * spread"))),
    ],
    [
        ("disagreement", rounded(clamp(
            f"35e-2 * least(1e0, spread / 35e-2) + 25e-2 * (1e0 - evidence_quality) + 15e-2 * neutral_rate + 15e-2 * {clamp('(6e-1 - confidence) / 6e-1')}"
            " + CASE WHEN NOT evidence_available THEN 1e-1 ELSE 0e0 END"))),
    ],
    [
        ("deep_trigger_reasons", listed(
            ("HIGH_PRELIMINARY_RISK", f"overall_risk >= {num(C.DEEP['risk'])}"), ("LOW_CONFIDENCE", f"confidence < {num(C.DEEP['confidence'])} AND overall_risk >= {num(C.DEEP['floor'])}"),
            ("HIGH_CONSEQUENCE", f"consequence_score >= {num(C.DEEP['consequence'])} OR greatest(financial_impact, reversibility) >= {num(C.DEEP['extreme'])}"),
            ("HIGH_CRITICALITY", f"action_criticality >= {num(C.DEEP['criticality'])}"), ("DETECTOR_DISAGREEMENT", f"disagreement >= {num(C.DEEP['disagreement'])}"),
            ("MISSING_EVIDENCE", "NOT evidence_available"))),
    ],
    [("verification_path", "CASE WHEN deep_trigger_reasons = '' THEN 'FAST' ELSE 'DEEP' END")],
]


def profile_rows() -> list[tuple]:
    """The policy profiles, tiers as ranks."""
    return [(name, *(C.RANK[v] if isinstance(v, str) else v for v in p.values())) for name, p in C.PROFILES.items()]


PROFILE = [("profile", "string"), *((f"at_{k}", "int" if isinstance(v, (str, int)) else "double") for k, v in C.PROFILES["default"].items())]
PROFILE_OF = "CASE WHEN {0} IN (" + ", ".join(f"'{p}'" for p in C.PROFILES) + ") THEN {0} ELSE 'default' END"


def policy_layers(confidence_aware: bool = True) -> list[Layer]:
    """Tier after each rule, in the fixed order of rules; a rule counts as triggered if it moves the tier."""
    safety = "t3 > t2 OR t4 > t3 OR t5 > t4 OR critical_pii OR toxic"
    return [
        [
            ("toxic", "toxicity_risk >= at_toxicity_at"),
            ("t0", "CASE WHEN overall_risk <= at_allow THEN 0 WHEN overall_risk <= at_annotate THEN 1 WHEN overall_risk <= at_verify THEN 2 WHEN overall_risk <= at_review THEN 3 ELSE 4 END"),
        ],
        [("t1", "CASE WHEN consequence_score >= at_escalate_at OR greatest(financial_impact, reversibility) >= at_extreme_at THEN least(t0 + at_steps, 4) ELSE t0 END")],
        [("t2", "CASE WHEN action_criticality >= at_critical_at OR financial_impact >= at_extreme_at THEN greatest(t1, at_critical_tier) ELSE t1 END")],
        [("t3", "CASE WHEN perf_status = 'CONTRADICTED' THEN greatest(t2, at_contradiction_tier) ELSE t2 END")],
        [("t4", "CASE WHEN perf_status = 'UNVERIFIED' AND performance_risk >= 4e-1 THEN greatest(t3, at_unverified_tier) ELSE t3 END")],
        [("t5", "CASE WHEN responsibility_risk >= at_responsibility_at THEN greatest(t4, at_responsibility_tier) ELSE t4 END")],
        [("t6", "CASE WHEN confidence <= at_confidence_at THEN greatest(t5, at_confidence_tier) ELSE t5 END" if confidence_aware else "t5")],
        [("t7", "CASE WHEN critical_pii THEN greatest(t6, at_pii_tier) ELSE t6 END")],
        [("t8", "CASE WHEN toxic THEN 4 ELSE t7 END")],
        [("t9", f"CASE WHEN dominant_dimension = 'cost' AND performance_risk < 4e-1 AND responsibility_risk < 4e-1 AND NOT ({safety}) AND t8 > at_cost_tier THEN at_cost_tier ELSE t8 END")],
        [("t10", "CASE WHEN NOT critical_pii AND NOT toxic AND t9 = 4 AND overall_risk >= at_unsure_risk AND confidence <= at_unsure_confidence THEN least(t9, at_unsure_tier) ELSE t9 END" if confidence_aware else "t9")],
        [
            ("triggered_rules", listed(
                ("HIGH_CONSEQUENCE", "t1 > t0"), ("HIGH_CRITICALITY_ACTION", "t2 > t1"), ("PERFORMANCE_CONTRADICTION", "t3 > t2"), ("UNVERIFIED_EVIDENCE", "t4 > t3"),
                ("HIGH_RESPONSIBILITY_RISK", "t5 > t4"), ("LOW_DETECTOR_CONFIDENCE", "t6 > t5"), ("CRITICAL_PII", "critical_pii"), ("SEVERE_TOXICITY", "toxic"),
                ("COST_ONLY_CAP", "t9 < t8"), ("LOW_CONFIDENCE_HIGH_RISK", "t10 < t9"), ("AUTOMATED_ACTION", "action_automation >= 8e-1 AND t10 > 0"), ("SEVERITY_FLOOR", "severity_floor"))),
            ("tier_changing_rules", listed(
                ("COST_ONLY_CAP", "t9 < t8"), ("CRITICAL_PII", "t7 > t6"), ("HIGH_CONSEQUENCE", "t1 > t0"), ("HIGH_CRITICALITY_ACTION", "t2 > t1"), ("HIGH_RESPONSIBILITY_RISK", "t5 > t4"),
                ("LOW_CONFIDENCE_HIGH_RISK", "t10 < t9"), ("LOW_DETECTOR_CONFIDENCE", "t6 > t5"), ("PERFORMANCE_CONTRADICTION", "t3 > t2"), ("RISK_BAND", "t0 > 0"), ("SEVERE_TOXICITY", "t8 > t7"),
                ("UNVERIFIED_EVIDENCE", "t4 > t3"))),
            ("decision", "CASE t10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(C.TIERS)) + " END"),
            ("base_tier", "CASE t0 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(C.TIERS)) + " END"),
        ],
        [
            # each code once, where its first rule would put it
            ("reason_codes", listed(
                ("HIGH_CONSEQUENCE", "t10 > 0 AND (t1 > t0 OR t2 > t1)"), ("CONTRADICTED_EVIDENCE", "t10 > 0 AND t3 > t2"), ("LOW_VERIFICATION_COVERAGE", "t10 > 0 AND t4 > t3"),
                ("HIGH_RESPONSIBILITY_RISK", "t10 > 0 AND t5 > t4"), ("LOW_CONFIDENCE_HIGH_RISK", "t10 > 0 AND (t6 > t5 OR t10 < t9)"), ("CRITICAL_PII", "t10 > 0 AND critical_pii"),
                ("TOXICITY", "t10 > 0 AND toxic"), ("COST_SPIKE", "(t10 > 0 AND t9 < t8) OR hit_tokens_in OR hit_tokens_out OR hit_estimated_cost"), ("HIGH_PERFORMANCE_RISK", "t10 > 0 AND performance_risk >= 7e-1 AND NOT t3 > t2"),
                ("MULTI_RISK", "t10 > 0 AND multi_risk"), ("HIGH_FINANCIAL_IMPACT", "t10 > 0 AND financial_impact >= 8e-1"), ("IRREVERSIBLE_ACTION", "t10 > 0 AND reversibility >= 8e-1"),
                ("HIGH_BLAST_RADIUS", "t10 > 0 AND blast_radius >= 7e-1"), ("AUTOMATED_EXTERNAL_ACTION", "t10 > 0 AND criticality_codes LIKE '%AUTOMATED_EXTERNAL_ACTION%'"),
                ("RETRY_ANOMALY", "hit_retries"), ("TOOL_LOOP", "cost_anomalies LIKE '%TOOL_LOOP%'"), ("LATENCY_ANOMALY", "hit_latency_ms"))),
            ("decision_confidence", "CASE WHEN critical_pii OR toxic THEN greatest(confidence, resp_conf) WHEN t10 = 0 THEN greatest(confidence, 75e-2) ELSE confidence END"),
        ],
    ]


#: Columns of the decisions table.
DECISION = (
    "interaction_id timestamp session_id application model action_type tokens_in tokens_out latency_ms tool_calls retry_count estimated_cost cost_anomalies efficiency financial_impact reversibility"
    " sensitivity blast_radius action_automation consequence_score consequence_band action_criticality criticality_band perf_status performance_risk responsibility_risk cost_risk overall_risk confidence"
    " decision_confidence dominant_dimension multi_risk severity_floor disagreement deep_trigger_reasons verification_path base_tier decision triggered_rules tier_changing_rules reason_codes"
).split()


def add(df: DataFrame, layers: list[Layer]) -> DataFrame:
    for layer in layers:
        df = df.withColumns({name: F.expr(e) for name, e in layer})
    return df


def interactions(events: DataFrame) -> DataFrame:
    return add(events.withColumnRenamed("ts", "timestamp"), EVENTS)


def baselines(priced: DataFrame, at: float = C.BASELINE_AT) -> DataFrame:
    """Interpolated percentile of every usage figure by application and model."""
    fits = percentiles(priced, SEGMENT, FITTED, at)
    return fits.select(*SEGMENT, *(F.col(x).alias(f"fit_{x}") for x in FITTED))


def signals(rows: DataFrame) -> DataFrame:
    """Cost, stakes and fused risk of every interaction; all that does not depend on the policy."""
    priced = add(rows, PRICE)
    return add(priced.join(F.broadcast(baselines(priced)), list(SEGMENT), "left"), COST + STAKES + FUSE)


def priced(rows: DataFrame, fitted: bool = True) -> DataFrame:
    """Cost and stakes of every interaction: all that neither a check nor the policy changes.

    Without ``fitted`` the fixed baselines alone hold, and cost is judged with less confidence.
    """
    own = add(rows, PRICE)
    if not fitted:
        return add(own.withColumns({f"fit_{x}": F.lit(None).cast("double") for x in FITTED}), COST + STAKES)
    return add(own.join(F.broadcast(baselines(own)), list(SEGMENT), "left"), COST + STAKES)


def efficiency(costed: DataFrame) -> DataFrame:
    """Efficiency, cost per success, wasted retries, and how sure the cost detector is, from which baseline."""
    source = F.when(F.col("fit_estimated_cost").isNull(), "static").otherwise("empirical")
    per_success = F.greatest("estimated_cost", F.lit(1e-9))  # one answer, whatever the attempts before it cost
    return costed.select("interaction_id", "efficiency", r4(per_success, 6).alias("cost_per_success"), r4(F.col("retry_share")).alias("retry_inefficiency"), "cost_confidence", source.alias("baseline_source"))


def decide(scored: DataFrame, confidence_aware: bool = True, profile: str = "application") -> DataFrame:
    """Apply the policy; ``profile`` is an expression for the name of the profile of a row."""
    profiles = scored.sparkSession.createDataFrame(profile_rows(), ", ".join(f"{n} {t}" for n, t in PROFILE))
    return add(scored.withColumn("profile", F.expr(PROFILE_OF.format(profile))).join(F.broadcast(profiles), "profile"), policy_layers(confidence_aware))


def blocked_by_toxicity(rows: DataFrame) -> DataFrame:
    """Add ``severe`` (the policy's rule of toxicity) and the decision that it forces; null where it says nothing.

    The rule gives the highest tier. Of the two rules after it, one leaves out what a safety rule raised, the other what is
    toxic, so the tier stays, whatever the other columns hold.
    """
    profiles = rows.sparkSession.createDataFrame(profile_rows(), ", ".join(f"{n} {t}" for n, t in PROFILE))
    judged = rows.withColumn("profile", F.expr(PROFILE_OF.format("application"))).join(F.broadcast(profiles), "profile").withColumn("severe", F.expr(dict(policy_layers()[0])["toxic"]))
    return judged.select(*rows.columns, "severe", F.when(F.col("severe"), C.TIERS[-1]).alias("decision"))


def top_contributors(scored: DataFrame, most: int = 2) -> DataFrame:
    """The factors that add most to the consequence of each interaction, ties in the order of the factors."""
    parts = [F.struct((-F.round(F.col(f) * w + F.lit(1e-9), 6)).alias("less"), F.lit(i).alias("i"), F.lit(f).alias("factor")) for i, (f, w) in enumerate(C.CONSEQUENCE.items())]
    best = F.filter(F.slice(F.array_sort(F.array(*parts)), 1, most), lambda x: x["less"] < 0)
    return scored.select("interaction_id", F.array_join(F.transform(best, lambda x: x["factor"]), ",").alias("top_contributors"))


def decisions(events: DataFrame) -> DataFrame:
    return decide(signals(interactions(events))).select(*DECISION)


# --- the same layers as SQL text, for engines other than Spark -----------------------------------------------------


def layered_sql(source: str, layers: list[Layer]) -> str:
    for layer in layers:
        source = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in layer) + f" FROM ({source})"
    return source


def signals_sql() -> str:
    priced = layered_sql("SELECT *, ts AS timestamp FROM events", EVENTS + PRICE)
    fits = ", ".join(f"quantile_cont({x}, {C.BASELINE_AT}) AS fit_{x}" for x in FITTED)
    return (
        f"priced AS MATERIALIZED ({priced}), fitted AS MATERIALIZED (SELECT application, model, {fits} FROM priced GROUP BY ALL), "
        f"scored AS MATERIALIZED ({layered_sql('SELECT p.*, ' + ', '.join('f.fit_' + x for x in FITTED) + ' FROM priced p LEFT JOIN fitted f USING (application, model)', COST + STAKES + FUSE)})"
    )


def decide_sql(source: str = "scored", confidence_aware: bool = True, profile: str = "application") -> str:
    rows = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else num(v) for v in row) + ")" for row in profile_rows())
    joined = f"SELECT * FROM (SELECT *, {PROFILE_OF.format(profile)} AS profile FROM {source}) JOIN (VALUES {rows}) p({', '.join(n for n, _ in PROFILE)}) USING (profile)"
    return layered_sql(joined, policy_layers(confidence_aware))


def decisions_sql() -> str:
    """CTEs up to ``decisions``."""
    return f"{signals_sql()}, decisions AS MATERIALIZED (SELECT {', '.join(DECISION)} FROM ({decide_sql()}))"
