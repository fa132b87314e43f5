"""The registered queries of the risk-oversight jobs, with the same work as SQL text where SQL expresses it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions import lexicons as L
from vigil.operators import adaptive as AD
from vigil.operators import calibration as K
from vigil.operators import evaluation as E
from vigil.operators import factors as FM
from vigil.operators import governance as G
from vigil.operators import grounding as G2
from vigil.operators import incidents as I
from vigil.operators import memory as MEM
from vigil.operators import monitoring as M
from vigil.operators import patterns as PT
from vigil.operators import replay as P
from vigil.operators import responsibility as R
from vigil.operators import routing as V
from vigil.operators import summaries as SU
from vigil.operators import trace as TR
from vigil.operators import views as Y
from vigil.plans import decide as D
from vigil.plans import texts as TX
from vigil.sources import tables as W
from vigil.sources.tables import shared_dir, staged, stored
from vigil.streaming import expiry as XE
from vigil.streaming import late as XL
from vigil.streaming import session as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions table, which reports share."""
    return staged(D.decisions(table(spark, sf_dir, "events")), "decisions", sf_dir)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def on_decisions(name: str, report: Callable[[DataFrame], DataFrame], sql: str, more: str = "") -> None:
    """A report over the decisions table; ``more`` are further CTEs of its SQL."""
    add(name, lambda spark, sf_dir: report(decided(spark, sf_dir)), f"WITH {D.decisions_sql()}{', ' + more if more else ''} {sql}")


def _set(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def r4(x: str, places: int = 4) -> str:
    return f"round(({x}) + 1e-9, {places})"


def rate(condition: str) -> str:
    return r4(f"avg(CASE WHEN {condition} THEN 1e0 ELSE 0e0 END)")


def many(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def nearest(x: str, at: float) -> str:
    return f"list_sort(list({x}))[CAST(round_even({at} * (count({x}) - 1), 0) AS INT) + 1]"


def exploded(column: str, alias: str, source: str = "decisions") -> str:
    return f"(SELECT *, unnest(list_filter(string_split({column}, ','), lambda x: x <> '')) AS {alias} FROM {source})"


# --- decisions ------------------------------------------------------------------------------------------------------

add("d14_decisions", lambda s, d: D.decisions(table(s, d, "events")), f"WITH {D.decisions_sql()} SELECT * FROM decisions")
add("c02_cost_baselines", lambda s, d: D.baselines(D.add(D.interactions(table(s, d, "events")), D.PRICE)).select("application", "model", *(F.round(F.col(f"fit_{x}") + 1e-9, 4).alias(x) for x in D.FITTED)),
    f"WITH {D.signals_sql()} SELECT application, model, {', '.join(r4('fit_' + x) + ' AS ' + x for x in D.FITTED)} FROM fitted")
_COST = ["interaction_id", "estimated_cost", *(f"hit_{x}" for x in (*D.RATIOS, "tools", "retries")), "cost_risk", "cost_anomalies", "efficiency"]
add("c04_cost_anomalies", lambda s, d: D.signals(D.interactions(table(s, d, "events"))).select(*_COST), f"WITH {D.signals_sql()} SELECT {', '.join(_COST)} FROM scored")
_STAKES = ["interaction_id", "consequence_score", "consequence_band", "action_criticality", "criticality_band", "criticality_codes"]
add("f01_consequence_criticality", lambda s, d: D.signals(D.interactions(table(s, d, "events"))).select(*_STAKES), f"WITH {D.signals_sql()} SELECT {', '.join(_STAKES)} FROM scored")
_FUSED = ["interaction_id", "performance_risk", "responsibility_risk", "cost_risk", "overall_risk", "confidence", "dominant_dimension", "multi_risk", "severity_floor"]
add("f06_risk_fusion", lambda s, d: D.signals(D.interactions(table(s, d, "events"))).select(*_FUSED), f"WITH {D.signals_sql()} SELECT {', '.join(_FUSED)} FROM scored")
_ROUTED = ["interaction_id", "disagreement", "deep_trigger_reasons", "verification_path"]
add("v01_disagreement", lambda s, d: D.signals(D.interactions(table(s, d, "events"))).select("interaction_id", "disagreement"), f"""WITH {D.signals_sql()} SELECT interaction_id, round(least(1e0, greatest(0e0,
    0.35e0 * least(1e0, list_aggregate([performance_risk, responsibility_risk, cost_risk], 'stddev_pop') / 0.35e0) + 0.25e0 * (1e0 - ((41 * interaction_id) % 100) / 100e0) + 0.15e0 * (((19 * interaction_id) % 10) / 10e0)
    + 0.15e0 * greatest(0e0, (0.6e0 - confidence) / 0.6e0) + 0.1e0 * (perf_raw >= 35e-2 AND perf_raw < 74e-2)::INT)) + 1e-9, 4) AS disagreement FROM scored""")
add("v02_routing_gates", lambda s, d: D.signals(D.interactions(table(s, d, "events"))).select(*_ROUTED), f"WITH {D.signals_sql()} SELECT {', '.join(_ROUTED)} FROM scored")

# --- monitoring -----------------------------------------------------------------------------------------------------

_RATES = ", ".join(f"{rate(f'''decision = '{t}' ''')} AS rate_{t.lower()}" for t in C.TIERS)
_COUNTS = ", ".join(f"{many(f'''decision = '{t}' ''')} AS n_{t.lower()}" for t in C.TIERS)
DEEP, FAST = "verification_path = 'DEEP'", "verification_path = 'FAST'"
on_decisions("a01_snapshot", M.snapshot, f"""SELECT count(*) AS total, {_COUNTS}, {_RATES}, {r4('avg(overall_risk)')} AS mean_risk, {r4('avg(latency_ms)')} AS mean_latency,
    {r4('avg(decision_confidence)')} AS mean_confidence, {r4('avg(cost_risk)')} AS mean_cost_risk, {rate(f'decision_confidence < {C.LOW_CONFIDENCE}')} AS low_confidence_rate, {rate(FAST)} AS fast_rate,
    {rate(DEEP)} AS deep_rate, {rate("consequence_band = 'high'")} AS high_consequence_rate, {rate("criticality_band = 'high'")} AS high_criticality_rate, {rate('multi_risk')} AS multi_risk_rate,
    {nearest('overall_risk', .95)} AS p95_risk, {r4(nearest('latency_ms', .95))} AS p95_latency FROM decisions""")
on_decisions("a02_nearest_rank_percentiles", M.percentiles, f"SELECT application, {nearest('overall_risk', .5)} AS p50, {nearest('overall_risk', .95)} AS p95 FROM decisions GROUP BY application")
_BUCKETS = ", ".join(f"('{n}', {lo}e0, {hi}e0)" for n, lo, hi in C.BUCKETS)
on_decisions("a04_risk_distribution", M.risk_distribution, f"""SELECT b.bucket, b.low, b.high, count(d.overall_risk) AS n, {r4('count(d.overall_risk) / (SELECT count(*) FROM decisions)')} AS share
    FROM (VALUES {_BUCKETS}) b(bucket, low, high) LEFT JOIN decisions d ON d.overall_risk >= b.low AND d.overall_risk < b.high GROUP BY ALL""")
_LONG = " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS risk, interaction_id FROM decisions" for x in ("performance_risk", "responsibility_risk", "cost_risk", "overall_risk"))
on_decisions("a05_histograms", M.histograms, f"SELECT dimension, CAST(least(floor(risk * 5), 4) AS INT) AS band, count(*) AS n FROM ({_LONG}) WHERE risk >= 0 AND risk < 1.0001 GROUP BY ALL")
on_decisions("a06_application_summary", M.application_summary, f"""SELECT application, count(*) AS total, {_RATES}, {r4('avg(overall_risk)')} AS mean_risk, {r4('avg(decision_confidence)')} AS mean_confidence,
    {r4('avg(performance_risk)')} AS mean_performance, {r4('avg(responsibility_risk)')} AS mean_responsibility, {r4('avg(cost_risk)')} AS mean_cost, {rate(DEEP)} AS deep_rate,
    {nearest('overall_risk', .95)} AS p95_risk, any_value(m.dominant_dimension) AS dominant_dimension FROM (SELECT * EXCLUDE (dominant_dimension) FROM decisions) d JOIN m USING (application) GROUP BY application""",
    "c AS (SELECT application, dominant_dimension, count(*) AS n FROM decisions GROUP BY ALL), m AS (SELECT application, dominant_dimension FROM c QUALIFY row_number() OVER (PARTITION BY application ORDER BY n DESC, dominant_dimension) = 1)")


def _segment_sql(key: str) -> str:
    return f"""SELECT coalesce({key}, 'unknown') AS {key}, count(*) AS total, {r4('avg(overall_risk)')} AS mean_risk, {rate(DEEP)} AS deep_rate, {rate("decision = 'HUMAN_REVIEW'")} AS review_rate,
        {rate("decision = 'BLOCK'")} AS block_rate, {r4('avg(latency_ms)')} AS mean_latency, {many(f'decision_confidence < {C.LOW_CONFIDENCE}')} AS low_confidence, {nearest('overall_risk', .95)} AS p95_risk FROM decisions GROUP BY 1"""


on_decisions("a07_application_metrics", lambda d: M.segment_metrics(d, "application"), _segment_sql("application"))
on_decisions("a08_model_metrics", lambda d: M.segment_metrics(d, "model"), _segment_sql("model"))
on_decisions("a09_verification_by_application", M.verification_by_application, f"""SELECT application, {many(FAST)} AS fast, {many(DEEP)} AS deep, {r4(f'avg(latency_ms) FILTER (WHERE {FAST})')} AS fast_latency,
    {r4(f'avg(latency_ms) FILTER (WHERE {DEEP})')} AS deep_latency FROM decisions GROUP BY application""")
_DETECTORS = " UNION ALL ".join(f"SELECT '{n}' AS detector, {n}_risk AS risk, {w}e0 AS weight, dominant_dimension FROM decisions" for n, w in C.FUSION.items())
on_decisions("a10_detectors", M.detectors, f"""SELECT detector, count(risk) AS coverage, {r4('avg(risk)')} AS mean_risk, {rate('risk >= 0.5')} AS high_rate, {r4('avg(risk * weight)')} AS mean_contribution,
    {many('dominant_dimension = detector')} AS dominant FROM ({_DETECTORS}) GROUP BY detector""")
on_decisions("a12_reason_codes", M.reason_codes, f"""SELECT code, count(*) AS n, {r4("least(1e0, count(*) / (SELECT count(*) FROM decisions WHERE decision <> 'ALLOW'))")} AS share
    FROM {exploded('reason_codes', 'code')} GROUP BY code""")
on_decisions("a14_rule_behaviour", M.rule_behaviour, f"""SELECT rule, coalesce(fired, 0) AS fired, {r4('coalesce(fired, 0) / (SELECT count(*) FROM decisions)')} AS fire_rate, coalesce(moved, 0) AS moved,
    coalesce(to_review, 0) AS to_review, coalesce(to_block, 0) AS to_block FROM f FULL JOIN m USING (rule)""",
    f"f AS (SELECT rule, count(*) AS fired FROM {exploded('triggered_rules', 'rule')} GROUP BY 1), m AS (SELECT rule, count(*) AS moved, {many('''decision = 'HUMAN_REVIEW' ''')} AS to_review, {many('''decision = 'BLOCK' ''')} AS to_block FROM {exploded('tier_changing_rules', 'rule')} GROUP BY 1)")
on_decisions("a15_verification_summary", M.verification_summary, f"SELECT reason, count(*) AS n, {r4('count(*) / (SELECT count(*) FROM decisions)')} AS share FROM {exploded('deep_trigger_reasons', 'reason')} GROUP BY reason")
on_decisions("a16_multi_turn", M.multi_turn, f"""SELECT count(*) AS sessions, {many('turns >= 2')} AS multi_turn, {rate('critical')} AS critical_share, max(turns) AS longest
    FROM (SELECT session_id, count(*) AS turns, bool_or(decision = 'BLOCK') AS critical FROM decisions GROUP BY 1)""")
_TREND = f"count(*) AS total, {r4('avg(overall_risk)')} AS mean_risk, {rate('''decision = 'BLOCK' ''')} AS block_rate, {rate('''decision = 'HUMAN_REVIEW' ''')} AS review_rate, {rate(DEEP)} AS deep_rate"
for _unit in ("hour", "day"):
    on_decisions(f"w07_trend_by_{_unit}", lambda d, u=_unit: M.trend(d, u), f"SELECT date_trunc('{_unit}', timestamp) AS bucket, {_TREND} FROM decisions GROUP BY 1")
_FROM, _TO = "2024-01-02 00:00:00", "2024-01-05 12:00:00"
on_decisions("p03_time_window", lambda d: M.windowed(d, _FROM, _TO), f"""SELECT {many('inside')} AS inside, {many('NOT inside')} AS outside, {r4('avg(overall_risk) FILTER (WHERE inside)')} AS mean_risk
    FROM (SELECT *, timestamp BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}' AS inside FROM decisions)""")
_POSTURE = _LONG.replace("'overall_risk'", "'consequence_score'").replace("overall_risk AS risk", "consequence_score AS risk")
on_decisions("a27_risk_posture", M.risk_posture, f"SELECT dimension, {r4('avg(risk)')} AS mean_risk, {many('risk >= 0.5')} AS high, max({r4('risk')}) AS max_risk FROM ({_POSTURE}) GROUP BY dimension")
on_decisions("a28_application_posture", M.application_posture, f"""SELECT *, CASE WHEN mean_risk >= 0.5 THEN 'HIGH' WHEN mean_risk >= 0.25 THEN 'MODERATE' ELSE 'LOW' END AS posture FROM (
    SELECT application, count(*) AS total, {r4('avg(overall_risk)')} AS mean_risk, {rate("decision IN ('HUMAN_REVIEW', 'BLOCK')")} AS oversight_rate FROM decisions GROUP BY 1)""")
on_decisions("a29_heatmap", M.heatmap, f"SELECT application, dimension, {r4('avg(risk)')} AS mean_risk FROM (SELECT l.*, d.application FROM ({_LONG}) l JOIN decisions d USING (interaction_id)) GROUP BY ALL")
on_decisions("a31_statistics", M.statistics, f"""SELECT count(*) AS total, {rate("decision IN ('HUMAN_REVIEW', 'BLOCK')")} AS oversight_rate, {r4('avg(overall_risk)')} AS mean_risk, max(overall_risk) AS max_risk,
    {r4('avg(latency_ms)')} AS mean_latency, {r4('max(latency_ms)')} AS max_latency, {many(f'decision_confidence < {C.LOW_CONFIDENCE}')} AS low_confidence, {r4(nearest('overall_risk', .5))} AS p50_risk,
    {r4(nearest('overall_risk', .95))} AS p95_risk, {r4(nearest('latency_ms', .5))} AS p50_latency, {r4(nearest('latency_ms', .95))} AS p95_latency FROM decisions""")
on_decisions("a26_dashboard", M.dashboard, f"""SELECT count(*) AS total, {r4('sum(estimated_cost)', 2)} AS total_cost, {r4('avg(estimated_cost)')} AS mean_cost, {r4('avg(efficiency)')} AS mean_efficiency,
    {many("perf_status = 'SUPPORTED'")} AS n_supported, {many("perf_status = 'UNVERIFIED'")} AS n_unverified, {many("perf_status = 'CONTRADICTED'")} AS n_contradicted FROM decisions""")
_A = C.ATTENTION
on_decisions("g04_attention_signals", M.attention_signals, f"""SELECT signal, {r4('value')} AS value, threshold, CASE WHEN NOT low AND value >= threshold * {_A['times']}e0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
    FROM s WHERE CASE WHEN low THEN value < threshold ELSE value > threshold END""",
    f"""s AS (SELECT 'high_block_rate' AS signal, avg((decision = 'BLOCK')::INT) AS value, {_A['block']}e0 AS threshold, false AS low FROM decisions
    UNION ALL SELECT 'high_human_review_rate', avg((decision = 'HUMAN_REVIEW')::INT), {_A['review']}e0, false FROM decisions UNION ALL SELECT 'high_deep_verification_rate', avg(({DEEP})::INT), {_A['deep']}e0, false FROM decisions
    UNION ALL SELECT 'high_risk_concentration', avg((overall_risk >= 0.5)::INT), {_A['concentration']}e0, false FROM decisions UNION ALL SELECT 'low_mean_confidence', avg(decision_confidence), {_A['confidence']}e0, true FROM decisions)""")  # fmt: skip
_METRICS = {"average_risk": "overall_risk", "intervention_rate": "(decision <> 'ALLOW')::INT", "review_rate": "(decision = 'HUMAN_REVIEW')::INT", "block_rate": "(decision = 'BLOCK')::INT",
            "deep_rate": f"({DEEP})::INT", "mean_confidence": "decision_confidence", "cost_risk": "cost_risk"}


def _compare_sql(first: str, flat: float) -> tuple[str, str]:
    ctes = f"o AS (SELECT *, row_number() OVER (ORDER BY timestamp, interaction_id) - 1 AS i, count(*) OVER () AS n FROM decisions), p AS MATERIALIZED (SELECT *, {first} AS first FROM o), v AS (" + " UNION ALL ".join(
        f"SELECT '{k}' AS metric, avg({v}) FILTER (WHERE first) AS b, avg({v}) FILTER (WHERE NOT first) AS r, {many('first')} AS n_first, {many('NOT first')} AS n_second FROM p" for k, v in _METRICS.items()) + ")"
    sql = f"SELECT metric, {r4('b')} AS baseline, {r4('r')} AS recent, {r4('r - b')} AS delta, CASE WHEN abs(r - b) <= {flat} THEN 'flat' WHEN r > b THEN 'up' ELSE 'down' END AS direction, n_first, n_second FROM v"
    return sql, ctes


on_decisions("g01_half_trend", M.half_trend, *_compare_sql("i < n // 2", 0.05))
on_decisions("g03_recent_shift", M.recent_shift, *_compare_sql("i < n - greatest(1, CAST(round_even(0.25 * n, 0) AS BIGINT))", 0.03))

# --- incidents ------------------------------------------------------------------------------------------------------

_LISTED = "coalesce(nullif(list_aggregate(list_sort(list_filter(string_split({0}, ','), lambda x: x <> '')), 'string_agg', ','), ''), '-')"
_INCIDENTS = f"""incidents AS MATERIALIZED (SELECT *, 'INC-' || upper(substr(sha1(CAST(interaction_id AS VARCHAR)), 1, 10)) AS incident_id,
    CASE WHEN decision = 'BLOCK' OR overall_risk >= {C.CRITICAL_RISK} OR list_contains(string_split(reason_codes, ','), 'CRITICAL_PII') THEN 'CRITICAL'
         WHEN decision = 'HUMAN_REVIEW' OR (consequence_score >= {C.HIGH_CONSEQUENCE} AND overall_risk >= {C.ELEVATED_RISK}) OR (multi_risk AND overall_risk >= {C.ELEVATED_RISK}) THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    concat_ws('|', 'app:' || application, 'dim:' || dominant_dimension, 'tier:' || decision, 'verify:' || verification_path, 'reasons:' || {_LISTED.format('reason_codes')}, 'rules:' || {_LISTED.format('tier_changing_rules')},
        'cons:' || consequence_band, 'crit:' || criticality_band) AS signature
    FROM (SELECT *, concat_ws(',', CASE WHEN decision = 'BLOCK' THEN 'BLOCK' END, CASE WHEN decision = 'HUMAN_REVIEW' THEN 'HUMAN_REVIEW' END, CASE WHEN multi_risk THEN 'MULTI_RISK' END,
        CASE WHEN list_contains(string_split(reason_codes, ','), 'HIGH_CONSEQUENCE') AND overall_risk >= {C.ELEVATED_RISK} THEN 'HIGH_CONSEQUENCE_WITH_ELEVATED_RISK' END) AS triggers FROM decisions) WHERE triggers <> '')"""


def on_incidents(name: str, report: Callable[[DataFrame], DataFrame], sql: str, more: str = "") -> None:
    on_decisions(name, lambda d: report(I.incidents(d)), sql, _INCIDENTS + (", " + more if more else ""))


_CLUSTERS = f"""clusters AS (SELECT signature, count(*) AS n, {r4('avg(overall_risk)')} AS mean_risk, max(overall_risk) AS max_risk, min(timestamp) AS first_seen, max(timestamp) AS last_seen, any_value(application) AS application,
    any_value(decision) AS decision, {r4('avg(decision_confidence)')} AS mean_confidence, count(*) >= {I.REPEATED} AS recurring FROM incidents GROUP BY signature)"""
_ID = ["incident_id", "interaction_id", "triggers", "severity", "signature"]
on_incidents("i03_incidents", lambda f: f.select(*_ID), f"SELECT {', '.join(_ID)} FROM incidents")
on_incidents("i05_clusters", I.clusters, "SELECT * FROM clusters", _CLUSTERS)
on_incidents("w10_riskiest_of_cluster", I.riskiest, f"SELECT signature, rank, interaction_id, overall_risk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY signature ORDER BY overall_risk DESC, interaction_id) AS INT) AS rank FROM incidents) WHERE rank <= 3")
on_incidents("w11_top_codes_of_cluster", I.top_codes, f"""SELECT signature, code, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY signature ORDER BY n DESC, code) AS INT) AS rank
    FROM (SELECT signature, code, count(*) AS n FROM {exploded('reason_codes', 'code', 'incidents')} GROUP BY ALL)) WHERE rank <= 3""")
on_incidents("a17_incident_digest", I.digest, f"""SELECT kind, name, count(*) AS n FROM (SELECT 'severity' AS kind, severity AS name FROM incidents UNION ALL SELECT 'application', application FROM incidents
    UNION ALL SELECT 'trigger', t FROM {exploded('triggers', 't', 'incidents')}) GROUP BY ALL""")
_GRADE = f"CASE WHEN n / {I.REPEATED} >= 1.6 THEN 'HIGH' WHEN n / {I.REPEATED} >= 1.25 THEN 'MEDIUM' ELSE 'LOW' END AS severity, {r4('least(1e0, 35e-2 + 4e-1 * least(1e0, n / 12) + 35e-2 * least(1e0, effect))', 3)} AS confidence"
on_incidents("i07_cluster_patterns", I.cluster_patterns, f"""SELECT pattern, application, subject, n, {r4('effect')} AS effect, {_GRADE} FROM (
    SELECT 'REPEATED_' || decision AS pattern, application, signature AS subject, n, 1e0 AS effect FROM clusters WHERE recurring AND decision IN ('BLOCK', 'VERIFY')
    UNION ALL SELECT 'LOW_CONFIDENCE_CLUSTER', application, signature, n, 1 - mean_confidence FROM clusters WHERE recurring AND mean_confidence < {C.LOW_CONFIDENCE})""", _CLUSTERS)
on_incidents("i11_dominance_patterns", I.dominance_patterns, f"""SELECT pattern, subject, n, {r4('n / total')} AS share FROM (SELECT *, sum(n) OVER (PARTITION BY pattern) AS total FROM (
    SELECT 'RULE_DOMINANCE' AS pattern, rule AS subject, count(*) AS n FROM {exploded('tier_changing_rules', 'rule', 'incidents')} GROUP BY ALL
    UNION ALL SELECT 'DETECTOR_DOMINANCE', dominant_dimension, count(*) FROM incidents GROUP BY ALL UNION ALL SELECT 'RISK_CONCENTRATION', application, count(*) FROM incidents GROUP BY ALL)) WHERE n / total >= {I.SHARE} AND total >= 5""")
on_decisions("i10_deep_concentration", I.deep_concentration, f"SELECT application, count(*) AS n, {rate(DEEP)} AS share FROM decisions GROUP BY 1 HAVING avg(({DEEP})::INT) >= {I.DEEP_SHARE}")
on_incidents("i14_cross_application", I.cross_application, r"SELECT regexp_replace(signature, '^app:[^|]*\|', '') AS subject, count(*) AS n, count(DISTINCT application) AS applications FROM incidents GROUP BY 1 HAVING count(DISTINCT application) >= 2")
on_incidents("i17_attribution", I.attribution, f"""SELECT application, kind, name, n, {r4('n / total')} AS share FROM (SELECT application, kind, name, count(*) AS n FROM (
    SELECT application, 'dimension' AS kind, dominant_dimension AS name FROM incidents UNION ALL SELECT application, 'decision', decision FROM incidents
    UNION ALL SELECT application, 'code', x FROM {exploded('reason_codes', 'x', 'incidents')} UNION ALL SELECT application, 'rule', x FROM {exploded('tier_changing_rules', 'x', 'incidents')}) GROUP BY ALL)
    JOIN (SELECT application, count(*) AS total FROM incidents GROUP BY 1) USING (application)""")
_RULES5 = f"top AS (SELECT rule, count(*) AS n FROM {exploded('tier_changing_rules', 'rule')} WHERE rule <> 'RISK_BAND' GROUP BY 1 ORDER BY n DESC, rule LIMIT 5)"
_DRIFT = [("'global'", "average_risk", "overall_risk"), ("'global'", "intervention_rate", "(decision <> 'ALLOW')::INT"), ("'global'", "deep_rate", f"({DEEP})::INT"), ("'global'", "incident_rate", "(decision IN ('BLOCK', 'HUMAN_REVIEW') OR multi_risk OR (',' || reason_codes || ',' LIKE '%,HIGH_CONSEQUENCE,%' AND overall_risk >= 5e-1))::INT"), *((f"'detector:{x}'", "mean_risk", f"{x}_risk") for x in I.DIMENSIONS), ("'application:' || application", "average_risk", "overall_risk")]
on_decisions("i19_drift", I.drift, f"""SELECT scope, metric, {r4('b')} AS baseline, {r4('r')} AS recent, {r4('r - b')} AS delta, CASE WHEN abs(r - b) <= {I.DRIFT_BAND} THEN 'STABLE' WHEN r > b THEN 'INCREASING' ELSE 'DECREASING' END AS direction,
    CASE WHEN abs(r - b) <= {I.DRIFT_BAND} THEN 'STABLE' WHEN abs(r - b) >= {I.DRIFT_AT} AND sufficient THEN 'POTENTIAL_DRIFT' ELSE 'TREND' END AS signal, sufficient FROM w WHERE b IS NOT NULL AND r IS NOT NULL""",
    f"""{_RULES5}, o AS (SELECT *, row_number() OVER (ORDER BY timestamp, interaction_id) - 1 < count(*) OVER () // 2 AS first FROM decisions),
    v AS ({' UNION ALL '.join(f"SELECT {s} AS scope, '{m}' AS metric, {x} AS value, first FROM o" for s, m, x in _DRIFT)}
    UNION ALL SELECT 'policy_rule:' || rule, 'fire_rate', list_contains(string_split(tier_changing_rules, ','), rule)::INT, first FROM o, top),
    w AS (SELECT scope, metric, avg(value) FILTER (WHERE first) AS b, avg(value) FILTER (WHERE NOT first) AS r, {many('first')} >= {I.DRIFT_SAMPLES} AND {many('NOT first')} >= {I.DRIFT_SAMPLES} AS sufficient FROM v GROUP BY ALL)""")  # fmt: skip

# --- governance -----------------------------------------------------------------------------------------------------

_ACTIONS = f"""actions AS (SELECT o_orderkey AS action_id, o_orderkey % (SELECT count(*) FROM events) AS interaction_id, o_orderdate AS timestamp,
    CASE o_orderstatus WHEN 'F' THEN 'APPROVE_DECISION' WHEN 'O' THEN 'MODIFY_DECISION' ELSE 'REJECT_DECISION' END AS action,
    CASE WHEN o_orderstatus = 'O' THEN CASE substr(o_orderpriority, 1, 1) {' '.join(f"WHEN '{i + 1}' THEN '{t}'" for i, t in enumerate(C.TIERS))} END END AS reviewer_decision FROM orders)"""
_FEEDBACK = """feedback AS (SELECT l_orderkey * 8 + l_linenumber AS feedback_id, l_orderkey % (SELECT count(*) FROM events) AS interaction_id,
    CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'modified' ELSE 'rejected' END AS outcome FROM lineitem)"""


def on_reviews(name: str, report: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], sql: str, more: str = "") -> None:
    """A report over decisions, reviewer actions and feedback."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = table(spark, sf_dir, "events").count()
        return report(decided(spark, sf_dir), G.actions(table(spark, sf_dir, "orders"), n), G.feedback(table(spark, sf_dir, "lineitem"), n))

    add(name, run, f"WITH {D.decisions_sql()}, {_ACTIONS}, {_FEEDBACK}{', ' + more if more else ''} {sql}")


_STATUS = "CASE action " + " ".join(f"WHEN '{a}' THEN '{s}'" for a, s in G.STATUS.items()) + " END"
_LEGAL = " OR ".join(f"(previous = '{s}' AND action IN ({', '.join(repr(v) for v in verbs)}))" for s, verbs in G.ALLOWED.items() if verbs)
on_reviews("w04_effective_decision", lambda d, a, f: G.effective(d, a), "SELECT interaction_id, application, decision, coalesce(m, decision) AS effective, coalesce(m <> decision, false) AS overridden FROM decisions LEFT JOIN x USING (interaction_id)",
    "x AS (SELECT interaction_id, arg_max(reviewer_decision, action_id) AS m FROM actions WHERE action = 'MODIFY_DECISION' AND reviewer_decision IS NOT NULL GROUP BY 1)")
on_reviews("a22_human_governance", lambda d, a, f: G.human_governance(d, a), "SELECT coalesce(status, 'OPEN') AS status, count(*) AS n FROM decisions LEFT JOIN x USING (interaction_id) GROUP BY 1",
    f"x AS (SELECT interaction_id, arg_max({_STATUS}, action_id) AS status FROM actions GROUP BY 1)")
on_reviews("w06_transition_check", lambda d, a, f: G.transition_check(a), f"""SELECT previous, action, count(*) AS n, {many(f"NOT (({_LEGAL}) AND NOT (action = 'MODIFY_DECISION' AND reviewer_decision IS NULL))")} AS violations FROM x GROUP BY ALL""",
    f"x AS (SELECT *, coalesce(lag({_STATUS}) OVER (PARTITION BY interaction_id ORDER BY action_id), 'OPEN') AS previous FROM actions)")
on_reviews("a23_reviewer_disagreement", lambda d, a, f: G.reviewer_disagreement(d, a), """SELECT concat_ws(' -> ', decision, reviewer_decision) AS transition, count(*) AS n FROM actions JOIN decisions USING (interaction_id)
    WHERE action = 'MODIFY_DECISION' AND reviewer_decision <> decision GROUP BY 1""")
on_reviews("a24_application_comparison", lambda d, a, f: G.application_comparison(d, a), f"""SELECT b.*, coalesce(actions, 0) AS actions, override_rate FROM (SELECT application, count(*) AS total, {r4('avg(overall_risk)')} AS mean_risk,
    {r4('avg(decision_confidence)')} AS mean_confidence, {rate("decision <> 'ALLOW'")} AS intervention_rate, {rate("decision = 'HUMAN_REVIEW'")} AS review_rate, {rate("decision = 'BLOCK'")} AS block_rate, {rate(DEEP)} AS deep_rate,
    {rate('multi_risk')} AS multi_risk_rate FROM decisions GROUP BY 1) b LEFT JOIN (SELECT application, count(*) AS actions, {rate("action = 'MODIFY_DECISION' AND reviewer_decision <> decision")} AS override_rate
    FROM actions JOIN decisions USING (interaction_id) GROUP BY 1) o USING (application)""")
_SIGNALS = """signals AS (SELECT s.*, coalesce(d.application, 'unknown') AS application, d.decision FROM (SELECT interaction_id, CASE action WHEN 'APPROVE_DECISION' THEN 'approval' WHEN 'MODIFY_DECISION' THEN 'modification' ELSE 'rejection' END AS kind FROM actions
    UNION ALL SELECT interaction_id, CASE outcome WHEN 'approved' THEN 'approval' WHEN 'modified' THEN 'modification' ELSE 'rejection' END FROM feedback) s LEFT JOIN decisions d USING (interaction_id))"""
on_reviews("a25_signal_summary", lambda d, a, f: G.signal_summary(G.signals(d, a, f)), " UNION ALL ".join(
    f"SELECT '{k}' AS scope, {n} AS name, count(*) AS n, {rate('''kind = 'modification' ''')} AS modification_rate, {rate('''kind = 'rejection' ''')} AS rejection_rate FROM signals GROUP BY ALL"
    for k, n in (("application", "application"), ("decision", "coalesce(decision, '-')"), ("kind", "kind"), ("all", "'-'"))), _SIGNALS)
on_reviews("a19_feedback_summary", lambda d, a, f: G.feedback_aggregate(f, d), f"""SELECT count(*) AS n, {many("outcome = 'approved'")} AS n_approved, {many("outcome = 'modified'")} AS n_modified, {many("outcome = 'rejected'")} AS n_rejected,
    {rate("outcome = 'approved'")} AS approval_rate, {rate("outcome <> 'approved'")} AS override_rate, count(DISTINCT interaction_id) AS interactions FROM feedback WHERE interaction_id IN (SELECT interaction_id FROM decisions)""")
_RANK = "list_position([" + ", ".join(f"'{t}'" for t in C.TIERS) + "], {0})"
on_reviews("a18_reviewer_confusion", lambda d, a, f: G.reviewer_confusion(d, a), f"""SELECT decision, reviewer_decision, CASE WHEN {_RANK.format('reviewer_decision')} > {_RANK.format('decision')} THEN 'escalation'
    WHEN {_RANK.format('reviewer_decision')} < {_RANK.format('decision')} THEN 'de-escalation' ELSE 'same' END AS move, count(*) AS n FROM actions JOIN decisions USING (interaction_id) WHERE reviewer_decision IS NOT NULL GROUP BY ALL""")
on_reviews("i18_override_patterns", lambda d, a, f: I.override_patterns(I.incidents(d), a.filter("reviewer_decision is not null")), f"""SELECT application, decision AS original, reviewer_decision, count(*) AS n,
    {r4('count(*) / any_value(total)')} AS rate FROM incidents JOIN actions USING (interaction_id) JOIN (SELECT application, count(*) AS total FROM incidents GROUP BY 1) USING (application)
    WHERE reviewer_decision <> decision GROUP BY ALL HAVING count(*) >= 3""", _INCIDENTS)
on_reviews("j01_incident_reviews", lambda d, a, f: I.with_reviews(I.incidents(d), a, f).select("interaction_id", "incident_id", "reviewer_signal", "feedback_outcome"), """SELECT interaction_id, incident_id, reviewer_signal, feedback_outcome
    FROM incidents LEFT JOIN (SELECT interaction_id, arg_max(s, action_id) AS reviewer_signal FROM (SELECT *, CASE action WHEN 'MODIFY_DECISION' THEN reviewer_decision ELSE action END AS s FROM actions) WHERE s IS NOT NULL GROUP BY 1) USING (interaction_id)
    LEFT JOIN (SELECT interaction_id, outcome AS feedback_outcome FROM feedback QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY feedback_id, outcome) = 1) USING (interaction_id)""", _INCIDENTS)
_KINDS = [("HIGH_OVERRIDE_RATE", "override_rate", 0.30), ("HIGH_HUMAN_REVIEW_RATE", "oversight_rate", 0.35), ("LOW_CONFIDENCE_TREND", "low_confidence_rate", 0.25), ("DEEP_ROUTING_CONCENTRATION", "deep_rate", 0.85)]
_INSIGHTS = f"""rates AS (SELECT application, count(*) AS total, {rate("decision IN ('HUMAN_REVIEW', 'BLOCK')")} AS oversight_rate, {rate("decision_confidence < 0.45")} AS low_confidence_rate, {rate(DEEP)} AS deep_rate FROM decisions GROUP BY 1),
    over AS (SELECT application, {rate("action = 'MODIFY_DECISION' AND reviewer_decision <> decision")} AS override_rate FROM actions JOIN decisions USING (interaction_id) GROUP BY 1),
    insights AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT application, '{k}' AS insight, {c} AS value, {v} AS threshold, total FROM rates LEFT JOIN over USING (application)" for k, c, v in _KINDS)}) WHERE value > threshold AND total >= 10),
    three AS (SELECT application, string_agg(interaction_id, ',' ORDER BY r) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY application ORDER BY overall_risk DESC, interaction_id) AS r FROM decisions) WHERE r <= 3 GROUP BY 1)"""
on_reviews("g05_insights", lambda d, a, f: G.insights(d, a), """SELECT application, insight, value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN value / threshold >= 1.6 THEN 'HIGH' WHEN value / threshold >= 1.25 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    examples FROM insights JOIN three USING (application)""", _INSIGHTS)
on_reviews("g06_recommendations", lambda d, a, f: G.recommendations(d, a), f"""SELECT recommendation, application, value FROM r UNION ALL SELECT 'NO_ACTION', NULL, NULL WHERE (SELECT count(*) FROM r) = 0""", _INSIGHTS + f""",
    whole AS (SELECT (SELECT {rate("decision IN ('HUMAN_REVIEW', 'BLOCK')")} FROM decisions) AS oversight, (SELECT {rate("action = 'MODIFY_DECISION' AND reviewer_decision <> decision")} FROM actions JOIN decisions USING (interaction_id)) AS override),
    r AS (SELECT 'REVIEW_THRESHOLD' AS recommendation, NULL AS application, oversight AS value FROM whole WHERE oversight > 0.35 AND (override IS NULL OR override < 0.20)
    UNION ALL SELECT CASE insight WHEN 'HIGH_OVERRIDE_RATE' THEN 'REVIEW_POLICY' ELSE 'REVIEW_DETECTOR' END, application, value FROM insights WHERE insight IN ('HIGH_OVERRIDE_RATE', 'LOW_CONFIDENCE_TREND'))""")

# --- evaluation and calibration -------------------------------------------------------------------------------------

_LABELLED = """SELECT *, round(label + 1e-9, 4) AS label_risk, contradicted OR pii OR toxic_text OR biased OR costly AS truly_risky,
    CASE WHEN pii THEN 'BLOCK' WHEN label <= 0.20 THEN 'ALLOW' WHEN label <= 0.40 THEN 'ANNOTATE' WHEN label <= 0.60 THEN 'VERIFY' WHEN label <= 0.85 THEN 'HUMAN_REVIEW' ELSE 'BLOCK' END AS expected
    FROM (SELECT *, 6e-1 * greatest(CASE WHEN contradicted THEN 8e-1 ELSE 5e-2 END, CASE WHEN pii THEN 85e-2 WHEN toxic_text THEN 75e-2 WHEN biased THEN 7e-1 ELSE 5e-2 END,
        CASE WHEN costly THEN 75e-2 ELSE 5e-2 END) + 4e-1 * consequence_score AS label
    FROM (SELECT *, perf_status = 'CONTRADICTED' AS contradicted, triggered_rules LIKE '%CRITICAL_PII%' AS pii, triggered_rules LIKE '%SEVERE_TOXICITY%' AS toxic_text, responsibility_risk >= 7e-1 AS biased,
        cost_anomalies <> '' AS costly FROM {}))"""


_LABELLED_SIGNALS = _LABELLED.format("scored").replace("triggered_rules LIKE '%CRITICAL_PII%'", "critical_pii").replace("triggered_rules LIKE '%SEVERE_TOXICITY%'", "toxicity_risk >= 85e-2")


def _binary_sql(source: str, truth: str, said: str, *keys: str) -> str:
    head = "".join(f"{k}, " for k in keys)
    safe = lambda a, b: r4(f"coalesce(({a}) / nullif({b}, 0), 0)")
    return f"""SELECT {head}tp, fp, fn, tn, {safe('tp', 'tp + fp')} AS precision, {safe('tp', 'tp + fn')} AS recall, {safe('2 * tp', '2 * tp + fp + fn')} AS f1, {safe('fp', 'fp + tn')} AS fpr, {safe('fn', 'fn + tp')} AS fnr,
        {safe('tp + tn', 'tp + tn + fp + fn')} AS accuracy FROM (SELECT {head}{many(f'{truth} AND {said}')} AS tp, {many(f'NOT {truth} AND {said}')} AS fp, {many(f'{truth} AND NOT {said}')} AS fn, {many(f'NOT {truth} AND NOT {said}')} AS tn FROM {source} {'GROUP BY ALL' if keys else ''})"""


on_decisions("e08_label_derivation", lambda d: E.with_labels(d).select("interaction_id", "label_risk", "truly_risky", "expected"), "SELECT interaction_id, label_risk, truly_risky, expected FROM l", f"l AS ({_LABELLED.format("decisions")})")
on_decisions("e01_binary_metrics", lambda d: E.binary(E.with_labels(d), F.col("truly_risky"), F.col("decision") != "ALLOW", "application"), _binary_sql("l", "truly_risky", "(decision <> 'ALLOW')", "application"), f"l AS ({_LABELLED.format("decisions")})")
_CELLS = ", ".join(f"('{a}', '{b}')" for a in C.TIERS for b in C.TIERS)
on_decisions("e02_confusion", lambda d: E.confusion(E.with_labels(d), "expected", "decision", C.TIERS), f"SELECT g.truth, g.said, count(l.decision) AS n FROM (VALUES {_CELLS}) g(truth, said) LEFT JOIN l ON l.expected = g.truth AND l.decision = g.said GROUP BY ALL", f"l AS ({_LABELLED.format("decisions")})")
_GRID = ", ".join(f"({t}e0)" for t in E.THRESHOLDS)
_SWEEP = f"l AS ({_LABELLED.format("decisions")}), s AS (SELECT l.*, t.threshold FROM l, (VALUES {_GRID}) t(threshold)), e AS ({_binary_sql('s', 'truly_risky', '(overall_risk >= threshold)', 'threshold')})"
on_decisions("e03_threshold_sweep", lambda d: E.threshold_sweep(E.with_labels(d), F.col("truly_risky"), "overall_risk"), "SELECT * FROM e", _SWEEP)
on_decisions("e04_best_threshold", lambda d: E.best_threshold(E.threshold_sweep(E.with_labels(d), F.col("truly_risky"), "overall_risk")), "SELECT * FROM e ORDER BY f1 DESC, threshold LIMIT 1", _SWEEP)
on_decisions("e05_evaluation_report", lambda d: E.report(E.with_labels(d)), f"""SELECT * FROM ({_binary_sql('l', 'truly_risky', "(decision <> 'ALLOW')")}), (SELECT {rate("decision IN ('VERIFY', 'HUMAN_REVIEW')")} AS abstention_rate,
    {rate("decision NOT IN ('VERIFY', 'HUMAN_REVIEW')")} AS coverage_rate, {rate('decision = expected')} AS exact_match FROM l)""", f"l AS ({_LABELLED.format("decisions")})")
on_decisions("e06_quadrants", lambda d: E.quadrants(E.with_labels(d)), f"""SELECT CASE WHEN overall_risk >= {C.EVALUATION['risk']} THEN 'high' ELSE 'low' END AS risk, CASE WHEN decision_confidence >= {C.EVALUATION['confidence']} THEN 'high' ELSE 'low' END AS confidence,
    count(*) AS n, {many('truly_risky')} AS truly_risky FROM l GROUP BY 1, 2""", f"l AS ({_LABELLED.format("decisions")})")


def on_signals(name: str, report: Callable[[DataFrame], DataFrame], sql: str, more: str) -> None:
    """A report that applies policies to the signals table itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(staged(D.signals(D.interactions(table(spark, sf_dir, "events"))), "signals", sf_dir))

    add(name, run, f"WITH {D.signals_sql()}, {more} {sql}")


_FLAT = {"performance_only": "performance_risk", "responsibility_only": "responsibility_risk", "cost_only": "cost_risk", "fused_only": "overall_risk",
         "fused_plus_consequence": "(6e-1 * overall_risk + 4e-1 * consequence_score)"}
_TIERED = {"risk_only_no_confidence": "unaware", "full_pipeline": "decision"}
_SAYS = [f"SELECT '{k}' AS mode, {v} >= 0.5 AS said, {v} >= 0.5 AS up, truly_risky FROM j" for k, v in _FLAT.items()]
_SAYS += [f"SELECT '{k}' AS mode, {v} <> 'ALLOW' AS said, {v} IN ('HUMAN_REVIEW', 'BLOCK') AS up, truly_risky FROM j" for k, v in _TIERED.items()]
on_signals("e07_ablation", E.ablation, f"""SELECT b.*, intervention_rate, clean_disturbed_rate, human_escalation_rate, clean_human_escalation_rate, risky_missed_by_escalation
    FROM ({_binary_sql("m", "truly_risky", "said", "mode")}) b JOIN (SELECT mode, {rate("said")} AS intervention_rate, {r4("coalesce(avg(said::INT) FILTER (WHERE NOT truly_risky), 0)")} AS clean_disturbed_rate,
    {rate("up")} AS human_escalation_rate, {r4("coalesce(avg(up::INT) FILTER (WHERE NOT truly_risky), 0)")} AS clean_human_escalation_rate, {many("truly_risky AND NOT up")} AS risky_missed_by_escalation FROM m GROUP BY 1) USING (mode)""",
    f"""f AS ({_LABELLED.format(f"({D.decide_sql()})")}), u AS (SELECT interaction_id, decision AS unaware FROM ({D.decide_sql(confidence_aware=False)})), j AS (SELECT * FROM f JOIN u USING (interaction_id)), m AS ({' UNION ALL '.join(_SAYS)})""")
_CAND = ", ".join(f"({i}, {r}e0, {c}e0)" for i, (r, c) in enumerate((r, c) for r in (0.35, 0.60, 0.85) for c in (0.30, 0.60, 0.90)))
_TOUCH = "deep AND decision <> 'ALLOW'"
_K3 = f"""f AS ({_LABELLED.format(f'({D.decide_sql()})')}), x AS (SELECT f.*, c.*, overall_risk >= risk_at OR (confidence < confidence_at AND overall_risk >= {C.DEEP['floor']}) OR consequence_score >= {C.DEEP['consequence']} OR action_criticality >= {C.DEEP['criticality']} AS deep
    FROM f, (VALUES {_CAND}) c(candidate, risk_at, confidence_at)), k AS (SELECT candidate, risk_at, confidence_at, {rate('deep')} AS deep_rate, {r4(f"{many(_TOUCH + ' AND truly_risky')} / {many('truly_risky')}")} AS recall,
    {r4(f"{many(_TOUCH + ' AND truly_risky')} / {many(_TOUCH)}")} AS precision, {r4(f"{many(_TOUCH + ' AND NOT truly_risky')} / {many('NOT truly_risky')}")} AS fpr, {rate("deep AND decision IN ('HUMAN_REVIEW', 'BLOCK')")} AS review_rate FROM x GROUP BY ALL),
    kv AS (SELECT *, concat_ws(',', CASE WHEN recall < 0.9 THEN 'recall' END, CASE WHEN fpr > 0.6 THEN 'fpr' END, CASE WHEN review_rate > 0.7 THEN 'review_rate' END) AS violations FROM k)"""
on_signals("k03_candidate_sweep", E.sweep, "SELECT * FROM k", _K3)
on_signals("k05_violations", lambda s: E.violations(E.sweep(s)), "SELECT * FROM kv", _K3)
on_signals("k06_selection", lambda s: E.select_candidate(E.sweep(s)), "SELECT * FROM kv ORDER BY violations <> '', CASE WHEN violations <> '' THEN -recall END, deep_rate, recall DESC, precision DESC, candidate LIMIT 1", _K3)
on_signals("k08_comparison", lambda s: E.comparison(E.sweep(s)), "SELECT k.candidate, " + ", ".join(f"{r4(f'k.{c} - b.{c}')} AS delta_{c}" for c in ("deep_rate", "recall", "precision")) + " FROM k, k b WHERE b.candidate = 0", _K3)
_QUOTED = {p: f'"{p}"' for p in C.PROFILES}
on_signals("k10_policy_simulation", E.simulate_policies, f"SELECT interaction_id, {', '.join(f'CAST({q} AS INT) AS {q}' for q in _QUOTED.values())}, greatest({', '.join(_QUOTED.values())}) <> least({', '.join(_QUOTED.values())}) AS differs FROM w",
    f"""t AS ({' UNION ALL '.join(f"SELECT interaction_id, '{p}' AS as_profile, t10 FROM ({D.decide_sql(profile=repr(p))})" for p in C.PROFILES)}),
    w AS (SELECT interaction_id, {', '.join(f"max(t10) FILTER (WHERE as_profile = '{p}') AS {q}" for p, q in _QUOTED.items())} FROM t GROUP BY 1)""")  # fmt: skip

# --- patterns with their applications, and what follows from them ------------------------------------------------------


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(decisions, incidents with reviewer signals, their patterns, reviewer actions with the tier they were about)."""
    d, n = decided(spark, sf_dir), table(spark, sf_dir, "events").count()
    log = G.actions(table(spark, sf_dir, "orders"), n).join(d.select("interaction_id", F.col("decision").alias("original_decision")), "interaction_id", "left")
    found = staged(I.with_reviews(I.incidents(d), log, G.feedback(table(spark, sf_dir, "lineitem"), n)), "reviewed-incidents", sf_dir)
    return d, found, staged(PT.patterns(found, d), "patterns", sf_dir), log


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: urgent orders as the log in which people approve or reject recommendations."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % n + 1).cast("int"))
    key = AD.recommendation_id(pick(AD.TYPES[:5], 5), pick(C.APPLICATIONS, 3))
    said = F.when(F.col("o_orderstatus") == "F", "APPROVED_FOR_EVALUATION").otherwise("REJECTED")
    return o.select(key.alias("recommendation_id"), said.alias("decision"), F.concat(F.lit("R-"), F.col("o_custkey")).alias("reviewer"), F.col("o_orderkey").alias("seq"))


def _advice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    d, found, patterns, log = _reviewed(spark, sf_dir)
    over = PT.override_patterns(found, log)
    safe = K.select(K.sweep(calibrated(spark, sf_dir), _GRID7))
    return d, patterns, over, AD.approvals_overlay(AD.recommendations(patterns, over, safe), _approvals(spark, sf_dir))


def _advice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, patterns, over, recs = _advice(spark, sf_dir)
    return AD.report(recs, patterns, I.drift(d), over)


_SEV = lambda r: f"CASE WHEN {r} >= 1.6 THEN 'HIGH' WHEN {r} >= 1.25 THEN 'MEDIUM' ELSE 'LOW' END"
_PATTERNS = f"""dom AS (SELECT *, {r4('n / total')} AS share FROM (SELECT *, sum(n) OVER (PARTITION BY type) AS total FROM (
        SELECT 'POLICY_RULE_DOMINANCE' AS type, rule AS subject, count(*) AS n FROM {exploded('tier_changing_rules', 'rule', 'incidents')} GROUP BY ALL
        UNION ALL SELECT 'DETECTOR_DOMINANCE', dominant_dimension, count(*) FROM incidents GROUP BY ALL UNION ALL SELECT 'RISK_CONCENTRATION', application, count(*) FROM incidents GROUP BY ALL)) WHERE n / total >= 0.5 AND total >= 5),
    pat0 AS (SELECT 'REPEATED_' || decision AS type, signature AS subject, {_SEV('n / 3')} AS severity, n AS incident_count, [application] AS applications FROM clusters WHERE recurring AND decision IN ('BLOCK', 'VERIFY')
        UNION ALL SELECT 'LOW_CONFIDENCE_CLUSTER', signature, {_SEV('n / 3')}, n, [application] FROM clusters WHERE recurring AND mean_confidence < {C.LOW_CONFIDENCE}
        UNION ALL SELECT type, subject, {_SEV('share / 0.5')}, n, CASE WHEN type = 'RISK_CONCENTRATION' THEN [subject] ELSE [] END FROM dom
        UNION ALL SELECT 'DEEP_ROUTING_CONCENTRATION', application, {_SEV(f"{rate(DEEP)} / 0.85")}, count(*), [application] FROM decisions GROUP BY application HAVING avg(({DEEP})::INT) >= 0.85
        UNION ALL SELECT 'CROSS_APPLICATION_PATTERN', subject, {_SEV('count(*) / 3')}, count(*), list_sort(list(DISTINCT application)) FROM (SELECT *, regexp_replace(signature, '^app:[^|]*\\|', '') AS subject FROM incidents) GROUP BY subject HAVING count(DISTINCT application) >= 2),
    pat AS MATERIALIZED (SELECT 'PAT-' || upper(substr(sha1(type || '|' || subject), 1, 10)) AS pattern_id, * FROM pat0),
    signalled AS MATERIALIZED (SELECT * FROM incidents LEFT JOIN (SELECT interaction_id, arg_max(s, action_id) AS reviewer_signal FROM (SELECT *, CASE action WHEN 'MODIFY_DECISION' THEN reviewer_decision ELSE action END AS s FROM actions) WHERE s IS NOT NULL GROUP BY 1) USING (interaction_id)),
    member AS (SELECT pattern_id, unnest(applications) AS application FROM pat UNION ALL SELECT pattern_id, application FROM pat, (SELECT DISTINCT application FROM incidents) WHERE len(applications) = 0),
    acted AS (SELECT a.*, coalesce(i.application, 'unknown') AS application, d.decision AS original_decision, i.reason_codes, i.tier_changing_rules,
        CASE WHEN action = 'REJECT_DECISION' THEN 'REJECTED' WHEN reviewer_decision <> d.decision THEN reviewer_decision END AS reviewer
        FROM actions a LEFT JOIN decisions d USING (interaction_id) LEFT JOIN incidents i USING (interaction_id) WHERE action IN ('MODIFY_DECISION', 'REJECT_DECISION')),
    over AS MATERIALIZED (SELECT application, original_decision, reviewer, n, {r4('least(1e0, n / reviewed)')} AS override_rate FROM (SELECT application, original_decision, reviewer, count(*) AS n FROM acted WHERE reviewer IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
        JOIN (SELECT application, original_decision, count(*) AS reviewed FROM acted GROUP BY ALL) USING (application, original_decision))"""


def on_patterns(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, more: str = "") -> None:
    add(name, run, f"WITH {D.decisions_sql()}, {_ACTIONS}, {_INCIDENTS}, {_CLUSTERS}, {_PATTERNS}{', ' + more if more else ''} {sql}")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("applications", F.array_join("applications", ","))


on_patterns("j09_patterns", lambda s, d: _flat(_reviewed(s, d)[2]), "SELECT * REPLACE (array_to_string(applications, ',') AS applications) FROM pat")
on_patterns("j09_memberships", lambda s, d: PT.memberships(*_reviewed(s, d)[1:3]), "SELECT * FROM member")
on_patterns("i17_pattern_attribution", lambda s, d: PT.attribution(*_reviewed(s, d)[1:3]), f"""SELECT pattern_id, kind, name, n, {r4('n / total')} AS share, row_number() OVER (PARTITION BY pattern_id, kind ORDER BY n DESC, name) = 1 AS dominant
    FROM (SELECT pattern_id, kind, name, count(*) AS n FROM member JOIN parts USING (application) GROUP BY ALL) JOIN (SELECT pattern_id, count(*) AS total FROM member JOIN incidents USING (application) GROUP BY 1) USING (pattern_id)""",
    f"""parts AS (SELECT application, 'dimension' AS kind, dominant_dimension AS name FROM incidents UNION ALL SELECT application, 'decision', decision FROM incidents UNION ALL SELECT application, 'override', 'any' FROM signalled WHERE reviewer_signal IS NOT NULL
    UNION ALL SELECT application, 'code', x FROM {exploded('reason_codes', 'x', 'incidents')} UNION ALL SELECT application, 'rule', x FROM {exploded('tier_changing_rules', 'x', 'incidents')})""")  # fmt: skip
_TOP4 = lambda c: f"SELECT application, original_decision, reviewer, string_agg(x, ',' ORDER BY r) AS top_{c} FROM (SELECT *, row_number() OVER (PARTITION BY application, original_decision, reviewer ORDER BY n DESC, x) AS r FROM (SELECT application, original_decision, reviewer, x, count(*) AS n FROM {exploded(c, 'x', 'acted')} WHERE reviewer IS NOT NULL GROUP BY ALL)) WHERE r <= 4 GROUP BY ALL"
on_patterns("i18_reviewer_patterns", lambda s, d: PT.override_patterns(_reviewed(s, d)[1], _reviewed(s, d)[3]), f"""SELECT over.*, coalesce(top_reason_codes, '') AS top_reason_codes, coalesce(top_tier_changing_rules, '') AS top_tier_changing_rules
    FROM over LEFT JOIN ({_TOP4('reason_codes')}) USING (application, original_decision, reviewer) LEFT JOIN ({_TOP4('tier_changing_rules')}) USING (application, original_decision, reviewer)""")
on_patterns("i06_cluster_details", lambda s, d: PT.cluster_details(_reviewed(s, d)[1]), f"""SELECT signature, min(concat_ws(' / ', application, decision, nullif(dominant_dimension, ''), nullif(array_to_string(list_filter(string_split(reason_codes, ','), lambda x: x <> '')[1:2], ' / '), ''), CASE WHEN verification_path = 'DEEP' THEN 'DEEP' END)) AS label,
    count(*) AS n, count(*) FILTER (verification_path = 'DEEP') AS deep, count(*) FILTER (verification_path <> 'DEEP') AS fast, count(reviewer_signal) AS reviewed, {r4('avg(overall_risk)')} AS mean_risk FROM signalled GROUP BY 1""")
_TYPED = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AD.TYPE_OF.items()) + " END"
_ADVICE = f"""asked AS (SELECT recommendation, application, coalesce(min(rank), 2) AS rank, coalesce(string_agg(DISTINCT pattern_id, ',' ORDER BY pattern_id), '') AS patterns, CAST(sum(incident_count) AS BIGINT) AS incident_count, coalesce(string_agg(DISTINCT transition, ',' ORDER BY transition), '') AS transitions FROM (
        SELECT {_TYPED} AS recommendation, application, pattern_id, list_position(['HIGH', 'MEDIUM', 'LOW', 'INFO'], severity) AS rank, incident_count, NULL AS transition FROM (SELECT *, unnest(CASE WHEN len(applications) = 0 THEN [NULL] ELSE applications END) AS application FROM pat)
        UNION ALL SELECT 'REVIEW_POLICY', application, NULL, NULL, n, concat_ws(' -> ', original_decision, reviewer) FROM over) GROUP BY ALL),
    votes AS (SELECT recommendation_id, arg_max(decision, seq) AS decision, arg_max(reviewer, seq) AS reviewer FROM (SELECT o_orderkey AS seq, 'R-' || o_custkey AS reviewer, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' ELSE 'REJECTED' END AS decision,
        'REC-' || upper(substr(sha1({_set(AD.TYPES[:5])}[o_orderkey % 5 + 1] || '|' || {_set(C.APPLICATIONS)}[o_orderkey % 3 + 1]), 1, 10)) AS recommendation_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P') GROUP BY 1),
    advice AS MATERIALIZED (SELECT recommendation_id, recommendation, application, ['HIGH', 'MEDIUM', 'LOW', 'INFO'][rank] AS severity, patterns, incident_count, transitions,
        coalesce(decision, CASE WHEN recommendation = 'REVIEW_VERIFICATION_THRESHOLD' AND (SELECT count(*) FROM sv WHERE candidate > 0 AND violations = '') > 0 THEN 'SIMULATED' ELSE 'RECOMMENDED_FOR_REVIEW' END) AS status, reviewer
        FROM (SELECT *, 'REC-' || upper(substr(sha1(recommendation || '|' || coalesce(application, 'GLOBAL')), 1, 10)) AS recommendation_id FROM asked) LEFT JOIN votes USING (recommendation_id))"""


# --- calibration that routes and decides again ----------------------------------------------------------------------


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events checked at both depths, with the truth that ``labels`` holds of their ids: toxic, or of low quality."""
    base = D.add(D.priced(D.interactions(table(spark, sf_dir, "events"))), [D.EVENTS_TIMES])
    both = K.both_depths(base, lambda rows: D.add(rows, D.EVENTS_DEEP), ("interaction_id", "fast_ms", "extra_ms"))
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("interaction_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("risky"))
    return staged(both.join(truth, "interaction_id"), "calibrated", sf_dir)


_GRID7 = {
    "risk": (0.25, 0.35, 0.45), "confidence": (0.60, 0.70, 0.80), "disagreement": (0.35, 0.45, 0.60), "floor": (0.10, 0.15),
    "consequence": (0.50, 0.60), "criticality": (0.55, 0.60), "extreme": (0.80, 0.85, 0.95),
}


def _calibrated_sql() -> str:
    """CTEs up to ``sw``: every row under every candidate, routed and judged one by one."""
    columns = ["candidate", *(f"at_{a}" for a in K.AXES)]
    values = ", ".join("(" + ", ".join(str(v) if i == 0 else f"{v}e0" for i, v in enumerate(c)) + ")" for c in K.grid(_GRID7))
    deep = D.decide_sql(f"({D.layered_sql('SELECT * FROM first_check', D.EVENTS_DEEP + D.FUSE)})")
    n = "count(*)"
    return f"""{D.signals_sql()}, first_check AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(name for layer in D.FUSE for name, _ in layer)}, {', '.join(f'at_{k}' for k in C.PROFILES['default'])}, profile, {', '.join(name for layer in (*D.policy_layers(), *D.EVENTS_DEEP) for name, _ in layer)}),
        overall_risk AS g_risk, confidence AS g_conf, disagreement AS g_dis, NOT evidence_available AS g_missing, t10 AS fast_tier FROM ({D.decide_sql()})),
    both_checks AS MATERIALIZED (SELECT b.*, 1e0 + tokens_out / 100e0 AS fast_ms, 2e0 + tokens_in / 100e0 AS extra_ms, l.toxic = 1 OR l.quality = 0 AS risky FROM ({deep}) b JOIN labels l ON l.doc_id = b.interaction_id),
    cand({', '.join(columns)}) AS (VALUES {values}),
    routed AS (SELECT c.*, risky, g_missing OR g_risk >= at_risk OR (g_conf < at_confidence AND g_risk >= at_floor) OR consequence_score >= at_consequence OR action_criticality >= at_criticality
        OR greatest(financial_impact, reversibility) >= at_extreme OR g_dis >= at_disagreement AS deep, fast_ms, extra_ms, fast_tier, t10 AS deep_tier FROM both_checks, cand c WHERE risky IS NOT NULL),
    judged AS (SELECT *, CASE WHEN deep THEN deep_tier ELSE fast_tier END AS tier FROM routed),
    counted AS (SELECT {', '.join(columns)}, {n} AS evaluation_count, {many('risky')} AS risky_count, {', '.join(f"{many(f'tier = {t}')} AS {name.lower()}" for t, name in enumerate(C.TIERS))},
        {many('risky AND tier > 0')} AS tp, {many('NOT risky AND tier > 0')} AS fp, {many('NOT deep')} AS fast, avg(fast_ms + CASE WHEN deep THEN extra_ms ELSE 0 END) AS ms FROM judged GROUP BY ALL),
    sw AS (SELECT {', '.join(columns)}, evaluation_count, risky_count, {', '.join(name.lower() for name in C.TIERS)}, {r4('(tp + evaluation_count - risky_count - fp) / evaluation_count')} AS accuracy,
        {r4('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r4('tp / risky_count')} AS recall, {r4('2 * tp / (tp + fp + risky_count)')} AS f1, {r4('fp / (evaluation_count - risky_count)')} AS false_positive_rate,
        {r4('(risky_count - tp) / risky_count')} AS missed_risk_rate, {r4('human_review / evaluation_count')} AS human_review_rate, {r4('fast / evaluation_count')} AS fast_path_rate,
        {r4('(evaluation_count - fast) / evaluation_count')} AS deep_path_rate, {r4('ms')} AS average_latency_ms FROM counted),
    sv AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {m} {'<' if op == '>=' else '>'} {v} THEN '{m}' END" for m, op, v in K.LIMITS)}) AS violations FROM sw)"""


def on_candidates(name: str, report: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: report(K.sweep(calibrated(s, d), _GRID7)), f"WITH {_calibrated_sql()} {sql}")


on_candidates("k03_routing_sweep", lambda c: c, "SELECT * FROM sw")
on_candidates("k05_limits", K.violations, "SELECT * FROM sv")
on_candidates("k08_against_today", K.comparison, "SELECT s.candidate, " + ", ".join(f"{r4(f's.{m} - t.{m}')} AS delta_{m}" for m in ("recall", "precision", "missed_risk_rate", "human_review_rate", "fast_path_rate", "average_latency_ms"))
    + " FROM sw s, sw t WHERE t.candidate = 0 AND s.candidate > 0")
_TIES = "recall DESC, precision DESC, human_review_rate, average_latency_ms, candidate"
for _goal, _first in (("MAX_FAST_PATH", "fast_path_rate DESC"), ("MIN_HUMAN_REVIEW", "human_review_rate"), ("MIN_LATENCY", "average_latency_ms")):
    on_candidates(f"k06_{_goal.lower()}", lambda c, g=_goal: K.select(c, g), f"SELECT * FROM sv WHERE candidate > 0 AND violations = '' ORDER BY {_first}, {_TIES} LIMIT 1")
on_candidates("k09_safe_candidates", lambda c: K.select(c, most=5), f"SELECT * FROM sv WHERE candidate > 0 AND violations = '' ORDER BY fast_path_rate DESC, {_TIES} LIMIT 5")

_CALIBRATED_ONLY = _calibrated_sql().removeprefix(f"{D.signals_sql()}, ")
on_patterns("g08_recommendations", lambda s, d: _advice(s, d)[3], "SELECT * FROM advice", f"{_CALIBRATED_ONLY}, {_ADVICE}")

on_patterns("g09_adaptive_report", _advice_report, f"""SELECT (SELECT count(*) FROM pat) AS patterns, (SELECT count(*) FROM drifts WHERE signal <> 'STABLE') AS drift_signals, (SELECT count(*) FROM drifts WHERE signal = 'POTENTIAL_DRIFT') AS potential_drift,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM over) AS reviewer_overrides, (SELECT count(*) FROM advice) AS recommendations, (SELECT count(*) FROM advice WHERE status = 'APPROVED') AS approved_for_evaluation,
    (SELECT count(*) FROM advice WHERE status = 'REJECTED') AS rejected, coalesce((SELECT scope || ' ' || metric FROM drifts WHERE signal <> 'STABLE' ORDER BY signal <> 'POTENTIAL_DRIFT', abs(delta) DESC, scope, metric LIMIT 1),
        (SELECT type || ' ' || subject FROM pat ORDER BY list_position(['HIGH', 'MEDIUM', 'LOW', 'INFO'], severity), incident_count DESC, type, subject LIMIT 1), 'NONE') AS observation, 'UNCHANGED' AS production_configuration""",
    f"{_CALIBRATED_ONLY}, {_ADVICE}, drifts AS ({SQL['i19_drift']})")

# --- small parts of cost and monitoring ------------------------------------------------------------------------------


def _efficiency_sql(fitted: bool) -> str:
    """By hand, from price and baseline."""
    base = f"greatest({C.STATIC['estimated_cost']}e0, {'coalesce(fit_estimated_cost, 0e0)' if fitted else '0e0'})"
    waste, tools = "least(1e0, retry_cost / greatest(estimated_cost, 1e-9))", "least(1e0, tool_cost / greatest(estimated_cost, 1e-9))"
    score = f"least(1e0, 0.55e0 * least(1e0, 1e0 / greatest(estimated_cost / {base}, 1e0)) + 0.25e0 * (1e0 - {waste}) + 0.2e0 * (1e0 - least(1e0, {tools} * 1.5e0))) * power(1e0 / (1 + retry_count), 0.4e0)"
    return f"""WITH {D.signals_sql()} SELECT interaction_id, {r4(score)} AS efficiency, {r4('greatest(estimated_cost, 1e-9)', 6)} AS cost_per_success, {r4(waste)} AS retry_inefficiency,
        CAST({0.82 if fitted else 0.7} AS DOUBLE) AS cost_confidence, '{'empirical' if fitted else 'static'}' AS baseline_source FROM scored"""


add("c07_efficiency", lambda s, d: D.efficiency(D.priced(D.interactions(table(s, d, "events")))), _efficiency_sql(True))
add("c09_static_baseline", lambda s, d: D.efficiency(D.priced(D.interactions(table(s, d, "events")), fitted=False)), _efficiency_sql(False))
#: What each detector took: stand-ins from usage, as the tables store no times.
_TOOK = {"performance": "1e0 + tokens_out / 100e0", "responsibility": "5e-1 + tokens_out / 400e0", "cost": "1e-1 + tool_calls / 50e0"}
on_decisions("a11_detector_latency", lambda d: M.detector_latency(d.withColumns({f"{k}_ms": F.expr(e) for k, e in _TOOK.items()}), {k: f"{k}_ms" for k in _TOOK}),
    " UNION ALL ".join(f"SELECT '{k}' AS detector, count(*) AS invocations, {r4(f'avg({e})')} AS mean_ms, {r4(nearest(e, .95))} AS p95_ms, {r4(f'max({e})')} AS max_ms FROM decisions" for k, e in _TOOK.items()))
on_decisions("p06_one_application", lambda d: M.kpis(M.of_application(d, "decision_support")).filter("application <> 'all'"), f"""SELECT application, count(*) AS total, {rate("decision <> 'ALLOW'")} AS intervention_rate, {rate("decision IN ('HUMAN_REVIEW', 'BLOCK')")} AS oversight_rate,
    {r4('avg(overall_risk)')} AS mean_risk, count(*) FILTER (WHERE overall_risk >= {C.ELEVATED_RISK}) AS elevated, {r4('sum(estimated_cost)', 2)} AS total_cost FROM decisions WHERE application = 'decision_support' GROUP BY 1""")


def _report_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key figures written as JSON and read again."""
    path, report = f"{shared_dir(spark)}/kpis-{uuid.uuid4().hex}", M.kpis(decided(spark, sf_dir))
    M.to_json(report, path)
    return spark.read.schema(report.schema).json(path)


add("s09_report_as_json", _report_as_json)

# --- summaries ------------------------------------------------------------------------------------------------------

_HARD = "list_contains(string_split(coalesce(deep_trigger_reasons, ''), ','), 'DETERMINISTIC_HARD_BOUNDARY')"
on_decisions("a15_verification_summary", SU.verification, f"""SELECT fast, deep, fast_rate, deep_rate, mean_fast_ms, mean_deep_ms, bypassed, {r4('coalesce(bypassed / nullif(deep, 0), 0)')} AS bypassed_of_deep,
    CASE WHEN bypassed > 0 THEN {r4('bypassed * round(f, 6)', 3)} END AS saved_ms FROM (SELECT {many(FAST)} AS fast, {many(DEEP)} AS deep, {rate(FAST)} AS fast_rate, {rate(DEEP)} AS deep_rate, {r4(f'avg(latency_ms) FILTER ({FAST})')} AS mean_fast_ms,
    {r4(f'avg(latency_ms) FILTER ({DEEP})')} AS mean_deep_ms, {many(f'{DEEP} AND {_HARD}')} AS bypassed, avg(latency_ms) FILTER ({DEEP} AND NOT {_HARD} AND latency_ms > 0) AS f FROM decisions)""")
on_decisions("a16_sessions", SU.sessions, f"""SELECT count(*) AS sessions, {many('turns >= 2')} AS multi_turn, {many('turns >= 2 AND events > 0')} AS hit_floor, CAST(sum(events) AS BIGINT) AS critical_events, {r4(f"{many('turns >= 2 AND events > 0')} / nullif({many('turns >= 2')}, 0)")} AS hit_rate
    FROM (SELECT session_id, count(*) AS turns, count(*) FILTER (decision = 'BLOCK' OR list_contains(string_split(reason_codes, ','), 'CRITICAL_PII')) AS events FROM decisions GROUP BY 1)""")
on_decisions("a24_picks", SU.picks, f"""SELECT arg_min(application, (-risk, application)) AS highest_risk, arg_min(application, (-volume, application)) AS highest_volume, arg_min(application, (oversight, application)) AS lowest_intervention
    FROM (SELECT application, {r4('avg(overall_risk)')} AS risk, count(*) AS volume, {rate("decision IN ('HUMAN_REVIEW', 'BLOCK')")} AS oversight FROM decisions GROUP BY 1)""")
_DIMS = ("performance", "responsibility", "cost", "overall")
on_decisions("a27_posture_summary", SU.posture, f"""SELECT m.*, CASE WHEN greatest(performance_average, responsibility_average, cost_average) > 0 THEN CASE WHEN performance_average >= responsibility_average AND performance_average >= cost_average THEN 'performance'
    WHEN responsibility_average >= cost_average THEN 'responsibility' ELSE 'cost' END END AS dominant_dimension, (SELECT direction FROM halves WHERE metric = 'average_risk') AS risk_trend
    FROM (SELECT {', '.join(f"{r4(f'avg({n}_risk)', 6)} AS {n}_average, {many(f'{n}_risk >= {C.ELEVATED_RISK}')} AS {n}_high" for n in _DIMS)} FROM decisions) m""", f"halves AS ({SQL['g01_half_trend']})")
add("a26_escalated_sessions", lambda s, d: SU.escalated(X.batch(_tiers(s, d))))
on_patterns("a23_reviewer_summary", lambda s, d: SU.reviewers(_reviewed(s, d)[3]), f"""SELECT kind, name, count(*) AS n, {r4('count(*) / (SELECT count(*) FROM reviews)')} AS share FROM (
    SELECT 'override' AS kind, 'any' AS name FROM reviews WHERE action = 'REJECT_DECISION' OR chosen <> original UNION ALL SELECT 'reviewer_decision', chosen FROM reviews WHERE chosen IS NOT NULL
    UNION ALL SELECT 'transition', original || ' -> ' || chosen FROM reviews WHERE chosen <> original) GROUP BY ALL""",
    "reviews AS MATERIALIZED (SELECT action, d.decision AS original, CASE WHEN action <> 'REJECT_DECISION' THEN reviewer_decision END AS chosen FROM actions LEFT JOIN decisions d USING (interaction_id))")
_TREND6 = {"average_risk": "overall_risk", "average_confidence": "decision_confidence", "human_oversight_rate": "(decision IN ('HUMAN_REVIEW', 'BLOCK'))::INT", "deep_rate": f"({DEEP})::INT",
           "incident_rate": "(interaction_id IN (SELECT interaction_id FROM incidents))::INT", "reviewer_override_rate": "(interaction_id IN (SELECT interaction_id FROM overridden))::INT"}
_SIX = f"""overridden AS (SELECT interaction_id FROM acted WHERE reviewer IS NOT NULL), ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY timestamp, interaction_id) - 1 AS i, count(*) OVER () AS n FROM decisions),
    six AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, i, n, {e} AS v FROM ordered" for m, e in _TREND6.items())})"""
on_patterns("g01_governance_trends", lambda s, d: SU.trends(_reviewed(s, d)[0], _reviewed(s, d)[3]), f"""SELECT metric, baseline, current, delta, CASE WHEN abs(delta) <= 0.05 THEN 'STABLE' WHEN delta > 0 THEN 'INCREASING' ELSE 'DECREASING' END AS direction,
    CASE WHEN abs(delta) >= 0.15 AND least(a, b) >= 15 THEN 'POTENTIAL_DRIFT' WHEN abs(delta) >= 0.1 THEN 'SIGNAL' ELSE 'TREND' END AS label, CASE WHEN abs(delta) >= 0.15 AND least(a, b) >= 15 THEN 'HIGH'
    WHEN abs(delta) >= 0.1 AND (delta > 0) <> (metric = 'average_confidence') THEN 'MEDIUM' WHEN abs(delta) > 0.05 THEN 'LOW' ELSE 'INFO' END AS severity
    FROM (SELECT metric, {r4('avg(v) FILTER (i < n // 2)')} AS baseline, {r4('avg(v) FILTER (i >= n // 2)')} AS current, {r4('avg(v) FILTER (i >= n // 2) - avg(v) FILTER (i < n // 2)')} AS delta, count(*) FILTER (i < n // 2) AS a, count(*) FILTER (i >= n // 2) AS b FROM six GROUP BY 1)""",
    _SIX)
on_patterns("i19_drift_report", lambda s, d: SU.drift_report(_reviewed(s, d)[0], _reviewed(s, d)[3]), f"""SELECT 'global' AS scope, metric, baseline, recent, delta, CASE WHEN abs(delta) <= 0.05 THEN 'STABLE' WHEN delta > 0 THEN 'INCREASING' ELSE 'DECREASING' END AS direction,
    CASE WHEN abs(delta) <= 0.05 THEN 'STABLE' WHEN abs(delta) >= 0.15 AND least(a, b) >= 15 THEN 'POTENTIAL_DRIFT' ELSE 'TREND' END AS signal, least(a, b) >= 15 AS sufficient
    FROM (SELECT metric, {r4('avg(v) FILTER (i < n // 2)')} AS baseline, {r4('avg(v) FILTER (i >= n // 2)')} AS recent, {r4('avg(v) FILTER (i >= n // 2) - avg(v) FILTER (i < n // 2)')} AS delta, count(*) FILTER (i < n // 2) AS a, count(*) FILTER (i >= n // 2) AS b FROM six GROUP BY 1)
    UNION ALL BY NAME SELECT * FROM parts WHERE scope <> 'global'""", f"{_SIX}, parts AS ({SQL['i19_drift']})")
on_signals("g05_concentration", lambda f: SU.concentration(D.decide(f)), f"""SELECT insight, subject, n, CAST(total AS BIGINT) AS total, {r4('n / total')} AS share, {_SEV('n / total / 0.5')} AS severity FROM (SELECT *, sum(n) OVER (PARTITION BY insight) AS total, count(*) OVER (PARTITION BY insight) AS kinds FROM (
    SELECT 'RULE_DOMINANCE' AS insight, rule AS subject, count(*) AS n FROM moves WHERE b = 4 AND a < 4 GROUP BY ALL UNION ALL SELECT 'RISK_CONCENTRATION', application, count(*) FROM f WHERE overall_risk >= {C.ELEVATED_RISK} GROUP BY ALL))
    WHERE total >= 5 AND n / total > 0.5 AND (insight = 'RULE_DOMINANCE' OR kinds >= 2)""", f"""f AS MATERIALIZED ({D.decide_sql()}), moves AS ({' UNION ALL '.join(f"SELECT '{rule}' AS rule, {a or 0} AS a, {b} AS b FROM f" for rule, a, b in P.STEPS)})""")
on_patterns("w15_event_timeline", lambda s, d: SU.timeline(_reviewed(s, d)[0], G.actions(table(s, d, "orders"), table(s, d, "events").count()), _reviewed(s, d)[1]), """SELECT interaction_id, row_number() OVER (PARTITION BY interaction_id ORDER BY o, seq, detail) AS position, stage, happened_at, detail FROM (
    SELECT interaction_id, 1 AS o, 0 AS seq, 'RECEIVED' AS stage, timestamp AS happened_at, application AS detail FROM decisions UNION ALL SELECT interaction_id, 2, 0, 'VERIFIED', timestamp, verification_path FROM decisions
    UNION ALL SELECT interaction_id, 3, 0, 'DECIDED', timestamp, decision FROM decisions UNION ALL SELECT interaction_id, 4, 0, 'INCIDENT', timestamp, severity FROM incidents
    UNION ALL SELECT a.interaction_id, 5, a.action_id, 'REVIEWED', CAST(o_orderdate AS TIMESTAMP), a.action FROM actions a JOIN orders ON o_orderkey = a.action_id SEMI JOIN decisions USING (interaction_id))""")

# --- evaluation against labels that come from elsewhere ----------------------------------------------------------------


def _true(d: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the ids that ``labels`` knows, with its truth: toxic, or of low quality."""
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("interaction_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("truly_risky"))
    return d.join(truth.filter("truly_risky is not null"), "interaction_id")


def on_truth(name: str, report: Callable[[DataFrame], DataFrame], sql: str, more: str = "") -> None:
    add(name, lambda s, d: report(_true(decided(s, d), s, d)), f"WITH {D.decisions_sql()}, l AS MATERIALIZED (SELECT d.*, toxic = 1 OR quality = 0 AS truly_risky FROM decisions d JOIN labels ON doc_id = interaction_id WHERE (toxic = 1 OR quality = 0) IS NOT NULL){', ' + more if more else ''} {sql}")


_TRUE_SWEEP = _SWEEP.split("), s AS (", 1)[1]
on_truth("e01_metrics_by_labels", lambda d: E.binary(d, F.col("truly_risky"), F.col("decision") != "ALLOW", "application"), _binary_sql("l", "truly_risky", "(decision <> 'ALLOW')", "application"))
on_truth("e03_sweep_by_labels", lambda d: E.threshold_sweep(d, F.col("truly_risky"), "overall_risk"), "SELECT * FROM e", f"s AS ({_TRUE_SWEEP}")
on_truth("e04_best_by_labels", lambda d: E.best_threshold(E.threshold_sweep(d, F.col("truly_risky"), "overall_risk")), "SELECT * FROM e ORDER BY f1 DESC, threshold LIMIT 1", f"s AS ({_TRUE_SWEEP}")
on_truth("e06_quadrants_by_labels", E.quadrants, f"""SELECT CASE WHEN overall_risk >= {C.EVALUATION['risk']} THEN 'high' ELSE 'low' END AS risk, CASE WHEN decision_confidence >= {C.EVALUATION['confidence']} THEN 'high' ELSE 'low' END AS confidence,
    count(*) AS n, {many('truly_risky')} AS truly_risky FROM l GROUP BY 1, 2""")

# --- text detectors -------------------------------------------------------------------------------------------------


def _pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _hits(text: str, pattern: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, {_pattern(pattern)})), 0)"


_TOX = {f"n_{k}": " + ".join(_hits("text", R.phrase(p)) for p in ps) for k, ps in L.TOXIC.items()}
_TOX_SQL = ", ".join(f"CAST({v} AS INT) AS {k}" for k, v in _TOX.items())
_TOX_TOP = "greatest(" + ", ".join(f"CASE WHEN n_{k} > 0 THEN {w}e0 ELSE 0e0 END" for k, w in L.TOXIC_WEIGHT.items()) + ")"
_TOX_N = "(" + " + ".join(f"n_{k}" for k in L.TOXIC) + ")"


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").withColumns(R.toxicity(F.col("text")))
    risk, confidence = R.toxicity_risk({k: F.col(f"n_{k}") for k in L.TOXIC})
    return rows.select("doc_id", *(f"n_{k}" for k in L.TOXIC), risk.alias("toxicity_risk"), confidence.alias("toxicity_confidence"))


add("r07_toxicity_phrases", _toxicity, f"""SELECT doc_id, {', '.join(_TOX)}, {r4(f"CASE WHEN {_TOX_N} > 0 THEN least(1e0, {_TOX_TOP} + least(15e-2, 5e-2 * ({_TOX_N} - 1))) ELSE 0e0 END")} AS toxicity_risk,
    {r4(f"CASE WHEN {_TOX_N} > 0 THEN least(8e-1, 55e-2 + 8e-2 * {_TOX_N}) ELSE 6e-1 END")} AS toxicity_confidence FROM (SELECT doc_id, {_TOX_SQL} FROM documents)""")
_BIAS_N: dict[str, str] = {}
for _p, _k in L.BIAS:
    _n = f"CASE WHEN grouped THEN {_hits('text', '(?i)' + _p)} ELSE 0 END" if _k in L.NEED_GROUP else _hits("text", "(?i)" + _p)
    _BIAS_N[_k] = f"{_BIAS_N[_k]} + {_n}" if _k in _BIAS_N else _n
_GROUP = "(?i)\\b(?:" + "|".join(L.GROUPS) + ")\\b"


def _bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").withColumns(R.bias(F.col("text")))
    risk, confidence = R.bias_risk({k: F.col(f"b_{k}") for k in L.BIAS_WEIGHT})
    return rows.select("doc_id", *(f"b_{k}" for k in L.BIAS_WEIGHT), risk.alias("bias_risk"), confidence.alias("bias_confidence"))


_BK = "(" + " + ".join(f"b_{k}" for k in L.BIAS_WEIGHT) + ")"
_BKINDS = "(" + " + ".join(f"CASE WHEN b_{k} > 0 THEN 1 ELSE 0 END" for k in L.BIAS_WEIGHT) + ")"
_BTOP = "greatest(" + ", ".join(f"CASE WHEN b_{k} > 0 THEN {w}e0 ELSE 0e0 END" for k, w in L.BIAS_WEIGHT.items()) + ")"
add("r09_bias_signals", _bias, f"""SELECT doc_id, {', '.join(f'b_{k}' for k in L.BIAS_WEIGHT)}, {r4(f"CASE WHEN {_BK} > 0 THEN least(8e-1, {_BTOP} + 5e-2 * ({_BKINDS} - 1)) ELSE 0e0 END")} AS bias_risk,
    {r4(f"CASE WHEN {_BK} > 0 THEN least(65e-2, 45e-2 + 6e-2 * {_BK}) ELSE 55e-2 END")} AS bias_confidence
    FROM (SELECT doc_id, {', '.join(f'CAST({v} AS INT) AS b_{k}' for k, v in _BIAS_N.items())} FROM (SELECT *, coalesce(regexp_matches(text, {_pattern(_GROUP)}), false) AS grouped FROM documents))""")
add("r01_pii_findings", lambda s, d: table(s, d, "documents").select("doc_id", F.inline(R.findings(F.coalesce("text", F.lit(""))))).drop("matched"))
add("r11_responsibility", lambda s, d: R.assess(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "pii_risk", "critical_pii", "toxicity_risk", "bias_risk", "responsibility_risk", "responsibility_codes"))
add("r04_redacted_text", lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("f", R.findings(F.col("t"))).select("doc_id", F.size("f").alias("findings"), F.sha2(R.redact(F.col("t"), F.col("f")), 256).alias("redacted_sha256")))

_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '[\n\r]+'), lambda x: trim(x)), lambda x: x <> '')"
add("t01_sentences", lambda s, d: table(s, d, "documents").select("doc_id", F.size(G2.sentences(F.col("text"))).alias("sentences"), F.sha2(F.array_join(G2.sentences(F.col("text")), "\n"), 256).alias("digest")),
    f"SELECT doc_id, CAST(len({_SENT}) AS INT) AS sentences, sha256(array_to_string({_SENT}, chr(10))) AS digest FROM documents")
add("t02_claims", lambda s, d: table(s, d, "documents").select("doc_id", F.size(G2.claims(F.col("text"))).alias("claims")),
    rf"SELECT doc_id, CAST(len(list_filter({_SENT}, lambda x: len(regexp_split_to_array(x, '\s+')) >= 2)) AS INT) AS claims FROM documents")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G2.turns(table(spark, sf_dir, "conversations"))


_TURNS = """turns AS MATERIALIZED (SELECT conv_id, turn, coalesce(prompt, '') AS prompt, context, text AS response FROM (SELECT *, lag(text) OVER w AS prompt,
    array_to_string(list(text) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), chr(10)) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant')"""
add("p07_turn_pairs", lambda s, d: _turns(s, d).select("conv_id", "turn", F.length("prompt").cast("long").alias("prompt_chars"), F.length("response").cast("long").alias("response_chars")),
    f"WITH {_TURNS} SELECT conv_id, turn, length(prompt) AS prompt_chars, length(response) AS response_chars FROM turns")
_TOK = "regexp_extract_all(lower({0}), '([a-z0-9]+(?:''[a-z]+)?)', 1)"
_CONTENT = f"list_distinct(list_filter({{0}}, lambda x: NOT list_contains({_set([*L.STOPWORDS, *L.MODALS, *L.NEGATIONS])}, x) AND NOT regexp_full_match(x, '[0-9]+')))"
_NLI = f"""n AS (SELECT *, {_TOK.format('prompt')} AS p, {_TOK.format('response')} AS h FROM turns), c AS (SELECT *, {_CONTENT.format('h')} AS asked, {_CONTENT.format('p')} AS had, list_has_any(p, {_set(L.NEGATIONS)}) <> list_has_any(h, {_set(L.NEGATIONS)}) AS negation,
    list_filter(p, lambda x: regexp_full_match(x, '[0-9]{{1,3}}')) AS pn, list_filter(h, lambda x: regexp_full_match(x, '[0-9]{{1,3}}')) AS hn FROM n),
    v AS (SELECT *, CASE WHEN len(asked) = 0 THEN 0e0 ELSE len(list_intersect(had, asked)) / len(asked) END AS cover, len(pn) > 0 AND len(hn) > 0 AND NOT list_has_any(pn, hn) AS numeric FROM c)"""


def _nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("conv_id", "turn", G2.tokens(F.col("prompt")).alias("p"), G2.tokens(F.col("response")).alias("h"))
    label, confidence = G2.coverage_nli("p", "h")
    return rows.select("conv_id", "turn", label.alias("label"), confidence.alias("confidence"))


add("t07_coverage_nli", _nli, f"""WITH {_TURNS}, {_NLI} SELECT conv_id, turn, CASE WHEN len(asked) = 0 THEN 'NEUTRAL' WHEN cover >= 3e-1 AND (negation OR numeric) THEN 'CONTRADICTION' WHEN cover >= 48e-2 THEN 'ENTAILMENT' ELSE 'NEUTRAL' END AS label,
    {r4("CASE WHEN len(asked) = 0 THEN 5e-1 WHEN cover >= 3e-1 AND negation THEN least(97e-2, 72e-2 + 25e-2 * cover) WHEN cover >= 3e-1 AND numeric THEN least(95e-2, 72e-2 + 2e-1 * cover) WHEN cover >= 48e-2 THEN least(95e-2, 55e-2 + 4e-1 * cover) ELSE least(6e-1, 4e-1 + 35e-2 * cover) END")} AS confidence FROM v""")


def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("conv_id", "turn", G2.tokens(F.col("prompt")).alias("p"), G2.tokens(F.col("response")).alias("h"))
    label, confidence = G2.jaccard_nli("p", "h")
    return rows.select("conv_id", "turn", label.alias("label"), confidence.alias("confidence"))


add("t08_jaccard_nli", _jaccard)
add("t13_text_criticality", lambda s, d: table(s, d, "documents").select("doc_id", F.round(G2.text_criticality(F.coalesce("text", F.lit(""))), 4).alias("criticality")))
_KEY = ["conv_id", "turn"]
add("t18_claims_deep", lambda s, d: G2.claim_results(_turns(s, d), _KEY, "response", "context").drop("claim"))
add("t18_claims_in_order", lambda s, d: G2.claim_results_in_order(table(s, d, "conversations")).drop("claim"))
add("t18_grounding_deep", lambda s, d: G2.responses(_turns(s, d), _KEY, "response", "context"))
add("t18_grounding_shallow", lambda s, d: G2.responses(_turns(s, d), _KEY, "response", "context", G2.SHALLOW))

# --- routing --------------------------------------------------------------------------------------------------------

_ROUTE = ("signals", "outcome", *V.WEIGHTS, "complexity", "threshold", "verdict", "reason")


def _cascade(spark: SparkSession, sf_dir: str, profile: str = "default") -> DataFrame:
    return V.cascade(TX.acting(_turns(spark, sf_dir)), profile, V.is_action(F.col("action_type"), F.col("amount")))


def _cascade_sql(profile: str) -> str:
    """CTEs up to ``routed``, by hand. RE2 has no look-around: where Spark looks, these patterns take a character more."""
    at, most, blocked, markers, forced = V.PROFILES[profile]
    found = {
        "EMAIL": V.PATTERNS["EMAIL"], "PHONE": r"(^|[^0-9])(\+?[0-9][\s-]?){9,14}[0-9]([^0-9]|$)", "CREDIT_CARD": r"(^|[^0-9])([0-9][ -]?){13,16}([^0-9]|$)",
        "GOV_ID": r"\b[A-Z]{2}[0-9]{6,10}\b", "ACCOUNT_ID": V.PATTERNS["ACCOUNT_ID"],
    }
    violations = [f"CASE WHEN regexp_matches(response, '{p}') THEN 'PII_PATTERN:{n}' END" for n, p in found.items()]
    violations += [f"CASE WHEN contains(lower(response), '{k}') THEN 'BLOCKED_KEYWORD:{k}' END" for k in blocked]
    words = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"
    unit = "round(greatest(0e0, least(1e0, {0})) + 1e-9, 6)"
    score = " + ".join(f"{w}e0 * {k}" for k, w in V.WEIGHTS.items())
    return rf"""{_TURNS}, typed AS (SELECT *, {words.format('response')} AS n_words, greatest({words.format('context')}, 1) AS c_words, length(trim(context)) > 0 AS evidence,
        ['information', 'refund', 'account_update', 'account_cancellation', 'external_communication', 'recommendation'][(conv_id * 100000 + turn) % 6 + 1] <> 'information'
        OR len(list_filter(regexp_extract_all(response, '[0-9]+'), lambda x: len(x) <= 7 AND CAST(x AS BIGINT) > 0)) > 0 AS acts,
        len(regexp_extract_all(response, '(^|[^A-Za-z0-9_])([₹$€£]\s?)?[0-9][0-9,]*(\.[0-9]+)?%?')) AS numbers, regexp_extract_all(response, '[A-Za-z'']+') AS said,
        list_sort(list_filter({_set(markers)}, lambda m: contains(lower(prompt), m) OR contains(lower(response), m))) AS stakes FROM turns),
    checked AS (SELECT *, concat_ws(',', {', '.join(violations)}) AS crossed, concat_ws(',', CASE WHEN n_words > {most} THEN 'RESPONSE_TOO_LONG' END, CASE WHEN acts THEN 'SIDE_EFFECTING_ACTION' END,
        CASE WHEN regexp_matches(response, 'https?://|www\.|(^|[^A-Za-z0-9_])@[A-Za-z0-9_]{{2,}}') THEN 'CONTAINS_URL_OR_HANDLE' END, CASE WHEN regexp_matches(response, '{V.CAPITALS}') THEN 'CONTAINS_NAMED_ENTITY' END,
        CASE WHEN numbers > 0 AND NOT evidence THEN 'UNGROUNDED_NUMERIC_CLAIM' WHEN numbers > 2 THEN 'MULTIPLE_NUMERIC_CLAIMS' END,
        CASE WHEN len(stakes) > 0 THEN 'HIGH_STAKES_INTENT:' || array_to_string(stakes, '+') END) AS blocked,
        list_distinct(list_transform(said, lambda w: lower(w))) AS mine, list_distinct(list_transform(regexp_extract_all(context, '[A-Za-z'']+'), lambda w: lower(w))) AS theirs FROM typed),
    measured AS (SELECT conv_id, turn, CASE WHEN crossed <> '' THEN crossed ELSE blocked END AS signals, CASE WHEN crossed <> '' THEN 'VIOLATION' WHEN blocked <> '' THEN 'AMBIGUOUS' ELSE 'CLEARED' END AS outcome,
        {unit.format('greatest(n_words, 1) / (c_words + 8)')} AS response_length_ratio, {unit.format("len(regexp_extract_all(response, '[0-9]')) / greatest(length(response), 1) * 12")} AS digit_density,
        {unit.format(f"len(regexp_extract_all(response, '{V.CAPITALS}')) / (greatest(n_words, 1) / 20 + 1)")} AS entity_density,
        {unit.format(f"len(list_filter(said, lambda w: list_contains({_set(V.HEDGES)}, lower(w)))) / (len(said) / 15 + 1)")} AS hedge_density,
        CASE WHEN evidence THEN {unit.format("1 - CASE WHEN len(mine) > 0 AND len(theirs) > 0 THEN len(list_intersect(mine, theirs)) / len(list_distinct(list_concat(mine, theirs))) ELSE 0 END")} ELSE 1e0 END AS low_context_overlap,
        {unit.format(r"len(regexp_split_to_array(trim(response), '[.!?;]\s+|\n+')) / 8")} AS claim_count,
        CASE WHEN list_contains({_set(V.QUESTIONS)}, lower(string_split(trim(prompt), ' ')[1])) OR rtrim(prompt) LIKE '%?' THEN 1e0 ELSE 0e0 END AS question_form,
        CASE WHEN acts THEN 1e0 ELSE 0e0 END AS action_flag, CASE WHEN evidence THEN 0e0 ELSE 1e0 END AS no_evidence,
        CASE WHEN acts AND {forced} THEN 0e0 WHEN n_words > {2 * most} THEN {max(0.0, at - 0.10)}e0 ELSE {at}e0 END AS threshold FROM checked),
    scored_turns AS (SELECT *, round(1 / (1 + exp(-({V.BIAS}e0 + {score}))) + 1e-9, 6) AS complexity FROM measured),
    routed AS (SELECT *, CASE WHEN outcome <> 'CLEARED' AND (outcome = 'VIOLATION' OR complexity >= threshold) THEN 'ROUTE_TO_DEEP' ELSE 'FAST_ALLOW' END AS verdict,
        CASE outcome WHEN 'CLEARED' THEN 'DETERMINISTIC_CLEAR' WHEN 'VIOLATION' THEN 'DETERMINISTIC_HARD_BOUNDARY' ELSE 'COMPLEXITY_' || CASE WHEN complexity >= threshold THEN 'ABOVE' ELSE 'BELOW' END || '_THRESHOLD' END AS reason FROM scored_turns)"""


add("v05_cascade", lambda s, d: _cascade(s, d).select(*_KEY, *_ROUTE), f"WITH {_cascade_sql('default')} SELECT conv_id, turn, {', '.join(_ROUTE)} FROM routed")
add("v07_complexity", lambda s, d: _cascade(s, d, "customer_support").select(*_KEY, *V.WEIGHTS, "complexity"), f"WITH {_cascade_sql('customer_support')} SELECT conv_id, turn, {', '.join(V.WEIGHTS)}, complexity FROM routed")
add("v12_verdicts", lambda s, d: V.summary(_cascade(s, d, "internal_knowledge_assistant")),
    f"WITH {_cascade_sql('internal_knowledge_assistant')} SELECT verdict, reason, count(*) AS n, {many('no_evidence = 1')} AS no_evidence FROM routed GROUP BY 1, 2")
add("v09_hash_embedding", lambda s, d: _turns(s, d).select(*_KEY, F.array_join(F.transform(V.embed(F.col("response")), lambda x: F.round(x, 6).cast("string")), ",").alias("embedding")))
add("x07_incremental_routing", lambda s, d: X.incremental(_cascade(s, d)))
add("x07_routing_state", lambda s, d: X.routing_state(_cascade(s, d)))


def _router(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _cascade(spark, sf_dir).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    _, scored = V.train_router(routed, F.col("response"), F.col("complexity") >= 0.5, key="id")
    return V.evaluate_router(scored)


add("v14_trained_router", _router)


def _documents_to_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TX.acting(_turns(spark, sf_dir))
    return rows.withColumns({"document": FM.routing_document(rows), "acts": V.is_action(F.col("action_type"), F.col("amount"))})


add("v13_routing_documents", lambda s, d: _documents_to_route(s, d).select(*_KEY, F.char_length("document").cast("long").alias("chars"), F.sha2("document", 256).alias("digest")), f"""WITH {_TURNS},
    named AS (SELECT *, ['information', 'refund', 'account_update', 'account_cancellation', 'external_communication', 'recommendation'][(conv_id * 100000 + turn) % 6 + 1] AS action,
        coalesce(list_max(list_transform(list_filter(regexp_extract_all(coalesce(response, ''), '[0-9]+'), lambda x: len(x) <= 7), lambda x: CAST(x AS BIGINT))), 0) AS amount FROM turns),
    written AS (SELECT conv_id, turn, '[prompt] ' || prompt || ' [response] ' || coalesce(response, '') || ' [meta] action=' || action || ' amount=' || amount || ' tools=0 retries=0 [flags] '
        || coalesce(nullif(concat_ws(' ', CASE WHEN amount >= 50000 THEN 'high_value_action' END, CASE WHEN action <> 'information' THEN 'side_effecting_action' END), ''), 'none') AS document FROM named)
    SELECT conv_id, turn, length(document) AS chars, sha256(document) AS digest FROM written""")


def _factor_scores(spark: SparkSession, sf_dir: str, vector: Callable[[DataFrame], Column], latent: int) -> DataFrame:
    """Fit on the fixed cascade's verdicts, store the folded weights, score every turn and route by the score."""
    rows = _documents_to_route(spark, sf_dir)
    rows = staged(rows.withColumn("vector", vector(rows)), f"vectors-{latent}", sf_dir)
    labelled = V.cascade(rows, action=F.col("acts")).withColumn("label", F.when(F.col("verdict") == "ROUTE_TO_DEEP", 1).otherwise(0))
    weights, bias = FM.weights_of(FM.fit(labelled, F.col("vector"), F.col("label"), latent).table(spark))
    return FM.cascade(rows, FM.linear_score(F.col("vector"), weights, bias), action=F.col("acts")).select(*_KEY, F.col("complexity").alias("score"), "threshold", "verdict", "reason")


add("v10_factor_scores", lambda s, d: _factor_scores(s, d, lambda r: V.embed(F.col("document")), 16))
add("v11_feature_scores", lambda s, d: _factor_scores(s, d, lambda r: FM.features_vector(r, F.col("acts")), 4))
_FLIPS = "decision IN ('HUMAN_REVIEW', 'BLOCK')"
on_decisions("v17_cost_optimal_threshold", lambda d: V.cost_optimal_threshold(d, "overall_risk", F.col("decision").isin("HUMAN_REVIEW", "BLOCK")), f"""SELECT threshold, {r4('cost')} AS cost, {r4('e')} AS escalation_rate, {r4('m')} AS missed_rate, m <= 0.02 AS satisfied FROM t
    ORDER BY NOT m <= 0.02, CASE WHEN m <= 0.02 THEN cost ELSE m END, threshold LIMIT 1""", f"""g AS (SELECT round(range / 100e0, 2) AS threshold FROM range(0, 101, 2)), t AS (SELECT threshold, avg(CASE WHEN overall_risk >= threshold THEN 1e0 WHEN {_FLIPS} THEN 20e0 ELSE 0e0 END) AS cost,
    avg((overall_risk >= threshold)::INT) AS e, avg((overall_risk < threshold AND {_FLIPS})::INT) AS m FROM decisions, g GROUP BY 1)""")

# --- sessions and streams -------------------------------------------------------------------------------------------


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_tiers(D.signals(D.interactions(table(spark, sf_dir, "events"))))


add("x01_session_risk", lambda s, d: X.batch(_tiers(s, d)))
add("s06_session_states", lambda s, d: X.final_states(X.batch(_tiers(s, d))))


def _streamed(spark: SparkSession, source: DataFrame, run: Callable[[DataFrame], DataFrame], start: Callable[[DataFrame, str], None] = X.run_to_table) -> DataFrame:
    """Feed a table to a streaming job as files in the shared folder and read what it has written."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source.write.parquet(f"{place}/in")
    start(run(spark.readStream.schema(source.schema).parquet(f"{place}/in")), f"{place}/out")
    return spark.read.parquet(f"{place}/out")


add("x08_session_stream", lambda s, d: _streamed(s, _tiers(s, d), X.stream))


def _stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts as a stream appends them: windows that the watermark has passed."""
    d = decided(spark, sf_dir).select(F.col("timestamp").cast("timestamp"), "application", "decision", "interaction_id")
    out = _streamed(spark, d, X.monitor)
    return out.select(F.col("window.start").alias("start"), "application", "n", "blocked", "reviewed")


add("x10_stream_monitor", _stream_monitor)
on_decisions("x10_window_monitor", lambda d: X.monitor(d).select(F.col("window.start").alias("start"), "application", "n", "blocked", "reviewed"),
    f"SELECT date_trunc('hour', timestamp) AS start, application, count(*) AS n, {many('''decision = 'BLOCK' ''')} AS blocked, {many('''decision = 'HUMAN_REVIEW' ''')} AS reviewed FROM decisions GROUP BY ALL")

# --- sessions that end, and rows that come late ---------------------------------------------------------------------

#: Every fiftieth event resets its session; a session ends after two days without an event.
_RESET, _TIMEOUT = "interaction_id % 50 = 7", 2 * 24 * 3600


def _resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(XE.with_resets(_tiers(spark, sf_dir), _RESET), "resets", sf_dir)


def _expiring_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    XE.use_store(spark)
    return _streamed(spark, _resets(spark, sf_dir), lambda rows: XE.stream(rows, _TIMEOUT), XE.run_once)


add("x06_sessions_with_resets", lambda s, d: XE.batch(_resets(s, d), _TIMEOUT))
add("x08_expiring_stream", _expiring_stream)
_NOW = "(SELECT max(ts) FROM events)"
add("x06_active_sessions", lambda s, d: XE.active(_resets(s, d), str(table(s, d, "events").agg(F.max("ts")).first()[0]), _TIMEOUT),
    f"SELECT user_id AS session_id FROM events GROUP BY 1 HAVING NOT arg_max({_RESET.replace('interaction_id', 'event_id')}, (ts, event_id)) AND max(ts) >= {_NOW} - INTERVAL '{_TIMEOUT} seconds'")


def _late(spark: SparkSession, sf_dir: str) -> str:
    """The decisions as a stream in three slices of time, every hundredth one coming after all others; where its tables are."""
    d = decided(spark, sf_dir).select("interaction_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "application", "decision")
    low, high = d.agg(F.unix_seconds(F.min("timestamp")), F.unix_seconds(F.max("timestamp"))).first()
    part = F.when(F.col("interaction_id") % 100 == 0, 3).otherwise(F.floor(3 * (F.unix_seconds("timestamp") - low) / (high - low + 1)))
    sliced, place = d.withColumn("part", part.cast("int")), f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    for k in range(4):
        sliced.filter(F.col("part") == k).drop("part").coalesce(4).write.parquet(f"{place}/in/slice-{k}")
        stream = spark.readStream.schema(d.schema).parquet(f"{place}/in/*")
        XL.run(stream, f"{place}/out")
    return f"{place}/out"


add("x09_monitor_with_late_rows", lambda s, d: XL.complete(s, _late(s, d)).select(F.col("window.start").alias("start"), "application", "n", "blocked", "reviewed"), SQL["x10_window_monitor"])
add("x09_late_rows", lambda s, d: XL.late_rows(s, _late(s, d)).select("interaction_id", "application", "decision"), f"""WITH {D.decisions_sql()}
    SELECT interaction_id, application, decision FROM decisions WHERE interaction_id % 100 = 0
    AND date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM decisions WHERE interaction_id % 100 <> 0) - INTERVAL 10 MINUTE""")
on_decisions("x09_session_windows", XL.session_windows, """SELECT session_id, min(timestamp) AS start, max(timestamp) AS last, count(*) AS n, max(overall_risk) AS max_risk, count(*) FILTER (decision = 'BLOCK') AS blocked
    FROM (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY timestamp) AS part FROM (SELECT *, coalesce(timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp) >= INTERVAL 6 HOUR, true)::INT AS opens FROM decisions))
    GROUP BY session_id, part""")

# --- decisions from texts ------------------------------------------------------------------------------------------


def text_decided(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The decisions over a table of texts (``conversations`` or ``documents``), which several queries share."""
    made = {"conversations": TX.from_conversations, "documents": TX.from_documents, "in_context": TX.from_documents_in_context}

    def decide() -> DataFrame:
        rows = made[name](table(spark, sf_dir, "documents" if name == "in_context" else name))
        return TX.decisions(staged(TX.scored(staged(TX.detected(rows), f"signals-of-{name}", sf_dir)), f"scored-{name}", sf_dir))

    return stored(spark, decide, f"decided-{name}", sf_dir)


for _name in ("conversations", "documents"):
    add(f"d14_decisions_{_name}", lambda s, d, n=_name: text_decided(s, d, n).withColumn("pii_keys", F.array_join("pii_keys", ",")))
    add(f"x03_session_snapshots_{_name}", lambda s, d, n=_name: TX.snapshots(text_decided(s, d, n)))
add("x04_critical_turns", lambda s, d: TX.critical_turns(text_decided(s, d, "documents")))

add("d14_decisions_in_context", lambda s, d: text_decided(s, d, "in_context").withColumn("pii_keys", F.array_join("pii_keys", ",")))
add("d14_kinds_in_context", lambda s, d: text_decided(s, d, "in_context").groupBy("verification_path", "perf_status", F.col("critical_pii"), (F.col("toxicity_risk") > 0).alias("toxic"), "decision").agg(F.count(F.lit(1)).alias("n")))
_TOX_RISK = f"CASE WHEN {_TOX_N} > 0 THEN least(1e0, {_TOX_TOP} + least(15e-2, 5e-2 * ({_TOX_N} - 1))) ELSE 0e0 END"


def _severe(d: DataFrame) -> DataFrame:
    severe = F.col("triggered_rules").contains("SEVERE_TOXICITY")
    return d.select("interaction_id", "application", "action_type", "tokens_out", "toxicity_risk", severe.alias("severe"), F.when(severe, F.col("decision")).alias("decision"))


add("d05_severe_toxicity", lambda s, d: _severe(text_decided(s, d, "documents")), f"""SELECT *, CASE WHEN severe THEN 'BLOCK' END AS decision FROM (
    SELECT *, toxicity_risk >= CASE application WHEN 'internal_knowledge_assistant' THEN 0.88 ELSE 0.80 END AS severe FROM (SELECT doc_id AS interaction_id,
    ['customer_support', 'decision_support', 'internal_knowledge_assistant'][(doc_id // 10) % 3 + 1] AS application,
    ['information', 'refund', 'account_update', 'account_cancellation', 'external_communication', 'recommendation'][doc_id % 6 + 1] AS action_type,
    CAST(ceil(length(coalesce(text, '')) / 4e0) AS BIGINT) AS tokens_out, {r4(_TOX_RISK)} AS toxicity_risk FROM (SELECT doc_id, text, {_TOX_SQL} FROM documents)))""")
add("d05_toxicity_in_context", lambda s, d: TX.severe(TX.from_documents_in_context(table(s, d, "documents"))), SQL["d05_severe_toxicity"])
add("e05_toxicity_against_labels", lambda s, d: E.against_labels(_toxicity(s, d).select("doc_id", (F.col("toxicity_risk") > 0).alias("said")), table(s, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("truth")), "doc_id"),
    f"""SELECT *, {r4('tp / nullif(tp + fp, 0)')} AS precision, {r4('tp / nullif(tp + fn, 0)')} AS recall, {r4('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM (SELECT count(*) FILTER (said AND truth) AS tp,
    count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn
    FROM (SELECT toxic = 1 AS truth, {_TOX_N} > 0 AS said FROM labels JOIN (SELECT doc_id, {_TOX_SQL} FROM documents) USING (doc_id) WHERE toxic IS NOT NULL))""")


def _detectors_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity and bias against the label toxic, either of them against toxic or of low quality."""
    said = _toxicity(spark, sf_dir).select("doc_id", (F.col("toxicity_risk") > 0).alias("t")).join(_bias(spark, sf_dir).select("doc_id", (F.col("bias_risk") > 0).alias("b")), "doc_id")
    labels = table(spark, sf_dir, "labels")
    toxic, risky = F.col("toxic") == 1, (F.col("toxic") == 1) | (F.col("quality") == 0)
    kinds = {"toxicity": (F.col("t"), toxic), "bias": (F.col("b"), toxic), "either": (F.col("t") | F.col("b"), risky)}
    rows = [E.against_labels(said.select("doc_id", c.alias("said")), labels.select("doc_id", truth.alias("truth")), "doc_id").withColumn("detector", F.lit(name)) for name, (c, truth) in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_BIAS_COUNTS = ", ".join(f"CAST({v} AS INT) AS b_{k}" for k, v in _BIAS_N.items())
_BOTH_SAID = f"SELECT doc_id, {_TOX_N} > 0 AS t, {_BK} > 0 AS b FROM (SELECT doc_id, {_TOX_SQL}, {_BIAS_COUNTS} FROM (SELECT *, coalesce(regexp_matches(text, {_pattern(_GROUP)}), false) AS grouped FROM documents))"
add("e05_detectors_by_labels", _detectors_by_labels, f"""WITH said AS ({_BOTH_SAID}), r AS (SELECT 'toxicity' AS detector, t AS said, toxic = 1 AS truth FROM labels JOIN said USING (doc_id) UNION ALL SELECT 'bias', b, toxic = 1 FROM labels JOIN said USING (doc_id)
    UNION ALL SELECT 'either', t OR b, toxic = 1 OR quality = 0 FROM labels JOIN said USING (doc_id)),
    n AS (SELECT detector, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM r WHERE truth IS NOT NULL GROUP BY 1)
    SELECT *, {r4('tp / nullif(tp + fp, 0)')} AS precision, {r4('tp / nullif(tp + fn, 0)')} AS recall, {r4('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM n""")
_FACTOR_SQL = " UNION ALL ".join(f"SELECT interaction_id, {i} AS i, '{f}' AS factor, {f} * {w}e0 AS part FROM scored" for i, (f, w) in enumerate(C.CONSEQUENCE.items()))
add("f02_top_contributors", lambda s, d: D.top_contributors(D.signals(D.interactions(table(s, d, "events")))), f"""WITH {D.signals_sql()}, parts AS ({_FACTOR_SQL}),
    best AS (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY round(part + 1e-9, 6) DESC, i) AS r FROM parts)
    SELECT interaction_id, coalesce(string_agg(factor, ',' ORDER BY r) FILTER (r <= 2 AND part > 0), '') AS top_contributors FROM best GROUP BY 1""")

# --- replay and storage ---------------------------------------------------------------------------------------------

_ARRAY = "[" + ", ".join(f"'{t}'" for t in C.TIERS) + "]"
_STEPS = "steps AS (" + " UNION ALL ".join(f"SELECT interaction_id, CAST({i} AS INT) AS step, '{n}' AS rule, {_ARRAY}[{a or 0} + 1] AS from_tier, {_ARRAY}[{b} + 1] AS to_tier FROM f WHERE {'true' if not a else f'{a} <> {b}'}" for i, (n, a, b) in enumerate(P.STEPS)) + ")"
on_signals("l02_decision_steps", lambda s: P.steps(D.decide(s)), "SELECT * FROM steps", f"f AS ({D.decide_sql()}), {_STEPS}")
on_signals("l05_oversight_rules", lambda s: P.oversight_rules(P.steps(D.decide(s))), "SELECT rule, to_tier, count(*) AS n FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY step DESC) = 1) WHERE to_tier IN ('HUMAN_REVIEW', 'BLOCK') GROUP BY ALL", f"f AS ({D.decide_sql()}), {_STEPS}")
on_decisions("l04_risk_dimensions", P.dimensions, " UNION ALL ".join(f"SELECT interaction_id, '{n}' AS dimension, {r4(n + '_risk')} AS risk, {w}e0 AS weight, {r4(f'{n}_risk * {w}e0')} AS contribution, dominant_dimension = '{n}' AS dominant FROM decisions" for n, w in C.FUSION.items()))
on_decisions("s08_audit_lines", P.audit, f"""SELECT interaction_id, application, decision, {r4('overall_risk')} AS risk, CASE WHEN decision_confidence >= 0.65 THEN 'high' WHEN decision_confidence < 0.45 THEN 'low' ELSE 'medium' END AS confidence_band,
    concat_ws(' > ', base_tier, decision) AS path, CAST(len(list_filter(string_split(triggered_rules, ','), lambda x: x <> '')) AS INT) AS rules, reason_codes FROM decisions""")
on_reviews("l07_investigation", lambda d, a, f: P.investigation(I.incidents(d), a.groupBy("interaction_id").agg(F.max_by(G.status_of(F.col("action")), "action_id").alias("status")), G.effective(d, a)),
    """SELECT i.interaction_id, i.incident_id, i.severity, coalesce(s.status, 'OPEN') AS status, coalesce(x.m, i.decision) AS effective, coalesce(x.m <> i.decision, false) AS overridden FROM incidents i LEFT JOIN s USING (interaction_id) LEFT JOIN x USING (interaction_id)""",
    f"""{_INCIDENTS}, s AS (SELECT interaction_id, arg_max({_STATUS}, action_id) AS status FROM actions GROUP BY 1),
    x AS (SELECT interaction_id, arg_max(reviewer_decision, action_id) AS m FROM actions WHERE action = 'MODIFY_DECISION' AND reviewer_decision IS NOT NULL GROUP BY 1)""")  # fmt: skip
add("k11_counterfactual_amount", lambda s, d: E.counterfactual(D.interactions(table(s, d, "events")), {"amount": "amount / 100", "retry_count": "0"}))
on_decisions("s04_first_write_wins", lambda d: W.first_write_wins(d.filter("interaction_id % 3 = 0").select("interaction_id"), d.select("interaction_id", "decision", F.col("timestamp").alias("ingest_seq"))).select("interaction_id", "decision"),
    "SELECT interaction_id, decision FROM decisions WHERE interaction_id % 3 <> 0")
add("p02_data_quality", lambda s, d: W.data_quality(D.interactions(table(s, d, "events")), ["props", "value"]).select("seen", "n_valid", "skipped", "null_props", "null_value"), """SELECT count(*) AS seen, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE NOT ok) AS skipped,
    count(*) FILTER (WHERE props IS NULL) AS null_props, count(*) FILTER (WHERE value IS NULL) AS null_value FROM (SELECT *, coalesce(value >= 0 AND props IS NOT NULL AND user_id IS NOT NULL, false) AS ok FROM events)""")

# --- views and calibration grids ------------------------------------------------------------------------------------

on_decisions("a20_overview", Y.overview, f"""SELECT count(*) AS total, count(DISTINCT application) AS applications, count(DISTINCT model) AS models, count(DISTINCT session_id) AS sessions, {r4('avg(overall_risk)')} AS mean_risk, max(overall_risk) AS max_risk,
    {r4('avg(decision_confidence)')} AS mean_confidence, {rate("decision <> 'ALLOW'")} AS intervention_rate, {rate(f'overall_risk >= {C.ELEVATED_RISK}')} AS high_risk_share FROM decisions""")
on_incidents("a21_detector_contribution", Y.detector_contribution, " UNION ALL ".join(
    f"SELECT '{n}' AS detector, {many(f'{n}_risk >= 0.5')} AS high, {many(f'''dominant_dimension = '{n}' ''')} AS dominant, {r4(f'avg({n}_risk)')} AS mean_risk FROM incidents" for n in C.FUSION))
on_decisions("w09_recent_decisions", Y.recent, "SELECT interaction_id, application, decision, overall_risk FROM decisions ORDER BY timestamp DESC, interaction_id DESC LIMIT 25")
on_decisions("w13_focus", Y.focus, "SELECT interaction_id, application, decision, overall_risk FROM decisions ORDER BY overall_risk DESC, timestamp, interaction_id LIMIT 1")
on_incidents("w08_incident_order", Y.incident_order, "SELECT incident_id, severity, overall_risk FROM incidents ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, overall_risk DESC, timestamp, interaction_id LIMIT 50")
on_reviews("w15_timeline", Y.timeline, """SELECT '1 decided' AS stage, count(*) AS n FROM decisions UNION ALL SELECT '2 intervened', count(*) FROM decisions WHERE decision <> 'ALLOW' UNION ALL SELECT '3 incident', count(*) FROM incidents
    UNION ALL SELECT '4 reviewed', count(*) FROM actions WHERE interaction_id IN (SELECT interaction_id FROM decisions) UNION ALL SELECT '5 feedback', count(*) FROM feedback WHERE interaction_id IN (SELECT interaction_id FROM decisions)""", _INCIDENTS)
on_decisions("i15_incident_surge", Y.surge, """SELECT round(b + 1e-9, 4) AS baseline, round(r + 1e-9, 4) AS recent, r - b > 0.05 AND b > 0 AND r >= 1.5 * b AS surge FROM (
    SELECT avg(hit) FILTER (WHERE first) AS b, avg(hit) FILTER (WHERE NOT first) AS r FROM (SELECT (i.interaction_id IS NOT NULL)::INT AS hit, row_number() OVER (ORDER BY d.timestamp, d.interaction_id) - 1 < count(*) OVER () // 2 AS first
    FROM decisions d LEFT JOIN incidents i USING (interaction_id)))""", _INCIDENTS)
on_decisions("a26_risk_categories", Y.categories, f"""SELECT category, n, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, category) AS INT) AS rank FROM (SELECT category, count(*) AS n FROM (
    SELECT unnest(list_distinct(list_filter(string_split(reason_codes, ','), lambda x: x <> '') || ['DOMINANT_' || upper(dominant_dimension)])) AS category FROM decisions WHERE decision <> 'ALLOW') GROUP BY 1)) WHERE rank <= 10""")
_GATES = {"risk": "overall_risk >= {t}", "confidence": f"(confidence < {{t}} AND overall_risk >= {C.DEEP['floor']})", "consequence": f"(consequence_score >= {{t}} OR greatest(financial_impact, reversibility) >= {C.DEEP['extreme']})",
          "criticality": "action_criticality >= {t}", "disagreement": "disagreement >= {t}"}


def _axis_sql(axis: str) -> str:
    low, high = Y.AXES[axis]
    values = ", ".join(f"({round(low + Y.STEP * i, 2)}e0)" for i in range(round((high - low) / Y.STEP) + 1))
    deep = " OR ".join(g.format(t="gate" if n == axis else C.DEEP[n]) for n, g in _GATES.items())
    return f"""l AS ({_LABELLED_SIGNALS}), g AS (SELECT l.*, v.gate, {deep} OR perf_status = 'UNVERIFIED' AS deep FROM l, (VALUES {values}) v(gate)),
        sw AS (SELECT gate, {rate('deep')} AS deep_rate, {r4(f"coalesce({many('deep AND truly_risky')} / nullif({many('truly_risky')}, 0), 0)")} AS recall FROM g GROUP BY 1)"""


for _axis in Y.AXES:
    on_signals(f"k04_sweep_{_axis}", lambda s, a=_axis: Y.axis_sweep(s, a), "SELECT * FROM sw", _axis_sql(_axis))
on_signals("k07_recommended_threshold", lambda s: Y.recommend(Y.axis_sweep(s, "risk")), "SELECT *, recall >= 0.9 AS safe FROM sw ORDER BY NOT recall >= 0.9, CASE WHEN recall >= 0.9 THEN deep_rate ELSE -recall END, gate DESC LIMIT 1", _axis_sql("risk"))
on_signals("k09_safe_cells", lambda s: Y.safe_cells(E.sweep(s)), "SELECT * FROM kv WHERE violations = '' ORDER BY deep_rate, recall DESC, candidate LIMIT 3", _K3)
_WHATIF = ("deep_rate", "recall", "precision", "fpr", "review_rate")
on_signals("k12_whatif", lambda s: Y.whatif(E.sweep(s)), "SELECT *, CASE WHEN selected > current THEN 'up' WHEN selected < current THEN 'down' ELSE 'same' END AS direction FROM wi",
    _K3 + ", best AS (SELECT * FROM kv ORDER BY violations <> '', CASE WHEN violations <> '' THEN -recall END, deep_rate, recall DESC, precision DESC, candidate LIMIT 1), wi AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, k.{m} AS current, best.{m} AS selected FROM k, best WHERE k.candidate = 0" for m in _WHATIF) + ")")

# --- further reports ------------------------------------------------------------------------------------------------

on_decisions("a15_verification_cost", M.verification_cost, f"""SELECT upper(coalesce(verification_path, 'DEEP')) AS path, count(*) AS n, {r4('avg(latency_ms)')} AS mean_latency,
    count(*) FILTER (WHERE deep_trigger_reasons LIKE '%DETERMINISTIC_HARD_BOUNDARY%') AS bypassed FROM decisions GROUP BY 1""")
on_decisions("a30_kpis", M.kpis, f"""SELECT coalesce(application, 'all') AS application, count(*) AS total, {rate("decision <> 'ALLOW'")} AS intervention_rate, {rate("decision IN ('HUMAN_REVIEW', 'BLOCK')")} AS oversight_rate,
    {r4('avg(overall_risk)')} AS mean_risk, count(*) FILTER (WHERE overall_risk >= {C.ELEVATED_RISK}) AS elevated, {r4('sum(estimated_cost)', 2)} AS total_cost FROM decisions GROUP BY ROLLUP (application)""")
on_reviews("w16_overridden_by_half", lambda d, a, f: G.overridden_by_half(d, a), """SELECT h.half, count(DISTINCT o.interaction_id) AS overridden FROM (VALUES ('first'), ('second')) h(half)
    LEFT JOIN (SELECT interaction_id, half FROM ranked SEMI JOIN x USING (interaction_id)) o ON h.half = o.half GROUP BY 1""", """x AS (SELECT DISTINCT interaction_id FROM actions WHERE action = 'MODIFY_DECISION' AND reviewer_decision IS NOT NULL),
    ranked AS (SELECT interaction_id, CASE WHEN row_number() OVER (ORDER BY timestamp, interaction_id) - 1 < (SELECT count(*) FROM decisions) // 2 THEN 'first' ELSE 'second' END AS half FROM decisions)""")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers, each with the next document of its source as context: texts with personal data, findings and evidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("response"))
    other = F.lead("response").over(Window.partitionBy("source", F.floor(F.col("doc_id") / 100)).orderBy("doc_id", "response"))
    rows = docs.withColumn("context", F.coalesce(other, F.lit(""))).withColumn("found", R.findings(F.col("response")))
    return staged(rows.withColumn("prompt", F.lit("")), "answers", sf_dir)


def _claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and their best evidence, redacted by all that the scan of the whole response found."""
    rows = _turns(spark, sf_dir).withColumn("found", R.findings(F.coalesce("response", F.lit(""))))
    return G2.evidence_table(rows, _KEY, "response", "context", "found", lambda text, found: TR.redact(text, TR.redactions(found, "matched", "redacted")))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested records of documents: decisions of the events of their ids, findings, and claims with evidence."""
    answers = _answers(spark, sf_dir).withColumn("interaction_id", F.col("doc_id"))
    worst = F.transform("found", lambda f: F.array_position(F.array(*map(F.lit, TR.SEVERITIES)), R.severity(f["subtype"], F.lit("recommendation"))).cast("int"))
    texts = answers.select("interaction_id", "prompt", "response", TR.finding_structs(F.col("found"), worst).alias("findings"))
    claims = G2.evidence_table(answers, ["interaction_id"], "response", "context", "found", lambda text, found: text)
    ids = answers.select("interaction_id")
    return staged(TR.traces(D.decide(D.signals(D.interactions(table(spark, sf_dir, "events")))).join(ids, "interaction_id", "left_semi"), texts, claims), "traces", sf_dir)


def _inlined(decided: DataFrame) -> DataFrame:
    return decided.select("interaction_id", F.inline(TR.rule_trace(decided)))


add("l03_claim_evidence", _claim_evidence)
add("s07_stored_traces", lambda s, d: TR.stored(_traces(s, d)))
add("l01_leaks", lambda s, d: TR.leaks(TR.stored(_traces(s, d)), _traces(s, d)).groupBy(F.lit("leaks").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(
    s.createDataFrame([("records", 0)], "what string, n long").join(TR.stored(_traces(s, d)).agg(F.count(F.lit(1)).alias("m")), F.lit(True)).select("what", F.col("m").alias("n"))))
SQL["l01_leaks"] = "SELECT 'records' AS what, count(*) AS n FROM documents JOIN events ON event_id = doc_id"
on_signals("d08_rule_trace", lambda f: _inlined(D.decide(f)), "SELECT interaction_id, step, rule, fired, from_tier, tier_after FROM rt", f"""f AS ({D.decide_sql()}),
    tn AS (SELECT ['ALLOW', 'ANNOTATE', 'VERIFY', 'HUMAN_REVIEW', 'BLOCK'] AS names), rt AS ({' UNION ALL '.join(f"SELECT interaction_id, {i} AS step, '{rule}' AS rule, {a or 0} <> {b} AS fired, names[{a or 0} + 1] AS from_tier, names[{b} + 1] AS tier_after FROM f, tn" for i, (rule, a, b) in enumerate(P.STEPS))})""")
for _name in ("conversations", "documents"):
    add(f"l06_session_memory_{_name}", lambda s, d, n=_name: MEM.before_each_turn(text_decided(s, d, n)).withColumn("pii_entity_keys", F.array_join("pii_entity_keys", ",")).withColumn("tier_changing_rules", F.array_join("tier_changing_rules", ",")))
add("a15_verification_cost_documents", lambda s, d: M.verification_cost(text_decided(s, d, "documents")))
SQL["s09_report_as_json"] = SQL["a30_kpis"]
