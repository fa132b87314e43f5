"""Calibration of the routing thresholds: what every combination of thresholds would route, decide, catch and miss.

Under a candidate a row is checked deeply if a gate holds, and then has the tier of the deep check, else that of the
shallow one; both tiers are worked out once. For each threshold a row matters only by how many of the tried values it
reaches, so rows are counted by these positions first. From there on nothing depends on the number of rows: one axis
after the other, positions become the values at which the gate stays shut, summed as they go.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.columns import r4
from vigil.plans import decide as D

#: Axes with the column that each compares and today's value. A gate opens at values of at least the threshold; the
#: confidence gate opens below its threshold, and only for risks of at least the floor.
AXES = {
    "risk": ("gate_risk", C.DEEP["risk"]),
    "disagreement": ("gate_disagreement", C.DEEP["disagreement"]),
    "consequence": ("consequence_score", C.DEEP["consequence"]),
    "criticality": ("action_criticality", C.DEEP["criticality"]),
    "extreme": ("extreme_factor", C.DEEP["extreme"]),
    "confidence": ("gate_confidence", C.DEEP["confidence"]),
    "floor": ("gate_risk", C.DEEP["floor"]),
}
SINGLE = ("risk", "disagreement", "consequence", "criticality", "extreme")
#: Candidates that ``sweep`` takes at most.
MOST = 100_000
#: Limits on a candidate: measure, direction, value.
LIMITS = (("recall", ">=", 0.90), ("precision", ">=", 0.25), ("false_positive_rate", "<=", 0.94), ("missed_risk_rate", "<=", 0.10), ("human_review_rate", "<=", 0.40))
OBJECTIVES = {"MIN_HUMAN_REVIEW": "human_review_rate", "MAX_FAST_PATH": "fast_path_rate", "MIN_LATENCY": "average_latency_ms"}
_TIER = [f"{d}_{t}" for d in ("fast", "deep") for t in range(len(C.TIERS))]
MEASURES = ("n", "risky", *_TIER, "fast_caught", "deep_caught", "extra_ms")


def both_depths(base: DataFrame, deeper: Callable[[DataFrame], DataFrame], keep: Sequence[str] = ("interaction_id",)) -> DataFrame:
    """The inputs of the routing gates, and the tier after a shallow and after a deep check.

    ``base`` has cost, stakes and the shallow check; ``deeper`` puts the deep check's columns in place of the shallow ones.
    """
    extreme = F.greatest("financial_impact", "reversibility").alias("extreme_factor")
    gates = [F.col(a).alias(f"gate_{b}") for a, b in (("overall_risk", "risk"), ("confidence", "confidence"), ("disagreement", "disagreement"))]
    gates.append((~F.col("evidence_available")).alias("gate_missing"))
    first = D.decide(D.add(base, D.FUSE)).select(*base.columns, *gates, F.col("t10").cast("int").alias("fast_tier"))
    second = D.decide(D.add(deeper(first), D.FUSE))
    own = ("gate_risk", "gate_confidence", "gate_disagreement", "gate_missing", "consequence_score", "action_criticality")
    return second.select(*keep, *own, extreme, "fast_tier", F.col("t10").cast("int").alias("deep_tier"))


def grid(axes: Mapping[str, Sequence[float]]) -> list[tuple]:
    """(candidate, a value for each axis) of the Cartesian product; axes without values keep today's. Candidate 0 is today."""
    if unknown := set(axes) - set(AXES):
        raise ValueError(f"unknown axes: {sorted(unknown)}")
    values = [sorted(set(axes.get(a, ()))) or [today] for a, (_, today) in AXES.items()]
    if any(not 0 <= v <= 1 for vs in values for v in vs):
        raise ValueError("thresholds lie between 0 and 1")
    product = list(itertools.product(*values))
    if len(product) > MOST:
        raise ValueError(f"{len(product)} candidates; at most {MOST}")
    return [(0, *(today for _, today in AXES.values())), *((i + 1, *p) for i, p in enumerate(product))]


def _cells(rows: DataFrame, values: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows counted by the number of values they reach on each axis. ``rows`` has risky and extra_ms besides the gates."""
    reached = lambda x, vs: F.size(F.filter(F.array(*map(F.lit, vs)), lambda v: v <= x))
    at = {a: reached(F.col(column), values[a]) for a, (column, _) in AXES.items()}
    place = rows.select(*(c.alias(a) for a, c in at.items()), "gate_missing", "fast_tier", "deep_tier", "risky", "extra_ms")
    one = lambda c: F.count_if(c)
    tiers = [one(F.col(f"{d}_tier") == t).alias(f"{d}_{t}") for d in ("fast", "deep") for t in range(len(C.TIERS))]
    caught = [one(F.col("risky") & (F.col(f"{d}_tier") > 0)).alias(f"{d}_caught") for d in ("fast", "deep")]
    return place.groupBy(*AXES, "gate_missing").agg(F.count(F.lit(1)).alias("n"), one(F.col("risky")).alias("risky"), *tiers, *caught, F.sum("extra_ms").alias("extra_ms"))


def _shut(cells: DataFrame, values: Mapping[str, Sequence[float]]) -> DataFrame:
    """Sums over the rows that stay on the fast path, for each combination of positions in ``values``."""
    sums = [F.sum(m).alias(m) for m in MEASURES]
    left = cells.filter("not gate_missing")
    for axis in SINGLE:  # shut from the first value that is beyond the row's
        left = left.filter(F.col(axis) < len(values[axis])).withColumn(axis, F.explode(F.sequence(F.col(axis), F.lit(len(values[axis]) - 1)))).groupBy(*AXES).agg(*sums)
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c in range(len(values["confidence"])) for f in range(len(values["floor"]))))
    stays = F.filter(pairs, lambda p: (p["c"] < F.col("confidence")) | (p["f"] >= F.col("floor")))
    left = left.withColumn("p", F.explode(stays)).withColumns({"confidence": F.col("p.c"), "floor": F.col("p.f")})
    return left.groupBy(*AXES).agg(*sums)


def sweep(rows: DataFrame, axes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Safety and efficiency of every candidate of ``grid(axes)``.

    ``rows`` (see ``both_depths``) has also ``risky``, the truth, and ``fast_ms`` and ``extra_ms``, what the shallow
    check takes and what the deep one adds. Rows without truth take no part. A row is flagged if its tier is not ALLOW.
    """
    rows = rows.filter("risky is not null")
    candidates = grid(axes)
    values = {a: sorted({c[k + 1] for c in candidates}) for k, a in enumerate(AXES)}
    total = rows.agg(
        F.count(F.lit(1)).alias("all_n"), F.count_if("risky").alias("all_risky"), F.count_if(F.col("risky") & (F.col("deep_tier") > 0)).alias("all_caught"),
        F.sum(F.col("fast_ms") + F.col("extra_ms")).alias("all_ms"), *(F.count_if(F.col("deep_tier") == t).alias(f"all_{t}") for t in range(len(C.TIERS))),
    )
    shut = _shut(_cells(rows, values), values)
    named = [(i, *v, *(values[a].index(x) for a, x in zip(AXES, v, strict=True))) for i, *v in candidates]
    schema = "candidate int, " + ", ".join(f"at_{a} double" for a in AXES) + ", " + ", ".join(f"{a} int" for a in AXES)
    table = F.broadcast(rows.sparkSession.createDataFrame(named, schema))  # at most MOST rows
    out = table.join(shut, list(AXES), "left").na.fill(0, list(MEASURES)).join(F.broadcast(total), F.lit(True))  # one row
    c = F.col
    n = {t: c(f"all_{t}") - c(f"deep_{t}") + c(f"fast_{t}") for t in range(len(C.TIERS))}
    tp = c("all_caught") - c("deep_caught") + c("fast_caught")
    flagged = c("all_n") - n[0]
    safe = lambda a, b: r4(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    clean = c("all_n") - c("all_risky")
    return out.select(
        "candidate", *(f"at_{a}" for a in AXES), c("all_n").alias("evaluation_count"), c("all_risky").alias("risky_count"),
        *(n[t].alias(name.lower()) for t, name in enumerate(C.TIERS)),
        safe(tp + clean - (flagged - tp), c("all_n")).alias("accuracy"), safe(tp, flagged).alias("precision"), safe(tp, c("all_risky")).alias("recall"), safe(2 * tp, flagged + c("all_risky")).alias("f1"),
        safe(flagged - tp, clean).alias("false_positive_rate"), safe(c("all_risky") - tp, c("all_risky")).alias("missed_risk_rate"),
        safe(n[3], c("all_n")).alias("human_review_rate"), safe(c("n"), c("all_n")).alias("fast_path_rate"), safe(c("all_n") - c("n"), c("all_n")).alias("deep_path_rate"),
        safe(c("all_ms") - c("extra_ms"), c("all_n")).alias("average_latency_ms"),
    )


def violations(candidates: DataFrame, limits: Sequence[tuple[str, str, float]] = LIMITS) -> DataFrame:
    """Add ``violations``: the limits that a candidate breaks, comma-joined."""
    broken = [F.when((F.col(m) < v) if op == ">=" else (F.col(m) > v), m) for m, op, v in limits]
    return candidates.withColumn("violations", F.concat_ws(",", *broken))


def select(candidates: DataFrame, objective: str = "MAX_FAST_PATH", limits: Sequence[tuple[str, str, float]] = LIMITS, most: int = 1) -> DataFrame:
    """The best candidates that break no limit (none, if all do): by the objective, then recall, precision, review, latency, order."""
    first = F.col(OBJECTIVES[objective])
    ordered = violations(candidates, limits).filter("candidate > 0 and violations = ''").orderBy(
        -first if objective == "MAX_FAST_PATH" else first, F.desc("recall"), F.desc("precision"), "human_review_rate", "average_latency_ms", "candidate"
    )
    return ordered.limit(most)


def comparison(candidates: DataFrame, measures: Sequence[str] = ("recall", "precision", "missed_risk_rate", "human_review_rate", "fast_path_rate", "average_latency_ms")) -> DataFrame:
    """Every candidate's differences from today's thresholds."""
    today = candidates.filter("candidate = 0").select(*(F.col(m).alias(f"t_{m}") for m in measures))
    return candidates.filter("candidate > 0").join(F.broadcast(today), F.lit(True)).select("candidate", *(r4(F.col(m) - F.col(f"t_{m}")).alias(f"delta_{m}") for m in measures))
