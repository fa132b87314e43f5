"""Routing of responses to fast or deep verification: fixed boundaries, complexity, thresholds, a trained router."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.columns import many, r4, rate

# fixed values: cascade profiles, patterns, word lists and weights
MARKERS = ("refund", "cancel", "close account", "delete", "terminate", "transfer", "wire", "payment", "password", "credential", "legal", "lawsuit", "medical", "diagnos", "prescri", "guarantee")
#: (threshold, most words of a fast response, blocked phrases, markers, actions always deep)
PROFILES = {
    "customer_support": (0.55, 110, ("guaranteed refund", "we never share data"), MARKERS, True),
    "internal_knowledge_assistant": (0.74, 160, (), ("password", "credential", "secret", "offboard"), False),
    "financial_agent": (0.28, 90, ("guaranteed return", "risk-free", "insider"), (*MARKERS, "trade", "portfolio", "balance", "invest", "loan", "credit limit"), True),
    "realtime_voice_agent": (0.40, 70, (), MARKERS, True),
    "default": (0.50, 120, (), MARKERS, True),
}
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "PHONE": r"(?<!\d)(?:\+?\d[\s\-]?){9,14}\d(?!\d)", "CREDIT_CARD": r"(?<!\d)(?:\d[ \-]?){13,16}(?!\d)",
    "GOV_ID": r"\b[A-Z]{2}\d{6,10}\b", "ACCOUNT_ID": r"(?i)\b(?:ACC|ACCT|CUST|EMP)[\-_]?\d{4,}\b",
}
#: What every match of a pattern holds, without the boundaries that are slow to look for at each character; whether there is
#: an address at all shows at the character before the at sign.
SIGNS = {"PHONE": r"(?:[0-9][\s\-]?\+?){9}[0-9]", "CREDIT_CARD": r"(?:[0-9][ \-]?){12}[0-9]", "GOV_ID": r"[A-Z]{2}[0-9]{6}", "ACCOUNT_ID": r"[CTPctp][\-_]?[0-9]{4}"}
ADDRESS = r"[A-Za-z0-9._%+\-]@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
NUMBER, LINK, CAPITALS = r"(?<!\w)(?:[₹$€£]\s?)?\d[\d,]*(?:\.\d+)?%?", r"https?://|www\.|(?<!\w)@[A-Za-z0-9_]{2,}", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
HEDGES = "might maybe perhaps possibly probably likely unsure think believe approximately around about roughly seems appears could should generally typically assume guess".split()
QUESTIONS = "who what when where why how which is are does can".split()
WEIGHTS = {
    "response_length_ratio": 1.30, "digit_density": 1.90, "entity_density": 1.55, "hedge_density": 2.10, "low_context_overlap": 2.35, "claim_count": 0.28, "question_form": 0.45, "action_flag": 1.20, "no_evidence": 1.40,
}
BIAS, DIM = -1.15, 64


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


#: Names of the columns of ``measured``.
MEASURED = ("words", "context_words", "said", "capitals", "evidence")


def words(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


#: Action types that only answer.
ANSWERS = ("", "none", "information", "informational", "info", "answer", "chat")


def is_action(action_type: Column, amount: Column) -> Column:
    """Whether an interaction does something besides answering; whom an answer is about does not count."""
    return ~F.lower(F.trim(F.coalesce(action_type, F.lit("")))).isin(*ANSWERS) | (F.coalesce(amount, F.lit(0.0)) > 0)


def cascade_check(prompt: Column, response: Column, context: Column, profile: str, action: Column | None = None) -> Column:
    """Comma-joined signals of the fixed check: violations if there are any, else what blocks the fast path."""
    _, most, blocked, markers, _ = PROFILES[profile]
    low, asked = F.lower(response), F.lower(prompt)
    violations = [F.when(response.rlike(p), f"PII_PATTERN:{n}") for n, p in PATTERNS.items()] + [F.when(low.contains(k), f"BLOCKED_KEYWORD:{k}") for k in blocked]
    numbers, evidence = F.regexp_count(response, F.lit(NUMBER)), F.length(F.trim(context)) > 0
    stakes = F.filter(F.array(*(F.when(asked.contains(m) | low.contains(m), m) for m in sorted(markers))), lambda m: m.isNotNull())
    blockers = [
        F.when(words(response) > most, "RESPONSE_TOO_LONG"),
        *([] if action is None else [F.when(action, "SIDE_EFFECTING_ACTION")]),
        F.when(response.rlike(LINK), "CONTAINS_URL_OR_HANDLE"),
        F.when(response.rlike(CAPITALS), "CONTAINS_NAMED_ENTITY"),
        F.when((numbers > 0) & ~evidence, "UNGROUNDED_NUMERIC_CLAIM").when(numbers > 2, "MULTIPLE_NUMERIC_CLAIMS"), F.when(F.size(stakes) > 0, F.concat(F.lit("HIGH_STAKES_INTENT:"), F.array_join(stakes, "+"))),
    ]
    hit = F.concat_ws(",", *violations)
    return F.when(hit != "", hit).otherwise(F.concat_ws(",", *blockers))


def _outcome(prompt: Column, response: Column, chosen: Callable, action: Column, found: dict[str, Column], most: Column) -> Column:
    """``outcome`` of ``cascade_check`` without its list: what is cheap is asked first, and nothing after a yes."""
    low, asked, said = F.lower(response), F.lower(prompt), lambda c: F.coalesce(c, F.lit(False))
    any_of = lambda conditions: reduce(lambda a, b: a | b, (said(c) for c in conditions), F.lit(False))
    holds = [*(response.rlike(SIGNS.get(n, x)) & response.rlike(x) for n, x in PATTERNS.items() if n != "EMAIL"), response.contains("@") & response.rlike(ADDRESS)]
    violation = any_of([*holds, chosen(lambda x: any_of(low.contains(k) for k in PROFILES[x][2]))])
    numbers = F.regexp_count(response, F.lit(NUMBER))
    stakes = chosen(lambda x: any_of(c for m in PROFILES[x][3] for c in (asked.contains(m), low.contains(m))))
    blocked = any_of([action, found["words"] > most, found["capitals"] > 0, response.rlike(LINK), numbers > F.when(~found["evidence"], 0).otherwise(2), stakes])
    return F.when(violation, "VIOLATION").when(blocked, "AMBIGUOUS").otherwise("CLEARED")


def outcome(signals: Column) -> Column:
    return F.when(signals == "", "CLEARED").when(signals.rlike("^(?:PII_PATTERN|BLOCKED_KEYWORD):"), "VIOLATION").otherwise("AMBIGUOUS")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z']+)"), F.lit(1))


def measured(response: Column, context: Column) -> dict[str, Column]:
    """What several signals and features need of the texts; as columns of their own step, each text is searched once."""
    return {"words": words(response), "context_words": words(context), "said": _tokens(response), "capitals": F.regexp_count(response, F.lit(CAPITALS)), "evidence": F.length(F.trim(context)) > 0}


def features(prompt: Column, response: Column, context: Column, action: Column | None = None, found: dict[str, Column] | None = None) -> dict[str, Column]:
    """Nine features in [0, 1]; ``found`` are the columns of ``measured``."""
    tokens, found = _tokens, found or measured(response, context)
    n, m, said, evidence = F.greatest(found["words"], F.lit(1)), F.greatest(found["context_words"], F.lit(1)), found["said"], found["evidence"]
    a, b = F.array_distinct(F.transform(said, F.lower)), F.array_distinct(F.transform(tokens(context), F.lower))
    overlap = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    hedges = F.size(F.filter(said, lambda w: F.lower(w).isin(*HEDGES)))
    first = F.lower(F.element_at(F.split(F.trim(prompt), " "), 1))
    return {
        "response_length_ratio": _clamp(n / (m + 8)), "digit_density": _clamp(F.regexp_count(response, F.lit("[0-9]")) / F.greatest(F.char_length(response), F.lit(1)) * 12),
        "entity_density": _clamp(found["capitals"] / (n / 20 + 1)), "hedge_density": _clamp(hedges / (F.size(said) / 15 + 1)), "low_context_overlap": F.when(evidence, _clamp(1 - overlap)).otherwise(1.0),
        "claim_count": _clamp(F.size(F.split(F.trim(response), r"[.!?;]\s+|\n+")) / 8), "question_form": F.when(first.isin(*QUESTIONS) | F.rtrim(prompt).endswith("?"), 1.0).otherwise(0.0),
        "action_flag": F.when(action, 1.0).otherwise(0.0) if action is not None else F.lit(0.0), "no_evidence": F.when(evidence, 0.0).otherwise(1.0),
    }


def complexity(found: dict[str, Column]) -> Column:
    z = F.lit(BIAS)
    for name, c in found.items():
        z = z + WEIGHTS[name] * c
    return 1 / (1 + F.exp(-z))


def effective_threshold(response: Column, profile: str, action: Column | None = None, session_complexity: Column | None = None) -> Column:
    at, most, _, _, forced = PROFILES[profile]
    t = F.when(words(response) > 2 * most, max(0.0, at - 0.10)).otherwise(at)
    if session_complexity is not None:
        t = F.when(session_complexity >= 0.60, F.greatest(F.lit(0.0), t - 0.10)).otherwise(t)
    return F.when(action, 0.0).otherwise(t) if forced and action is not None else t


def rerouted(out: DataFrame) -> DataFrame:
    """Verdict and reason from outcome, complexity and threshold."""
    above = F.col("complexity") >= F.col("threshold")
    clear, crossed = F.col("outcome") == "CLEARED", F.col("outcome") == "VIOLATION"
    reason = (
        F.when(clear, "DETERMINISTIC_CLEAR").when(crossed, "DETERMINISTIC_HARD_BOUNDARY")
        .when(above, "COMPLEXITY_ABOVE_THRESHOLD").otherwise("COMPLEXITY_BELOW_THRESHOLD")
    )
    verdict = F.when(~clear & (crossed | above), "ROUTE_TO_DEEP").otherwise("FAST_ALLOW")
    return out.withColumn("verdict", verdict).withColumn("reason", reason)


def cascade(turns: DataFrame, profile: str = "default", action: Column | None = None) -> DataFrame:
    """Signals, complexity, verdict and reason for every turn with prompt, context and response.

    ``action`` says which turns do something (see ``is_action``); without it none does.
    """
    p, r, c = F.col("prompt"), F.col("response"), F.col("context")
    if action is not None:
        turns, action = turns.withColumn("_action", action), F.col("_action")
    out = turns.withColumn("signals", cascade_check(p, r, c, profile, action)).withColumn("outcome", outcome(F.col("signals")))
    out = out.withColumns({k: r4(v, 6) for k, v in features(p, r, c, action).items()})
    out = out.withColumn("complexity", r4(complexity({k: F.col(k) for k in WEIGHTS}), 6)).withColumn("threshold", effective_threshold(r, profile, action))
    return rerouted(out).drop("_action")


def cascade_by(turns: DataFrame, application: str = "application") -> DataFrame:
    """The cascade under the profile of each row's application (``default`` for others): outcome, complexity, whether deep.

    Rows have action_type and amount; under most profiles whatever acts is checked deeply.
    """
    p, r, c, act = F.col("prompt"), F.col("response"), F.col("context"), F.col("_action")
    others = [n for n in PROFILES if n != "default"]

    def chosen(of: Callable[[str], Column]) -> Column:
        own = [F.when(F.col(application) == name, of(name)) for name in others]
        return F.when(F.col(application).isin(*others), F.coalesce(*own)).otherwise(of("default"))

    # in steps, so that the texts are searched once
    out = turns.withColumn("_action", is_action(F.col("action_type"), F.col("amount"))).withColumns({f"_{k}": v for k, v in measured(r, c).items()})
    found = {k: F.col(f"_{k}") for k in MEASURED}
    n, most, at = found["words"], chosen(lambda x: F.lit(PROFILES[x][1])), chosen(lambda x: F.lit(PROFILES[x][0]))
    low_at, forced = chosen(lambda x: F.lit(max(0.0, PROFILES[x][0] - 0.10))), chosen(lambda x: F.lit(PROFILES[x][4]))
    threshold = F.when(act & forced, 0.0).when(n > 2 * most, low_at).otherwise(at)
    out = out.withColumns({"cascade_outcome": _outcome(p, r, chosen, act, found, most), "_threshold": threshold, **{f"_{k}": v for k, v in features(p, r, c, act, found).items()}})
    out = out.withColumn("complexity", r4(complexity({k: F.col(f"_{k}") for k in WEIGHTS}), 6))
    above = F.col("complexity") >= F.col("_threshold")
    deep = (F.col("cascade_outcome") != "CLEARED") & ((F.col("cascade_outcome") == "VIOLATION") | above)
    return out.withColumn("cascade_deep", deep).drop("_action", "_threshold", *(f"_{k}" for k in (*WEIGHTS, *MEASURED)))


def _fnv(token: str) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for byte in token.encode("utf-8"):
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    """Signed hash buckets of words and character trigrams, unit length. Hashes are remembered within a batch."""
    import re

    seen: dict[str, tuple[int, float]] = {}
    out = []
    for text in texts:
        low, v = (text or "").lower(), np.zeros(DIM)
        for token in (*re.findall(r"[A-Za-z']+", low), *(low[i : i + 3] for i in range(max(0, len(low) - 2)))):
            if token not in seen:
                h = _fnv(token)
                seen[token] = (h % DIM, 1.0 if h >> 32 & 1 else -1.0)
            i, sign = seen[token]
            v[i] += sign
        norm = np.linalg.norm(v)
        out.append(v / norm if norm else v)
    return pd.Series(out)


def train_router(rows: DataFrame, text: Column, label: Column, every: int = 5, key: str = "interaction_id") -> tuple[object, DataFrame]:
    """A logistic router on hashed features; every ``every``-th row by hash of its key is held out. Returns (model, scored rows)."""
    data = rows.withColumn("features", array_to_vector(embed(text))).withColumn("label", label.cast("double")).withColumn("held_out", F.pmod(F.xxhash64(key), F.lit(every)) == 0)
    model = LogisticRegression(maxIter=30, regParam=0.01).fit(data.filter("not held_out").select("features", "label"))
    return model, model.transform(data)


def evaluate_router(scored: DataFrame) -> DataFrame:
    """Held-out accuracy, recall and precision of deep routing, and the accuracy of always going deep."""
    deep, said = F.col("label") == 1, F.col("prediction") == 1
    safe = lambda a, b: r4(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return scored.filter("held_out").agg(F.count(F.lit(1)).alias("n"), rate(deep == said).alias("accuracy"), safe(F.count_if(deep & said), F.count_if(deep)).alias("deep_recall"), safe(F.count_if(deep & said), F.count_if(said)).alias("deep_precision"), rate(deep).alias("always_deep"))


def cost_optimal_threshold(samples: DataFrame, score: str, flips: Column, deep_cost: float = 1.0, penalty: float = 20.0, most_missed: float = 0.02, grid: Sequence[float] = tuple(round(i / 100, 2) for i in range(0, 101, 2))) -> DataFrame:
    """The threshold of least expected cost that misses few risks, else the safest; scores are counted first."""
    histogram = samples.groupBy(F.col(score).alias("score"), flips.alias("flips")).agg(F.count(F.lit(1)).alias("n"))
    each = histogram.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    up = F.col("score") >= F.col("threshold")
    total = F.sum("n")
    out = each.groupBy("threshold").agg(
        (F.sum(F.when(up, F.col("n") * deep_cost).when(F.col("flips"), F.col("n") * penalty).otherwise(0.0)) / total).alias("cost"), (F.sum(F.when(up, F.col("n")).otherwise(0)) / total).alias("escalation_rate"),
        (F.sum(F.when(~up & F.col("flips"), F.col("n")).otherwise(0)) / total).alias("missed_rate"),
    )
    good = F.col("missed_rate") <= most_missed
    best = out.orderBy(~good, F.when(good, F.col("cost")).otherwise(F.col("missed_rate")), "threshold").limit(1)
    return best.select("threshold", r4(F.col("cost")).alias("cost"), r4(F.col("escalation_rate")).alias("escalation_rate"), r4(F.col("missed_rate")).alias("missed_rate"), good.alias("satisfied"))


def summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("n"), many(F.col("no_evidence") == 1).alias("no_evidence"))
