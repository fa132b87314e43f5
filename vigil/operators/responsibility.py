"""Responsibility scan of responses: personal data, toxicity, bias."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import lexicons as L
from vigil.functions.columns import r4
from vigil.functions.schema import struct

WEIGHTS = {"pii": 0.45, "toxicity": 0.35, "bias": 0.20}
FINDINGS = T.ArrayType(struct("subtype string, start int, end int, matched string, redacted string"))


def phrase(text: str) -> str:
    """The phrase as it stands, in any case; lexicon phrases hold no character that a pattern reads otherwise."""
    return "(?i)" + text


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def toxicity(text: Column) -> dict[str, Column]:
    """Phrase counts by category, risk and confidence. Whether the lower-case text holds any phrase decides whether to count at all."""
    low = F.lower(text)
    hit = F.coalesce(reduce(lambda a, b: a | b, (low.contains(p) for ps in L.TOXIC.values() for p in ps)), F.lit(False))
    n = {k: F.when(hit, sum((count_of(text, phrase(p)) for p in ps[1:]), count_of(text, phrase(ps[0])))).otherwise(0) for k, ps in L.TOXIC.items()}
    return {f"n_{k}": c.cast("int") for k, c in n.items()}


def toxicity_risk(n: dict[str, Column]) -> tuple[Column, Column]:
    total = sum(list(n.values())[1:], next(iter(n.values())))
    top = F.greatest(*(F.when(c > 0, L.TOXIC_WEIGHT[k]).otherwise(0.0) for k, c in n.items()))
    risk = F.when(total > 0, F.least(F.lit(1.0), top + F.least(F.lit(0.15), 0.05 * (total - 1)))).otherwise(0.0)
    return r4(risk), r4(F.when(total > 0, F.least(F.lit(0.8), 0.55 + 0.08 * total)).otherwise(0.6))


def bias(text: Column) -> dict[str, Column]:
    """Pattern counts by kind; the generalising kinds need a group word somewhere in the text. Patterns are tried where their words are."""
    low = F.lower(text)
    group = F.coalesce(text.rlike(r"(?i)\b(?:" + "|".join(sorted(set(L.GROUPS), key=lambda g: (-len(g), g))) + r")\b"), F.lit(False))
    out: dict[str, Column] = {}
    for (pattern, kind), words in zip(L.BIAS, L.BIAS_HOLDS, strict=True):
        holds = F.coalesce(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), F.lit(False))
        n = count_of(text, "(?i)" + pattern)
        n = F.when(holds, F.when(group, n).otherwise(0) if kind in L.NEED_GROUP else n).otherwise(0)
        out[kind] = out[kind] + n if kind in out else n
    return {f"b_{k}": c.cast("int") for k, c in out.items()}


def bias_risk(n: dict[str, Column]) -> tuple[Column, Column]:
    total = sum(list(n.values())[1:], next(iter(n.values())))
    kinds = sum([F.when(c > 0, 1).otherwise(0) for c in list(n.values())[1:]], F.when(next(iter(n.values())) > 0, 1).otherwise(0))
    top = F.greatest(*(F.when(c > 0, L.BIAS_WEIGHT[k]).otherwise(0.0) for k, c in n.items()))
    risk = F.when(total > 0, F.least(F.lit(0.8), top + 0.05 * (kinds - 1))).otherwise(0.0)
    return r4(risk), r4(F.when(total > 0, F.least(F.lit(0.65), 0.45 + 0.06 * total)).otherwise(0.55))


def _luhn(text: str) -> bool:
    total, digits = 0, [int(c) for c in text if c.isdigit()]
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return len(digits) >= 13 and total % 10 == 0


def _redaction(kind: str, matched: str) -> str:
    if kind == "email":
        local, _, domain = matched.partition("@")
        return f"{local[:1]}***@{domain[:1]}***"
    if kind == "phone":
        return "*" * (len(matched) - 2) + matched[-2:]
    return L.TOKENS[kind]


def scan(text: str | None) -> list[dict]:
    """Findings in order of position. Earlier patterns claim their text; names count only beside another finding."""
    text, found = text or "", []
    patterns = [*((k, _COMPILED[i]) for i, (k, _) in enumerate(L.PII)), ("person_name", _NAME)]
    for kind, pattern in patterns:
        if kind == "person_name" and not found:
            break
        if kind in HOLDS and HOLDS[kind] not in text:
            continue
        for m in pattern.finditer(text):
            part = m.group()
            if kind == "credit_card" and not _luhn(part) or kind == "phone" and sum(c.isdigit() for c in part) < 8:
                continue
            if kind == "person_name" and (part in L.NOT_NAMES or part.split()[0] in L.NOT_FIRST):
                continue
            if all(m.end() <= f["start"] or m.start() >= f["end"] for f in found):
                found.append({"subtype": kind, "start": m.start(), "end": m.end(), "matched": part, "redacted": _redaction(kind, part)})
    return sorted(found, key=lambda f: f["start"])


_COMPILED = [re.compile(p) for _, p in L.PII]
_NAME = re.compile(L.NAME)


#: What a text must hold for a pattern to be worth a search.
HOLDS = {"email": "@", "account_id": "ACC-", "employee_id": "EMP-"}


@F.pandas_udf(FINDINGS)
def scan_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([scan(t) for t in texts])


def findings(text: Column) -> Column:
    """Positions and overlaps need a helper; texts without a digit or an at sign cannot have a finding and skip it."""
    possible = F.when(text.rlike(r"[0-9@]"), text)
    return F.when(text.rlike(r"[0-9@]"), scan_udf(possible)).otherwise(F.array().cast(FINDINGS))


def pii_risk(found: Column, action: Column) -> tuple[Column, Column]:
    """(risk, whether critical) of a row's findings."""
    kinds = F.array_distinct(F.transform(found, lambda f: f["subtype"]))
    weight = lambda k: F.coalesce(*(F.when(k == n, w) for n, w in L.PII_WEIGHT.items()), F.lit(0.4))
    outward = F.coalesce(action.isin(*L.OUTWARD), F.lit(False))
    critical = F.exists(kinds, lambda k: k.isin(*sorted(L.CRITICAL)) | (outward & k.isin(*sorted(L.IDENTIFYING))))
    contacts = F.size(F.array_intersect(kinds, F.array(*map(F.lit, L.CONTACT)))) >= 2
    base = F.least(F.lit(1.0), F.array_max(F.transform(kinds, weight)) + 0.05 * (F.size(kinds) - 1))
    risk = F.when(contacts, F.greatest(base, F.lit(0.85))).otherwise(base)
    risk = F.when(outward & (critical | contacts), F.greatest(risk, F.lit(0.9))).otherwise(risk)
    return r4(F.when(F.size(kinds) > 0, risk).otherwise(0.0)), critical | contacts


def _valued(kind: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(*(F.when(kind == n, w) for n, w in table.items()), F.lit(default))


def severity(kind: Column, action: Column) -> Column:
    """Severity of a finding by its kind; what identifies a person is critical in what goes outward."""
    weight, outward = _valued(kind, L.PII_WEIGHT, 0.4), F.coalesce(action.isin(*L.OUTWARD), F.lit(False))
    critical = kind.isin(*sorted(L.CRITICAL)) | (weight >= 0.9) | (outward & kind.isin(*sorted(L.IDENTIFYING)))
    return F.when(critical, "CRITICAL").when(weight >= 0.7, "HIGH").when(weight >= 0.5, "MEDIUM").otherwise("LOW")


def entity_keys(found: Column) -> Column:
    """Different ``kind:redacted`` keys in order; they tell entities apart without their text."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda f: F.concat_ws(":", f["subtype"], f["redacted"]))))


def pii_confidence(found: Column) -> Column:
    """The surest finding; 0.6 without any."""
    return F.coalesce(F.array_max(F.transform(found, lambda f: _valued(f["subtype"], L.PII_CONFIDENCE, 0.7))), F.lit(0.6))


def redact(text: Column, found: Column) -> Column:
    """The text with every finding replaced; findings do not overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, f: F.struct(f["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, f["start"] - a["at"]), f["redacted"]).alias("out"))
    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))


def assess(rows: DataFrame, text_col: str = "text", action_col: str | None = None) -> DataFrame:
    """Add findings, counts, the three risks and their fusion. Null texts have no findings."""
    text = F.col(text_col)
    out = rows.withColumn("findings", findings(F.coalesce(text, F.lit("")))).withColumns(toxicity(text)).withColumns(bias(text))
    tox, bia = {k: F.col(f"n_{k}") for k in L.TOXIC}, {k: F.col(f"b_{k}") for k in L.BIAS_WEIGHT}
    action = F.col(action_col) if action_col else F.lit(None).cast("string")
    (pii, critical), (tr, tc), (br, bc) = pii_risk(F.col("findings"), action), toxicity_risk(tox), bias_risk(bia)
    out = out.withColumns({"pii_risk": pii, "critical_pii": critical, "toxicity_risk": tr, "toxicity_confidence": tc, "bias_risk": br, "bias_confidence": bc, "pii_confidence": pii_confidence(F.col("findings"))})
    # the surest detector that fired
    fired = F.array_max(F.array(*(F.when(F.col(f"{n}_risk") > 0, F.col(f"{n}_confidence")) for n in WEIGHTS)))
    out = out.withColumn("responsibility_confidence", r4(F.coalesce(fired, F.lit(0.6))))
    out = out.withColumn("toxic_critical", sum((F.col(f"n_{k}") for k, w in L.TOXIC_WEIGHT.items() if w >= 0.9), F.lit(0)) > 0)
    mixed = F.lit(WEIGHTS["pii"]) * F.col("pii_risk") + WEIGHTS["toxicity"] * F.col("toxicity_risk") + WEIGHTS["bias"] * F.col("bias_risk")
    out = out.withColumn("responsibility_risk", r4(F.greatest(mixed, 0.85 * F.greatest("pii_risk", "toxicity_risk", "bias_risk"))))
    rules = (("CRITICAL_PII", F.col("critical_pii")), ("PII_EXPOSURE", F.col("pii_risk") > 0), ("TOXICITY", F.col("toxicity_risk") >= 0.5), ("POTENTIAL_BIAS_SIGNAL", F.col("bias_risk") > 0), ("HIGH_RESPONSIBILITY_RISK", F.col("responsibility_risk") >= 0.6))
    return out.withColumn("responsibility_codes", F.concat_ws(",", *(F.when(c, n) for n, c in rules)))
