"""The nested record of a decision: findings, claims, and the rules with their running tier; redacted before it leaves.

A text of a record is redacted by all findings of the record, longest first, wherever they stand in it, so that what one
sentence shows to be personal is hidden in every other as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import config as C
from vigil.functions.schema import struct
from vigil.operators import replay as P

FINDING = struct("category string, subtype string, severity string, matched_text string, redacted_text string, start int, end int")
CLAIM = struct("claim_no int, claim string, evidence string, similarity double")
RULE = struct("step int, rule string, fired boolean, from_tier string, tier_after string")
#: The record as it is stored.
TRACE = T.StructType([
    T.StructField("interaction_id", T.LongType()), T.StructField("decision", T.StringType()), T.StructField("overall_risk", T.DoubleType()), T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType()),
    T.StructField("findings", T.ArrayType(FINDING)), T.StructField("claims", T.ArrayType(CLAIM)), T.StructField("rule_trace", T.ArrayType(RULE)),
])
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def rule_trace(decided: DataFrame) -> Column:
    """Every rule in policy order: whether it moved the tier, and the tier before and after it. Needs the tier columns."""
    name = lambda c: F.element_at(F.array(*map(F.lit, C.TIERS)), c + 1)
    parts = []
    for i, (rule, before, after) in enumerate(P.STEPS):
        a, b = (F.col(before) if before else F.lit(0)), F.col(after)
        parts.append(F.struct(F.lit(i).alias("step"), F.lit(rule).alias("rule"), (a != b).alias("fired"), name(a).alias("from_tier"), name(b).alias("tier_after")))
    return F.array(*parts).cast(T.ArrayType(RULE))


def finding_structs(findings: Column, severity: Column) -> Column:
    """Findings of the personal-data scan as they stand in a record; ``severity`` gives a rank (1 to 4) of each by place."""
    return F.transform(
        F.arrays_zip(findings.alias("f"), severity.alias("s")),
        lambda x: F.struct(
            F.lit("pii").alias("category"), x["f"]["subtype"].alias("subtype"), F.element_at(F.array(*map(F.lit, SEVERITIES)), x["s"]).alias("severity"), x["f"]["matched"].alias("matched_text"),
            x["f"]["redacted"].alias("redacted_text"), x["f"]["start"].alias("start"), x["f"]["end"].alias("end"),
        ),
    ).cast(T.ArrayType(FINDING))


def redactions(findings: Column, matched: str = "matched_text", redacted: str = "redacted_text") -> Column:
    """What to replace by what, different pairs only, longest match first; blank matches replace nothing."""
    pairs = F.transform(findings, lambda f: F.struct((-F.char_length(F.trim(f[matched]))).alias("less"), F.trim(f[matched]).alias("raw"), F.coalesce(f[redacted], F.lit("[REDACTED]")).alias("by")))
    return F.array_sort(F.array_distinct(F.filter(pairs, lambda p: p["raw"] != "")))


def redact(text: Column, pairs: Column) -> Column:
    """``text`` with every match of the record's pairs replaced; null stays null."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["raw"], p["by"]))


def redacted(traces: DataFrame) -> DataFrame:
    """Records without a raw match in any text: prompt, response, matched texts, claims and evidence."""
    out = traces.withColumn("_pairs", redactions(F.col("findings")))
    p = F.col("_pairs")
    out = out.withColumns({
        "prompt": redact(F.col("prompt"), p), "response": redact(F.col("response"), p),
        "claims": F.transform("claims", lambda c: c.withField("claim", redact(c["claim"], p)).withField("evidence", redact(c["evidence"], p))),
        "findings": F.transform("findings", lambda f: f.withField("matched_text", f["redacted_text"])),
    })
    return out.drop("_pairs")


def traces(decided: DataFrame, texts: DataFrame, claims: DataFrame, key: str = "interaction_id") -> DataFrame:
    """The nested records: ``decided`` with tier columns, ``texts`` (key, prompt, response, findings), ``claims`` (key and
    the fields of ``CLAIM``), which are folded in order of their number. Decisions without texts have empty lists."""
    folded = claims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*CLAIM.names))).alias("claims"))
    out = decided.select(key, "decision", "overall_risk", rule_trace(decided).alias("rule_trace")).join(texts.select(key, "prompt", "response", "findings"), key, "left").join(folded, key, "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(T.ArrayType(kind))).cast(T.ArrayType(kind)).alias(c)
    return out.select(F.col(key).cast("long").alias("interaction_id"), "decision", "overall_risk", "prompt", "response", empty("findings", FINDING), empty("claims", CLAIM), "rule_trace")


def stored(found: DataFrame) -> DataFrame:
    """Redacted records as rows to keep: key, promoted columns and the whole record as JSON."""
    safe = redacted(found)
    return safe.select("interaction_id", "decision", "overall_risk", F.to_json(F.struct(*TRACE.names), {"ignoreNullFields": "false"}).alias("record"))


def restored(rows: DataFrame) -> DataFrame:
    """The records that ``stored`` wrote."""
    return rows.select(F.from_json("record", TRACE).alias("t")).select("t.*")


def leaks(rows: DataFrame, found: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Raw matches that are still readable in a stored record: none, or the redaction is wrong."""
    raw = found.select(key, F.explode(F.array_distinct(F.transform("findings", lambda f: f["matched_text"]))).alias("raw"))
    return rows.join(raw, key).filter((F.trim("raw") != "") & F.col("record").contains(F.col("raw"))).select(key, "raw")
