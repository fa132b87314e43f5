"""Personal data by weak supervision, in DataFrame functions.

Fixed patterns give the base spans. Looser patterns, and matches that fail a check, give further candidates. Labelers (a
format check, a gazetteer, the words before, the shape) vote on every candidate of the corpus; votes are counted by
pattern, and expectation-maximisation over these counts (a bounded table) estimates how reliable each labeler is and how
likely each pattern is personal data. A logistic span classifier trained on these likelihoods decides on candidates that
are not base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive loops and anchors keep matching linear; they match what the plain patterns match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns of further candidates: spelt-out and defanged addresses, numbers in local form. None for cards.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(](?:\.|dot|DOT)[\])]\x20?[0-9]{1,3}){3}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: What a text must contain for a kind to be looked for at all.
NEEDS = {"email": "@", "phone": "+"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Gazetteers: endings of addresses, first digits of cards, country codes of phones (fixed values).
ENDINGS = r"(?i)\.(?:com|org|net|edu|gov|int|io|info|biz|co|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NOT_PUBLIC = r"^(?:0+|127|255)\."
#: Words before a span that speak for a kind, and for none.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)\b",
}
AGAINST = r"(?i)\b(?:version|release|isbn|order|invoice|ticket|total|serial|sku|part|item|section|rfc)\b[^A-Za-z]*$"
LABELERS = ("format", "gazetteer", "context", "shape")
#: Prior reliability of each labeler, and its weight in parts of the votes. The format check tests a checksum or a
#: range, so its prior is strong.
PRIOR = np.array([(0.98, 1.0), (0.75, 0.1), (0.75, 0.1), (0.75, 0.1)])
#: Characters before a span that are its context; likelihood from which a candidate is taken.
BEFORE, TAKE = 40, 0.8
MARKS = "\u0001\u0002"
SPAN = "array<struct<start:int,end:int,text:string,before:string>>"


#: Pieces of a text that are folded together; an even number, so that every block begins outside a match.
BLOCK = 128


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their positions in code points.

    Matches are put between two marks, the text is split at the marks, and lengths are summed up. Marks in the text
    itself are first replaced by another character that no pattern matches. Pieces are folded in blocks: lists grow by
    copying, so one fold over all pieces would take time in the square of the matches.
    """
    plain = F.translate(text, MARKS, "\u0003\u0003")
    parts = F.split(F.regexp_replace(plain, pattern, f"{MARKS[0]}$0{MARKS[1]}"), f"[{MARKS}]", -1)
    none = F.array().cast(SPAN)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("text"), F.right(acc["last"], F.lit(BEFORE)).alias("before")))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), part.alias("last"), F.when(acc["odd"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def spans(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(False).alias("odd"), F.lit("").alias("last"), none.alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def in_blocks(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
        length = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.char_length(x))
        starts = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + length(b))))
        return _bound(blocks, lambda bs: _bound(starts(bs), lambda s: F.flatten(F.transform(bs, lambda b, i: spans(b, F.get(s, i))))))

    return _bound(parts, in_blocks)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes(kind: str, text: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    n = F.length(digits(text))
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": n.between(13, 19) & F.call_function("luhn_check", digits(text)),
        "phone": n.between(9, 15),
    }[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _undone(text: Column) -> Column:
    """A defanged address with plain dots."""
    return F.regexp_replace(text, r"\x20?[\[(](?:\.|dot|DOT)[\])]\x20?", ".")


def votes(kind: str, span: Column, base: bool) -> Column:
    """A struct with a vote of -1, 0 or 1 by every labeler, and whether the span is from a base pattern."""
    text, before, never = span["text"], span["before"], F.lit(False)
    gazetteer = {
        "email": _vote(F.regexp_replace(text, r"(?i)\x20?[\[(]dot[\])]\x20?", ".").rlike(ENDINGS), never),
        "ip": _vote(never, _undone(text).rlike(NOT_PUBLIC)),
        "card": _vote(digits(text).rlike(ISSUERS), ~digits(text).rlike(ISSUERS)),
        "phone": _vote(text.rlike(COUNTRIES), text.startswith("+") & ~text.rlike(COUNTRIES)),
    }[kind]
    grouped = {
        "email": text.rlike(r"^[A-Za-z0-9]+[._][A-Za-z0-9]+"),
        "ip": _undone(text).rlike(rf"^(?=[1-9]){OCTET}(?:\.{OCTET}){{3}}$"),
        "card": text.rlike(r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5}$|^[0-9]{15,16}$"),
        "phone": text.rlike(r"\([0-9]{2,4}\)|[0-9]{3}[\x20.-][0-9]{3,4}"),
    }[kind]
    dull = digits(text).rlike(r"([0-9])\1{6}|0123456|1234567")
    checked = passes(kind, text)
    return F.struct(
        (_vote(checked, ~checked) if base else F.lit(0)).alias("format"), gazetteer.alias("gazetteer"),
        _vote(before.rlike(CONTEXT[kind]) & ~before.rlike(AGAINST), before.rlike(AGAINST)).alias("context"),
        _vote(grouped & ~dull, dull).alias("shape"), F.lit(base).alias("base"),
    )


def _passing(kind: str, every: Column) -> Column:
    return F.filter(every, lambda x: passes(kind, x["text"]))


def _voted(kind: str, spans: Column, base: bool) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), votes(kind, x, base).alias("votes")))


def _further(kind: str) -> Column:
    """Candidates of a kind that are not base spans: matches with a failed check, and looser ones apart from base spans."""
    base, more = F.col(f"_{kind}"), []
    if kind in ("card", "phone"):
        least, most = (13, 19) if kind == "card" else (7, 15)
        failed = F.filter(F.col(f"_{kind}_all"), lambda x: ~passes(kind, x["text"]) & F.length(digits(x["text"])).between(least, most))
        more.append(_voted(kind, failed, True))
    if kind in LOOSE:
        free = F.filter(F.col(f"_{kind}_loose"), lambda x: ~F.exists(base, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
        more.append(_voted(kind, free, False))
    return F.concat(*more) if more else F.array().cast("array<struct<start:int,end:int>>")


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _taken(kind: str, model: Model, take: float) -> Column:
    return F.filter(F.col(f"_{kind}_more"), lambda x: model.likelihood(kind, x["votes"]) >= take)


def _all_votes(kind: str) -> Column:
    every = F.transform(F.col(f"_{kind}"), lambda x: votes(kind, x, True))
    if kind in LOOSE or kind == "card":
        every = F.concat(every, F.transform(F.col(f"_{kind}_more"), lambda x: x["votes"]))
    return F.transform(every, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_<kind>`` (base spans) and ``_<kind>_more`` (further candidates with votes) for every kind."""
    none = F.array().cast(SPAN)
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_digit = text.rlike("[0-9]")
    out = docs
    for kind in KINDS:
        there = text.contains(NEEDS[kind]) if kind in NEEDS else has_digit
        out = out.withColumn(f"_{kind}_all", F.when(there, found_spans(text, BASE[kind])).otherwise(none))
        if kind in LOOSE:
            out = out.withColumn(f"_{kind}_loose", F.when(has_digit | text.contains("[") | text.contains("("), found_spans(text, LOOSE[kind])).otherwise(none))
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", _passing(kind, F.col(f"_{kind}_all")))
    for kind in KINDS:
        out = out.withColumn(f"_{kind}_more", _further(kind))
    return out.drop(*(f"_{k}_all" for k in KINDS), *(f"_{k}_loose" for k in LOOSE))


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier, and the labelers' reliabilities, by kind."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    reliability: dict[str, dict[str, float]] = field(default_factory=dict)

    def likelihood(self, kind: str, vote: Column) -> Column:
        w = self.weights.get(kind)
        if w is None:
            return F.lit(0.0)
        z = F.lit(w["bias"]) + F.when(vote["base"], w["base"]).otherwise(0.0)
        for name in LABELERS:
            z = z + F.when(vote[name] == 1, w[f"{name}+"]).when(vote[name] == -1, w[f"{name}-"]).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood of each vote pattern (rows of -1, 0, 1) and reliability of each labeler, from counts.

    Labelers err independently; prior votes keep reliabilities off 0 and 1 and from trading places.
    """
    reliable, share = PRIOR[:, 0].copy(), 0.5
    said = patterns != 0
    likely = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        odds = np.log(reliable / (1 - reliable))
        before, likely = likely, 1 / (1 + np.exp(-(patterns @ odds + math.log(share / (1 - share)))))
        right = np.where(patterns == 1, likely[:, None], 1 - likely[:, None])
        n = (said * counts[:, None]).sum(0)
        more = 10 + PRIOR[:, 1] * n
        reliable = ((right * said * counts[:, None]).sum(0) + more * PRIOR[:, 0]) / (n + more)
        reliable = np.clip(reliable, 0.5, 0.99)
        share = float(np.clip((likely @ counts + 1) / (counts.sum() + 2), 0.02, 0.98))
        if np.abs(likely - before).max() < 1e-9:
            break
    return likely, reliable


def _classifier(patterns: np.ndarray, base: np.ndarray, counts: np.ndarray, likely: np.ndarray) -> dict[str, float]:
    """Logistic model of votes and origin on the likelihoods, weighted by counts (Newton steps with a ridge)."""
    names = ["bias", "base", *(f"{n}{s}" for n in LABELERS for s in "+-")]
    x = np.column_stack([np.ones(len(base)), base, *((patterns[:, i] == s) for i in range(len(LABELERS)) for s in (1, -1))]).astype(float)
    scale = counts / counts.sum() * min(counts.sum(), 1e6)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (scale * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (scale * (p - likely)) + 0.5 * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(names, map(float, w), strict=True))


def train(candidates: DataFrame) -> Model:
    """Votes on every candidate of all documents (``with_candidates``), counted by pattern (162 of a kind at most), then fitted.

    Base spans vote too: they show the labelers' reliabilities.
    """
    counted = candidates.select(F.explode(F.concat(*map(_all_votes, KINDS))).alias("c")).groupBy("c.kind", "c.v").count().collect()
    weights, reliability = {}, {}
    for kind in KINDS:
        rows = sorted(((tuple(r["v"]), r["count"]) for r in counted if r["kind"] == kind))
        if rows:
            patterns = np.array([r[0][:-1] for r in rows], dtype=float)
            base, counts = np.array([r[0][-1] for r in rows], dtype=float), np.array([r[1] for r in rows], dtype=float)
            likely, reliable = expectation_maximisation(patterns, counts)
            weights[kind] = _classifier(patterns, base, counts, likely)
            reliability[kind] = dict(zip(LABELERS, map(float, reliable), strict=True))
    return Model(weights, reliability)


def detect(docs: DataFrame, text_col: str = "text", take: float = TAKE, keep_text: bool = True) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (kind, start, end), by kind as listed and then by start.

    ``spans`` holds all base spans and the candidates that the classifier takes. Null and empty texts have none. Rows,
    ids and other columns stay as they are; there is no shuffle but for the counts of votes. Texts are read once: the
    candidates, with the other columns, are a table in the shared folder. Without ``keep_text`` the text stays behind.
    """
    rows = with_candidates(docs, text_col)
    rows = saved(rows if keep_text else rows.drop(text_col), "candidates")
    model = train(rows)
    base, spans = [], []
    for kind in KINDS:
        own = _named(kind, F.col(f"_{kind}"))
        base.append(own)
        if kind in LOOSE or kind == "card":
            own = F.array_sort(F.array_distinct(F.concat(own, _named(kind, _taken(kind, model, take)))))
        spans.append(own)
    out = rows.withColumn("base", F.concat(*base)).withColumn("spans", F.concat(*spans))
    return out.drop(*(f"_{k}" for k in KINDS), *(f"_{k}_more" for k in KINDS))


def number_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap the first names all."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced in ``text``, and ``n_chars`` following it; columns as they were."""
    hidden = detect(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), "in_text")
    text = redacted(F.col("in_text"), F.col("spans"))
    out = hidden.withColumn("in_text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("in_n_chars", F.when(F.size("spans") > 0, F.char_length("in_text").cast("long")).otherwise(F.col("in_n_chars")))
    return out.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))
