"""Grounding of responses in their context: claims, evidence, entailment, risk."""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import lexicons as L
from vigil.functions.columns import r4, spread
from vigil.functions.schema import struct
from vigil.operators.verdicts import folded

RETRIEVAL, ENTAIL, CONTRADICT, SHALLOW, DEEP, MAX_CHARS = 0.10, 0.60, 0.60, 1, 3, 800
#: Responses of a batch that Python holds as texts at once.
ROWS = 256
WORD = re.compile(r"\w\w+")
#: White space between words, and the spaces that are trimmed: both as the SQL has them, so a vertical tab is neither.
SPACE, SPACES = r"[\t\n\f\r ]+", " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def sentences(text: Column) -> Column:
    """Lines, split after . ! ? before white space; trimmed, empty ones left out."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"([.!?]){SPACE}", "$1\n")
    # a lambda of one name: F.trim would get the place as its second argument, and trim the digits of that
    return F.filter(F.transform(F.split(marked, r"[\n\r]+"), lambda s: F.trim(s, F.lit(SPACES))), lambda s: s != "")


def claims(text: Column, least: int = 2) -> Column:
    """Sentences of at least ``least`` words."""
    return F.filter(sentences(text), lambda s: s.rlike(f"(?:{SPACE}+[^\t\n\f\r ]*){{{least - 1}}}"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1))


def content(words: Column) -> Column:
    """Different tokens that are no stop word, modal, negation or number."""
    none = F.array(*map(F.lit, [*L.STOPWORDS, *L.MODALS, *L.NEGATIONS]))
    return F.filter(F.array_except(words, none), lambda w: ~w.rlike("^[0-9]+$"))


def _numbers(words: Column, most: int) -> Column:
    return F.array_distinct(F.filter(words, lambda w: w.rlike(f"^[0-9]{{1,{most}}}$")))


def _negated(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, L.NEGATIONS)))


def coverage_nli(premise: str, hypothesis: str) -> tuple[Column, Column]:
    """(label, confidence) by how much of the hypothesis the premise covers; inputs are token columns."""
    p, h = F.col(premise), F.col(hypothesis)
    asked = content(h)
    return _ruled(_cover(content(p), asked), F.size(asked) == 0, _negated(p) != _negated(h), _clash(_numbers(p, 3), _numbers(h, 3)))


def _cover(had: Column, asked: Column) -> Column:
    """Share of the words asked for."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(had, asked)), F.size(asked)), F.lit(0.0))


def _clash(pn: Column, hn: Column) -> Column:
    """Both have numbers, none in common."""
    return (F.size(pn) > 0) & (F.size(hn) > 0) & ~F.arrays_overlap(pn, hn)


def _ruled(cover: Column, empty: Column, negation: Column, numeric: Column) -> tuple[Column, Column]:
    topical = cover >= 0.30
    label = F.when(empty, "NEUTRAL").when(topical & (negation | numeric), "CONTRADICTION").when(cover >= 0.48, "ENTAILMENT").otherwise("NEUTRAL")
    confidence = (
        F.when(empty, 0.5).when(topical & negation, F.least(F.lit(0.97), 0.72 + 0.25 * cover)).when(topical & numeric, F.least(F.lit(0.95), 0.72 + 0.20 * cover))
        .when(cover >= 0.48, F.least(F.lit(0.95), 0.55 + 0.40 * cover)).otherwise(F.least(F.lit(0.60), 0.40 + 0.35 * cover))
    )
    return label, r4(confidence)


def jaccard_nli(premise: str, hypothesis: str) -> tuple[Column, Column]:
    """The symmetric variant: overlap of content words, any difference of numbers."""
    p, h = F.col(premise), F.col(hypothesis)
    a, b = content(p), content(h)
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    pn, hn = F.array_sort(_numbers(p, 40)), F.array_sort(_numbers(h, 40))
    negation, numeric = _negated(p) != _negated(h), (F.size(pn) > 0) & (F.size(hn) > 0) & (pn != hn)
    label = F.when((negation | numeric) & (overlap >= 0.4), "CONTRADICTION").when(overlap >= 0.5, "ENTAILMENT").otherwise("NEUTRAL")
    confidence = (
        F.when(negation & (overlap >= 0.4), F.least(F.lit(0.97), 0.75 + 0.25 * overlap)).when(numeric & (overlap >= 0.4), F.least(F.lit(0.95), 0.75 + 0.20 * overlap))
        .when(overlap >= 0.5, F.least(F.lit(0.97), 0.70 + 0.30 * overlap)).otherwise(F.least(F.lit(0.60), 0.45 + 0.30 * overlap))
    )
    return label, r4(confidence, 2)


def repack(sentence: str, most: int = MAX_CHARS) -> list[str]:
    """A sentence as it is, or packed word by word into parts of at most ``most`` characters."""
    if len(sentence) <= most:
        return [sentence]
    out, now = [], ""
    for word in sentence.split():
        parts = [word[i : i + most] for i in range(0, len(word), most)]
        for part in parts:
            if now and (len(parts) > 1 or len(now) + 1 + len(part) > most):
                out.append(now)
                now = ""
            now = f"{now} {part}".strip()
            if len(parts) > 1:
                out.append(now)
                now = ""
    return out + [now] if now else out


class Index:
    """Documents by the words they hold, added one by one; a query is weighed against all that are there so far.

    Cosine of a query with each document, smoothed idf over query and documents, words of two characters or more. A query
    touches only the documents that share a word with it, and no document is read twice.
    """

    def __init__(self) -> None:
        self.counts: list[Counter] = []
        self.df: Counter = Counter()
        self.holders: dict[str, list[tuple[int, int]]] = {}

    def add(self, document: str) -> None:
        c, j = Counter(WORD.findall(document.lower())), len(self.counts)
        self.counts.append(c)
        for w, k in c.items():
            self.df[w] += 1
            self.holders.setdefault(w, []).append((j, k))

    def scores(self, query: str) -> dict[int, float]:
        """Similarity of every document that shares a word with the query, by its place."""
        n, df = 2 + len(self.counts), self.df
        idf: dict[str, float] = {}

        def weight(w: str) -> float:
            if w not in idf:
                idf[w] = math.log(n / (1 + df[w])) + 1
            return idf[w]

        asked = Counter(WORD.findall(query.lower()))
        size, dots, norms = 0.0, {}, {}
        for w, k in asked.items():
            own = math.log(n / (2 + df.get(w, 0))) + 1  # the query is a document too
            size += (k * own) ** 2
            for j, m in self.holders.get(w, ()):
                if j not in dots:
                    dots[j], norms[j] = 0.0, sum((x * weight(v)) ** 2 for v, x in self.counts[j].items())
                dots[j] += k * m * own * own
                norms[j] += m * m * (own * own - weight(w) * weight(w))
        return {j: round(d / math.sqrt(size * norms[j]), 12) for j, d in dots.items()}

    def best(self, query: str, most: int) -> list[tuple[int, float]]:
        """The most similar documents, ties to the earlier one; those that share no word follow in order."""
        got = self.scores(query)
        first = heapq.nsmallest(most, ((-s, j) for j, s in got.items() if s > 0))
        out = [(j, -s) for s, j in first]
        rest = (j for j in range(len(self.counts)) if got.get(j, 0.0) <= 0)
        return [*out, *((j, 0.0) for j in itertools.islice(rest, most - len(out)))]


def weighed(documents: list[str]) -> Callable[[str], list[float]]:
    """Similarities of a query with all of some documents."""
    index = Index()
    for d in documents:
        index.add(d)

    def scores(query: str) -> list[float]:
        found = index.scores(query)
        return [found.get(j, 0.0) for j in range(len(documents))]

    return scores


EVIDENCE = T.ArrayType(struct("claim_no int, claim string, evidence array<string>, similarity array<double>"))


def _evidence(claim_list: Sequence[str], index: Index, chunks: list[str]) -> list[dict]:
    """The ``DEEP`` most similar chunks of every claim."""
    rows = []
    for i, claim in enumerate(claim_list):
        best = index.best(claim, DEEP)
        rows.append({"claim_no": i, "claim": claim, "evidence": [chunks[j] for j, _ in best], "similarity": [round(min(1.0, s), 6) for _, s in best]})
    return rows


def _indexed(sentence_list: Sequence[str], index: Index, chunks: list[str]) -> None:
    for sentence in sentence_list:
        for chunk in repack(sentence):
            chunks.append(chunk)
            index.add(chunk)


@F.pandas_udf(EVIDENCE)
def evidence_udf(claim_lists: pd.Series, chunk_lists: pd.Series) -> pd.Series:
    """Evidence of a row's claims in the row's own context."""
    out = []
    for claim_list, chunk_list in zip(claim_lists, chunk_lists, strict=True):
        claim_list = claim_list if claim_list is not None else ()
        index, chunks = Index(), []
        _indexed(chunk_list if chunk_list is not None and len(claim_list) else (), index, chunks)
        out.append(_evidence(claim_list, index, chunks))
    return pd.Series(out)


#: What ``turn_evidence`` gives for each assistant turn.
TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("found", EVIDENCE), T.StructField("has_context", T.BooleanType())])


def turn_evidence(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, found, has_context): evidence of every assistant turn's claims in the turns before it.

    A conversation is read once, in order, and its chunks are kept as an index that grows by each turn, so a turn carries
    no earlier text and nothing is counted twice. A conversation's index is in one task's memory; one conversation at a time.
    Null texts say nothing. Turns of one number are taken in order of role and text.
    """
    asks = F.col("role") == "assistant"
    rows = conversations.select("conv_id", "turn", "role", "text", F.when(asks, claims(F.col("text"))).alias("asked"), sentences(F.col("text")).alias("said"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", asks.alias("asks"), "asked", "said")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index, chunks = object(), Index(), []
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.conv_id != last:
                    last, index, chunks = r.conv_id, Index(), []
                if r.asks:
                    out.append((r.conv_id, r.turn, _evidence(r.asked, index, chunks), bool(chunks)))
                _indexed(r.said, index, chunks)
            yield pd.DataFrame(out, columns=TURN.names)

    return ordered.filter("conv_id IS NOT NULL").mapInPandas(run, TURN)


def text_criticality(text: Column, possible: Sequence[Column] = ()) -> Column:
    """What a text asserts: money or a big number, an action, an entity. ``possible`` says which of the three it may hold."""
    some, act, named = possible or (F.lit(True),) * 3
    money = F.when(some & (text.rlike(L.MONEY) | text.rlike(L.BIG_NUMBER)), 0.55).otherwise(0.0)
    verb = F.when(act & F.lower(text).rlike(r"\b(?:" + "|".join(L.ACTION_VERBS) + ")"), 0.35).otherwise(0.0)
    return F.least(F.lit(1.0), money + verb + F.when(named & text.rlike(L.ENTITY), 0.20).otherwise(0.0))


def _possible(text: Column) -> list[Column]:
    """Which of the three things that ``text_criticality`` looks for any sentence of a text may hold."""
    text, low = F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit("")))
    holds = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return [text.rlike(L.MONEY) | text.rlike(L.BIG_NUMBER), holds(L.ACTION_VERBS), holds(L.ENTITIES)]


def _stakes(claim_list: Column, possible: Sequence[Column]) -> Column:
    """``text_criticality`` of every claim of a text."""
    each = F.transform(claim_list, lambda c: text_criticality(c, possible))
    return F.when(reduce(lambda a, b: a | b, possible), each).otherwise(F.array_repeat(F.lit(0.0), F.size(claim_list)))


def _judged(rows: DataFrame, keep: list[str], response: str, context: str, depths: Sequence[int]) -> DataFrame:
    """One row for each claim, and one with a null claim for a response without any; ``similarity1``, ``status1`` and so on
    for each depth. No shuffle: a claim carries its evidence, and all depths share one pass."""
    return _verdicts(rows.select(*keep, F.inline_outer(evidence_udf(claims(F.col(response)), sentences(F.col(context))))), keep, depths)


def _verdicts(found: DataFrame, keep: list[str], depths: Sequence[int]) -> DataFrame:
    """``_judged`` from claims that have their evidence."""
    most = max(depths)
    piece = lambda i: F.get("evidence", F.lit(i))
    found = found.withColumns({"ht": tokens(F.coalesce("claim", F.lit(""))), **{f"pt{i}": tokens(F.coalesce(piece(i), F.lit(""))) for i in range(most)}})
    # in steps, so that nothing is worked out twice: content words and numbers of each text, then how they meet, then the rules
    texts = ["ht", *(f"pt{i}" for i in range(most))]
    found = found.withColumns({f"{n}_{t}": f(F.col(t)) for t in texts for n, f in (("w", content), ("neg", _negated), ("num", lambda x: _numbers(x, 3)))})
    asked, hn = F.col("w_ht"), F.col("num_ht")
    found = found.withColumns({k: c for i in range(most) for k, c in {
        f"cover{i}": _cover(F.col(f"w_pt{i}"), asked), f"negation{i}": F.col(f"neg_pt{i}") != F.col("neg_ht"), f"numeric{i}": _clash(F.col(f"num_pt{i}"), hn)}.items()})
    verdicts = [_ruled(F.col(f"cover{i}"), F.size(asked) == 0, F.col(f"negation{i}"), F.col(f"numeric{i}")) for i in range(most)]
    found = found.withColumns({f"{n}{i}": c for i, pair in enumerate(verdicts) for n, c in zip(("label", "conf"), pair, strict=True)})
    best = F.get("similarity", F.lit(0))  # the first is the most similar, at any depth
    found = found.withColumn("best", best).withColumn("retrieved", F.coalesce(F.col("best") >= RETRIEVAL, F.lit(False)))
    gate = F.greatest(F.lit(RETRIEVAL), 0.6 * F.col("best"))
    found = found.withColumns({f"in{i}": F.coalesce(F.col("retrieved") & (F.get("similarity", F.lit(i)) >= gate), F.lit(False)) for i in range(most)})

    def pick(depth: int, label: str | None = None, least: float = 0.0) -> Column:
        """Highest confidence of the evidence in question with this label."""
        is_ = lambda i: F.col(f"in{i}") if label is None else F.col(f"in{i}") & (F.col(f"label{i}") == label) & (F.col(f"conf{i}") >= least)
        return F.array_max(F.array(*(F.when(is_(i), F.col(f"conf{i}")) for i in range(depth))))

    found = found.withColumns({f"{n}{d}": c for d in depths for n, c in (("c", pick(d, "CONTRADICTION", CONTRADICT)), ("e", pick(d, "ENTAILMENT", ENTAIL)), ("f", pick(d)))})
    there = F.when(F.col("retrieved"), 1.0).when(F.size("evidence") > 0, 0.3).otherwise(0.0)
    status = lambda d: F.when(F.col(f"c{d}").isNotNull(), "CONTRADICTED").when(F.col(f"e{d}").isNotNull(), "SUPPORTED").when(F.col("retrieved"), "NEUTRAL").otherwise("NO_EVIDENCE")
    sure = lambda d: F.when(F.col("retrieved"), F.coalesce(f"c{d}", f"e{d}", f"f{d}", F.lit(0.0)))
    out = found.select(*keep, "claim_no", "claim", F.coalesce("best", F.lit(0.0)).alias("similarity"), there.alias("there"), text_criticality(F.col("claim")).alias("text_criticality"),
        *(c for d in depths for c in (status(d).alias(f"status{d}"), sure(d).alias(f"nli_confidence{d}"))))
    nli = lambda d: F.coalesce(f"nli_confidence{d}", F.lit(0.0))
    out = out.withColumns({f"evidence_strength{d}": r4(F.least(F.lit(1.0), 0.4 * F.col("similarity") + 0.4 * nli(d) + 0.2 * F.col("there"))) for d in depths})

    def risk(d: int) -> Column:
        at = F.col(f"status{d}")
        return (
            F.when(at == "CONTRADICTED", (0.55 + 0.30 * nli(d)) * (0.75 + 0.25 * F.least(F.lit(1.0), F.col("similarity") / 0.6)))
            .when(at == "SUPPORTED", 0.08 * (1 - 0.9 * F.least(F.lit(1.0), (F.col("similarity") + nli(d)) / 1.6)))
            .when(at == "NEUTRAL", 0.42 * (0.6 + 0.4 * (1 - F.col(f"evidence_strength{d}")))).otherwise(0.50)
        )

    return out.withColumns({f"claim_risk{d}": r4(F.least(F.lit(1.0), risk(d))) for d in depths})


def claim_results(rows: DataFrame, key: list[str], response: str, context: str, depth: int = DEEP) -> DataFrame:
    """One row for each claim: best similarity, verdict, evidence strength, risk."""
    own = [F.col(f"{n}{depth}").alias(n) for n in ("status", "nli_confidence", "evidence_strength", "claim_risk")]
    return _judged(rows, key, response, context, [depth]).filter("claim IS NOT NULL").select(*key, "claim_no", "claim", "similarity", *own, "text_criticality")


def claim_results_in_order(conversations: DataFrame, depth: int = DEEP) -> DataFrame:
    """``claim_results`` of all assistant turns of conversations, by ``turn_evidence``."""
    key = ["conv_id", "turn"]
    own = [F.col(f"{n}{depth}").alias(n) for n in ("status", "nli_confidence", "evidence_strength", "claim_risk")]
    found = turn_evidence(conversations).select(*key, F.inline("found"))
    return _verdicts(found, key, [depth]).select(*key, "claim_no", "claim", "similarity", *own, "text_criticality")


def graded(rows: DataFrame, key: list[str], response: str, context: str, depths: Sequence[int] = (DEEP,), keep: Sequence[str] = ()) -> DataFrame:
    """One row for each response (``key`` names one): number of claims, highest text criticality (null without claims), and for
    every depth counts, status, grounding score, risk, confidence, quality of evidence and share of neutral claims.
    ``keep`` are further columns to carry.

    One shuffle of sums; a response's claims are folded where it is read. Responses without claims have risk 0.10.
    """
    may = {f"_may{i}": c for i, c in enumerate(_possible(F.col(response)))}
    lists = rows.select(*key, *keep, claims(F.col(response)).alias("_claims"), sentences(F.col(context)).alias("_chunks"), *(c.alias(n) for n, c in may.items()))
    asked = F.when(F.size("_chunks") > 0, F.col("_claims"))  # where there is no evidence, stakes say all
    lists = lists.select(*key, *keep, "_chunks", asked.alias("_asked"), _stakes(F.col("_claims"), [*map(F.col, may)]).alias("_stakes"))
    found = lists.select(*key, *keep, _folder(tuple(depths))("_asked", "_stakes", "_chunks").alias("_f")).select(*key, *keep, "_f.*")
    total = lambda c: F.sum(c).alias(c)
    sums = [total(f"{n}{d}") for d in depths for n in ("supported", "contradicted", "neutral", "strength", "risk", "nli")]
    agg = found.groupBy(*key).agg(total("claims"), F.max("critical").alias("max_text_criticality"), *(F.first(k).alias(k) for k in keep), total("weight"), *sums)
    seen = lambda d: F.col(f"supported{d}") + F.col(f"contradicted{d}")
    means = {f"{n}{d}": F.try_divide(F.col(x), y) for d in depths for n, x, y in (
        ("quality", f"strength{d}", F.col("claims")), ("mean", f"risk{d}", F.col("weight")), ("nli", f"nli{d}", seen(d)))}
    return agg.withColumns(means).select(*key, "claims", "max_text_criticality", *keep, *(c for d in depths for c in _grade(d)))


def _folder(depths: tuple[int, ...]) -> Callable[..., Column]:
    """``verdicts.folded`` as an Arrow function of claims, stakes and sentences of the context."""
    long = [x for d in depths for x in (f"supported{d}", f"contradicted{d}", f"neutral{d}")]
    double = ["critical", "weight", *(f"{n}{d}" for d in depths for n in ("strength", "risk", "nli"))]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("claims", *long)] + [T.StructField(n, T.DoubleType()) for n in double])

    @F.arrow_udf(schema)
    def fold(asked: pa.Array, stakes: pa.Array, said: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, max(1, len(said)), ROWS):
            claim_lists, stake_lists, sentence_lists = (x.slice(at, ROWS).to_pylist() for x in (asked, stakes, said))
            out = folded([c or () for c in claim_lists], stake_lists, [[c for s in x for c in repack(s)] for x in sentence_lists], depths)
            parts.append(pa.StructArray.from_arrays([pa.array(out[f.name], from_pandas=True) for f in schema], [f.name for f in schema]))
        return pa.concat_arrays(parts)

    return fold


def _grade(d: int) -> list[Column]:
    n, s, c, quality, mean = F.col("claims"), F.col(f"supported{d}"), F.col(f"contradicted{d}"), F.col(f"quality{d}"), F.col(f"mean{d}")
    seen = s + c
    ceiling = F.when(c > 0, F.greatest(F.lit(0.30), 0.70 - 0.10 * (c - 1))).otherwise(1.0)
    status = F.when(n == 0, "UNVERIFIED").when((c > 0) & (s == 0), "CONTRADICTED").when(c > 0, "PARTIALLY_SUPPORTED").when(s == n, "SUPPORTED").when(s > 0, "PARTIALLY_SUPPORTED").otherwise("UNVERIFIED")
    risk = F.when(n == 0, 0.10).when(c > 0, F.greatest(mean, F.least(F.lit(0.97), 0.62 + 0.12 * c))).when(s == n, mean).otherwise(F.greatest(mean, F.lit(0.05)))
    sure = F.when(n == 0, 0.55).when(seen == 0, 0.40 + 0.20 * quality).otherwise(F.least(F.lit(0.9), 0.35 + 0.25 * seen / n + 0.20 * F.col(f"nli{d}") + 0.20 * quality))
    return [
        s.alias(f"supported{d}"), c.alias(f"contradicted{d}"), status.alias(f"status{d}"), r4(F.when(seen > 0, F.least(s / seen, ceiling))).alias(f"grounding_score{d}"), r4(risk).alias(f"performance_risk{d}"),
        r4(sure).alias(f"confidence{d}"), r4(F.coalesce(quality, F.lit(0.0))).alias(f"evidence_quality{d}"), F.when(n > 0, F.col(f"neutral{d}") / n).otherwise(0.0).alias(f"neutral_rate{d}"),
    ]


def responses(rows: DataFrame, key: list[str], response: str, context: str, depth: int = DEEP) -> DataFrame:
    """One row for each response: status, grounding score, risk and confidence."""
    own = [F.col(f"{n}{depth}").alias(n) for n in ("supported", "contradicted", "status", "grounding_score", "performance_risk", "confidence")]
    return graded(rows, key, response, context, [depth]).select(*key, "claims", *own)


def turns(conversations: DataFrame) -> DataFrame:
    """Adapter: assistant turns with the turn before as prompt and all earlier turns as context."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    earlier = F.collect_list("text").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spread(conversations.select("conv_id", "turn", "role", "text"), "conv_id").withColumn("prompt", F.lag("text").over(order)).withColumn("context", F.array_join(earlier, "\n"))
    return rows.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("prompt", F.lit("")).alias("prompt"), "context", F.col("text").alias("response"))


def evidence_table(rows: DataFrame, key: list[str], response: str, context: str, findings: str, redacted: Callable[[Column, Column], Column]) -> DataFrame:
    """One row for each claim with its most similar evidence; no evidence where there is no context.

    ``redacted`` hides in a text what the row's ``findings`` tell to hide: a row's findings serve all its texts.
    """
    found = rows.select(*key, findings, F.inline(evidence_udf(claims(F.col(response)), sentences(F.col(context)))))
    first = lambda c: F.get(c, F.lit(0))
    hidden = lambda c: redacted(c, F.col(findings))
    return found.select(*key, "claim_no", hidden(F.col("claim")).alias("claim"), hidden(F.coalesce(first("evidence"), F.lit(""))).alias("evidence"), F.coalesce(first("similarity"), F.lit(0.0)).alias("similarity"))
