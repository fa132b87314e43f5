"""Toxicity classifier with a counterfactual penalty.

A logistic model over counts of words is fitted to labelled documents. Labelled texts that mention an identity
term get copies with another term of its group in its place; a difference in score between a text and its copy is
penalised, and so is that to a copy without the term, so that a group's name weighs nothing by itself. The fit happens on a bounded, documented sample of labelled
rows; words are counted and texts are scored on Spark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.7
#: Labelled rows the model is fitted to, at most.
SAMPLE = 16_000
#: Words of the model, at most, and the documents a word must be in.
WORDS, LEAST = 512, 5
#: Penalty on weights, and on score differences between a text and its counterfactual copies.
RIDGE, SWAP = 0.01, 10.0
#: Where the classes stand apart, the threshold lies midway between them, this part of either left aside.
TAIL = 0.01
#: Occurrences of a word that count, at most.
TIMES = 3
#: A word in fewer documents than this part of the toxic ones is held back more: copies of one text share rare words.
SUPPORT = 0.2
#: Identity terms by group; terms of a group are swapped with each other.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("disabled", "deaf", "blind"),
    ("immigrants", "refugees", "foreigners", "natives"), ("old", "young"), ("african", "american", "european", "mexican", "chinese", "indian"),
)


def counted(text: str | None, words: Container[str]) -> list[tuple[str, int]]:
    """Those of ``words`` that the text holds, with how often, up to ``TIMES``, in order of the words."""
    return sorted((w, min(n, TIMES)) for w, n in Counter(WORD.findall((text or "").lower())).items() if w in words)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[w] * n for w, n in counted(text, self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _partners(groups: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    return {t: tuple(o for o in g if o != t) for g in groups for t in g}


def count_words(labelled: DataFrame) -> DataFrame:
    """(word, clean, toxic): the labelled documents each word is in. Counts are summed per batch before they move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[toxic].update(set(WORD.findall((text.as_py() or "").lower())))
            words = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in n)], names=["word", "clean", "toxic"])

    counted = labelled.select("text", "toxic").mapInArrow(count, "word string, clean long, toxic long")
    return counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _newton(x: np.ndarray, labels: np.ndarray, weigh: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Minimum of the penalised, weighted log-loss."""
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(weigh * (np.logaddexp(0, z) - labels * z)) + v @ penalty @ v / 2)

    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weigh * (p - labels)) + penalty @ w
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), grad)
        rate = 1.0
        while loss(w - rate * step) > now and rate > 1e-4:
            rate /= 2
        w, before = w - rate * step, now
        now = loss(w)
        if before - now < 1e-7 * max(1.0, before):
            break
    return w


def _fit(rows: list[list[tuple[int, int]]], labels: np.ndarray, swaps: np.ndarray, n_words: int, ridge: float, swap: float) -> np.ndarray:
    """Weights and bias (last). Words may only speak for toxicity, so short and empty texts score low.

    Both classes weigh alike, up to tenfold. Words with a negative weight leave and the rest is fitted again.
    """
    x = np.zeros((len(rows), n_words + 1))
    for i, r in enumerate(rows):
        for j, times in r:
            x[i, j] = times
    seen = np.maximum((x[:, :-1] > 0).sum(axis=0), 1)
    weigh = np.where(labels > 0, min(10.0, max(1.0, (labels == 0).sum() / max(1, labels.sum()))), 1.0)
    held = np.maximum(1, SUPPORT * labels.sum() / seen) ** 2
    x[:, -1] = 1
    penalty = np.diag([*(ridge * 2 * held), 1e-6]) + swap * 2 * swaps.T @ swaps / max(1, len(swaps))
    open_, w = np.arange(n_words + 1), np.zeros(n_words + 1)
    for _ in range(20):
        part = _newton(x[:, open_], labels, weigh, penalty[np.ix_(open_, open_)])
        w[:] = 0
        w[open_] = part
        good = (part >= 0) | (open_ == n_words)
        if good.all():
            break
        open_ = open_[good]
    w[:-1] = np.maximum(w[:-1], 0)
    if labels.min() == labels.max():
        return w
    clean, toxic = np.quantile((x @ w)[labels == 0], 1 - TAIL), np.quantile((x @ w)[labels > 0], TAIL)
    if toxic > clean:
        w[-1] += math.log(THRESHOLD / (1 - THRESHOLD)) - (clean + toxic) / 2
    return w


def _without_words(toxic: int, n: int) -> Model:
    share = min(max(toxic / n if n else 0.0, 1e-4), 0.5)
    return Model(math.log(share / (1 - share)), {})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, identity: tuple[tuple[str, ...], ...] = IDENTITY, ridge: float = RIDGE, swap: float = SWAP) -> Model:
    """Fit the model to labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    At most about ``sample`` labelled documents are used, those with the least hash of their id. A document with several
    labels counts as toxic if one says so; labels that are null do not count. Without labelled documents of both kinds
    nothing tells them apart: the model has no words and gives every text the share of toxic labels, a half at most.
    """
    usable = labels.filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    usable = usable.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    n, n_toxic = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return _without_words(n_toxic, n)
    part = min(1.0, sample / n)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000)).limit(sample + sample // 5)
    labelled = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    total = F.greatest(F.col("clean") + F.col("toxic"), F.lit(1))
    share = n_toxic / n
    surprise = F.abs(F.col("toxic") - total * share) / F.sqrt(total * (share * (1 - share)))
    best = count_words(labelled).filter(F.col("clean") + F.col("toxic") >= LEAST).orderBy(F.desc(surprise), "word").limit(words).select("word")
    partner = _partners(identity)
    vocabulary = sorted({r["word"] for r in best.collect()} | partner.keys())
    place = {w: i for i, w in enumerate(vocabulary)}

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counted(t, place) for t in batch["text"]]
            yield pd.DataFrame({"words": [[place[w] for w, _ in f] for f in found], "times": [[n for _, n in f] for f in found], "toxic": batch["toxic"]})

    rows = labelled.select("text", "toxic").mapInPandas(index, "words array<int>, times array<int>, toxic int").collect()
    if len({r["toxic"] for r in rows}) < 2:  # labels of documents that are not there, or without text
        return _without_words(sum(r["toxic"] for r in rows), len(rows))
    difference: Counter = Counter()
    for r in rows:
        held = set(r["words"])
        for i in held:
            for other in partner.get(vocabulary[i], ()):
                if (j := place[other]) not in held:
                    difference[min(i, j), max(i, j)] += 1
            if vocabulary[i] in partner:
                difference[i, i] += 1  # the copy without the term
    swaps = np.zeros((max(1, len(difference)), len(vocabulary) + 1))
    for k, ((i, j), times) in enumerate(difference.items()):
        swaps[k, j] = -math.sqrt(times)
        swaps[k, i] = math.sqrt(times)
    w = _fit([list(zip(r["words"], r["times"], strict=True)) for r in rows], np.array([r["toxic"] for r in rows], dtype=float), swaps, len(vocabulary), ridge, swap)
    return Model(float(w[-1]), {t: float(w[i]) for t, i in place.items() if abs(w[i]) > 1e-6})


def score_column(model: Model, text: Column) -> Column:
    """Score of every whole text, 0 to 1; null and empty texts score by the bias alone."""

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return scored(text)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; repeated rows and null ids stay."""
    model = train(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = docs.select("doc_id", held.alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents whose score is under ``threshold``, with their own columns."""
    name = "_score" + "_" * max((len(c) for c in docs.columns), default=0)
    return docs.withColumn(name, score_column(train(docs, labels), F.col("text"))).filter(F.col(name) < threshold).drop(name)
