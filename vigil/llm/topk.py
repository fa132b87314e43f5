"""Exact top-k search by inner product, pruned by segment means and deviations from coarse to fine.

A vector is cut into segments; of a segment of length n with means p, q and deviations s, t the inner product is at
most n (p q + s t) (equally, the squared distance is at least n ((p - q)^2 + (s - t)^2)). Bounds for one segment, for a
few and for many are ever closer and still cheap. Rows whose bound is under a query's k-th best score so far leave; the
rest get their exact score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of segments, coarse to fine, as parts of the whole vector.
LEVELS = (1, 4, 16)
#: Queries and rows of one block at most, about; rows of a block that are scored at a time.
QUERIES, ROWS, STEP = 4096, 8192, 1024


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Vectors whose inner product bounds that of the rows: scaled means, then scaled deviations, of each segment."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])) if x.shape[1] else []
    out = []
    for p in parts:
        n, s = math.sqrt(len(p)), x[:, p]
        out += [n * s.mean(axis=1), n * s.std(axis=1)]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) triples the k best of each query; ties go to the smaller id."""
    q, ids, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], s[rank < k]


def _search_whole(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search_block`` in Python's whole numbers, query by query, without bounds."""
    whole = lambda m: [[int(c) for c in row] for row in m]
    xs, at, ids, scores = whole(x), [], [], []
    for i, a in enumerate(whole(q)):
        every = ((-sum(c * d for c, d in zip(a, b, strict=True)), int(j)) for j, b in zip(x_ids, xs, strict=True) if j != q_ids[i])
        for s, j in heapq.nsmallest(k, every):
            at.append(i)
            ids.append(j)
            scores.append(-s)
    return np.array(at, dtype=np.int64), np.array(ids, dtype=np.int64), np.array(scores, dtype=object)


def search_block(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, levels: Sequence[int] = LEVELS, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of the k best rows of each query; a row of the query's own id does not count.

    Whole numbers are exact in doubles as long as scores stay under 2^53; beyond, Python's whole numbers are used for
    all scores of the block, so ``score`` then holds objects.
    """
    largest = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * max(q.shape[1], 1)
    if not largest < 2**53:
        return _search_whole(q_ids, q, x_ids, x, k)
    order = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")  # long rows first: they raise the k-th score early
    x_ids, x = x_ids[order], x[order]
    q_stats, x_stats = [statistics(q, n) for n in levels], [statistics(x, n) for n in levels]
    least = np.full(len(q), -np.inf)
    top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for at in range(0, len(x), step):
        rows, asked = np.arange(at, min(at + step, len(x))), np.arange(len(q))
        for qs, xs in zip(q_stats, x_stats, strict=True):
            bound = qs[asked] @ xs[rows].T
            open_ = bound + 1e-9 * np.abs(bound) + 1e-6 >= least[asked][:, None]
            asked, rows = asked[open_.any(axis=1)], rows[open_.any(axis=0)]
            if not len(asked) or not len(rows):
                break
        if not len(asked) or not len(rows):
            continue
        score = q[asked] @ x[rows].T
        score[q_ids[asked][:, None] == x_ids[rows][None, :]] = -np.inf
        if len(rows) > k:  # only what reaches a query's own k-th score can count; ties stay
            least_here = np.maximum(least[asked], -np.partition(-score, k - 1, axis=1)[:, k - 1])
        else:
            least_here = least[asked]
        i, j = np.nonzero((score >= least_here[:, None]) & (score > -np.inf))
        top = _best([top, (asked[i], x_ids[rows[j]], score[i, j])], k)
        full = np.flatnonzero(np.bincount(top[0], minlength=len(q)) >= k)
        least[full] = top[2][np.searchsorted(top[0], full, side="right") - 1]
    return top


def _as_long(score: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond the range become its ends."""
    if score.dtype != object:
        return score.astype(np.int64)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in score], dtype=np.int64)


def usable(vector: Column) -> Column:
    """True where a vector is there and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): of every query the k rows with the highest inner product of whole numbers.

    Every query meets every row, in blocks: queries are dealt to blocks of about ``QUERIES``, rows to blocks of about
    ``ROWS``, and each pair of blocks is one group that keeps k rows of a query. Repeated query ids count once (the
    first row by value); shorter vectors end in zeros; rows without an id or a usable vector take no part. Scores beyond
    a long's range are given, and ranked, as the end of that range.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = vectors.filter(is_query & F.col(id_col).isNotNull() & usable(F.col(vector_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(vector_col).cast("array<double>")).alias("v"))
    n_rows, n_queries = rows.count(), asked.count()
    many_q, many_x = max(1, math.ceil(n_queries / QUERIES)), max(1, math.ceil(n_rows / ROWS))
    dealt_x = rows.withColumn("xb", F.pmod(F.xxhash64("id"), F.lit(many_x))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(many_q - 1))))
    dealt_q = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(many_q)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many_x - 1).cast("long"))))

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        width = max((len(v) for p in (q, x) for v in p["v"]), default=0)
        full = lambda p: np.array([np.pad(v, (0, width - len(v))) for v in p["v"]]).reshape(len(p), width)
        q_ids = q["id"].to_numpy(dtype=np.int64)
        at, ids, score = search_block(q_ids, full(q), x["id"].to_numpy(dtype=np.int64), full(x), k)
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "score": _as_long(score)})

    found = dealt_q.groupBy("qb", "xb").cogroup(dealt_x.groupBy("qb", "xb")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Add ``v``: every component as floor(scale * x), x as double; null where a vector is not usable or leaves the doubles."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    numbers = F.transform(F.col(vector_col), whole)
    return vectors.withColumn("v", F.when(usable(F.col(vector_col)) & F.forall(numbers, lambda x: F.abs(x) < float("inf")), numbers))
