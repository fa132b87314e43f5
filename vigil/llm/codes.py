"""Vectors as short codes: a codebook for each part of a vector, and Orchard's search for the nearest entry.

Components are whole numbers, so every distance, mean and error is exact. Codebooks are small (parts x entries), so
they travel with the tasks; vectors are only read, in passes that send back sums of the batches.

Orchard's search keeps, for every entry, the list of all other entries by distance from it. A vector starts at some
entry and walks down its list; where it meets a nearer entry it goes on in that entry's list. Entries met before are
marked and passed over. Once the list is beyond twice the vector's current distance, the triangle inequality leaves no
entry that is nearer or as near.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import saved, skew_join
from vigil.llm.topk import usable

#: Parts of a vector, entries of a codebook, rounds of assignment and replacement.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors searched at a time.
STEP = 4096
LARGEST = (1 << 63) - 1


def whole(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), x as double; those beyond a long's range become its ends."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(9.3e18)), F.lit(-9.3e18))))


def _kind(*arrays: np.ndarray) -> type:
    """A type that holds all squared distances of the components, and four times them, exactly."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    width = max(a.shape[-1] for a in arrays)
    return np.int64 if 16 * most * most * max(width, 1) < LARGEST else object


class Codebooks:
    """``entries`` has, by part, the entries of the codebook as rows of whole numbers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        parts, size, _ = entries.shape
        own = entries.astype(_kind(entries))
        apart = ((own[:, :, None, :] - own[:, None, :, :]) ** 2).sum(axis=3)
        self.lists = np.argsort(apart, axis=2, kind="stable").astype(np.int32)
        self.apart = np.take_along_axis(apart, self.lists.astype(np.int64), axis=2)
        # where to begin: entries by the sum of their components, which is a bound of the distance as well
        sums = own.sum(axis=2)
        self.by_sum = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.by_sum, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of every vector; of entries as near, the first.

        ``x`` is vectors x parts x components. All vectors walk at once, each down its own list.
        """
        n, parts, width = x.shape
        size, kind = self.entries.shape[1], _kind(x, self.entries)
        q, entries, apart = x.astype(kind).reshape(n * parts, width), self.entries.astype(kind), self.apart.astype(kind)
        part = np.tile(np.arange(parts), n)
        at = np.empty(n * parts, np.int64)
        total = q.sum(axis=1).reshape(n, parts)
        for p in range(parts):
            at[p::parts] = self.by_sum[p, np.minimum(np.searchsorted(self.sums[p], total[:, p]), size - 1)]
        away = ((q - entries[part, at]) ** 2).sum(axis=1)
        marked = np.zeros((n * parts, size), bool)
        marked[np.arange(n * parts), at] = True
        place = np.zeros(n * parts, np.int64)
        walking = np.arange(n * parts)
        while walking.size:
            p, here, k = part[walking], at[walking], place[walking]
            on = (apart[p, here, k] <= 4 * away[walking]).astype(bool)
            walking, p, here, k = walking[on], p[on], here[on], k[on]
            met = self.lists[p, here, k]
            place[walking] += 1
            new = ~marked[walking, met]
            rows, p, met = walking[new], p[new], met[new]
            marked[rows, met] = True
            d = ((q[rows] - entries[p, met]) ** 2).sum(axis=1)
            nearer = ((d < away[rows]) | ((d == away[rows]) & (met < at[rows]))).astype(bool)
            moved = rows[nearer]
            at[moved], away[moved], place[moved] = met[nearer], d[nearer], 0
            walking = walking[place[walking] < size]
        return at.reshape(n, parts), away.reshape(n, parts)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.entries.ravel()).encode()).hexdigest()


def _cut(vectors: pd.Series, parts: int, width: int) -> np.ndarray:
    """Vectors x parts x components; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), parts * width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out.reshape(len(vectors), parts, width)


def _replaced(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floored mean of the parts nearest to it. Tasks send a sum for each component of an entry."""
    parts, size, width = books.entries.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, count = np.zeros(parts * size * width, object), np.zeros(parts * size, np.int64)
        for batch in batches:
            for k in range(0, len(batch), STEP):
                x = _cut(batch["v"].iloc[k : k + STEP], parts, width)
                entry = (books.nearest(x)[0] + np.arange(parts) * size).ravel()
                here = np.zeros((parts * size, width), np.int64 if np.abs(x).max(initial=0) < 1 << 48 else object)
                np.add.at(here, entry, x.reshape(-1, width))
                sums += here.ravel().astype(object)
                count += np.bincount(entry, minlength=parts * size)
        used = np.flatnonzero(np.repeat(count > 0, width))
        yield pd.DataFrame({"slot": used, "total": [Decimal(int(s)) for s in sums[used]], "n": np.repeat(count, width)[used]})

    kind = T.StructType([T.StructField("slot", T.LongType()), T.StructField("total", T.DecimalType(38, 0)), T.StructField("n", T.LongType())])
    found = rows.select("v").mapInPandas(add, kind).groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    entries = books.entries.ravel().copy()
    for slot, total, n in found.collect():  # parts x entries x width of a part, however many vectors there are
        entries[slot] = int(total) // n
    return Codebooks(entries.reshape(books.entries.shape))


def fit(rows: DataFrame, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of rows (id, v): they begin as the parts of the ``size`` rows with the least ids. None without rows.

    Rows of one id are ordered by vector; rows without an id come last. Where there are fewer rows, there are as many
    entries. The longest vector counts, its length filled up to a multiple of ``parts``.
    """
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(size).toPandas()["v"]
    books = Codebooks(_cut(first, parts, max(1, -(-longest // parts))).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = _replaced(rows, books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row with a usable vector.

    Vectors that are null or hold null or non-finite components are left out; repeated rows and rows without an id
    stay. Null labels belong together. Errors beyond a long's range are given as its end.
    """
    if not 1 <= size <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.struct(F.col(label_col).alias("label")).alias("label"), whole(F.col(vector_col)).alias("v"))
    books = fit(rows.select("id", "v"), parts, size, rounds)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = books.entries.shape[2]
        for batch in batches:
            for k in range(0, len(batch), STEP):
                some = batch.iloc[k : k + STEP]
                entry, away = books.nearest(_cut(some["v"], parts, width))
                codes = [bytes(e).hex() for e in entry.astype(np.uint8)]
                yield pd.DataFrame({"id": some["id"], "label": some["label"], "code": codes, "error": [Decimal(int(e)) for e in away.astype(object).sum(axis=1)]})

    label = vectors.schema[label_col].dataType
    kind = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.DecimalType(38, 0))])
    flat = rows.select("id", F.col("label.label").alias("label"), "v")
    coded = saved((flat if books else flat.limit(0)).mapInPandas(code, kind), "codes").withColumn("label", F.struct("label"))
    summed = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "errors")
    long = lambda c: F.least(F.col(c), F.lit(Decimal(LARGEST))).cast("long").alias(c)
    out = skew_join(coded, summed, "label", "n", coded.count())
    return out.select(F.col("id").alias("vec_id"), "code", long("error"), long("label_error"), F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
