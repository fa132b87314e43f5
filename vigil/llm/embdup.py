"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more lie within the squared distance 2 - 2c. A fixed random rotation spreads that distance
over the coordinates, which are cut into low-dimensional blocks; each block has a share of the budget in proportion to
its dimensions. A pair within the whole budget is within the share of some block (pigeonhole). Each block is joined by
range on a grid over its first coordinates: a vector is at home in one cell and looks into those that its ball touches.
Pairs of a cell that are within the block's budget are verified in double precision on the whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import saved
from vigil.llm.components import connected_components
from vigil.llm.topk import usable

#: Coordinates of a block, most of them that make the grid, and cell sides as multiples of a block's radius.
BLOCK, GRID, SIDE = 8, 5, 3.0
#: Vectors of a bucket of a cell, about (a task compares two at most), and rows compared at a time.
HOME, STEP = 4096, 512
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(width: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def blocks(width: int, size: int = BLOCK) -> list[slice]:
    return [slice(at, min(at + size, width)) for at in range(0, width, size)]


def _turned(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(vectors.shape[1])


def touched(turned: np.ndarray, block: slice, width: int, budget: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row positions, cells, whether at home) of the cells that each row's ball touches in a block."""
    radius = math.sqrt(budget * (block.stop - block.start) / width) * (1 + 1e-6)
    side = SIDE * radius
    part = turned[:, block][:, :grid] / side
    cell = np.floor(part)
    inside = part - cell
    for step in product((0, -1, 1), repeat=part.shape[1]):
        move = np.array(step, dtype=float)
        away = np.where(move < 0, inside, np.where(move > 0, 1 - inside, 0.0))
        rows = np.flatnonzero((away**2).sum(axis=1) <= (1 / SIDE) ** 2 * (1 + 1e-6))
        yield rows, (cell[rows] + move).astype(np.int64), not any(step)


def _cells(vectors: np.ndarray, budget: float, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row positions, blocks, cell names and home flags of all vectors of one width."""
    width, turned, out = vectors.shape[1], _turned(vectors), []
    for b, block in enumerate(blocks(width)):
        for rows, cell, home in touched(turned, block, width, budget, grid):
            name = np.full(len(rows), b, dtype=np.int64)
            for column in cell.T:
                name = name * 2097143 + column  # cells of a block that share a name are merely compared in vain
            out.append((rows, np.full(len(rows), b), name, np.full(len(rows), home)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def compare(vectors: np.ndarray, weights: np.ndarray, home: np.ndarray, b: int, cosine: float, budget: float, inside: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the rows at home in one cell: (first, second, weight of second), each pair in its first block only.

    With ``inside`` home rows meet all rows, else only those not at home.
    """
    width, unit = vectors.shape[1], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned, parts = _turned(vectors), blocks(width)
    limits = np.array([budget * (p.stop - p.start) / width for p in parts]) * (1 + SLACK) + SLACK
    block = turned[:, parts[b]].astype(np.float32)
    half = (block**2).sum(axis=1) / 2
    right = np.concatenate([block, -half[:, None], -np.ones((len(block), 1), np.float32)], axis=1)
    left = np.concatenate([block, np.ones((len(block), 1), np.float32), half[:, None]], axis=1)
    own, first, second = np.flatnonzero(home), [], []
    others = np.arange(len(home)) if inside else np.flatnonzero(~home)
    right = right[others]
    for at in range(0, len(own), STEP):
        some = own[at : at + STEP]
        i, j = np.nonzero(left[some] @ right.T >= -limits[b] / 2 - 1e-5)
        i, j = some[i], others[j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = (x != y) & (np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine)
            x, y = x[near], y[near]
            spread = (turned[x] - turned[y]) ** 2
            within = np.stack([spread[:, p].sum(axis=1) for p in parts], axis=1) <= limits
            here = within.argmax(axis=1) == b
            first.append(x[here])
            second.append(y[here])
    x, y = np.concatenate([*first, np.zeros(0, int)]), np.concatenate([*second, np.zeros(0, int)])
    return x.astype(int), y.astype(int), weights[y.astype(int)]


def _stars(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the least row that it reaches by the links x-y, within one cell."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, x, before[y])
        np.minimum.at(root, y, before[x])
        root = root[root]
        if np.array_equal(root, before):
            return root


def dealt_to_buckets(dealt: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of cells (label, b, cell, node, home, ...) with ``i`` and ``j``: groups by these hold two buckets at most.

    ``full`` has the number of ``parts`` of cells that are split; rows of a cell of no parts are dropped. A row is in the bucket of its node's hash. In group
    (i, j) the home rows of bucket i meet all rows of bucket j, home or not; the latter are not at home there unless
    i = j. So every home row meets every other row of its cell once.
    """
    split = dealt.join(full, ["label", "b", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).filter("parts > 0")
    split = split.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    others = F.filter(every, lambda x: x != F.col("own"))
    place = lambda i, j, home: F.struct(i.alias("i"), j.alias("j"), home.alias("home"))
    as_home = F.transform(F.filter(others, lambda x: F.col("home")), lambda x: place(F.col("own"), x, F.lit(True)))
    as_other = F.transform(others, lambda x: place(x, F.col("own"), F.lit(False)))
    placed = split.withColumn("at", F.explode(F.concat(F.array(place(F.col("own"), F.col("own"), F.col("home"))), as_home, as_other)))
    return placed.drop("home", "own", "parts").select("*", "at.*").drop("at")


def linked(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Only rows with an id, a label and a usable vector that is not zero link, and only within a label and a vector
    length. Equal vectors are compared once and counted as often as they occur. A row without links is its own
    component; one without an id has none and is not kept. Each row of a cell gives one count and one star edge, so
    pairs are never written out.
    """
    budget = max(0.0, 2 - 2 * cosine) + SLACK
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    nonzero = F.exists("v", lambda x: x != 0)
    good = rows.filter(fit).filter(nonzero).withColumn("label", F.struct("label", F.size("v").alias("width")))
    kinds = saved(good.groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("v", F.col("v").cast("array<double>")), "vectors")
    largest = kinds.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = max(1, min(GRID, math.ceil(math.log(max(1, largest) / HOME) / math.log(1 / 0.6)) if largest > HOME else 1))

    def deal(batches: Iterator[pa.RecordBatch], counts: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            widths = np.asarray(pa.compute.list_value_length(batch.column("v")))
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                part = batch.take(pa.array(at))
                x = np.asarray(part.column("v").flatten()).reshape(len(at), width)
                row, b, name, home = _cells(x, budget, grid)
                dealt = part.take(pa.array(row))
                extra = {"b": pa.array(b.astype(np.int32)), "cell": pa.array(name), "home": pa.array(home)}
                columns = {"label": dealt.column("label")} if counts else {n: dealt.column(n) for n in ("label", "v", "node", "copies")}
                yield pa.RecordBatch.from_pydict(columns | extra)

    label = kinds.schema["label"].dataType.simpleString()
    dealt = kinds.mapInArrow(lambda it: deal(it, False), f"label {label}, v array<double>, node long, copies long, b int, cell long, home boolean")
    homes = kinds.select("label", "v").mapInArrow(lambda it: deal(it, True), f"label {label}, b int, cell long, home boolean")
    sizes = homes.groupBy("label", "b", "cell").agg(F.count(F.lit(1)).alias("count"), F.count_if("home").alias("at_home"))
    parts = F.when(F.col("at_home") > 0, F.ceil(F.col("count") / HOME)).otherwise(0).cast("int")  # visitors alone never meet
    full = sizes.filter(F.col("count") > HOME).select("label", "b", "cell", parts.alias("parts"))
    split = dealt_to_buckets(dealt, full)

    def links(cell: pd.DataFrame) -> pd.DataFrame:
        if len(cell) < 2 or not cell["home"].any():
            return pd.DataFrame({"node": [], "root": [], "links": []}, dtype="int64")
        node = cell["node"].to_numpy(dtype=np.int64)
        x, y, w = compare(np.stack(cell["v"]).astype(float), cell["copies"].to_numpy(dtype=np.int64), cell["home"].to_numpy(dtype=bool), int(cell["b"].iloc[0]), cosine, budget, bool(cell["i"].iloc[0] == cell["j"].iloc[0]))
        n = np.zeros(len(cell), dtype=np.int64)
        np.add.at(n, x, w)
        hit = np.unique(np.concatenate([x, y]))
        return pd.DataFrame({"node": node[hit], "root": node[_stars(len(cell), x, y)[hit]], "links": n[hit]})

    found = saved(split.groupBy("label", "b", "cell", "i", "j").applyInPandas(links, "node long, root long, links long"), "cells")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "node", "root").withColumnRenamed("node", "n")
    named = kinds.join(counts, "node", "left").join(roots, F.col("node") == F.col("n"), "left")
    named = named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    keyed = rows.withColumn("label", F.when(fit & nonzero, F.struct("label", F.size("v").alias("width")))).withColumn("v", F.when(F.col("label").isNotNull(), F.col("v").cast("array<double>")))
    out = keyed.join(named, ["label", "v"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
