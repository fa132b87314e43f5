"""Column helpers of the report jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r4(c: Column, places: int = 4) -> Column:
    return F.round(c + F.lit(1e-9), places)


def rate(condition: Column) -> Column:
    """Share of rows where the condition holds; null for no rows."""
    return r4(F.avg(condition.cast("double")))


def mean(c: str | Column) -> Column:
    return r4(F.avg(c))


def many(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def one_row(df: DataFrame, *others: DataFrame) -> DataFrame:
    """Side by side, for frames of one row each."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), others, df)


def codes(c: str) -> Column:
    """The names of a comma-joined list; empty for an empty one."""
    return F.filter(F.split(F.col(c), ","), lambda x: x != "")


def band(c: str | Column, table: Sequence[tuple[str, float, float]]) -> Column:
    """Name of the half-open range that holds the value."""
    c = F.col(c) if isinstance(c, str) else c
    return reduce(lambda out, b: F.when((c >= b[1]) & (c < b[2]), b[0]).otherwise(out), table, F.lit(None).cast("string"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys to all shuffle partitions. Adaptive execution merges these by size, which is wrong where little text means much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


NEAR, ACCURACY, SMALL = 4e-4, 10_000, 20_000


def _statistics(df: DataFrame, keys: Sequence[str], values: Sequence[str], at: float, position: Callable[[Column], Column]) -> DataFrame:
    """(keys, _x, _k, _v): for every value column ``_x`` its order statistics next to ``position`` (0-based, of the row count).

    A sketch brackets each position: ``percentile_approx`` is off by at most 1/ACCURACY of the rows, the bracket is NEAR wide
    on either side (a group of up to SMALL rows is its own bracket). Then the rows below the bracket are counted and only
    values inside it are ranked: about a 1000th of a large group's different values. Results are exact. Nulls take no part.
    """
    kept = df.select(*keys, *values)
    ends = [max(0.0, at - NEAR), min(1.0, at + NEAR), 0.0, 1.0]
    sketch = kept.groupBy(*keys).agg(*(f(x).alias(f"_{n}_{x}") for x in values for n, f in (("n", F.count), ("b", lambda x: F.percentile_approx(x, ends, ACCURACY)))))
    sketch = sketch.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    near = kept.join(F.broadcast(sketch), reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.lit(True)))
    end = lambda x, i: F.get(f"_b_{x}", F.when(F.col(f"_n_{x}") > SMALL, i).otherwise(i + 2))
    # a row gives each column's value if it lies in the bracket, and counts below it otherwise
    each = F.array(*(F.struct(F.lit(x).alias("_x"), F.col(f"_n_{x}").alias("_n"), F.when(F.col(x) >= end(x, 0), F.col(x).cast("double")).alias("_v"),
        (F.col(x) <= end(x, 1)).alias("_in")) for x in values))
    counted = near.select(*keys, F.inline(F.filter(each, lambda e: e["_in"]))).groupBy(*keys, "_x", "_n", "_v").agg(F.count(F.lit(1)).alias("_m"))
    running = Window.partitionBy(*keys, "_x").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_m").over(running)).withColumn("_p", position(F.col("_n")))
    low, high = F.floor("_p"), F.ceil("_p")
    pick = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    return ranked.groupBy(*keys, "_x").agg(pick(low).alias("_low"), pick(high).alias("_high"), F.max("_p").alias("_p"))


def percentiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], at: float) -> DataFrame:
    """Exact interpolated percentile of every value column by group, as columns of the same names."""
    found = _statistics(df, keys, values, at, lambda n: (n - 1) * F.lit(at))
    # written as the built-in does it, so that results agree to the last bit
    low, high, p = F.col("_low"), F.col("_high"), F.col("_p")
    value = F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_x") == x, value)).alias(x) for x in values))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, at: float, name: str) -> DataFrame:
    """The element at index round-half-even(at * (n - 1)) of the sorted values of each group."""
    found = _statistics(df, keys, [value], at, lambda n: F.bround((n - 1) * F.lit(at), 0))
    return found.groupBy(*keys).agg(F.max("_low").alias(name))  # a row for an empty table too, where there are no keys


def mode(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value of each group, ties to the first by name."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = Window.partitionBy(*keys).orderBy(F.desc("_n"), value)
    return counted.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*keys, F.col(value).alias(name))


def cut_key(df: DataFrame, index: int, ts: str = "timestamp", key: str = "interaction_id") -> tuple | None:
    """(timestamp, id) of the row at ``index`` in the order of both, without a global sort.

    Rows are counted by hour, then by timestamp within the hour that holds the index, then ranked within one timestamp.
    """
    part, left = df.select(ts, key), index
    for unit in (F.date_trunc("hour", F.col(ts)), F.col(ts)):
        counted = part.withColumn("_u", unit).groupBy("_u").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("_b", before).filter((F.col("_b") <= left) & (F.col("_b") + F.col("_n") > left)).first()
        if found is None:
            return None
        part, left = part.withColumn("_u", unit).filter(F.col("_u") == found["_u"]).drop("_u"), left - found["_b"]
    row = part.orderBy(key).offset(left).limit(1).first()
    return (row[ts], row[key])


def before(cut: tuple | None, ts: str = "timestamp", key: str = "interaction_id") -> Column:
    """Whether a row comes before the cut key."""
    if cut is None:
        return F.lit(False)
    at = F.lit(cut[0])
    return (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < cut[1]))
