"""What several operators share: tables in the shared folder and ranks inside large groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regular expression of a word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys of over this part of all rows are split in joins.
SPLIT = 256
#: Bytes of an Arrow batch inside ``small_batches``. A task and its worker hold a batch several times over.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where a local session names none, a temporary one. A cluster must name one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="vigil-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send workers Arrow batches of ``BATCH_BYTES`` (one row at least); then the session's bound holds again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skew_join(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int, split: int = SPLIT) -> DataFrame:
    """Inner join of ``rows`` with the one row that ``keyed`` has for each ``key``; frequent keys are dealt to parts.

    ``size`` of ``keyed`` is (about) how many of ``total`` rows have the key. Keys of over one ``split``-th of them, so
    ``split`` at most, are broadcast with their number of parts; rows go round the parts and ``keyed`` is repeated for
    each. ``keyed`` should be a written table, ``rows`` one that is read in a fixed order.
    """
    most = max(1, total // split)
    hot = F.broadcast(keyed.filter(F.col(size) > most).select(key, F.ceil(F.col(size) / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_parts")
    each = keyed.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each.hint("merge"), [key, "_part"]).drop("_part")


def position_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: int, name: str, weight: Column | None = None) -> DataFrame:
    """Add ``name``: the 0-based position of each row in its group, in a pseudorandom but fixed order.

    With ``weight`` the position is the sum of the weights of the rows before it. Rows of a group are dealt to
    ``buckets`` ranges of a hash of ``order``; counts per range give each range its first position, so no task ever
    holds a whole group. Rows that agree in ``order`` are ranked arbitrarily among themselves. Null keys form a group.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    rows = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets))).withColumn("_w", w)
    for i, k in enumerate(keys):
        rows = rows.withColumn(f"_k{i}", F.struct(k))
    groups = [f"_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(*groups, "_b").agg(F.sum("_w").alias("_s")).withColumn("_first", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    # sort-merge: the rows are dealt by group and range for the window in any case, and may be broadcast by a low estimate else
    out = rows.join(firsts.hint("merge"), [*groups, "_b"]).withColumn(name, F.col("_first") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return out.drop("_h", "_b", "_w", "_first", *groups)
