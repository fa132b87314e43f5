"""A windowed monitor that loses nothing: rows behind the watermark go to a table of their own.

Every micro-batch writes three small tables under its own batch id: counts by window, rows that came too late, and the
latest event time seen. A batch that is run again after a failure overwrites what it wrote before, so each counts once.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.streaming.session import monitor

SEEN = "batch long, latest timestamp"


def _latest_before(spark: SparkSession, path: str, batch_id: int) -> datetime.datetime | None:
    """The latest event time of earlier batches: one row a batch."""
    if batch_id == 0:
        return None
    return spark.read.schema(SEEN).parquet(f"{path}/seen/*").filter(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]


def run(stream: DataFrame, path: str, window: str = "1 hour", late: str = "10 minutes") -> None:
    """Count ``stream`` (timestamp, application, decision, and more) into tables under ``path``, over all there is.

    A row is late if its window ended at or before the watermark: the latest time of earlier batches less ``late``.
    Late rows, and rows without a time, are kept whole in the side table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = _latest_before(spark, path, batch_id)
        mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        ends = F.window(F.col("timestamp"), window)["end"]
        behind = F.lit(False) if latest is None else ends <= mark
        kept = batch.persist()
        try:
            known = kept.filter("timestamp is not null").withColumn("_late", behind)
            side = known.filter("_late").drop("_late").unionByName(kept.filter("timestamp is null"))
            side.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            counts = monitor(known.filter("not _late"), window)
            counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
            seen = kept.agg(F.lit(batch_id).cast("long").alias("batch"), F.max("timestamp").cast("timestamp").alias("latest"))
            seen.coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch-{batch_id}")
        finally:
            kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def counted(spark: SparkSession, path: str) -> DataFrame:
    """Counts by window and application of the rows that came in time."""
    return spark.read.parquet(f"{path}/counts").groupBy("window", "application").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "reviewed")))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, with the batch they came in."""
    return spark.read.parquet(f"{path}/late")


def complete(spark: SparkSession, path: str, window: str = "1 hour") -> DataFrame:
    """Counts of all rows that have a time: those in time and those that were late."""
    more = monitor(late_rows(spark, path), window)
    return counted(spark, path).unionByName(more).groupBy("window", "application").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "reviewed")))


def session_windows(d: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions by inactivity: decisions of a session id that are less than ``gap`` apart, with counts and the highest risk.

    Rows without a time are left out. In a stream the watermark is for the caller to set.
    """
    found = d.groupBy("session_id", F.session_window("timestamp", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("overall_risk").alias("max_risk"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"))
    return found.select("session_id", F.col("session_window.start").alias("start"), (F.col("session_window.end") - F.expr(f"INTERVAL {gap}")).alias("last"), "n", "max_risk", "blocked")
