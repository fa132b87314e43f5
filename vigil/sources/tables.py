"""Reading and writing the library's tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import config as C
from vigil.functions.schema import struct

INTERACTION = struct(
    "interaction_id string, timestamp timestamp, application string, user_type string, model string, session_id string, prompt string, context string, response string, tokens_in int, tokens_out int,"
    " latency_ms double, tool_calls int, retry_count int, action_type string, action_amount_inr double, affected_entities int"
)
FEEDBACK = struct(
    "feedback_id string, interaction_id string, system_decision string, reviewer_decision string, human_override boolean, outcome string, actual_outcome string, reason string, reviewer string, timestamp timestamp"
)

_written: dict[tuple[str, str, str], str] = {}
_made: dict[tuple[str, str, str], T.StructType] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where a local session names none, a temporary one. A cluster must name one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="vigil-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def staged(df: DataFrame, name: str, key: str) -> DataFrame:
    """A table that several reports read: written once for a session and ``key``, then read from the shared folder."""
    spark = df.sparkSession
    at = (spark.sparkContext.applicationId, name, key)
    if at not in _written:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _written[at] = path
    return spark.read.schema(df.schema).parquet(_written[at])


def stored(spark: SparkSession, make: Callable[[], DataFrame], name: str, key: str) -> DataFrame:
    """``staged`` of what ``make`` gives; once it is there, nothing is planned again to tell what its columns are."""
    at = (spark.sparkContext.applicationId, name, key)
    if at not in _made:
        _made[at] = staged(make(), name, key).schema
    return spark.read.schema(_made[at]).parquet(_written[at])


def read_interactions(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Interactions from CSV (with header), JSON lines or Parquet, with the fixed schema; bad CSV rows become nulls."""
    reader = spark.read.schema(INTERACTION)
    return reader.csv(path, header=True, multiLine=True, escape='"') if form == "csv" else reader.json(path) if form == "json" else reader.parquet(path)


def write_interactions(df: DataFrame, path: str, form: str = "parquet") -> None:
    out = df.select(*(c.name for c in INTERACTION)).write.mode("overwrite")
    out.csv(path, header=True, escape='"') if form == "csv" else out.json(path) if form == "json" else out.parquet(path)


def split_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled cases as (interactions, labels by interaction_id): detectors never see a label."""
    own = {c.name for c in INTERACTION}
    return cases.select(*(c.name for c in INTERACTION)), cases.select("interaction_id", *(c for c in cases.columns if c not in own))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path)


def append_feedback(df: DataFrame, path: str) -> None:
    df.select(*(c.name for c in FEEDBACK)).write.mode("append").json(path)


def valid(df: DataFrame) -> DataFrame:
    """Add ``valid``: what the record checks of an interaction say."""
    ok = (
        (F.length(F.col("interaction_id").cast("string")) > 0) & (F.col("tokens_in") >= 0) & (F.col("tokens_out") >= 0) & (F.col("latency_ms") > 0) & (F.col("tool_calls") >= 0) & (F.col("retry_count") >= 0)
        & (F.col("affected_entities") >= 1) & F.col("application").isin(*C.APPLICATIONS) & F.col("model").isin(*C.MODELS) & F.col("action_type").isin(*C.ACTIONS)
    )
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def data_quality(df: DataFrame, optional: list[str]) -> DataFrame:
    """One row: records seen, valid, skipped, and nulls of optional fields."""
    return valid(df).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("valid")).alias("n_valid"), F.count_if(~F.col("valid")).alias("skipped"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in optional))


def promoted(decisions: DataFrame) -> DataFrame:
    """Decisions as stored: promoted columns and the whole record as JSON."""
    return decisions.select("interaction_id", "application", "decision", "overall_risk", "timestamp", F.to_json(F.struct(*decisions.columns)).alias("record"))


def first_write_wins(stored: DataFrame, new: DataFrame, key: str = "interaction_id", order: str = "ingest_seq") -> DataFrame:
    """New rows to append: the first of each key that is not stored yet."""
    fresh = new.join(stored.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")


def latest_write(rows: DataFrame, key: str = "interaction_id", order: str = "ingest_seq") -> DataFrame:
    """The last written row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")
