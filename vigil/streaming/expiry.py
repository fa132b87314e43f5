"""Sessions that end: by a reset event, or when nothing comes for a while.

A row with ``reset`` clears its session and gives no output. A session whose last turn is more than ``timeout`` earlier
in event time begins anew, its turns counted from 1. Both hold alike in batch and as a stream; a stream's state also
leaves the store when its session has been silent for longer than a time to live, so the store keeps live sessions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.streaming import session as X

STATE = "at long, cumulative double, recent array<double>, floor double, turns long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of event time after which a session begins anew.
TIMEOUT = 24 * 3600
EMPTY = (None, X.START)


def with_resets(tiers: DataFrame, reset: str = "false") -> DataFrame:
    """Rows of the recurrence with their time in microseconds and whether they reset their session (an expression; null: no)."""
    return tiers.withColumns({"at": F.unix_micros(F.col("timestamp").cast("timestamp")), "reset": F.coalesce(F.expr(reset), F.lit(False))})


def step_of(timeout: float) -> Callable[[tuple, object], tuple[tuple, tuple | None]]:
    """One turn: ((time of the last turn, state), row) -> (the same after it, output or none). Rows without a time never expire a session."""

    def step(state: tuple, r) -> tuple[tuple, tuple | None]:
        last, inner = state
        if r.reset:
            return EMPTY, None
        at = last if pd.isna(r.at) else int(r.at)
        if last is not None and at is not None and at - last > timeout * 1_000_000:
            inner = X.START
        inner, row = X.advance(inner, r)
        return (at if last is None or at is None else max(at, last), inner), row

    return step


def batch(rows: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """Every turn with the risk of its session since it last began."""
    return X.in_order(rows, "session_id", ["timestamp", "interaction_id"], EMPTY, step_of(timeout), X.OUT)


class Sessions(StatefulProcessor):
    """The recurrence with its state in a store whose entries expire."""

    def __init__(self, timeout: float, live_ms: int) -> None:
        self.timeout, self.live_ms = timeout, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step = step_of(self.timeout)
        self.state = handle.getValueState("session", STATE, self.live_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state = EMPTY if held is None else (held[0], (held[1], list(held[2]), held[3], held[4]))
        out = []
        for r in pd.concat(list(rows)).sort_values(["timestamp", "interaction_id"]).itertuples():
            state, row = self.step(state, r)
            if row is not None:
                out.append(row)
        at, (cumulative, recent, floor, turns) = state
        if turns:
            self.state.update((at, float(cumulative), [float(x) for x in recent], float(floor), int(turns)))
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=X.NAMES)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, timeout: float = TIMEOUT, live: float | None = None) -> DataFrame:
    """The same over a stream: rows of a micro-batch in order of time and id, later batches after them.

    ``live`` is how long, in seconds of the clock, the store keeps a silent session (``timeout`` at least; by default
    twice that): as long as rows come in within that time of their own, what the store forgets had ended anyway. The
    session must use the RocksDB state store (see ``use_store``).
    """
    live = max(timeout, live if live is not None else 2 * timeout)
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(timeout, int(1000 * live)), X.OUT, "Append", "ProcessingTime")


def use_store(spark: SparkSession) -> None:
    """State that expires needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def run_once(df: DataFrame, path: str) -> None:
    """Run a stream over what there is now, in one batch, into a Parquet table.

    State that expires by the clock makes a stream that takes all there is in several batches go on for ever.
    """
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(once=True).start(path).awaitTermination()


def active(rows: DataFrame, now: str, timeout: float = TIMEOUT) -> DataFrame:
    """Sessions that are live at the timestamp ``now``: not reset since their last turn, which is at most ``timeout`` ago."""
    last = rows.filter(F.col("timestamp") <= F.lit(now).cast("timestamp")).groupBy("session_id").agg(
        F.max_by(F.struct("at", "reset"), F.struct("timestamp", "interaction_id")).alias("last"), F.max("at").alias("latest")
    )
    fresh = F.unix_micros(F.lit(now).cast("timestamp")) - F.col("latest") <= timeout * 1_000_000
    return last.filter(~F.col("last.reset") & fresh).select("session_id")
