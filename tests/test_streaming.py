"""Sessions that end and rows that come late: stream against batch, over several micro-batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.streaming import expiry as XE
from vigil.streaming import late as XL
from vigil.streaming import session as X

T0 = dt.datetime(2024, 1, 1)
ROWS = "session_id long, timestamp timestamp, interaction_id long, overall_risk double, at_unsure_risk double, critical boolean, tiers array<int>, bounds array<double>"
HOUR = 3600


def tiers(spark, turns):
    """(session, hours, id, risk, critical) as rows of the recurrence."""
    made = [(s, T0 + dt.timedelta(hours=h), i, float(r), 0.6, c, [0, 1, 2, 3, 4] * 2, [0.2, 0.4, 0.62, 0.85]) for s, h, i, r, c in turns]
    return spark.createDataFrame(made, ROWS)


#: Session 1 is reset before its fifth turn, session 2 is silent for three days, session 3 goes on.
TURNS = [
    *((1, h, 10 + h, 0.7, h == 1) for h in range(8)), *((2, h, 100 + h, 0.8, False) for h in range(4)), *((2, 76 + h, 150 + h, 0.3, False) for h in range(4)),
    *((3, 5 * h, 200 + h, 0.1 * h, False) for h in range(9)),
]
RESET = "interaction_id = 14"


def rows_of(df):
    return sorted(map(tuple, df.select(*X.NAMES).collect()))


def test_reset_and_expiry_start_a_session_afresh(spark):
    got = {r["interaction_id"]: r for r in XE.batch(XE.with_resets(tiers(spark, TURNS), RESET)).collect()}
    assert 14 not in got and got[13]["turn"] == 4 and got[13]["floor"] == 0.75
    assert got[15]["turn"] == 1 and got[15]["floor"] == 0.0 and got[15]["high_risk_events"] == 1
    assert got[103]["turn"] == 4 and got[150]["turn"] == 1 and got[150]["adjusted"] == 0.3
    assert got[208]["turn"] == 9
    plain = {r["interaction_id"]: r for r in X.batch(tiers(spark, TURNS)).collect()}
    assert plain[150]["turn"] == 5 and plain[150]["adjusted"] > 0.3  # without expiry the old risk stays


@pytest.mark.parametrize("cuts", [(), (3, 30), (1, 2, 6, 77)])
def test_stream_equals_batch_after_reset_and_expiry(spark, tmp_path, cuts):
    XE.use_store(spark)
    rows = XE.with_resets(tiers(spark, TURNS), RESET)
    ends = [-1, *cuts, 10_000]
    stream = XE.stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*"))
    hours = (F.col("at") - F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000)) / 3_600_000_000
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        rows.filter((hours > a) & (hours <= b)).coalesce(1).write.parquet(f"{tmp_path}/in/part-{k}")
        XE.run_once(stream, f"{tmp_path}/out")
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(XE.batch(rows))


def test_active_sessions(spark):
    rows = XE.with_resets(tiers(spark, [t for t in TURNS if t[2] <= 14 or t[2] >= 100]), RESET)
    live = lambda now: sorted(r["session_id"] for r in XE.active(rows, str(T0 + dt.timedelta(hours=now))).collect())
    assert live(3) == [1, 2, 3] and live(4.5) == [2, 3] and live(30) == [3] and live(77) == [2] and live(200) == []


def decisions(spark, rows):
    return spark.createDataFrame([(i, None if m is None else T0 + dt.timedelta(minutes=m), a, d) for i, m, a, d in rows], "interaction_id long, timestamp timestamp, application string, decision string")


def test_late_rows_are_kept_and_counts_are_whole(spark, tmp_path):
    batches = [
        [(1, 5, "a", "ALLOW"), (2, 50, "a", "BLOCK"), (3, 61, "b", "ALLOW")],
        [(4, 300, "a", "HUMAN_REVIEW"), (5, 20, "a", "BLOCK")],  # 5 comes while its window is open: 61 - 10 < 60
        [(6, 10, "a", "BLOCK"), (7, 295, "b", "ALLOW"), (8, None, "b", "ALLOW"), (9, 239, "b", "BLOCK"), (10, 241, "b", "BLOCK")],  # 290 has passed
        [],
    ]
    every = decisions(spark, [r for b in batches for r in b])
    for k, b in enumerate(batches):
        decisions(spark, b).coalesce(1).write.parquet(f"{tmp_path}/in/part-{k}")
        XL.run(spark.readStream.schema(every.schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out")
    late = sorted(r["interaction_id"] for r in XL.late_rows(spark, f"{tmp_path}/out").collect())
    assert late == [6, 8, 9]
    counts = lambda df: sorted((r["window"]["start"], r["application"], r["n"], r["blocked"], r["reviewed"]) for r in df.collect())
    assert counts(XL.complete(spark, f"{tmp_path}/out")) == counts(X.monitor(every.filter("timestamp is not null")))
    assert counts(XL.counted(spark, f"{tmp_path}/out")) == counts(X.monitor(every.filter("interaction_id not in (6, 8, 9)")))


def test_a_batch_that_runs_again_counts_once(spark, tmp_path, monkeypatch):
    one = decisions(spark, [(1, 5, "a", "ALLOW"), (2, 500, "a", "BLOCK")])
    one.coalesce(1).write.parquet(f"{tmp_path}/in/part-0")
    stream = spark.readStream.schema(one.schema).parquet(f"{tmp_path}/in/*")
    whole, failed = XL._latest_before, []

    def fails_once(*args):
        if not failed:
            failed.append(True)
            decisions(spark, [(1, 5, "a", "ALLOW")]).groupBy(F.window("timestamp", "1 hour"), "application").agg(*(F.count(F.lit(1)).alias(c) for c in ("n", "blocked", "reviewed"))).write.parquet(f"{tmp_path}/out/counts/batch=0")
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(XL, "_latest_before", fails_once)
    with pytest.raises(Exception, match="lost"):
        XL.run(stream, f"{tmp_path}/out")
    XL.run(stream, f"{tmp_path}/out")
    assert sum(r["n"] for r in XL.counted(spark, f"{tmp_path}/out").collect()) == 2
