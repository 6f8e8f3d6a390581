"""The live stream against batch results, with messages that come late and out of order."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from marketloom.plans import catalog
from marketloom.streaming import bars, live


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def run(spark, folder, *parts):
    """The rows out of a stream over some batches of messages."""
    source, name = folder / "in", f"l{uuid.uuid4().hex}"
    source.mkdir()
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("overwrite").parquet(str(folder / f"p{k}"))
        (file,) = (folder / f"p{k}").glob("*.parquet")
        file.rename(source / f"{k}.parquet")
        import os

        os.utime(source / f"{k}.parquet", (1_000_000_000 + k, 1_000_000_000 + k))
    q = live.live(bars.read_events(spark, str(source)), 3600, 1800).writeStream.format("memory").queryName(name).outputMode("append")
    q = q.option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
        return spark.table(name)
    finally:
        q.stop()


def test_live_values_and_bars_equal_batch(spark, rocks, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(*bars.EVENTS.fieldNames())
    # Every seventh message of a batch comes with the next one, five minutes late at most by event time or not at all late.
    n = events.count()
    edges = events.approxQuantile("event_id", [0.34, 0.67], 0.0)
    part = F.when(F.col("event_id") <= edges[0], 0).when(F.col("event_id") <= edges[1], 1).otherwise(2)
    near = F.col("event_id").isin([int(e) - k for e in edges for k in (0, 1)])
    dealt = events.withColumn("part", F.when(near, part + 1).otherwise(part))
    out = run(spark, tmp_path, *[dealt.filter(F.col("part") == k).drop("part").orderBy(F.rand(k)) for k in range(3)])
    want = {r["user_id"]: r for r in catalog.QUERIES["merged_last_values"](spark, small).collect()}
    got = {r["user_id"]: r["s"] for r in out.filter("kind = 'state'").groupBy("user_id").agg(F.max_by(F.struct("trade", "quote", "security", "messages"), "messages").alias("s")).collect()}
    assert sum(r["messages"] for r in got.values()) == n and got.keys() == want.keys()
    for user, r in got.items():
        for field in ("trade", "quote", "security"):
            assert (r[field] is None) == (want[user][field] is None) and (r[field] is None or abs(r[field] - want[user][field]) < 1e-5)
    whole = {(r["user_id"], r["bucket"]): tuple(r)[2:] for r in bars.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").collect()}
    closed = {(r["user_id"], r["at"]): (r["open"], r["high"], r["low"], r["close"], r["n"]) for r in out.filter("kind = 'closed'").collect()}
    assert closed and closed.keys() <= whole.keys() and all(closed[k] == whole[k] for k in closed)
    assert len(closed) >= 0.6 * len(whole)
    stale = out.filter("kind = 'stale'").count()
    assert stale > 0
    b = live.breadth(out).first()
    both = [r for r in want.values() if r["trade"] is not None and r["quote"] is not None]
    assert (b["above"], b["below"]) == (sum(r["trade"] > r["quote"] for r in both), sum(r["trade"] < r["quote"] for r in both))
    assert b["unknown"] == len(want) - len(both)


def test_a_late_message_changes_its_bar_but_no_newer_value(spark, rocks, tmp_path):
    def rows(*told):
        frame = spark.createDataFrame([(i, t, 1, kind, v, None) for i, t, kind, v in told], "event_id long, ts string, user_id long, event_type string, value double, props string")
        return frame.withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    out = run(
        spark, tmp_path,
        rows((1, "2024-01-01 00:10:00", "view", 5.0), (2, "2024-01-01 01:01:00", "view", 7.0)),
        rows((3, "2024-01-01 00:59:00", "view", 9.0), (4, "2024-01-01 00:58:00", "purchase", 1.0)),
        rows((5, "2024-01-01 05:00:00", "signup", 2.0)), rows((6, "2024-01-01 09:00:00", "signup", 3.0)),
    )
    closed = sorted((str(r["at"]), r["open"], r["high"], r["low"], r["close"], r["n"]) for r in out.filter("kind = 'closed'").collect())
    assert closed[:2] == [("2024-01-01 00:00:00", 5.0, 9.0, 1.0, 9.0, 3), ("2024-01-01 01:00:00", 7.0, 7.0, 7.0, 7.0, 1)]
    states = sorted((r["messages"], r["trade"], r["quote"], r["security"]) for r in out.filter("kind = 'state'").collect())
    assert states == [(2, None, 7.0, None), (4, 1.0, 7.0, None), (5, 1.0, 7.0, 2.0), (6, 1.0, 7.0, 3.0)]
    assert [(str(r["at"]), r["quote"]) for r in out.filter("kind = 'stale'").collect()] == [("2024-01-01 01:31:00", 7.0)]
