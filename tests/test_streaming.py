"""Streams give what the same functions give on the whole table."""

from __future__ import annotations

import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from marketloom.streaming import bars


@pytest.fixture
def events(spark, small, tmp_path):
    shutil.copy(f"{small}/events.parquet", tmp_path / "events.parquet")
    return str(tmp_path)


def streamed(frame, mode, folder):
    name = f"s{uuid.uuid4().hex}"
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/.{name}").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        return frame.sparkSession.table(name).collect()
    finally:
        q.stop()


@pytest.mark.parametrize("fn", [lambda e: bars.tumbling(e, "1 hour"), lambda e: bars.sessions(e, "30 minutes"), bars.last_values])
def test_stream_equals_batch(spark, events, fn):
    batch = fn(spark.read.schema(bars.EVENTS).parquet(events).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(streamed(fn(bars.read_events(spark, events)), "complete", events), key=repr) == sorted(batch.collect(), key=repr)


def test_late_windows_close(spark, events):
    closed = streamed(bars.tumbling(bars.read_events(spark, events), "1 hour"), "append", events)
    batch = bars.tumbling(spark.read.schema(bars.EVENTS).parquet(events).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").collect()
    assert set(closed) <= set(batch) and len(closed) >= 0.9 * len(batch)
