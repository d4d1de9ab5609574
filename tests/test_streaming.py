"""Streaming queries driven to their end over files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import live


@pytest.fixture()
def feed(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:{s:02d}") for m in range(3) for s in (0, 20, 40)] + [("b", "2024-01-01 00:00:10"), ("b", "2024-01-01 00:00:10")]
    df = spark.createDataFrame(rows, "key string, t string").select("key", F.col("t").cast("timestamp").alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_windows(spark, feed):
    rows = run(spark, live.windowed_counts(feed, "at", "10 minutes", "1 minute", "key"), "windows", "complete")
    assert {(r.key, r.window.start.minute): r.n for r in rows} == {("a", 0): 3, ("a", 1): 3, ("a", 2): 3, ("b", 0): 2}


def test_once(spark, feed):
    assert len(run(spark, live.once(feed, ["key", "at"], "at"), "once")) == 10


def test_throttle_agrees_with_its_batch_form(spark, feed, tmp_path):
    got = run(spark, live.throttled(feed, "key", "at", 30_000), "throttled")
    batch = live.throttled_batch(spark.read.parquet(str(tmp_path / "in")), "key", "at", 30_000).collect()
    assert sorted((r.key, r.at) for r in got) == sorted((r.key, r.at) for r in batch)
    assert sum(r.key == "a" for r in got) == 5


def test_completions(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "completed"), (1, 2, "discarded"), (2, 2, "completed")], "batch_id long, total long, outcome string")
    df.write.parquet(str(tmp_path / "jobs"))
    rows = run(spark, live.completions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "jobs"))), "completions")
    assert [(r.batch_id, r.done) for r in rows] == [(1, 2)]
