from __future__ import annotations

from strataform.operators.skew import broadcast_within, bucket_counts, chunked_fill, chunked_lag, spread
from strataform.sources.shared import written
from tests.conftest import rows

DATA = [("a", 1, 1, "x"), ("a", 1, 2, None), ("a", 2, 3, None), ("a", 4, 9, "y"), ("b", 1, 1, None)]


def frame(spark):
    return spark.createDataFrame(DATA, "k string, day int, t int, v string")


def test_lag_and_lead_cross_chunks(spark):
    df = frame(spark)
    assert rows(chunked_lag(df, ["k"], "day", "t", "t", "p").select("k", "t", "p")) == [("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("a", 9, 3), ("b", 1, None)]
    assert rows(chunked_lag(df, ["k"], "day", "t", "t", "n", forward=True).select("k", "t", "n")) == [("a", 1, 2), ("a", 2, 3), ("a", 3, 9), ("a", 9, None), ("b", 1, None)]


def test_fill_crosses_chunks(spark):
    assert rows(chunked_fill(frame(spark), ["k"], "day", "t", ["v"]).select("k", "t", "v")) == [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "x"), ("a", 9, "y"), ("b", 1, None)]


def test_broadcast_only_within_the_bound(spark):
    df = frame(spark)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(broadcast_within(df).join(df, "k")) or "broadcast" in plan(broadcast_within(df)).lower()
    assert "broadcast" not in plan(broadcast_within(df, limit=10)).lower()


def test_buckets_spread_and_written(spark):
    df = frame(spark)
    assert rows(bucket_counts(df, ["k"], 2)) == [("a", 2), ("b", 1)]
    assert rows(written(df)) == rows(df)
    assert spread(df.coalesce(1), "k").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
