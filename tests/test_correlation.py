"""Correlation windows against a walk through each key's events."""

import random

import pytest
from pyspark.sql import functions as F

from vigilstream.operators import correlation

SCHEMA = "seq_num long, ms long, ip_hash_key string, self boolean, key string, t long, block long, event string"


def walk(rows, seconds=60):
    out, now = [], {}
    for s, ms, k, own, *_ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0] is not None, r[0] or 0)):
        if own or k is None or ms is None:
            continue
        if k in now and ms < now[k][0] + seconds * 1000:
            now[k][2:] = [s, now[k][3] + 1]
            continue
        if k in now:
            out.append((k, *now[k]))
        now[k] = [ms, s, s, 1]
    return sorted(out + [(k, *x) for k, x in now.items()])


def found(spark, rows, seconds=60, parts=3):
    df = spark.createDataFrame([(*r, None, 5, 6, "e") for r in rows], SCHEMA).repartition(parts).withColumn("event_time", F.expr("timestamp_millis(ms)"))
    got = correlation.correlation(df, seconds)
    return sorted((r.key, r.window_start, r.first_event.seq_num, r.last_event.seq_num, r.repeat_count) for r in got.collect())


def test_one_event_and_none(spark):
    assert found(spark, [(1, 1_700_000_000_123, "a", False)], parts=1) == [("a", 1_700_000_000_123, 1, 1, 1)]
    assert found(spark, [(1, None, "a", False), (2, 5, None, False), (3, 5, "a", True)]) == []
    assert found(spark, []) == []


def test_many_events_of_a_key_within_one_window(spark):
    """Several Arrow batches, all within the first window."""
    rows = [(k, 1_700_000_000_000 + k, "hot", False) for k in range(25_000)]
    assert found(spark, rows, parts=1) == [("hot", 1_700_000_000_000, 0, 24_999, 25_000)]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_against_a_walk(spark, batch):
    rnd = random.Random(batch)
    rows = []
    for key, gap in (("hot", 3_000), ("hot2", 100), ("rare", 9_000_000), ("even", 60_000), ("mixed", None), (None, 1000)):
        at = rnd.randrange(-5_000_000, 5_000_000)
        for _ in range({"hot": 2500, "hot2": 1500}.get(key, 60)):
            at += gap if key == "even" else rnd.choice([0, 1, 59_999, 60_000, 60_001, 959_999, 960_000]) if key == "mixed" else rnd.randrange(2 * gap)
            rows.append((len(rows), None if rnd.random() < 0.02 else at, key, None if rnd.random() < 0.5 else rnd.random() < 0.1))
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert found(spark, rows) == walk(rows)
        assert found(spark, rows, 1) == walk(rows, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    """The times of one key lie in many partitions where chains are found."""
    rows = spark.range(40_000).selectExpr("'hot' AS key", "id * 5000 AS t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = correlation.opened(rows)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(key#" in plan and ", block#" in plan
        assert correlation.opened(rows).count() == -(-40_000 // 12)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
