"""Stateful processors against the same rows in batch."""

import json
import time

from pyspark.sql import functions as F

from vigilstream.functions import keys
from vigilstream.operators import correlation, windows
from vigilstream.plans import fixture
from vigilstream.sources import flows, samples
from vigilstream.streaming import runner


def _start(df, path, name):
    return df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / f"state-{name}")).trigger(availableNow=True).start()


def _drain(df, path, name):
    _start(df, path, name).awaitTermination(120)
    return df.sparkSession.table(name)


def test_correlation(spark, tmp_path):
    """Files out of order, several Arrow batches a key in a trigger, and events at one time."""
    rows = [(k, 1_700_000_000 + k * 7 + (k % 3) * 20, f"k{k % 4}", k % 11 == 0) for k in range(200)]
    table = spark.createDataFrame(rows, "seq_num long, s long, ip_hash_key string, self boolean").withColumn("event_time", F.timestamp_seconds("s"))
    end = spark.createDataFrame([(999, 1_800_000_000, "end", False), (1000, 1_900_000_000, "end", False)], "seq_num long, s long, ip_hash_key string, self boolean").withColumn("event_time", F.timestamp_seconds("s"))
    for k, part in enumerate((table.where("seq_num < 100"), table.where("seq_num >= 100"), end.where("seq_num = 999"), end.where("seq_num = 1000"))):
        part.repartition(1).sortWithinPartitions(F.desc("s")).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k < 3 else 0)  # files are taken in the order of their seconds
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = _drain(runner.stream_correlation(stream, 60, delay="5 minutes"), tmp_path, "correlated").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [r for r in correlation.correlation(table, 60).collect()]
    told = sorted((r.key, r.window_start, json.loads(r.first_event)["seq_num"], json.loads(r.last_event)["seq_num"], r.repeat_count) for r in got if r.key != "end")
    assert told == sorted((r.key, r.window_start, r.first_event.seq_num, r.last_event.seq_num, r.repeat_count) for r in want)
    assert json.loads(got[0].first_event)["self"] is False


def test_streams_of_rankings_are_the_batch(spark, tmp_path):
    """All rankings over one stream of events."""
    fields = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    kinds = ("view", "click", "signup", "purchase", "error")
    rows = [(k, f"2024-01-01 00:{k // 10:02d}:{k % 10 * 6:02d}", k * 13 % 40, kinds[k % 5], k / 3, f'{{"k": {k % 29}}}') for k in range(400)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    events = keys.with_connection(fixture.log_messages(spark, str(tmp_path)))
    stream = keys.with_connection(fixture.as_log_messages(spark.readStream.schema(fields).parquet(str(tmp_path / "events.parquet"))))
    running = [_start(runner.stream_counts(stream, r, "5 minutes"), tmp_path, f"sum_{r.name}") for r in windows.RANKINGS]
    for r, query in zip(windows.RANKINGS, running, strict=True):
        query.awaitTermination(120)
        got = spark.table(f"sum_{r.name}")
        columns = ["window_start", *r.keys, "scount"]
        want = [tuple(x) for x in windows.counts(events, r, "5 minutes").select(*columns).collect()]
        last = max(w for w, *_ in want)
        assert sorted(tuple(x) for x in got.select(*columns).collect()) == sorted(w for w in want if w[0] != last), r.name
    got = {tuple(x) for x in _drain(runner.stream_rate(stream, "5 minutes"), tmp_path, "rated").collect()}
    want = {tuple(x) for x in windows.rate(events, "5 minutes").collect()}
    assert got == {w for w in want if w[0] != max(x[0] for x in want)}


def test_flow_templates(spark, tmp_path):
    def packet(k):
        return bytearray(samples.templated({"seq_num": k, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "bytes": k, "dst_port": 53}, 9 if k % 2 else 10))

    rows = [(f"e{k % 2}", k, packet(k)) for k in range(1, 80)]
    table = spark.createDataFrame(rows, "exporter string, seq_num long, payload binary")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    columns = ["exporter", "seq_num", "version", "src_ip", "dst_ip", "bytes"]
    got = sorted(tuple(r) for r in _drain(runner.stream_flows(stream), tmp_path, "flows").select(*columns).collect())
    want = sorted(tuple(r) for r in flows.templated_flows(table).select(*columns).collect())
    assert got == want and len(got) == 28 + 15  # odd from 25 to 79, even from 50 to 78


def test_tcp_lines(spark, tmp_path):
    rows = [("s", k, bytearray(f"{k} a\n{k} ".encode())) for k in range(5)]
    table = spark.createDataFrame(rows, "socket string, seq_num long, payload binary")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    got = [r.message for r in _drain(runner.stream_tcp_lines(stream), tmp_path, "lines").collect()]
    assert got == ["0 a", "0 1 a", "1 2 a", "2 3 a", "3 4 a"]
