"""Reports delivered to sockets, queues and tables, and small helpers of streams."""

import json
import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from vigilstream.operators import reports
from vigilstream.sources import events
from vigilstream.streaming import sinks
from vigilstream.streaming.batchlog import BatchLog


def made(spark, n, first=0):
    return spark.range(first, first + n).select(F.lit("Top").alias("statement"), F.col("id").alias("time"), F.format_string('{"n":%d}', F.col("id")).alias("json"))


def test_socket_frames_are_sent_whole(spark):
    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def listen():
        for _ in range(2):
            data, link = b"", server.accept()[0]
            while part := link.recv(1 << 16):
                data += part
            got.append(data)

    thread = threading.Thread(target=listen)
    thread.start()
    sinks.sink("socket", host="127.0.0.1", port=server.getsockname()[1])(made(spark, 20).repartition(2), 0)
    thread.join(60)
    bodies = []
    for data in got:
        while data:
            (size,) = struct.unpack(">i", data[:4])
            bodies.append(data[4 : 4 + size].decode())
            data = data[4 + size :]
    assert sorted(bodies) == sorted(f'{{"n":{k}}}' for k in range(20))
    with pytest.raises(ValueError):
        sinks.sink("fax")


def test_queue_counts_discards(spark, tmp_path):
    queue = sinks.QueueSink("text", room=5, path=str(tmp_path / "q"))
    queue(made(spark, 8), 0)
    queue(made(spark, 3), 1)
    assert (queue.sent, queue.discards) == (8, 3) and spark.read.text(str(tmp_path / "q")).count() == 8
    assert queue.sent_bytes == 8 * len('{"n":0}')


def test_table_is_drained(spark, tmp_path):
    table = sinks.ReportTable(spark, str(tmp_path / "t"), most=4)
    table(made(spark, 3), 0)
    table(made(spark, 3), 0)  # a batch that is delivered again
    rows, dropped = table.drain()
    assert [r.json for r in rows.collect()] == ['{"n":0}', '{"n":1}', '{"n":2}'] and dropped == 0
    table(made(spark, 6, 10), 1)
    assert [r.json for r in table.latest().collect()] == ['{"n":15}']
    rows, dropped = table.drain()
    assert [r.json for r in rows.collect()] == [f'{{"n":{k}}}' for k in range(10, 14)] and dropped == 2
    assert table.drain()[0].count() == 0


def test_a_table_without_reports_and_with_timestamps(spark, tmp_path):
    table = sinks.ReportTable(spark, str(tmp_path / "t"))
    assert table.latest().collect() == [] and table.drain()[0].collect() == []
    rows = spark.range(3).select(F.lit("Top").alias("statement"), F.timestamp_seconds(F.col("id") * 100).alias("time"), F.format_string('{"n":%d}', F.col("id")).alias("json"))
    table(rows, 0)
    assert [(r.time, r.json) for r in table.latest().collect()] == [("1970-01-01 00:03:20", '{"n":2}')]
    assert [r.json for r in table.drain()[0].collect()] == ['{"n":0}', '{"n":1}', '{"n":2}']


def test_a_batch_that_comes_again_is_in_a_queue_once(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    queue = sinks.QueueSink("text", log=log, path=str(tmp_path / "q"))
    for batch in (0, 0, 1, 1, 0):
        queue(made(spark, 3, 10 * batch), batch)
    again = sinks.QueueSink("text", log=BatchLog(spark, str(tmp_path / "log")), path=str(tmp_path / "q"))  # after a restart
    again(made(spark, 3, 10), 1)
    again(made(spark, 3, 20), 2)
    assert queue.sent == 6 and again.sent == 3
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "q")).collect()) == sorted(f'{{"n":{k}}}' for b in range(3) for k in range(10 * b, 10 * b + 3))


def test_ids_go_on_after_a_restart(spark, tmp_path):
    got, table = [], sinks.ReportTable(spark, str(tmp_path / "t"))

    def sink(reports, number):
        got.append([json.loads(r.json)["id"] for r in reports.orderBy("json").collect()])
        table(reports, number)

    rows = lambda n, first: spark.range(first, first + n).select(F.lit("Top").alias("statement"), F.when(F.col("id") != 1, F.col("id")).alias("time"), F.lit(1).alias("size"))
    one = sinks.Numbered(sink, BatchLog(spark, str(tmp_path / "log")), first=100)
    one(rows(3, 0), 0)
    one(rows(3, 0), 0)
    one(rows(2, 200), 1)
    two = sinks.Numbered(sink, BatchLog(spark, str(tmp_path / "log")), first=100)
    two(rows(2, 200), 1)
    two(rows(4, 300), 2)
    assert [sorted(x) for x in got] == [[100, 101, 102], [103, 104], [105, 106, 107, 108]]
    assert sorted(json.loads(r.json)["id"] for r in table.drain()[0].collect()) == list(range(100, 109))


def test_a_driver_lost_before_the_entry_gives_the_same_ids(spark, tmp_path):
    class Lost(Exception):
        pass

    class Log(BatchLog):
        def commit(self, number, **values):
            raise Lost

    table = sinks.ReportTable(spark, str(tmp_path / "t"))
    rows = spark.range(3).select(F.lit("Top").alias("statement"), F.col("id").alias("time"))
    with pytest.raises(Lost):
        sinks.Numbered(table, Log(spark, str(tmp_path / "log")))(rows, 0)
    sinks.Numbered(table, BatchLog(spark, str(tmp_path / "log")))(rows, 0)
    assert [json.loads(r.json)["id"] for r in table.drain()[0].collect()] == [0, 1, 2]


def test_throughput(spark, tmp_path):
    spark.range(50).selectExpr("concat('x', id) AS value").coalesce(1).write.text(str(tmp_path / "in"))
    told = []
    listener = sinks.Throughput(each=lambda name, rates: told.append((name, rates)))
    spark.streams.addListener(listener)
    try:
        stream = sinks.measured(spark.readStream.text(str(tmp_path / "in")))
        query = stream.writeStream.format("noop").queryName("fed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(100):
            if told:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    name, rates = told[0]
    assert name == "fed" and rates["messages"] == 50 and rates["bytes"] == 50 * 2 + 40 and rates["messages_per_second"] > 0 < rates["mb_per_second"]


def test_length_frames():
    a, b = b"abc", b"x" * 300
    data = b"".join(struct.pack("<i", len(x)) + x for x in (a, b, b""))
    for cut in range(len(data)):
        first, rest = events.length_frames(b"", data[:cut])
        second, rest = events.length_frames(rest, data[cut:])
        assert first + second == [a, b, b""] and rest == b""
    assert events.length_frames(b"", struct.pack("<i", -1) + b"rest") == ([], b"")


def test_numbers_run_over_hours(spark):
    rows = spark.createDataFrame([(s, t) for t in range(0, 30_000, 700) for s in ("b", "a")], "statement string, time long").repartition(3)
    got = [(r.time, r.statement) for r in sorted(reports.numbered(rows, 5).collect(), key=lambda r: r.id)]
    assert got == sorted(got) and [r.id for r in reports.numbered(rows, 5).orderBy("id").collect()] == list(range(5, 5 + len(got)))


def test_charts_and_helpers(spark):
    assert reports.chart_fields("DstIpTop", ("dst_ip", "scount")) == ("dst_ip", "scount")
    assert reports.chart_fields("X_Top", ("Bytes", "y")) == ("y", "Bytes") and reports.chart_fields("DstIpSum", ("dst_ip", "scount")) is None and reports.chart_fields("ATop", ("a", "b")) is None
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(2)
    assert sinks.fan_in([a, b]).where("x is null").count() == 2
    assert [r.id for r in sinks.sampled(spark.range(2500), 1000, "id").collect()] == [0, 1000, 2000]
