"""Segments out of order over several triggers against the same segments in batch."""

import random
import struct
import time

import pytest

from vigilstream.sources import events
from vigilstream.streaming import runner

SCHEMA = "socket string, seq_num long, payload binary"


def triggers(spark, path, parts):
    """A stream that brings each part in a trigger of its own."""
    for k, rows in enumerate(parts):
        spark.createDataFrame([(s, n, bytearray(p)) for s, n, p in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
        time.sleep(1.1 if k < len(parts) - 1 else 0)  # files are taken in the order of their seconds
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def drained(df, path, name, n):
    """The first n rows of a query; it is stopped then, as timers keep it from ending by itself."""
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / name)).start()
    try:
        for _ in range(200):
            if df.sparkSession.table(name).count() >= n or query.exception() is not None:
                break
            time.sleep(0.3)
        assert query.exception() is None
    finally:
        query.stop()
    return [(r.socket, r.message) for r in df.sparkSession.table(name).collect()]


def by_socket(rows):
    out = {}
    for socket, message in rows:
        out.setdefault(socket, []).append(message)
    return out


@pytest.mark.parametrize("by", ["number", "bytes"])
def test_lines_over_triggers_are_those_of_the_batch(spark, tmp_path, by):
    rnd = random.Random(by)
    rows = []
    for socket in ("a", "b", "c"):
        text = "".join(f"{socket}{k} {'x' * rnd.randrange(20)}\n" for k in range(60)).encode()
        at = number = 0
        while at < len(text):
            size = rnd.randrange(1, 40)
            rows.append((socket, at if by == "bytes" else number, text[at : at + size]))
            at, number = at + size, number + 1
    batch = by_socket((r.socket, r.message) for r in events.syslog_tcp(spark.createDataFrame([(s, n, bytearray(p)) for s, n, p in rows], SCHEMA)).orderBy("socket", "at").collect())
    parts = [[], [], []]
    for r in rows:
        parts[rnd.randrange(3)].append(r)
    parts[2] += rnd.sample(rows, 20)  # sent again
    if by == "bytes":  # and sent again in one longer piece
        parts[1].append(("a", 0, b"".join(p for s, _, p in rows if s == "a")[:100]))
    for p in parts:
        rnd.shuffle(p)
    got = drained(runner.stream_tcp_lines(triggers(spark, tmp_path, parts), by, first=0, wait=600_000), tmp_path, f"lines_{by}", sum(map(len, batch.values())))
    assert by_socket(got) == batch


def test_a_gap_is_given_up_after_a_while(spark, tmp_path):
    parts = [[("s", 0, b"one\ntw"), ("s", 2, b"three\nfour\n")], [("s", 3, b"five\n")], [("t", 0, b"other\n")], [("t", 1, b"more\n")], [("s", 1, b"late\n"), ("s", 4, b"six\n")]]
    stream = triggers(spark, tmp_path, parts)
    query = runner.stream_tcp_lines(stream, wait=1).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "gaps")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            got = by_socket((r.socket, r.message) for r in spark.table("gaps").collect())
            if "six" in got.get("s", ()) and len(got.get("t", ())) == 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    # What the missing segment's neighbours have is joined, as a batch without it would.
    assert got == {"s": ["one", "twthree", "four", "five", "six"], "t": ["other", "more"]}


def test_framed_records_over_triggers(spark, tmp_path):
    data = b"".join(struct.pack("<i", len(x)) + x for x in (b"abc", b"", b"d" * 300, b"end"))
    cuts = [data[k : k + 50] for k in range(0, len(data), 50)]
    rows = [("s", k, c) for k, c in enumerate(cuts)]
    got = drained(runner.stream_records(triggers(spark, tmp_path, [rows[::2], rows[1::2]]), first=0), tmp_path, "records", 4)
    assert [m for _, m in got] == ["abc", "", "d" * 300, "end"]
    with pytest.raises(ValueError):
        runner.TcpLines(by="time")
