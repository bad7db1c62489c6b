"""As-of joins, and what is made of them: templates before flows, and floors of networks, against a walk in order."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from vigilstream.operators.asof import as_of
from vigilstream.sources import flows


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of_by_brute_force(spark, width):
    rnd = random.Random(width)
    left = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(40)]), k, 9) for k in range(150)]
    right = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(40)]), f"v{k}") for k in range(30)]
    right = list({(b, o): (b, o, v) for b, o, v in right}.values())
    got = as_of(spark.createDataFrame(left, "of string, o long, id long, slice int"), spark.createDataFrame(right, "of string, o long, value string"), ["of"], ["o"], F.floor(F.col("o") / width), F.col("value"), "out")
    place = lambda o: (o is not None, o or 0)
    want = []
    for b, o, k, x in left:
        before = [(place(p), v) for c, p, v in right if c == b and place(p) <= place(o)]
        want.append((b, o, k, x, max(before)[1] if before else None))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert got.columns == ["of", "o", "id", "slice", "out"]


def packet(rnd, version, number):
    """Templates and data sets in any order, broken ones among them."""
    sets = b""
    for _ in range(rnd.randrange(1, 4)):
        template = rnd.choice([256, 257, 258])
        if rnd.random() < 0.3:
            fields = rnd.choice([((8, 4), (12, 4), (1, 4)), ((1, 8), (8, 4), (12, 4), (7, 2)), ((27, 16), (28, 16), (2, 4)), ((1, 9),), ()])
            body = struct.pack(">HH", template, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)
            sets += struct.pack(">HH", 0 if version == 9 else 2, 4 + len(body)) + body
        else:
            body = rnd.randbytes(rnd.randrange(60))
            sets += struct.pack(">HH", template, 4 + len(body)) + body
    if rnd.random() < 0.05:
        sets += struct.pack(">HH", 256, 2)
    source = rnd.choice([1, 2])
    if version == 9:
        return struct.pack(">HHIIII", 9, 1, 1000, 1_700_000_000, number, source) + sets
    return struct.pack(">HHIII", 10, 16 + len(sets), 1_700_000_000, number, source) + sets


def in_order(rows):
    out, known = [], {}
    for name, k, data in sorted(rows, key=lambda r: r[1]):
        if data is not None:
            out += [(name, k, f.get("src_ip"), f.get("dst_ip"), f.get("bytes"), f.get("packets"), f["version"], f.get("sys_uptime_ms"), f["unix_secs"], f["flow_sequence"], f["source_id"]) for f in flows.templated(data, known.setdefault(name, flows.Templates()), {})]
    return sorted(map(str, out))


COLUMNS = ["exporter", "seq_num", "src_ip", "dst_ip", "bytes", "packets", "version", "sys_uptime_ms", "unix_secs", "flow_sequence", "source_id"]


def decoded(spark, rows):
    df = spark.createDataFrame([(e, k, None if d is None else bytearray(d)) for e, k, d in rows], "exporter string, seq_num long, payload binary").repartition(3)
    return sorted(str(tuple(r)) for r in flows.templated_flows(df).select(*COLUMNS).collect())


@pytest.mark.parametrize("slice", [3, 4096])
def test_templates_as_of_their_time(spark, monkeypatch, slice):
    monkeypatch.setattr(flows, "SLICE", slice)
    rnd = random.Random(slice)
    rows = [(rnd.choice(["hot", "hot", "hot", "x"]), k, packet(rnd, rnd.choice([9, 10]), k)) for k in range(300)]
    rows += [("x", 1000, None), ("x", 1001, b""), ("x", 1002, b"\0\t" + bytes(8)), ("x", 1003, b"\0\x05" + bytes(30))]
    got = decoded(spark, rows)
    assert got == in_order(rows) and len(got) > 50


def test_exporters_beyond_their_templates_lose_the_oldest(spark):
    """Nine templates of a source, and then a sixty-fifth source: only a walk in order knows which have gone."""
    def one(k, version, source, *sets):
        return struct.pack(">HHIIII", 9, 1, 1, 1, k, source) + b"".join(struct.pack(">HH", kind, 4 + len(b)) + b for kind, b in sets)

    define = lambda n: (0, struct.pack(">HHHH", n, 1, 1, 4))
    data = lambda n: (n, struct.pack(">I", n))
    rows = [("nine", k, one(k, 9, 1, define(256 + k))) for k in range(9)] + [("nine", 9 + k, one(k, 9, 1, data(256 + k))) for k in range(9)]
    rows += [("many", k, one(k, 9, k, define(300), data(300))) for k in range(65)] + [("many", 65 + k, one(k, 9, k, data(300))) for k in range(65)]
    rows += [("few", k, one(k, 9, 1, *([define(256)] if k == 3 else []), data(256))) for k in range(6)]
    got = decoded(spark, rows)
    assert got == in_order(rows) and len(got) == 8 + 65 + 64 + 3


def test_one_exporter_is_many_tasks(spark):
    rows = spark.createDataFrame([("hot", k, bytearray(packet(random.Random(k), 9, k))) for k in range(20)], "exporter string, seq_num long, payload binary")
    plan = flows.templated_flows(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "seq_num" in plan and "slice" in plan
