"""Decoders on bytes made here, and stream results against batch results."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from vigilstream.functions import net
from vigilstream.operators import rules, windows
from vigilstream.plans.statements import Registry, Statement, split_script
from vigilstream.sources import events, flows, frames, samples, sflow
from vigilstream.streaming import runner

ROW = {"seq_num": 25, "src_ip": "10.0.0.1", "dst_ip": "198.51.100.2", "bytes": 77, "dst_port": 443}


def test_fixed_flows_reject_what_the_header_does_not_say():
    good = samples.netflow5(ROW)
    assert flows.fixed(good)[0]["bytes"] == 77
    assert flows.fixed(good[:-1]) == flows.fixed(good + b"x") == flows.fixed(b"") == []
    assert flows.fixed(struct.pack(">HH", 5, 0) + good[4:24]) == []


@pytest.mark.parametrize("version", [9, 10])
def test_templates_come_before_data(version):
    known, stats = flows.Templates(), {}
    late = {**ROW, "seq_num": 26}
    assert flows.templated(samples.templated(late, version), known, stats) == []
    assert flows.templated(samples.templated(ROW, version), known, stats)[0]["dst_ip"] == "198.51.100.2"
    assert flows.templated(samples.templated(late, version), known, stats)[0]["dst_port"] == 443
    assert stats == {"packets": 3, "no_template": 1, "flows": 2}


def test_longest_unused_template_leaves():
    known = flows.Templates()
    for n in range(flows.TEMPLATES + 1):
        known.put(1, 256 + n, [(1, 4)])
    assert known.get(1, 256) is None and known.get(1, 257)


def test_sflow_sample_and_cut_datagram():
    raw = samples.sflow5(ROW)
    (found,) = sflow.samples(raw)
    assert (found["sip"], found["host"], found["skipped"]) == ("10.0.0.1", "host.example.com", ["0:2200"])
    assert sflow.samples(raw[:40]) == [] and sflow.samples(b"") == []


def test_dns_answers_and_loops():
    (found,) = frames.dns_message(samples.dns_reply(ROW))
    assert found == {"dns_name": "www.example.com.", "dns_answers": [{"type": "A", "name": None, "ip": "198.51.100.2"}]}
    loop = struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c" + bytes(4)
    assert frames.dns_message(loop) == frames.dns_message(b"ab") == []


def test_frames():
    assert frames.layers(samples.frame(ROW))["payload"] == b"hello"
    assert frames.layers(b"short") is None


def test_replay_records_stop_where_cut(spark, tmp_path):
    body = json.dumps({"seq_num": 5, "dip": "192.0.2.1", "extra": 1}).encode()
    record = struct.pack("<iq", len(body), 1234) + body
    assert len(list(events.lv_records(record * 3 + record[:-1]))) == 3
    (tmp_path / "a.jlv").write_bytes(record * 2)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jlv.gz").write_bytes(gzip.compress(record))
    got = events.source(spark, "lv_file", str(tmp_path)).select("seq_num", "dst_ip", F.unix_millis("event_time").alias("t")).collect()
    assert [tuple(r) for r in got] == [(5, "192.0.2.1", 1234)] * 3


def test_lines_over_segments():
    lines, rest = events.line_frames(b"ab", b"c\nde\n\nf")
    assert (lines, rest) == ([b"abc", b"de"], b"f")
    lines, rest = events.line_frames(b"", b"x" * 5000)
    assert [len(x) for x in lines] == [events.CARRY] and len(rest) == 5000 - events.CARRY


def test_config_with_comments():
    assert events.read_config('{"a": "x//y", // note\n "b": [1, 2,], /* more */ }') == {"a": "x//y", "b": [1, 2]}


def test_script_and_registry():
    assert split_script("-- note\nSELECT ';' FROM a; /* off */; SELECT 2") == ["SELECT ';' FROM a", "SELECT 2"]
    r = Registry()
    r.add(Statement("all", lambda df: df))
    with pytest.raises(ValueError):
        r.add(Statement("all", lambda df: df))


def test_packet_filters(spark):
    rows = spark.createDataFrame([(6, "10.0.0.1", "10.9.0.1", 1024, 80, 2048), (17, "192.0.2.1", "10.0.0.1", 53, 4000, 2048)], "ip_protocol int, src_ip string, dst_ip string, src_port int, dst_port int, eth_type int")
    hit = lambda text: [r.dst_port for r in rows.where(rules.packet_filter(text)).collect()]
    assert hit("tcp port 80") == [80] and hit("not tcp") == [4000] and hit("src net 192.0.2.0/24 or host 10.9.0.1") == [80, 4000]
    for bad in ("tcp and", "(tcp", "port", "what 1", "tcp tcp )"):
        with pytest.raises(ValueError):
            rules.packet_filter(bad)


def test_addresses(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("",), (None,), ("1.2.3",)], "ip string")
    assert [r[0] for r in rows.select(net.ip_to_long(F.col("ip"))).collect()] == [16909060, None, None, None, None]
    nets = spark.createDataFrame([("10.1.2.3/8",), ("10.1.2.3",), ("0.0.0.0/0",), ("10.0.0.0/33",)], "c string")
    got = [r[0] and tuple(r[0]) for r in nets.select(net.cidr_parts(F.col("c"))).collect()]
    assert got == [(167772160, 184549375, 8), (167838211, 167838211, 32), (0, 2**32 - 1, 0), None]


def test_stream_of_rankings_is_the_batch(spark, tmp_path):
    ranking = next(r for r in windows.RANKINGS if r.name == "dst_ip")
    rows = [(k, f"2024-01-01 00:{k // 10:02d}:{k % 10 * 5:02d}", f"10.0.0.{k % 7}", False) for k in range(300)]
    table = spark.createDataFrame(rows, "seq_num long, event_time string, dst_ip string, self boolean").withColumn("event_time", F.col("event_time").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = runner.start_top(stream, ranking, lambda df, _: got.extend(tuple(r) for r in df.select("window_start", "dst_ip", "scount", "rank").collect()), str(tmp_path / "state"), "5 minutes", n=3, available_now=True)
    query.awaitTermination(120)
    want = [tuple(r) for r in windows.top(table, ranking, "5 minutes", 3).select("window_start", "dst_ip", "scount", "rank").collect()]
    last = max(w for w, *_ in want)  # the last window is open still
    assert sorted(got) == sorted(w for w in want if w[0] != last) and got


def test_older_flow_versions():
    """Versions 1 and 7, as their packets are laid out: header, then records of 52 bytes."""
    record = bytes([10, 0, 0, 1, 10, 0, 0, 2, 10, 0, 0, 3]) + struct.pack(">HHIIIIHH", 4, 5, 6, 700, 80, 90, 1024, 53)
    one = struct.pack(">HHIII", 1, 2, 1000, 1_700_000_000, 9) + 2 * (record + struct.pack(">HBBB", 0, 17, 8, 2) + bytes(11))
    found = flows.fixed(one)
    assert len(one) == 16 + 2 * 52 and len(found) == 2 and found[0] == found[1]
    want = {"version": 1, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "gateway_ip": "10.0.0.3", "if_in": 4, "if_out": 5, "packets": 6, "bytes": 700, "flow_start": 80, "flow_finish": 90, "src_port": 1024, "dst_port": 53}
    assert found[0] == want | {"protocol": 17, "tos": 8, "tcp_flags": 2, "sys_uptime_ms": 1000, "unix_secs": 1_700_000_000, "unix_nsecs": 9}
    seven = struct.pack(">HHIIIII", 7, 1, 1000, 1_700_000_000, 9, 44, 0) + record + struct.pack(">BBBBHHBBHI", 0, 2, 6, 8, 64512, 64513, 8, 24, 0, 0)
    assert len(seven) == 24 + 52
    (found,) = flows.fixed(seven)
    assert found == want | {"version": 7, "protocol": 6, "tos": 8, "tcp_flags": 2, "src_as": 64512, "dst_as": 64513, "src_mask": 8, "dst_mask": 24, "sys_uptime_ms": 1000, "unix_secs": 1_700_000_000, "unix_nsecs": 9, "flow_sequence": 44}
    for bad in (one[:-1], one + b"x", seven[:-1], struct.pack(">HH", 7, 2) + seven[4:]):
        assert flows.fixed(bad) == []


def test_own_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in ("10.0.0.1", "10.0.0.2", "2001:DB8:0::5", "2001:db8::6", None, "")], "ip string")
    assert [r[0] for r in rows.select(frames.is_self(F.col("ip"), ("10.0.0.1", "2001:db8::5"))).collect()] == [True, False, True, False, False, False]
    kinds = spark.createDataFrame([(k, s) for k in ("syslog", "dns", "netflow", None) for s in (True, False, None)], "kind string, self boolean")
    assert [tuple(r) for r in frames.guarded(kinds).collect()] == [("syslog", True), ("dns", True), ("dns", False), ("dns", None), ("netflow", True), (None, True), (None, False), (None, None)]


def test_numbers_of_a_queue(spark):
    rows = [(k % 3 and "hot" or None, (k * 37 % 500) * 20 if k % 10 else None, k % 7, 1) for k in range(200)]
    df = spark.createDataFrame(rows, "sensor_name string, s long, seq_num long, at int").withColumn("event_time", F.timestamp_seconds("s")).repartition(3)
    got = windows.queue_numbers(df).collect()
    for name in ("hot", None):
        mine = sorted((r for r in got if r.sensor_name == name), key=lambda r: r.queue_num)
        assert [r.queue_num for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == sum(r[0] == name for r in rows)
        place = [(r.s is not None, r.s or 0, r.seq_num) for r in mine]
        assert place == sorted(place)
