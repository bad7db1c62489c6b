"""Lookups row by row, in both families, against plain Python."""

import ipaddress
import random

from pyspark.sql import functions as F

from vigilstream.functions import net
from vigilstream.operators import lookups, reputation, rules

IOC = "file_id long, line long, id long, type string, threat_type string, ip string, dns string, value string"


def iocs(spark, *rows):
    return spark.createDataFrame([(0, k, k, kind, "scan", *rest) for k, (kind, *rest) in enumerate(rows, 1)], IOC)


def test_sensors_with_equal_numbers_stay_apart(spark):
    table = iocs(spark, ("ip", "192.0.2.1", None, None), ("ip", "2001:DB8:0::1", None, None), ("cidr", None, None, "2001:db8::/32"), ("domain", None, "a.example.com", None), ("cidr", None, None, "10.0.0.0/8"))
    rows = [("s1", 1, "192.0.2.1", "10.9.9.9"), ("s2", 1, "2001:db8::1", "8.8.8.8"), ("s3", 0, "2001:0db8:ffff::5", "x"), ("s4", 0, "9.9.9.9", None), ("s5", 0, None, "10.1.1.1")]
    events = spark.createDataFrame(rows, "sensor string, seq_num long, src_ip string, dst_ip string")
    got = {r.sensor: (r.probe, r.ioc_id, r.dst_ip) for r in lookups.frame_match(events, table).collect()}
    assert got == {"s1": ("sip", 1, "10.9.9.9"), "s2": ("sip", 2, "8.8.8.8"), "s3": ("sip_cidr", 3, "x"), "s5": ("dip_cidr", 5, "10.1.1.1")}
    answer = "array<struct<type:string,name:string,ip:string>>"
    rows = [("s1", 1, "b.example.com", [("A", None, "10.3.3.3"), ("CNAME", "A.example.com", None)]), ("s2", 1, "a.example.com.", None), ("s3", 1, None, [("CNAME", "a.example.com", None), ("AAAA", None, "2001:db8:0:0::1")])]
    got = {r.sensor: (r.probe, r.ioc_id) for r in lookups.dns_match(spark.createDataFrame(rows, f"sensor string, seq_num long, dns_name string, dns_answers {answer}"), table).collect()}
    assert got == {"s1": ("answer_cidr", 5), "s2": ("qname", 4), "s3": ("answer_name", 4)}
    rows = [(k, f"from 192.0.2.{k} end") for k in (1, 1, 2)]
    found = rules.regex_chain(spark.createDataFrame(rows, "seq_num long, message string"), [rules.Regex("ips", "[0-9.]+", "substring", "ip")], table)
    assert [tuple(r) for r in found.collect()] == [(1, "from 192.0.2.1 end", "ips", "192.0.2.1", 1)] * 2


def test_reputation_keeps_rows(spark):
    feed = spark.createDataFrame([("cidr_src", "r", 1, "2001:db8::/48", "six"), ("cidr_dst", "r", 2, "10.0.0.0/8", "ten")], "type string, report string, line long, cidr string, comment string")
    keys = spark.createDataFrame([("k1", "known"), ("", "no")], "hash_key string, comment string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "domain string")
    rows = [("s1", 7, "2001:db8:0:0:1::", "10.1.1.1", "", "", None), ("s2", 7, "1.1.1.1", "10.1.1.1", "k1", "", None), ("s3", 7, "1.1.1.1", "2.2.2.2", "k1", "", None), ("s4", 7, None, None, "", "k1", "x.bad.org"), ("s5", 7, None, None, "", "", "x.bad.org."), ("s6", 7, None, None, "", "", "ok.bad.org"), ("s7", 7, None, None, "", "", "fine.net")]
    events = spark.createDataFrame(rows, "sensor string, seq_num long, src_ip string, dst_ip string, hash_key string, ip_hash_key string, ioc_dns string")
    got = {r.sensor: (r.why, r.comment) for r in reputation.reputation(events, feed, keys, names("bad.org"), names("ok.bad.org")).collect()}
    assert got == {"s1": ("src_cidr", "six"), "s2": ("dst_cidr", "ten"), "s3": ("hash_key", "known"), "s4": ("ip_hash_key", "known"), "s5": ("domain", "DomainTable-DNS-bad.org")}


def test_longest_networks_of_many_lengths(spark):
    rnd = random.Random(4)
    nets = {f"{ipaddress.IPv4Network((rnd.randrange(4) << 30 | rnd.randrange(1 << 12) << 12, p), strict=False)}" for p in range(1, 33) for _ in range(6)}
    nets |= {f"{ipaddress.IPv6Network((0x20010DB8 << 96 | rnd.randrange(16) << 92, p), strict=False)}" for p in range(30, 60, 7)}
    table = iocs(spark, *(("cidr", None, None, n) for n in sorted(nets)))
    probes = [str(ipaddress.IPv4Address(rnd.randrange(4) << 30 | rnd.randrange(1 << 12) << 12 | rnd.randrange(64))) for _ in range(150)]
    probes += [str(ipaddress.IPv6Address(0x20010DB8 << 96 | rnd.randrange(16) << 92)) for _ in range(20)] + ["::1", "bad", None]
    parsed = {n: ipaddress.ip_network(n) for n in nets}
    want = {}
    for p in probes:
        try:
            ip = ipaddress.ip_address(p)
        except ValueError:
            continue
        inside = [n for n, x in parsed.items() if x.version == ip.version and ip in x]
        if inside:
            want[p] = max(inside, key=lambda n: parsed[n].prefixlen)
    rows = spark.createDataFrame([(p,) for p in dict.fromkeys(probes)], "ip string")
    got = {r.ip: r.entry.value for r in lookups.longest_prefix(rows, lookups.networks(table), "ip").collect()}
    assert got == want


def test_addresses_of_both_families(spark):
    rnd = random.Random(2)
    words = ["0", "00", "1", "db8", "ffff", "0db8", "abcd", "g", "", "12345"]
    texts = [":".join(rnd.choice(words[:7]) for _ in range(8)) for _ in range(60)] + [str(ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.getrandbits(128) & (-1 << 16 * rnd.randrange(8)))) for _ in range(60)]
    texts += [":".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(80)] + ["::", "::1", "1::", "::ffff:192.0.2.1", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::", ":1", "1:", "192.0.2.1", "::ffff:c0a8:1", "::ffff:999.1.1.1", "1.2.3", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, ip string")
    got = {r.k: (r.text, r.mapped) for r in rows.select("k", net.ip_normal(F.col("ip")).alias("text"), net.is_mapped(F.col("ip")).alias("mapped")).collect()}
    for k, t in enumerate(texts):
        try:
            ip = ipaddress.ip_address(t)
        except ValueError:
            ip = None
        mapped = ip is not None and ip.version == 6 and ip.ipv4_mapped is not None
        text = str(ipaddress.IPv6Address(int(ip)))  if mapped else str(ip)
        assert got[k][1] == mapped, t
        if ip is None:
            assert got[k][0] is None, t
        elif not mapped:
            assert got[k][0] == text, t
    pairs = [(str(ipaddress.IPv6Address(rnd.getrandbits(128))), str(ipaddress.IPv6Address(rnd.getrandbits(128)))) for _ in range(30)] + [("10.0.0.1", "255.0.255.0"), ("0.0.0.0", "::"), ("::", "0.0.0.0")]
    made = spark.createDataFrame(pairs, "a string, b string").select("a", "b", net.ip_hex(F.col("a")).alias("x"), net.ip_hex(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    for r in made.select("a", "b", net.ip_and(x, y).alias("both"), net.ip_or(x, y).alias("either"), net.ip_invert(x).alias("not"), net.ip_compare(x, y).alias("cmp"), net.is_all_zeros(x).alias("zeros"), net.in_network(F.col("a"), F.concat("b", F.lit("/1"))).alias("inside")).collect():
        a, b = ipaddress.ip_address(r.a), ipaddress.ip_address(r.b)
        width = 8 if a.version == 4 else 32
        same = a.version == b.version
        assert r["both"] == (f"{int(a) & int(b):0{width}x}" if same else None) and r.either == (f"{int(a) | int(b):0{width}x}" if same else None)
        assert r["not"] == f"{(1 << 4 * width) - 1 - int(a):0{width}x}" and r.zeros == (int(a) == 0)
        assert r.cmp == ((int(a) > int(b)) - (int(a) < int(b)) if same else (1 if a.version > b.version else -1))
        assert r.inside == (same and a in ipaddress.ip_network(f"{b}/1", strict=False))
    prefixes = spark.createDataFrame([(p, f) for p, f in [(0, 4), (13, 4), (32, 4), (0, 6), (61, 6), (128, 6), (33, 4)]], "p int, f int")
    for r in prefixes.select("p", "f", net.mask(F.col("p"), F.col("f")).alias("m")).collect():
        bits = 32 if r.f == 4 else 128
        assert r.m == (f"{((1 << bits) - 1) ^ ((1 << (bits - r.p)) - 1):0{bits // 4}x}" if r.p <= bits else None)


def test_names_of_a_caller_do_not_clash(spark):
    table = iocs(spark, ("ip", "192.0.2.1", None, None), ("cidr", None, None, "10.0.0.0/8"))
    names = ["__key", "__entry", "__base", "__digits_0", "__key_0", "__hit_0", "__hit_1", "key", "entry"]
    rows = [("192.0.2.1", "x", *names), ("1.1.1.1", "10.2.3.4", *names), ("2.2.2.2", None, *names)]
    events = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ["src_ip", "dst_ip", *names]))
    got = lookups.frame_match(events, table).orderBy("probe").collect()
    assert [(r.probe, r.ioc_id) for r in got] == [("dip_cidr", 2), ("sip", 1)]
    assert all(r[c] == c for r in got for c in names if c != "entry")
