"""Both address families in packet filters, DNS rules and feeds; networks as a sorted table finds them."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from vigilstream.operators import feeds, reputation, rules

ADDRESSES = ["2001:db8::1", "2001:0DB8:0:0::1", "2001:db9::1", "10.9.0.1", "192.0.2.7", "::ffff:10.9.0.1", "fe80::1", None, "", "nonsense"]


def hits(spark, text):
    rows = spark.createDataFrame([(k, a, "10.0.0.9", 6, 0x86DD if a and ":" in a else 0x0800) for k, a in enumerate(ADDRESSES)], "seq_num long, src_ip string, dst_ip string, ip_protocol int, eth_type int")
    return [r.seq_num for r in rows.where(rules.packet_filter(text)).orderBy("seq_num").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("net 2001:db8::/32", [0, 1]),
        ("not src net 2001:db8::/32", [2, 3, 4, 5, 6, 7, 8, 9]),
        ("src net 2001:db8::/31", [0, 1, 2]),
        ("host 2001:db8:0::1", [0, 1]),
        ("src host 10.9.0.1", [3]),
        ("src net 10.9.0.5/16 or host fe80:0::1", [3, 6]),
        ("src net ::/0", [0, 1, 2, 5, 6]),
        ("src net 0.0.0.0/0", [3, 4]),
        ("ip6 and tcp src net 2001:db8::/32", [0, 1]),
    ],
)
def test_packet_filters(spark, text, want):
    assert hits(spark, text) == want


@pytest.mark.parametrize("text", ["net 2001:db8::/129", "host example", "net 10.0.0.0/33", "host"])
def test_what_is_no_address(text, spark):
    with pytest.raises(ValueError):
        rules.packet_filter(text)


def test_dns_rules(spark):
    answers = "dns_answers array<struct<type:string,name:string,ip:string>>"
    rows = spark.createDataFrame([(1, "a.example", [("AAAA", "a.example", "2001:DB8::0:5")]), (2, "b.example", [("A", "b.example", "10.0.0.1")]), (3, None, None)], f"n long, dns_name string, {answers}")
    got = rules.dns_chain(rows, [("six", None, "2001:db8::5"), ("four", None, "10.0.0.1"), ("name", "B.", None)])
    assert sorted((r.n, r.rule) for r in got.collect()) == [(1, "six"), (2, "four"), (2, "name")]


def test_feeds(spark):
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(["; head", "2001:db8::/32 ; SBL1", "10.0.0.0/8 ; SBL2", "10.0.0.0/33 ; none", "nothing", "2001:db8::/129 ; none", "2001:db8::1 ; host"])], "line long, text string")
    assert [(r.cidr, r.comment) for r in feeds.drop_list(lines).orderBy("line").collect()] == [("2001:db8::/32", "SBL1"), ("10.0.0.0/8", "SBL2"), ("2001:db8::1", "host")]
    assert [r.line for r in feeds.drop_rejects(lines).orderBy("line").collect()] == [3, 4, 5]
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(["# head", " 2001:db8::/32 ", "10.0.0.0/8", "x", "; y"])], "line long, text string")
    assert [(r.cidr, r.comment) for r in feeds.cidr_list(lines).orderBy("line").collect()] == [("2001:db8::/32", "context-line-1"), ("10.0.0.0/8", "context-line-2")]
    assert [r.line for r in feeds.cidr_rejects(lines).collect()] == [3]


def test_an_indicator_line_without_fields_after_a_shuffle(spark):
    """Conditions that are tried in another order find no field missing."""
    lines = spark.createDataFrame([(0, 1, "bad"), (0, 2, "1,ip,scan,10.0.0.1,,"), (0, 3, "x,ip,scan,10.0.0.2,,"), (0, 4, "99999999999999999999,ip,a,b,c,d")], "file_id long, line long, text string")
    good, bad = feeds.ioc_lines(lines)
    assert [r.id for r in good.where("ip IS NOT NULL AND ip <> ''").collect()] == [1] and sorted(r.line for r in bad.collect()) == [1, 3, 4]


def test_floor_of_networks(spark):
    rnd = random.Random(3)
    nets = [f"{rnd.choice([10, 11, 198])}.{rnd.randrange(3)}.{rnd.randrange(4) * 64}.0/{rnd.choice([0, 7, 8, 12, 16, 17, 18, 24, 32])}" for _ in range(40)]
    nets = [str(ipaddress.ip_network(n, strict=False)) for n in nets]
    rows = [("cidr_src", n, f"c {n}", "r") for n in nets] + [("cidr_dst", "10.0.0.0/9", "other", "r"), ("cidr_src", "2001:db8::/32", "six", "r"), ("cidr_src", "bad", "bad", "r")]
    table = spark.createDataFrame(rows, "type string, cidr string, comment string, report string")
    ips = [f"{rnd.choice([9, 10, 11, 198, 255])}.{rnd.randrange(4)}.{rnd.randrange(256)}.{rnd.randrange(256)}" for _ in range(200)] + [None, "x", "2001:db8::1"] + ["10.0.0.1"] * 50
    events = spark.createDataFrame([(k, ip, "mine", 5) for k, ip in enumerate(ips)], "seq_num long, src_ip string, comment string, bits int")
    bits = {}
    for n in set(nets):
        net = ipaddress.ip_network(n)
        bits[f"{int(net.network_address):032b}"[: net.prefixlen]] = n
    want = []
    for k, ip in enumerate(ips):
        if ip and ip.count(".") == 3:
            address = f"{int(ipaddress.ip_address(ip)):032b}"
            floor = max((b for b in bits if b <= address), default=None)
            if floor is not None and address.startswith(floor):
                want.append((k, bits[floor]))
    got = reputation.by_floor(events, table, "src")
    assert got.columns == ["seq_num", "src_ip", "bits", "comment", "cidr"]
    assert sorted((r.seq_num, r.cidr) for r in got.collect()) == want and want
    longest = reputation.by_network(events, table, "src")
    assert longest.count() > got.count()  # a longer network before an address hides the one around both
    assert all(r.comment == f"c {r.cidr}" for r in got.where(F.col("cidr").isNotNull()).collect())
