"""Connections derived from events, and their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilstream.functions.net import url_host

#: Fixed value: the separator within keys.
US = "\u001f"
#: Protocols that make a connection.
PROTOCOLS = ((1, "icmp"), (6, "tcp"), (17, "udp"))


def _key(*parts: Column | str) -> Column:
    """Parts, each followed by the separator; null parts are empty."""
    columns = [F.coalesce(F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*[x for c in columns for x in (c, F.lit(US))])


def connection_type(ioc_type: Column, ip_protocol: Column) -> Column:
    """url, icmp, tcp or udp; null where the event makes no connection."""
    out = F.when(ioc_type == "url", F.lit("url"))
    for number, name in PROTOCOLS:
        out = out.when(ip_protocol == number, F.lit(name))
    return out


def hash_key(kind: Column, src: Column, dst: Column, port: Column, host: Column, query: Column | None = None, query_type: Column | None = None) -> Column:
    """The key of a connection: networks have an empty one."""
    # The kind is named as seldom as can be: plans repeat its expression wherever it is named.
    port = F.when(kind.isin("tcp", "udp"), _key(port)).otherwise(F.lit(""))
    body = F.when(kind == "url", _key(host))
    if query is not None:
        body = body.when(kind == "dns", _key(query, F.upper(query_type)))
    whole = F.concat(F.upper(kind), F.lit(US), body.otherwise(F.concat(_key(src, dst), port)))
    return F.when(kind.startswith("cidr"), F.lit("")).otherwise(whole)


def ip_hash_key(src: Column, dst: Column) -> Column:
    """The key by addresses alone, whatever the kind of connection."""
    return _key("IP", src, dst)


def parse_hash_key(key: Column) -> Column:
    """Kind and parts of a key; the port of tcp and udp is left out; null for networks and what is no key."""
    part = F.split(key, US)
    kind = F.lower(part[0])
    two = kind.isin("ip", "icmp", "tcp", "udp")
    fields = (
        kind.alias("kind"),
        F.when(two, F.get(part, F.lit(1))).alias("src_ip"),
        F.when(two, F.get(part, F.lit(2))).alias("dst_ip"),
        F.when(kind == "url", F.get(part, F.lit(1))).alias("url_host"),
        F.when(kind == "dns", F.get(part, F.lit(1))).alias("dns_query"),
    )
    return F.when(kind.isin("ip", "icmp", "tcp", "udp", "url", "dns") & key.contains(US), F.struct(*fields))


def escaped(key: Column) -> Column:
    """With the separator as readable text."""
    return F.replace(key, F.lit(US), F.lit("\\u001F"))


def string_hash(text: Column) -> Column:
    """The 32-bit hash h = 31 h + unit over the text's UTF-16 units (for text of the basic plane)."""
    step = lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32))
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: step(h, c).cast("long"))
    return F.when(text.isNotNull(), F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int"))


def with_connection(events: DataFrame, drop_unconnected: bool = True) -> DataFrame:
    """Adds ``connection_type``, ``hash_key`` and ``ip_hash_key``; events without a connection go unless asked otherwise."""
    kind = connection_type(F.col("ioc_type"), F.col("ip_protocol"))
    out = events.withColumn("connection_type", kind)
    key = hash_key(F.col("connection_type"), F.col("src_ip"), F.col("dst_ip"), F.col("dst_port"), url_host(F.col("ioc_value")))
    out = out.withColumn("hash_key", key).withColumn("ip_hash_key", ip_hash_key(F.col("src_ip"), F.col("dst_ip")))
    return out.where(F.col("connection_type").isNotNull()) if drop_unconnected else out
