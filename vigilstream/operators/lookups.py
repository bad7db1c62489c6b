"""Indicator tables, and lookups of events in them.

Each event keeps its row: every probe adds the entry that it finds by a left join, and nothing is grouped, so events that
share a number stay apart and a lookup is one scan. A table is small beside the events and is broadcast while it has at
most ``HELD`` rows; beyond that the same joins shuffle.

Networks of both families are looked up by prefix length: an address is cut to each length that the table has, the
longest first, and met by an equi-join with the networks of that length. A table of more than ``LENGTHS`` lengths has its
networks cut into longer ones first, so that there are few (every eighth). Where several lookups have an order, the first
that hits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilstream.functions import net
from vigilstream.schema import MAX_ANSWERS

#: About 200 bytes a row.
HELD = 500_000
#: Prefix lengths of a family that are joined each by itself.
LENGTHS = 12
#: What names of helper columns end with; no caller's column has it.
_OWN = "\u0001"
_BASE, _ENTRY, _KEY, _DIGITS = (f"{x}{_OWN}" for x in ("base", "entry", "key", "digits"))


def held(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is small: by the optimiser's estimate where that tells, else by counting."""
    estimate = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = estimate <= HELD * 200 or table.limit(HELD + 1).count() <= HELD
    return F.broadcast(table) if small else table


def first_wins(iocs: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the first loaded."""
    by = Window.partitionBy(key).orderBy("file_id", "line")
    return iocs.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def _entry(iocs: DataFrame, kind: tuple[str, ...], key: Column) -> DataFrame:
    """key and entry (the indicator as a struct) of the indicators of these kinds, the first of each key."""
    rows = iocs.where(F.col("type").isin(*kind)).withColumn("key", key).where("key is not null and key <> ''")
    entry = F.struct(F.col("id").alias("ioc_id"), "file_id", "type", "threat_type", "ip", "dns", "value")
    return first_wins(rows, "key").select("key", entry.alias("entry"))


def exact_ips(iocs: DataFrame) -> DataFrame:
    """By the digits of the address, however it is written."""
    return _entry(iocs, ("ip",), net.ip_hex(F.col("ip")))


def domains(iocs: DataFrame) -> DataFrame:
    """Names of domain indicators, and hosts of URL and e-mail indicators, in canonical form."""
    name = F.when(F.col("type") == "domain", F.col("dns")).when(F.col("type") == "url", net.url_host(F.col("value")))
    return _entry(iocs, ("domain", "url", "email"), net.canonical_domain(name.otherwise(net.email_domain(F.col("value")))))


def urls(iocs: DataFrame) -> DataFrame:
    return _entry(iocs, ("url",), F.col("value"))


def emails(iocs: DataFrame) -> DataFrame:
    return _entry(iocs, ("email",), F.col("value"))


def networks(iocs: DataFrame) -> DataFrame:
    """family, prefix, base and entry of network indicators."""
    rows = _entry(iocs, ("cidr",), F.col("value"))
    rows = rows.withColumn("x", net.network_parts(F.col("key"))).where("x is not null").select("x.family", "x.prefix", "x.base", "entry")
    by = Window.partitionBy("family", "prefix", "base").orderBy("entry.file_id", "entry.ioc_id")
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def lookup(probes: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Probes whose key the table has, with ``entry``."""
    return probes.join(held(table), probes[key] == table["key"], how).drop("key")


def _ladder(table: DataFrame, lengths: list[tuple[int, int]]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Networks cut to every eighth length, the longest original one of each, if there are many lengths."""
    if all(sum(f == family for f, _ in lengths) <= LENGTHS for family in (4, 6)):
        return table, lengths
    step = F.greatest(F.lit(8), (F.ceil(F.col("prefix") / 8) * 8).cast("int"))
    free = step - F.col("prefix")
    # The last digits of the longer networks: the base's own bits with all that may follow them.
    digits = F.rpad("base", F.floor(step / 4).cast("int"), F.lit("0"))
    tail = F.conv(F.right(digits, F.lit(2)), 16, 10).cast("int")
    more = F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), free) - 1)).alias("more")
    rows = table.select("family", "prefix", "entry", step.alias("step"), digits.alias("digits"), tail.alias("tail"), more)
    base = F.concat(F.left("digits", F.length("digits") - 2), F.lpad(F.lower(F.hex((F.col("tail") + F.col("more")).cast("long"))), 2, "0"))
    rows = rows.groupBy("family", F.col("step").alias("prefix"), base.alias("base")).agg(F.max_by("entry", F.col("prefix")).alias("entry"))
    return rows, sorted({(f, max(8, -(-p // 8) * 8)) for f, p in lengths})


class Networks:
    """A table of networks (family, prefix, base, entry), ready for probes."""

    def __init__(self, table: DataFrame):
        # Lengths are 33 and 129 whole numbers at most, so they go into the plan.
        lengths = sorted((r.family, r.prefix) for r in table.select("family", "prefix").distinct().collect())
        table, self.lengths = _ladder(table, lengths)
        self.tables = {(f, p): held(table.where((F.col("family") == f) & (F.col("prefix") == p)).select(F.col("base").alias(_BASE), F.col("entry").alias(_ENTRY))) for f, p in self.lengths}
        self.type = table.schema["entry"].dataType

    def probe(self, rows: DataFrame, digits: str, out: str) -> DataFrame:
        """Rows with the entry of the longest network that the address (its digits) lies in, or null, as ``out``."""
        found = []
        for k, (family, prefix) in enumerate(reversed(self.lengths)):
            side = self.tables[family, prefix]
            key = F.when(F.length(digits) == (8 if family == 4 else 32), net.cut(F.col(digits), prefix))
            rows = rows.join(side, key == side[_BASE], "left").drop(_BASE).withColumnRenamed(_ENTRY, f"{out}{k}{_OWN}")
            found.append(f"{out}{k}{_OWN}")
        entry = F.coalesce(*found) if found else F.lit(None).cast(self.type)
        return rows.withColumn(out, entry).drop(*found)


def longest_prefix(probes: DataFrame, table: DataFrame, ip: str) -> DataFrame:
    """Probes whose address lies in a network, with the longest one's ``entry``."""
    rows = Networks(table).probe(probes.withColumn(_DIGITS, net.ip_hex(F.col(ip))), _DIGITS, "entry")
    return rows.where("entry is not null").drop(_DIGITS)


def priority(events: DataFrame, probes: list[tuple[str, str, Column]], iocs: DataFrame) -> DataFrame:
    """The events that one of the probes (name, table, value) hits, with the first one's name (``probe``), ``ioc_id`` and ``entry``.

    Tables: ip, cidr, domain, url, email.
    """
    tables = {"ip": exact_ips, "domain": domains, "url": urls, "email": emails}
    known: dict = {}
    rows, order, digits = events, [], {}
    for k, (name, table, value) in enumerate(probes):
        if table in ("ip", "cidr"):
            text = str(value)
            if text not in digits:
                digits[text] = f"digits{k}{_OWN}"
                rows = rows.withColumn(digits[text], net.ip_hex(value.cast("string")))
            key = digits[text]
        else:
            key = f"key{k}{_OWN}"
            rows = rows.withColumn(key, value.cast("string"))
        if table not in known:
            known[table] = Networks(networks(iocs)) if table == "cidr" else held(tables[table](iocs).withColumnsRenamed({"key": _KEY, "entry": _ENTRY}))
        if table == "cidr":
            rows = known[table].probe(rows, key, f"hit{k}{_OWN}")
        else:
            rows = rows.join(known[table], F.col(key) == known[table][_KEY], "left").drop(_KEY).withColumnRenamed(_ENTRY, f"hit{k}{_OWN}")
        order.append((name, f"hit{k}{_OWN}"))
    probe = F.coalesce(*[F.when(F.col(hit).isNotNull(), F.lit(name)) for name, hit in order])
    entry = F.coalesce(*[F.col(hit) for _, hit in order])
    out = rows.select(*[F.col(c) for c in events.columns], probe.alias("probe"), entry.alias("entry")).where("probe is not null")
    return out.withColumn("ioc_id", F.col("entry.ioc_id"))


def frame_match(events: DataFrame, iocs: DataFrame) -> DataFrame:
    """Source exact, source network, destination exact, destination network."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    return priority(_told_apart(events), [("sip", "ip", src), ("sip_cidr", "cidr", src), ("dip", "ip", dst), ("dip_cidr", "cidr", dst)], iocs)


def netflow_match(flows: DataFrame, iocs: DataFrame, addresses: tuple[str, ...] = ("agent_ip", "src_ip", "dst_ip", "gateway_ip")) -> DataFrame:
    """Exporter, source, destination, gateway; within each the network goes before the exact address."""
    return priority(_told_apart(flows), [(f"{a}{s}", t, F.col(a)) for a in addresses for s, t in (("_cidr", "cidr"), ("", "ip"))], iocs)


def dns_match(messages: DataFrame, iocs: DataFrame) -> DataFrame:
    """The name asked for, then each answer in turn: its name, its address, its address's network.

    Messages are laid out by question and answer, each with the message's row; only what hits is brought together again.
    """
    messages = _told_apart(messages)
    answers = F.coalesce("dns_answers", F.array().cast("array<struct<type:string,name:string,ip:string>>"))
    head = F.struct(F.lit(0).alias("order"), net.canonical_domain(F.col("dns_name")).alias("name"), F.lit(None).cast("string").alias("ip"))
    others = F.transform(F.slice(answers, 1, MAX_ANSWERS), lambda a, i: F.struct((i + 1).alias("order"), net.canonical_domain(a["name"]).alias("name"), a["ip"].alias("ip")))
    rows = messages.withColumn("__row", F.monotonically_increasing_id()).withColumn("__x", F.explode(F.concat(F.array(head), others)))
    rows = priority(rows, [("name", "domain", F.col("__x.name")), ("ip", "ip", F.col("__x.ip")), ("cidr", "cidr", F.col("__x.ip"))], iocs)
    probe = F.when(F.col("__x.order") == 0, F.lit("qname")).otherwise(F.concat(F.lit("answer_"), "probe"))
    found = F.struct(*[F.col(c) for c in messages.columns], probe.alias("probe"), "entry", "ioc_id")
    return rows.groupBy("__row").agg(F.min_by(found, F.col("__x.order")).alias("x")).select("x.*")


def sflow_match(samples: DataFrame, iocs: DataFrame) -> DataFrame:
    """Five addresses (exact, then network, each), the host, the URL's host, the URL."""
    probes = [(f"{a}{s}", t, F.col(a)) for a in ("sip", "dip", "natsip", "natdip", "next_hop") for s, t in (("", "ip"), ("_cidr", "cidr"))]
    probes += [("host", "domain", net.canonical_domain(F.col("host"))), ("url_host", "domain", net.canonical_domain(net.url_host(F.col("url")))), ("url", "url", F.col("url"))]
    return priority(_told_apart(samples), probes, iocs)


def _told_apart(events: DataFrame) -> DataFrame:
    """Without what an earlier lookup has added."""
    return events.drop("probe", "entry")
