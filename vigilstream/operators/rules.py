"""Rule chains: packet filters, DNS rules, and regular expressions, compiled to Column expressions."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilstream.functions import net
from vigilstream.operators import lookups

_TOKEN = re.compile(r"\s*(\(|\)|!|&&|\|\||[^\s()!]+)")
#: Protocol numbers by name.
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17, "icmp6": 58}


def _is_host(ip: Column, text: str) -> Column:
    """Whether an address is this one; IPv6 addresses are compared by their digits, however they are written."""
    address = ipaddress.ip_address(text)
    return ip == str(address) if address.version == 4 else net.ip_hex(ip) == address.packed.hex()


def _in_net(ip: Column, text: str) -> Column:
    """Whether an address lies in this network; a network of one family holds no address of the other."""
    inside = ipaddress.ip_network(text, strict=False)
    if inside.version == 4:
        return net.net_match(ip, F.lit(str(inside)))
    digits, first, last = net.ip_hex(ip), inside.network_address.packed.hex(), inside.broadcast_address.packed.hex()
    return (F.length(digits) == len(first)) & digits.between(first, last)


def packet_filter(text: str) -> Column:
    """A packet filter expression: ip, ip6, arp, protocols, [src|dst] host, net and port, and, or, not, parentheses.

    Hosts and networks may be of either family; an address or network that is none is an error.
    """
    words = _TOKEN.findall(text)
    at = 0

    def peek() -> str | None:
        return words[at].lower() if at < len(words) else None

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise ValueError(f"filter ends too early: {text}")
        at += 1
        return words[at - 1].lower()

    def either() -> Column:
        out = both()
        while peek() in ("or", "||"):
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = unit()
        while peek() in ("and", "&&"):
            take()
            out = out & unit()
        return out

    def unit() -> Column:
        word = take()
        if word in ("not", "!"):
            return ~unit()
        if word == "(":
            out = either()
            if take() != ")":
                raise ValueError(f"parenthesis isn't closed: {text}")
            return out
        if word in PROTOCOLS:
            out = F.col("ip_protocol") == PROTOCOLS[word]
            return out & term("") if peek() in ("port", "src", "dst", "host", "net") else out
        if word in ("ip", "ip6", "arp"):
            return F.col("eth_type") == {"ip": 0x0800, "ip6": 0x86DD, "arp": 0x0806}[word]
        return term(word)

    def term(word: str) -> Column:
        word = word or take()
        sides = ("src", "dst")
        if word in sides:
            sides, word = (word,), take()
        if word == "port":
            value = int(take())
            found = [F.col(f"{s}_port") == value for s in sides]
        elif word == "host":
            value = take()
            found = [_is_host(F.col(f"{s}_ip"), value) for s in sides]
        elif word == "net":
            value = take()
            found = [_in_net(F.col(f"{s}_ip"), value) for s in sides]
        else:
            raise ValueError(f"unknown word {word} in {text}")
        out = found[0]
        for f in found[1:]:
            out = out | f
        return F.coalesce(out, F.lit(False))

    out = either()
    if at < len(words):
        raise ValueError(f"{words[at]} isn't expected in {text}")
    return F.coalesce(out, F.lit(False))


def pcap_chain(events: DataFrame, rules: list[dict]) -> DataFrame:
    """A row for each event and each rule it matches."""
    hits = F.array_compact(F.array(*[F.when(packet_filter(r["filter"]), F.lit(r["name"])) for r in rules]))
    return events.withColumn("rule", F.explode(hits))


def dns_chain(messages: DataFrame, rules: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """A row for each message and rule (name, dns, ip) it matches: part of a name in any case, or an answer's address.

    The rules are a configuration's short list, so each is a condition of the plan and nothing is joined.
    """
    answers = F.coalesce("dns_answers", F.array().cast("array<struct<type:string,name:string,ip:string>>"))
    names = F.transform(F.array_compact(F.concat(F.array(F.col("dns_name")), F.transform(answers, lambda a: a["name"]))), F.lower)
    rows, hits = messages.withColumn("__names", names).withColumn("__ips", F.transform(answers, lambda a: a["ip"])), []
    for name, dns, ip in rules:
        hit = F.lit(False)
        if dns is not None:
            part = dns.lower()
            hit = hit | F.exists("__names", lambda n: n.contains(part))
        if ip is not None:
            hit = hit | F.coalesce(F.exists("__ips", lambda x: _is_host(x, ip)), F.lit(False))
        hits.append(F.when(hit, F.lit(name)))
    return rows.withColumn("rule", F.explode(F.array_compact(F.array(*hits)))).drop("__names", "__ips")


@dataclass(frozen=True)
class Regex:
    """A regular-expression rule; ``kind``: complete (the message matches) or substring (matches are looked up as ``ioc_type``)."""

    name: str
    pattern: str
    kind: str = "complete"
    ioc_type: str | None = None
    nocase: bool = True
    inverted: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.nocase else self.pattern


def regex_complete(text: Column, rule: Regex) -> Column:
    hit = text.rlike(rule.java)
    return ~hit if rule.inverted else hit


def regex_first_match(messages: DataFrame, rules: list[Regex], text: str = "message") -> DataFrame:
    """The first complete rule that each message matches."""
    name = F.coalesce(*[F.when(regex_complete(F.col(text), r), F.lit(r.name)) for r in rules])
    return messages.withColumn("rule", name).where("rule is not null")


def regex_chain(messages: DataFrame, rules: list[Regex], iocs: DataFrame, text: str = "message") -> DataFrame:
    """The messages that a rule hits, with the first such ``rule``: a complete one by matching, a substring one by its first ``token`` in the table (``ioc_id``)."""
    messages = messages.drop("rule", "token", "ioc_id")
    every = []
    for k, r in enumerate(rules):
        if r.kind == "complete":
            hit = F.when(regex_complete(F.col(text), r), F.array(F.struct(F.lit(k).alias("rule_at"), F.lit(0).alias("token_at"), F.lit(None).cast("string").alias("token"))))
        else:
            hit = _tokens(F.regexp_extract_all(F.col(text), F.lit(r.java), F.lit(0)), k)
        every.append(F.coalesce(hit, F.array().cast("array<struct<rule_at:int,token_at:int,token:string>>")))
    # Tokens are looked up with their message's row; only what hits is brought together again.
    rows = messages.withColumn("__row", F.monotonically_increasing_id()).withColumn("__x", F.explode(F.concat(*every)))
    tables = {"ip": lookups.exact_ips, "domain": lookups.domains, "url": lookups.urls, "email": lookups.emails}
    token, found = F.col("__x.token"), []
    for kind in sorted({r.ioc_type for r in rules if r.kind != "complete"}):
        of = [k for k, r in enumerate(rules) if r.kind != "complete" and r.ioc_type == kind]
        value = net.canonical_domain(token) if kind == "domain" else net.ip_hex(token) if kind == "ip" else token
        side = lookups.held(tables[kind](iocs).select(F.col("key").alias("__key"), F.col("entry.ioc_id").alias("__ioc")))
        rows = rows.join(side, F.when(F.col("__x.rule_at").isin(of), value) == side["__key"], "left").drop("__key").withColumnRenamed("__ioc", f"__ioc_{kind}")
        found.append(f"__ioc_{kind}")
    ioc = F.coalesce(*found) if found else F.lit(None).cast("long")
    rows = rows.withColumn("ioc_id", ioc).where("ioc_id is not null or __x.token is null")
    names = F.array(*[F.lit(r.name) for r in rules])
    hit = F.struct(*[F.col(c) for c in messages.columns], F.element_at(names, F.col("__x.rule_at") + 1).alias("rule"), token.alias("token"), "ioc_id")
    return rows.groupBy("__row").agg(F.min_by(hit, F.struct("__x.rule_at", "__x.token_at")).alias("x")).select("x.*")


def _tokens(tokens: Column, rule: int) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(F.lit(rule).alias("rule_at"), i.alias("token_at"), t.alias("token")))


def rule_counts(matched: DataFrame) -> DataFrame:
    """How often each rule matched."""
    return matched.groupBy("rule").agg(F.count("*").alias("matches"))
