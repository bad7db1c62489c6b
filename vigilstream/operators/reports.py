"""Reports: envelopes, their JSON, the latest of each statement, chart ranges, and text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilstream.functions.keys import US
from vigilstream.functions.times import interval_format


def window_envelopes(statement: str, rows: DataFrame, fields: tuple[str, ...], time: str = "window_start") -> DataFrame:
    """One report a window: statement, time, size and entries in the order of rank."""
    entry = F.struct(F.col("rank").alias("__rank"), *fields)
    out = rows.groupBy(F.col(time).alias("time")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    out = out.withColumn("entries", F.transform("entries", lambda e: F.struct(*[e[f].alias(f) for f in fields])))
    return out.select(F.lit(statement).alias("statement"), "time", F.size("entries").alias("size"), "entries")


def event_envelopes(statement: str, rows: DataFrame, fields: tuple[str, ...], time: str) -> DataFrame:
    """One report an event."""
    entries = F.array(F.struct(*fields))
    return rows.select(F.lit(statement).alias("statement"), F.col(time).alias("time"), F.lit(1).alias("size"), entries.alias("entries"))


def numbered(envelopes: DataFrame, first: int = 0) -> DataFrame:
    """With a running id over all reports, by time (nulls first) and statement. Reports are numbered within minutes, and minutes follow each other."""
    rows = envelopes.withColumn("__minute", F.floor(F.col("time").cast("double") / 60))
    # Rows of the offsets are minutes that have reports: half a million a year.
    so_far = Window.orderBy("__minute").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__minute").agg(F.count("*").alias("n")).select(F.col("__minute").alias("__of"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__minute").orderBy("time", "statement")).cast("long")
    met = rows.withColumn("id", at).join(before, F.col("__minute").eqNullSafe(F.col("__of")))
    return met.withColumn("id", F.col("id") + F.col("__before") + (first - 1)).drop("__minute", "__of", "__before")


def to_json(envelopes: DataFrame, pretty: bool = False) -> DataFrame:
    """Reports as JSON without null fields."""
    options = {"ignoreNullFields": "true", "pretty": str(pretty).lower()}
    return envelopes.select("statement", "time", F.concat(F.to_json(F.struct(*envelopes.columns), options), F.lit("\n")).alias("json"))


def latest(envelopes: DataFrame) -> DataFrame:
    """The last report of each statement."""
    fields = [c for c in envelopes.columns if c != "statement"]
    return envelopes.groupBy("statement").agg(F.max_by(F.struct(*fields), "time").alias("x")).select("statement", "x.*")


def chart_ranges(rows: DataFrame, value: str = "scount", time: str = "window_start") -> DataFrame:
    """The axis of each report's chart: 0.90 of the least value to 1.05 of the greatest."""
    out = rows.groupBy(time).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return out.select(time, (F.col("a") * F.lit(0.90)).alias("y_min"), (F.col("b") * F.lit(1.05)).alias("y_max"))


def ikey(events: DataFrame) -> Column:
    """Source, indicator type, value, threat type, type, number and severity, as far as they are there."""
    number = F.when(F.coalesce("ioc_id", F.lit(0)) != 0, F.concat(F.lit("ID "), F.col("ioc_id").cast("string")))
    return F.concat_ws(" ", "source", "ioc_type", "ioc_value", "ioc_threat_type", "ioc_type", number, F.lit("SEV Unknown"))


def readable_key(key: Column) -> Column:
    return F.translate(key, US, " ")


def lm_projection(events: DataFrame) -> DataFrame:
    """The short form of an event: the indicator's value, address and name in one field."""
    value = F.concat_ws(", ", F.nullif("ioc_value", F.lit("")), "ioc_ip", "ioc_dns")
    return events.select("seq_num", "source", "sensor_name", "src_ip", "dst_ip", "ioc_id", "ioc_type", value.alias("ioc_value"), "hash_key")


#: Names of an event's JSON fields, and the columns that fill them.
HEAD = (("source", "source"), ("rule", "rule"), ("seq_num", "seq_num"))
ETHERNET = (("port_id", "port_id"), ("direction", "upper(direction)"), ("self", "CAST(self AS INT)"), ("length", "length"), ("eth_type", "eth_type"), ("smac", "src_mac"), ("dmac", "dst_mac"))
IP = (
    ("sip", "src_ip"), ("dip", "dst_ip"), ("ip_protocol", "ip_protocol"), ("ttl", "ip_ttl"), ("l4_length", "l4_length"), ("icmp_type", "icmp_type"),
    ("icmp_code", "icmp_code"), ("sport", "src_port"), ("dport", "dst_port"), ("dns_name", "dns_name"),
)
INDICATOR = (("file_id", "ioc_file_id"), ("ioc_id", "ioc_id"), ("type", "upper(ioc_type)"), ("threat_type", "ioc_threat_type"), ("ip", "ioc_ip"), ("value", "ioc_value"), ("dns", "ioc_dns"))
#: The same of a flow.
FLOW = (
    ("source", "source"), ("seq_num", "seq_num"), ("tag", "tag"), ("flow_sec", "flow_sec"), ("flow_usec", "flow_usec"), ("ip_protocol", "protocol"),
    ("tcp_flags", "tcp_flags"), ("ip_tos", "tos"), ("agentip", "exporter"), ("sip", "src_ip"), ("sport", "src_port"), ("dip", "dst_ip"), ("dport", "dst_port"),
    ("gatewayip", "gateway_ip"), ("packets", "packets"), ("bytes", "bytes"), ("sifindex", "if_in"), ("difindex", "if_out"),
    ("sys_uptime_sec", "sys_uptime_ms DIV 1000"), ("sys_uptime_msec", "sys_uptime_ms % 1000"), ("sys_time_sec", "unix_secs"), ("sys_time_nsec", "unix_nsecs"),
    ("netflow_version", "version"), ("flow_start_sec", "flow_start DIV 1000"), ("flow_start_msec", "flow_start % 1000"), ("flow_stop_sec", "flow_finish DIV 1000"),
    ("flow_stop_msec", "flow_finish % 1000"), ("src_as", "src_as"), ("src_masklen", "src_mask"), ("dst_as", "dst_as"), ("dst_masklen", "dst_mask"),
    ("engine_type", "engine_type"), ("engine_id", "engine_id"), ("source_id", "source_id"), ("crc32", "crc32"),
)
#: The same of a sample; what is named otherwise in it.
SAMPLE = (
    ("source", "source"), ("seq_num", "seq_num"), ("source_ip", "source_ip"), *((c, c) for c in (
        "agent_ip", "agent_sub_id", "packet_seq_num", "sys_up_time", "sample_type", "sample_format", "sample_seq_num", "ds_type", "ds_index", "sample_rate",
        "sample_pool", "drop_count", "input_port", "output_port", "sample_protocol", "packet_length", "stripped_length", "header_length", "eth_type", "smac",
        "dmac", "rx_vlan", "tx_vlan", "sip", "dip", "natsip", "natdip", "ip_protocol", "ip_length", "ttl", "l4_length",
    )), ("icmp_type", "CASE WHEN ip_protocol IN (1, 58) THEN icmp_type END"), ("icmp_code", "CASE WHEN ip_protocol IN (1, 58) THEN icmp_code END"),
    ("sport", "CASE WHEN ip_protocol NOT IN (1, 58) THEN sport END"), ("dport", "CASE WHEN ip_protocol NOT IN (1, 58) THEN dport END"),
    ("natsport", "natsport"), ("natdport", "natdport"), ("tcp_flags", "CASE WHEN ip_protocol = 6 THEN tcp_flags END"), ("src_user", "src_user"), ("dst_user", "dst_user"),
)


def _made(rows: DataFrame, fields: tuple[tuple[str, str], ...]) -> Column:
    """JSON of the fields whose columns the rows have; nulls are left out."""
    has = set(rows.columns)
    there = [F.expr(e).alias(name) for name, e in fields if _columns(e) <= has]
    return F.to_json(F.struct(*there))


def _columns(expression: str) -> set[str]:
    words = set(re.findall(r"[a-z_0-9]*[a-z][a-z_0-9]*", expression))
    return words - {"upper"}


def event_json(events: DataFrame) -> DataFrame:
    """seq_num and the event as JSON, with the fields of its source: frames, frames with an indicator, or messages.

    A column that ``events`` lacks is left out, and so is what is null.
    """
    source = F.col("source")
    message = _made(events, (*HEAD, *IP, ("message", "message"), *INDICATOR))
    ioc, frame = _made(events, (*HEAD, *ETHERNET, *IP, *INDICATOR)), _made(events, (*HEAD, *ETHERNET, *IP))
    text = F.when(source.endswith("_syslog"), message).when(source.endswith("_ioc"), ioc).otherwise(frame)
    return events.select("seq_num", text.alias("json"))


def flow_json(flows: DataFrame) -> DataFrame:
    """seq_num and the flow as JSON; with an indicator's columns, its fields too."""
    return flows.select("seq_num", _made(flows, (*FLOW, *INDICATOR)).alias("json"))


def sample_json(samples: DataFrame) -> DataFrame:
    """seq_num and the sample as JSON; with an indicator's columns, its fields too."""
    return samples.select("seq_num", _made(samples, (*SAMPLE, *INDICATOR)).alias("json"))


def reputation_text(found: DataFrame) -> DataFrame:
    """seq_num and the lines told of an event that a connection table or a name list knows; empty ones are left out.

    Of ``reputation``'s rows: event_time, source, hash_key, why and comment are read; ``cidr`` and ``known_key`` if they are there.
    """
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"    {name.ljust(7)} "), c))
    other = lambda name: F.col(name) if name in found.columns else F.lit(None).cast("string")
    time = F.coalesce(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("Unknown"))
    lines = [
        F.concat(F.lit("Conn Table detected reputation based threat from ["), F.col("source"), F.lit("]:")), line("time", time), line("type", F.col("why")), line("cidr", other("cidr")),
        line("comment", F.col("comment")), line("skey", readable_key(F.col("hash_key"))), line("ikey", ikey(found)), line("mkey", readable_key(other("known_key"))),
        line("url", F.when(F.col("ioc_type") == "url", F.col("ioc_value"))),
    ]
    return found.select("seq_num", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("text"))


def chart_fields(statement: str, fields: tuple[str, ...]) -> tuple[str, str] | None:
    """The fields along (x) and up (y) of a statement's chart: y is the one named for bytes, sessions or counts; None if it has no chart."""
    up = [f for f in fields if re.search("bytes|sessions|count", f, re.I)]
    along = [f for f in fields if f not in up]
    return (along[0], up[0]) if statement.endswith("Top") and up and along else None


def flow_text(flows: DataFrame) -> DataFrame:
    """A flow as one line of text."""
    named = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name} "), c.cast("string")))
    ends = F.concat(F.lit("["), "src_ip", F.lit("]:"), "src_port", F.lit(" -> ["), "dst_ip", F.lit("]:"), "dst_port")
    line = F.concat_ws(" ", F.lit("FLOW"), named("tag", F.col("tag")), named("proto", F.col("protocol")), ends, named("packets", F.col("packets")), named("octets", F.col("bytes")), F.concat(F.lit("uptime "), interval_format(F.col("uptime"))))
    return flows.select("seq_num", line.alias("line"))
