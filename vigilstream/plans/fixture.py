"""Event and lookup tables for the registered queries, derived from the driver's tables by the same expressions in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Base columns, then the event's. ``{S}`` is the engine's name of the text type.
_BASE = (
    ("e", "event_id"),
    ("u", "user_id"),
    ("ts", "ts"),
    ("kind", "event_type"),
    ("amount", "value"),
    ("k", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"),
)
_MIDDLE = (
    ("proto", "CASE WHEN e % 97 = 0 THEN 47 WHEN e % 4 = 0 THEN 1 WHEN e % 4 = 2 THEN 17 ELSE 6 END"),
    ("told", "kind IN ('click', 'signup', 'error')"),
)
_EVENT = (
    ("seq_num", "e"),
    ("event_time", "ts"),
    ("sensor_name", "concat('sensor-', CAST(u % 4 AS {S}))"),
    ("self", "e % 10 = 0"),
    ("source", "CASE kind WHEN 'view' THEN 'pcap' WHEN 'click' THEN 'frame_ioc' WHEN 'signup' THEN 'dns_ioc' WHEN 'purchase' THEN 'udp_syslog' ELSE 'netflow_ioc' END"),
    ("ip_protocol", "proto"),
    ("src_ip", "concat('10.', CAST(u % 4 AS {S}), '.', CAST(u % 16 AS {S}), '.', CAST(u % 250 + 1 AS {S}))"),
    ("dst_ip", "concat('198.51.', CAST(e % 8 AS {S}), '.', CAST(k % 16 + 1 AS {S}))"),
    ("dst_port", "CASE WHEN proto IN (1, 47) THEN 0 ELSE CASE k % 5 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 514 ELSE 2055 END END"),
    ("src_port", "CASE WHEN proto IN (1, 47) THEN 0 ELSE CAST(1024 + u % 32 AS INT) END"),
    ("eth_type", "CASE WHEN e % 13 = 0 THEN 34525 ELSE 2048 END"),
    ("src_mac", "concat('02:00:00:00:00:', CAST(u % 90 + 10 AS {S}))"),
    ("dst_mac", "concat('02:00:00:00:00:', CAST(k % 90 + 10 AS {S}))"),
    ("src_asn", "CASE WHEN e % 5 = 0 THEN 0 ELSE 64512 + u % 8 END"),
    ("dst_asn", "64512 + k % 8"),
    ("ioc_id", "CASE WHEN told THEN 1000 + k ELSE 0 END"),
    ("ioc_type", "CASE WHEN told THEN CASE k % 3 WHEN 0 THEN 'ip' WHEN 1 THEN 'url' ELSE 'domain' END END"),
    ("ioc_threat_type", "CASE WHEN told THEN CASE k % 4 WHEN 0 THEN 'scan' WHEN 1 THEN 'botnet' WHEN 2 THEN 'phish' ELSE 'spam' END END"),
    ("ioc_value", "CASE WHEN NOT told THEN '' WHEN k % 3 = 0 THEN concat('203.0.113.', CAST(k % 16 + 1 AS {S})) WHEN k % 3 = 1 THEN concat('http://www.bad', CAST(k AS {S}), '.example.com/') ELSE concat('www.bad', CAST(k AS {S}), '.example.com') END"),
    ("ioc_ip", "CASE WHEN told AND k % 3 = 0 THEN concat('203.0.113.', CAST(k % 16 + 1 AS {S})) END"),
    ("ioc_dns", "CASE WHEN told AND k % 3 <> 0 THEN concat('www.bad', CAST(k AS {S}), '.example.com') END"),
    ("bytes", "CAST(floor(amount * 100) AS BIGINT)"),
)


def _select(columns: tuple, text: str) -> list[str]:
    return [f"{expr.format(S=text)} AS {name}" for name, expr in columns]


def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log_messages(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_log_messages(events: DataFrame) -> DataFrame:
    rows = events.selectExpr(*_select(_BASE, "STRING")).selectExpr("*", *_select(_MIDDLE, "STRING"))
    return rows.selectExpr(*_select(_EVENT, "STRING"))


#: Further columns of events, and events as flows and samples, for what writes them.
WIDE = (
    ("rule", "concat('rule-', CAST(seq_num % 3 AS {S}))"),
    ("port_id", "CAST(seq_num % 8 AS INT)"),
    ("direction", "CASE WHEN seq_num % 2 = 0 THEN 'rx' ELSE 'tx' END"),
    ("length", "CAST(60 + seq_num % 1000 AS INT)"),
    ("ip_ttl", "64"),
    ("l4_length", "CAST(seq_num % 500 AS INT)"),
    ("icmp_type", "CASE WHEN ip_protocol = 1 THEN 8 END"),
    ("icmp_code", "CASE WHEN ip_protocol = 1 THEN 0 END"),
    ("dns_name", "ioc_dns"),
    ("ioc_file_id", "CASE WHEN ioc_id <> 0 THEN ioc_id % 4 END"),
    ("message", "CASE WHEN source = 'udp_syslog' THEN concat('from ', src_ip) END"),
)
FLOWS = (
    *((c, c) for c in ("source", "seq_num", "src_ip", "dst_ip", "src_port", "dst_port", "bytes", "ioc_type", "ioc_threat_type", "ioc_ip", "ioc_value", "ioc_dns")),
    ("tag", "7"), ("protocol", "ip_protocol"), ("tcp_flags", "2"), ("tos", "0"), ("exporter", "sensor_name"), ("gateway_ip", "CASE WHEN seq_num % 2 = 0 THEN dst_ip END"),
    ("packets", "1 + seq_num % 9"), ("if_in", "1"), ("if_out", "2"), ("sys_uptime_ms", "seq_num * 1234"), ("unix_secs", "1700000000 + seq_num"), ("unix_nsecs", "seq_num * 1000"),
    ("version", "5"), ("flow_start", "seq_num * 1000 + 17"), ("flow_finish", "seq_num * 1000 + 999"), ("src_as", "src_asn"), ("src_mask", "8"), ("dst_as", "dst_asn"),
    ("dst_mask", "24"), ("engine_type", "0"), ("engine_id", "1"), ("ioc_id", "CASE WHEN ioc_id <> 0 THEN ioc_id END"),
)
SAMPLES = (
    ("source", "source"), ("seq_num", "seq_num"), ("source_ip", "src_ip"), ("agent_ip", "dst_ip"), ("agent_sub_id", "0"), ("packet_seq_num", "seq_num"), ("sys_up_time", "CAST(seq_num AS DOUBLE)"),
    ("sample_type", "'flow'"), ("sample_format", "1"), ("ds_type", "0"), ("ds_index", "3"), ("sample_rate", "512"), ("input_port", "3"), ("output_port", "4"), ("packet_length", "60 + seq_num % 100"),
    ("eth_type", "eth_type"), ("smac", "src_mac"), ("dmac", "dst_mac"), ("sip", "src_ip"), ("dip", "dst_ip"), ("natsip", "ioc_ip"), ("ip_protocol", "ip_protocol"), ("ttl", "64"),
    ("icmp_type", "8"), ("icmp_code", "0"), ("sport", "src_port"), ("dport", "dst_port"), ("tcp_flags", "2"), ("src_user", "CASE WHEN seq_num % 3 = 0 THEN 'someone' END"),
)


def derived(events: DataFrame, columns: tuple, keep: bool = False) -> DataFrame:
    return events.selectExpr(*(["*"] if keep else []), *_select(columns, "STRING"))


def derived_sql(columns: tuple, keep: bool = False) -> str:
    """The same as a table of SQL."""
    return f"(SELECT {'*, ' if keep else ''}{', '.join(_select(columns, 'VARCHAR'))} FROM lm)"


#: Connections as SQL; the separator is chr(31).
_CONNECTION = """CASE WHEN ioc_type = 'url' THEN 'url' WHEN ip_protocol = 1 THEN 'icmp' WHEN ip_protocol = 6 THEN 'tcp' WHEN ip_protocol = 17 THEN 'udp' END"""
_KEY = """CASE connection_type
  WHEN 'icmp' THEN concat('ICMP', chr(31), src_ip, chr(31), dst_ip, chr(31))
  WHEN 'url' THEN concat('URL', chr(31), regexp_extract(ioc_value, '^(https?://)?([^/]*)', 2), chr(31))
  ELSE concat(upper(connection_type), chr(31), src_ip, chr(31), dst_ip, chr(31), CAST(dst_port AS VARCHAR), chr(31)) END"""


def sql(query: str) -> str:
    """A query over ``lm`` (events) and ``c`` (events with a connection) as one SQL text."""
    return f"""WITH lm0 AS (SELECT {", ".join(_select(_BASE, "VARCHAR"))} FROM events),
lm1 AS (SELECT *, {", ".join(_select(_MIDDLE, "VARCHAR"))} FROM lm0),
lm AS (SELECT {", ".join(_select(_EVENT, "VARCHAR"))} FROM lm1),
c0 AS (SELECT *, {_CONNECTION} AS connection_type FROM lm),
c AS (SELECT *, {_KEY} AS hash_key, concat('IP', chr(31), src_ip, chr(31), dst_ip, chr(31)) AS ip_hash_key FROM c0 WHERE connection_type IS NOT NULL),
{_TABLES}
{query}"""


#: Indicators: file_id, line, id, type, threat_type, ip, dns, value.
IOCS = (
    (0, 1, 1, "ip", "scan", "198.51.3.4", None, None),
    (0, 2, 2, "ip", "botnet", "10.1.5.6", None, None),
    (0, 3, 3, "cidr", "scan", None, None, "198.51.0.0/16"),
    (0, 4, 4, "cidr", "spam", None, None, "198.51.3.0/24"),
    (0, 5, 5, "cidr", "spam", None, None, "10.2.0.0/15"),
    (0, 6, 6, "domain", "phish", None, "www.bad5.example.com", None),
    (0, 7, 7, "domain", "phish", None, "www.bad8.example.com.", None),
    (0, 8, 8, "url", "phish", None, None, "http://www.bad7.example.com/"),
    (0, 9, 9, "email", "spam", None, None, "user11@www.bad11.example.com"),
    (1, 1, 10, "ip", "late", "198.51.3.4", None, None),
    (1, 2, 11, "domain", "late", None, "www.bad5.example.com", None),
    (1, 3, 12, "cidr", "late", None, None, "198.51.3.128/25"),
)
#: Feeds: type, report, line, cidr, comment, created.
FEEDS = (
    ("cidr_src", "bogon", 1, "10.0.0.0/8", "context-line-1", "2024-01-01 00:00:00"),
    ("cidr_src", "bogon", 2, "10.3.0.0/16", "context-line-2", "2024-01-05 00:00:00"),
    ("cidr_dst", "drop", 1, "198.51.0.0/21", "SBL1", "2024-01-10 00:00:00"),
    ("cidr_dst", "drop", 2, "198.51.7.0/24", "SBL2", "2024-01-02 00:00:00"),
    ("cidr_dst", "drop", 3, "203.0.113.0/24", "SBL3", "2024-01-03 00:00:00"),
)
#: Keys that the connection table knows: hash_key, comment.
KEYS = (("URL\u001fwww.bad4.example.com\u001f", "known url"), ("IP\u001f10.1.5.6\u001f198.51.1.2\u001f", "known pair"), ("", "network"))
WHITE = (("example.org",), ("bad11.example.com",))
BLACK = (("bad5.example.com",), ("bad11.example.com",), ("bad8.example.com",))


def _table(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    """Rows that are part of the plan, so that their size is known without a job."""
    fields = [f.split() for f in schema.split(", ")]
    names = ", ".join(n for n, _ in fields)
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in fields)} FROM VALUES {body} AS t({names})")


def iocs(spark: SparkSession) -> DataFrame:
    return _table(spark, IOCS, "file_id long, line long, id long, type string, threat_type string, ip string, dns string, value string")


def feeds(spark: SparkSession) -> DataFrame:
    return _table(spark, FEEDS, "type string, report string, line long, cidr string, comment string, created_time string")


def keys(spark: SparkSession) -> DataFrame:
    return _table(spark, KEYS, "hash_key string, comment string")


def names(spark: SparkSession, rows: tuple) -> DataFrame:
    return _table(spark, rows, "domain string")


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return " || chr(31) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\u001f"))
    return str(x)


def values(name: str, rows: tuple, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


#: Lines of feed and indicator files, made of ``part``: number, text, and what is to come of them. ``{S}``: the text type.
_K = "p_partkey"
_K_HEX = "lower(hex(p_partkey % 65536))"
_NET = f"concat('198.51.', CAST({_K} % 8 AS {{S}}), '.', CAST({_K} * 16 % 256 AS {{S}}), '/', CAST(20 + {_K} % 9 AS {{S}}))"
_NET6 = f"concat('2001:db8:', {_K_HEX}, '::/', CAST(48 + {_K} % 17 AS {{S}}))"
FEED_LINES = (
    ("line", f"CAST({_K} AS BIGINT)"),
    ("cidr", f"CASE {_K} % 5 WHEN 1 THEN {_NET} WHEN 2 THEN {_NET6} WHEN 3 THEN concat('10.', CAST({_K} % 4 AS {{S}}), '.', CAST({_K} % 16 AS {{S}}), '.0/', CAST(16 + {_K} % 9 AS {{S}})) END"),
    ("drop_text", f"CASE {_K} % 5 WHEN 0 THEN '; head ; of' WHEN 4 THEN concat('10.0.0.0/', CAST(33 + {_K} % 9 AS {{S}}), ' ; none') ELSE concat(cidr, ' ; SBL', CAST({_K} AS {{S}}), ' ; x') END"),
    ("cidr_text", f"CASE {_K} % 5 WHEN 0 THEN '# head' WHEN 4 THEN concat('300.0.0.', CAST({_K} % 256 AS {{S}})) ELSE cidr END"),
    ("name", f"concat('n', CAST({_K} AS {{S}}), '.example', CAST({_K} % 7 AS {{S}}), '.org')"),
    ("rank_text", f"CASE {_K} % 5 WHEN 0 THEN concat('x,', name) WHEN 1 THEN concat(CAST({_K} AS {{S}}), ',', name, '/path,more') ELSE concat(CAST({_K} AS {{S}}), ',', name) END"),
    ("kind", f"CASE {_K} % 6 WHEN 0 THEN 'IP' WHEN 1 THEN 'url' WHEN 2 THEN 'Domain' WHEN 3 THEN 'cidr' WHEN 4 THEN 'email' ELSE 'md5' END"),
    ("address", f"concat('192.0.', CAST({_K} % 3 AS {{S}}), '.', CAST({_K} % 50 AS {{S}}))"),
    ("value", f"CASE {_K} % 6 WHEN 1 THEN concat('http://', name, '/a,b') WHEN 3 THEN {_NET} WHEN 4 THEN concat('user@', name) ELSE '' END"),
    ("ioc_text", f"CASE WHEN {_K} % 11 = 0 THEN concat('bad', CAST({_K} AS {{S}})) ELSE concat(CAST({_K} AS {{S}}), ',', kind, ',scan,', CASE WHEN kind = 'IP' THEN address ELSE '' END, ',', CASE WHEN kind = 'Domain' THEN name ELSE '' END, ',', value) END"),
)


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``FEED_LINES`` of the parts; a column may name those before it."""
    out = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    for name, expr in FEED_LINES:
        out = out.selectExpr("*", f"{expr.format(S='STRING')} AS {name}")
    return out


def feed_lines_sql(query: str) -> str:
    """A query over ``t``, the same as a table of SQL."""
    source = "(SELECT p_partkey FROM part)"
    for name, expr in FEED_LINES:
        source = f"(SELECT *, {expr.format(S='VARCHAR')} AS {name} FROM {source})"
    return f"WITH t AS (SELECT * FROM {source}) {query}"


_NUMBER = "CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)"


def number(ip: str) -> str:
    return f"({_NUMBER.format(ip)})"


_TABLES = ",\n".join(
    [
        values("iocs", IOCS, "file_id, line, id, type, threat_type, ip, dns, value"),
        values("feeds", FEEDS, "type, report, line, cidr, comment, created_time"),
        values("keys", KEYS, "hash_key, comment"),
        values("white", WHITE, "domain"),
        values("black", BLACK, "domain"),
        "ioc_ip_t AS (SELECT ip AS k, arg_min(id, file_id * 1000 + line) AS id FROM iocs WHERE type = 'ip' GROUP BY 1)",
        f"ioc_net_t AS (SELECT id, CAST(split_part(value, '/', 2) AS INT) AS plen, {number("split_part(value, '/', 1)")} AS lo FROM iocs WHERE type = 'cidr')",
        "ioc_name_t AS (SELECT rtrim(CASE type WHEN 'domain' THEN dns WHEN 'url' THEN regexp_extract(value, '^(https?://)?([^/]*)', 2) ELSE split_part(value, '@', 2) END, '.') || '.' AS k, arg_min(id, file_id * 1000 + line) AS id FROM iocs WHERE type IN ('domain', 'url', 'email') GROUP BY 1)",
        f"feed_t AS (SELECT *, CAST(split_part(cidr, '/', 2) AS INT) AS plen, {number("split_part(cidr, '/', 1)")} AS lo FROM feeds)",
    ]
)
