"""The operators as registered queries over the driver's tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilstream.functions import keys as K
from vigilstream.functions import net, strings, times
from vigilstream.operators import correlation, counting, feeds, lookups, reports, rules, windows
from vigilstream.operators import reputation as rep
from vigilstream.plans import fixture as fx
from vigilstream.sources import events as ev
from vigilstream.sources import flows, frames, replay, samples, sflow
from vigilstream.shipping import ship
from vigilstream.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DAY, DAY_S = "1 day", 86400


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # HotSpot compiles no method of more bytes; stages beyond are better generated expression by expression.
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return build(ship(spark), sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return build

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.log_messages(spark, sf_dir)


def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_connection(lm(spark, sf_dir))


# Rankings: counts by window and key, and the ten largest.

_ANCHOR = "(SELECT min(epoch_us(event_time)) FROM c)"


def _window_sql(seconds: int) -> str:
    """The start of windows that begin with the first event, in seconds."""
    micros = seconds * 1_000_000
    return f"CAST(floor((epoch_us(event_time) - {_ANCHOR} - (epoch_us(event_time) - {_ANCHOR}) % {micros} + {_ANCHOR}) / 1000000) AS BIGINT)"


def _ranking_rows(r: windows.Ranking, seconds: int) -> str:
    """Counts of a ranking: window_start, keys, scount."""
    window = _window_sql(seconds)
    where = r.where + (" AND NOT self" if r.not_self else "")
    names = ", ".join(r.keys)
    shown = "printf('0x%04x', eth_type & 65535) AS eth_type" if r.shown else names
    if r.name == "src_port":
        return f"""SELECT window_start, ip_protocol, src_port, max(n) AS scount FROM (
          SELECT {window} AS window_start, ip_protocol, src_port, count(*) OVER (PARTITION BY {window}, src_port ORDER BY event_time, seq_num ROWS UNBOUNDED PRECEDING) AS n
          FROM c WHERE {where}) GROUP BY 1, 2, 3"""
    return f"SELECT window_start, {shown}, scount FROM (SELECT {window} AS window_start, {names}, count(*) AS scount FROM c WHERE {where} GROUP BY ALL)"


def _ranking_sql(r: windows.Ranking, n: int | None, seconds: int = 60) -> str:
    counted, names = _ranking_rows(r, seconds), ", ".join(r.keys)
    if n is None:
        return fx.sql(counted)
    order = f"row_number() OVER (PARTITION BY window_start ORDER BY scount DESC, {names})"
    return fx.sql(f"SELECT *, {order} AS rank FROM ({counted}) QUALIFY {order} <= {n}")


_FIRST: dict[tuple, int | None] = {}


def _anchored(s: SparkSession, d: str, size: str) -> tuple[DataFrame, str]:
    """Events, and the start of windows that begin with the first of them. Statements of one session share the first event, as those of one deployment do; it is looked for again when the table's files change."""
    events = connected(s, d)
    files = s._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    system = files.getFileSystem(s._jsc.hadoopConfiguration())
    state = tuple((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in system.listStatus(files))
    key = (s.sparkContext.applicationId, state)
    if key not in _FIRST:
        _FIRST[key] = windows.first_micros(events)
    return events, windows.offset(_FIRST[key], size)


def _top(s: SparkSession, d: str, r: windows.Ranking, size: str = windows.WINDOW) -> DataFrame:
    events, start = _anchored(s, d, size)
    return windows.top(events, r, size, 10, start=start)


def _sum(s: SparkSession, d: str, r: windows.Ranking, size: str = windows.WINDOW) -> DataFrame:
    events, start = _anchored(s, d, size)
    return windows.counts(events, r, size, start=start)


def _rate(s: SparkSession, d: str) -> DataFrame:
    events, start = _anchored(s, d, windows.WINDOW)
    return windows.rate(events, start=start)


# Windows of a minute from the first event on, as statements have them; of a day, where a key stands in many rows.
for _r in windows.RANKINGS:
    _query(f"{_r.name}_top", _ranking_sql(_r, 10))(lambda s, d, r=_r: _top(s, d, r))
    _query(f"{_r.name}_sum", _ranking_sql(_r, None))(lambda s, d, r=_r: _sum(s, d, r))
    _query(f"{_r.name}_top_day", _ranking_sql(_r, 10, DAY_S))(lambda s, d, r=_r: _top(s, d, r, DAY))


def _all_tops_sql(seconds: int) -> str:
    """The rankings one by one, and the rate."""
    parts = []
    for r in windows.RANKINGS:
        names = ", ".join(r.keys)
        counted = _ranking_rows(r, seconds)
        key = f"CAST({r.keys[-1]} AS VARCHAR)"
        protocol = "CAST(ip_protocol AS INTEGER)" if len(r.keys) == 2 else "CAST(NULL AS INTEGER)"
        parts.append(f"SELECT '{r.name}' AS statement, window_start, rank, {key} AS key, {protocol} AS protocol, scount, CAST(NULL AS DOUBLE) AS rate FROM (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY scount DESC, {names}) AS INTEGER) AS rank FROM ({counted})) WHERE rank <= 10")
    window = _window_sql(seconds)
    parts.append(f"""SELECT 'rate', window_start, NULL, NULL, NULL, coalesce(n, 0), coalesce(n, 0) / {seconds}.0::DOUBLE
      FROM (SELECT unnest(range(a, b + 1, {seconds})) AS window_start FROM (SELECT min(w) AS a, max(w) AS b FROM (SELECT {window} AS w FROM c)))
      LEFT JOIN (SELECT {window} AS w, count(*) AS n FROM c GROUP BY 1) ON w = window_start""")
    return fx.sql("\nUNION ALL ".join(parts))


def _all_tops(s: SparkSession, d: str, size: str) -> DataFrame:
    events, start = _anchored(s, d, size)
    return counting.all_tops(events, size, start=start)


_query("all_tops", _all_tops_sql(60))(lambda s, d: _all_tops(s, d, windows.WINDOW))
_query("all_tops_day", _all_tops_sql(DAY_S))(lambda s, d: _all_tops(s, d, DAY))

_query("rate_per_minute", fx.sql(f"""SELECT window_start, CAST(60000 AS BIGINT) AS window_ms, coalesce(n, 0) AS scount, coalesce(n, 0) / 60.0::DOUBLE AS rate
FROM (SELECT unnest(range(a, b + 1, 60)) AS window_start FROM (SELECT min(w) AS a, max(w) AS b FROM (SELECT {_window_sql(60)} AS w FROM c)))
LEFT JOIN (SELECT {_window_sql(60)} AS w, count(*) AS n FROM c GROUP BY 1) ON w = window_start"""))(_rate)  # fmt: skip

_query("tumbling_60s", fx.sql("SELECT seq_num, (CAST(floor(epoch(event_time)) AS BIGINT) // 60) * 60 AS window_start, (CAST(floor(epoch(event_time)) AS BIGINT) // 60) * 60 + 60 AS window_end FROM c"))(
    lambda s, d: windows.tumbling(connected(s, d)).select("seq_num", "window_start", "window_end")
)

def _correlation_sql(seconds: int) -> str:
    """Windows walked through event by event of each key; the whole first and last event are told by some of their fields."""
    fields = ", ".join(f"arg_{m}({c}, n) AS {name}_{c}" for m, name in (("min", "first"), ("max", "last")) for c in ("seq_num", "source", "dst_port", "ioc_value"))
    return fx.sql(f"""SELECT * FROM (
  WITH RECURSIVE r AS (SELECT *, ip_hash_key AS key, epoch_us(event_time) // 1000 AS t, row_number() OVER (PARTITION BY ip_hash_key ORDER BY epoch_us(event_time) // 1000, seq_num) AS n FROM c WHERE NOT self),
  w AS (SELECT key, n, t AS start FROM r WHERE n = 1 UNION ALL SELECT r.key, r.n, CASE WHEN r.t >= w.start + {seconds * 1000} THEN r.t ELSE w.start END FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
  SELECT w.key, w.start AS window_start, {fields.replace(", n)", ", w.n)")}, count(*) AS repeat_count FROM w JOIN r ON r.key = w.key AND r.n = w.n GROUP BY 1, 2)""")


def _correlation(s: SparkSession, d: str, seconds: int) -> DataFrame:
    told = ("seq_num", "source", "dst_port", "ioc_value")
    found = correlation.correlation(connected(s, d), seconds, columns=told)
    fields = [F.col(f"{w}_event.{c}").alias(f"{w}_{c}") for w in ("first", "last") for c in told]
    return found.select("key", "window_start", *fields, "repeat_count")


_query("correlation", _correlation_sql(60))(lambda s, d: _correlation(s, d, 60))
_query("correlation_hours", _correlation_sql(6 * 3600))(lambda s, d: _correlation(s, d, 6 * 3600))

_query("seq_gap", fx.sql("SELECT sensor_name, seq_num, p AS previous, seq_num - p - 1 AS missing FROM (SELECT sensor_name, seq_num, lag(seq_num) OVER (PARTITION BY sensor_name ORDER BY seq_num) AS p FROM lm) WHERE seq_num - p > 1"))(lambda s, d: windows.seq_gaps(lm(s, d)))
_query("queue_numbers", fx.sql("SELECT seq_num, sensor_name, row_number() OVER (PARTITION BY sensor_name ORDER BY event_time, seq_num) AS queue_num FROM lm"))(lambda s, d: windows.queue_numbers(lm(s, d).select("seq_num", "sensor_name", "event_time")).drop("event_time"))
_OWN = ("198.51.1.3", "198.51.2.5", "2001:db8::5")
_DST = "CASE WHEN seq_num % 5 = 0 THEN concat('2001:DB8:0::', CAST(seq_num % 10 AS {0})) ELSE dst_ip END"
_KIND = "CASE WHEN ip_protocol = 17 AND dst_port = 53 THEN 'dns' WHEN ip_protocol = 17 AND dst_port = 514 THEN 'syslog' WHEN ip_protocol = 17 AND dst_port = 2055 THEN 'netflow' WHEN ip_protocol = 6 AND dst_port = 514 THEN 'syslog' WHEN ip_protocol = 6 AND dst_port = 53 THEN 'dns_logged' WHEN ip_protocol = 6 AND dst_port = 2055 THEN 'netflow_logged' END"
_query("self_guard", fx.sql(f"""SELECT * FROM (SELECT seq_num, {_KIND} AS kind, CASE WHEN seq_num % 5 = 0 THEN seq_num % 10 = 5 ELSE dst_ip IN ('198.51.1.3', '198.51.2.5') END AS self FROM lm)
WHERE self OR coalesce(kind, 'dns') IN ('dns', 'dns_logged')"""))(
    lambda s, d: frames.guarded(lm(s, d).select("seq_num", frames.port_dispatch(F.col("ip_protocol"), F.col("dst_port")).alias("kind"), frames.is_self(F.expr(_DST.format("STRING")), _OWN).alias("self")))
)
_query("filter_conj", fx.sql("SELECT seq_num FROM lm WHERE NOT self AND ip_protocol = 6 AND dst_port <> 0"))(lambda s, d: lm(s, d).where("NOT self AND ip_protocol = 6 AND dst_port <> 0").select("seq_num"))
_query("filter_isset", fx.sql("SELECT seq_num FROM lm WHERE ioc_value IS NOT NULL AND ioc_value <> '' AND ioc_id <> 0"))(lambda s, d: lm(s, d).where("ioc_value IS NOT NULL AND ioc_value <> '' AND coalesce(ioc_id, 0) <> 0").select("seq_num"))

# Keys and scalar functions.

_query("connection_derive", fx.sql("SELECT seq_num, connection_type FROM c0"))(lambda s, d: K.with_connection(lm(s, d), False).select("seq_num", "connection_type"))
_query("hash_key", fx.sql("SELECT seq_num, hash_key FROM c"))(lambda s, d: connected(s, d).select("seq_num", "hash_key"))
_query("ip_hash_key", fx.sql("SELECT seq_num, ip_hash_key FROM c"))(lambda s, d: connected(s, d).select("seq_num", "ip_hash_key"))
_query("parse_hash_key", fx.sql("""SELECT seq_num, connection_type AS kind, CASE WHEN connection_type <> 'url' THEN src_ip END AS src_ip, CASE WHEN connection_type <> 'url' THEN dst_ip END AS dst_ip,
CASE WHEN connection_type = 'url' THEN regexp_extract(ioc_value, '^(https?://)?([^/]*)', 2) END AS url_host FROM c"""))(
    lambda s, d: connected(s, d).select("seq_num", K.parse_hash_key(F.col("hash_key")).alias("x")).select("seq_num", "x.kind", "x.src_ip", "x.dst_ip", "x.url_host")
)
_query("hash_lm", fx.sql("""SELECT seq_num, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INT) AS h FROM (
SELECT seq_num, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(hash_key, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM c)"""))(
    lambda s, d: connected(s, d).select("seq_num", K.string_hash(F.col("hash_key")).alias("h"))
)
_query("lower_upper", fx.sql("SELECT seq_num, lower(ioc_value) AS low, upper(ioc_value) AS up FROM lm"))(lambda s, d: lm(s, d).select("seq_num", F.lower("ioc_value").alias("low"), F.upper("ioc_value").alias("up")))
_query("ip_to_long", fx.sql(f"SELECT seq_num, {fx.number('src_ip')} AS n FROM lm"))(lambda s, d: lm(s, d).select("seq_num", net.ip_to_long(F.col("src_ip")).alias("n")))
_query("long_to_ip", fx.sql("SELECT seq_num, concat_ws('.', CAST(n >> 24 AS VARCHAR), CAST((n >> 16) & 255 AS VARCHAR), CAST((n >> 8) & 255 AS VARCHAR), CAST(n & 255 AS VARCHAR)) AS ip FROM (SELECT seq_num, (seq_num * 2654435761) % 4294967296 AS n FROM lm)"))(
    lambda s, d: lm(s, d).select("seq_num", net.long_to_ip((F.col("seq_num") * 2654435761) % 4294967296).alias("ip"))
)
_query("net_match", fx.sql(f"SELECT seq_num, {fx.number('dst_ip')} BETWEEN {fx.number(repr('198.51.0.0'))} AND {fx.number(repr('198.51.3.255'))} AS inside FROM lm"))(
    lambda s, d: lm(s, d).select("seq_num", net.net_match(F.col("dst_ip"), F.lit("198.51.0.0/22")).alias("inside"))
)
_query("cidr_bits", fx.sql(f"SELECT seq_num, left(lpad(bin({fx.number('src_ip')}), 32, '0'), CAST(seq_num % 33 AS INT)) AS bits FROM lm"))(
    lambda s, d: lm(s, d).select("seq_num", net.cidr_bits(F.col("src_ip"), (F.col("seq_num") % 33).cast("int")).alias("bits"))
)
_query("cidr_parse", fx.sql(f"SELECT seq_num, n - n % (1::BIGINT << (32 - p)) AS lo, n - n % (1::BIGINT << (32 - p)) + (1::BIGINT << (32 - p)) - 1 AS hi, p AS prefix FROM (SELECT seq_num, {fx.number('dst_ip')} AS n, CAST(seq_num % 33 AS INT) AS p FROM lm)"))(
    lambda s, d: lm(s, d).select("seq_num", net.cidr_parts(F.concat("dst_ip", F.lit("/"), (F.col("seq_num") % 33).cast("string"))).alias("x")).select("seq_num", F.col("x.start").alias("lo"), F.col("x.end").alias("hi"), "x.prefix")
)
_IP6 = "concat('20010db8', repeat('0', 8))"
_query("ip_parse", fx.sql(f"""SELECT seq_num, CAST(CASE WHEN seq_num % 2 = 0 THEN 6 ELSE 4 END AS INT) AS family, CASE WHEN seq_num % 2 = 0 THEN concat({_IP6}, repeat('0', 16)) ELSE printf('%08x', {fx.number('src_ip')}) END AS start,
CASE WHEN seq_num % 2 = 0 THEN concat({_IP6}, repeat('f', 16)) ELSE printf('%08x', {fx.number('src_ip')}) END AS "end", CAST(CASE WHEN seq_num % 2 = 0 THEN 64 ELSE 32 END AS INT) AS prefix FROM lm"""))(lambda s, d: lm(s, d).select("seq_num", net.ip_range(F.when(F.col("seq_num") % 2 == 0, F.concat(F.lit("2001:db8::"), (F.col("seq_num") % 9999).cast("string"), F.lit("/64"))).otherwise(F.col("src_ip"))).alias("x")).select("seq_num", "x.*"))
_query("ip_normal", fx.sql("SELECT seq_num, CASE WHEN seq_num = 0 THEN '2001:db8::' WHEN seq_num < 65536 THEN concat('2001:db8::', lower(hex(seq_num))) END AS ip FROM lm"))(lambda s, d: lm(s, d).select("seq_num", net.ip_normal(F.concat(F.lit("2001:DB8:0:0:0:0:0:"), F.hex("seq_num"))).alias("ip")))
_query("ip_masks", fx.sql(f"""SELECT seq_num, printf('%08x', n - n % 256) AS low, printf('%08x', n - n % 256 + 255) AS high, printf('%08x', 4294967295 - n) AS inverted, CAST(sign(m - n) AS INT) AS compared
FROM (SELECT seq_num, {fx.number('dst_ip')} AS n, {fx.number('src_ip')} AS m FROM lm)"""))(
    lambda s, d: lm(s, d).select("seq_num", net.ip_hex(F.col("src_ip")).alias("a"), net.ip_hex(F.col("dst_ip")).alias("b"), net.mask(F.lit(24), F.lit(4)).alias("m")).select("seq_num", net.ip_and(F.col("b"), F.col("m")).alias("low"), net.ip_or(F.col("b"), net.ip_invert(F.col("m"))).alias("high"), net.ip_invert(F.col("b")).alias("inverted"), net.ip_compare(F.col("a"), F.col("b")).alias("compared"))
)
_query("mac_format", fx.sql("SELECT seq_num, regexp_replace(lower(lpad(hex(seq_num), 12, '0')), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS mac FROM lm"))(
    lambda s, d: lm(s, d).select("seq_num", net.mac_format(F.unhex(F.lpad(F.hex("seq_num"), 12, "0"))).alias("mac"))
)
_query("tcp_flags_format", fx.sql("SELECT seq_num, concat(" + ", ".join(f"CASE WHEN (seq_num & {bit}) <> 0 THEN '{name} ' ELSE '' END" for bit, name in net.TCP_FLAGS) + ") AS flags FROM lm"))(
    lambda s, d: lm(s, d).select("seq_num", net.tcp_flags_format(F.col("seq_num")).alias("flags"))
)
_query("sflow_port_id", fx.sql("SELECT seq_num, (n >> 30) & 3 AS format, n & 1073741823 AS value FROM (SELECT seq_num, (seq_num * 2654435761) % 4294967296 AS n FROM lm)"))(
    lambda s, d: lm(s, d).select("seq_num", net.sflow_port((F.col("seq_num") * 2654435761) % 4294967296).alias("x")).select("seq_num", "x.*")
)
_query("interval_format", fx.sql("""SELECT seq_num, concat(CASE WHEN n // 31449600 > 0 THEN concat(CAST(n // 31449600 AS VARCHAR), 'y') ELSE '' END, CASE WHEN n % 31449600 // 604800 > 0 THEN concat(CAST(n % 31449600 // 604800 AS VARCHAR), 'w') ELSE '' END,
CASE WHEN n % 604800 // 86400 > 0 THEN concat(CAST(n % 604800 // 86400 AS VARCHAR), 'd') ELSE '' END, CASE WHEN n % 86400 // 3600 > 0 THEN concat(CAST(n % 86400 // 3600 AS VARCHAR), 'h') ELSE '' END,
CASE WHEN n % 3600 // 60 > 0 THEN concat(CAST(n % 3600 // 60 AS VARCHAR), 'm') ELSE '' END, CAST(n % 60 AS VARCHAR), 's') AS text FROM (SELECT seq_num, seq_num * 12347 AS n FROM lm)"""))(
    lambda s, d: lm(s, d).select("seq_num", times.interval_format(F.col("seq_num") * 12347).alias("text"))
)
_query("flow_times", fx.sql("SELECT seq_num, CAST(round(seq_num * 1000 + bytes / 1000.0::DOUBLE) AS BIGINT) AS flow, seq_num * 1000 + bytes AS started, CAST(round(seq_num * 1000 + bytes / 1000000.0::DOUBLE) AS BIGINT) AS sys FROM lm"))(
    lambda s, d: lm(s, d).select("seq_num", times.flow_millis(F.col("seq_num"), F.col("bytes")).alias("flow"), times.millis(F.col("seq_num"), F.col("bytes")).alias("started"), times.sys_millis(F.col("seq_num"), F.col("bytes")).alias("sys"))
)
_query("reverse_domain", "SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '^(https?://)?([^/]*)', 2), '.')), '.') AS rdomain FROM pages")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", net.reverse_domain(net.url_host(F.col("url"))).alias("rdomain"))
)
_query("url_host", "SELECT page_id, nullif(regexp_extract(url, '(?i)^(https?://)?([^/]*)', 2), '') AS host FROM pages")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", net.url_host(F.col("url")).alias("host")))
_query("url_encode", fx.sql("SELECT seq_num, replace(replace(ioc_value, ':', '%3A'), '/', '%2F') AS text FROM lm"))(lambda s, d: lm(s, d).select("seq_num", net.url_encode(F.col("ioc_value")).alias("text")))
_query("email_domain", fx.sql("SELECT seq_num, concat('bad', CAST(ioc_id AS VARCHAR), '.example.com') AS domain FROM lm"))(
    lambda s, d: lm(s, d).select("seq_num", net.email_domain(F.concat(F.lit("user@bad"), F.col("ioc_id").cast("string"), F.lit(".example.com"))).alias("domain"))
)
_query("xpath", fx.sql("SELECT seq_num, sensor_name AS text, CAST(seq_num AS DOUBLE) AS number FROM lm"))(
    lambda s, d: lm(s, d).withColumn("x", F.concat(F.lit("<e><s>"), "sensor_name", F.lit("</s><n>"), F.col("seq_num").cast("string"), F.lit("</n></e>"))).select("seq_num", strings.xpath_string(F.col("x"), "e/s").alias("text"), strings.xpath_number(F.col("x"), "e/n").alias("number"))
)
_query("string_helpers", """SELECT p_partkey, length(trim(p_name)) > 0 AS has_text, replace(p_name, ' ', '') AS squeezed, len(string_split(p_name, 'a')) - 1 AS times_a, concat(upper(left(p_name, 1)), substr(p_name, 2)) AS capitalized,
string_split(p_name, ' ')[-1] AS last_part FROM part""")(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", strings.has_text(F.col("p_name")).alias("has_text"), strings.delete(F.col("p_name"), " ").alias("squeezed"), strings.count_occurrences(F.col("p_name"), "a").cast("long").alias("times_a"), strings.capitalize(F.col("p_name")).alias("capitalized"), strings.unqualify(F.col("p_name"), " ").alias("last_part"))
)

# Indicator lookups.

def _net_hit(name: str, column: str) -> str:
    return f"LEFT JOIN (SELECT ip, arg_max(id, plen) AS id FROM (SELECT DISTINCT {column} AS ip FROM lm) JOIN ioc_net_t ON {fx.number('ip')} BETWEEN lo AND lo + (1::BIGINT << (32 - plen)) - 1 GROUP BY ip) {name} ON {name}.ip = lm.{column}"


def _ip_hit(name: str, column: str) -> str:
    return f"LEFT JOIN ioc_ip_t {name} ON {name}.k = lm.{column}"


def _first(pairs: list[tuple[str, str]]) -> str:
    """probe and ioc_id of the first hit among (probe, alias)."""
    probe = " ".join(f"WHEN {a}.id IS NOT NULL THEN '{p}'" for p, a in pairs)
    return f"CASE {probe} END AS probe, coalesce({', '.join(f'{a}.id' for _, a in pairs)}) AS ioc_id"


_query("ioc_exact_ip", fx.sql(f"SELECT seq_num, a.id AS ioc_id FROM lm {_ip_hit('a', 'dst_ip')} WHERE a.id IS NOT NULL"))(
    lambda s, d: lookups.lookup(lm(s, d).select("seq_num", net.ip_hex(F.col("dst_ip")).alias("ip")), lookups.exact_ips(fx.iocs(s)), "ip").select("seq_num", "entry.ioc_id")
)
_query("ioc_cidr_lpm", fx.sql(f"SELECT seq_num, a.id AS ioc_id FROM lm {_net_hit('a', 'dst_ip')} WHERE a.id IS NOT NULL"))(
    lambda s, d: lookups.longest_prefix(lm(s, d).select("seq_num", "dst_ip"), lookups.networks(fx.iocs(s)), "dst_ip").select("seq_num", "entry.ioc_id")
)
_FRAME = [("sip", "a"), ("sip_cidr", "b"), ("dip", "c1"), ("dip_cidr", "d1")]
_query("ioc_frame_match", fx.sql(f"SELECT seq_num, {_first(_FRAME)} FROM lm {_ip_hit('a', 'src_ip')} {_net_hit('b', 'src_ip')} {_ip_hit('c1', 'dst_ip')} {_net_hit('d1', 'dst_ip')} WHERE coalesce(a.id, b.id, c1.id, d1.id) IS NOT NULL"))(
    lambda s, d: lookups.frame_match(lm(s, d).select("seq_num", "src_ip", "dst_ip"), fx.iocs(s)).select("seq_num", "probe", "ioc_id")
)
_FLOW = [("src_ip_cidr", "b"), ("src_ip", "a"), ("dst_ip_cidr", "d1"), ("dst_ip", "c1")]
_query("ioc_netflow_match", fx.sql(f"SELECT seq_num, {_first(_FLOW)} FROM lm {_ip_hit('a', 'src_ip')} {_net_hit('b', 'src_ip')} {_ip_hit('c1', 'dst_ip')} {_net_hit('d1', 'dst_ip')} WHERE coalesce(a.id, b.id, c1.id, d1.id) IS NOT NULL"))(
    lambda s, d: lookups.netflow_match(lm(s, d).select("seq_num", "src_ip", "dst_ip"), fx.iocs(s), ("src_ip", "dst_ip")).select("seq_num", "probe", "ioc_id")
)
_query("ioc_domain", fx.sql("SELECT seq_num, t.id AS ioc_id FROM lm JOIN ioc_name_t t ON t.k = ioc_dns || '.'"))(
    lambda s, d: lookups.lookup(lm(s, d).select("seq_num", net.canonical_domain(F.col("ioc_dns")).alias("name")), lookups.domains(fx.iocs(s)), "name").select("seq_num", "entry.ioc_id")
)
_query("ioc_url", fx.sql("SELECT seq_num, iocs.id AS ioc_id FROM lm JOIN iocs ON iocs.type = 'url' AND iocs.value = lm.ioc_value"))(lambda s, d: lookups.lookup(lm(s, d).select("seq_num", "ioc_value"), lookups.urls(fx.iocs(s)), "ioc_value").select("seq_num", "entry.ioc_id"))
_query("ioc_email", fx.sql("SELECT seq_num, iocs.id AS ioc_id FROM lm JOIN iocs ON iocs.type = 'email' AND iocs.value = concat('user', CAST(ioc_id - 1000 AS VARCHAR), '@', ioc_dns)"))(
    lambda s, d: lookups.lookup(lm(s, d).select("seq_num", F.concat(F.lit("user"), (F.col("ioc_id") - 1000).cast("string"), F.lit("@"), "ioc_dns").alias("mail")), lookups.emails(fx.iocs(s)), "mail").select("seq_num", "entry.ioc_id")
)


def _dns(s: SparkSession, d: str) -> DataFrame:
    """Messages that ask for the indicator's name, with one named answer and one address."""
    nothing = F.lit(None).cast("string")
    answer = lambda kind, name, ip: F.struct(F.lit(kind).alias("type"), name.alias("name"), ip.alias("ip"))
    named = F.concat(F.lit("www.bad"), (F.col("seq_num") % 16).cast("string"), F.lit(".example.com"))
    return lm(s, d).select("seq_num", F.col("ioc_dns").alias("dns_name"), F.array(answer("CNAME", named, nothing), answer("A", nothing, F.col("dst_ip"))).alias("dns_answers"))


_DNS_SQL = f"SELECT lm.seq_num, {_first([('qname', 'q'), ('answer_name', 'n'), ('answer_ip', 'a'), ('answer_cidr', 'b')])} FROM lm LEFT JOIN ioc_name_t q ON q.k = ioc_dns || '.' LEFT JOIN ioc_name_t n ON n.k = concat('www.bad', CAST(seq_num % 16 AS VARCHAR), '.example.com.') {_ip_hit('a', 'dst_ip')} {_net_hit('b', 'dst_ip')} WHERE coalesce(q.id, n.id, a.id, b.id) IS NOT NULL"
_query("ioc_dns_match", fx.sql(_DNS_SQL))(lambda s, d: lookups.dns_match(_dns(s, d), fx.iocs(s)).select("seq_num", "probe", "ioc_id"))
_query("dns_answers_explode", fx.sql("SELECT seq_num, 0 AS answer_at, 'CNAME' AS type, concat('www.bad', CAST(seq_num % 16 AS VARCHAR), '.example.com') AS name, NULL AS ip FROM lm UNION ALL SELECT seq_num, 1, 'A', NULL, dst_ip FROM lm"))(
    lambda s, d: frames.answers(_dns(s, d)).select("seq_num", "answer_at", "type", "name", "ip")
)
_SFLOW = [("sip", "a"), ("sip_cidr", "b"), ("dip", "c1"), ("dip_cidr", "d1"), ("host", "h"), ("url_host", "h2"), ("url", "u")]
_SFLOW_SQL = f"SELECT lm.seq_num, {_first(_SFLOW)} FROM lm {_ip_hit('a', 'src_ip')} {_net_hit('b', 'src_ip')} {_ip_hit('c1', 'ioc_ip')} {_net_hit('d1', 'ioc_ip')} LEFT JOIN ioc_name_t h ON h.k = ioc_dns || '.' LEFT JOIN ioc_name_t h2 ON lm.ioc_type = 'url' AND h2.k = regexp_extract(ioc_value, '^(https?://)?([^/]*)', 2) || '.' LEFT JOIN iocs u ON u.type = 'url' AND lm.ioc_type = 'url' AND u.value = ioc_value WHERE coalesce(a.id, b.id, c1.id, d1.id, h.id, h2.id, u.id) IS NOT NULL"
_query("ioc_sflow_match", fx.sql(_SFLOW_SQL))(
    lambda s, d: lookups.sflow_match(lm(s, d).select("seq_num", F.col("src_ip").alias("sip"), F.col("ioc_ip").alias("dip"), *[F.lit(None).cast("string").alias(x) for x in ("natsip", "natdip", "next_hop")], F.col("ioc_dns").alias("host"), F.when(F.col("ioc_type") == "url", F.col("ioc_value")).alias("url")), fx.iocs(s)).select("seq_num", "probe", "ioc_id")
)

# Rules.

PCAP_RULES = [{"name": "web", "filter": "tcp and (dst port 80 or dst port 443)"}, {"name": "ten", "filter": "src net 10.0.0.0/9 and not port 53"}, {"name": "six", "filter": "ip6 || icmp"}]
_PCAP_SQL = fx.sql(f"""SELECT seq_num, 'web' AS rule FROM lm WHERE ip_protocol = 6 AND dst_port IN (80, 443)
UNION ALL SELECT seq_num, 'ten' FROM lm WHERE {fx.number('src_ip')} BETWEEN 167772160 AND 176160767 AND NOT (src_port = 53 OR dst_port = 53)
UNION ALL SELECT seq_num, 'six' FROM lm WHERE eth_type = 34525 OR ip_protocol = 1""")
_query("pcap_chain", _PCAP_SQL)(lambda s, d: rules.pcap_chain(lm(s, d), PCAP_RULES).select("seq_num", "rule"))
_query("rule_counts", fx.sql("SELECT rule, count(*) AS matches FROM (" + _PCAP_SQL[_PCAP_SQL.index("SELECT seq_num, 'web'") :] + ") GROUP BY 1"))(lambda s, d: rules.rule_counts(rules.pcap_chain(lm(s, d), PCAP_RULES)))
DNS_RULES = (("five", "BAD5.", None), ("mail", "mail", None), ("addr", None, "198.51.3.4"))
_query("dns_chain", fx.sql("""SELECT seq_num, 'five' AS rule FROM lm WHERE contains(coalesce(ioc_dns, ''), 'bad5.') OR seq_num % 16 = 5 UNION ALL SELECT seq_num, 'addr' FROM lm WHERE dst_ip = '198.51.3.4'"""))(
    lambda s, d: rules.dns_chain(_dns(s, d), DNS_RULES).select("seq_num", "rule")
)
IP_RE, NAME_RE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"(?:(?:[0-9A-Za-z.-]+)\.){1,}(?:[A-Za-z.]{2,6})\.?"
COMPLETE = [rules.Regex("address", IP_RE), rules.Regex("license", "LICENSED under"), rules.Regex("no_the", "the", inverted=True)]


def _texts(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("seq_num"), F.col("text").alias("message"))


_query("regex_complete", f"SELECT doc_id AS seq_num, regexp_matches(text, '{IP_RE}') AS hit FROM documents")(lambda s, d: _texts(s, d).select("seq_num", rules.regex_complete(F.col("message"), COMPLETE[0]).alias("hit")))
_query("regex_first_match", f"SELECT doc_id AS seq_num, CASE WHEN regexp_matches(text, '{IP_RE}') THEN 'address' WHEN regexp_matches(text, '(?i)licensed under') THEN 'license' ELSE 'no_the' END AS rule FROM documents WHERE regexp_matches(text, '{IP_RE}') OR regexp_matches(text, '(?i)licensed under') OR NOT regexp_matches(text, '(?i)the')")(
    lambda s, d: rules.regex_first_match(_texts(s, d), COMPLETE).select("seq_num", "rule")
)


def _syslog(s: SparkSession, d: str) -> DataFrame:
    return lm(s, d).select("seq_num", F.concat(F.lit("from "), "src_ip", F.lit(" to "), "dst_ip", F.lit(" name "), F.coalesce("ioc_dns", F.lit("none")), F.lit(" end")).alias("message"))


_query("regex_substring_ioc", fx.sql("""SELECT lm.seq_num, CASE WHEN a.id IS NOT NULL OR b.id IS NOT NULL THEN 'ips' WHEN n.id IS NOT NULL THEN 'names' ELSE 'rest' END AS rule,
CASE WHEN a.id IS NOT NULL THEN src_ip WHEN b.id IS NOT NULL THEN dst_ip WHEN n.id IS NOT NULL THEN ioc_dns END AS token, coalesce(a.id, b.id, n.id) AS ioc_id
FROM lm LEFT JOIN ioc_ip_t a ON a.k = src_ip LEFT JOIN ioc_ip_t b ON b.k = dst_ip LEFT JOIN ioc_name_t n ON n.k = ioc_dns || '.'
WHERE coalesce(a.id, b.id, n.id) IS NOT NULL OR contains(src_ip, '.7')"""))(
    lambda s, d: rules.regex_chain(_syslog(s, d), [rules.Regex("ips", IP_RE, "substring", "ip"), rules.Regex("names", r"www\.[a-z0-9.]+", "substring", "domain"), rules.Regex("rest", r"from [0-9.]*\.7")], fx.iocs(s)).drop("message")
)

# Reputation.


def _feed_hit(side: str) -> str:
    kind = "cidr_src" if side == "src" else "cidr_dst"
    return f"SELECT ip, arg_max(comment, plen) AS comment, arg_max(cidr, plen) AS cidr FROM (SELECT DISTINCT {side}_ip AS ip FROM c) JOIN feed_t ON type = '{kind}' AND {fx.number('ip')} BETWEEN lo AND lo + (1::BIGINT << (32 - plen)) - 1 GROUP BY ip"


_PICK = f"""SELECT c.seq_num, CASE WHEN s.comment IS NOT NULL THEN 'src_cidr' WHEN t.comment IS NOT NULL THEN 'dst_cidr' WHEN k.comment IS NOT NULL THEN 'hash_key' WHEN p.comment IS NOT NULL THEN 'ip_hash_key' END AS why,
coalesce(s.comment, t.comment, k.comment, p.comment) AS comment FROM c LEFT JOIN ({_feed_hit("src").replace("'cidr_src'", "'cidr_src' AND cidr <> '10.0.0.0/8'")}) s ON s.ip = src_ip LEFT JOIN ({_feed_hit("dst")}) t ON t.ip = dst_ip
LEFT JOIN keys k ON k.hash_key = c.hash_key AND k.hash_key <> '' LEFT JOIN keys p ON p.hash_key = c.ip_hash_key WHERE coalesce(s.comment, t.comment, k.comment, p.comment) IS NOT NULL"""
_NAMES = """SELECT seq_num, arg_min(domain, length(domain)) AS domain FROM c JOIN black ON ioc_dns = domain OR ends_with(ioc_dns, '.' || domain)
WHERE NOT EXISTS (SELECT 1 FROM white w WHERE ioc_dns = w.domain OR ends_with(ioc_dns, '.' || w.domain)) GROUP BY 1"""


def _narrow(s: SparkSession) -> DataFrame:
    return fx.feeds(s).where("cidr <> '10.0.0.0/8'")


def _judged(s: SparkSession, d: str) -> DataFrame:
    return rep.reputation(connected(s, d), _narrow(s), fx.keys(s), fx.names(s, fx.BLACK), fx.names(s, fx.WHITE))


_query("reputation_cidr", fx.sql(f"SELECT seq_num, comment, cidr FROM c JOIN ({_feed_hit('src')}) s ON s.ip = src_ip"))(lambda s, d: rep.by_network(connected(s, d).select("seq_num", "src_ip"), fx.feeds(s), "src").drop("src_ip"))
_query("reputation_key", fx.sql("SELECT seq_num, comment FROM c JOIN keys ON keys.hash_key = c.hash_key AND keys.hash_key <> ''"))(lambda s, d: rep.by_key(connected(s, d), fx.keys(s), "hash_key").select("seq_num", "comment"))
_query("reputation_pick", fx.sql(_PICK))(lambda s, d: rep.pick(connected(s, d), _narrow(s), fx.keys(s)).select("seq_num", "why", "comment"))
_query("domain_suffix", fx.sql("SELECT seq_num, arg_min(domain, length(domain)) AS domain FROM c JOIN black ON ioc_dns = domain OR ends_with(ioc_dns, '.' || domain) GROUP BY 1"))(
    lambda s, d: rep.suffix_match(connected(s, d).where("ioc_dns IS NOT NULL"), fx.names(s, fx.BLACK), "ioc_dns").select("seq_num", "domain")
)
_query("whitelist_anti", fx.sql(_NAMES))(lambda s, d: rep.name_hits(connected(s, d).where("ioc_dns IS NOT NULL"), fx.names(s, fx.BLACK), fx.names(s, fx.WHITE), "ioc_dns").select("seq_num", "domain"))
_BOTH = f"SELECT coalesce(p.seq_num, n.seq_num) AS seq_num, coalesce(why, 'domain') AS why, coalesce(comment, 'DomainTable-DNS-' || domain) AS comment FROM ({_PICK}) p FULL JOIN ({_NAMES}) n ON p.seq_num = n.seq_num"
_query("reputation", fx.sql(_BOTH))(lambda s, d: _judged(s, d).select("seq_num", "why", "comment"))
_query("reputation_semi", fx.sql(f"SELECT seq_num, source FROM c WHERE seq_num IN (SELECT seq_num FROM ({_BOTH}))"))(lambda s, d: _judged(s, d).select("seq_num", "source"))
_query("reputation_enrich", fx.sql(f"SELECT c.seq_num, hash_key, CASE WHEN why <> 'domain' THEN connection_type END AS conn, CASE WHEN why <> 'domain' THEN comment END AS mconn FROM c JOIN ({_BOTH}) b ON b.seq_num = c.seq_num"))(
    lambda s, d: _judged(s, d).select("seq_num", "hash_key", F.when(F.col("why") != "domain", F.col("connection_type")).alias("conn"), F.when(F.col("why") != "domain", F.col("comment")).alias("mconn"))
)
_VALID = "p_partkey % 5 IN (1, 2, 3)"
_DROPS = f"SELECT 'cidr_dst' AS type, 'drop' AS report, line, cidr, concat('SBL', CAST(p_partkey AS VARCHAR), ' ; x') AS comment FROM t WHERE {_VALID}"
_BOGONS = f"SELECT 'cidr_src' AS type, 'bogon' AS report, line, cidr, concat('context-line-', CAST(line AS VARCHAR)) AS comment FROM t WHERE {_VALID}"


def _drops(s: SparkSession, d: str) -> DataFrame:
    return feeds.drop_list(fx.feed_lines(s, d).select("line", F.col("drop_text").alias("text")))


def _bogons(s: SparkSession, d: str) -> DataFrame:
    return feeds.cidr_list(fx.feed_lines(s, d).select("line", F.col("cidr_text").alias("text")))


def _created(rows: DataFrame) -> DataFrame:
    """Feeds of a line a day."""
    return rows.withColumn("created_time", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("line") * 86_400))


_query("feed_drop_parse", fx.feed_lines_sql(_DROPS))(_drops)
_query("feed_cidr_parse", fx.feed_lines_sql(_BOGONS))(_bogons)
_query("feed_rejects", fx.feed_lines_sql("SELECT line, drop_text AS text FROM t WHERE p_partkey % 5 = 4 UNION ALL SELECT line, cidr_text FROM t WHERE p_partkey % 5 = 4"))(
    lambda s, d: feeds.drop_rejects(fx.feed_lines(s, d).select("line", F.col("drop_text").alias("text"))).union(feeds.cidr_rejects(fx.feed_lines(s, d).select("line", F.col("cidr_text").alias("text"))))
)
_query("feed_whitelist", fx.feed_lines_sql("SELECT CAST(p_partkey AS INTEGER) AS rank, name AS domain, concat('org.example', CAST(p_partkey % 7 AS VARCHAR), '.n', CAST(p_partkey AS VARCHAR)) AS rdomain FROM t WHERE p_partkey % 5 <> 0"))(
    lambda s, d: feeds.ranked_domains(fx.feed_lines(s, d).select(F.col("rank_text").alias("text")))
)
# Of networks that both lists have the later list counts, and of those that one has twice the later line.
_query("feed_union", fx.feed_lines_sql(f"SELECT cidr, arg_max(type, [f, line]) AS type, arg_max(comment, [f, line]) AS comment FROM (SELECT *, 0 AS f FROM ({_DROPS}) UNION ALL SELECT *, 1 FROM ({_BOGONS}) WHERE line % 2 = 0) GROUP BY cidr"))(
    lambda s, d: rep.union([_drops(s, d), _bogons(s, d).where("line % 2 = 0")], ["cidr"]).select("cidr", "type", "comment")
)
_query("feed_expire", fx.feed_lines_sql(f"SELECT cidr, comment FROM ({_DROPS}) WHERE line >= 100"))(lambda s, d: rep.expire(_created(_drops(s, d)), "2024-04-10 00:00:00").select("cidr", "comment"))
_query("feed_remove", fx.feed_lines_sql(f"SELECT cidr, comment FROM ({_DROPS}) WHERE cidr NOT IN (SELECT cidr FROM t WHERE {_VALID} AND p_partkey % 4 = 0)"))(
    lambda s, d: rep.remove(_drops(s, d), _bogons(s, d).where("line % 4 = 0").select("cidr"), "cidr").select("cidr", "comment")
)
_GOOD_IOC = "p_partkey % 11 <> 0 AND kind <> 'md5'"


def _iocs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return feeds.ioc_lines(fx.feed_lines(s, d).select(F.col("line") % 2, "line", "ioc_text").toDF("file_id", "line", "text"))


_query("ioc_load", fx.feed_lines_sql(f"SELECT line % 2 AS file_id, line, CAST(p_partkey AS BIGINT) AS id, lower(kind) AS type, 'scan' AS threat_type, CASE WHEN kind = 'IP' THEN address END AS ip, CASE WHEN kind = 'Domain' THEN name ELSE '' END AS dns, value FROM t WHERE {_GOOD_IOC}"))(lambda s, d: _iocs(s, d)[0])
_query("ioc_rejects", fx.feed_lines_sql(f"SELECT line, ioc_text AS text FROM t WHERE NOT ({_GOOD_IOC})"))(lambda s, d: _iocs(s, d)[1].select("line", "text"))
_query("ioc_first_wins", fx.feed_lines_sql(f"SELECT printf('%08x', {fx.number('address')}) AS key, arg_min(CAST(p_partkey AS BIGINT), [line % 2, line]) AS ioc_id FROM t WHERE {_GOOD_IOC} AND kind = 'IP' GROUP BY 1"))(lambda s, d: lookups.exact_ips(_iocs(s, d)[0]).select("key", "entry.ioc_id"))

# Networks of the feeds as a sorted table finds them, and both families in rules.
_BITS = "lpad(bin({0}), 32, '0')"
_FLOOR_SQL = f"""SELECT seq_num, comment, cidr FROM (SELECT seq_num, {_BITS.format(fx.number("dst_ip"))} AS bits FROM c) e
ASOF JOIN (SELECT b, min(cidr) AS cidr, arg_min(comment, [cidr, comment]) AS comment FROM (SELECT left({_BITS.format(fx.number("split_part(cidr, '/', 1)"))}, CAST(split_part(cidr, '/', 2) AS INT)) AS b, cidr, concat('SBL', CAST(p_partkey AS VARCHAR), ' ; x') AS comment
  FROM t WHERE p_partkey % 5 IN (1, 3)) GROUP BY b) n ON e.bits >= n.b WHERE starts_with(bits, b)"""
_query("reputation_floor", fx.sql(_FLOOR_SQL).replace("WITH lm0 AS", fx.feed_lines_sql("").rstrip() + ", lm0 AS", 1))(lambda s, d: rep.by_floor(connected(s, d).select("seq_num", "dst_ip"), _drops(s, d), "dst").drop("dst_ip"))

# Reports.


def _top_ips(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d, next(r for r in windows.RANKINGS if r.name == "dst_ip"), DAY)


_TOP = _ranking_sql(next(r for r in windows.RANKINGS if r.name == "dst_ip"), 10, DAY_S)
_HEAD, _TOP_SELECT = _TOP[: _TOP.index("SELECT *, row_number()")], _TOP[_TOP.index("SELECT *, row_number()") :]
_ENTRIES = "string_agg(concat(dst_ip, '=', CAST(scount AS VARCHAR)), ' ' ORDER BY rank)"
_query("report_envelope", f"{_HEAD} SELECT 'DstIpTop' AS statement, window_start AS time, CAST(count(*) AS INT) AS size, {_ENTRIES} AS entries, row_number() OVER (ORDER BY window_start) - 1 AS id FROM ({_TOP_SELECT}) GROUP BY window_start")(
    lambda s, d: reports.numbered(reports.window_envelopes("DstIpTop", _top_ips(s, d), ("dst_ip", "scount"))).withColumn("entries", F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["dst_ip"], e["scount"].cast("string"))), " "))
)
_query("report_json", f"""{_HEAD} SELECT 'DstIpTop' AS statement, window_start AS time, concat('{{"statement":"DstIpTop","time":', CAST(window_start AS VARCHAR), ',"size":', CAST(count(*) AS VARCHAR), ',"entries":[', string_agg(concat('{{"dst_ip":"', dst_ip, '","scount":', CAST(scount AS VARCHAR), '}}'), ',' ORDER BY rank), ']}}', chr(10)) AS json FROM ({_TOP_SELECT}) GROUP BY window_start""")(
    lambda s, d: reports.to_json(reports.window_envelopes("DstIpTop", _top_ips(s, d), ("dst_ip", "scount")))
)
_query("top_reports_latest", f"{_HEAD} SELECT 'DstIpTop' AS statement, window_start AS time, CAST(count(*) AS INT) AS size FROM ({_TOP_SELECT}) GROUP BY window_start ORDER BY window_start DESC LIMIT 1")(
    lambda s, d: reports.latest(reports.window_envelopes("DstIpTop", _top_ips(s, d), ("dst_ip", "scount"))).drop("entries")
)
_query("chart_ranges", f"{_HEAD} SELECT window_start, min(scount) * 0.90::DOUBLE AS y_min, max(scount) * 1.05::DOUBLE AS y_max FROM ({_TOP_SELECT}) GROUP BY 1")(lambda s, d: reports.chart_ranges(_top_ips(s, d)))
_query("ikey_format", fx.sql("SELECT seq_num, concat_ws(' ', source, ioc_type, ioc_value, ioc_threat_type, ioc_type, CASE WHEN ioc_id <> 0 THEN concat('ID ', CAST(ioc_id AS VARCHAR)) END, 'SEV Unknown') AS ikey, replace(hash_key, chr(31), ' ') AS hkey FROM c"))(
    lambda s, d: connected(s, d).transform(lambda e: e.select("seq_num", reports.ikey(e).alias("ikey"), reports.readable_key(F.col("hash_key")).alias("hkey")))
)
_query("lm_projection", fx.sql("SELECT seq_num, source, sensor_name, src_ip, dst_ip, ioc_id, ioc_type, concat_ws(', ', nullif(ioc_value, ''), ioc_ip, ioc_dns) AS ioc_value, hash_key FROM c"))(lambda s, d: reports.lm_projection(connected(s, d)))


#: JSON fields that are text.
_TEXTS = set("source rule direction smac dmac sip dip dns_name type threat_type ip value dns message agentip gatewayip source_ip agent_ip sample_type natsip natdip src_user dst_user".split())


def _json_sql(fields: tuple[tuple[str, str], ...], columns: set[str]) -> str:
    shown = []
    for name, expression in fields:
        if reports._columns(expression) <= columns:
            e = expression.replace("DIV", "//")
            shown.append(f"CASE WHEN ({e}) IS NOT NULL THEN concat('\"{name}\":', " + (f"'\"', {e}, '\"'" if name in _TEXTS else f"CAST({e} AS VARCHAR)") + ") END")
    return f"concat('{{', concat_ws(',', {', '.join(shown)}), '}}')"


_EVENTS = {name for name, _ in (*fx._EVENT, *fx.WIDE)}
_MESSAGE_JSON, _IOC_JSON, _FRAME_JSON = (_json_sql(f, _EVENTS) for f in ((*reports.HEAD, *reports.IP, ("message", "message"), *reports.INDICATOR), (*reports.HEAD, *reports.ETHERNET, *reports.IP, *reports.INDICATOR), (*reports.HEAD, *reports.ETHERNET, *reports.IP)))
_query("event_json", fx.sql(f"SELECT seq_num, CASE WHEN ends_with(source, '_syslog') THEN {_MESSAGE_JSON} WHEN ends_with(source, '_ioc') THEN {_IOC_JSON} ELSE {_FRAME_JSON} END AS json FROM {fx.derived_sql(fx.WIDE, True)}"))(
    lambda s, d: reports.event_json(fx.derived(lm(s, d), fx.WIDE, True))
)
_query("netflow_json", fx.sql(f"SELECT seq_num, {_json_sql((*reports.FLOW, *reports.INDICATOR), {n for n, _ in fx.FLOWS})} AS json FROM {fx.derived_sql(fx.FLOWS)}"))(lambda s, d: reports.flow_json(fx.derived(lm(s, d), fx.FLOWS)))
_query("sflow_json", fx.sql(f"SELECT seq_num, {_json_sql((*reports.SAMPLE, *reports.INDICATOR), {n for n, _ in fx.SAMPLES})} AS json FROM {fx.derived_sql(fx.SAMPLES)}"))(lambda s, d: reports.sample_json(fx.derived(lm(s, d), fx.SAMPLES)))
_query("reputation_log", fx.sql(f"""SELECT seq_num, concat(concat_ws(chr(10), concat('Conn Table detected reputation based threat from [', source, ']:'), concat('    time    ', strftime(event_time, '%Y-%m-%dT%H:%M:%SZ')), concat('    type    ', why),
concat('    comment ', comment), concat('    skey    ', replace(hash_key, chr(31), ' ')), concat('    ikey    ', concat_ws(' ', source, ioc_type, ioc_value, ioc_threat_type, ioc_type, CASE WHEN ioc_id <> 0 THEN concat('ID ', CAST(ioc_id AS VARCHAR)) END, 'SEV Unknown')),
CASE WHEN ioc_type = 'url' THEN concat('    url     ', ioc_value) END), chr(10)) AS text FROM c JOIN ({_BOTH}) b USING (seq_num)"""))(lambda s, d: reports.reputation_text(_judged(s, d)))
_query("netflow_format", fx.sql("SELECT seq_num, concat('FLOW tag 7 proto ', CAST(ip_protocol AS VARCHAR), ' [', src_ip, ']:', CAST(src_port AS VARCHAR), ' -> [', dst_ip, ']:', CAST(dst_port AS VARCHAR), ' octets ', CAST(bytes AS VARCHAR), ' uptime ', CAST(seq_num % 60 AS VARCHAR), 's') AS line FROM lm"))(
    lambda s, d: reports.flow_text(lm(s, d).select("seq_num", F.lit(7).alias("tag"), F.col("ip_protocol").alias("protocol"), "src_ip", "src_port", "dst_ip", "dst_port", F.lit(None).cast("long").alias("packets"), "bytes", (F.col("seq_num") % 60).alias("uptime")))
)

# Sources: records and packets made from the events, then decoded.


def _wire(s: SparkSession, d: str) -> DataFrame:
    fields = (F.lit("x").alias("time"), F.col("sensor_name").alias("sensor"), "source", F.col("self").cast("int").alias("self"), "seq_num", F.col("src_ip").alias("sip"), F.col("dst_ip").alias("dip"), F.col("dst_port").alias("dport"), "ip_protocol", "ioc_id", F.upper("ioc_type").alias("type"), F.col("ioc_value").alias("value"))
    return lm(s, d).select(F.unix_millis(F.col("event_time").cast("timestamp")).alias("millis"), F.when(F.col("seq_num") % 50 == 7, F.lit("{broken")).otherwise(F.to_json(F.struct(*fields))).alias("value"), F.col("seq_num").alias("n"))


_DECODED = "CASE WHEN seq_num % 50 = 7 THEN 0 ELSE seq_num END AS seq_num, CASE WHEN seq_num % 50 <> 7 THEN dst_ip END AS dst_ip, seq_num % 50 <> 7 AND self AS self, CASE WHEN seq_num % 50 <> 7 THEN ioc_type END AS ioc_type, CASE WHEN seq_num % 50 = 7 THEN 0 ELSE dst_port END AS dst_port"
_query("json_decode", fx.sql(f"SELECT seq_num % 50 = 7 AS bad, {_DECODED} FROM lm"))(lambda s, d: ev.json_events(_wire(s, d)).select("bad", "seq_num", "dst_ip", "self", "ioc_type", "dst_port"))
_query("scan_limit", "SELECT CAST(1000 AS BIGINT) AS n")(lambda s, d: lm(s, d).limit(1000).agg(F.count("*").alias("n")))
def _replayed(s: SparkSession, d: str) -> DataFrame:
    """A replay file of each sensor's events, decoded."""
    record = ev.lv_frame(F.unix_millis(F.col("event_time").cast("timestamp")), F.concat(F.lit("event "), F.col("seq_num").cast("string"), F.lit(" of "), "src_ip"))
    files = lm(s, d).groupBy(F.col("sensor_name").alias("file")).agg(F.array_sort(F.collect_list(F.struct("seq_num", F.hex(record).alias("x")))).alias("all"))
    return ev.lv_decode(files.select("file", F.unhex(F.array_join(F.transform("all", lambda r: r["x"]), "")).alias("raw")))


def _ranges(s: SparkSession, d: str, least: int | None = None) -> DataFrame:
    """Events as replay files of a few megabytes at most, read in ranges of 64 kB."""
    value = F.concat(F.lit("event "), F.col("seq_num").cast("string"), F.lit(" of "), "src_ip")
    rows = lm(s, d).select("seq_num", F.unix_millis(F.col("event_time").cast("timestamp")).alias("millis"), value.alias("value"))
    path, to = new_path(s, "replay"), new_path(s, "ranges")
    replay.write(rows.repartitionByRange(3, "seq_num").sortWithinPartitions("seq_num"), path)
    replay.index(s, path, to, 64 << 10)
    return replay.replay(s, path, to, least).select("millis", "value")


_LV_SQL = "SELECT epoch_us(event_time) // 1000 AS millis, concat('event ', CAST(seq_num AS VARCHAR), ' of ', src_ip) AS value FROM lm"
_query("lv_ranges", fx.sql(_LV_SQL))(_ranges)
_query("lv_ranges_since", fx.sql(f"SELECT * FROM ({_LV_SQL}) WHERE millis >= 1705300000000"))(lambda s, d: _ranges(s, d, 1705300000000))
_query("lv_decode", fx.sql("SELECT sensor_name AS file, row_number() OVER (PARTITION BY sensor_name ORDER BY seq_num) - 1 AS at, epoch_us(event_time) // 1000 AS millis, concat('event ', CAST(seq_num AS VARCHAR), ' of ', src_ip) AS value FROM lm"))(_replayed)
_query("port_dispatch", fx.sql("SELECT seq_num, CASE WHEN ip_protocol = 17 THEN CASE dst_port WHEN 53 THEN 'dns' WHEN 514 THEN 'syslog' WHEN 2055 THEN 'netflow' END WHEN ip_protocol = 6 THEN CASE dst_port WHEN 514 THEN 'syslog' WHEN 53 THEN 'dns_logged' WHEN 2055 THEN 'netflow_logged' END END AS holds FROM lm"))(
    lambda s, d: lm(s, d).select("seq_num", frames.port_dispatch(F.col("ip_protocol"), F.col("dst_port")).alias("holds"))
)
_query("syslog_udp", fx.sql("SELECT seq_num, concat('from ', src_ip) AS message FROM lm WHERE self"))(lambda s, d: ev.syslog_udp(lm(s, d).select("seq_num", "self", F.concat(F.lit("from "), "src_ip").cast("binary").alias("payload"))).select("seq_num", "message"))
_query("syslog_tcp_frames", fx.sql("SELECT sensor_name AS socket, n - 1 AS at, CASE WHEN n = 1 THEN src_ip ELSE concat('to ', src_ip) END AS message FROM (SELECT *, row_number() OVER (PARTITION BY sensor_name ORDER BY seq_num) AS n FROM lm)"))(
    lambda s, d: ev.syslog_tcp(lm(s, d).select(F.col("sensor_name").alias("socket"), "seq_num", F.concat("src_ip", F.lit("\n"), F.lit("to ")).alias("payload")))
)


def _pieces(s: SparkSession, d: str) -> DataFrame:
    """Framed records of each sensor's events, cut in two within the length of every record."""
    body = F.concat(F.lit("record "), F.col("seq_num").cast("string"))
    raw = F.concat(F.substring(ev.lv_frame(F.lit(0).cast("long"), body), 1, 4), body.cast("binary"))
    cut = lambda part, k: F.struct((F.col("seq_num") * 2 + k).alias("seq_num"), part.alias("payload"))
    rows = lm(s, d).select(F.col("sensor_name").alias("socket"), F.explode(F.array(cut(F.substring(raw, 1, 3), 0), cut(F.substring(raw, 4, 1 << 20), 1))).alias("x"))
    return rows.select("socket", "x.*")


_query("socket_frames", fx.sql("SELECT sensor_name AS socket, row_number() OVER (PARTITION BY sensor_name ORDER BY seq_num) - 1 AS at, concat('record ', CAST(seq_num AS VARCHAR)) AS message FROM lm"))(lambda s, d: ev.framed_records(_pieces(s, d)))


def _packets(s: SparkSession, d: str, make: Callable[[dict], bytes]) -> DataFrame:
    """A packet made from each event."""
    import pyarrow as pa

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([make(r) for r in b.to_pylist()], pa.binary())], ["exporter", "seq_num", "payload"])

    return lm(s, d).select(F.col("sensor_name").alias("exporter"), "seq_num", "src_ip", "dst_ip", "bytes", "dst_port").mapInArrow(work, "exporter string, seq_num long, payload binary")


_query("netflow_fixed", fx.sql("SELECT seq_num, 5 AS version, src_ip, dst_ip, bytes, dst_port FROM lm"))(
    lambda s, d: flows.fixed_flows(_packets(s, d, samples.netflow5), ("seq_num",)).select("seq_num", "version", "src_ip", "dst_ip", "bytes", "dst_port")
)
_HAVE = "(SELECT *, row_number() OVER (PARTITION BY sensor_name ORDER BY seq_num) AS n, max(CASE WHEN seq_num % 25 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_name ORDER BY seq_num ROWS UNBOUNDED PRECEDING) AS known FROM lm)"
for _name, _version in (("netflow_v9", 9), ("ipfix", 10)):
    _query(_name, fx.sql(f"SELECT sensor_name AS exporter, seq_num, {_version} AS version, src_ip, dst_ip, bytes, dst_port FROM {_HAVE} WHERE known = 1"))(
        lambda s, d, v=_version: flows.templated_flows(_packets(s, d, lambda r: samples.templated(r, v))).select("exporter", "seq_num", "version", "src_ip", "dst_ip", "bytes", "dst_port")
    )
_query("exporter_stats", fx.sql(f"SELECT sensor_name AS exporter, count(*) AS packets, sum(known)::BIGINT AS flows, 0::BIGINT AS invalid, sum(1 - known)::BIGINT AS no_template FROM {_HAVE} GROUP BY 1"))(lambda s, d: flows.exporter_stats(_packets(s, d, lambda r: samples.templated(r, 9))))
_query("sflow_decode", fx.sql("SELECT seq_num, 'flow' AS sample_type, src_ip AS sip, dst_ip AS dip, dst_port AS dport, concat('http://', dst_ip, '/') AS url FROM lm"))(
    lambda s, d: sflow.sflow(_packets(s, d, samples.sflow5), ("seq_num",)).select("seq_num", "sample_type", "sip", "dip", "dport", "url")
)
_query("frame_decode", fx.sql("SELECT seq_num, src_ip AS sip, dst_ip AS dip, dst_port AS dport, 17 AS ip_protocol FROM lm"))(lambda s, d: frames.frames(_packets(s, d, samples.frame), ("seq_num",), "payload").select("seq_num", "sip", "dip", "dport", "ip_protocol"))
_query("dns_decode", fx.sql("SELECT seq_num, 'www.example.com.' AS dns_name, 1 AS n, dst_ip AS ip FROM lm"))(lambda s, d: frames.dns(_packets(s, d, samples.dns_reply), ("seq_num",)).select("seq_num", "dns_name", F.size("dns_answers").alias("n"), F.col("dns_answers")[0]["ip"].alias("ip")))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: the ten most frequent destinations of each day, from whole events."""
    return _QUERIES["dst_ip_top"](spark, "/root/testdata/sf0.001")
