"""Reputation: feeds of networks and keys, name lists, and what they say of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilstream.functions import net
from vigilstream.operators.asof import as_of
from vigilstream.operators.lookups import Networks, held


def union(feeds: list[DataFrame], key: list[str]) -> DataFrame:
    """All feeds in one table; of rows with one key the last loaded."""
    rows = None
    for k, feed in enumerate(feeds):
        feed = feed.withColumn("__feed", F.lit(k))
        rows = feed if rows is None else rows.unionByName(feed, allowMissingColumns=True)
    order = [F.desc("__feed"), *([F.desc("line")] if "line" in rows.columns else [])]
    by = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n", "__feed")


def expire(feed: DataFrame, max_age: str) -> DataFrame:
    """Rows created at ``max_age`` (a timestamp) or later."""
    return feed.where(F.col("created_time") >= F.lit(max_age).cast("timestamp"))


def remove(feed: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return feed.join(held(keys), on, "left_anti")


def _networks(feed: DataFrame, side: str) -> DataFrame:
    rows = feed.where(F.col("type") == f"cidr_{side}").withColumn("x", net.network_parts(F.col("cidr"))).where("x is not null")
    rows = rows.select("x.family", "x.prefix", "x.base", F.struct("comment", "cidr", "report").alias("entry"))
    return rows.dropDuplicates(["family", "prefix", "base"])


def _with_network(events: DataFrame, feed: DataFrame, side: str, out: str) -> DataFrame:
    rows = events.withColumn("__digits", net.ip_hex(F.col(f"{side}_ip")))
    return Networks(_networks(feed, side)).probe(rows, "__digits", out).drop("__digits")


def _keys(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("hash_key") != "").select(F.col("hash_key").alias("__key"), F.col("comment").alias("__comment")).dropDuplicates(["__key"])


def by_network(events: DataFrame, feed: DataFrame, side: str) -> DataFrame:
    """Events whose source (``src``) or destination (``dst``) lies in a network of the feed, with the longest one's comment and cidr."""
    rows = _with_network(events.drop("comment", "cidr"), feed, side, "__entry").where("__entry is not null")
    return rows.withColumn("comment", F.col("__entry.comment")).withColumn("cidr", F.col("__entry.cidr")).drop("__entry")


def by_floor(events: DataFrame, feed: DataFrame, side: str) -> DataFrame:
    """``by_network`` as a sorted table finds it: of IPv4 networks, written as their bits, the last one not after the address's bits, if the address lies in it.

    A longer network that ends before the address hides the shorter one around both. Distinct addresses are put in one order
    with the networks, so that a frequent address is looked up once; events meet what was found for theirs.
    """
    table = feed.where(F.col("type") == f"cidr_{side}").withColumn("x", net.cidr_parts(F.col("cidr"))).where("x is not null")
    table = table.select(F.substring(F.lpad(F.bin("x.start"), 32, "0"), F.lit(1), F.col("x.prefix")).alias("bits"), "comment", "cidr").groupBy("bits").agg(F.min(F.struct("cidr", "comment")).alias("entry"))
    addresses = events.select(F.col(f"{side}_ip").alias("address")).distinct().withColumn("bits", net.cidr_bits(F.col("address"), F.lit(32))).where("bits is not null")
    # Slices are of the first ten bits.
    slice = F.conv(F.rpad(F.substring("bits", 1, 10), 10, "0"), 2, 10).cast("long")
    found = as_of(addresses, table, (), ("bits",), slice, F.struct("bits", "entry"), "found").where(F.col("bits").startswith(F.col("found.bits")))
    found = found.select(F.col("address").alias("of_address"), F.col("found.entry.comment").alias("of_comment"), F.col("found.entry.cidr").alias("of_cidr"))
    rows = events.drop("comment", "cidr")
    return rows.join(found, rows[f"{side}_ip"] == F.col("of_address")).drop("of_address").withColumnsRenamed({"of_comment": "comment", "of_cidr": "cidr"})


def by_key(events: DataFrame, feed: DataFrame, column: str) -> DataFrame:
    """Events whose connection key a row of the feed has, with its comment."""
    return events.drop("comment").join(held(_keys(feed)), F.col(column) == F.col("__key")).drop("__key").withColumnRenamed("__comment", "comment")


def _picked(events: DataFrame, networks: DataFrame, keys: DataFrame) -> DataFrame:
    """Events with ``__found`` (why, comment) of the connection tables, or null; each table is asked by a left join."""
    rows, found = events, []
    for side in ("src", "dst"):
        rows = _with_network(rows, networks, side, f"__{side}")
        hit = F.col(f"__{side}")
        found.append(F.when(hit.isNotNull(), F.struct(F.lit(f"{side}_cidr").alias("why"), hit["comment"].alias("comment"))))
    table = held(_keys(keys))
    for column in ("hash_key", "ip_hash_key"):
        rows = rows.join(table, F.col(column) == table["__key"], "left").withColumnRenamed("__comment", f"__of_{column}").withColumnRenamed("__key", f"__in_{column}")
        found.append(F.when(F.col(f"__in_{column}").isNotNull(), F.struct(F.lit(column).alias("why"), F.col(f"__of_{column}").alias("comment"))))
    return rows.withColumn("__found", F.coalesce(*found)).drop("__src", "__dst", *[f"__{k}_{c}" for k in ("of", "in") for c in ("hash_key", "ip_hash_key")])


def pick(events: DataFrame, networks: DataFrame, keys: DataFrame) -> DataFrame:
    """Events that a connection table knows: source network, destination network, connection key, key by addresses, the first of them. ``why`` says which."""
    rows = _picked(events.drop("why", "comment"), networks, keys).where("__found is not null")
    return rows.withColumn("why", F.col("__found.why")).withColumn("comment", F.col("__found.comment")).drop("__found")


def _with_suffix(events: DataFrame, table: DataFrame, name: str, out: str) -> DataFrame:
    """Events with the shortest suffix of the name that the table (column ``domain``) has, or null: a left join for each number of labels."""
    listed = table.select(net.reverse_domain(F.rtrim("domain", F.lit("."))).alias("__suffix"), F.col("domain").alias("__domain")).dropDuplicates(["__suffix"])
    listed = listed.withColumn("__labels", F.size(F.split("__suffix", r"\.")))
    rows, found = events.withColumn("__parts", F.reverse(F.split(F.rtrim(F.col(name), F.lit(".")), r"\."))), []
    for k in sorted(r[0] for r in listed.select("__labels").distinct().collect()):  # 127 at most, a name's labels
        side = held(listed.where(F.col("__labels") == k).drop("__labels"))
        key = F.when(F.size("__parts") >= k, F.array_join(F.slice("__parts", 1, k), "."))
        rows = rows.join(side, key == side["__suffix"], "left").drop("__suffix").withColumnRenamed("__domain", f"__{out}_{k}")
        found.append(f"__{out}_{k}")
    shortest = F.coalesce(*found) if found else F.lit(None).cast("string")
    return rows.withColumn(out, shortest).drop("__parts", *found)


def suffix_match(names: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Rows with the shortest suffix of the name that the table has, as ``domain``; rows without one go."""
    return _with_suffix(names.drop("domain"), table, name, "domain").where("domain is not null")


def name_hits(names: DataFrame, black: DataFrame, white: DataFrame, name: str = "dns_name") -> DataFrame:
    """Rows of blacklisted names that no whitelist suffix covers."""
    rows = _with_suffix(_with_suffix(names.drop("domain"), black, name, "domain"), white, name, "__white")
    return rows.where("domain is not null and __white is null").drop("__white")


def reputation(events: DataFrame, networks: DataFrame, keys: DataFrame, black: DataFrame, white: DataFrame, name: str = "ioc_dns") -> DataFrame:
    """Events that the connection tables or the name lists know, with why and comment; the tables go before the names. One scan."""
    rows = _picked(events.drop("why", "comment"), networks, keys)
    rows = _with_suffix(_with_suffix(rows, black, name, "__black"), white, name, "__white")
    named = F.when(F.col("__black").isNotNull() & F.col("__white").isNull(), F.struct(F.lit("domain").alias("why"), F.concat(F.lit("DomainTable-DNS-"), "__black").alias("comment")))
    rows = rows.withColumn("__found", F.coalesce("__found", named)).where("__found is not null")
    return rows.withColumn("why", F.col("__found.why")).withColumn("comment", F.col("__found.comment")).drop("__found", "__black", "__white")
