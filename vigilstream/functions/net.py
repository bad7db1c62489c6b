"""Addresses of both families, networks, MACs, flags, and parts of names; all of them Column expressions.

An address is worked with as hexadecimal digits, eight for IPv4 and 32 for IPv6, which sort as numbers do and of which a
network is the beginning (``ip_hex``, ``cut``); IPv4 also as a whole number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4)


def ip_to_long(ip: Column) -> Column:
    """The address as a number; null unless it is four octets."""
    part = F.split(ip, r"\.")
    value = sum((part[k].cast("long") * (1 << (24 - 8 * k)) for k in range(1, 4)), part[0].cast("long") * (1 << 24))
    return F.when(is_ipv4(ip), value)


def long_to_ip(n: Column) -> Column:
    octets = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(n.between(0, 2**32 - 1), F.concat_ws(".", *octets))


def _power(bits: Column) -> Column:
    """2 to the bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def network(n: Column, prefix: Column) -> Column:
    """The first address of the network of that prefix length."""
    return n - F.pmod(n, _power(F.lit(32) - prefix))


def cidr_parts(cidr: Column) -> Column:
    """start, end, prefix of an IPv4 network or address; no prefix means one host, /0 everything; null if invalid."""
    ip = ip_to_long(F.substring_index(cidr, "/", 1))
    text = F.when(cidr.contains("/"), F.regexp_extract(cidr, r"^[^/]*/([0-9]{1,2})$", 1)).otherwise(F.lit("32"))
    prefix = F.when(text != "", text.cast("int"))
    start = network(ip, prefix)
    end = start + _power(F.lit(32) - prefix) - 1
    good = ip.isNotNull() & prefix.between(0, 32)
    return F.when(good, F.struct(start.alias("start"), end.alias("end"), prefix.alias("prefix")))


def cidr_bits(ip: Column, prefix: Column) -> Column:
    """The first bits of the address, as text of 0 and 1."""
    n = ip_to_long(ip)
    return F.when(n.isNotNull() & prefix.between(0, 32), F.substring(F.lpad(F.bin(n), 32, "0"), F.lit(1), prefix))


def net_match(ip: Column, cidr: Column) -> Column:
    parts = cidr_parts(cidr)
    return ip_to_long(ip).between(parts["start"], parts["end"])


def netmask(prefix: Column) -> Column:
    return long_to_ip(F.lit(2**32) - _power(F.lit(32) - prefix))


def hostmask(prefix: Column) -> Column:
    return long_to_ip(_power(F.lit(32) - prefix) - 1)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _tail_hex(ip: Column) -> Column:
    """IPv6 text whose last two groups may be written as an IPv4 address, with groups alone."""

    def with_tail(tail: Column) -> Column:
        digits = F.lpad(F.lower(F.hex(ip_to_long(tail))), 8, "0")
        return F.concat(F.left(ip, F.length(ip) - F.length(tail)), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))

    return F.when(ip.contains("."), _let(F.regexp_extract(ip, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1), with_tail)).otherwise(ip)


#: Colons stand between groups, or twice once, and nowhere else.
_IPV6 = "^(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?(::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?)?$"


def _ipv6_hex(ip: Column) -> Column:
    def of_text(text: Column) -> Column:
        groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
        both = F.transform(F.split(text, "::"), groups)
        return F.when(text.rlike(_IPV6), _let(both, of_halves))

    def of_halves(halves: Column) -> Column:
        short = F.size(halves) == 2
        named = F.size(F.flatten(halves))
        zeros = F.array_repeat(F.lit("0"), F.when(short, 8 - named).otherwise(0))
        every = F.concat(halves[0], zeros, F.coalesce(F.get(halves, F.lit(1)), F.array().cast("array<string>")))
        digits = F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(F.when(short, named <= 7).otherwise(named == 8), digits)

    return _let(F.lower(_tail_hex(ip)), of_text)


def ip_hex(ip: Column) -> Column:
    """An address's digits: 8 for IPv4, 32 for IPv6; null if it is neither."""
    four = F.lpad(F.lower(F.hex(ip_to_long(ip))), 8, "0")
    return F.when(is_ipv4(ip), four).when(ip.contains(":"), _ipv6_hex(ip))


def _nibble(digit: Column, bits: Column, fill: int) -> Column:
    """A hexadecimal digit whose first bits are kept and whose others are all ``fill``."""
    value = F.conv(digit, 16, 10).cast("int")
    rest = F.call_function("shiftleft", F.lit(1), (F.lit(4) - bits).cast("int")) - 1
    kept = value.bitwiseAND(F.lit(15) - rest)
    return F.lower(F.hex((kept + rest if fill else kept).cast("long")))


def cut(digits: Column, prefix: Column | int) -> Column:
    """The digits that the first bits make; a last one that they only partly make has zeros in its other bits."""
    if isinstance(prefix, int):
        whole, bits = prefix // 4, prefix % 4
        begin = F.substring(digits, 1, whole)
        return F.concat(begin, _nibble(F.substring(digits, whole + 1, 1), F.lit(bits), 0)) if bits else begin
    whole, bits = F.floor(prefix / 4).cast("int"), prefix % 4
    last = F.when(bits > 0, _nibble(F.substring(digits, whole + 1, F.lit(1)), bits, 0)).otherwise(F.lit(""))
    return F.concat(F.substring(digits, F.lit(1), whole), last)


def network_parts(cidr: Column) -> Column:
    """family, prefix, base (``cut`` to the prefix), start and end (digits) of a network or address of either family; null if it is neither."""

    def of_digits(digits: Column) -> Column:
        width = F.length(digits)
        text = F.when(cidr.contains("/"), F.regexp_extract(cidr, r"^[^/]*/([0-9]{1,3})$", 1)).otherwise((width * 4).cast("string"))
        return _let(F.when(text != "", text.cast("int")), lambda prefix: F.when(prefix.between(0, width * 4), of_prefix(digits, prefix)))

    def of_prefix(digits: Column, prefix: Column) -> Column:
        width, whole, bits = F.length(digits), F.floor(prefix / 4).cast("int"), prefix % 4
        last = F.when(bits > 0, _nibble(F.substring(digits, whole + 1, F.lit(1)), bits, 1)).otherwise(F.lit(""))
        end = F.concat(F.substring(digits, F.lit(1), whole), last)
        base = cut(digits, prefix)
        return F.struct(F.when(width == 8, 4).otherwise(6).alias("family"), prefix.alias("prefix"), base.alias("base"), F.rpad(base, width, F.lit("0")).alias("start"), F.rpad(end, width, F.lit("f")).alias("end"))

    return _let(ip_hex(F.substring_index(cidr, "/", 1)), of_digits)


def ip_text(digits: Column) -> Column:
    """The shortest usual text of an address's digits: the first longest run of two or more zero groups is ``::``."""
    four = F.concat_ws(".", *[F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10) for k in range(4)])
    groups = [F.regexp_replace(F.substring(digits, 4 * k + 1, 4), "^0{1,3}", "") for k in range(8)]

    def shortened(text: Column) -> Column:
        short = text
        for k in range(2, 9):
            run = ":" + "0:" * k
            at = F.instr(text, run)
            short = F.when(at > 0, F.concat(F.left(text, at - 1), F.lit("::"), F.substring(text, at + len(run), F.length(text)))).otherwise(short)
        return F.regexp_replace(F.regexp_replace(short, "^:(?!:)", ""), "(?<!:):$", "")

    six = _let(F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":")), shortened)
    return F.when(F.length(digits) == 8, four).when(F.length(digits) == 32, six)


def ip_normal(ip: Column) -> Column:
    """The shortest usual text of an IPv4 or IPv6 address; null if it is neither."""
    return _let(ip_hex(ip), ip_text)


def ip_range(cidr: Column) -> Column:
    """Family and the bounds of an address or network as digits, and the prefix."""
    return _let(network_parts(cidr), lambda p: F.when(p.isNotNull(), F.struct(*[p[f].alias(f) for f in ("family", "start", "end", "prefix")])))


def _halves(digits: Column) -> list[Column]:
    """The digits as two signed numbers of 64 bits; IPv4 has its value in the second."""
    padded = F.lpad(digits, 32, "0")
    return [F.conv(F.substring(padded, k, 16), 16, -10).cast("long") for k in (1, 17)]


def _whole(halves: list[Column], width: Column) -> Column:
    text = F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in halves])
    return F.right(text, width)


def ip_and(a: Column, b: Column) -> Column:
    """Both addresses' common bits, as digits; null for addresses of two families, as in ``ip_or``."""
    return F.when(F.length(a) == F.length(b), _whole([x.bitwiseAND(y) for x, y in zip(_halves(a), _halves(b), strict=True)], F.length(a)))


def ip_or(a: Column, b: Column) -> Column:
    return F.when(F.length(a) == F.length(b), _whole([x.bitwiseOR(y) for x, y in zip(_halves(a), _halves(b), strict=True)], F.length(a)))


def ip_invert(a: Column) -> Column:
    """All bits the other way round."""
    return F.translate(a, "0123456789abcdef", "fedcba9876543210")


def ip_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; IPv4 comes before IPv6."""
    x, y = (F.struct(F.length(c), c) for c in (a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(x < y, -1).when(x > y, 1).otherwise(0))


def is_all_zeros(a: Column) -> Column:
    return a.rlike("^0+$")


def is_all_ones(a: Column) -> Column:
    return a.rlike("^f+$")


def mask(prefix: Column, family: Column) -> Column:
    """Digits whose first bits are set."""
    width = F.when(family == 4, 8).otherwise(32)
    bits = F.concat(F.repeat(F.lit("1"), prefix), F.repeat(F.lit("0"), width * 4 - prefix))
    nibbles = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.lower(F.conv(F.substring(bits, k * 4 + 1, F.lit(4)), 2, 16)))
    return F.when(prefix.between(0, width * 4), F.array_join(nibbles, ""))


def in_network(ip: Column, cidr: Column) -> Column:
    """Whether an address lies in a network of its family, either one."""
    inside = lambda digits, parts: (F.length(digits) == F.length(parts["start"])) & digits.between(parts["start"], parts["end"])
    return _let(network_parts(cidr), lambda parts: _let(ip_hex(ip), lambda digits: inside(digits, parts)))


def is_mapped(ip: Column) -> Column:
    """Whether IPv6 text holds an IPv4 address, however it is written."""
    return F.coalesce(_let(ip_hex(ip), lambda digits: digits.rlike("^0{20}ffff.{8}$")), F.lit(False))


def mac_format(raw: Column) -> Column:
    """Six bytes as pairs of hexadecimal digits with colons."""
    return F.when(F.length(raw) == 6, F.regexp_replace(F.lower(F.hex(raw)), "(..)(?=.)", "$1:"))


#: Flag bits and names, in the order in which they are written.
TCP_FLAGS = ((0x20, "URG"), (0x10, "ACK"), (0x08, "PSH"), (0x04, "RST"), (0x02, "SYN"), (0x01, "FIN"))


def tcp_flags_format(flags: Column) -> Column:
    """Names of the flags that are set, each with a space after it."""
    return F.concat(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(f"{name} ")).otherwise(F.lit("")) for bit, name in TCP_FLAGS])


def sflow_port(port: Column) -> Column:
    """Format (two highest bits) and value of an interface number."""
    return F.struct(F.shiftrightunsigned(port, 30).bitwiseAND(F.lit(3)).alias("format"), port.bitwiseAND(F.lit(0x3FFFFFFF)).alias("value"))


def sflow_tag(tag: Column) -> Column:
    """A data format number as enterprise:format."""
    return F.concat_ws(":", F.shiftright(tag, 12).cast("string"), tag.bitwiseAND(F.lit(0xFFF)).cast("string"))


def canonical_domain(name: Column) -> Column:
    """With exactly one dot at its end; null stays null, and so does what is empty."""
    return F.when(F.rtrim(name, F.lit(".")) != "", F.concat(F.rtrim(name, F.lit(".")), F.lit(".")))


def url_host(url: Column) -> Column:
    """What stands between the scheme (http or https) and the first slash, with port and user if there are any."""
    return F.nullif(F.regexp_extract(url, "(?i)^(https?://)?([^/]*)", 2), F.lit(""))


def email_domain(mail: Column) -> Column:
    """What follows the first @."""
    return F.when(F.instr(mail, "@") > 0, F.substring(mail, F.instr(mail, "@") + 1, F.length(mail)))


def reverse_domain(name: Column) -> Column:
    return F.array_join(F.reverse(F.split(name, r"\.")), ".")


def suffixes(name: Column) -> Column:
    """Reversed suffixes, the shortest first: com, com.example, com.example.www."""
    parts = F.reverse(F.split(name, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def url_encode(text: Column) -> Column:
    return F.url_encode(text)


def uuid_format(raw: Column) -> Column:
    """Sixteen bytes in the usual groups."""
    return F.when(F.length(raw) == 16, F.regexp_replace(F.lower(F.hex(raw)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
