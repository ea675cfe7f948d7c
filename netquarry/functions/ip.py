"""IPv4 addresses and networks as BIGINT expressions; invalid input is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTETS = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def parse_ip(text: Column) -> Column:
    """Number of a dotted address; null if it is none."""
    folded = F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    return F.when(text.rlike(OCTETS), folded)


def format_ip(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def address_of(cidr: Column) -> Column:
    """Host part of "a.b.c.d/len" or of a bare address."""
    return parse_ip(F.substring_index(cidr, "/", 1))


def prefix_of(cidr: Column) -> Column:
    """Prefix length of "a.b.c.d/len"; 32 for a bare address; null out of 0 to 32."""
    length = F.when(F.contains(cidr, F.lit("/")), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(F.lit(32))
    return F.when(address_of(cidr).isNotNull() & length.between(0, 32), length)


def mask(length: Column) -> Column:
    return F.lit(2**32) - F.pow(F.lit(2.0), F.lit(32) - length).cast("long")


def network(ip: Column, length: Column) -> Column:
    """First address of ip's network of the given prefix length."""
    return ip.bitwiseAND(mask(length))


def last_address(ip: Column, length: Column) -> Column:
    return network(ip, length) + F.pow(F.lit(2.0), F.lit(32) - length).cast("long") - 1


def strict_network(cidr: Column) -> Column:
    """struct(lo, hi, length) of a network without host bits; null otherwise."""
    ip, length = address_of(cidr), prefix_of(cidr)
    return F.when(network(ip, length) == ip, F.struct(ip.alias("lo"), last_address(ip, length).alias("hi"), length.alias("length")))


def wildcard_network(ip: Column, wildcard: Column) -> Column:
    """struct(lo, hi) of a network given by address and host mask; null unless the mask is contiguous and no host bit is set."""
    start, hosts = parse_ip(ip), parse_ip(wildcard)
    fits = (hosts.bitwiseAND(hosts + 1) == 0) & (start.bitwiseAND(hosts) == 0)
    return F.when(fits, F.struct(start.alias("lo"), (start + hosts).alias("hi")))


def octet(ip: Column, k: int) -> Column:
    """k-th octet (1 to 4); the text 'none' for null."""
    return F.coalesce(F.shiftright(ip, 32 - 8 * k).bitwiseAND(255).cast("string"), F.lit("none"))


def binary(ip: Column) -> Column:
    """32 binary digits; 'none' for null."""
    return F.coalesce(F.lpad(F.conv(ip.cast("string"), 10, 2), 32, "0"), F.lit("none"))


def cumulative_prefixes(ip: Column, lo: int = 1, hi: int = 32) -> Column:
    """Binary prefixes of growing length."""
    return F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda n: F.substr(binary(ip), F.lit(1), n))


def supernets(ip: Column, lo: int = 20, hi: int = 31) -> Column:
    """Supernet strings "a.b.c.d/len" for each length; 'n' throughout for null."""
    return F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda p: F.when(ip.isNull(), F.lit("n")).otherwise(F.concat(format_ip(network(ip, p)), F.lit("/"), p.cast("string"))))


def generalize_address(text: Column) -> Column:
    """Network of "a.b..d/len" with the missing octets as 0; other text unchanged."""
    filled = F.regexp_replace(F.regexp_replace(text, r"\.\.", ".0."), r"\.\.", ".0.")
    dots = F.length(filled) - F.length(F.replace(filled, F.lit("."), F.lit("")))
    host = F.substring_index(filled, "/", 1)
    padded = F.concat(host, F.repeat(F.lit(".0"), F.greatest(F.lit(0), F.lit(3) - dots)), F.when(F.contains(filled, F.lit("/")), F.concat(F.lit("/"), F.substring_index(filled, "/", -1))).otherwise(F.lit("")))
    ip, length = address_of(padded), prefix_of(padded)
    return F.coalesce(F.concat(format_ip(network(ip, length)), F.lit("/"), length.cast("string")), text)


def is_address(text: Column) -> Column:
    """Whole text is an IPv4 or IPv6 address, with or without a prefix length."""
    v4 = F.substring_index(text, "/", 1).rlike(OCTETS) & (~F.contains(text, F.lit("/")) | prefix_of(text).isNotNull())
    v6 = text.rlike(r"^(?=[0-9a-fA-F:]*:)(?!.*::.*::)([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(/(12[0-8]|1[01]\d|\d?\d))?$")
    return F.coalesce(v4 | v6, F.lit(False))


def address_kind(text: Column) -> Column:
    """'v4', 'v6' or null, by the characters of the text."""
    return F.when(text.rlike(r"^[0-9./]+$"), "v4").when(text.rlike(r"^[0-9a-fA-F:./]+$") & F.contains(text, F.lit(":")), "v6")
