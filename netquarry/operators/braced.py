"""Graph and keywords of braced configurations, from the key table of their JSON (infer.flatten_json).

    interfaces / <interface> / unit / <unit> / family / <family> / address
    groups / <group> / interfaces / <pattern> / unit / <*> / family / <family> / filter / input, output, input-list

IPv4 addresses give their networks; IPv6 ones are nodes by their text in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import ip as ipf
from netquarry.functions.text import common_starts, keywords
from netquarry.operators.graph import union


def _at(depth: int, **fixed: str) -> Column:
    """Paths of a depth with fixed words at places p0, p1, …"""
    out = F.size("path") == depth
    for place, word in fixed.items():
        out = out & (F.get("path", F.lit(int(place[1:]))) == word)
    return out


def _edges(df: DataFrame, src: Column, src_type: str, dst: Column, dst_type: str) -> DataFrame:
    return df.select(src.alias("src"), F.lit(src_type).alias("src_type"), dst.alias("dst"), F.lit(dst_type).alias("dst_type"), F.lit(None).cast("string").alias("etype")).where("src is not null and dst is not null")


def braced_graph(keys: DataFrame) -> DataFrame:
    """Edges interface-unit, unit-subnet, unit-vlan, unit-group and group-ACL; ids of units carry device and interface."""
    k = keys.withColumn("path", F.concat("parent", F.array("key")))
    p = lambda i: F.get("path", F.lit(i))
    iface = F.concat_ws("_", "doc", p(1))
    unit = F.concat_ws("_", F.lit("unit"), "doc", p(1), p(3))
    inside = {"p0": "interfaces", "p2": "unit"}
    units = k.where(_at(4, **inside) & (F.col("container") == "dict"))
    address = {**inside, "p4": "family", "p6": "address"}
    plain = k.where(_at(7, **address) & F.col("leaf").isNotNull()).withColumn("address", F.col("leaf"))
    opened = k.where(_at(8, **address)).withColumn("address", F.col("key"))
    addresses = plain.unionByName(opened)
    v4 = F.concat(ipf.format_ip(ipf.network(ipf.address_of(F.col("address")), ipf.prefix_of(F.col("address")))), F.lit("/"), ipf.prefix_of(F.col("address")).cast("string"))
    net = F.when(ipf.is_address(F.col("address")), F.coalesce(v4, F.lower("address")))
    vlans = k.where(_at(5, **inside, p4="vlan-id") & F.col("leaf").isNotNull())
    applied = k.where(_at(5, **inside, p4="apply-groups") & F.col("leaf").isNotNull()).withColumn("group", F.col("leaf"))
    listed = k.where(_at(6, **inside, p4="apply-groups")).withColumn("group", F.col("key"))
    groups = applied.unionByName(listed)
    filters = {"p0": "groups", "p2": "interfaces", "p4": "unit", "p6": "family", "p8": "filter"}
    named = k.where(_at(10, **filters) & F.col("key").isin("input", "output") & F.col("leaf").isNotNull()).withColumn("acl", F.col("leaf"))
    chains = k.where(_at(11, **filters, p9="input-list")).withColumn("acl", F.col("key"))
    return union(
        _edges(units, iface, "interface", unit, "unit"),
        _edges(addresses, unit, "unit", net, "subnet"),
        _edges(vlans, unit, "unit", F.concat(F.lit("vlan_"), "leaf"), "vlan"),
        _edges(groups, unit, "unit", F.concat(F.lit("group_"), "group"), "group"),
        _edges(named.unionByName(chains), F.concat(F.lit("group_"), p(1)), "group", F.concat(F.lit("acl_"), "acl"), "acl"),
    ).distinct()


def braced_keywords(keys: DataFrame) -> DataFrame:
    """device, kind, owner, word: descriptions of interfaces and units (owner vlan_<unit>), and names of filter terms."""
    k = keys.withColumn("path", F.concat("parent", F.array("key")))
    p = lambda i: F.get("path", F.lit(i))
    text = F.regexp_replace("leaf", '"', "")
    iface = k.where(_at(3, p0="interfaces", p2="description")).select("doc", F.lit("interface").alias("kind"), p(1).alias("owner"), keywords(text, " ").alias("words"))
    unit = k.where(_at(5, p0="interfaces", p2="unit", p4="description")).select("doc", F.lit("interface"), F.concat(F.lit("vlan_"), p(3)), keywords(text, "[ |]"))
    term = k.where(_at(7, p0="firewall", p1="family", p3="filter", p5="term")).select("doc", F.lit("acl"), p(4), keywords(F.col("key"), "[ -]"))
    words = iface.union(unit).select("doc", "kind", "owner", F.explode("words").alias("w")).select("doc", "kind", "owner", F.explode(common_starts(F.col("w"))).alias("word"))
    return words.unionByName(term.toDF("doc", "kind", "owner", "words").select("doc", "kind", "owner", F.explode("words").alias("word"))).withColumnRenamed("doc", "device").distinct()
