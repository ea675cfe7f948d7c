"""Association rules with confidence over interfaces, ACLs, keywords and VLANs.

Rules are rows (msg, n, d, c); c is null where d is 0. Every function takes and returns DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions import ip as ipf
from netquarry.functions.rules import confidence
from netquarry.operators.numbering import numbered_in

MOST_VLANS = 1024


def _rule(df: DataFrame, msg, n, d) -> DataFrame:
    return df.select(msg.alias("msg"), n.cast("long").alias("n"), d.cast("long").alias("d")).withColumn("c", confidence(F.col("n"), F.col("d")))


# references


def reference_counts(interfaces: DataFrame) -> DataFrame:
    """One row: interfaces, with any ACL, with in, with out, with both. The last three count IP addresses once (last interface wins)."""
    per_iface = interfaces.agg(F.count("*").alias("ifaces"), F.count_if(F.col("in_acl").isNotNull() | F.col("out_acl").isNotNull()).alias("with_acl"))
    by_ip = addressed(interfaces).agg(F.count_if(F.col("in_acl").isNotNull()).alias("with_in"), F.count_if(F.col("out_acl").isNotNull()).alias("with_out"), F.count_if(F.col("in_acl").isNotNull() & F.col("out_acl").isNotNull()).alias("with_both"))
    return per_iface.join(F.broadcast(by_ip))


def addressed(interfaces: DataFrame) -> DataFrame:
    """One row an IP address: the last interface that has it."""
    return interfaces.where("ip is not null").groupBy("ip").agg(F.max_by(F.struct("device", "iface", "in_acl", "out_acl"), "iface").alias("x")).select("ip", "x.*")


def applied(interfaces: DataFrame) -> DataFrame:
    """device, iface, ip, direction, acl for every applied ACL."""
    return interfaces.select("device", "iface", "ip", F.expr("stack(2, 'in', in_acl, 'out', out_acl)").alias("direction", "acl")).where("acl is not null")


def acl_networks(lines: DataFrame) -> DataFrame:
    """acl, line_no, lo, hi, length of the source and destination networks; the whole address space and invalid networks are left out."""
    sides = lines.select("acl", "line_no", F.explode(F.array("src", "dst")).alias("cidr")).where("cidr is not null")
    nets = sides.withColumn("net", ipf.strict_network(F.col("cidr")))
    return nets.where("net is not null and net.length > 0").select("acl", "line_no", "net.lo", "net.hi", "net.length")


def covering(networks: DataFrame, addresses: DataFrame) -> DataFrame:
    """Distinct (acl, ip) where a network of the ACL holds the address.

    An equi-join on (prefix length, network): every address offers one row for each prefix length in use, so nothing is
    compared by range. Prefix lengths are at most 33.
    """
    lengths = networks.select("length").distinct()
    offered = addresses.select("ip").distinct().join(F.broadcast(lengths)).withColumn("lo", ipf.network(F.col("ip"), F.col("length")))
    return offered.join(networks.select("acl", "lo", "length"), ["length", "lo"]).select("acl", "ip").distinct()


def cover_rule(networks: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Of the (ACL, address) pairs where the ACL covers the address, those where it is applied."""
    by_ip = addressed(interfaces)
    pairs = covering(networks, by_ip).join(by_ip, "ip")
    hit = F.coalesce(F.col("acl") == F.col("in_acl"), F.lit(False)) | F.coalesce(F.col("acl") == F.col("out_acl"), F.lit(False))
    return _rule(pairs.agg(F.count_if(hit).alias("n"), F.count("*").alias("d")), F.lit("C(ACL covers interface's IP => interface has that ACL applied)"), F.col("n"), F.col("d"))


def acl_ranges(networks: DataFrame, interfaces: DataFrame) -> DataFrame:
    """acl, lo, hi: span of the addresses to which an ACL with networks is applied."""
    used = applied(addressed(interfaces))
    return used.join(networks.select("acl").distinct(), "acl", "left_semi").groupBy("acl").agg(F.min("ip").alias("lo"), F.max("ip").alias("hi"))


def range_counts(spans: DataFrame, addresses: DataFrame, *keys: str) -> DataFrame:
    """Addresses inside each span [lo, hi], by prefix counts: both ends look up a running count, no range join.

    The running count needs one order over all addresses; it is made of totals by /16 (at most 65536 rows, in one window)
    and a window within each /16.
    """
    points = addresses.groupBy("ip").agg(F.count("*").alias("n")).withColumn("block", F.shiftright("ip", 16))
    totals = points.groupBy("block").agg(F.sum("n").alias("t")).withColumn("ahead", F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", F.coalesce("ahead", F.lit(0)).alias("ahead"))
    ends = spans.select(*keys, F.expr("stack(2, lo - 1, -1L, hi, 1L)").alias("at", "sign")).withColumn("block", F.shiftright("at", 16))
    everything = points.select("block", F.col("ip").alias("at"), "n", F.lit(0).alias("kind")).unionByName(ends.select("block", "at", F.lit(0).cast("long").alias("n"), F.lit(1).alias("kind")).distinct())
    within = everything.withColumn("seen", F.sum("n").over(Window.partitionBy("block").orderBy("at", "kind"))).where("kind = 1").select("block", "at", "seen")
    every = totals.select("block", F.col("ahead")).unionByName(ends.select("block").distinct().join(totals.select("block"), "block", "left_anti").withColumn("ahead", F.lit(None).cast("long")))
    total = points.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    grown = every.withColumn("next", F.first("ahead", True).over(Window.orderBy("block").rowsBetween(0, Window.unboundedFollowing))).join(F.broadcast(total))
    start = grown.select("block", F.coalesce("next", "whole").alias("start"))
    found = ends.join(within, ["block", "at"]).join(start, "block")
    return found.groupBy(*keys).agg(F.sum(F.col("sign") * (F.col("start") + F.col("seen"))).alias("d"))


def range_rules(networks: DataFrame, interfaces: DataFrame) -> DataFrame:
    """For each ACL: of the addresses in the span of its own, those with the ACL applied (once, even if in and out)."""
    by_ip = addressed(interfaces)
    spans = acl_ranges(networks, interfaces)
    inside = range_counts(spans, by_ip, "acl")
    own = applied(by_ip).select("acl", "ip").distinct().groupBy("acl").agg(F.count("*").alias("n"))
    both = spans.join(inside, "acl").join(own, "acl")
    msg = F.concat(F.lit("C(interface's IP falls within range ['"), ipf.format_ip(F.col("lo")), F.lit("', '"), ipf.format_ip(F.col("hi")), F.lit("'] => ACL "), F.col("acl"), F.lit(" applied to the interface)"))
    return _rule(both, msg, F.col("n"), F.col("d"))


def reference_rules(interfaces: DataFrame, lines: DataFrame) -> DataFrame:
    """The four fixed rules and one for each ACL."""
    counts = reference_counts(interfaces)
    fixed = counts.select(
        F.explode(
            F.array(
                F.struct(F.lit("C(interface => has ACL reference)").alias("msg"), F.col("with_acl").alias("n"), F.col("ifaces").alias("d")),
                F.struct(F.lit("C(interface has 'in' ACL applied => interface has 'out' ACL applied)").alias("msg"), F.col("with_both").alias("n"), F.col("with_in").alias("d")),
                F.struct(F.lit("C(interface has 'out' ACL applied => interface has 'in' ACL applied)").alias("msg"), F.col("with_both").alias("n"), F.col("with_out").alias("d")),
            )
        ).alias("r")
    ).select("r.*")
    networks = acl_networks(lines)
    return _rule(fixed, F.col("msg"), F.col("n"), F.col("d")).unionByName(cover_rule(networks, interfaces)).unionByName(range_rules(networks, interfaces))


# keywords


def common_keywords(keywords: DataFrame, threshold: int = 10) -> DataFrame:
    """word, count of the (device, iface) that have it, if at least threshold."""
    return keywords.groupBy("word").agg(F.count_distinct("device", "iface").alias("count")).where(F.col("count") >= threshold)


def keyword_rules(keywords: DataFrame, interfaces: DataFrame, threshold: int = 10) -> DataFrame:
    """word, acl, n, d, c: of the interfaces with a common keyword, those with the ACL applied, for every ACL in use.

    Counted from the (word, acl) pairs that occur; the others are filled in with 0. What is crossed is the list of common
    words and the list of ACLs, both without their interfaces.
    """
    common = common_keywords(keywords, threshold)
    has = keywords.join(common.select("word"), "word").select("word", "device", "iface").distinct()
    used = applied(interfaces).select("device", "iface", "acl").distinct()
    hits = has.join(used, ["device", "iface"]).groupBy("word", "acl").agg(F.count("*").alias("n"))
    every = common.crossJoin(used.select("acl").distinct())
    out = every.join(hits, ["word", "acl"], "left").select("word", "acl", F.coalesce("n", F.lit(0)).alias("n"), F.col("count").alias("d"))
    return out.withColumn("c", confidence(F.col("n"), F.col("d")))


def keyword_exceptions(keywords: DataFrame, interfaces: DataFrame, rules: DataFrame) -> DataFrame:
    """word, acl, device, iface: interfaces with the keyword and without the ACL, for the given rules."""
    used = applied(interfaces).select("device", "iface", "acl").distinct()
    has = keywords.select("word", "device", "iface").distinct().join(rules.select("word", "acl"), "word")
    return has.join(used, ["device", "iface", "acl"], "left_anti").select("word", "acl", "device", "iface")


def keyword_stanzas(keywords: DataFrame) -> DataFrame:
    """word, owners, devices: how many interfaces and devices have a word.

    Owners are counted for each device first, so a word's owners are not doubled and dealt again for its devices.
    """
    owned = keywords.select("word", "device", "iface").distinct()
    by_device = owned.groupBy("word", "device").agg(F.count("iface").alias("n"))
    owners = F.sum(F.when(F.col("device").isNotNull(), F.col("n")).otherwise(0))
    return by_device.groupBy("word").agg(owners.alias("owners"), F.count("device").alias("devices"))


def keyword_pairing(interfaces: DataFrame, keywords: DataFrame) -> DataFrame:
    """device, ifaces, words: interfaces that have a keyword, and how many keywords they have in all. Only an interface's number of keywords is joined."""
    numbers = keywords.groupBy("device", "iface").agg(F.count("*").alias("n"))
    # Broadcast, either would be held by each task whole.
    paired = interfaces.select("device", "iface").hint("merge").join(numbers, ["device", "iface"])
    return paired.groupBy("device").agg(F.count_distinct("iface").alias("ifaces"), F.sum("n").alias("words"))


def keyword_owners(keywords: DataFrame) -> DataFrame:
    """Inverted index: word, k, device, iface; a word's owners in order, from 0. It is long, so a word that most interfaces have is no row of its own."""
    owned = keywords.select("word", F.struct("device", "iface").alias("owner")).distinct()
    return numbered_in(owned, "word", "owner").select("word", "k", "owner.device", "owner.iface")


def keyword_ospf(keywords: DataFrame, ospf: DataFrame, threshold: int = 10) -> DataFrame:
    """word, n, d, c: of the interfaces with a common keyword, those that run OSPF."""
    marked = keywords.select("word", "device", "iface").distinct().join(ospf.select("device", "iface").distinct().withColumn("runs", F.lit(True)), ["device", "iface"], "left")
    out = marked.groupBy("word").agg(F.count_if(F.col("runs")).alias("n"), F.count("*").alias("d")).where(F.col("d") >= threshold)
    return out.withColumn("c", confidence(F.col("n"), F.col("d")))


def keyword_ranges(keywords: DataFrame, interfaces: DataFrame) -> DataFrame:
    """word, lo, hi, n, d, c: addresses with the keyword, of all addresses in the span of those."""
    has = keywords.join(interfaces.where("ip is not null").select("device", "iface", "ip"), ["device", "iface"])
    spans = has.groupBy("word").agg(F.min("ip").alias("lo"), F.max("ip").alias("hi"), F.count_distinct("device", "iface").alias("n"))
    inside = range_counts(spans, interfaces.where("ip is not null"), "word")
    return spans.join(inside, "word").withColumn("c", confidence(F.col("n"), F.col("d")))


# VLANs


def vlan_pairs(trunks: DataFrame, most: int = MOST_VLANS) -> DataFrame:
    """v1, v2, n, d, c for both directions: of the trunk interfaces with v1, those with v2. Interfaces with more VLANs than most are left out."""
    sizes = trunks.groupBy("iface").agg(F.count("*").alias("size")).where(F.col("size") <= most).select("iface")
    kept = trunks.join(sizes, "iface", "left_semi")
    single = kept.groupBy("vlan").agg(F.count("*").alias("d"))
    left = kept.select("iface", F.col("vlan").alias("a"))
    right = kept.select("iface", F.col("vlan").alias("b"))
    pairs = left.join(right, "iface").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v1"), F.col("b").alias("v2")), F.struct(F.col("b").alias("v1"), F.col("a").alias("v2")))).alias("p"), "n").select("p.*", "n")
    return both.join(single.withColumnRenamed("vlan", "v1"), "v1").select("v1", "v2", "n", "d", confidence(F.col("n"), F.col("d")).alias("c"))


def frequent_itemsets(trunks: DataFrame, support: float = 0.5, least: int = 2) -> DataFrame:
    """items (sorted), freq: VLAN sets of at least `least` that a share of the interfaces accepts together."""
    from pyspark.ml.fpm import FPGrowth

    baskets = trunks.groupBy("iface").agg(F.collect_set("vlan").alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    return found.where(F.size("items") >= least).select(F.array_sort("items").alias("items"), "freq")
