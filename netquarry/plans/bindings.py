"""Configuration tables out of the driver's tables, in Spark and (the *_SQL texts) in DuckDB.

interfaces: customers; devices: nations; VLANs of trunk interfaces: parts of orders; ACLs: nations and market segments;
keywords: words of part names and order priorities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.session import parts_for

BASE_IP = 167772160  # 10.0.0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trunks(spark: SparkSession, d: str) -> DataFrame:
    """iface, vlan."""
    line = table(spark, d, "lineitem")
    dealt = line.select(F.col("l_orderkey").alias("iface"), F.col("l_partkey").alias("vlan")).repartition(parts_for(line.count(), spark), "iface", "vlan")
    return dealt.distinct()


TRUNKS_SQL = "trunks AS (SELECT DISTINCT l_orderkey AS iface, l_partkey AS vlan FROM lineitem)"


def interfaces(spark: SparkSession, d: str) -> DataFrame:
    """device, iface, ip (null for some), length, in_acl, out_acl."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_nationkey").cast("long").alias("device"),
        F.col("c_custkey").alias("iface"),
        F.when(F.col("c_acctbal") >= -500, F.col("c_custkey") * 256 + (BASE_IP + 1)).alias("ip"),
        F.lit(24).alias("length"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("in_acl"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey"))).alias("out_acl"),
    )


INTERFACES_SQL = f"""interfaces AS (SELECT c_nationkey::BIGINT AS device, c_custkey AS iface,
  CASE WHEN c_acctbal >= -500 THEN c_custkey * 256 + {BASE_IP + 1} END AS ip, 24 AS length,
  CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS in_acl,
  CASE WHEN c_nationkey % 2 = 0 THEN 'NATION_' || c_nationkey END AS out_acl FROM customer)"""


def acl_lines(spark: SparkSession, d: str) -> DataFrame:
    """acl, line_no, action, src (CIDR), dst (CIDR, may be null)."""
    s = table(spark, d, "supplier")
    net = F.col("s_suppkey") * 4096 + BASE_IP
    text = F.concat_ws(".", *[F.shiftright(net, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])
    own = s.select(
        F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("acl"),
        F.col("s_suppkey").alias("line_no"),
        F.when(F.col("s_acctbal") > 3000, "PERMIT").otherwise("DENY").alias("action"),
        F.concat(text, F.lit("/20")).alias("src"),
        F.when(F.col("s_acctbal") > 6000, F.lit("0.0.0.0/0")).when(F.col("s_acctbal") > 3000, F.concat(text, F.lit("/28"))).alias("dst"),
    )
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("k"))
    net = (F.col("k") - F.col("k") % 16) * 256 + BASE_IP
    text = F.concat_ws(".", *[F.shiftright(net, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])
    return own.unionByName(c.select(F.col("c_mktsegment").alias("acl"), F.col("c_nationkey").cast("long").alias("line_no"), F.lit("PERMIT").alias("action"), F.concat(text, F.lit("/20")).alias("src"), F.lit(None).cast("string").alias("dst")))


_DOTTED = "(({0} >> 24) & 255) || '.' || (({0} >> 16) & 255) || '.' || (({0} >> 8) & 255) || '.' || ({0} & 255)"
DOTTED_SQL = _DOTTED
ACL_LINES_SQL = f"""acl_lines AS (
  SELECT 'NATION_' || s_nationkey AS acl, s_suppkey AS line_no, CASE WHEN s_acctbal > 3000 THEN 'PERMIT' ELSE 'DENY' END AS action,
    s_suppkey * 4096 + {BASE_IP} AS slo, s_suppkey * 4096 + {BASE_IP} + 4095 AS shi, 20 AS slen,
    CASE WHEN s_acctbal > 3000 AND s_acctbal <= 6000 THEN s_suppkey * 4096 + {BASE_IP} END AS dlo,
    CASE WHEN s_acctbal > 3000 AND s_acctbal <= 6000 THEN s_suppkey * 4096 + {BASE_IP} + 15 END AS dhi FROM supplier
  UNION ALL SELECT c_mktsegment, c_nationkey::BIGINT, 'PERMIT', (k - k % 16) * 256 + {BASE_IP}, (k - k % 16) * 256 + {BASE_IP} + 4095, 20, NULL, NULL
  FROM (SELECT c_mktsegment, c_nationkey, min(c_custkey) AS k FROM customer GROUP BY ALL)),
acl_nets AS (SELECT acl, line_no, slo AS lo, shi AS hi FROM acl_lines UNION ALL SELECT acl, line_no, dlo, dhi FROM acl_lines WHERE dlo IS NOT NULL)"""


def iface_keywords(spark: SparkSession, d: str) -> DataFrame:
    """device, iface, word: words of the parts that a customer ordered and of the priorities.

    Names are split where their customer's lie, and only words are made distinct: a task holds the words of its customers, not
    their names. Shuffles have as many parts as keep a task small.
    """
    lineitem, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    # Counts of Parquet files are in their footers.
    n = parts_for(lineitem.count(), spark)
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    line = lineitem.select("l_orderkey", "l_partkey").repartition(n, "l_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    named = line.join(p, line["l_partkey"] == p["p_partkey"]).select("l_orderkey", "p_name").repartition(n, "l_orderkey")
    names = named.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("iface"), F.col("p_name").alias("name"), F.lit(True).alias("split"))
    names = names.unionByName(o.select(F.col("o_custkey").alias("iface"), F.lower("o_orderpriority").alias("name"), F.lit(False).alias("split")))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("iface"), F.col("c_nationkey").cast("long").alias("device"))
    # All that follows is by customer: no further shuffle of names. Broadcast, customers would be held by each task whole.
    names = names.repartition(n, "iface")
    words = names.select("iface", F.explode(F.when(F.col("split"), F.split("name", " ")).otherwise(F.array("name"))).alias("word")).distinct()
    return words.join(c.hint("merge"), "iface").select("device", "iface", "word")


IFACE_KEYWORDS_SQL = """iface_keywords AS (SELECT DISTINCT c_nationkey::BIGINT AS device, c_custkey AS iface, word FROM (
  SELECT o_custkey, unnest(string_split(p_name, ' ')) AS word FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT o_custkey, lower(o_orderpriority) FROM orders) JOIN customer ON o_custkey = c_custkey)"""


def site_edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed simple graph: src, src_type, dst, dst_type, etype; interfaces with VLAN (nation), ACL (segment), keyword (region)."""
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier")
    node = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    iface = node("interface", "c_custkey")
    out = [
        c.select(iface.alias("src"), F.lit("interface").alias("src_type"), node("vlan", "c_nationkey").alias("dst"), F.lit("vlan").alias("dst_type"), F.lit("allowed").alias("etype")),
        c.where("c_acctbal > 0").select(iface, F.lit("interface"), node("acl", "c_mktsegment"), F.lit("acl"), F.lit("in")),
        n.select(node("vlan", "n_nationkey"), F.lit("vlan"), node("keyword", "n_regionkey"), F.lit("keyword"), F.lit(None).cast("string")),
        c.groupBy("c_mktsegment").agg(F.min("c_nationkey").alias("k")).select(node("acl", "c_mktsegment"), F.lit("acl"), node("vlan", "k"), F.lit("vlan"), F.lit("src")),
        s.select(node("interface", "s_name"), F.lit("interface"), node("vlan", "s_nationkey"), F.lit("vlan"), F.lit("allowed")),
    ]
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole.distinct()


SITE_SQL = """site AS (
  SELECT DISTINCT 'interface:' || c_custkey AS src, 'interface' AS src_type, 'vlan:' || c_nationkey AS dst, 'vlan' AS dst_type, 'allowed' AS etype FROM customer
  UNION ALL SELECT DISTINCT 'interface:' || c_custkey, 'interface', 'acl:' || c_mktsegment, 'acl', 'in' FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT DISTINCT 'vlan:' || n_nationkey, 'vlan', 'keyword:' || n_regionkey, 'keyword', NULL FROM nation
  UNION ALL SELECT 'acl:' || c_mktsegment, 'acl', 'vlan:' || min(c_nationkey), 'vlan', 'src' FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT DISTINCT 'interface:' || s_name, 'interface', 'vlan:' || s_nationkey, 'vlan', 'allowed' FROM supplier),
adj AS (SELECT src AS id, src_type AS type, dst AS nbr, dst_type AS nbr_type FROM site UNION SELECT dst, dst_type, src, src_type FROM site)"""


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Graph of trunk interfaces, VLANs and the keywords of their names."""
    p = table(spark, d, "part")
    t = trunks(spark, d).select(F.concat(F.lit("interface:"), "iface").alias("src"), F.lit("interface").alias("src_type"), F.concat(F.lit("vlan:"), "vlan").alias("dst"), F.lit("vlan").alias("dst_type"), F.lit("allowed").alias("etype"))
    k = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    k = k.distinct().select(F.concat(F.lit("vlan:"), "p_partkey"), F.lit("vlan"), F.concat(F.lit("keyword:"), "w"), F.lit("keyword"), F.lit(None).cast("string"))
    # Trunks and keywords are distinct already and have no edge in common.
    return t.union(k)


PARTS_SQL = """parts AS (
  SELECT DISTINCT 'interface:' || l_orderkey AS src, 'interface' AS src_type, 'vlan:' || l_partkey AS dst, 'vlan' AS dst_type, 'allowed' AS etype FROM lineitem
  UNION SELECT 'vlan:' || p_partkey, 'vlan', 'keyword:' || unnest(string_split(p_name, ' ')), 'keyword', NULL FROM part),
adj AS (SELECT src AS id, src_type AS type, dst AS nbr, dst_type AS nbr_type FROM parts UNION SELECT dst, dst_type, src, src_type FROM parts)"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    """period (an hour, as text), col: event types seen in that hour. Hours stand for the dates of snapshots."""
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("period"), F.col("event_type").alias("col")).distinct()


CHANGES_SQL = "changes AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS period, event_type AS col FROM events)"


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Earlier and later state of (device, stanza, element): last attr values of each half of the events."""
    e = table(spark, d, "events")
    half = e.agg((F.max("event_id") / 2).cast("long").alias("mid"))
    # One row is broadcast.
    e = e.join(F.broadcast(half))
    out = []
    for keep in (F.col("event_id") <= F.col("mid"), F.col("event_id") > F.col("mid")):
        last = e.where(keep).groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "props"), "event_id").alias("x"), F.max("event_id").alias("seq"))
        flat = last.select(F.col("user_id").alias("device"), F.col("event_type").alias("stanza"), F.expr("stack(2, 'value', cast(round(x.value) as bigint) div 10 || '', 'props', x.props)").alias("attr", "val"))
        out.append(flat.withColumn("element", F.lit("last")))
    return out[0], out[1]


SNAPSHOTS_SQL = """mid AS (SELECT max(event_id) // 2 AS mid FROM events),
halves AS (SELECT user_id AS device, event_type AS stanza, event_id <= mid AS early, arg_max(value, event_id) AS v, arg_max(props, event_id) AS p FROM events, mid GROUP BY ALL),
state AS (SELECT device, stanza, 'last' AS element, early, 'value' AS attr, (round(v)::BIGINT // 10)::VARCHAR AS val FROM halves
  UNION ALL SELECT device, stanza, 'last', early, 'props', p FROM halves)"""


def frame(spark: SparkSession, d: str) -> DataFrame:
    """Wide frame for contrast sets: row_id, grp, and categorical features of each order line."""
    line = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("grp"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("kind"), "p_size")
    joined = line.join(o, line["l_orderkey"] == o["o_orderkey"]).join(p, line["l_partkey"] == p["p_partkey"])
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "grp", "priority", "kind", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "p_size")


FRAME_SQL = """frame AS (SELECT o_orderstatus AS grp, substr(o_orderpriority, 1, 1) AS priority, p_type AS kind, l_returnflag AS flag, l_linestatus AS status, p_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
