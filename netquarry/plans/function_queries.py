"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.functions import ip as ipf
from netquarry.functions import text as T
from netquarry.functions.rules import additional_metrics, rule_group, rule_items
from netquarry.operators.nearest import hamming_pairs
from netquarry.plans import bindings as B
from netquarry.plans.registry import query

DOT = B.DOTTED_SQL


@query(
    "f07_octets_and_binary",
    f"""WITH {B.INTERFACES_SQL} SELECT iface, coalesce(((ip >> 24) & 255)::VARCHAR, 'none') AS o1, coalesce(((ip >> 16) & 255)::VARCHAR, 'none') AS o2,
  coalesce(((ip >> 8) & 255)::VARCHAR, 'none') AS o3, coalesce((ip & 255)::VARCHAR, 'none') AS o4, coalesce(right(repeat('0', 32) || format('{{:b}}', ip), 32), 'none') AS bits,
  coalesce(left(right(repeat('0', 32) || format('{{:b}}', ip), 32), 20), 'none') AS first20 FROM interfaces""",
)
def f07(spark, d):
    i = B.interfaces(spark, d)
    return i.select("iface", *[ipf.octet(F.col("ip"), k).alias(f"o{k}") for k in (1, 2, 3, 4)], ipf.binary(F.col("ip")).alias("bits"), F.get(ipf.cumulative_prefixes(F.col("ip")), F.lit(19)).alias("first20"))


@query(
    "f08_supernets",
    f"""WITH {B.INTERFACES_SQL}, l AS (SELECT unnest(range(20, 32)) AS length)
SELECT iface, l.length AS length, CASE WHEN ip IS NULL THEN 'n' ELSE {DOT.format("((ip >> (32 - l.length)) << (32 - l.length))")} || '/' || l.length END AS net FROM interfaces, l""",
)
def f08(spark, d):
    nets = B.interfaces(spark, d).select("iface", F.posexplode(ipf.supernets(F.col("ip"))).alias("k", "net"))
    return nets.select("iface", (F.col("k") + 20).alias("length"), "net")


@query("f09_wildcard_networks", "SELECT s_suppkey AS k, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE s_suppkey * 4096 + 167772160 END AS lo, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE s_suppkey * 4096 + 167772160 + 4095 END AS hi FROM supplier")
def f09(spark, d):
    start = F.col("s_suppkey") * 4096 + B.BASE_IP
    s = B.table(spark, d, "supplier").select("s_suppkey", ipf.wildcard_network(ipf.format_ip(start), F.when(F.col("s_nationkey") % 3 == 0, "0.0.5.255").otherwise("0.0.15.255")).alias("net"))
    return s.select(F.col("s_suppkey").alias("k"), "net.lo", "net.hi")


@query("f12_generalize_address", f"SELECT s_suppkey AS k, CASE WHEN s_nationkey = 0 THEN 'any' ELSE {DOT.format('(s_suppkey * 4096 + 167772160)')} || '/20' END AS net FROM supplier")
def f12(spark, d):
    whole = ipf.format_ip(F.col("s_suppkey") * 4096 + (B.BASE_IP + 77))
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), ipf.generalize_address(F.when(F.col("s_nationkey") == 0, "any").otherwise(F.concat(whole, F.lit("/20")))).alias("net"))


@query("f13_f14_addresses", f"SELECT c_nationkey AS k, bool_and(c_acctbal >= 0) AS every, count(*) FILTER (c_acctbal >= 0) AS v4 FROM customer GROUP BY 1")
def f13(spark, d):
    name = F.when(F.col("c_acctbal") >= 0, F.concat(ipf.format_ip(F.col("c_custkey") + B.BASE_IP), F.lit("/24"))).otherwise(F.col("c_name"))
    c = B.table(spark, d, "customer").select("c_nationkey", name.alias("x"))
    return c.groupBy(F.col("c_nationkey").alias("k")).agg(F.bool_and(ipf.is_address(F.col("x"))).alias("every"), F.count(ipf.address_kind(F.col("x"))).alias("v4"))


@query(
    "f03_keywords",
    f"""WITH w AS (SELECT DISTINCT doc_id, lower(unnest(string_split(text, ' '))) AS w FROM documents)
SELECT w AS word, count(*) AS docs FROM w WHERE length(w) > 1 AND w NOT IN ({", ".join(f"'{x}'" for x in T.STOPWORDS)}) GROUP BY 1""",
)
def f03(spark, d):
    words = B.table(spark, d, "documents").select(F.explode(T.keywords(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("docs"))


SHARED_SQL = """SELECT a, b, coalesce((SELECT substr(a, i, k) FROM (SELECT unnest(range(1, length(a) + 1)) AS i), (SELECT unnest(range(1, length(a) + 1)) AS k)
  WHERE i + k - 1 <= length(a) AND contains(b, substr(a, i, k)) ORDER BY k DESC, i LIMIT 1), '') AS shared FROM names"""
NAMES_SQL = "names AS (SELECT DISTINCT p.p_type AS b, q.p_name AS a FROM part p JOIN part q ON p.p_size = q.p_size)"


@query("f04_longest_shared", f"WITH {NAMES_SQL.replace('p.p_type AS b', 'lower(p.p_type) AS b')} {SHARED_SQL}")
def f04(spark, d):
    p = B.table(spark, d, "part")
    pairs = p.select(F.lower("p_type").alias("b"), "p_size").distinct().join(p.select(F.col("p_name").alias("a"), "p_size").distinct(), "p_size").select("a", "b").distinct()
    return pairs.withColumn("shared", T.longest_shared(F.col("a"), F.col("b")))


@query("f05_similar_words", f"WITH {NAMES_SQL.replace('p.p_type AS b', 'p.p_name AS b')} SELECT a, b, shared FROM ({SHARED_SQL}) WHERE length(shared) >= 3 AND a < b")
def f05(spark, d):
    p = B.table(spark, d, "part").select("p_name", "p_size").distinct()
    pairs = p.select(F.col("p_name").alias("a"), "p_size").join(p.select(F.col("p_name").alias("b"), "p_size"), "p_size").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("shared", T.longest_shared(F.col("a"), F.col("b"))).where(F.length("shared") >= 3)


@query(
    "f06_common_starts",
    """WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part),
s AS (SELECT unnest(['re', 'bo', 'ge']) AS s), hit AS (SELECT p_partkey, s AS word FROM w JOIN s ON contains(w, s) UNION SELECT p_partkey, w FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(w, s)))
SELECT word, count(DISTINCT p_partkey) AS owners FROM hit GROUP BY word""",
)
def f06(spark, d):
    w = B.table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    folded = w.select("p_partkey", F.explode(T.common_starts(F.col("w"), ("re", "bo", "ge"))).alias("word"))
    return folded.groupBy("word").agg(F.count_distinct("p_partkey").alias("owners"))


@query(
    "f15_ranges",
    """WITH x AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), g AS (SELECT s, p, p - row_number() OVER (PARTITION BY s ORDER BY p) AS g FROM x),
i AS (SELECT s, min(p) AS lo, max(p) AS hi FROM g GROUP BY s, g)
SELECT s AS k, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS spans FROM i GROUP BY s""",
)
def f15(spark, d):
    x = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_partkey").alias("p"))
    return x.select("k", T.ranges(F.col("p")).alias("spans"))


@query("s10_expand_ranges", "SELECT o_orderkey AS k, list_concat(range(o_custkey, o_custkey + o_orderkey % 5 + 1), [o_custkey + 100]) AS numbers FROM orders")
def s10(spark, d):
    o = B.table(spark, d, "orders")
    text = F.concat(F.col("o_custkey"), F.lit("-"), F.col("o_custkey") + F.col("o_orderkey") % 5, F.lit(", "), F.col("o_custkey") + 100)
    return o.select(F.col("o_orderkey").alias("k"), T.expand_ranges(text).cast("array<bigint>").alias("numbers"))


@query("f17_strip_digits", "SELECT DISTINCT CASE WHEN regexp_full_match(x, '[0-9]+') THEN x ELSE regexp_replace(x, '[0-9]', '', 'g') END AS word FROM (SELECT p_brand AS x FROM part UNION ALL SELECT p_size::VARCHAR FROM part)")
def f17(spark, d):
    p = B.table(spark, d, "part")
    return p.select(F.col("p_brand").alias("x")).union(p.select(F.col("p_size").cast("string"))).select(T.strip_digits(F.col("x")).alias("word")).distinct()


@query("f18_rule_items", "SELECT c_custkey AS k, c_mktsegment AS a, c_nationkey::VARCHAR AS b, c_nationkey % 10 AS grp FROM customer")
def f18(spark, d):
    c = B.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("('a=>"), "c_mktsegment", F.lit("', 'b=>"), F.col("c_nationkey"), F.lit("')")).alias("rule"), F.concat(F.lit("group=>"), F.col("c_nationkey")).alias("g"))
    items = rule_items(F.col("rule"))
    return c.select(F.col("c_custkey").alias("k"), items["a"].alias("a"), items["b"].alias("b"), rule_group(F.col("g")).alias("grp"))


METRICS_SQL = """rules AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'R') / count(*) AS precision, count(*) FILTER (l_returnflag = 'R') / (1.0 * sum(count(*) FILTER (l_returnflag = 'R')) OVER ()) AS recall, count(*) AS frequency FROM lineitem GROUP BY 1)"""


@query(
    "f19_additional_metrics",
    f"""WITH {METRICS_SQL}, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rules)
SELECT k, frequency, round(f1, 6) AS f1, round(10 * precision + frequency / max(frequency) OVER () + 2 * f1, 6) AS weighted FROM f""",
)
def f19(spark, d):
    line = B.table(spark, d, "lineitem")
    total = line.agg(F.count_if(F.col("l_returnflag") == "R").alias("all_r"))
    rules = line.groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("frequency")).join(F.broadcast(total))
    rules = rules.select("k", "frequency", (F.col("r") / F.col("frequency")).alias("precision"), (F.col("r") / F.col("all_r")).alias("recall"))
    return additional_metrics(rules).select("k", "frequency", F.round("f1", 6).alias("f1"), F.round("weighted", 6).alias("weighted"))


@query("f16_hamming", "SELECT a.vec_id AS a, b.vec_id AS b, len(list_filter(range(1, 65), lambda i: (a.embedding[i] > 0) <> (b.embedding[i] > 0))) / 64.0 AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def f16(spark, d):
    e = B.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x > 0).alias("bits"))
    return hamming_pairs(e, "label")


@query("f20_regex_found", "SELECT p_type AS k, count(*) FILTER (regexp_matches(p_name, 'r[ei]')) AS hits FROM part GROUP BY 1")
def f20(spark, d):
    return B.table(spark, d, "part").groupBy(F.col("p_type").alias("k")).agg(F.count_if(F.col("p_name").rlike("r[ei]")).alias("hits"))
