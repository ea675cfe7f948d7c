"""Association rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.functions.rules import confidence, filter_confidence
from netquarry.operators import associations as A
from netquarry.plans import bindings as B
from netquarry.plans.registry import query

C = "CASE WHEN {d} > 0 THEN ((2000 * {n} + {d}) // (2 * {d})) / 1000.0 END"


def c_sql(n: str, d: str) -> str:
    return C.format(n=n, d=d)


BY_IP_SQL = "by_ip AS (SELECT ip, first(in_acl ORDER BY iface DESC) AS in_acl, first(out_acl ORDER BY iface DESC) AS out_acl, max(iface) AS iface FROM interfaces WHERE ip IS NOT NULL GROUP BY ip)"
APPLIED_SQL = "applied AS (SELECT device, iface, ip, 'in' AS direction, in_acl AS acl FROM interfaces WHERE in_acl IS NOT NULL UNION ALL SELECT device, iface, ip, 'out', out_acl FROM interfaces WHERE out_acl IS NOT NULL)"
COVER_SQL = "cover AS (SELECT DISTINCT acl, ip FROM acl_nets JOIN by_ip ON ip BETWEEN lo AND hi)"
SPANS_SQL = """used AS (SELECT ip, in_acl AS acl FROM by_ip WHERE in_acl IS NOT NULL UNION SELECT ip, out_acl FROM by_ip WHERE out_acl IS NOT NULL),
spans AS (SELECT acl, min(ip) AS lo, max(ip) AS hi, count(DISTINCT ip) AS n FROM used WHERE acl IN (SELECT acl FROM acl_nets) GROUP BY acl)"""
VLAN_PAIRS_SQL = f"""WITH {B.TRUNKS_SQL},
kept AS (SELECT * FROM trunks WHERE iface IN (SELECT iface FROM trunks GROUP BY iface HAVING count(*) <= 1024)),
single AS (SELECT vlan, count(*) AS d FROM kept GROUP BY vlan),
pairs AS (SELECT a.vlan AS v1, b.vlan AS v2, count(*) AS n FROM kept a JOIN kept b ON a.iface = b.iface AND a.vlan <> b.vlan GROUP BY ALL)
SELECT v1, v2, n, d, {c_sql("n", "d")} AS c FROM pairs JOIN single ON vlan = v1"""


@query("a07_vlan_pair_confidence", VLAN_PAIRS_SQL)
def a07(spark, d):
    return A.vlan_pairs(B.trunks(spark, d))


@query("f02_filter_confidence", f"SELECT * FROM ({VLAN_PAIRS_SQL}) WHERE c >= 0.04 AND n >= 2 AND d >= 3")
def f02(spark, d):
    return filter_confidence(A.vlan_pairs(B.trunks(spark, d)), 0.04, 2, 3)


@query("f01_confidence", f"SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'R') AS n, count(*) FILTER (l_linenumber < 4) AS d, {c_sql('n', 'd')} AS c FROM lineitem GROUP BY 1")
def f01(spark, d):
    out = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count_if(F.col("l_linenumber") < 4).alias("d"))
    return out.withColumn("c", confidence(F.col("n"), F.col("d")))


@query("j02_applied_acls", f"WITH {B.INTERFACES_SQL}, {APPLIED_SQL} SELECT * FROM applied")
def j02(spark, d):
    return A.applied(B.interfaces(spark, d))


@query("j02_addresses", f"WITH {B.INTERFACES_SQL}, {BY_IP_SQL} SELECT ip, iface, in_acl, out_acl FROM by_ip")
def j02_addresses(spark, d):
    return A.addressed(B.interfaces(spark, d)).drop("device")


@query(
    "a01_a02_reference_counts",
    f"""WITH {B.INTERFACES_SQL}, {BY_IP_SQL} SELECT * FROM
  (SELECT count(*) AS ifaces, count(*) FILTER (in_acl IS NOT NULL OR out_acl IS NOT NULL) AS with_acl FROM interfaces),
  (SELECT count(in_acl) AS with_in, count(out_acl) AS with_out, count(*) FILTER (in_acl IS NOT NULL AND out_acl IS NOT NULL) AS with_both FROM by_ip)""",
)
def a01(spark, d):
    return A.reference_counts(B.interfaces(spark, d))


@query("f11_acl_networks", f"WITH {B.ACL_LINES_SQL} SELECT acl, line_no, lo, hi FROM acl_nets")
def f11(spark, d):
    return A.acl_networks(B.acl_lines(spark, d)).select("acl", "line_no", "lo", "hi")


@query("j03_acl_covers_address", f"WITH {B.INTERFACES_SQL}, {B.ACL_LINES_SQL}, {BY_IP_SQL}, {COVER_SQL} SELECT * FROM cover")
def j03(spark, d):
    return A.covering(A.acl_networks(B.acl_lines(spark, d)), B.interfaces(spark, d).where("ip is not null"))


@query(
    "j03_cover_rule",
    f"""WITH {B.INTERFACES_SQL}, {B.ACL_LINES_SQL}, {BY_IP_SQL}, {COVER_SQL},
  counts AS (SELECT count(*) FILTER (acl = in_acl OR acl = out_acl) AS n, count(*) AS d FROM cover JOIN by_ip USING (ip))
SELECT 'C(ACL covers interface''s IP => interface has that ACL applied)' AS msg, n, d, {c_sql("n", "d")} AS c FROM counts""",
)
def j03_rule(spark, d):
    return A.cover_rule(A.acl_networks(B.acl_lines(spark, d)), B.interfaces(spark, d))


@query("f10_acl_ranges", f"WITH {B.INTERFACES_SQL}, {B.ACL_LINES_SQL}, {BY_IP_SQL}, {SPANS_SQL} SELECT acl, lo, hi FROM spans")
def f10(spark, d):
    return A.acl_ranges(A.acl_networks(B.acl_lines(spark, d)), B.interfaces(spark, d))


REFERENCE_SQL = f"""WITH {B.INTERFACES_SQL}, {B.ACL_LINES_SQL}, {BY_IP_SQL}, {COVER_SQL}, {SPANS_SQL},
counts AS (SELECT count(in_acl) AS i, count(out_acl) AS o, count(*) FILTER (in_acl IS NOT NULL AND out_acl IS NOT NULL) AS b FROM by_ip),
rules AS (
  SELECT 'C(interface => has ACL reference)' AS msg, count(*) FILTER (in_acl IS NOT NULL OR out_acl IS NOT NULL) AS n, count(*) AS d FROM interfaces
  UNION ALL SELECT 'C(interface has ''in'' ACL applied => interface has ''out'' ACL applied)', b, i FROM counts
  UNION ALL SELECT 'C(interface has ''out'' ACL applied => interface has ''in'' ACL applied)', b, o FROM counts
  UNION ALL SELECT 'C(ACL covers interface''s IP => interface has that ACL applied)', count(*) FILTER (acl = in_acl OR acl = out_acl), count(*) FROM cover JOIN by_ip USING (ip)
  UNION ALL SELECT 'C(interface''s IP falls within range [''' || {B.DOTTED_SQL.format("lo")} || ''', ''' || {B.DOTTED_SQL.format("hi")} || '''] => ACL ' || acl || ' applied to the interface)',
    n, (SELECT count(*) FROM by_ip WHERE ip BETWEEN lo AND hi) FROM spans)
SELECT msg, n, d, {c_sql("n", "d")} AS c FROM rules"""


@query("a03_j04_reference_rules", REFERENCE_SQL)
def a03(spark, d):
    return A.reference_rules(B.interfaces(spark, d), B.acl_lines(spark, d))


@query("a04_common_keywords", f"WITH {B.IFACE_KEYWORDS_SQL} SELECT word, count(*) AS count FROM iface_keywords GROUP BY word HAVING count(*) >= 10")
def a04(spark, d):
    return A.common_keywords(B.iface_keywords(spark, d))


KEYWORD_RULES_SQL = f"""WITH {B.IFACE_KEYWORDS_SQL}, {B.INTERFACES_SQL}, {APPLIED_SQL},
common AS (SELECT word, count(*) AS d FROM iface_keywords GROUP BY word HAVING count(*) >= 10),
acls AS (SELECT DISTINCT acl FROM applied),
used AS (SELECT DISTINCT device, iface, acl FROM applied),
hits AS (SELECT word, acl, count(*) AS n FROM iface_keywords JOIN used USING (device, iface) GROUP BY ALL),
counted AS (SELECT word, acl, coalesce(n, 0) AS n, d FROM common CROSS JOIN acls LEFT JOIN hits USING (word, acl))"""


@query("a05_j05_keyword_rules", f"{KEYWORD_RULES_SQL} SELECT word, acl, n, d, {c_sql('n', 'd')} AS c FROM counted")
def a05(spark, d):
    return A.keyword_rules(B.iface_keywords(spark, d), B.interfaces(spark, d))


@query(
    "j05_keyword_exceptions",
    f"{KEYWORD_RULES_SQL} SELECT word, acl, device, iface FROM counted JOIN iface_keywords k USING (word) WHERE 10 * n >= d AND NOT EXISTS (SELECT 1 FROM used u WHERE u.device = k.device AND u.iface = k.iface AND u.acl = counted.acl)",
)
def j05(spark, d):
    words, ifaces = B.iface_keywords(spark, d), B.interfaces(spark, d)
    return A.keyword_exceptions(words, ifaces, A.keyword_rules(words, ifaces).where("10 * n >= d"))


@query("j06_keyword_owners", f"WITH {B.IFACE_KEYWORDS_SQL} SELECT word, row_number() OVER (PARTITION BY word ORDER BY device, iface) - 1 AS k, device, iface FROM iface_keywords")
def j06_owners(spark, d):
    return A.keyword_owners(B.iface_keywords(spark, d))


@query("j06_keyword_stanzas", f"WITH {B.IFACE_KEYWORDS_SQL} SELECT word, count(*) AS owners, count(DISTINCT device) AS devices FROM iface_keywords GROUP BY word")
def j06(spark, d):
    return A.keyword_stanzas(B.iface_keywords(spark, d))


@query(
    "j07_keyword_ospf",
    f"""WITH {B.IFACE_KEYWORDS_SQL}, ospf AS (SELECT DISTINCT c_custkey AS iface FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
  counted AS (SELECT word, count(o.iface) AS n, count(*) AS d FROM iface_keywords k LEFT JOIN ospf o ON k.iface = o.iface GROUP BY word HAVING count(*) >= 10)
SELECT word, n, d, {c_sql("n", "d")} AS c FROM counted""",
)
def j07(spark, d):
    ospf = B.table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_nationkey").cast("long").alias("device"), F.col("c_custkey").alias("iface"))
    return A.keyword_ospf(B.iface_keywords(spark, d), ospf)


@query(
    "a06_j08_keyword_ranges",
    f"""WITH {B.IFACE_KEYWORDS_SQL}, {B.INTERFACES_SQL}, spans AS (SELECT word, min(ip) AS lo, max(ip) AS hi, count(*) AS n FROM iface_keywords JOIN interfaces USING (device, iface) WHERE ip IS NOT NULL GROUP BY word),
  counted AS (SELECT word, lo, hi, any_value(spans.n) AS n, count(*) AS d FROM spans JOIN interfaces ON ip BETWEEN lo AND hi GROUP BY ALL)
SELECT word, lo, hi, n, d, {c_sql("n", "d")} AS c FROM counted""",
)
def a06(spark, d):
    return A.keyword_ranges(B.iface_keywords(spark, d), B.interfaces(spark, d))


@query("k04_interface_acls", f"WITH {B.INTERFACES_SQL}, {APPLIED_SQL} SELECT acl, count(DISTINCT iface) AS ifaces FROM applied GROUP BY acl")
def k04(spark, d):
    return A.applied(B.interfaces(spark, d)).groupBy("acl").agg(F.count_distinct("iface").alias("ifaces"))


ITEMSETS_SQL = """WITH t AS (SELECT DISTINCT l_orderkey AS iface, p_type AS vlan FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT count(DISTINCT iface) AS n FROM t),
two AS (SELECT a.vlan AS x, b.vlan AS y, count(*) AS freq FROM t a JOIN t b ON a.iface = b.iface AND a.vlan < b.vlan GROUP BY x, y)
SELECT x, y, freq FROM two, n WHERE freq >= 0.2 * n"""


@query("a08_frequent_itemsets", ITEMSETS_SQL)
def a08(spark, d):
    """Pairs among the frequent item sets of part types by order."""
    line, part = B.table(spark, d, "lineitem"), B.table(spark, d, "part")
    pairs = line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("iface"), F.col("p_type").alias("vlan")).distinct()
    return A.frequent_itemsets(pairs, 0.2).where(F.size("items") == 2).select(F.col("items")[0].alias("x"), F.col("items")[1].alias("y"), "freq")


@query("k06_itemset_rules", f"WITH {B.TRUNKS_SQL}, s AS (SELECT vlan, count(*) AS d FROM trunks GROUP BY vlan) SELECT max(d) AS most, min(d) AS least, count(*) AS vlans FROM s")
def k06(spark, d):
    return B.trunks(spark, d).groupBy("vlan").agg(F.count("*").alias("d")).agg(F.max("d").alias("most"), F.min("d").alias("least"), F.count("*").alias("vlans"))


@query("j01_config_keyword_pairing", f"WITH {B.IFACE_KEYWORDS_SQL}, {B.INTERFACES_SQL} SELECT device, count(DISTINCT i.iface) AS ifaces, count(*) AS words FROM interfaces i JOIN iface_keywords k USING (device, iface) GROUP BY device")
def j01(spark, d):
    return A.keyword_pairing(B.interfaces(spark, d), B.iface_keywords(spark, d))
