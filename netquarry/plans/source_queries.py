"""Source formats written out of the driver's tables as text, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F


from netquarry.plans import bindings as B
from netquarry.plans.registry import query
from netquarry.sources import configs as S
from netquarry.sources import vendor as V


def config_texts(spark, d):
    """A configuration document for each nation: customers as interfaces, segments as ACLs."""
    i = B.interfaces(spark, d)
    from netquarry.functions import ip as ipf

    body = F.struct(F.col("iface").cast("string").alias("name"), F.concat(ipf.format_ip(F.col("ip")), F.lit("/24")).alias("address"), "in_acl", "out_acl")
    ifaces = i.groupBy("device").agg(F.map_from_entries(F.collect_list(F.struct(F.col("iface").cast("string"), body))).alias("interfaces"))
    return ifaces.select(F.col("device").cast("string").alias("file"), F.to_json(F.struct(F.col("device").cast("string").alias("name"), "interfaces")).alias("text"))


@query("s01_s02_config_round_trip", f"WITH {B.INTERFACES_SQL} SELECT device::VARCHAR AS device, iface::VARCHAR AS iface, ip, in_acl, out_acl FROM interfaces")
def s01(spark, d):
    parsed = S.parse(config_texts(spark, d), S.CONFIG).where("ok").select("doc.*")
    return S.flat_interfaces(parsed).select("device", "iface", "ip", "in_acl", "out_acl")


@query("k15_rejected_documents", "SELECT count(*) FILTER (c_nationkey % 4 <> 0) AS good, count(*) FILTER (c_nationkey % 4 = 0) AS bad FROM (SELECT DISTINCT c_nationkey FROM customer)")
def k15(spark, d):
    broken = config_texts(spark, d).withColumn("text", F.when(F.col("file").cast("int") % 4 == 0, F.concat(F.lit("{,"), "text")).otherwise(F.col("text")))
    return S.parse(broken, S.CONFIG).agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query("s07_graph_document", f"WITH {B.SITE_SQL} SELECT (SELECT count(DISTINCT id) FROM adj) AS nodes, (SELECT count(*) FROM site) AS links")
def s07(spark, d):
    doc = S.graph_document(B.site_edges(spark, d)).select(F.from_json("json", S.GRAPH).alias("g"))
    return doc.select(F.size("g.nodes").cast("long").alias("nodes"), F.size("g.links").cast("long").alias("links"))


@query("s08_dot_lines", f"WITH {B.SITE_SQL} SELECT '\"' || src || '\" -- \"' || dst || '\";' AS line FROM site")
def s08(spark, d):
    return S.dot_text(B.site_edges(spark, d))


@query(
    "s08_dot_document",
    f"""WITH {B.SITE_SQL} SELECT 'graph G {{' AS line UNION ALL SELECT DISTINCT '"' || id || '" [type="' || type || '"];' FROM adj UNION ALL SELECT '"' || src || '" -- "' || dst || '";' FROM site UNION ALL SELECT '}}'""",
)
def s08_document(spark, d):
    return S.dot_document(B.site_edges(spark, d)).select("line")


def written(spark, write, name):
    """A folder that write has filled."""
    import uuid

    from netquarry.session import shared_dir

    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(path)
    return path


@query("s03_json_round_trip", f"WITH {B.INTERFACES_SQL} SELECT device, iface, ip, in_acl FROM interfaces")
def s03(spark, d):
    i = B.interfaces(spark, d).select("device", "iface", "ip", "in_acl")
    return spark.read.schema(i.schema).json(written(spark, lambda p: S.write_json(i, p), "json"))


@query("s06_csv_round_trip", f"WITH {B.INTERFACES_SQL} SELECT device, iface, ip, in_acl FROM interfaces")
def s06(spark, d):
    i = B.interfaces(spark, d).select("device", "iface", "ip", "in_acl")
    return S.read_csv(spark, written(spark, lambda p: S.write_csv(i, p), "csv"), i.schema)


@query("s04_interfaces_by_file", f"WITH {B.INTERFACES_SQL} SELECT device::VARCHAR AS file, count(*) AS interfaces FROM interfaces GROUP BY device")
def s04(spark, d):
    parsed = S.parse(config_texts(spark, d), S.CONFIG).where("ok").select("doc.*")
    whole = S.aggregate_interfaces(parsed)
    return whole.select("file", F.size(F.from_json("interfaces", f"map<string,{S.INTERFACE}>")).cast("long").alias("interfaces"))


@query("s05_first_files", "SELECT n_nationkey, n_name FROM nation")
def s05(spark, d):
    """The first file of a list only, as the operator has it."""
    return S.read_parquet_folder(spark, [f"{d}/nation.parquet", f"{d}/customer.parquet"], 1).select("n_nationkey", "n_name")


@query(
    "g01_config_graph",
    f"""WITH {B.INTERFACES_SQL}, n AS (SELECT device || '_' || iface AS id, device, ip, in_acl, out_acl FROM interfaces)
SELECT id AS src, 'interface' AS src_type, {B.DOTTED_SQL.format("((ip >> 8) << 8)")} || '/24' AS dst, 'subnet' AS dst_type, NULL AS etype FROM n WHERE ip IS NOT NULL
UNION ALL SELECT id, 'interface', device || '_' || in_acl, 'acl', 'in' FROM n WHERE in_acl IS NOT NULL UNION ALL SELECT id, 'interface', device || '_' || out_acl, 'acl', 'out' FROM n WHERE out_acl IS NOT NULL""",
)
def g01_configs(spark, d):
    """From documents through the parser to the graph of configurations."""
    from netquarry.operators.graph import config_graph

    parsed = S.parse(config_texts(spark, d), S.CONFIG).where("ok").select("doc.*")
    return config_graph(parsed).drop("seq")


@query(
    "g02_keyword_graph",
    f"WITH {B.IFACE_KEYWORDS_SQL} SELECT device || '_' || iface AS src, 'interface' AS src_type, word AS dst, 'keyword' AS dst_type FROM iface_keywords",
)
def g02_keywords(spark, d):
    from netquarry.operators.graph import keyword_edges

    k = B.iface_keywords(spark, d).groupBy("device", "iface").agg(F.collect_list("word").alias("words"))
    docs = k.groupBy("device").agg(F.map_from_entries(F.collect_list(F.struct(F.col("iface").cast("string"), "words"))).alias("interfaces"))
    docs = docs.select(F.col("device").cast("string").alias("name"), "interfaces", F.from_json(F.lit("{}"), "map<string,array<string>>").alias("acls"))
    return keyword_edges(docs).select("src", "src_type", "dst", "dst_type")


@query("s11_resolve_aliases", "SELECT c_nationkey AS device, 'a' || c_custkey AS acl, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 3 = 1 THEN c_custkey - 1 END AS lines FROM (SELECT *, c_custkey // 3 % 5 AS n FROM customer)".replace("c_nationkey AS device", "n AS device"))
def s11(spark, d):
    c = B.table(spark, d, "customer").select(F.expr("c_custkey div 3 % 5").alias("device"), F.concat(F.lit("a"), "c_custkey").alias("acl"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a"), F.col("c_custkey") - 1)).when(F.col("c_custkey") % 3 == 2, F.lit("missing")).alias("alias"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("lines"), F.lit(None).cast("string").alias("remarks"))
    return S.resolve_aliases(c).select("device", "acl", "lines")


def vlan_texts(spark, d):
    p = B.table(spark, d, "part").select((F.col("p_size")).cast("string").alias("file"), "p_partkey", "p_name")
    block = F.concat(F.lit("vlan "), "p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("\n name "), "p_name")).otherwise(F.lit("")), F.lit("\n!"))
    return p.withColumn("block", block).groupBy("file").agg(F.concat(F.lit("hostname x\n!\n"), F.array_join(F.array_sort(F.collect_list("block")), "\n"), F.lit("\nrouter ospf 7\n network 10.0.0.0 0.0.0.255 area 3\n!")).alias("text"))


@query("s12_vlan_names", "SELECT p_size::VARCHAR AS file, p_partkey::INT AS num, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS name FROM part")
def s12(spark, d):
    return V.vlan_names(V.lines_of(vlan_texts(spark, d)))


@query("s12_ospf_networks", "SELECT DISTINCT p_size::VARCHAR AS file, '7' AS process, '10.0.0.0' AS network, '0.0.0.255' AS wildcard, '3' AS area FROM part")
def s12_ospf(spark, d):
    return V.ospf_networks(V.lines_of(vlan_texts(spark, d)))


def dialect_texts(spark, d):
    s = B.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("file"), "s_name", "s_suppkey")
    port = F.struct(F.col("s_name").alias("name"), F.array(F.concat(F.lit("i"), "s_suppkey")).alias("interfaces"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("30"), F.lit("4"))).alias("vlan_trunks"))
    iface = F.struct(F.concat(F.lit("i"), "s_suppkey").alias("name"), F.concat(F.lit("to "), "s_name").alias("description"))
    g = s.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("s_name", port))).alias("Port"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("i"), "s_suppkey"), iface))).alias("Interface"))
    return g.select("file", F.to_json(F.struct("Port", "Interface")).alias("text"))


@query(
    "s13_j18_port_interfaces",
    """SELECT s_nationkey::VARCHAR AS file, s_name AS name, 'to ' || s_name AS description, CASE WHEN s_suppkey % 2 = 0 THEN 'trunk' ELSE 'access' END AS switchport FROM supplier
UNION ALL SELECT s_nationkey::VARCHAR, 'i' || s_suppkey, 'to ' || s_name, NULL FROM supplier""",
)
def s13(spark, d):
    return V.port_interfaces(dialect_texts(spark, d)).select("file", "name", "description", "switchport")


@query("s14_repair_json", "SELECT s_suppkey::VARCHAR AS file, s_name AS name FROM supplier")
def s14(spark, d):
    word = F.regexp_replace("s_name", "#", "_")
    t = B.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.concat(F.lit('{"name": '), word, F.lit(', "path": "a%2Fb"}')).alias("text"))
    doc = F.from_json("text", "struct<name:string,path:string>")
    return V.repair_json(t).select("file", F.when(doc["path"] == "a/b", F.regexp_replace(doc["name"], "_", "#")).alias("name"))


@query("s15_indented_text", "SELECT c_nationkey::VARCHAR AS file, count(*) AS interfaces FROM customer GROUP BY 1")
def s15(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("file"), F.concat(F.lit("interface Eth"), "c_custkey", F.lit("\n description to "), "c_mktsegment", F.lit("\n ip address 10.0.0.1 255.255.255.0\n no shutdown\n!")).alias("block"))
    texts = c.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("block")), "\n").alias("text"))
    good = F.from_json("json", "struct<interface:map<string,struct<description:string,`ip-address`:string,shutdown:boolean>>>")["interface"]
    fits = F.map_filter(good, lambda k, v: F.startswith(v["description"], F.lit("to ")) & (v["ip-address"] == "10.0.0.1 255.255.255.0") & ~v["shutdown"])
    return V.convert(texts, V.parse_indented).select("file", F.size(fits).cast("long").alias("interfaces"))


@query("s16_s17_braced_text", "SELECT c_nationkey::VARCHAR AS file, count(*) AS units FROM customer GROUP BY 1")
def s16(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("file"), F.concat(F.lit("  unit "), "c_custkey", F.lit(' {\n    description "to '), "c_mktsegment", F.lit('";\n    vlans [ 1 2 ];\n  }')).alias("block"))
    texts = c.groupBy("file").agg(F.concat(F.lit("interfaces {\n"), F.array_join(F.array_sort(F.collect_list("block")), "\n"), F.lit("\n}")).alias("text"))
    units = F.from_json("json", "struct<interfaces:struct<unit:map<string,struct<description:string,vlans:array<string>>>>>")["interfaces"]["unit"]
    return V.convert(texts, V.parse_braced_normal).select("file", F.size(F.map_filter(units, lambda k, v: F.size(v["vlans"]) == 2)).cast("long").alias("units"))


@query("s18_clean_anonymization", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS description, (s_suppkey % 2)::BIGINT AS remarks FROM supplier")
def s18(spark, d):
    s = B.table(spark, d, "supplier")
    iface = F.from_json(F.to_json(F.struct(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).otherwise("REMOVED").alias("description"))), S.INTERFACE)
    acl = F.from_json(F.to_json(F.struct(F.array(F.lit(" REMOVED"), F.when(F.col("s_suppkey") % 2 > 0, "kept").otherwise(" REMOVED")).alias("remarks"))), S.ACL)
    c = s.select("s_suppkey", F.create_map(F.lit("i"), iface).alias("interfaces"), F.create_map(F.lit("a"), acl).alias("acls"))
    return S.clean_anonymization(c).select(F.col("s_suppkey").alias("k"), F.col("interfaces")["i"]["description"].alias("description"), F.size(F.col("acls")["a"]["remarks"]).cast("long").alias("remarks"))


@query("s19_s20_scrape_logs", "SELECT p_type AS similarity, p_size::VARCHAR AS hyperparameter, p_size / 100.0 AS precision, min(p_partkey) / 10000.0 AS recall FROM part GROUP BY ALL")
def s19(spark, d):
    p = B.table(spark, d, "part").groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("k"))
    texts = p.select(F.concat_ws("_", "p_type", "p_size", F.lit("run")).alias("file"), F.concat(F.lit("start\nprecision: "), F.col("p_size") / 100, F.lit("\nrecall: "), (F.col("k") / 10000).cast("decimal(12,4)").cast("string"), F.lit("\n")).alias("text"))
    return V.scrape_logs(texts).dropDuplicates(["similarity", "hyperparameter"])


@query("f22_bug_sites", "SELECT n_nationkey::VARCHAR AS file, 'bug ' || n_name AS title, 'at ' || n_regionkey AS detail FROM nation")
def f22(spark, d):
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("file"), F.concat(F.lit("paths.csv\nbug "), "n_name", F.lit("\nat "), "n_regionkey", F.lit("\n[skipped]\n")).alias("text"))
    return V.bug_sites(n)


@query("k01_extract_keywords", f"WITH w AS (SELECT DISTINCT c_nationkey::VARCHAR AS device, c_custkey::VARCHAR AS owner, unnest(['link', lower(c_mktsegment)]) AS word FROM customer) SELECT device, 'interface' AS kind, owner, word FROM w")
def k01(spark, d):
    c = B.table(spark, d, "customer")
    iface = F.from_json(F.to_json(F.struct(F.concat(F.lit("Link to the "), "c_mktsegment").alias("description"))), S.INTERFACE)
    docs = c.groupBy(F.col("c_nationkey").cast("string").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), iface))).alias("interfaces"))
    docs = docs.withColumn("vlans", F.from_json(F.lit("{}"), "map<string,struct<num:int,name:string,interface:string>>")).withColumn("acls", F.from_json(F.lit("{}"), f"map<string,{S.ACL}>"))
    return S.extract_keywords(docs)


@query("k05_ospf_processes", "SELECT n_regionkey::VARCHAR AS device, n_name AS iface, '2' AS process FROM nation")
def k05(spark, d):
    n = B.table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("name")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    one = F.struct(F.lit("p").alias("name"), F.lit("v").alias("vrf"), F.col("names").alias("interfaces"))
    return S.flat_ospf(n.select("name", F.create_map(F.lit("1"), one, F.lit("2"), one).alias("ospf")))


