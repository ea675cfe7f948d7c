"""Reading and writing configuration documents, keyword documents, graphs and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERFACE = "struct<name:string,description:string,address:string,in_acl:string,out_acl:string,switchport:string,access_vlan:int,allowed_vlans:array<int>,lag:int>"
ACL = "struct<name:string,alias:string,remarks:array<string>,lines:array<struct<action:string,srcIps:string,dstIps:string>>>"
CONFIG = f"struct<name:string,interfaces:map<string,{INTERFACE}>,acls:map<string,{ACL}>,vlans:map<string,struct<num:int,name:string,interface:string>>,lags:map<string,struct<num:int,interface:string>>,ospf:map<string,struct<name:string,vrf:string,interfaces:array<string>,areas:map<string,struct<name:string,type:string,networks:array<string>>>>>>"
KEYWORDS = "struct<name:string,interfaces:map<string,array<string>>,acls:map<string,array<string>>>"
GRAPH = "struct<directed:boolean,multigraph:boolean,nodes:array<struct<id:string,type:string>>,links:array<struct<source:string,target:string,type:string>>>"


def read_texts(spark: SparkSession, path: str | list[str], suffix: str = "*") -> DataFrame:
    """file (base name without its ending), text: whole files of a folder, at any depth, or of a list of files."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", suffix)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return reader.text(path).select(name.alias("file"), F.col("value").alias("text"))


def parse(texts: DataFrame, schema: str) -> DataFrame:
    """file, doc, ok: documents by an explicit schema; text that is no JSON object is kept with ok = false."""
    doc = F.from_json("text", schema, {"mode": "PERMISSIVE"})
    return texts.select("file", doc.alias("doc"), F.coalesce(F.try_parse_json("text").isNotNull() & F.trim("text").startswith("{"), F.lit(False)).alias("ok"))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """name, interfaces, acls, vlans, lags, ospf of every valid configuration; the file names those without a name."""
    d = parse(read_texts(spark, path, "*.json"), CONFIG).where("ok")
    return d.select(F.coalesce("doc.name", "file").alias("name"), *[f"doc.{c}" for c in ("interfaces", "acls", "vlans", "lags", "ospf")])


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    d = parse(read_texts(spark, path, "*.json"), KEYWORDS).where("ok")
    return d.select(F.coalesce("doc.name", "file").alias("name"), "doc.interfaces", "doc.acls")


def rejected(spark: SparkSession, path: str, schema: str = CONFIG) -> DataFrame:
    """Files that could not be parsed."""
    return parse(read_texts(spark, path, "*.json"), schema).where("not ok").select("file")


def paired(configs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Configurations with the keyword document of the same name."""
    return configs.join(keywords.select("name", F.col("interfaces").alias("interface_words"), F.col("acls").alias("acl_words")), "name")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line, keys in column order."""
    df.write.mode("overwrite").json(path)


def read_parquet_folder(spark: SparkSession, paths: list[str], max_files: int | None = None) -> DataFrame:
    """The first max_files of the given files as one table."""
    return spark.read.parquet(*(paths if max_files is None else paths[:max_files]))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, src_type, dst, dst_type, etype) of node-link files."""
    g = parse(read_texts(spark, path, "*.json"), GRAPH).where("ok").select("file", "doc.*")
    n = g.select("file", F.explode("nodes").alias("n")).select("file", "n.id", "n.type")
    e = g.select("file", F.explode("links").alias("l")).select("file", F.col("l.source").alias("src"), F.col("l.target").alias("dst"), F.regexp_replace("l.type", r'[\[\]"]', "").alias("etype"))
    out = e.join(n.select("file", F.col("id").alias("src"), F.col("type").alias("src_type")), ["file", "src"]).join(n.select("file", F.col("id").alias("dst"), F.col("type").alias("dst_type")), ["file", "dst"])
    return out.select("src", "src_type", "dst", "dst_type", "etype")


def graph_document(edges: DataFrame) -> DataFrame:
    """One row, json: a node-link document, for graphs of the size of a network's (thousands of nodes)."""
    from netquarry.operators.graph import nodes

    n = nodes(edges).agg(F.array_sort(F.collect_list(F.struct("id", "type"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("etype").alias("type")))).alias("links"))
    return n.join(F.broadcast(e)).select(F.to_json(F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")).alias("json"))


def dot_text(edges: DataFrame) -> DataFrame:
    """Lines of a DOT drawing, one an edge."""
    return edges.select(F.format_string('"%s" -- "%s";', "src", "dst").alias("line"))


def dot_document(edges: DataFrame, name: str = "G") -> DataFrame:
    """place, line: a whole DOT drawing: header, nodes with their types, edges, end. Lines are sorted by place, so a text of any size is
    written by ranges: dot_document(e).orderBy("place").select("line").write.text(path)."""
    from netquarry.operators.graph import nodes

    place = lambda k, *by: F.struct(F.lit(k).alias("k"), F.concat_ws("|", *by).alias("by")).alias("place")
    one = edges.sparkSession.range(1)
    head = one.select(place(0, F.lit("")), F.lit(f"graph {name} {{").alias("line"))
    own = nodes(edges).select(place(1, F.col("id")), F.format_string('"%s" [type="%s"];', "id", "type").alias("line"))
    lines = edges.select(place(2, F.col("src"), F.col("dst")), F.format_string('"%s" -- "%s";', "src", "dst").alias("line"))
    return head.unionByName(own).unionByName(lines).unionByName(one.select(place(3, F.lit("")), F.lit("}").alias("line")))


def flat_interfaces(configs: DataFrame) -> DataFrame:
    """device, iface, ip, length, in_acl, out_acl, description, switchport, access_vlan, lag."""
    from netquarry.functions import ip as ipf

    i = configs.select(F.col("name").alias("device"), F.explode("interfaces").alias("iface", "i"))
    return i.select("device", "iface", ipf.address_of(F.col("i.address")).alias("ip"), ipf.prefix_of(F.col("i.address")).alias("length"), "i.in_acl", "i.out_acl", "i.description", "i.switchport", "i.access_vlan", "i.lag")


def flat_acl_lines(configs: DataFrame) -> DataFrame:
    """device, acl, line_no, action, src, dst."""
    a = configs.select(F.col("name").alias("device"), F.explode("acls").alias("acl", "a"))
    lines = a.select("device", "acl", F.posexplode("a.lines").alias("line_no", "line"))
    return lines.select("device", "acl", "line_no", "line.action", F.col("line.srcIps").alias("src"), F.col("line.dstIps").alias("dst"))


def flat_trunks(configs: DataFrame) -> DataFrame:
    """iface, vlan of trunk interfaces."""
    i = configs.select(F.col("name").alias("device"), F.explode("interfaces").alias("iface", "i"))
    return i.select(F.concat_ws("_", "device", "iface").alias("iface"), F.explode("i.allowed_vlans").alias("vlan")).distinct()


def flat_keywords(documents: DataFrame) -> DataFrame:
    """device, iface, word."""
    i = documents.select(F.col("name").alias("device"), F.explode("interfaces").alias("iface", "words"))
    return i.select("device", "iface", F.explode("words").alias("word")).distinct()


def flat_ospf(configs: DataFrame) -> DataFrame:
    """device, iface, process of the interfaces that run OSPF; of several processes the last in order."""
    o = configs.select(F.col("name").alias("device"), F.explode("ospf").alias("process", "o")).select("device", "process", F.explode("o.interfaces").alias("iface"))
    return o.groupBy("device", "iface").agg(F.max("process").alias("process"))


def aggregate_interfaces(configs: DataFrame) -> DataFrame:
    """file, interfaces (JSON): the interfaces of all files by file name, a row a file; written as JSON lines they are one document a line."""
    return configs.select(F.col("name").alias("file"), F.to_json("interfaces").alias("interfaces"))


def resolve_aliases(acls: DataFrame) -> DataFrame:
    """device, acl, lines, remarks: an alias takes them from its target, one step; a missing target leaves null."""
    target = acls.select("device", F.col("acl").alias("alias"), F.col("lines").alias("target_lines"), F.col("remarks").alias("target_remarks"))
    joined = acls.join(target, ["device", "alias"], "left")
    pick = lambda c: F.when(F.col("alias").isNotNull(), F.col(f"target_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("device", "acl", pick("lines"), pick("remarks"))


def clean_anonymization(configs: DataFrame) -> DataFrame:
    """Configurations without removed remarks and descriptions."""
    acls = F.transform_values("acls", lambda _, a: a.withField("remarks", F.filter(a["remarks"], lambda r: r != " REMOVED")))
    ifaces = F.transform_values("interfaces", lambda _, i: i.withField("description", F.nullif(i["description"], F.lit("REMOVED"))))
    return configs.withColumn("acls", acls).withColumn("interfaces", ifaces)


def extract_keywords(configs: DataFrame) -> DataFrame:
    """device, kind, owner, word: words of interface descriptions, VLAN names, ACL names and remarks, longer ones folded under common starts."""
    from netquarry.functions.text import common_starts, keywords

    i = configs.select("name", F.explode("interfaces").alias("owner", "x")).select("name", F.lit("interface").alias("kind"), "owner", F.explode(keywords(F.col("x.description"))).alias("word"))
    v = configs.select("name", F.explode("vlans").alias("k", "x")).select("name", F.lit("interface"), F.concat(F.lit("Vlan"), F.col("x.num")), F.explode(keywords(F.col("x.name"), "[ _-]")))
    a = configs.select("name", F.explode("acls").alias("owner", "x"))
    names = a.select("name", F.lit("acl"), "owner", F.explode(keywords(F.col("owner"), "[ -]")))
    remarks = a.select("name", "owner", F.explode("x.remarks").alias("r")).select("name", F.lit("acl"), "owner", F.explode(keywords(F.col("r"), "[ -]")))
    words = i.union(v).union(names).union(remarks)
    return words.select(F.col("name").alias("device"), "kind", "owner", F.explode(common_starts(F.col("word"))).alias("word")).distinct()
