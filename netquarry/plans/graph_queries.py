"""Graph operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.operators import graph as G
from netquarry.operators import node2vec as N
from netquarry.plans import bindings as B
from netquarry.plans.registry import query
from netquarry.session import stored

SITE = f"WITH {B.SITE_SQL}"
PARTS = f"WITH {B.PARTS_SQL}"
MEMBERS_SQL = """member AS (SELECT DISTINCT 'vlan:' || l_suppkey AS id, 'vlan' AS type, 'interface:' || p_brand || p_size AS nbr, 'interface' AS nbr_type FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT DISTINCT 'vlan:' || s_suppkey, 'vlan', 'acl:' || s_nationkey, 'acl' FROM supplier),
common AS (SELECT a.id AS a, b.id AS b, a.nbr_type AS k, count(*) AS n FROM member a JOIN member b ON a.nbr = b.nbr AND a.id < b.id GROUP BY ALL),
degree AS (SELECT id, nbr_type AS k, count(*) AS d FROM member GROUP BY ALL)"""


def site(spark, d):
    return G.adjacency(B.site_edges(spark, d))


def members(spark, d):
    """Adjacency of suppliers (VLANs) to kinds of parts (interfaces) and nations (ACLs), one side only; written, as it is read several times."""
    line, part = B.table(spark, d, "lineitem"), B.table(spark, d, "part")
    kinds = line.join(part, line["l_partkey"] == part["p_partkey"]).select("l_suppkey", "p_brand", "p_size").distinct().select(F.concat(F.lit("vlan:"), "l_suppkey").alias("id"), F.lit("vlan").alias("type"), F.concat(F.lit("interface:"), "p_brand", "p_size").alias("nbr"), F.lit("interface").alias("nbr_type"))
    acls = B.table(spark, d, "supplier").select(F.concat(F.lit("vlan:"), "s_suppkey"), F.lit("vlan"), F.concat(F.lit("acl:"), "s_nationkey"), F.lit("acl"))
    return stored(kinds.union(acls).distinct(), "members")


@query("g01_g02_graph_edges", f"{SITE} SELECT src, src_type, dst, dst_type, etype FROM site")
def g01(spark, d):
    return B.site_edges(spark, d)


@query(
    "g01_simple_edges",
    "WITH e AS (SELECT 'c' || c_nationkey AS a, 's' || c_mktsegment AS b, c_custkey AS seq, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS t FROM customer) SELECT a AS src, b AS dst, arg_max(t, seq) AS etype FROM e GROUP BY ALL",
)
def g01_simple(spark, d):
    c = B.table(spark, d, "customer")
    e = c.select(F.concat(F.lit("s"), "c_mktsegment").alias("src"), F.lit("acl").alias("src_type"), F.concat(F.lit("c"), "c_nationkey").alias("dst"), F.lit("vlan").alias("dst_type"), F.when(F.col("c_acctbal") > 0, "in").otherwise("out").alias("etype"), F.col("c_custkey").alias("seq"))
    return G.simple_edges(e).select("src", "dst", "etype")


@query("s07_node_link", f"{SITE} SELECT id, type, count(*) AS degree FROM adj GROUP BY ALL")
def s07(spark, d):
    return site(spark, d).groupBy("id", "type").agg(F.count("*").alias("degree"))


@query("j09_typed_neighbors", f"{SITE} SELECT id, count(*) AS n FROM adj WHERE type = 'vlan' AND nbr_type = 'interface' GROUP BY id")
def j09(spark, d):
    return G.neighbors(site(spark, d), "vlan", "interface")


PRUNE_ROUND = "r{k} AS (SELECT id, nbr FROM r{j} WHERE id NOT IN (SELECT id FROM r{j} GROUP BY id HAVING count(*) < 2) AND nbr NOT IN (SELECT id FROM r{j} GROUP BY id HAVING count(*) < 2))"


def prune_sql(rounds: int) -> str:
    return f"WITH {B.PARTS_SQL}, r0 AS MATERIALIZED (SELECT id, nbr FROM adj), " + ", ".join(PRUNE_ROUND.format(k=k, j=k - 1).replace(" AS (", " AS MATERIALIZED (", 1) for k in range(1, rounds + 1)) + f" SELECT least(id, nbr) AS u, greatest(id, nbr) AS v FROM r{rounds} GROUP BY ALL"


@query("g04_prune_degree_one", prune_sql(12))
def g04(spark, d):
    return G.prune_degree_one(B.part_edges(spark, d)).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))


@query("j10_similarity_proportions", f"WITH {MEMBERS_SQL} SELECT a, b, n / x.d AS pa, n / y.d AS pb FROM common JOIN degree x ON a = x.id AND common.k = x.k JOIN degree y ON b = y.id AND common.k = y.k WHERE common.k = 'interface'")
def j10(spark, d):
    return G.similarity_proportions(members(spark, d), "vlan", "interface")


SIMILAR_SQL = f"""WITH {MEMBERS_SQL},
parts AS (SELECT a, b, CASE common.k WHEN 'interface' THEN 0.75 ELSE 0.25 END * n / x.d AS pa, CASE common.k WHEN 'interface' THEN 0.75 ELSE 0.25 END * n / y.d AS pb
  FROM common JOIN degree x ON a = x.id AND common.k = x.k JOIN degree y ON b = y.id AND common.k = y.k),
alike AS (SELECT a, b, sum(pa) AS pa, sum(pb) AS pb FROM parts GROUP BY a, b HAVING sum(pa) >= {{t}} AND sum(pb) >= {{t}} AND NOT (sum(pa) = 1 AND sum(pb) = 1))"""


@query("g09_similar_nodes", SIMILAR_SQL.format(t=0.45) + " SELECT a, b, round(pa, 9) AS pa, round(pb, 9) AS pb FROM alike")
def g09(spark, d):
    return G.similar_nodes(members(spark, d), "vlan", {"interface": 0.75, "acl": 0.25}, 0.45).select("a", "b", F.round("pa", 9).alias("pa"), F.round("pb", 9).alias("pb"))


SUGGEST_SQL = f"""{SIMILAR_SQL.format(t=0.5)},
whole AS (SELECT id, count(*) AS d FROM member GROUP BY id),
ends AS (SELECT a, b, x.d AS da, y.d AS db FROM alike JOIN whole x ON a = x.id JOIN whole y ON b = y.id),
towards AS (SELECT a AS node, b AS other FROM ends WHERE da <= db UNION SELECT b, a FROM ends WHERE db <= da),
suggested AS (SELECT DISTINCT node, nbr AS suggestion FROM towards JOIN member ON id = other WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.id = node AND m.nbr = member.nbr))"""


@query("g11_suggest_links", f"{SUGGEST_SQL} SELECT node, suggestion FROM suggested")
def g11(spark, d):
    return G.similar_links(members(spark, d), "vlan", {"interface": 0.75, "acl": 0.25}, 0.5).select("node", "suggestion")


GRID = [0.5, 0.6, 0.7, 0.8, 0.9]


@query(
    "p04_link_prediction_sweep",
    f"""WITH {MEMBERS_SQL.split(",\ncommon AS")[0]}, gone AS (SELECT id, nbr FROM member ORDER BY md5(id || '|' || nbr || '|3'), id, nbr LIMIT 200),
m AS (SELECT * FROM member WHERE (id, nbr) NOT IN (SELECT id, nbr FROM gone)),
common AS (SELECT a.id AS a, b.id AS b, a.nbr_type AS k, count(*) AS n FROM m a JOIN m b ON a.nbr = b.nbr AND a.id < b.id GROUP BY ALL),
degree AS (SELECT id, nbr_type AS k, count(*) AS d FROM m GROUP BY ALL),
parts AS (SELECT a, b, CASE common.k WHEN 'interface' THEN 0.75 ELSE 0.25 END * n / x.d AS pa, CASE common.k WHEN 'interface' THEN 0.75 ELSE 0.25 END * n / y.d AS pb
  FROM common JOIN degree x ON a = x.id AND common.k = x.k JOIN degree y ON b = y.id AND common.k = y.k),
alike AS (SELECT a, b, round(least(sum(pa), sum(pb)), 9) AS score FROM parts GROUP BY a, b HAVING sum(pa) >= 0.5 AND sum(pb) >= 0.5 AND NOT (sum(pa) = 1 AND sum(pb) = 1)),
whole AS (SELECT id, count(*) AS d FROM m GROUP BY id),
ends AS (SELECT a, b, x.d AS da, y.d AS db, score FROM alike JOIN whole x ON a = x.id JOIN whole y ON b = y.id),
towards AS (SELECT a AS node, b AS other, score FROM ends WHERE da <= db UNION ALL SELECT b, a, score FROM ends WHERE db <= da),
offered AS (SELECT node, nbr AS suggestion, max(score) AS score FROM towards JOIN m ON id = other WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.id = node AND n.nbr = m.nbr) GROUP BY ALL),
grid AS (SELECT unnest({GRID}) AS threshold),
c AS (SELECT threshold, count(score) AS suggested, count(gone.id) AS hits FROM grid LEFT JOIN offered ON score >= threshold LEFT JOIN gone ON gone.id = node AND gone.nbr = suggestion GROUP BY threshold)
SELECT threshold, hits, suggested, hits / nullif(suggested, 0) AS precision, hits / (SELECT count(*) FROM gone) AS recall FROM c""",
)
def p04(spark, d):
    """Precision and recall at every threshold, from one table of scored suggestions."""
    m = members(spark, d)
    gone = stored(G.remove_edges(m.select(F.col("id").alias("src"), F.col("nbr").alias("dst")), 200, seed=3), "gone")
    left = m.join(gone.select(F.col("src").alias("id"), F.col("dst").alias("nbr")), ["id", "nbr"], "left_anti")
    # A score counts as the highest threshold that it reaches.
    scored = G.similar_links(left, "vlan", {"interface": 0.75, "acl": 0.25}, GRID[0], GRID)
    return G.precision_recall_curve(gone, scored.select(F.col("node").alias("src"), F.col("suggestion").alias("dst"), "score"), GRID)


BOTH_SQL = "both_ways AS (SELECT id, type, nbr, nbr_type FROM member UNION SELECT nbr, nbr_type, id, type FROM member)"


@query(
    "o02_rank_suggestions",
    f"""{SUGGEST_SQL}, {BOTH_SQL}, w AS (SELECT id, count(*) AS weight FROM both_ways WHERE nbr_type = 'vlan' GROUP BY id),
r AS (SELECT node, suggestion, coalesce(weight, 0) AS weight, row_number() OVER (PARTITION BY node ORDER BY coalesce(weight, 0) DESC, suggestion) AS rank FROM suggested LEFT JOIN w ON id = suggestion)
SELECT * FROM r WHERE rank <= 5""",
)
def o02(spark, d):
    m = members(spark, d)
    both = m.union(m.select("nbr", "nbr_type", "id", "type"))
    return G.rank_suggestions(both, G.similar_links(m, "vlan", {"interface": 0.75, "acl": 0.25}, 0.5).select("node", "suggestion"), "vlan", 5)


@query(
    "a31_precision_recall",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS hits, count(*) FILTER (toxic = 1) AS suggested, count(*) FILTER (quality = 1) AS removed FROM labels)
SELECT hits, suggested, removed, hits / nullif(suggested, 0) AS precision, hits / nullif(removed, 0) AS recall FROM c""",
)
def a31(spark, d):
    labels = B.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("src"), F.lit("x").alias("dst"), "quality", "toxic")
    return G.precision_recall(labels.where("quality = 1"), labels.where("toxic = 1"))


@query("g12_remove_edges", f"{SITE} SELECT src, src_type, dst, dst_type FROM site ORDER BY md5(src || '|' || dst || '|3'), src, dst LIMIT 200")
def g12(spark, d):
    """The sample is the operator: two hundred links go."""
    return G.remove_edges(B.site_edges(spark, d), 200, seed=3).select("src", "src_type", "dst", "dst_type")


WALKS = {"length": 8, "walks": 6, "size": 32, "window": 4, "p": 0.5, "q": 2.0, "epochs": 3}


@query("g10_node_vectors")
def g10_vectors(spark, d):
    walks = {k: WALKS[k] for k in ("length", "walks", "p", "q")}
    return N.node_vectors(N.random_walks(site(spark, d), **walks), WALKS["size"], WALKS["window"], WALKS["epochs"])


@query("g10_similar_nodes_by_walks")
def g10(spark, d):
    """Interfaces with similar walks. Vectors are random by nature, so there is no SQL; tests hold the parts against brute force."""
    return N.similar_nodes_by_walks(site(spark, d), "interface", 0.9, **WALKS)


@query("g10_a31_suggested_links")
def g10_links(spark, d):
    """How many removed links the neighbours of nodes with similar walks suggest."""
    edges = B.site_edges(spark, d)
    gone = stored(G.remove_edges(edges, 200, seed=3).select("src", "dst"))
    left = G.adjacency(edges.join(gone, ["src", "dst"], "left_anti"))
    pairs = N.similar_nodes_by_walks(left, "interface", 0.9, **WALKS)
    found = G.suggest_links(left, pairs).select(F.col("node").alias("src"), F.col("suggestion").alias("dst"))
    return G.precision_recall(gone, found)


COALESCE_SQL = """own AS (SELECT id, type, list_sort(list_distinct(list(nbr))) AS nbrs FROM adj WHERE type = 'interface' GROUP BY id, type)
SELECT len(members) AS members, len(nbrs) AS nbrs, members[1] AS first FROM (SELECT nbrs, list_sort(list(id)) AS members FROM own GROUP BY nbrs) WHERE len(members) > 1"""


@query("g08_coalesce_groups", f"{SITE}, {COALESCE_SQL}")
def g08(spark, d):
    own = site(spark, d).where("type = 'interface'").groupBy("id").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))
    groups = own.groupBy("nbrs").agg(F.array_sort(F.collect_set("id")).alias("m")).where(F.size("m") > 1)
    return groups.select(F.size("m").alias("members"), F.size("nbrs").alias("nbrs"), F.col("m")[0].alias("first"))


@query(
    "g08_coalesce_vertices",
    f"""{SITE}, own AS (SELECT id, list_sort(list_distinct(list(nbr))) AS nbrs FROM adj WHERE type = 'interface' GROUP BY id),
named AS (SELECT nbrs, string_agg(id, ',' ORDER BY id) AS name, list(id) AS ids FROM own GROUP BY nbrs),
of AS (SELECT unnest(ids) AS id, name FROM named)
SELECT DISTINCT coalesce(a.name, src) AS src, coalesce(b.name, dst) AS dst FROM site LEFT JOIN of a ON src = a.id LEFT JOIN of b ON dst = b.id""",
)
def g08_edges(spark, d):
    return G.coalesce_vertices(B.site_edges(spark, d), ("interface",)).select("src", "dst")


SUBNETS_SQL = f"nets AS (SELECT DISTINCT {B.DOTTED_SQL.format('(ip - 1)')} || '/24' AS id, {B.DOTTED_SQL.format('((ip >> 11) << 11)')} || '/21' AS up FROM interfaces WHERE ip IS NOT NULL)"


@query("g05_add_supernets", f"WITH {B.INTERFACES_SQL}, {SUBNETS_SQL} SELECT id AS src, up AS dst FROM nets")
def g05(spark, d):
    from netquarry.functions import ip as ipf

    i = B.interfaces(spark, d).where("ip is not null")
    e = i.select(F.col("iface").cast("string").alias("src"), F.lit("interface").alias("src_type"), F.concat(ipf.format_ip(ipf.network(F.col("ip"), F.col("length"))), F.lit("/24")).alias("dst"), F.lit("subnet").alias("dst_type"), F.lit(None).cast("string").alias("etype"))
    return G.add_supernets(e, 21).where("etype = 'supernet'").select("src", "dst")


@query(
    "j11_shared_subnet_without_vlan",
    f"""{SITE}, p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM adj a JOIN adj b ON a.nbr = b.nbr AND a.id < b.id WHERE a.type = 'interface' AND a.nbr_type = 'acl' AND b.type = 'interface')
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM adj x JOIN adj y ON x.nbr = y.nbr WHERE x.id = p.a AND y.id = p.b AND x.nbr_type = 'vlan')
  AND EXISTS (SELECT 1 FROM adj x WHERE x.id IN (p.a, p.b) AND x.nbr_type = 'vlan')""",
)
def j11(spark, d):
    """Interfaces with an ACL in common and no VLAN."""
    return G.shared_subnet_without_vlan(site(spark, d), "interface", "acl", "vlan")


@query(
    "j12_neighbor_differences",
    f"""WITH {MEMBERS_SQL}, p AS (SELECT a, b FROM common WHERE k = 'acl')
SELECT a, b, m.nbr AS nbr, 'a' AS side FROM p JOIN member m ON m.id = a WHERE m.nbr_type = 'interface' AND NOT EXISTS (SELECT 1 FROM member y WHERE y.id = b AND y.nbr = m.nbr)
UNION ALL SELECT a, b, m.nbr, 'b' FROM p JOIN member m ON m.id = b WHERE m.nbr_type = 'interface' AND NOT EXISTS (SELECT 1 FROM member y WHERE y.id = a AND y.nbr = m.nbr)""",
)
def j12(spark, d):
    return G.neighbor_differences(members(spark, d), "vlan", "acl", "interface")


@query("j13_triangles", f"{SITE} SELECT p.id AS x, p.nbr AS y, q.nbr AS z FROM adj p JOIN adj q ON p.nbr = q.id JOIN adj r ON r.id = p.id AND r.nbr = q.nbr WHERE p.type = 'interface' AND p.nbr_type = 'acl' AND q.nbr_type = 'vlan'")
def j13(spark, d):
    return G.triangles(site(spark, d), "interface", "acl", "vlan")


@query("j14_typed_edges", f"{SITE} SELECT id, nbr FROM adj WHERE type = 'interface' AND nbr_type = 'vlan'")
def j14(spark, d):
    return G.typed_edges(site(spark, d), "interface", "vlan")


@query("a33_induced_counts", f"{SITE} SELECT (SELECT count(DISTINCT id) FROM adj WHERE type IN ('interface', 'vlan')) AS nodes, (SELECT count(*) FROM site WHERE src_type IN ('interface', 'vlan') AND dst_type IN ('interface', 'vlan')) AS edges")
def a33(spark, d):
    return G.induced_counts(B.site_edges(spark, d), ("interface", "vlan"))


LO, HI = B.BASE_IP, B.BASE_IP + 65535


@query("j15_subnet_acls", f"WITH {B.INTERFACES_SQL} SELECT DISTINCT acl FROM (SELECT unnest([in_acl, out_acl]) AS acl FROM interfaces WHERE (ip >> 8) << 8 >= {LO} AND ((ip >> 8) << 8) + 255 <= {HI}) WHERE acl IS NOT NULL")
def j15_acls(spark, d):
    return G.subnet_acls(B.interfaces(spark, d), LO, HI)


@query("j15_subnet_descriptions", f"WITH {B.INTERFACES_SQL} SELECT ip, device, iface FROM interfaces WHERE (ip >> 8) << 8 >= {LO} AND ((ip >> 8) << 8) + 255 <= {HI}")
def j15_descriptions(spark, d):
    return G.subnets_within(B.interfaces(spark, d), LO, HI).select("ip", "device", "iface")


@query("o01_numberline", f"WITH {B.INTERFACES_SQL} SELECT ip, length, count(*) AS n, min(iface) AS first FROM interfaces WHERE ip IS NOT NULL GROUP BY ALL")
def o01(spark, d):
    return B.interfaces(spark, d).where("ip is not null").groupBy("ip", "length").agg(F.count("*").alias("n"), F.min("iface").alias("first")).orderBy("ip", "length")


def aggregate_sql() -> str:
    steps = [f"WITH {B.INTERFACES_SQL}, l0 AS (SELECT DISTINCT ip >> 8 AS n FROM interfaces WHERE ip IS NOT NULL)"]
    for k in range(1, 17):
        steps.append(f"l{k} AS (SELECT n // 2 AS n FROM l{k - 1} GROUP BY n // 2 HAVING count(*) = 2)")
    rest = " UNION ALL ".join(f"SELECT (n << {8 + k})::BIGINT AS lo, {24 - k} AS length FROM l{k} WHERE n // 2 NOT IN (SELECT n FROM l{k + 1})" for k in range(16))
    return ", ".join(steps) + " " + rest


@query("o08_k21_aggregate_prefixes", aggregate_sql())
def o08(spark, d):
    from netquarry.functions import ip as ipf

    i = B.interfaces(spark, d).where("ip is not null")
    return G.aggregate_prefixes(i.select(ipf.network(F.col("ip"), F.col("length")).alias("lo"), "length"))


@query("o07_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity < 2) UNION ALL SELECT 'left', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 10) UNION ALL SELECT 'any', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_quantity < 10)")
def o07(spark, d):
    line = B.table(spark, d, "lineitem")
    r, q = line.where("l_returnflag = 'R'").select("l_partkey"), line.where("l_quantity < 10").select("l_partkey")
    counts = [
        line.where("l_returnflag = 'R' and l_quantity > 48").select("l_suppkey").intersect(line.where("l_quantity < 2").select("l_suppkey")).agg(F.lit("both").alias("kind"), F.count("*").alias("n")),
        r.subtract(q).agg(F.lit("left").alias("kind"), F.count("*").alias("n")),
        r.union(q).distinct().agg(F.lit("any").alias("kind"), F.count("*").alias("n")),
    ]
    return G.union(*counts)


@query("o06_nearest_neighbors", "WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS v FROM embeddings), u AS (SELECT v, min(vec_id) AS id FROM b GROUP BY v), p AS (SELECT x.id AS id, y.id AS other, len(list_filter(range(1, 65), lambda i: x.v[i] <> y.v[i])) AS d FROM u x JOIN u y ON x.id <> y.id) SELECT id, arg_min(other, (d, other)) AS nearest, min(d) / 64.0 AS distance FROM p GROUP BY id")
def o06(spark, d):
    from netquarry.operators.nearest import nearest_by_hamming

    e = B.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("v"))
    return nearest_by_hamming(e, 64)
