import random

from pyspark.sql import functions as F

from netquarry.operators import graph as G
from netquarry.operators import paths as P
from netquarry.sources import configs as S

from . import configs

EDGE = "src string, src_type string, dst string, dst_type string, etype string"


def graph(spark, pairs, kind=lambda x: "vlan" if x[0] == "v" else "interface"):
    return spark.createDataFrame([(a, kind(a), b, kind(b), None) for a, b in pairs], EDGE)


def test_graph_of_configurations(spark, tmp_path):
    c = S.read_configs(spark, configs.write(tmp_path, configs.VLANS))
    words = G.keyword_edges(spark.createDataFrame([(configs.VLAN_WORDS["name"], configs.VLAN_WORDS["interfaces"], {})], "name string, interfaces map<string,array<string>>, acls map<string,array<string>>"))
    e = G.simple_edges(G.config_graph(c).unionByName(words))
    got = {frozenset((r["src"], r["dst"])): r["etype"] for r in e.collect()}
    want = {frozenset((f"vlans_GigabitEthernet0/{i}", f"Vlan{v}")): "allowed" for i, vs in ((1, (100, 200, 300)), (2, (300,)), (3, (100, 200)), (4, (100, 200)), (5, (400,))) for v in vs}
    want |= {frozenset((f"Vlan{v}", w)): None for v, w in ((100, "red"), (200, "orange"), (300, "yellow"), (400, "green"))}
    assert got == want
    types = {r["id"]: r["type"] for r in G.nodes(e).collect()}
    assert types["Vlan100"] == "vlan" and types["red"] == "keyword" and len(types) == 13


def test_acl_graph_and_core(spark, tmp_path):
    c = S.read_configs(spark, configs.write(tmp_path, configs.ACLS))
    e = G.simple_edges(G.config_graph(c))
    got = {frozenset((r["src"], r["dst"])) for r in e.collect()}
    assert frozenset(("acls_aclB", "20.0.2.1/32")) in got and frozenset(("acls_GigabitEthernet0/4", "acls_aclD")) in got
    assert not any("0.0.0.0/0" in x for x in got)
    # Without keywords every interface hangs off a tree: no core is left.
    assert G.prune_degree_one(e).count() == 0


def test_prune_keeps_the_two_core(spark):
    rng = random.Random(2)
    pairs = {(f"i{rng.randint(0, 60)}", f"v{rng.randint(0, 60)}") for _ in range(90)}
    now = set(pairs)
    while True:
        degree = {}
        for e in now:
            for x in e:
                degree[x] = degree.get(x, 0) + 1
        keep = {e for e in now if all(degree[x] > 1 for x in e)}
        if keep == now:
            break
        now = keep
    got = {(r["src"], r["dst"]) for r in G.prune_degree_one(graph(spark, pairs)).collect()}
    assert got == now


def test_undefined_acl_has_a_type(spark, tmp_path):
    doc = {"name": "d", "interfaces": configs.by_name(configs.interface("e0", in_acl="missing")), "acls": {}}
    c = S.read_configs(spark, configs.write(tmp_path, doc))
    assert {r["id"]: r["type"] for r in G.nodes(G.config_graph(c)).collect()} == {"d_e0": "interface", "d_missing": "acl"}


TOY = [(f"i{i}", f"Vlan{v}") for i, vs in ((1, (100, 200, 300)), (2, (300,)), (3, (100, 200, 300)), (4, (100, 200)), (5, (400, 401, 405))) for v in vs]


def toy(spark):
    return graph(spark, TOY, lambda x: "vlan" if x.startswith("Vlan") else "interface")


def test_coalesce(spark):
    got = G.coalesce_vertices(toy(spark), ("vlan",))
    vlans = {r["id"] for r in G.nodes(got).where("type = 'vlan'").collect()}
    assert vlans == {"Vlan{100,200}", "Vlan{400-401,405}", "Vlan300"}


def test_similarity_and_suggestions(spark):
    adj = G.adjacency(toy(spark))
    got = {(r["a"], r["b"]): (r["pa"], r["pb"]) for r in G.similarity_proportions(adj, "interface").collect()}
    assert got["i1", "i4"] == (2 / 3, 1.0) and got["i1", "i3"] == (1.0, 1.0) and ("i1", "i5") not in got
    pairs = G.similar_nodes(adj, "interface", {"vlan": 1.0}, 0.6)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("i1", "i4"), ("i3", "i4")}
    suggested = G.suggest_links(adj, pairs)
    assert {(r["node"], r["suggestion"]) for r in suggested.collect()} == {("i4", "Vlan300")}
    assert G.rank_suggestions(adj, suggested, "interface", 1).first()["weight"] == 3


def test_precision_recall(spark):
    link = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    r = G.precision_recall(link([("a", "b"), ("c", "d")]), link([("b", "a"), ("x", "y"), ("x", "z")])).first()
    assert (r["hits"], r["suggested"], r["removed"], r["precision"], r["recall"]) == (1, 3, 2, 1 / 3, 0.5)
    empty = spark.createDataFrame([], "src string, dst string")
    assert G.precision_recall(empty, empty).first()["precision"] is None


def test_removed_edges_repeat(spark):
    a, b = (sorted(map(tuple, G.remove_edges(toy(spark), 3, seed=1).collect())) for _ in range(2))
    assert a == b and len(a) == 3


def test_paths(spark):
    adj = G.adjacency(graph(spark, [("i1", "v1"), ("i2", "v1"), ("i1", "i2"), ("i2", "v2")]))
    got = {("".join(r["path"]), r["cycle"]) for r in P.simple_paths(adj, 4, "vlan").collect()}
    assert ("v1i1i2", True) in got and ("v2i2v1", False) in got and ("v2i2v1i1", False) in got and ("v1i1i2v2", False) in got
    assert not any(len(set(p[k : k + 2] for k in range(0, len(p), 2))) < len(p) // 2 for p, _ in got)
    counts = P.pattern_counts(P.path_patterns(P.simple_paths(adj, 3, "vlan"), [("vlan",)]), -1)
    assert {r["pattern"]: (r["cycles"], r["total"]) for r in counts.collect()}["v1 interface interface"] == (2, 2)


def test_aggregate_prefixes(spark):
    rows = [(0, 25), (128, 25), (256, 24), (256, 26), (1024, 24)]
    got = {tuple(r) for r in G.aggregate_prefixes(spark.createDataFrame(rows, "lo long, length int")).collect()}
    assert got == {(0, 23), (1024, 24)}
    one = spark.createDataFrame([(0, 32)], "lo long, length int")
    assert [tuple(r) for r in G.aggregate_prefixes(one).collect()] == [(0, 32)]
