"""Queries on small tables with the keys, groups and hubs of larger ones, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

from .test_entry import show


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query equals its SQL on tables given as SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(entry.oracle_sql()[name])
        columns = [x[0] for x in want.description]
        got, rows = show(df.columns, [tuple(r) for r in df.collect()]), show(columns, want.fetchall())
        assert got == rows
        return len(rows)

    return run


def test_braced_addresses_beyond_one_octet(same):
    assert same("g03_braced_graph", customer="SELECT k AS c_custkey, (k % 2)::INT AS c_nationkey, 'BUILDING' AS c_mktsegment FROM (SELECT unnest([1, 65535, 65536, 70001, 900000]) AS k)") == 15


def test_a_large_group_is_named_once(spark):
    """Forty thousand interfaces of one VLAN become one: a name a member, or one folded from each edge, would be gigabytes."""
    import time

    from pyspark.sql import functions as F

    from netquarry.operators import graph as G

    n = 40_000
    edges = spark.range(n).select(F.concat(F.lit("i"), "id").alias("src"), F.lit("interface").alias("src_type"), F.lit("v").alias("dst"), F.lit("vlan").alias("dst_type"), F.lit(None).cast("string").alias("etype"))
    start = time.monotonic()
    (row,) = G.coalesce_vertices(edges, ("interface",)).collect()
    assert row["src"] == ",".join(sorted(f"i{k}" for k in range(n))) and row["dst"] == "v"
    assert time.monotonic() - start < 60


def test_pairs_in_cells_equal_pairs_by_neighbours(spark, monkeypatch):
    """Dense nodes over several cells, with counts, degrees and weighted shares of two types."""
    import itertools
    import random

    from netquarry.operators import graph as G
    from netquarry.operators import paths as P

    from .test_similarity import brute_similar

    monkeypatch.setattr(G, "CELL_SIDE", 20)
    rng = random.Random(5)
    rows = [(f"n{k}", "vlan", f"{kind}{x}", kind) for k in range(70) for kind, most, n in (("interface", 600, 250), ("acl", 4, 1)) for x in rng.sample(range(most), n)]
    adj = spark.createDataFrame(rows, "id string, type string, nbr string, nbr_type string")
    own = {}
    for i, _, x, kind in rows:
        own.setdefault(i, set()).update([x] if kind == "interface" else [])
    want = {(a, b): (len(own[a] & own[b]), 250, 250) for a, b in itertools.combinations(sorted(own), 2)}
    met = G.common_neighbors(adj, "vlan", "interface")
    assert "ArrowInGroups" in met._jdf.queryExecution().toString() or "FlatMapGroupsInArrow" in met._jdf.queryExecution().toString()
    assert {(r["a"], r["b"]): (r["common"], r["da"], r["db"]) for r in met.collect()} == want
    assert {(r["a"], r["b"]): (r["both"], r["either"], r["apart"]) for r in P.neighbor_set_sizes(adj, "vlan", "interface").collect()} == {k: (n, 500 - n, 500 - 2 * n) for k, (n, _, _) in want.items()}
    weights = {"interface": 0.75, "acl": 0.25}
    got = {(r["a"], r["b"]): (round(r["pa"], 9), round(r["pb"], 9)) for r in G.similar_nodes(adj, "vlan", weights, 0.45).collect()}
    assert got == brute_similar(rows, weights, 0.45) and got


def _site(spark, pairs):
    from netquarry.operators import graph as G

    kind = lambda x: {"a": "acl", "i": "interface", "v": "vlan", "k": "keyword"}[x[0]]
    return G.adjacency(spark.createDataFrame([(a, kind(a), b, kind(b), None) for a, b in pairs], "src string, src_type string, dst string, dst_type string, etype string"))


def test_paths_through_classes_equal_all_paths(spark, monkeypatch):
    import random
    from collections import Counter

    from netquarry.operators import paths as P

    monkeypatch.setattr(P, "TWIN_DEGREE", 4)
    monkeypatch.setattr(P, "MEMBERS_AT_ONCE", 3)
    rng = random.Random(4)
    pairs = {(f"i{k}", f"a{k % 2}") for k in range(16)} | {(f"i{k}", f"v{k // 6}") for k in range(20)} | {("a0", "v0"), ("v1", "k0"), ("v2", "k0")}
    pairs |= {(f"i{rng.randrange(20)}", f"v{rng.randrange(3)}") for _ in range(6)}
    adj = _site(spark, pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kinds = {"a": "acl", "i": "interface", "v": "vlan", "k": "keyword"}
    want, now = Counter(), [(x,) for x in near if x[0] == "a"]
    for length in range(2, 5):
        now = [(*p, x) for p in now for x in near[p[-1]] - set(p)]
        want.update((p, p[-1] in near[p[0]]) for p in now if length > 2)
    found = P.simple_paths(adj, 4, "acl").collect()
    assert Counter((tuple(r["path"]), r["cycle"]) for r in found) == want
    assert all(r["types"] == [kinds[x[0]] for x in r["path"]] for r in found)
    subsets = P.named_subsets(("acl", "interface", "keyword", "vlan"))
    classes = P.twins(adj)
    assert classes.where("n > 1").count() > 4
    totals = {}
    for s in subsets:
        for (p, cycle), n in want.items():
            count = totals.setdefault((" ".join(x if kinds[x[0]] in s else kinds[x[0]] for x in p), "-".join(s)), [0, 0])
            count[0] += n * cycle
            count[1] += n
    counts = P.folded_counts(P.folded_paths(adj, classes, 4, "acl"), subsets, -1)
    got = [(" ".join(r["words"]), r["names"], [r["cycles"], r["total"]]) for r in P.named_members(counts, classes, 4).collect()]
    assert len(got) == len(totals) and {(p, s): c for p, s, c in got} == totals
    bucket = lambda c: "full" if c[0] == c[1] else "high" if c[0] * 10 >= c[1] * 9 else "low"
    sets = {}
    for (p, _), c in totals.items():
        sets.setdefault((p.count(" ") + 1, bucket(c)), []).append(tuple(sorted(p.split())))
    assert {(r["nodes"], r["bucket"]): (r["patterns"], r["signatures"]) for r in P.sort_patterns(counts).collect()} == {k: (len(x), len(set(x))) for k, x in sets.items()}


def test_paths_of_a_hub_are_counted_not_listed(spark):
    """Thirty thousand interfaces of one ACL and one VLAN have 900 million paths."""
    import time

    from pyspark.sql import functions as F

    from netquarry.operators import graph as G
    from netquarry.operators import paths as P

    n = 30_000
    side = lambda id_, kind: spark.range(n).select(F.concat(F.lit("i"), "id").alias("src"), F.lit("interface").alias("src_type"), F.lit(id_).alias("dst"), F.lit(kind).alias("dst_type"))
    adj = G.adjacency(side("a", "acl").union(side("v", "vlan")))
    start = time.monotonic()
    counts = P.folded_counts(P.folded_paths(adj, P.twins(adj), 4, "acl"), [("interface",), ("vlan",)], -1)
    got = {tuple(r) for r in P.sort_patterns(counts).collect()}
    assert got == {(3, "low", n + 1, n + 1), (4, "full", n * (n - 1) + 1, n * (n - 1) // 2 + 1)}
    assert time.monotonic() - start < 60


def test_pairs_in_place_equal_pairs_by_neighbours(spark, monkeypatch):
    """Several lists of one hub, nodes that share more than one neighbour, and unnamed neighbours."""
    import itertools
    import random

    from netquarry.operators import graph as G

    met = G.met_in_place
    monkeypatch.setattr(G, "met_in_place", lambda rows, at_once: met(rows, 7))
    rng = random.Random(6)
    rows = [(f"n{k}", "vlan", x, kind) for k in range(60) for kind, least, most, n in (("acl", 1, 3, 5), ("interface", 0, 4, 12)) for x in rng.sample([f"{kind}{z}" for z in range(n)], rng.randint(least, most))]
    rows += [("n1", "vlan", None, "interface"), ("n2", "vlan", None, "interface"), ("n3", "vlan", None, "acl")]
    adj = spark.createDataFrame(rows, "id string, type string, nbr string, nbr_type string")
    own = lambda i, kind: {x for n, _, x, k in rows if n == i and k == kind and x}
    some = {i: own(i, "interface") for i, *_ in rows}
    acls, bare = {i: own(i, "acl") for i in some}, {"n1", "n2"}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(some), 2) if acls[a] & acls[b]]
    want = [(a, b) for a, b in pairs if not some[a] & some[b] and (some[a] or some[b] or {a, b} & bare)]
    assert sorted(map(tuple, G.shared_subnet_without_vlan(adj, "vlan", "acl", "interface").collect())) == want and want
    apart = [(a, b, x or "", side) for a, b in pairs for side, one, other in (("a", a, b), ("b", b, a)) for x in [*(some[one] - some[other]), *([None] if one in bare else [])]]
    assert sorted((r["a"], r["b"], r["nbr"] or "", r["side"]) for r in G.neighbor_differences(adj, "vlan", "acl", "interface").collect()) == sorted(apart)


def test_pairs_of_a_hub_are_not_shuffled(spark):
    """Six thousand interfaces of one ACL are 18 million pairs; the shuffle holds lists of them."""
    from pyspark.sql import functions as F

    from netquarry.operators import graph as G

    n = 6_000
    side = lambda id_, kind: spark.range(n).select(F.concat(F.lit("i"), "id").alias("src"), F.lit("interface").alias("src_type"), id_.alias("dst"), F.lit(kind).alias("dst_type"))
    adj = G.adjacency(side(F.lit("a"), "acl").union(side(F.concat(F.lit("v"), F.col("id") % 2), "vlan")))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert G.shared_subnet_without_vlan(adj, "interface", "acl", "vlan").count() == n * n // 4
    assert written() - before < 30e6


def test_rules_meet_classes_of_rows(spark):
    """Two hundred thousand rows of twelve kinds: rules are matched with the kinds, so little is shuffled; nulls are kinds too."""
    from pyspark.sql import functions as F

    from netquarry.operators import contrast as C

    n = 200_000
    frame = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("f"), (F.floor(F.col("id") / 3) % 2).alias("g"), F.when(F.floor(F.col("id") / 6) % 2 == 0, "x").otherwise("y").alias("grp"))
    rules = spark.createDataFrame([(1, ["f=>1"], "x"), (2, ["f=>1", "g=>0"], "y"), (3, ["g=>1"], "x")], "rule_id long, rule array<string>, grp string")
    has = {1: lambda f, g: f == 1, 2: lambda f, g: f == 1 and g == 0, 3: lambda f, g: g == 1}
    group = {1: "x", 2: "y", 3: "x"}
    rows = [(i, i % 3 or None, i // 3 % 2, "y" if i // 6 % 2 else "x") for i in range(n)]
    met = [(i, r, grp) for i, f, g, grp in rows for r in has if has[r](f, g)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    bad = C.violations(rules, frame, ["f", "g"], "grp")
    assert bad.count() == bad.distinct().count() == sum(group[r] != grp for _, r, grp in met)
    assert {(r["rule_id"], r["matched"], r["covered"]) for r in C.coverage(rules, frame, ["f", "g"], "grp").collect()} == {(k, sum(r == k for _, r, _ in met), sum(r == k and grp == group[k] for _, r, grp in met)) for k in has}
    hit = {i for i, r, grp in met if grp == group[r]}
    assert {r["row_id"] for r in C.uncovered_rows(rules, frame, ["f", "g"], "grp").collect()} == set(range(n)) - hit
    got = {r["row_id"]: sorted(r["centers"]) for r in C.condensed(rules, frame, ["f", "g"], "grp").collect()}
    broken = {}
    for i, r, grp in met:
        if grp != group[r]:
            broken.setdefault(i, set()).add(r)
    assert got.keys() == broken.keys() and all(set(c) <= broken[i] for i, c in got.items())
    # The count of distinct rows above shuffles about 2 MB itself.
    assert written() - before < 6e6
    kinds = C.classes(frame, ["f", "g"], "grp")
    assert C.spanning_rules(C.rule_rows(rules, C.long_items(kinds, ["f", "g"])), 0.01, sizes=kinds) == C.spanning_rules(C.rule_rows(rules, C.long_items(frame, ["f", "g"])), 0.01)


def test_a_worker_hands_keys_on(spark):
    """Two documents of thirty thousand keys in one batch: no more than KEYS_AT_ONCE are gathered."""
    import json

    import pyarrow as pa

    from netquarry.operators import infer as I

    class Documents:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    texts = [json.dumps({"a": {f"k{k}": str(k) for k in range(30_000)}}), "{broken", None, json.dumps({"b": ["x"]})]
    found = list(I.flatten_json(Documents())([pa.RecordBatch.from_pydict({"doc": ["1", "2", "3", "4"], "json": texts})]))
    assert sum(b.num_rows for b in found) == 30_003 and max(b.num_rows for b in found) <= 10_000
    assert found[-1].to_pylist()[-1] == {"doc": "4", "parent": ["b"], "key": "x", "container": None, "leaf": None}


def test_keys_of_a_signature_are_not_gathered(spark, monkeypatch):
    """Keys are read from a written table and shuffled in as many parts as there are rows for."""
    from netquarry import session
    from netquarry.operators import infer as I

    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    keys = I.flatten_json(spark.createDataFrame([("1", '{"interfaces": {' + ", ".join(f'"i{k}": {{"acl": "a{k % 2}"}}' for k in range(100)) + "}}")], "doc string, json string"))
    symbols = I.extract_symbols(keys)
    plan = symbols._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and ", 21)" in plan
    related = I.relationships(symbols)
    assert ", 20)" in related._jdf.queryExecution().toString()
    assert {tuple(r) for r in related.collect()} == {("acl", f"a{k % 2}", "interfaces", f"i{k}", 1) for k in range(100)}


def test_keyword_tables_are_dealt_by_their_size(spark, sf_dir, monkeypatch):
    """Shuffles of lines have as many parts as there are rows for; frames read the words once; edges are not made distinct as texts."""
    import re

    from netquarry import session
    from netquarry.plans import bindings as B

    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    parts = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert re.search(rf"hashpartitioning\(iface#\d+L?, {parts}\)", plan(B.iface_keywords(spark, sf_dir)))
    assert not re.search(r"HashAggregate\(keys=\[src#", plan(B.part_edges(spark, sf_dir)))
    assert "lineitem.parquet" not in plan(entry.queries()["a10_learn_one_hot"](spark, sf_dir))
    assert "SortAggregate" not in plan(entry.queries()["a17_vocabulary"](spark, sf_dir)).split("HashAggregate(keys=[word", 2)[-1]


def test_names_of_a_customer_are_not_hashed(spark, sf_dir):
    """A task hashes the few words of its customers, not all names of their parts."""
    import re

    from netquarry.plans import bindings as B

    words = B.iface_keywords(spark, sf_dir)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[[^\]]*name#", plan) and re.search(r"Aggregate\(keys=\[iface#\d+L?, word#", plan)
    assert words.count() == words.distinct().count() > 0


def test_owners_of_a_word_are_not_dealt_again(spark):
    """Words that lie by interface are counted where they lie; rows given twice and unnamed owners count as SQL counts them."""
    from pyspark.sql import functions as F

    from netquarry.operators import associations as A

    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    n = 100_000
    row = spark.range(n).select((F.col("id") % 5).alias("device"), F.col("id").alias("iface"))
    dealt = row.repartition(8, "iface")
    before = written()
    dealt.groupBy("iface").count().count()
    own = written() - before
    words = dealt.select("device", "iface", F.explode(F.array(*[F.lit(f"w{k}") for k in range(10)])).alias("word"))
    before = written()
    assert {tuple(r) for r in A.keyword_stanzas(words).collect()} == {(f"w{k}", n, 5) for k in range(10)}
    assert written() - before < 2 * own
    rows = [("a", 1, 1), ("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", None, 1), ("a", 3, None), ("b", None, 1), ("b", None, None), ("c", 4, None), (None, 1, 1)]
    odd = spark.createDataFrame(rows, "word string, device long, iface long")
    assert {tuple(r) for r in A.keyword_stanzas(odd).collect()} == {("a", 3, 3), ("b", 0, 0), ("c", 0, 1), (None, 1, 1)}


def test_numbers_of_keywords_are_paired(spark, sf_dir):
    """Where interfaces are too large for a broadcast, an interface's number of keywords is dealt to them, not each keyword."""
    import re

    from netquarry.operators import associations as A

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = entry.queries()["j01_config_keyword_pairing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = [below for line, below in zip(lines, lines[1:]) if re.search(r"Exchange hashpartitioning\(device#\d+L?, iface#\d+L?, ", line)]
    assert len(dealt) == 2 and sum("Aggregate(keys=[device#" in x for x in dealt) == 1
    interfaces = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (None, 1), (3, 1)], "device long, iface long")
    words = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (2, 1, None), (None, 1, "a"), (4, 1, "a")], "device long, iface long, word string")
    assert {tuple(r) for r in A.keyword_pairing(interfaces, words).collect()} == {(1, 2, 5), (2, 1, 1)}


def test_interfaces_are_not_held_whole(spark, sf_dir):
    """Tables of a row an interface grow with the input: a task gets its part of them, however small their files are."""
    for name in ("j01_config_keyword_pairing", "a17_vocabulary"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin [iface#" in x or "BroadcastHashJoin [device#" in x] and "SortMergeJoin" in plan


@pytest.mark.parametrize("grid", [[], [0.5, 0.6, 0.7, 0.8]])
def test_links_are_offered_within_cells(spark, monkeypatch, grid):
    """What similar nodes offer, folded in cells, is what their pairs give, with alike nodes, a third type, unshared neighbours and several cells."""
    import random

    from pyspark.sql import functions as F

    from netquarry.operators import graph as G

    monkeypatch.setattr(G, "CELL_SIDE", 10)
    rng = random.Random(3)
    rows = []
    for k in range(60):
        own = rng.sample(range(40), rng.randint(18, 34))
        for twin in range(rng.choice([1, 1, 3])):
            node = f"n{k}_{twin}"
            rows += [(node, "vlan", f"interface{x}", "interface") for x in own] + [(node, "vlan", f"acl{k % 4}", "acl")] * (k % 7 > 0)
            rows += [(node, "vlan", f"word{k % 5}", "keyword")] * (k % 3 > 0) + [(node, "vlan", f"n{(k + 1) % 60}_0", "vlan")] * (k % 6 == 0) + [(node, "vlan", f"interface_{node}", "interface")] * (k % 9 == 0)
    adj = spark.createDataFrame(rows, "id string, type string, nbr string, nbr_type string")
    weights = {"interface": 0.75, "acl": 0.25}
    alike = G.similar_nodes(adj, "vlan", weights, 0.5)
    score = F.array_max(F.filter(F.array(*map(F.lit, grid)).cast("array<double>"), lambda t: t <= F.round(F.least("pa", "pb"), 9)))
    want = {tuple(r) for r in G.scored_links(adj, alike.select("a", "b", score.alias("score"))).collect()}
    monkeypatch.setattr(G, "similar_nodes", None)
    got = G.similar_links(adj, "vlan", weights, 0.5, grid).collect()
    assert len(got) == len(want) > 500
    assert {tuple(r) for r in got} == want


def test_members_of_a_class_come_in_few_lists(spark, monkeypatch):
    """Two thousand interfaces of one ACL and VLAN are one list: what is dealt for their pairs is a row a pair of lists."""
    from netquarry.operators import paths as P

    lists = []
    kept = P.stored
    monkeypatch.setattr(P, "stored", lambda df, name="table": lists.append((name, kept(df, name))) or lists[-1][1])
    adj = _site(spark, {(f"i{k}", end) for k in range(2000) for end in ("a0", "v0")})
    found = P.simple_paths(adj, 3, "acl")
    (members,) = [x for name, x in lists if name == "members"]
    assert members.count() == 1
    assert found.count() == 2000
