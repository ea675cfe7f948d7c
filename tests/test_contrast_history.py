import collections
import itertools
import random

from netquarry.operators import contrast as C
from netquarry.operators import graph
from netquarry.operators import history as H
from netquarry.plans import contrast_queries


def frame(spark, seed=1, n=200):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xy"), rng.choice("abc"), rng.choice("pq"), rng.randint(0, 30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, grp string, f string, g string, v long")


def test_not_rules_equal_brute_force(spark):
    """Rules of one to four items."""
    rng = random.Random(6)
    names = ["f", "g", "h", "k"]
    rows = [(rng.choice("xy"), *[rng.choice("abc") for _ in names]) for _ in range(150)]
    counts = C.item_counts(spark.createDataFrame(rows, "grp string, f string, g string, h string, k string"), names, "grp")
    for depth in range(1, 5):
        learned = C.learn(counts, names, depth)
        got = {(tuple(r["rule"]), r["grp"]): r["c"] for r in C.not_rules(learned, counts).collect()}
        assert max(len(rule) for rule, _ in got) == depth
        for rule, grp in got:
            items = [x.split("=>") for x in rule]
            assert got[rule, grp] == sum(r[0] == grp and all(r[1 + names.index(k)] != v for k, v in items) for r in rows)


def test_pairs_of_a_hub(spark, monkeypatch):
    """Nodes of a block are dealt over pairs of parts; every pair comes once, with all neighbours in common."""
    monkeypatch.setattr(graph, "PAIRED_AT_ONCE", 7)
    rows = [(f"n{i}", "hub") for i in range(60)] + [(f"n{i}", f"x{i % 9}") for i in range(60)] + [("alone", "y")] + [(f"n{i}", f"y{k}") for i in range(0, 60, 7) for k in range(300)]
    got = {(r["a"], r["b"]): r["common"] for r in graph.shared_counts(spark.createDataFrame(rows, "id string, nbr string")).collect()}
    by = collections.defaultdict(list)
    for i, n in rows:
        by[n].append(i)
    assert got == collections.Counter((min(a, b), max(a, b)) for v in by.values() for a, b in itertools.combinations(v, 2))


def test_discretize(spark):
    _, df = frame(spark)
    labels = [r[0] for r in C.discretize(df, "v").select("v").distinct().collect()]
    assert len(labels) == 3 and all(x.startswith("(") for x in labels)
    assert "v" not in C.discretize(df, "v", max_share=0.001).columns
    assert "v" not in C.discretize(spark.createDataFrame([(4, 1), (4, 2)], "v long, w long"), "v").columns
    few = spark.createDataFrame([(1,), (2,)], "v long")
    assert {r[0] for r in C.discretize(few, "v").collect()} == {"1", "2"}


def test_coverage_and_violations(spark):
    rows, df = frame(spark)
    rules = spark.createDataFrame([(1, ["f=>a"], "x"), (2, ["f=>a", "g=>p"], "x"), (3, ["f=>b", "g=>q"], "y")], "rule_id long, rule array<string>, grp string")
    has = {1: lambda r: r[2] == "a", 2: lambda r: r[2] == "a" and r[3] == "p", 3: lambda r: r[2] == "b" and r[3] == "q"}
    grp = {1: "x", 2: "x", 3: "y"}
    got = {r["rule_id"]: (r["matched"], r["covered"]) for r in C.coverage(rules, df, ["f", "g"], "grp").collect()}
    assert got == {k: (sum(map(f, rows)), sum(f(r) and r[1] == grp[k] for r in rows)) for k, f in has.items()}
    bad = {(r["row_id"], r["rule_id"]) for r in C.violations(rules, df, ["f", "g"], "grp").collect()}
    assert bad == {(r[0], k) for k, f in has.items() for r in rows if f(r) and r[1] != grp[k]}
    open_rows = {r[0] for r in C.uncovered_rows(rules, df, ["f", "g"], "grp").collect()}
    assert open_rows == {r[0] for r in rows if not any(f(r) and r[1] == grp[k] for k, f in has.items())}
    assert {r["rule_id"] for r in C.drop_longer_rules(rules).collect()} == {1, 3}
    centers = {r["row_id"]: list(r["centers"]) for r in C.condense_violations(C.violations(rules, df, ["f", "g"], "grp"), rules).collect()}
    assert set(centers) == {i for i, _ in bad} and all(len(v) == 1 for v in centers.values())


def test_spanning_rules(spark):
    sets = {1: range(10), 2: range(5, 15), 3: range(12, 14), 4: range(0, 3)}
    rows = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v], "rule_id long, row_id long")
    weights, want = dict.fromkeys(range(15), 1.0), []
    while True:
        gain, rule = max((sum(weights[i] for i in v), -k) for k, v in sets.items())
        if -rule in want:
            break
        want.append(-rule)
        for i in sets[-rule]:
            weights[i] /= 2
    assert C.spanning_rules(rows) == want


def brute_spanning(sets):
    """The reference's greedy cover: a picked rule is out, its rows' weights halve; ends with a gain under 0.05 % or no rule left."""
    weights, left, picked = dict.fromkeys({i for v in sets.values() for i in v}, 1.0), dict(sets), []
    while left:
        total = sum(weights.values())
        gain, rule = max((sum(weights[i] for i in v), -k) for k, v in left.items())
        picked.append(-rule)
        for i in left.pop(-rule):
            weights[i] /= 2
        if gain / 2 < 0.0005 * total:
            break
    return picked


def test_spanning_rules_without_a_cap(spark):
    ends = [0, 40, *range(52, 160, 9)]
    disjoint = {k + 1: range(a, b) for k, (a, b) in enumerate(itertools.pairwise(ends))}
    small = {1: range(3000), 2: range(3000, 3002), 3: range(3002, 3003), 4: range(3003, 3004)}
    for sets, n in ((disjoint, 13), ({1: range(10), 2: range(5, 15), 3: range(12, 14), 4: range(0, 3)}, 4), (small, 3)):
        rows = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v], "rule_id long, row_id long")
        got = C.spanning_rules(rows, drop_picked=True)
        assert got == brute_spanning(sets)
        assert len(got) == n


def test_spanning_query_picks_from_all_rules(spark):
    sf = "/root/testdata/sf0.001"
    nation, segment = {}, {}
    for r in spark.read.parquet(f"{sf}/customer.parquet").collect():
        nation[r["c_custkey"]], segment[r["c_custkey"]] = r["c_nationkey"], r["c_mktsegment"]
    by = {}
    orders = [r for r in spark.read.parquet(f"{sf}/orders.parquet").collect() if r["o_custkey"] in nation]
    for r in orders:
        by.setdefault((segment[r["o_custkey"]], r["o_orderpriority"][0]), []).append(r)
    rules = sorted(by)
    assert len(rules) > 10
    sets = {n: [r["o_orderkey"] for r in by[k]] for n, k in enumerate(rules, 1)}
    got = [r["rule_id"] for r in contrast_queries.g13(spark, sf).orderBy("place").collect()]
    assert got == brute_spanning(sets)


def test_prune_and_one_hot(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (2, 0, 0, 1)], "k long, a int, b int, c int")
    assert C.prune_columns(df, ["a", "b", "c"]).columns == ["k", "a"]
    wide = C.one_hot(spark.createDataFrame([(1, "x"), (2, "y")], "k long, f string"), "k", "f", ["x", "y", "z"])
    assert {tuple(r) for r in wide.collect()} == {(1, 1, 0, 0), (2, 0, 1, 0)}


SNAP = "device string, stanza string, element string, attr string, val string"


def test_snapshot_diff(spark):
    before = spark.createDataFrame([("d", "ACL", "a", "x", "1"), ("d", "ACL", "a", "y", "1"), ("d", "ACL", "b", "x", "1"), ("d", "VLAN", "v", "x", "1"), ("d", "AAA1", "v", "x", "1"), ("d", "ACL", "n", "x", None)], SNAP)
    after = spark.createDataFrame([("d", "ACL", "a", "x", "2"), ("d", "ACL", "a", "z", "1"), ("d", "ACL", "c", "x", "1"), ("d", "AAA1", "v", "x", "2"), ("d", "ACL", "n", "x", None)], SNAP)
    got = {tuple(r) for r in H.snapshot_diff(before, after).collect()}
    assert got == {("d", "ACL", "a", "Modification", "x", "1", "2"), ("d", "ACL", "a", "Deletion", "y", "1", None), ("d", "ACL", "a", "Addition", "z", None, "1"), ("d", "ACL", "b", "Deletion", None, None, None), ("d", "ACL", "c", "Addition", None, None, None)}
    kinds = {(r["stanza"], r["kind"]) for r in H.diff_kinds(before, after).collect()}
    assert ("VLAN", "Deleted") in kinds and ("ACL", "Modification") in kinds


def test_change_matrix_keeps_quiet_periods(spark):
    changes = spark.createDataFrame([("1", "A"), ("1", "B"), ("3", "A")], "period string, col string")
    periods = spark.createDataFrame([("1",), ("2",), ("3",)], "period string")
    got = {(r["period"], r["col"]): r["changed"] for r in H.change_matrix(changes, periods).collect()}
    assert got["2", "A"] == 0 and got["3", "A"] == 1 and len(got) == 6
    p = H.point_frequencies(changes, periods).first()
    assert (p["n00"], p["n01"], p["n11"], p["n10"]) == (1, 0, 1, 1)
    c = {(r["a"], r["b"]): (r["together"], r["apart"]) for r in H.co_changes(changes).collect()}
    assert c == {("A", "A"): (2, 0), ("A", "B"): (1, 1), ("B", "B"): (1, 0)}


def test_lifetimes(spark):
    patterns = {"".join(map(str, p)): p for p in itertools.product((0, 1), repeat=4) if any(p)}
    rows = [(k, i) for k, p in patterns.items() for i, x in enumerate(p) if x]
    got = {r["class"]: r["n"] for r in H.lifetimes(spark.createDataFrame(rows, "thing string, period int"), [0, 1, 2, 3]).collect()}
    assert got == {"fixed 1": 1, "fixed 2": 1, "fixed 3": 1, "not fixed": 1, "other": 11}


def test_rank_correlation_with_ties(spark):
    import pandas as pd

    rng = random.Random(3)
    wide = pd.DataFrame({c: [rng.randint(0, 3) for _ in range(40)] for c in "abc"})
    rows = [(i, c, int(wide[c][i])) for i in range(40) for c in "abc"]
    got = {(r["a"], r["b"]): r["rho"] for r in H.rank_correlation(spark.createDataFrame(rows, "r int, c string, n int"), "r", "c", "n").collect()}
    want = wide.rank().corr()
    for (a, b), rho in got.items():
        assert abs(rho - want[a][b]) < 1e-9
