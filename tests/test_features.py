"""Feature frames, sweeps, covers and shared runs against brute force."""

import collections
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions.text import longest_shared
from netquarry.operators import contrast as C
from netquarry.operators import features as X
from netquarry.operators import graph as G
from netquarry.operators import infer as I


def brute_shared(a, b):
    for n in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - n + 1):
            if a[i : i + n] in b:
                return a[i : i + n]
    return ""


def test_longest_shared_run(spark):
    rng = random.Random(1)
    words = ["", "a", "é中", *["".join(rng.choice("abé") for _ in range(rng.randint(1, 14))) for _ in range(40)]]
    pairs = list(itertools.product(words, words))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", longest_shared(F.col("a"), F.col("b")).alias("x"), longest_shared(F.col("a"), F.col("b"), False).alias("y")).collect()
    assert all(r["x"] == brute_shared(r["a"], r["b"]) and r["y"] == brute_shared(r["a"][:-1], r["b"]) for r in got)
    null = spark.createDataFrame([(None, "a")], "a string, b string").select(longest_shared(F.col("a"), F.col("b"))).first()[0]
    assert null is None


def test_longest_shared_run_of_long_words(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = text(2300)
    a, b = text(4000) + common + text(3700), text(100) + common + text(7600)
    got = spark.createDataFrame([(a, b)], "a string, b string").select(longest_shared(F.col("a"), F.col("b"))).first()[0]
    assert common in got and got in a and got in b and len(got) < 2320


def test_vocabulary_by_first_seen(spark):
    words = [("r1", "b"), ("r1", "a"), ("r2", "a"), ("r2", "b"), ("r3", "c"), ("r3", "d"), ("r4", "d")]
    df = spark.createDataFrame([(r, w, k) for k, (r, w) in enumerate(words)], "row string, word string, seq int")
    assert [r["word"] for r in X.vocabulary(df, 3).collect()] == ["b", "a", "d"]
    assert [r["word"] for r in X.vocabulary(df, 9).collect()] == ["b", "a", "d", "c"]
    assert {tuple(r) for r in X.word_features(df, X.vocabulary(df, 2)).collect()} == {("r1", "b", "1"), ("r1", "a", "1"), ("r2", "a", "1"), ("r2", "b", "1")}


def test_prefix_ladder(spark):
    rows = [("one", 0x0A000105), ("two", 0x0A000105), ("two", 0x0A010105), ("none", None), ("far", 0x0A00F105), ("near", 0x0A000106)]
    ladder = X.prefix_features(spark.createDataFrame(rows, "row string, ip long"))
    got = {(r["row"], r["feature"]): r["value"] for r in ladder.collect()}
    assert len(got) == 5 * 12 and got["one", "subnet_/20"] == "10.0.0.0/20" and got["one", "subnet_/31"] == "10.0.1.4/31"
    assert all(got[r, f"subnet_/{p}"] == "n" for r in ("two", "none") for p in range(20, 32))
    # All lengths to /30 split these rows alike; /31 tells .5 from .6.
    left = X.drop_equal_prefixes(ladder)
    assert {r["feature"] for r in left.collect()} == {"subnet_/20", "subnet_/31"} and left.count() == 2 * 5


def test_neighbor_flags(spark):
    adj = spark.createDataFrame([("i1", "interface", "v1", "vlan"), ("i1", "interface", "a", "acl"), ("i2", "interface", "a", "acl"), ("v1", "vlan", "i1", "interface")], "id string, type string, nbr string, nbr_type string")
    got = {tuple(r) for r in X.neighbor_features(adj, "interface", "vlan", flags=True).collect()}
    assert got == {("i1", "vlan_v1", "1"), ("i1", "has_vlans", "1"), ("i2", "has_vlans", "0")}


def random_items(seed, rows=120, items=9):
    rng = random.Random(seed)
    return {r: (rng.choice("xy"), {f"f{k}" for k in range(items) if rng.random() < 0.35}) for r in range(rows)}


@pytest.mark.parametrize("depth,least", [(1, 1), (2, 1), (3, 1), (3, 12)])
def test_rules_of_items(spark, depth, least):
    table = random_items(depth)
    held = spark.createDataFrame([(r, i) for r, (_, s) in table.items() for i in s], "row int, item string")
    groups = spark.createDataFrame([(r, g) for r, (g, _) in table.items()], "row int, grp string")
    want = collections.Counter()
    for g, s in table.values():
        for n in range(1, depth + 1):
            want.update(((*c,), g) for c in itertools.combinations(sorted(s), n))
    whole = collections.Counter()
    for (c, _), n in want.items():
        whole[c] += n
    got = {(tuple(r["rule"]), r["grp"]): r["a"] for r in X.learn_items(held, groups, depth, least).collect()}
    assert got == {k: n for k, n in want.items() if whole[k[0]] >= least}


def test_rules_with_zeros(spark):
    table = random_items(7, items=5)
    known = [f"f{k}" for k in range(5)] + ["never"]
    ones = spark.createDataFrame([(r, i, "1") for r, (_, s) in table.items() for i in s], "row int, feature string, value string")
    groups = spark.createDataFrame([(r, g) for r, (g, _) in table.items()], "row int, grp string")
    want = collections.Counter()
    for g, s in table.values():
        dense = [f"{f}=>{int(f in s)}" for f in sorted(known)]
        want.update(((i,), g) for i in dense)
        want.update((c, g) for c in itertools.combinations(dense, 2))
    got = {(tuple(r["rule"]), r["grp"]): r["a"] for r in X.learn_one_hot(ones, groups, spark.createDataFrame([(k,) for k in known], "feature string")).collect()}
    assert got == want


def test_sweep_is_one_learning_a_column(spark):
    rng = random.Random(5)
    frame = spark.createDataFrame([tuple(rng.choice(v) for v in ("ab", "xyz", "pq", "mn")) for _ in range(400)], ["c1", "c2", "c3", "c4"])
    columns, limits = ["c1", "c2", "c3", "c4"], {"min_support": 0.01, "min_count": 5, "min_difference": 1, "min_lift": 0.5, "min_confidence": 0.2}
    got = {(r["grouped_by"], tuple(r["rule"]), r["grp"]): tuple(round(r[c], 9) for c in ("support", "lift", "confidence", "precision", "recall", "frequency")) for r in C.sweep(frame, columns, 2, **limits).collect()}
    want = {}
    for g in columns:
        features = [c for c in columns if c != g]
        counts = C.item_counts(frame, features, g)
        learned = C.learn(counts, features, 2)
        for r in C.score(learned, C.not_rules(learned, counts), **limits).collect():
            want[g, tuple(r["rule"]), r["grp"]] = tuple(round(r[c], 9) for c in ("support", "lift", "confidence", "precision", "recall", "frequency"))
    assert got == want and len(got) > 50


def test_text_columns_are_not_binned(spark):
    frame = spark.createDataFrame([(f"v{k}", k) for k in range(40)], "text string, number int")
    assert C.discretize(frame, "text").select("text").distinct().count() == 40
    assert C.discretize(frame, "number").select("number").distinct().count() == 3


def brute_spanning(rows, least_gain, drop):
    """Every rule is counted in every round."""
    by = collections.defaultdict(set)
    for rule, row in rows:
        by[rule].add(row)
    weight, picked = {r: 1.0 for _, r in rows}, []
    while True:
        total = sum(weight.values())
        open_ = {k: sum(weight[r] for r in v) for k, v in by.items() if not (drop and k in picked)}
        if not open_:
            return picked
        rule = max(open_, key=lambda k: (open_[k], -k))
        if rule in picked:
            return picked
        small = open_[rule] / 2 < least_gain * total
        if small and picked and not drop:
            return picked
        picked.append(rule)
        if small and drop:
            return picked
        for r in by[rule]:
            weight[r] /= 2


@pytest.mark.parametrize("drop", [False, True])
def test_spanning_rules_that_overlap(spark, monkeypatch, drop):
    monkeypatch.setattr(C, "RECOUNTED", 3)
    rng = random.Random(6)
    rows = {(k, r) for k in range(40) for r in rng.sample(range(150), rng.choice([4, 10, 10, 30]))}
    df = spark.createDataFrame(list(rows), "rule_id long, row_id long")
    want = brute_spanning(rows, 0.01, drop)
    assert len(want) > 5 and C.spanning_rules(df, 0.01, drop) == want


def brute_cover(rules):
    left, centers = dict(rules), []
    while left:
        near = {k: {o for o, y in left.items() if set(x) & set(y)} for k, x in left.items()}
        best = min(left, key=lambda k: (-len(near[k]), k))
        centers.append(best)
        left = {o: x for o, x in left.items() if o not in near[best]}
    return centers


def test_star_covers_of_rules_that_overlap(spark):
    rng = random.Random(9)
    rules = {k: [f"i{x}" for x in sorted(rng.sample(range(12), rng.choice([1, 2, 2, 3])))] for k in range(30)}
    broken = {r: rng.sample(range(30), rng.randint(1, 12)) for r in range(60)}
    got = C.condense_violations(spark.createDataFrame([(r, k) for r, v in broken.items() for k in v], "row_id long, rule_id long"), spark.createDataFrame([(k, x, "g") for k, x in rules.items()], "rule_id long, rule array<string>, grp string"))
    assert {r["row_id"]: r["centers"] for r in got.collect()} == {r: brute_cover({k: rules[k] for k in v}) for r, v in broken.items()}


def test_curve_is_one_count_a_threshold(spark):
    rng = random.Random(3)
    removed = [(f"a{i}", f"b{i % 7}") for i in range(40)]
    scored = [(f"b{i % 7}", f"a{i}", round(rng.random(), 2)) for i in range(0, 80, 2)] + [("a2", "b2", 0.31), ("a2", "b2", 0.99)]
    grid = [0.1, 0.3, 0.55, 0.9, 0.999]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = {r["threshold"]: (r["hits"], r["suggested"], r["precision"], r["recall"]) for r in G.precision_recall_curve(df(removed, "src string, dst string"), df(scored, "src string, dst string, score double"), grid).collect()}
    for t in grid:
        one = G.precision_recall(df(removed, "src string, dst string"), df([s[:2] for s in scored if s[2] >= t], "src string, dst string")).first()
        assert got[t] == (one["hits"], one["suggested"], one["precision"], one["recall"])


def test_prefixes_of_all_lengths(spark):
    import ipaddress

    rng = random.Random(4)
    for _ in range(3):
        nets = {(x >> (32 - n) << (32 - n), n) for n, x in ((rng.choice([0, 3, 22, 24, 25, 26, 30, 32])if rng.random() < 0.02 else rng.randint(23, 32), 0x0A000000 + rng.randrange(3000)) for _ in range(400))}
        got = {tuple(r) for r in G.aggregate_prefixes(spark.createDataFrame(list(nets), "lo long, length int")).collect()}
        want = ipaddress.collapse_addresses([ipaddress.ip_network((lo, n)) for lo, n in nets])
        assert got == {(int(x.network_address), x.prefixlen) for x in want}
    assert G.aggregate_prefixes(spark.createDataFrame([], "lo long, length int")).count() == 0


def test_symbols_below_the_twelfth_level(spark):
    doc = {"name": {f"n{k}": {"leaf": "x"} for k in range(3)}}
    for k in range(20):
        doc = {f"level{k}": doc}
    other = json.loads(json.dumps(doc).replace('"n', '"m'))
    keys = I.flatten_json(spark.createDataFrame([("a", json.dumps(doc)), ("b", json.dumps(other))], "doc string, json string"))
    depths = {len(r["path"]) for r in I.extract_symbols(keys).collect()}
    assert max(depths) > 20
    with pytest.raises(RuntimeError, match="deeper"):
        I.extract_symbols(keys, max_depth=5)
    assert I.extract_symbols(keys.where("false")).count() == 0


def test_template_paths(spark):
    kinds = [("", "type"), ("a", "name"), ("a/*", "type"), ("a/* x", "type"), ("b", "pair")]
    got = {tuple(r) for r in I.template_paths(spark.createDataFrame(kinds, "signature string, kind string")).collect()}
    assert got == {("a", 1), ("a/NAME", 2), ("a/NAME x", 2), ("b", 1)}
