"""Walks, vectors, nearest neighbours and pairs at a threshold against brute force."""

import collections
import itertools
import random

import numpy as np
import pytest

from netquarry.operators import graph as G
from netquarry.operators import node2vec as N
from netquarry.operators.nearest import nearest_by_hamming
from netquarry.operators.numbering import numbered_in


def both_ways(spark, pairs, kind="interface"):
    return spark.createDataFrame([(x, kind, y, kind) for a, b in pairs for x, y in ((a, b), (b, a))], "id string, type string, nbr string, nbr_type string")


def test_numbers_of_a_hub(spark):
    rows = [("hub", i) for i in range(900)] + [(f"n{i % 40}", i) for i in range(300)]
    random.Random(1).shuffle(rows)
    got = {(r["g"], r["o"]): r["k"] for r in numbered_in(spark.createDataFrame(rows, "g string, o int").repartition(6), "g", "o").collect()}
    by = collections.defaultdict(list)
    for g, o in rows:
        by[g].append(o)
    assert got == {(g, o): k for g, v in by.items() for k, o in enumerate(sorted(v))}


def cliques(n, size):
    """n cliques, each joined to the next by one edge."""
    pairs = [(f"c{k}n{i}", f"c{k}n{j}") for k in range(n) for i, j in itertools.combinations(range(size), 2)]
    return pairs + [(f"c{k}n0", f"c{k + 1}n1") for k in range(n - 1)]


@pytest.mark.parametrize("p,q", [(1, 1), (0.25, 4)])
def test_walks_follow_edges(spark, p, q):
    pairs = cliques(3, 5)
    linked = {frozenset(e) for e in pairs}
    adj = both_ways(spark, pairs)
    walks = N.random_walks(adj, 6, 4, p, q)
    rows = sorted(tuple(r) for r in walks.collect())
    assert len(rows) == 15 * 4 and all(path[0] == start and len(path) == 6 for start, _, path in rows)
    assert all(frozenset(e) in linked for *_, path in rows for e in zip(path, path[1:]))
    assert rows == sorted(tuple(r) for r in N.random_walks(adj, 6, 4, p, q).collect())
    assert rows != sorted(tuple(r) for r in N.random_walks(adj, 6, 4, p, q, seed=8).collect())


def test_steps_have_second_order_weights(spark):
    """From a over b: back to a 1/p, on to c (next to a) 1, on to d or e 1/q; the shares of many walks are theirs."""
    adj = both_ways(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("b", "d"), ("b", "e")])
    p, q = 0.5, 4.0
    seen = collections.Counter(r["path"][2] for r in N.random_walks(adj, 3, 3000, p, q).where("start = 'a'").collect() if r["path"][1] == "b")
    total, weights = sum(seen.values()), {"a": 1 / p, "c": 1, "d": 1 / q, "e": 1 / q}
    assert total > 1000
    for node, w in weights.items():
        share = w / sum(weights.values())
        assert abs(seen[node] / total - share) < 4 * (share * (1 - share) / total) ** 0.5


def test_training_tells_groups_apart():
    """Pairs within two groups only: scores inside are higher than across."""
    rng = np.random.default_rng(1)
    inner, outer = rng.standard_normal((12, 8)) * 0.1, np.zeros((12, 8))
    pairs = np.array([(i, j) for g in (0, 6) for i in range(g, g + 6) for j in range(g, g + 6) if i != j] * 60)
    N.train_pairs(pairs, inner, outer, 0.1, rng)
    score = inner @ outer.T
    assert min(score[:6, :6].mean(), score[6:, 6:].mean()) > max(score[:6, 6:].mean(), score[6:, :6].mean()) + 0.5


def test_similar_nodes_by_walks(spark, monkeypatch):
    """Nodes of a clique are alike; several parts are averaged; one seed gives one result."""
    monkeypatch.setattr(N, "WALKS_A_PART", 150)
    adj = both_ways(spark, cliques(6, 6))
    run = lambda: sorted(tuple(r) for r in N.similar_nodes_by_walks(adj, "interface", 0.8, 8, 12, 16, 3, epochs=6).collect())
    got = run()
    own = sum(a[:2] == b[:2] for a, b, _ in got)
    assert own >= 60 and own / len(got) > 0.8
    assert got == run()


@pytest.mark.parametrize("crowd", [0, 150])
def test_recall_of_similar_pairs(spark, crowd):
    """Against all pairs, with a large group of near copies and one of equal vectors."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    vectors = np.concatenate([centres[rng.integers(60, size=900)] + 0.25 * rng.standard_normal((900, 16)), centres[:1] + 0.01 * rng.standard_normal((crowd, 16)), np.repeat(centres[1:2], crowd, axis=0)])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    got = {(r["a"], r["b"]): r["similarity"] for r in N.similar_pairs(spark.createDataFrame(rows, "id long, vector array<double>"), 0.8).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    np.fill_diagonal(cosine, -1)
    assert all(abs(s - cosine[a, b]) < 2e-6 and s >= 0.8 for (a, b), s in got.items())
    want = set()
    for i in range(900):
        for j in np.lexsort((np.arange(len(rows)), -cosine[i]))[:10]:
            if cosine[i, j] >= 0.8:
                want.add((min(i, int(j)), max(i, int(j))))
    assert len(want & set(got)) >= 0.9 * len(want) > 500
    assert len(got) < 20 * len(rows)


def test_nearest(spark):
    """Random vectors, near copies, ties and bits that all share."""
    rng = random.Random(4)
    rows = [(i, [rng.random() < 0.5 for _ in range(70)]) for i in range(60)]
    rows += [(100 + i, [not x if k == i else x for k, x in enumerate(rows[i % 60][1])]) for i in range(70)] + [(300, rows[0][1]), (-1, rows[1][1])]
    rows = [(i, v[:50] + [True] * 10 + v[60:]) for i, v in rows]
    first = {}
    for i, v in sorted(rows):
        first.setdefault(tuple(v), i)
    got = {r["id"]: (r["nearest"], r["distance"]) for r in nearest_by_hamming(spark.createDataFrame(rows, "vec_id long, v array<boolean>"), 70).collect()}
    assert got.keys() == set(first.values())
    for x, i in first.items():
        d, j = min((sum(p != q for p, q in zip(x, y, strict=True)), j) for y, j in first.items() if j != i)
        assert got[i] == (j, d / 70)
    one = spark.createDataFrame(rows[:1], "vec_id long, v array<boolean>")
    assert nearest_by_hamming(one, 70).count() == 0 and nearest_by_hamming(one.limit(0), 70).count() == 0


def test_nearest_of_many(spark):
    """A hundred thousand vectors in pairs that differ in a few bits."""
    from pyspark.sql import functions as F

    n = 100_000
    bit = lambda x, k: F.pmod(F.shiftright(x, k), F.lit(2)) == 1
    base = spark.range(n).select("id", F.xxhash64(F.floor(F.col("id") / 2)).alias("h"))
    flips = F.when(F.col("id") % 2 == 1, F.col("h").bitwiseXOR(F.expr("shiftleft(1L, cast(id % 61 as int)) | shiftleft(1L, cast(id % 59 as int))"))).otherwise(F.col("h"))
    vectors = base.select(F.col("id").alias("vec_id"), F.array(*[bit(flips, k) for k in range(64)]).alias("v"))
    got = nearest_by_hamming(vectors, 64)
    total, right = got.agg(F.count("*"), F.count_if((F.col("nearest") == F.col("id").bitwiseXOR(F.lit(1))) & (F.col("distance") <= 2 / 64))).first()
    assert total == right == n


def brute_similar(rows, weights, threshold):
    nbrs = collections.defaultdict(lambda: collections.defaultdict(set))
    for i, _, n, k in rows:
        nbrs[i][k].add(n)
    out = {}
    for a, b in itertools.combinations(sorted(nbrs), 2):
        pa = pb = 0.0
        for k, w in weights.items():
            common = len(nbrs[a][k] & nbrs[b][k])
            pa += common / len(nbrs[a][k]) * w if common else 0
            pb += common / len(nbrs[b][k]) * w if common else 0
        if pa >= threshold and pb >= threshold and not pa == pb == 1:
            out[a, b] = (round(pa, 9), round(pb, 9))
    return out


@pytest.mark.parametrize("weights,threshold", [({"vlan": 0.75, "acl": 0.25}, 0.5), ({"vlan": 0.5, "acl": 0.5}, 0.4), ({"vlan": 1.0}, 0.6), ({"vlan": 0.6, "acl": 0.6}, 0.9)])
def test_similar_nodes_at_a_threshold(spark, weights, threshold):
    rng = random.Random(8)
    rows = {(f"i{k}", "interface", f"{kind}{int(rng.paretovariate(0.7)) % 90}", kind) for k in range(130) for kind, n in (("vlan", rng.randint(0, 12)), ("acl", rng.randint(0, 3))) for _ in range(n)}
    got = {(r["a"], r["b"]): (round(r["pa"], 9), round(r["pb"], 9)) for r in G.similar_nodes(spark.createDataFrame(list(rows), "id string, type string, nbr string, nbr_type string"), "interface", weights, threshold).collect()}
    assert got == brute_similar(rows, weights, threshold)


def test_a_hub_makes_no_pairs(spark):
    """A hundred thousand nodes share one neighbour, and few of them more."""
    from pyspark.sql import functions as F

    n = 100_000
    ids = spark.range(n).select(F.format_string("i%06d", "id").alias("id"), F.lit("interface").alias("type"), F.explode(F.array(F.lit("hub"), F.concat(F.lit("own"), "id"), F.concat(F.lit("pair"), F.floor(F.col("id") / 2).cast("string")))).alias("nbr"), F.lit("vlan").alias("nbr_type"))
    front = G.pairs_above(ids.select("id", "nbr"), 0.6)
    assert front.count() == n // 2
    assert G.similar_nodes(ids, "interface", {"vlan": 1.0}, 0.6).count() == n // 2


def test_similar_pairs_are_chosen_before_the_shuffle(spark):
    """Four thousand vectors: 10.1 MB were shuffled when every pair of a cell was, 6.6 MB since."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    vectors = centres[rng.integers(60, size=4000)] + 0.25 * rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "id long, vector array<double>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert N.similar_pairs(df, 0.8).count() > 20_000
    assert written() - before < 8e6


def test_vectors_far_from_all_meet_in_cells(spark, monkeypatch):
    """Random vectors of several groups: most have no neighbour that one flipped bit finds; the shuffle stays small."""
    from netquarry.operators import nearest as R

    monkeypatch.setattr(R, "CELL_SIDE", 300)
    rng = random.Random(9)
    rows = {i: rng.getrandbits(64) for i in range(1000)}
    df = spark.createDataFrame([(i, [bool(x >> k & 1) for k in range(64)]) for i, x in rows.items()], "vec_id long, v array<boolean>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    got = {r["id"]: (r["nearest"], r["distance"] * 64) for r in R.nearest_by_hamming(df, 64).collect()}
    assert written() - before < 10e6
    assert got == {i: min(((x ^ y).bit_count(), j) for j, y in rows.items() if j != i)[::-1] for i, x in rows.items()}


def test_pairs_of_packed_bits(spark):
    """Unknown bits, lengths that differ, more than one word; bits are not compared one by one."""
    from netquarry.functions.text import hamming
    from netquarry.operators.nearest import hamming_pairs

    rng = random.Random(3)
    rows = [(i, i % 3, [rng.choice([True, False, None]) for _ in range(rng.choice([1, 63, 64, 65, 70]))]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, bits array<boolean>")
    from pyspark.sql import functions as F

    x, y = df.toDF("a", "label", "x"), df.toDF("b", "label", "y")
    want = x.join(y, "label").where("a < b").select("a", "b", hamming(F.col("x"), F.col("y")))
    got = hamming_pairs(df, "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and "zip_with" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("p,q", [(0.5, 2.0), (4.0, 0.25), (1.0, 3.0)])
def test_few_draws_are_looked_up(spark, monkeypatch, p, q):
    """A step of walks on a hub's leaves joins few draws a walk, in one or two rounds, and has the weights of its edges."""
    from collections import Counter

    from netquarry.operators import node2vec as N

    tables = []
    kept = N.stored
    monkeypatch.setattr(N, "stored", lambda df, name="table": tables.append((name, kept(df, name))) or tables[-1][1])
    edges = [(f"leaf{k}", "hub") for k in range(40)] + [("leaf0", "leaf1"), ("leaf0", "leaf2")]
    adj = spark.createDataFrame(edges + [(b, a) for a, b in edges], "id string, nbr string")
    found = [r["path"] for r in N.random_walks(adj, 3, 400, p, q).collect()]
    assert len(found) == 41 * 400 and all(len(x) == 3 for x in found)
    met = [x.count() for name, x in tables if name == "met"]
    assert 1 <= len(met) <= 2 and sum(met) < 5 * len(found)
    came = Counter(x[2] for x in found if x[:2] == ["leaf0", "hub"])
    n = sum(came.values())
    whole = 1 / p + 2 + 37 / q
    for want, got in ((1 / p, came["leaf0"]), (2, came["leaf1"] + came["leaf2"]), (37 / q, n - came["leaf0"] - came["leaf1"] - came["leaf2"])):
        share = want / whole
        assert abs(got - n * share) < 5 * (n * share * (1 - share)) ** 0.5 + 1
