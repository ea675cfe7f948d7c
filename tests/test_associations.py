import collections
import random

from netquarry.operators import associations as A
from netquarry.sources import configs as S

from . import configs


def documents(spark, tmp_path, *docs):
    return S.read_configs(spark, configs.write(tmp_path, *docs))


def test_reference_rules(spark, tmp_path):
    c = documents(spark, tmp_path, configs.ACLS)
    rules = A.reference_rules(S.flat_interfaces(c), S.flat_acl_lines(c))
    got = {r["msg"]: (r["n"], r["d"], r["c"]) for r in rules.collect()}
    span = "C(interface's IP falls within range ['{}', '{}'] => ACL {} applied to the interface)"
    # Messages and counts that are known for this network.
    assert got == {
        "C(interface => has ACL reference)": (5, 8, 0.625),
        "C(interface has 'in' ACL applied => interface has 'out' ACL applied)": (2, 3, 0.667),
        "C(interface has 'out' ACL applied => interface has 'in' ACL applied)": (2, 4, 0.5),
        "C(ACL covers interface's IP => interface has that ACL applied)": (1, 3, 0.333),
        span.format("10.0.2.1", "10.0.2.1", "aclA"): (1, 1, 1.0),
        span.format("10.0.3.1", "20.0.2.1", "aclB"): (3, 4, 0.75),
        span.format("10.0.4.1", "10.0.5.1", "aclC"): (2, 2, 1.0),
        span.format("10.0.4.1", "10.0.4.1", "aclD"): (1, 1, 1.0),
    }


def test_vlan_pairs(spark, tmp_path):
    c = documents(spark, tmp_path, configs.VLANS)
    got = {(r["v1"], r["v2"]): (r["n"], r["d"]) for r in A.vlan_pairs(S.flat_trunks(c)).collect()}
    # Pair counts that are known for this network.
    assert got == {(100, 200): (3, 3), (200, 100): (3, 3), (100, 300): (1, 3), (300, 100): (1, 2), (200, 300): (1, 3), (300, 200): (1, 2)}
    assert A.vlan_pairs(S.flat_trunks(c), most=1).count() == 0


def drawn(seed=11, n=60):
    """Own random interfaces: (words, in and out ACL)."""
    rng = random.Random(seed)
    words = {i: {w for w in ("uplink", "lab", "guest", "voice", "rare") if rng.random() < (0.03 if w == "rare" else 0.4)} for i in range(n)}
    acls = {i: (rng.choice([None, "EDGE", "CORE"]), rng.choice([None, "CORE", "OUT"])) for i in range(n)}
    return words, acls


def small(spark):
    words, acls = drawn()
    rows = [(f"d{i % 3}", str(i), w) for i, own in words.items() for w in own]
    ifaces = [(f"d{i % 3}", str(i), 0x0A000001 + 256 * i, 24, a, b) for i, (a, b) in acls.items()]
    return spark.createDataFrame(rows, "device string, iface string, word string"), spark.createDataFrame(ifaces, "device string, iface string, ip long, length int, in_acl string, out_acl string")


def test_keyword_rules(spark):
    words, ifaces = small(spark)
    known, acls = drawn()
    rules = A.keyword_rules(words, ifaces, 10)
    got = {(r["word"], r["acl"]): (r["n"], r["d"]) for r in rules.collect()}
    owners = {w: [i for i in known if w in known[i]] for w in {w for own in known.values() for w in own}}
    want = {(w, a): (sum(a in acls[i] for i in own), len(own)) for w, own in owners.items() if len(own) >= 10 for a in ("EDGE", "CORE", "OUT")}
    assert got == want and len(want) == 12
    missing = {(r["word"], r["acl"], int(r["iface"])) for r in A.keyword_exceptions(words, ifaces, rules).collect()}
    assert missing == {(w, a, i) for w, a in want for i in owners[w] if a not in acls[i]}


def test_common_keywords(spark):
    words, _ = small(spark)
    counts = collections.Counter(w for own in drawn()[0].values() for w in own)
    assert {r["word"]: r["count"] for r in A.common_keywords(words, 10).collect()} == {w: n for w, n in counts.items() if n >= 10}


def test_owners_of_keywords_in_order(spark):
    words, _ = small(spark)
    got = collections.defaultdict(list)
    for r in sorted(A.keyword_owners(words.union(words)).collect(), key=lambda r: (r["word"], r["k"])):
        assert r["k"] == len(got[r["word"]])
        got[r["word"]].append((r["device"], r["iface"]))
    assert got == {w: sorted((f"d{i % 3}", str(i)) for i, own in drawn()[0].items() if w in own) for w in got} and len(got) == 5


def test_keyword_ranges(spark):
    words, ifaces = small(spark)
    known, _ = drawn()
    got = {r["word"]: (r["n"], r["d"]) for r in A.keyword_ranges(words, ifaces).collect()}
    owners = {w: [i for i in known if w in known[i]] for w in got}
    assert got == {w: (len(own), max(own) - min(own) + 1) for w, own in owners.items()}


def test_no_range_join_or_product_in_the_cover_plan(spark):
    _, ifaces = small(spark)
    nets = A.acl_networks(spark.createDataFrame([("R", 0, "10.0.0.0/16", None)], "acl string, line_no int, src string, dst string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = A.covering(nets, ifaces)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "CartesianProduct" not in plan and "[length" in plan
    assert A.covering(nets, ifaces).count() == 60


def test_rules_over_nothing(spark):
    _, ifaces = small(spark)
    none = ifaces.where("false")
    lines = spark.createDataFrame([], "acl string, line_no int, src string, dst string")
    got = A.reference_rules(none, lines).collect()
    assert len(got) == 4 and all(r["c"] is None and r["d"] == 0 for r in got)
