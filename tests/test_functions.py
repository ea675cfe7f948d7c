import ipaddress
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquarry.functions import ip as ipf
from netquarry.functions import text as T
from netquarry.functions.rules import confidence, filter_confidence, rule_group, rule_items


def column(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", expression(F.col("x")).alias("y")).collect())]


def test_networks_agree_with_the_standard_library(spark):
    rng = random.Random(1)
    rows = [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randint(0, 32)}" for _ in range(300)]
    rows += [str(ipaddress.ip_network(r, strict=False)) for r in rows[:100]]
    got = column(spark, rows, lambda x: F.struct(ipf.network(ipf.address_of(x), ipf.prefix_of(x)), ipf.last_address(ipf.address_of(x), ipf.prefix_of(x)), ipf.strict_network(x).isNotNull()))
    for r, (lo, hi, strict) in zip(rows, got, strict=True):
        net = ipaddress.ip_network(r, strict=False)
        assert (lo, hi) == (int(net[0]), int(net[-1]))
        assert strict == (str(net) == r)


def test_invalid_addresses_are_null(spark):
    rows = ["1.2.3", "256.1.1.1", "a.b.c.d", "", None, "1.2.3.4/33", "1.2.3.4/x"]
    assert column(spark, rows, lambda x: F.coalesce(ipf.strict_network(x).isNotNull(), F.lit(False))) == [False] * 7


def test_octets_and_binary(spark):
    rows = [int(ipaddress.IPv4Address("10.1.2.200")), None]
    assert column(spark, rows, lambda x: ipf.octet(x, 4), "long") == ["200", "none"]
    assert column(spark, rows, ipf.binary, "long") == [f"{rows[0]:032b}", "none"]
    assert column(spark, rows, lambda x: F.get(ipf.supernets(x), F.lit(0)), "long") == ["10.1.0.0/20", "n"]


def test_wildcards(spark):
    df = spark.createDataFrame([("20.0.5.0", "0.0.0.255"), ("20.0.5.1", "0.0.0.255"), ("20.0.5.0", "0.0.1.254")], "a string, w string")
    got = [r[0] for r in df.select(ipf.wildcard_network(F.col("a"), F.col("w"))).collect()]
    assert got[0]["hi"] - got[0]["lo"] == 255 and got[1] is None and got[2] is None


def test_generalized_addresses(spark):
    assert column(spark, ["10.11..12/24", "10.11.12.13/24", "10.11.12.13", "ge-0/0/0"], ipf.generalize_address) == ["10.11.0.0/24", "10.11.12.0/24", "10.11.12.13/32", "ge-0/0/0"]


def test_addresses_by_pattern(spark):
    rows = ["1.2.3.4", "1.2.3.4/24", "2001:db8::1", "2001:db8::1/64", "1.2.3", "word", None]
    assert column(spark, rows, ipf.is_address) == [True, True, True, True, False, False, False]


def test_keywords(spark):
    assert column(spark, ["Filtering BY the Bldg mgmt x uplink uplink"], T.keywords) == [["filtering", "building", "management", "uplink"]]


@pytest.mark.parametrize(("a", "b", "want"), [("building", "builder", "build"), ("abc", "xyz", ""), ("", "x", ""), ("xa", "a", "a")])
def test_longest_shared(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.longest_shared(F.col("a"), F.col("b"))).first()[0] == want


def test_longest_shared_without_the_last_character(spark):
    df = spark.createDataFrame([("xab", "ab")], "a string, b string")
    assert df.select(T.longest_shared(F.col("a"), F.col("b"), whole=False)).first()[0] == "a"


def test_ranges_and_names(spark):
    assert column(spark, [[5, 3, 4, 9, 4], [], [7]], T.ranges, "array<long>") == ["3-5,9", "", "7"]
    name = lambda kind: lambda x: T.group_name(F.lit(kind), x)
    assert column(spark, [["Vlan400", "Vlan401", "Vlan405"]], name("vlan"), "array<string>") == ["Vlan{400-401,405}"]
    assert column(spark, [["d_b", "d_a"], ["d_b", "e_a"]], name("interface"), "array<string>") == ["d_{a,b}", "d_b,e_a"]
    assert column(spark, ["1-3,7", "", None, "5"], T.expand_ranges) == [[1, 2, 3, 7], None, None, [5]]


def test_common_starts(spark):
    assert column(spark, ["studentlab", "bgems", "printer"], T.common_starts) == [["student"], ["ems", "bg"], ["printer"]]
    assert column(spark, ["ge0", "123"], T.strip_digits) == ["ge", "123"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 800), st.integers(0, 800)), min_size=1, max_size=30))
def test_confidence_rounds_half_up(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(pairs, "n long, d long").select("n", "d", confidence(F.col("n"), F.col("d")).alias("c"))
    for r in df.collect():
        assert r["c"] == ((2000 * r["n"] + r["d"]) // (2 * r["d"]) / 1000 if r["d"] else None)


def test_rule_texts(spark):
    assert column(spark, ["('a=>1', 'b=>x y')"], rule_items) == [{"a": "1", "b": "x y"}]
    assert column(spark, ["in_acl=>1"], rule_group) == [1]
    rules = spark.createDataFrame([("x", 1, 1, 1.0), ("y", 0, 0, None), ("z", 1, 2, 0.5)], "msg string, n long, d long, c double")
    assert [r["msg"] for r in filter_confidence(rules).collect()] == ["x"]
