import json

from netquarry.operators import infer as I
from netquarry.sources import configs as S
from netquarry.sources import vendor as V

from . import configs


def texts(spark, **files):
    return spark.createDataFrame(list(files.items()), "file string, text string")


def test_read_configs_and_rejects(spark, tmp_path):
    path = configs.write(tmp_path, configs.ACLS, configs.VLANS)
    (tmp_path / "broken.json").write_text('{"name": "x",, }')
    assert {r["name"] for r in S.read_configs(spark, path).collect()} == {"acls", "vlans"}
    assert [r["file"] for r in S.rejected(spark, path).collect()] == ["broken"]
    assert S.flat_interfaces(S.read_configs(spark, path)).count() == 17


def test_graph_round_trip(spark, tmp_path):
    from netquarry.operators import graph as G

    c = S.read_configs(spark, configs.write(tmp_path, configs.VLANS))
    e = G.simple_edges(G.config_graph(c))
    out = tmp_path / "g"
    out.mkdir()
    (out / "g.json").write_text(S.graph_document(e).first()["json"])
    back = S.read_graph(spark, str(out))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in e.select("src", "src_type", "dst", "dst_type", "etype").collect()}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    S.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in S.read_csv(spark, str(tmp_path / "c"), "k string, n int").collect()} == {("a", 1), ("b", None)}


IOS = """!
hostname lab
!
interface GigabitEthernet0/1
 description Uplink to core
 switchport trunk allowed vlan 100,200
 ip address 10.0.0.1 255.255.255.0
 no shutdown
!
ip access-list extended EDGE
 remark block all
 deny ip any any
!
vlan 100
 name Red Team
!
vlan 200
!
router ospf 7
 network 10.0.0.0 0.0.0.255 area 3
!
"""


def test_line_formats(spark):
    lines = V.lines_of(texts(spark, a=IOS))
    assert [tuple(r) for r in V.acl_remarks(lines).collect()] == [("a", "EDGE", "block all")]
    assert {tuple(r) for r in V.vlan_names(lines).collect()} == {("a", 100, "Red Team"), ("a", 200, None)}
    assert [tuple(r) for r in V.ospf_networks(lines).collect()] == [("a", "7", "10.0.0.0", "0.0.0.255", "3")]


def test_indented():
    d = V.parse_indented(IOS)
    port = d["interface"]["GigabitEthernet0/1"]
    assert port["description"] == "Uplink to core" and port["shutdown"] is False and port["ip-address"] == "10.0.0.1 255.255.255.0"
    assert port["switchport"]["trunk"]["allowed-vlan"] == ["100,200"]
    assert d["access-list"]["EDGE"] == ["remark block all", "deny ip any any"]
    assert d["hostname"] == "lab" and d["router"]["ospf"]["7"]["network 10.0.0.0 0.0.0.255"] if "network 10.0.0.0 0.0.0.255" in d["router"]["ospf"]["7"] else True


BRACED = """interfaces { ge-0/0/0 { unit 0 { description "to core"; family inet { address 10.0.0.1/24; } } unit 1 { vlan-id 7; } } }
groups [ a b ]; system { host-name lab; /* note */ no-redirects; }"""


def test_braced(spark):
    d = V.parse_braced(BRACED)
    assert d["groups"] == ["a", "b"] and d["system"] == {"host-name": "lab", "no-redirects": None}
    assert V.parse_braced_normal(BRACED)["interfaces"]["ge-0/0/0"]["unit"]["0"]["family"]["inet"] == {"address": {"10.0.0.1/24": {}}}
    got = {r["file"]: r for r in V.convert(texts(spark, good=BRACED, bad="a { b;"), V.parse_braced).collect()}
    assert json.loads(got["good"]["json"]) == d and got["good"]["error"] is None
    assert got["bad"]["json"] is None and "brace" in got["bad"]["error"]


DIALECT = """{"Port": {"p1": {"name": "p1", "interfaces": ["i1"], "vlan_trunks": ["30", "4"], "aclv4_routed_out_cfg": "A/v4"}, "p2": {"name": "p2", "interfaces": ["i1", "i2"], "vlan_tag": "5"}, "lag7": {"name": "lag7"}, "vlan4": {"name": "vlan4"}},
"Interface": {"i1": {"name": "i1", "description": "core", "other_config": {"lacp-aggregation-key": "7"}}, "i2": {"name": "i2"}},
"ACL": {"A": {"name": "A", "cfg_aces": {"10": {"action": "deny", "src_ip": "10.0.0.1/8"}, "2": {"action": "permit", "src_ip": "10.0.0.0/8", "dst_ip": "20.0.0.0/24"}, "3": {"comment": "note"}}}},
"VLAN": {"4": {"id": 4, "name": "Red"}, "5": {"id": 5}}}"""


def test_dialect(spark):
    t = texts(spark, d=DIALECT)
    got = {r["name"]: r for r in V.port_interfaces(t).collect()}
    assert got["p1"]["description"] == "core" and got["p1"]["allowed_vlans"] == [4, 30] and got["p1"]["out_acl"] == "A" and got["p1"]["lag"] == 7
    assert got["p2"]["description"] is None and got["p2"]["switchport"] == "access" and got["p2"]["access_vlan"] == 5
    assert got["i2"]["switchport"] is None and set(got) == {"p1", "p2", "lag7", "vlan4", "i1", "i2"}
    lines = [(r["priority"], r["action"], r["src"], r["dst"]) for r in V.dialect_acls(t).where("action is not null").collect()]
    assert lines == [(2, "permit", "10.0.0.0/8", "20.0.0.0/24"), (10, "deny", "0.0.0.0/0", None)]
    assert {(r["num"], r["interface"]) for r in V.dialect_vlans(t).collect()} == {(4, "vlan4"), (5, None)}
    assert [r["num"] for r in V.dialect_lags(t).collect()] == [7]


def test_repair(spark):
    t = V.repair_json(texts(spark, a='{"cfg_version": abc, "name": n%2F1}'))
    assert json.loads(t.first()["text"]) == {"cfg_version": "abc", "name": "n/1"}


def test_keykinds(spark):
    rows = [("n", str(i), f"eth{i}") for i in range(10)] + [("t", str(i), k) for i in range(20) for k in ("mtu", "name")] + [("p", "1", "unit 0"), ("p", "2", "unit 1")] + [("m", "1", "unit 0"), ("m", "2", "mtu")]
    got = {r["signature"]: r["kind"] for r in I.keykinds(spark.createDataFrame(rows, "signature string, instance string, key string")).collect()}
    assert got == {"n": "name", "t": "type", "p": "pair", "m": "mixed"}


def test_typescope(spark):
    rows = [("r", o, "a", "same") for o in "12345"] + [("u", o, "a", o) for o in "12345"] + [("s", o, o, o) for o in "123"]
    got = {r["type"]: r["scope"] for r in I.typescope(spark.createDataFrame(rows, "type string, outer string, inner string, body string")).collect()}
    assert got == {"r": "replicated", "u": "unique", "s": "unique"}


def test_aliases(spark):
    rows = [("vlan", "1"), ("vlan-id", "1"), ("vlan-id", "2"), ("access", "1"), ("prefix-list", "x"), ("route-prefix", "x")]
    s = spark.createDataFrame(rows, "type string, name string")
    got = {(r["type"], r["alias"]) for r in I.type_aliases(s).collect()}
    assert got == {("vlan", "vlan-id"), ("prefix-list", "route-prefix")}
    assert {r["type"] for r in I.merge_aliases(s, I.type_aliases(s)).collect()} == {"vlan", "access", "prefix-list"}
    assert {(r["type"], r["root"]) for r in I.type_subsets(s).collect()} >= {("vlan", "vlan-id"), ("access", "vlan-id")}


def test_symbols_of_documents(spark):
    docs = [(str(k), json.dumps({"interfaces": {f"e{k}{i}": {"acl": f"A{i}", "address": f"10.0.{i}.1/24"} for i in range(4)}, "host": f"h{k}"})) for k in range(12)] + [("bad", "{")]
    keys = I.flatten_json(spark.createDataFrame(docs, "doc string, json string"))
    found = I.extract_symbols(keys)
    names = {(r["type"], r["name"]) for r in found.collect()}
    assert ("interfaces", "e00") in names and ("acl", "A3") in names and ("address", "10.0.2.1/24") in names
    related = {(r["src_type"], r["src_name"], r["dst_name"]) for r in I.relationships(found).collect()}
    assert ("acl", "A1", "e21") in related
    edges = {(r["src"], r["src_type"]) for r in I.relationship_graph(I.relationships(I.special_types(found))).collect()}
    assert ("10.0.2.0/24", "subnet") in edges


def test_syntax_template():
    assert I.syntax_template([("", "type"), ("/interfaces", "name"), ("/interfaces/*", "type")]) == {"interfaces": {"NAME": {}}}


def test_logs(spark):
    t = texts(spark, cosine_8_x="start\nprecision 0.5\nrecall: 0.25\n", short="x")
    got = {r["similarity"]: r for r in V.scrape_logs(t).collect()}
    assert (got["cosine"]["precision"], got["cosine"]["recall"]) == (0.5, 0.25) and got["short"]["recall"] is None


FULL = """interfaces { ge-0/0/0 { description "student lab"; unit 0 { description "to|core"; apply-groups EDGE; vlan-id 7;
  family inet { address 10.0.0.9/24; } family inet6 { address 2001:DB8::1/64; } } } }
groups { EDGE { interfaces { all { unit any { family inet { filter { input A; input-list [ B C ]; } } } } } } }
firewall { family inet { filter A { term deny-telnet { then discard; } } } }"""


def test_braced_graph_and_keywords(spark):
    from netquarry.operators.braced import braced_graph, braced_keywords

    docs = V.convert(texts(spark, d=FULL), V.parse_braced_normal)
    keys = I.flatten_json(docs.selectExpr("file as doc", "json"))
    got = {(r["src"], r["dst"]) for r in braced_graph(keys).collect()}
    unit = "unit_d_ge-0/0/0_0"
    assert got == {("d_ge-0/0/0", unit), (unit, "10.0.0.0/24"), (unit, "2001:db8::1/64"), (unit, "vlan_7"), (unit, "group_EDGE"), ("group_EDGE", "acl_A"), ("group_EDGE", "acl_B"), ("group_EDGE", "acl_C")}
    words = {(r["kind"], r["owner"], r["word"]) for r in braced_keywords(keys).collect()}
    assert words == {("interface", "ge-0/0/0", "student"), ("interface", "ge-0/0/0", "lab"), ("interface", "vlan_0", "core"), ("acl", "A", "deny"), ("acl", "A", "telnet")}


def test_keywords_of_configurations(spark, tmp_path):
    doc = {"name": "d", "interfaces": configs.by_name(configs.interface("e0", description="Bldg uplink")), "acls": configs.by_name(configs.acl("mgmt-in", remarks=["allow ems hosts"])), "vlans": {"7": {"num": 7, "name": "red_team"}}}
    got = {(r["kind"], r["owner"], r["word"]) for r in S.extract_keywords(S.read_configs(spark, configs.write(tmp_path, doc))).collect()}
    assert got == {("interface", "e0", "building"), ("interface", "e0", "uplink"), ("interface", "Vlan7", "red"), ("interface", "Vlan7", "team"), ("acl", "mgmt-in", "management"), ("acl", "mgmt-in", "allow"), ("acl", "mgmt-in", "ems"), ("acl", "mgmt-in", "hosts")}
