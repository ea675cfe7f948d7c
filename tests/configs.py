"""Small configuration documents in the library's format."""

import json


def interface(name, **more):
    keys = ("description", "address", "in_acl", "out_acl", "switchport", "access_vlan", "allowed_vlans")
    return {"name": name, **{k: more.get(k) for k in keys}}


def acl(name, *lines, remarks=()):
    return {"name": name, "remarks": list(remarks), "lines": [{"action": a, "srcIps": s, **({"dstIps": d} if d else {})} for a, s, d in lines]}


def by_name(*items):
    return {x["name"]: x for x in items}


# The small network whose rules and confidences are known, so that results can be held against them.
G = "GigabitEthernet0/"
ANY = "0.0.0.0/0"
ACLS = {
    "name": "acls",
    "interfaces": by_name(
        interface(G + "1", address="10.0.1.1/24"),
        interface(G + "2", address="10.0.2.1/24", in_acl="aclA"),
        interface(G + "3", address="10.0.3.1/24", out_acl="aclB"),
        interface(G + "4", address="10.0.4.1/24", in_acl="aclC", out_acl="aclD"),
        interface(G + "5", address="10.0.5.1/24", in_acl="aclC", out_acl="aclB"),
        interface(G + "6", address="20.0.2.1/24", out_acl="aclB"),
        interface(G + "7", address="20.0.3.1/24"),
        interface(G + "8", address="20.0.4.1/24"),
    ),
    "acls": by_name(
        acl("aclA", ("DENY", "20.0.1.128/25", None), ("PERMIT", "20.0.1.0/24", None)),
        acl("aclB", ("DENY", "20.0.2.1", ANY), ("PERMIT", ANY, ANY)),
        acl("aclC", ("PERMIT", "20.0.3.0/24", ANY), ("PERMIT", "20.0.4.1", ANY), ("DENY", ANY, "20.0.5.0/24"), ("DENY", ANY, "20.0.6.1"), ("PERMIT", "20.0.7.0/24", "20.0.8.0/24"), remarks=["Test filtering by source or destination"]),
        acl("aclD", ("PERMIT", "20.0.15.0/24", ANY), ("PERMIT", "20.0.16.0/24", ANY)),
    ),
    "vlans": {},
    "ospf": {},
}
VLANS = {
    "name": "vlans",
    "interfaces": by_name(
        interface(G + "1", switchport="trunk", allowed_vlans=[100, 200, 300]),
        interface(G + "2", switchport="trunk", allowed_vlans=[300]),
        interface(G + "3", switchport="trunk", allowed_vlans=[100, 200]),
        interface(G + "4", switchport="trunk", allowed_vlans=[100, 200]),
        interface(G + "5", switchport="trunk", allowed_vlans=[400]),
        interface("Vlan100", description="Red"),
        interface("Vlan200", description="Orange"),
        interface("Vlan300", description="Yellow"),
        interface("Vlan400", description="Green"),
    ),
    "acls": {},
    "vlans": {},
    "ospf": {},
}
VLAN_WORDS = {"name": "vlans", "interfaces": {"Vlan100": ["red"], "Vlan200": ["orange"], "Vlan300": ["yellow"], "Vlan400": ["green"]}, "acls": {}}


def write(folder, *documents):
    for d in documents:
        (folder / f"{d['name']}.json").write_text(json.dumps(d))
    return str(folder)
