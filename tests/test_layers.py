"""Links, neighbours and DNS transactions over frames by hand."""

import struct

from pyspark.sql import functions as F

from netloom.operators import dns, incidents, layer2
from tests.test_decode import V4, eth, ip
from tests.test_fixtures import made, packet


def test_vlan_alerts_are_spaced(spark):
    rows = made(spark, [packet(no, no) for no in (1, 500, 1000, 1001, 1500, 2001, 9000)]).withColumns({"vlan_id": F.lit(1), "outer_vlan_id": F.lit(None).cast("int"), "vlan_pcp": F.lit(0)})
    assert sorted((r.no, r.signature) for r in layer2.vlan_alerts(rows).collect()) == [(1, "Native-VLAN"), (1001, "Native-VLAN"), (2001, "Native-VLAN"), (9000, "Native-VLAN")]
    crossed = made(spark, [packet(no, no) for no in (1, 2, 3, 4)]).withColumn("vlan_id", F.when(F.col("no") < 3, 5).otherwise(F.col("no").cast("int") * 10))
    assert [(r.no, r.detail) for r in layer2.mac_on_vlans(crossed).collect()] == [(3, "MAC 02:02:02:02:02:02 on VLANs 5,30")]


def test_arp_binding(spark):
    arp = lambda mac: eth(b"\x08\x06", bytes(8) + bytes([mac] * 6) + bytes([10, 0, 0, 1]) + bytes(10))
    p = made(spark, [packet(k, k, bytes_=arp(m)) for k, m in enumerate([1, 1, 2, 2, 1])])
    assert sorted(r.no for r in layer2.arp_changes(p).collect()) == [2, 4]


def icmp6(kind, hops=255, src=b"\xfe\x80", target=b"\1" * 16, link=b"\7" * 6):
    body = bytes([kind, 0, 0, 0]) + bytes(4) + target + b"\2\1" + link
    return eth(b"\x86\xdd", bytes([0x60, 0, 0, 0]) + struct.pack(">H", len(body)) + bytes([58, hops]) + src + bytes(13) + b"\1" + b"\xff\2" + bytes(14) + body)


def test_ipv6_control(spark):
    frames = [icmp6(135), icmp6(135, 64), icmp6(134, src=b"\x20\1"), icmp6(136), icmp6(136, link=b"\x08" * 6)]
    p = made(spark, [packet(k, 10 * k, bytes_=f) for k, f in enumerate(frames)] + [packet(100 + k, 100 + k / 50, bytes_=icmp6(134)) for k in range(20)])
    assert sorted((r.no, r.signature) for r in layer2.ipv6_control(p).collect()) == [(1, "Invalid IPv6 neighbor discovery hop limit"), (2, "Invalid IPv6 router advertisement source"), (4, "IPv6 neighbor binding changed"), (119, "IPv6 router advertisement flood")]


def message(response, name=b"\1a\3com\0", mark=b""):
    return struct.pack(">HHHHHH", 7, 0x8000 if response else 0, 1, 0, 0, 0) + name + b"\0\1\0\1" + mark


def asked(no, t, response=False, server="8.8.8.8", **more):
    data = message(response, **more)
    ports = (53, 4000) if response else (4000, 53)
    frame = eth(V4, ip(17, struct.pack(">HHHH", *ports, 8 + len(data), 0) + data))
    ends = (server, "10.0.0.9") if response else ("10.0.0.9", server)
    return packet(no, t, *ends, "DNS", sp=ports[0], dp=ports[1], bytes_=frame)


def signatures(spark, rows):
    return sorted((r.no, r.signature) for r in dns.transactions(made(spark, rows)).collect())


def test_dns_transactions(spark):
    plain = [asked(1, 0), asked(2, 0.1, True), asked(3, 0.2, True), asked(4, 0.3, True, mark=b"x"), asked(5, 7, True)]
    assert signatures(spark, plain) == [(4, "Conflicting DNS responses"), (5, "Unsolicited DNS response")]
    assert signatures(spark, [asked(1, 0), asked(2, 1, True, server="9.9.9.9", name=b"\1b\3com\0")]) == [(2, "DNS transaction question mismatch"), (2, "Unexpected DNS responder")]
    assert signatures(spark, [asked(1, 0), asked(2, 40, True)]) == [(2, "Unsolicited DNS response")]
    assert dns._question(message(False, b"\xc0\x0c")) is None and dns._question(b"") is None


def test_dns_tunnel(spark):
    p = made(spark, [packet(k, k, protocol="DNS", info=f"Query {'abcdefghijklmnopqrstuvwxyz0123456789'[k % 9:]}{k}.evil.com", dp=53) for k in range(50)] + [packet(90, 90, protocol="DNS", info="Query www.good.com", dp=53)])
    got = {r.apex: (r.queries, r.subdomains, r.severity, r.suspicious) for r in dns.tunnels(p).collect()}
    assert got == {"evil.com": (50, 50, "HIGH", True), "good.com": (1, 1, None, False)}


def test_decisions(spark):
    ends = [("a", "203.0.113.9"), ("b", "203.0.113.9"), ("a", "127.0.0.1"), ("a", "name"), ("a", "198.51.100.1"), ("a", "ff02::1"), ("a", "2001:db8::5")]
    found = spark.createDataFrame([(f"i{k}", "IDS", d, ip_, "10.0.0.1", float(k)) for k, (d, ip_) in enumerate(ends)], "incident_id string, source string, detector string, attacker string, target string, first_time double")
    kept = spark.createDataFrame([("198.51.100.1",)], "address string")
    got = {r.incident_id: r.status for r in incidents.decisions(found, kept, "automatic", most=1).collect()}
    assert got == {"i0": "applied", "i1": "rejected", "i2": "rejected", "i3": "rejected", "i4": "rejected", "i5": "rejected", "i6": "pending approval"}
