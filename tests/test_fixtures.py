"""Operators over small packets written by hand: what the events table can't show."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators import behaviour, enrich, fields
from netloom.sources import pcap
from netloom.streaming import live

SCHEMA = "no long, timestamp double, src string, dst string, protocol string, length int, info string, src_port int, dst_port int, vlan_id int, bytes binary"


def frame(flags=0x02, tags=b"", payload=b"", proto=6):
    ip = bytes([0x45, 0, 0, 40, 0, 0, 0x40, 0, 64, proto, 0, 0, 10, 0, 0, 9, 203, 0, 113, 9])
    tcp = struct.pack(">HHIIBBHHH", 40000, 443, 7, 0, 0x50, flags, 64240, 0, 0)
    return bytearray(b"\0" * 5 + b"\1" + b"\2" * 6 + tags + b"\x08\0" + ip + tcp + payload)


def packet(no, t, src="10.0.0.9", dst="203.0.113.9", protocol="TCP", length=60, info="", sp=40000, dp=443, bytes_=None):
    return (no, float(t), src, dst, protocol, length, info, sp, dp, None, bytes_ or frame())


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_stealth_probes_and_illegal_flags(spark):
    p = made(spark, [packet(k, k, bytes_=frame(f)) for k, f in enumerate([0, 1, 0x29, 0x02, 0x12, 0x03, 0x06])])
    assert {r.no for r in behaviour.stealth_probe(p).collect()} == {0, 1, 2}
    assert {r.no: r.detail.split(" 10.")[0] for r in behaviour.illegal_flags(p).collect()} == {5: "SYN FIN", 6: "SYN RST"}


def test_beacon_and_irregular_control(spark):
    even = [packet(k, 10 * k, length=120) for k in range(7)]
    odd = [packet(100 + k, t, src="10.0.0.8", length=120) for k, t in enumerate([0, 2, 9, 11, 27, 31, 60])]
    assert [r.no for r in behaviour.beacons(made(spark, even + odd)).collect()] == [6]


def test_beacon_again_after_a_quiet_hour(spark):
    rows = [packet(k, 10 * k, length=120) for k in range(9)] + [packet(50 + k, 9000 + 10 * k, length=120) for k in range(9)]
    assert sorted(r.no for r in behaviour.beacons(made(spark, rows)).collect()) == [6, 56]


def test_exfiltration_volume_and_entropy(spark):
    noise = bytearray((i * 73) % 256 for i in range(60000))
    p = made(spark, [packet(k, k, length=60000, bytes_=noise) for k in range(17)])
    assert [r.no for r in behaviour.outbound_volume(p).collect()] == [16]
    assert [r.no for r in behaviour.outbound_entropy(p).collect()] == [4]
    back = made(spark, [packet(k, k, length=60000) for k in range(17)] + [packet(40, 0.5, "203.0.113.9", "10.0.0.9", length=60000, sp=443, dp=40000) for _ in range(3)])
    assert behaviour.outbound_volume(back).count() == 0


def test_dns_abuse(spark):
    nx = [packet(k, k, "8.8.8.8", "10.0.0.9", "DNS", 90, "Response NXDOMAIN x.example", 53, 40000) for k in range(20)]
    txt = [packet(90, 90, "10.0.0.9", "8.8.8.8", "DNS", 600, "Query TXT x.example", 40000, 53), packet(91, 91, "10.0.0.9", "8.8.8.8", "DNS", 512, "Query TXT", 40000, 53)]
    p = made(spark, nx + txt)
    assert [r.no for r in behaviour.nxdomain_burst(p).collect()] == [19]
    assert [r.no for r in behaviour.large_txt(p).collect()] == [90]
    assert [r.no for r in behaviour.external_resolver(p).collect()] == [90]


def test_sweep_and_ntlm(spark):
    sweep = [packet(k, k, dst=f"10.0.2.{k}", protocol="ICMP", info="Echo request") for k in range(12)]
    ntlm = [packet(50 + k, k, dst=f"10.0.3.{k}", bytes_=frame(payload=b"NtLmSsP")) for k in range(3)]
    p = made(spark, sweep + ntlm)
    assert [r.no for r in behaviour.icmp_sweep(p).collect()] == [11]
    assert [r.no for r in behaviour.ntlm_fan_out(p).collect()] == [52]


def test_handshake_takes_the_latest_request_once(spark):
    ask, answer = frame(0x02), frame(0x12)
    rows = [packet(1, 0, bytes_=ask), packet(2, 1, bytes_=ask)] + [packet(no, t, "203.0.113.9", "10.0.0.9", sp=443, dp=40000, bytes_=answer) for no, t in ((3, 1.025), (4, 1.03))]
    assert [(r.no, round(r.latency_ms, 6)) for r in behaviour.handshakes(made(spark, rows)).collect()] == [(3, 25.0)]
    late = [packet(1, 0, bytes_=ask), packet(2, 31, "203.0.113.9", "10.0.0.9", sp=443, dp=40000, bytes_=answer)]
    assert behaviour.handshakes(made(spark, late)).count() == 0


def test_fields_of_tagged_udp_and_short_frames(spark):
    tagged = frame(tags=bytes.fromhex("8100e014"), proto=17)
    p = made(spark, [packet(1, 0, bytes_=tagged), packet(2, 0, bytes_=bytearray(b"\0" * 5)), (3, 0.0, None, None, None, None, None, None, None, None, None)])
    got = {(r.no, r.path): (r.value, r.offset) for r in fields.fields(p).collect()}
    assert got[1, "vlan.id"] == ("20", 14) and got[1, "vlan.pcp"] == ("7", 14) and got[1, "ip.src"] == ("10.0.0.9", 30)
    assert got[1, "udp.srcport"] == ("40000", 38) and (1, "tcp.seq") not in got
    assert {path for no, path in got if no == 2} == {"frame.number", "frame.time", "frame.len", "proto", "payload.len"}
    assert {path for no, path in got if no == 3} == {"frame.number", "frame.time"}


def test_longest_prefix_and_domains(spark):
    prefixes = spark.createDataFrame([("203.0.113.0/24", "1", "wide"), ("203.0.113.128/25", "2", "narrow"), ("0.0.0.0/0", None, "any"), ("bad", "3", "none")], "cidr string, asn string, organization string")
    ends = spark.createDataFrame([(x,) for x in ("203.0.113.200", "203.0.113.1", "9.9.9.9", "10.1.1.1", "fe80::1", "name")], "address string")
    assert {r.address: r.organization for r in enrich.identities(ends, prefixes).collect()} == {"203.0.113.200": "narrow", "203.0.113.1": "wide", "9.9.9.9": "any", "10.1.1.1": "Private network", "fe80::1": "Private network", "name": "Unresolved"}
    assert {r.organization for r in enrich.identities(ends.where("address = '9.9.9.9'"), prefixes.limit(0)).collect()} == {"Unresolved"}
    known = spark.createDataFrame([("domain", "evil.com"), ("domain", "not.evil.com"), ("ip", "a.b")], "kind string, value string")
    texts = spark.createDataFrame([(1, "see NOTEVIL.com and x.not.evil.com"), (2, "a.b"), (3, None)], "id int, text string")
    assert {(r.id, r.word, r.domain) for r in enrich.domain_hits(texts, "id", "text", known).collect()} == {(1, "notevil.com", "evil.com"), (1, "x.not.evil.com", "not.evil.com")}


def test_text_functions(spark):
    row = spark.range(1).select(T.domain(F.lit("Query 0x1 A www.Example.com. 1.2")).alias("d"), T.apex(F.lit("a.b.example.com")).alias("a"), T.authority(F.lit("GET / Host: A.b;, x")).alias("h"), T.flag_names(F.lit(0x12)).alias("f"), T.flag_names(F.lit(0)).alias("n"), T.entropy(F.lit(b"aabb")).alias("e"), T.entropy(F.lit(b"")).alias("z"), T.risk_label(F.lit(0.7)).alias("r"), T.string_class(F.lit("10.0.0.1")).alias("c")).first()
    assert tuple(row) == ("www.example.com", "example.com", "a.b", "SYN ACK", "NONE", 1.0, 0.0, "HIGH", "ip")


@pytest.mark.parametrize("order", "<>")
def test_captures_round_trip(spark, tmp_path, order):
    frames = [bytes(frame(payload=b"x" * k)) for k in range(5)]
    p = made(spark, [packet(k, 1.5 + k, bytes_=bytearray(f)) for k, f in enumerate(frames)])
    body = b"".join(bytes(r[0]) for r in p.orderBy("no").select(pcap.record()).collect())
    if order == "<":
        data = pcap.file_head() + body
    else:
        data = b"\xa1\xb2\xc3\xd4" + b"\0" * 20 + b"".join(struct.pack(">IIII", 1 + k, 500000, len(f), len(f)) + f for k, f in enumerate(frames))
    (tmp_path / "a.pcap").write_bytes(data + b"\1\2\3")  # a record cut off
    got = pcap.read(spark, f"file://{tmp_path}").orderBy("record").collect()
    assert [(r.record, r.timestamp, bytes(r.bytes)) for r in got] == [(k + 1, 1.5 + k, f) for k, f in enumerate(frames)]


def test_streams_agree_with_tables(spark, tmp_path):
    rows = [packet(k, k * 0.4) for k in range(20)] + [packet(99, 500)]
    land = str(tmp_path / "land")
    made(spark, rows).write.parquet(land)
    stream = live.packets(spark, land, SCHEMA)
    for name, df in (("line", live.timeline(stream)), ("burst", live.bursts(stream, ["src", "dst"], 5, 30))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", os.path.join(tmp_path, name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {(r.bucket, r.packets) for r in spark.table("line").collect()} == {(float(b), sum(int(k * 0.4) == b for k in range(20))) for b in range(8)}
    assert [(r.hits, r.first_no, r.last_no) for r in spark.table("burst").collect()] == [(20, 0, 19)]


def test_comparison_of_two_packets(spark):
    left, right = made(spark, [packet(1, 0, bytes_=frame(0x02))]), made(spark, [packet(2, 5, bytes_=frame(0x12, tags=bytes.fromhex("81000014")))])
    assert {(r.path, r.change) for r in fields.compared(left, right).collect()} == {("tcp.flags", "changed"), ("vlan.id", "right only"), ("vlan.pcp", "right only"), ("vlan.dei", "right only")}
