"""Frames by hand: decoding, byte signatures, payload text."""

import struct

import pytest

from netloom.operators import decode
from netloom.operators import signatures as G
from tests.test_fixtures import frame, made, packet


def eth(kind, payload, tags=b""):
    return bytearray(b"\0" * 6 + b"\2" * 6 + tags + kind + payload)


def ip(proto, payload, more=0):
    return bytes([0x45, 0]) + struct.pack(">HHH", 20 + len(payload), 7, more) + bytes([64, proto, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + payload


V4 = b"\x08\0"
CASES = [
    (bytearray(frame()), ("10.0.0.9", "203.0.113.9", "HTTPS", "40000 → 443 [SYN] Seq=7", 40000, 443, None, None)),
    (eth(V4, ip(17, struct.pack(">HHHH", 5000, 53, 8, 0))), ("10.0.0.1", "10.0.0.2", "DNS", "5000 → 53 Len=0", 5000, 53, None, None)),
    (eth(V4, ip(17, struct.pack(">HHHH", 5000, 6000, 8, 0) + b"\x80\0\0\0")), ("10.0.0.1", "10.0.0.2", "RTP", "5000 → 6000 Len=4", 5000, 6000, None, None)),
    (eth(V4, ip(6, b"\0" * 4)), ("10.0.0.1", "10.0.0.2", "TCP", "TCP (truncated)", None, None, None, None)),
    (eth(b"\x08\x06", bytes(6) + b"\0\1" + bytes(6) + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 7])), ("10.0.0.1", "10.0.0.7", "ARP", "Who has 10.0.0.7? Tell 10.0.0.1 (request)", None, None, None, None)),
    (eth(b"\x88\x47", b"\0\1\0\0"), ("?.?.?.?", "?.?.?.?", "MPLS", "MPLS Label=16", None, None, None, None)),
    (eth(b"\x88\x63", b"\x11\x09\0\0"), ("?.?.?.?", "?.?.?.?", "PPPoE", "PPPoE PADI", None, None, None, None)),
    (eth(V4, ip(1, b"\x08\0"), b"\x88\xa8\0\x0a\x81\0\xe0\x14"), ("10.0.0.1", "10.0.0.2", "ICMP", "Echo request", None, None, 20, 10)),
    (eth(b"\x86\xdd", bytes([0x60, 0, 0, 0, 0, 2, 58, 255]) + b"\xfe\x80" + bytes(13) + b"\1" + b"\xff\2" + bytes(13) + b"\1" + b"\x86\0"), ("fe80:0000:0000:0000:0000:0000:0000:0001", "ff02:0000:0000:0000:0000:0000:0000:0001", "ICMPv6", "Router advertisement", None, None, None, None)),
    (eth(V4, ip(99, b"")), ("10.0.0.1", "10.0.0.2", "IP(99)", "Unknown IP protocol", None, None, None, None)),
    (bytearray(5), ("?.?.?.?", "?.?.?.?", "RAW", "Unparseable frame", None, None, None, None)),
    (None, ("?.?.?.?", "?.?.?.?", "RAW", "Unparseable frame", None, None, None, None)),
]


def test_frames_of_every_kind(spark):
    rows = spark.createDataFrame([(k, 0.0, data) for k, (data, _) in enumerate(CASES)], "no long, timestamp double, bytes binary")
    got = {r.no: (r.src, r.dst, r.protocol, r.info, r.src_port, r.dst_port, r.vlan_id, r.outer_vlan_id) for r in decode.decoded(rows).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def names(df):
    return sorted((r.no, r.signature) for r in df.collect())


def test_exploits_and_exposures(spark):
    texts = [(80, b"GET /../../../../../admin HTTP/1.1\r\nUser-Agent: x y\r\n"), (445, b"NTLMSSP" + bytes(8)), (443, b"${JNDI:ldap"), (445, b"NTLMSSP Kerberos"), (8000, b"x Union Select y"), (9, b"\x90" * 16), (9, b"\x90" * 15 + b"."), (9, b"clean")]
    p = made(spark, [packet(k, 0, dp=port, bytes_=frame(payload=text)) for k, (port, text) in enumerate(texts)])
    assert names(G.exploits(p)) == [(0, "Directory Traversal"), (1, "Pass-the-Hash (suspected)"), (2, "Log4Shell (CVE-2021-44228)"), (4, "SQL Injection Probe"), (5, "Shellcode NOP sled")]
    assert names(G.exposures(p)) == [(0, "Cleartext HTTP Sensitive Path"), (1, "SMB Null Session")]
    assert [tuple(r)[3:] for r in G.http_records(p).where("no = 0").collect()] == [(80, "GET", "/../../../../../admin", "x y", None)]
    old = made(spark, [packet(1, 0, bytes_=bytearray(b"\x16\x03\x01\0\0\1\0\5")), packet(2, 0, bytes_=bytearray(b"\x16\x03\0\0\0\2")), (3, 0.0, *[None] * 8, None)])
    assert names(G.weak_tls(old)) == [(1, "RC4 Cipher Suite"), (1, "TLS 1.0"), (2, "SSL 3.0 (POODLE)")]


def test_malformed_headers(spark):
    bad_tcp = frame()
    bad_tcp[46] = 0x40  # a header of 16 bytes
    frames = [frame(), bad_tcp, eth(V4, ip(17, b"abc", 0x2000)), eth(V4, ip(17, b"x" * 16, 0x2000))]
    p = made(spark, [packet(k, 0, bytes_=bytearray(f)) for k, f in enumerate(frames)])
    assert names(G.malformed(p)) == [(1, "Malformed TCP header"), (2, "Tiny IPv4 fragment")]


def test_credentials(spark):
    texts = [b"Authorization: Basic dTpw\r\nUSER bob\r\n pass x\r\n", b"AUTH PLAIN\nAGJvYgBwdzEyMw==\na1 LOGIN u p\n* LOGIN z", b"\xff\nUSER x", b"nothing", None]
    p = made(spark, [(k, 0.0, *[None] * 8, bytearray(t) if t else None) for k, t in enumerate(texts)])
    assert {tuple(r) for r in G.credentials(p).collect()} == {(0, "HTTP-BasicAuth", "u:p"), (0, "FTP-USER", "USER bob"), (0, "FTP-PASS", "pass x"), (1, "SMTP-AUTH", ":bob:pw123"), (1, "IMAP-LOGIN", "a1 LOGIN u p")}


@pytest.mark.parametrize("port,payload,severity", [(502, bytes([0, 1, 0, 0, 0, 6, 1, 6]), "HIGH"), (20000, b"\x05\x64" + bytes(10) + b"\x0d", "CRIT"), (102, b"\x03\0" + bytes(5) + b"\x32" + bytes(9) + b"\x29", "CRIT"), (502, bytes([0, 1, 0, 0, 0, 6, 1, 3]), None)])
def test_industrial_commands(spark, port, payload, severity):
    p = made(spark, [packet(1, 0, dp=port, bytes_=frame(payload=payload))])
    assert [r.severity for r in G.industrial(p).collect()] == ([severity] if severity else [])


def test_magic_and_anomalies(spark):
    p = made(spark, [packet(1, 0, dp=9, bytes_=frame(0x12, payload=b"%PDF-1.4 GET ")), packet(2, 0, dp=9, bytes_=bytearray(b"MZ"))])
    assert {tuple(r) for r in G.magic(p).collect()} == {(1, "PDF", 54), (2, "PE/EXE", 0)}
    assert {tuple(r) for r in G.anomalies(p).collect()} >= {(1, "HTTP content on non-standard port")}
