"""Handshakes, streams, feeds and exports over small inputs by hand."""

import struct

import pytest

from netloom.operators import handshake, streams
from netloom.sources import exports, feeds
from tests.test_decode import V4, eth, ip
from tests.test_fixtures import made, packet


def client_hello(name=b"a.example", ciphers=(0x1301, 0x0A0A, 0xC02F)):
    ext = lambda kind, body: struct.pack(">HH", kind, len(body)) + body
    sni = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name
    exts = ext(0x1A1A, b"") + ext(0, sni) + ext(16, b"\0\3\2h2") + ext(13, b"\0\4\4\3\10\4") + ext(43, b"\2\3\4")
    body = b"\3\3" + b"\5" * 32 + b"\0" + struct.pack(">H", 2 * len(ciphers)) + b"".join(struct.pack(">H", c) for c in ciphers) + b"\1\0" + struct.pack(">H", len(exts)) + exts
    return b"\x16\3\1" + struct.pack(">H", len(body) + 4) + b"\1" + len(body).to_bytes(3) + body


def tcp(seq, payload=b"", flags=0x18):
    return eth(V4, ip(6, struct.pack(">HHIIBBHHH", 4000, 80, seq, 0, 0x50, flags, 100, 0, 0) + payload))


def test_hello_fingerprint_and_session(spark):
    server = b"\2\0\0\x26" + b"\3\3" + b"\6" * 32 + b"\0" + b"\x13\1" + b"\0"
    rows = [packet(1, 0, bytes_=tcp(1, client_hello())), packet(2, 1, "203.0.113.9", "10.0.0.9", sp=443, dp=40000, bytes_=tcp(1, b"\x16\3\3" + struct.pack(">H", len(server)) + server)), packet(3, 2, bytes_=tcp(1, client_hello()[:30])), packet(4, 3)]
    p = made(spark, rows)
    got = handshake.hellos(p).orderBy("no").collect()
    assert [(r.no, r.kind, r.sni, r.alpn, r.version, r.ciphers) for r in got] == [(1, 1, "a.example", "h2", 0x0304, [0x1301, 0xC02F]), (2, 2, None, None, 0x0303, [0x1301])]
    assert got[0].ja4.split("_")[0] == "t13d0204h2" and len(got[0].ja4) == 36
    (s,) = handshake.tls_sessions(p).collect()
    assert (s.sni, s.server_cipher, s.first_seen, s.last_seen) == ("a.example", 0x1301, 0.0, 1.0)


def test_quic_headers(spark):
    quic = lambda body: eth(V4, ip(17, struct.pack(">HHHH", 4000, 443, 8 + len(body), 0) + body))
    first = b"\xc0\0\0\0\1\4\1\2\3\4\2\x09\x08" + bytes(20)
    p = made(spark, [packet(1, 0, bytes_=quic(first)), packet(2, 1, src="10.0.0.8", bytes_=quic(first)), packet(3, 1, bytes_=quic(b"\x40" + bytes(20))), packet(4, 1, bytes_=quic(b"\xc0\0\0\0\1\x15" + bytes(40)))])
    h = handshake.quic(p)
    assert {(r.no, r.packet_type, r.destination_id, r.source_id) for r in h.collect()} == {(1, "Initial", "01020304", "0908"), (2, "Initial", "01020304", "0908"), (3, "1-RTT", "", "")}
    assert [(r.packets, r.addresses, r.migrated) for r in handshake.quic_connections(h).collect()] == [(2, 3, True)]


@pytest.mark.parametrize("start", [100, 2**32 - 4])
def test_streams_are_put_in_order(spark, start):
    at = lambda k: (start + 1 + k) % 2**32
    parts = [(start, b"", 2), (at(0), b"abc", 24), (at(6), b"ghi", 24), (at(1), b"bcde", 24), (at(5), b"fg", 24), (at(0), b"abc", 24), (at(20), b"lost", 24)]
    p = made(spark, [packet(k, k, bytes_=tcp(*part)) for k, part in enumerate(parts)])
    got = streams.reassembled(p).orderBy("offset").collect()
    assert b"".join(bytes(r.data) for r in got) == b"abcdefghi" and [r.offset for r in got] == [0, 3, 5, 7]


def test_payload_after_reset(spark):
    rows = [(1, b"a", 24), (2, b"", 4), (3, b"", 16), (3, b"b", 24), (4, b"c", 24), (9, b"", 2), (10, b"d", 24)]
    p = made(spark, [packet(k, k, bytes_=tcp(*r)) for k, r in enumerate(rows)])
    assert [r.no for r in streams.after_reset(p).collect()] == [3]


def test_feeds(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path / name}"

    assert {tuple(r) for r in feeds.indicators(spark, file("i.csv", "# x\nip,1.2.3.4,bad, host\nDOMAIN,evil.com\nhash,aa\nport,9\n\n")).collect()} == {("ip", "1.2.3.4", "bad, host", "i.csv"), ("domain", "evil.com", "", "i.csv"), ("hash", "aa", "", "i.csv")}
    assert {(r.kind, r.value) for r in feeds.plain_indicators(spark, file("p.txt", "1.2.3.4\nevil.com\nword\n")).collect()} == {("ip", "1.2.3.4"), ("domain", "evil.com")}
    assert [tuple(r) for r in feeds.prefixes(spark, file("n.csv", "10.0.0.0/8,AS1,Some, Inc\n")).collect()] == [("10.0.0.0/8", "AS1", "Some, Inc")]
    with pytest.raises(Exception, match="bad line"):
        feeds.prefixes(spark, file("bad.csv", "nonsense\n")).collect()
    assert {(r.kind, r.target) for r in feeds.reputation(spark, file("r.csv", "1.2.3.0/24,high,x,y\nt13d_ab,low,x,y\n")).collect()} == {("address", "1.2.3.0/24"), ("fingerprint", "t13d_ab")}
    assert [tuple(r) for r in feeds.key_log(spark, file("k.log", f"CLIENT_RANDOM {'AB' * 32} {'0f' * 48}\nOTHER {'ab' * 32} 00\nCLIENT_RANDOM zz 00\n")).collect()] == [("CLIENT_RANDOM", "ab" * 32, 48)]


def test_exports(spark, tmp_path):
    path = f"file://{tmp_path}"
    one = spark.createDataFrame([("i1", 1), ("i1", 2)], "incident_id string, no int")
    exports.evidence(one, f"{path}/e")
    exports.evidence(one.unionByName(spark.createDataFrame([("i2", 3)], one.schema)), f"{path}/e")
    assert sorted((r.incident_id, r.no) for r in spark.read.json(f"{path}/e").collect()) == [("i1", 1), ("i1", 2), ("i2", 3)]
    exports.case({"notes": one.withColumnRenamed("no", "value")}, f"{path}/c")
    assert exports.load_case(spark, f"{path}/c")["notes"].columns == ["incident_id"]
