"""Registered queries over frames that SQL makes from the events table, one kind of frame for each event.

The SQL that makes frames runs in Spark and in DuckDB alike. The twins say what is to be found from the event's own
numbers (which part of which datagram it stands for, and of which kind that datagram is), never from the bytes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import behaviour, control, detect, dns, fingerprints, fragments, handshake, layer2, processes, signatures, streams
from netloom.plans.packets import SQL, packets

EVENTS = "(SELECT event_id AS n, CAST(event_id AS DOUBLE) / 40 AS t, CAST(user_id % 6 + 1 AS INT) AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type AS e FROM {events})"


def hx(number: object, width: int) -> str:
    return f"lpad(hex({number}), {width}, '0')"


def part(size: int) -> str:
    """Events in groups: d is the group, part the place in it."""
    return f"(SELECT *, CAST((n - n % {size}) / {size} AS BIGINT) AS d, n % {size} AS part FROM {EVENTS} e0)"


def frames(of: str, src: str, dst: str, body: list[str], protocol: str = "'TCP'", info: str = "e", sport: str = "NULL", dport: str = "NULL", vlan: str = "NULL", t: str = "t", where: str = "true", more: str = "") -> str:
    data = f"unhex(concat({', '.join(body)}))"
    return f"SELECT n + 1 AS no, {t} AS timestamp, {src} AS src, {dst} AS dst, {protocol} AS protocol, CAST({sport} AS INT) AS src_port, CAST({dport} AS INT) AS dst_port, CAST({vlan} AS INT) AS vlan_id, {info} AS info, CAST(octet_length({data}) AS INT) AS length, {data} AS bytes{more} FROM {of} f0 WHERE {where}"


def ether(kind: str, src: str = "'000000000002'", dst: str = "'000000000001'") -> list[str]:
    return [dst, src, f"'{kind}'"]


def ipv4(payload: object, proto: str, src: str, dst: str, ident: str = "'0000'", flags: str = "'4000'", total: str | None = None) -> list[str]:
    """payload is the number of bytes after the header; src and dst are hex."""
    return ["'4500'", hx(total or f"20 + {payload}", 4), ident, flags, f"'40{proto}0000'", src, dst]


def tcp(sport: str, dport: str, seq: str, flags: str = "'18'", window: str = "'FAF0'") -> list[str]:
    return [hx(sport, 4), hx(dport, 4), hx(seq, 8), "'00000000'", "'50'", flags, window, "'00000000'"]


def udp(sport: str, dport: str, payload: object) -> list[str]:
    return [hx(sport, 4), hx(dport, 4), hx(f"8 + {payload}", 4), "'0000'"]


def ipv6(payload: object, following: str, src: str, dst: str, hops: str = "'40'") -> list[str]:
    return ["'60000000'", hx(payload, 4), following, hops, src, dst]


FLAGS = f"""SELECT no, timestamp, src, dst, protocol, src_port, dst_port, vlan_id, info, length, unhex(concat(substring(hex(bytes), 1, 92), CASE WHEN no % 17 = 0 THEN '40' ELSE '50' END,
  CASE no % 13 WHEN 0 THEN '03' WHEN 1 THEN '00' WHEN 2 THEN '01' WHEN 3 THEN '29' WHEN 4 THEN '06' ELSE '02' END, substring(hex(bytes), 97))) AS bytes FROM ({SQL}) p0"""
_LETTERS = "CASE WHEN d % 5 = 1 AND part = 3 THEN 'ZZZZZZZZ' WHEN d % 5 = 2 AND part = 3 THEN 'BBBBBBBB' WHEN d % 5 = 3 AND part = 0 THEN 'AAAA' WHEN part = 0 THEN 'AAAAAAAA' WHEN part = 1 THEN 'BBBBBBBB' WHEN part = 2 THEN 'CCCCCCCC' ELSE 'DDDDDDDD' END"
_SRC4 = "concat('0A0000', lpad(hex(d % 6 + 1), 2, '0'))"
_SRC = "concat('10.0.0.', CAST(d % 6 + 1 AS STRING))"
#: Datagrams of four fragments: 1 contradicts itself, 2 repeats itself, 3 begins with four bytes, 4 has a length below its header's.
FRAGMENTS = frames(part(4), _SRC, "'10.0.1.1'", [*ether("0800"), *ipv4("0", "11", _SRC4, "'0A000101'", hx("d % 65536", 4), hx("CASE WHEN part < 3 THEN 8192 ELSE 0 END + CASE WHEN part = 3 AND d % 5 IN (1, 2) THEN 1 ELSE part END", 4), f"CASE WHEN d % 5 = 4 AND part = 2 THEN 16 ELSE 20 + length({_LETTERS}) END"), f"hex({_LETTERS})"], "'UDP'")
FLOOD = frames(part(100), _SRC, "'10.0.1.1'", [*ether("0800"), *ipv4("8", "11", _SRC4, "'0A000101'", hx("d % 65536", 4), hx("8192 + part", 4)), "'4141414141414141'"], "'UDP'")
_SAID = "CASE part WHEN 0 THEN '' WHEN 1 THEN 'HELLO' WHEN 2 THEN CASE d % 3 WHEN 0 THEN 'HELLO' WHEN 1 THEN 'XXXX' ELSE '' END ELSE 'WORLD' END"
#: Flows of four segments: 0 sends one twice, 1 contradicts itself, 2 goes on after a reset.
SEGMENTS = frames(part(4), _SRC, "'10.0.1.1'", [*ether("0800"), *ipv4(f"20 + length({_SAID})", "06", _SRC4, "'0A000101'"), *tcp("20000 + d % 20000", "80", "CASE part WHEN 0 THEN 1000 WHEN 1 THEN 1001 WHEN 2 THEN CASE WHEN d % 3 = 1 THEN 1003 ELSE 1001 END ELSE 1006 END", "CASE WHEN part = 0 THEN '02' WHEN part = 2 AND d % 3 = 2 THEN '04' ELSE '18' END"), f"hex({_SAID})"], "'HTTP'", sport="20000 + d % 20000", dport="80")
_V6 = "concat('FE80', repeat('0', 26), lpad(hex(d % 6 + 1), 2, '0'))"
_AT = "CASE WHEN d % 4 = 1 THEN CASE part WHEN 0 THEN 16 WHEN 1 THEN 0 ELSE 8 END WHEN d % 4 IN (2, 3) AND part = 1 THEN 0 ELSE part * 8 END"
#: Datagrams of three fragments: 0 in order, 1 out of order, 2 contradicts itself, 3 repeats itself and stays unfinished.
FRAGMENTS6 = frames(part(3), "concat('fe80::', CAST(d % 6 + 1 AS STRING))", "'fe80::99'", [*ether("86DD"), *ipv6(16, "'2C'", _V6, "concat('FE80', repeat('0', 26), '99')"), "'0600'", hx(f"{_AT} + CASE WHEN {_AT} < 16 THEN 1 ELSE 0 END", 4), hx("d", 8), f"CASE WHEN d % 4 = 2 AND part = 1 THEN hex('########') ELSE CASE {_AT} WHEN 0 THEN '9C400050247B6A6E' WHEN 8 THEN hex('di:ldap:') ELSE hex('//x/aaaa') END END"], "'IPv6'")
FLOOD6 = frames(part(200), "'fe80::1'", "'fe80::99'", [*ether("86DD"), *ipv6(16, "'2C'", _V6, "concat('FE80', repeat('0', 26), '99')"), "'0600'", hx("part * 8 + 1", 4), hx("d", 8), "'4141414141414141'"], "'IPv6'")
_MAC = "concat('0200000000', lpad(hex(u), 2, '0'))"
_IP = "concat('10.0.0.', CAST(u AS STRING))"
_IP4 = "concat('0A0000', lpad(hex(u), 2, '0'))"
ARP = frames(EVENTS, _IP, "'10.0.0.99'", [*ether("0806", _MAC, "'FFFFFFFFFFFF'"), "'0001080006040002'", f"CASE WHEN k % 10 = 0 THEN '0200000000FF' ELSE {_MAC} END", _IP4, "'000000000000'", "'0A000063'"], "'ARP'")
VLANS = frames(EVENTS, _IP, "'10.0.1.1'", ["CASE WHEN k % 13 = 0 THEN '01000CCCCCCC' ELSE '000000000001' END", _MAC, "'0800'", "'00'"], vlan="CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 20 ELSE NULL END", more=", CAST(CASE WHEN k % 9 = 0 THEN 7 ELSE NULL END AS INT) AS vlan_pcp, CAST(CASE WHEN k % 7 = 0 THEN 100 ELSE NULL END AS INT) AS outer_vlan_id")
#: Spanning tree frames of views and clicks, LLDP of all other events.
BRIDGES = frames(EVENTS, _IP, "''", ["CASE WHEN e IN ('view', 'click') THEN concat('0180C2000000', " + _MAC + ", '0026', '4242030000', '00', '00', CASE WHEN k % 7 = 0 THEN '01' ELSE '00' END, repeat('00', 20)) ELSE concat('0180C200000E', " + _MAC + ", '88CC', '0207', '04', CASE WHEN k % 8 = 0 THEN '0200000000FF' ELSE " + _MAC + " END, '0000') END"], "'L2'")
_LINK = "concat(CASE WHEN k % 6 = 0 THEN '2001' ELSE 'FE80' END, repeat('0', 26), lpad(hex(u), 2, '0'))"
#: Router advertisements of views and clicks, neighbour advertisements of all other events.
NEIGHBOURS = frames(EVENTS, "concat('fe80::', CAST(u AS STRING))", "'ff02::1'", [*ether("86DD", _MAC), *ipv6(32, "'3A'", _LINK, "concat('FF02', repeat('0', 27), '1')", "CASE WHEN k % 10 = 0 THEN '40' ELSE 'FF' END"), "CASE WHEN e IN ('view', 'click') THEN '86000000' ELSE '88000000' END", "'00000000'", "concat(repeat('0', 30), lpad(hex(u), 2, '0'))", "'0201'", f"CASE WHEN k % 7 = 0 THEN '0200000000FF' ELSE {_MAC} END"], "'ICMPv6'")
EXTENDED = frames(EVENTS, "concat('fe80::', CAST(u AS STRING))", "'fe80::99'", [*ether("86DD", _MAC), *ipv6("8 * (k % 12)", "CASE WHEN k % 12 > 0 THEN '00' ELSE '3B' END", "concat('FE80', repeat('0', 28))", "concat('FE80', repeat('0', 28))"), "repeat('0000000000000000', greatest(k % 12 - 1, 0))", "CASE WHEN k % 12 > 0 THEN '3B00000000000000' ELSE '' END"], "'IPv6'")
_CLIENT = "concat('10.0.0.', CAST(d % 6 + 1 AS STRING))"
_ASKS = "(part = 0 OR part = 3 OR (part = 2 AND d % 6 NOT IN (4, 5)))"
_ID = "CASE WHEN part = 1 AND d % 6 = 3 THEN (d + 30000) % 65536 WHEN part = 3 OR (part = 2 AND d % 6 NOT IN (4, 5)) THEN (d + 10000 + part) % 65536 ELSE d % 65536 END"
_SERVER = "CASE WHEN (part = 1 AND d % 6 = 1) OR (part = 2 AND d % 6 = 4) THEN '9.9.9.9' ELSE '8.8.8.8' END"
_NAME = "concat(CASE WHEN part = 1 AND d % 6 = 2 THEN 'b' ELSE 'a' END, CAST(d % 7 AS STRING))"
#: Groups of a request, its answer, and two more messages: 1 is answered by another server, 2 to another question, 3 with another number, 4 twice and differently, 5 twice alike.
NAMES = frames(part(4), f"CASE WHEN {_ASKS} THEN {_CLIENT} ELSE {_SERVER} END", f"CASE WHEN {_ASKS} THEN {_SERVER} ELSE {_CLIENT} END", [
    *ether("0800"), *ipv4("8 + 32", "11", f"CASE WHEN {_ASKS} THEN {_SRC4} ELSE '08080808' END", f"CASE WHEN {_ASKS} THEN '08080808' ELSE {_SRC4} END"), f"CASE WHEN {_ASKS} THEN {hx('30000 + d % 1000', 4)} ELSE '0035' END", f"CASE WHEN {_ASKS} THEN '0035' ELSE {hx('30000 + d % 1000', 4)} END", hx(8 + 32, 4), "'0000'",
    hx(_ID, 4), f"CASE WHEN {_ASKS} THEN '0100' ELSE '8180' END", "'0001000000000000'", "'02'", f"hex({_NAME})", "'07'", "hex('example')", "'03'", "hex('com')", "'0000010001'"], "'DNS'",
    sport=f"CASE WHEN {_ASKS} THEN 30000 + d % 1000 ELSE 53 END", dport=f"CASE WHEN {_ASKS} THEN 53 ELSE 30000 + d % 1000 END")
TUNNELS = f"SELECT n + 1 AS no, t AS timestamp, 'DNS' AS protocol, concat('Query A x', substring(md5(CAST(n % 500 AS STRING)), 1, CAST(4 + k % 28 AS INT)), '.t', CAST(u AS STRING), '.net') AS info, 40000 AS src_port, 53 AS dst_port FROM {EVENTS} e1"
ANSWERED = f"SELECT n + 1 AS no, t AS timestamp, '8.8.8.8' AS src, {_IP} AS dst, 'DNS' AS protocol, CASE e WHEN 'error' THEN 'Response NXDOMAIN' WHEN 'view' THEN 'Response TXT' ELSE 'Response A' END AS info, CAST(400 + k * 2 AS INT) AS length, 53 AS src_port, 40000 AS dst_port FROM {EVENTS} e1"
ECHOES = f"SELECT n + 1 AS no, t AS timestamp, {_IP} AS src, concat('10.0.1.', CAST(k AS STRING)) AS dst, CASE WHEN e = 'error' THEN 'UDP' ELSE 'ICMP' END AS protocol, CASE WHEN e = 'view' THEN 'Echo reply' ELSE 'Echo request' END AS info, CAST(NULL AS INT) AS dst_port FROM {EVENTS} e1"
#: Flows by the event's number: the first three send every six seconds and evenly, others at odd times or of odd sizes.
BEACONS = f"SELECT n + 1 AS no, CAST(n AS DOUBLE) + CASE WHEN n % 6 = 3 THEN k % 5 ELSE 0 END AS timestamp, concat('10.0.0.', CAST(n % 6 AS STRING)) AS src, 40000 AS src_port, '203.0.113.7' AS dst, 443 AS dst_port, 'HTTPS' AS protocol, CAST(CASE WHEN n % 6 = 4 THEN 60 + k ELSE 120 END AS INT) AS length FROM {EVENTS} e1"
_NOISE = ", ".join(f"md5(concat(CAST(n AS STRING), '-{i}'))" for i in range(24))
NOISE = f"SELECT n + 1 AS no, t AS timestamp, {_IP} AS src, concat('203.0.113.', CAST(k % 2 AS STRING)) AS dst, 'TCP' AS protocol, 384 AS length, 40000 AS src_port, 443 AS dst_port, CASE WHEN u < 4 THEN unhex(concat({_NOISE})) ELSE unhex(repeat('41', 384)) END AS bytes FROM {EVENTS} e1"
_COMMAND = "CASE e WHEN 'view' THEN concat('000100000006', '01', lpad(hex(k % 24), 2, '0'), '00000000') WHEN 'click' THEN concat('0564', repeat('00', 10), lpad(hex(k % 16), 2, '0'), '00') WHEN 'error' THEN concat('0300001F02F080', '32', repeat('00', 9), lpad(hex(k % 42), 2, '0')) ELSE concat('810A0011', '0100', '0000', '00', lpad(hex(k % 24), 2, '0')) END"
_PLANT = "CASE e WHEN 'view' THEN 502 WHEN 'click' THEN 20000 WHEN 'error' THEN 102 ELSE 47808 END"
COMMANDS = frames(EVENTS, _IP, "'10.0.1.1'", [*ether("0800"), *ipv4("60", "06", _IP4, "'0A000101'", total="80"), *tcp("40000", _PLANT, "1"), _COMMAND], "'TCP'", sport="40000", dport=_PLANT, where="e <> 'signup'")
#: Offers of views, each from one of two servers, and requests of all other events, each from one of a hundred clients.
LEASES = frames(EVENTS, _IP, "'255.255.255.255'", [*ether("0800", _MAC), *ipv4("8 + 253", "11", _IP4, "'FFFFFFFF'"), "CASE WHEN e = 'view' THEN '00430044' ELSE '00440043' END", hx("8 + 253", 4), "'0000'",
    "'01010600'", "repeat('00', 24)", f"concat({_MAC}, repeat('00', 10))", "repeat('00', 192)", "'63825363'", "CASE WHEN e = 'view' THEN concat('350102', '3604', '0A0000', CASE WHEN k % 9 = 0 THEN '02' ELSE '01' END, 'FF000000') ELSE concat('350101', '3D0700', '020000', lpad(hex(k), 6, '0'), 'FF') END"], "'DHCP'", sport="CASE WHEN e = 'view' THEN 67 ELSE 68 END", dport="CASE WHEN e = 'view' THEN 68 ELSE 67 END", vlan="u")
_HEAD = "concat('POST /a HTTP/1.1', chr(13), chr(10), CASE d % 7 WHEN 0 THEN concat('Content-Length: 5', chr(13), chr(10), 'Content-Length: 6') WHEN 1 THEN concat('Content-Length: 5', chr(13), chr(10), 'Transfer-Encoding: chunked') WHEN 2 THEN 'Content-Length : 5' WHEN 3 THEN 'Content-Length: five' WHEN 4 THEN 'Transfer-Encoding: chunked, gzip' WHEN 5 THEN 'Content-Length: 5' ELSE concat('User-Agent: agent', CAST(d % 3 AS STRING)) END, chr(13), chr(10), chr(13), chr(10))"
_HALF = f"CASE WHEN part = 0 THEN substring({_HEAD}, 1, 20) ELSE substring({_HEAD}, 21) END"
REQUESTS = frames(part(2), _SRC, "'10.0.1.1'", [*ether("0800"), *ipv4(f"20 + length({_HALF})", "06", _SRC4, "'0A000101'"), *tcp("20000 + d % 20000", "8080", "CASE WHEN part = 0 THEN 1 ELSE 21 END"), f"hex({_HALF})"], "'HTTP'", sport="20000 + d % 20000", dport="8080")
WHOLE = frames(part(1), _SRC, "'10.0.1.1'", [*ether("0800"), *ipv4(f"20 + length({_HEAD})", "06", _SRC4, "'0A000101'"), *tcp("20000 + d % 20000", "8080", "1"), f"hex({_HEAD})"], "'HTTP'", sport="20000 + d % 20000", dport="8080")
_RANDOM = "concat(md5(concat('a', CAST(d AS STRING))), md5(concat('b', CAST(d AS STRING))))"
_THIRD = "CASE d % 3 WHEN 0 THEN '0005' WHEN 1 THEN 'C030' ELSE '0A0A' END"
_CHOSEN = "CASE d % 4 WHEN 0 THEN '0005' WHEN 1 THEN '002F' ELSE 'C02F' END"
_EXTENSIONS = "concat('0000', '0012', '0010', '00', '000D', hex(concat('host', CAST(d % 6 + 1 AS STRING), '.example')), '0010', '0005', '0003', '02', hex('h2'), '000D', '0006', '0004', '04030804', '000A', '0006', '0004', '001D0017', '000B', '0002', '0100')"
_CLIENT_HELLO = f"concat('16030100', '6B', '01000067', '0303', {_RANDOM}, '00', '0006', '1301C02F', {_THIRD}, '0100', '0038', {_EXTENSIONS})"
_SERVER_HELLO = f"concat('16030300', '2C', '02000028', '0303', {_RANDOM}, '00', {_CHOSEN}, '00', '0000')"
#: Pairs of a client's and a server's hello.
HELLOS = frames(part(2), f"CASE WHEN part = 0 THEN {_SRC} ELSE '10.0.1.1' END", f"CASE WHEN part = 0 THEN '10.0.1.1' ELSE {_SRC} END", [*ether("0800"), *ipv4("132", "06", f"CASE WHEN part = 0 THEN {_SRC4} ELSE '0A000101' END", f"CASE WHEN part = 0 THEN '0A000101' ELSE {_SRC4} END"), *tcp("CASE WHEN part = 0 THEN 20000 + d % 20000 ELSE 443 END", "CASE WHEN part = 0 THEN 443 ELSE 20000 + d % 20000 END", "1"), f"CASE WHEN part = 0 THEN {_CLIENT_HELLO} ELSE {_SERVER_HELLO} END"], "'HTTPS'", sport="CASE WHEN part = 0 THEN 20000 + d % 20000 ELSE 443 END", dport="CASE WHEN part = 0 THEN 443 ELSE 20000 + d % 20000 END")
#: Alerts of clients.
ALERTS = frames(EVENTS, _IP, "'10.0.1.1'", [*ether("0800"), *ipv4("27", "06", _IP4, "'0A000101'"), *tcp("40000 + u", "443", "1"), "concat('1503030002', lpad(hex(k % 3), 2, '0'), lpad(hex(k), 2, '0'))"], "'HTTPS'", sport="40000 + u", dport="443")
#: The same hellos as bare records, which is what some rules look at.
RECORDS = f"SELECT no, timestamp, src, dst, protocol, src_port, dst_port, unhex(substring(hex(bytes), 109)) AS bytes FROM ({HELLOS}) h0"
_QUIC = "CASE WHEN k % 5 = 0 THEN concat('40', repeat('AB', 20)) ELSE concat(CASE k % 5 WHEN 1 THEN 'C0' WHEN 2 THEN 'D0' WHEN 3 THEN 'E0' ELSE 'F0' END, '00000001', '08', '00000000000000', lpad(hex(k % 20), 2, '0'), '04', '0A0B0C0D', '00') END"
QUIC = frames(EVENTS, _IP, "'10.0.1.1'", [*ether("0800"), *ipv4("8 + 24", "11", _IP4, "'0A000101'"), *udp("40000 + u", "443", 24), _QUIC], "'QUIC'", sport="40000 + u", dport="443")
#: First segments of sources with the lives and windows of some systems.
WINDOWS = frames(EVENTS, _IP, "'10.0.1.1'", [*ether("0800"), "'45000028000040'", "'00'", "CASE u WHEN 1 THEN '40' WHEN 2 THEN '80' WHEN 3 THEN 'FF' ELSE '3C' END", "'060000'", _IP4, "'0A000101'", *tcp("40000", "443", "1", "'02'", "CASE u WHEN 1 THEN 'FAF0' WHEN 2 THEN '2000' ELSE '1234' END")], "'TCP'", sport="40000", dport="443")


def made(sql: str):
    return lambda spark, sf_dir: spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def over(sql: str, operator):
    return lambda spark, sf_dir: operator(made(sql)(spark, sf_dir))


SHORT = ("no", "signature", "severity")
KEYS = "SELECT concat(md5(concat('a', CAST(s_suppkey AS STRING))), md5(concat('b', CAST(s_suppkey AS STRING)))) AS client_random FROM {supplier}"


def _inventory(spark, sf_dir):
    from netloom.operators import traffic

    ranges = spark.createDataFrame([("10.0.0.96/27", "NEAR", 1)], "cidr string, label string, priority long")
    names = made(NAMES)(spark, sf_dir).withColumn("info", F.concat(F.lit("Query h"), (F.col("no") % 3).cast("string"), F.lit(".org")))
    both = made(ARP)(spark, sf_dir).unionByName(names)
    return traffic.inventory(both, ranges).select("ip", F.array_join("hostnames", ",").alias("hostnames"), "mac", "place")


def _with_keys(spark, sf_dir):
    sessions = handshake.tls_sessions(made(HELLOS)(spark, sf_dir))
    return handshake.with_key_material(sessions, spark.sql(KEYS, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet")))


def _known_prints(spark, sf_dir):
    """Fingerprints of two kinds of client are known, as is one that nobody has."""
    hellos = handshake.hellos(made(HELLOS)(spark, sf_dir)).where("kind = 1").select("no", "ja4")
    known = spark.createDataFrame([("fingerprint", f"t12d03{n}h2_{c}_{e}", "high", "tool", "feed") for n, c, e in (("05", *_PRINTS[0]), ("05", *_PRINTS[1]), ("05", "0" * 12, "1" * 12))], "kind string, target string, severity string, label string, source string")
    return processes.fingerprint_reputation(hellos, known.withColumn("target", F.upper("target"))).select("no", "severity", "label")


def _sha12(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:12]


#: The hashed parts of the fingerprints of the clients of d % 3 = 0, 1, 2.
_PRINTS = [(_sha12(c), _sha12("000a,000b,000d_0403,0804")) for c in ("0005,1301,c02f", "1301,c02f,c030", "1301,c02f")]


def queries() -> dict:
    short = lambda f: lambda p: f(p).select(*SHORT)
    return {
        "d5_malformed_tcp": over(FLAGS, lambda p: signatures.malformed(p)),
        "d6_illegal_flags": over(FLAGS, lambda p: behaviour.illegal_flags(p)),
        "d9_stealth_probes": over(FLAGS, lambda p: behaviour.stealth_probe(p)),
        "d1_d2_malformed_fragments": over(FRAGMENTS, short(signatures.malformed)),
        "d3_conflicting_fragments": over(FRAGMENTS, short(fragments.conflicting_fragments)),
        "d4_fragment_flood": over(FLOOD, short(fragments.fragment_flood)),
        "d7_after_reset": over(SEGMENTS, lambda p: streams.after_reset(p)),
        "d8_conflicting_retransmission": over(SEGMENTS, short(fragments.conflicting_retransmission)),
        "r1_reassembled": over(SEGMENTS, lambda p: streams.reassembled(p).select("src", "src_port", "first_no", "offset", "no", F.decode("data", "UTF-8").alias("data"), "closed")),
        "r2_datagrams": over(FRAGMENTS6, lambda p: fragments.ipv6_datagrams(p).select("no", "outcome", "conflict", "fragments", F.hex("payload").alias("payload"))),
        "d31_conflicting_fragments6": over(FRAGMENTS6, lambda p: fragments.ipv6_fragment_alerts(fragments.ipv6_datagrams(p)).select(*SHORT)),
        "d32_rejected_fragments6": over(FLOOD6, lambda p: fragments.ipv6_fragment_alerts(fragments.ipv6_datagrams(p)).select(*SHORT)),
        "d53_exploits_in_fragments6": over(FRAGMENTS6, lambda p: fragments.exploits_in_fragments(fragments.ipv6_datagrams(p)).select(*SHORT)),
        "d_arp_changes": over(ARP, layer2.arp_changes),
        "d_v1_vlan_alerts": over(VLANS, lambda p: layer2.vlan_alerts(p, 50)),
        "d_v4_mac_on_vlans": over(VLANS, layer2.mac_on_vlans),
        "d19_topology_changes": over(BRIDGES, control.topology_changes),
        "d20_chassis_changes": over(BRIDGES, control.chassis_changes),
        "d14_extension_headers": over(EXTENDED, short(control.excessive_headers)),
        "d15_ipv6_control": over(NEIGHBOURS, lambda p: layer2.ipv6_control(p, 3).select(*SHORT, "correlation_key")),
        "x6_messages": over(NAMES, lambda p: dns.messages(p).select("no", "id", "response", "question")),
        "d36_dns_transactions": over(NAMES, dns.transactions),
        "j14_dns_latency": over(NAMES, lambda p: fingerprints.dns_latency(p).withColumn("latency_ms", F.round("latency_ms", 3))),
        "d_dns_tunnels": over(TUNNELS, lambda p: dns.tunnels(p).withColumns({c: F.round(c, 6) for c in ("max_entropy", "score")})),
        "d24_nxdomain": over(ANSWERED, behaviour.nxdomain_burst),
        "d25_large_txt": over(ANSWERED, behaviour.large_txt),
        "d13_icmp_sweep": over(ECHOES, behaviour.icmp_sweep),
        "d21_beacons": over(BEACONS, behaviour.beacons),
        "d23_outbound_entropy": over(NOISE, lambda p: behaviour.outbound_entropy(p, 5000)),
        "d34_industrial": over(COMMANDS, signatures.industrial),
        "d29_dhcp_servers": over(LEASES, control.dhcp_servers),
        "d30_dhcp_clients": over(LEASES, lambda p: control.dhcp_clients(p, 5)),
        "d33_smuggling": over(REQUESTS, control.smuggling),
        "d_http_records": over(WHOLE, signatures.http_records),
        "t1_hellos": over(HELLOS, lambda p: handshake.hellos(p).select("no", "kind", "version", "random", "sni", "alpn", F.array_join("ciphers", "-").alias("ciphers"), F.array_join("extensions", "-").alias("extensions"), F.array_join("signatures", "-").alias("signatures"), "ja4")),
        "t5_fingerprints": over(HELLOS, lambda p: fingerprints.flow_fingerprints(p).select("a_ip", "a_port", "b_port", "ja3", "ja3s")),
        "t6_tls_sessions": over(HELLOS, lambda p: handshake.tls_sessions(p).select("a_ip", "a_port", "b_ip", "b_port", "version", "random", "sni", "alpn", "server_cipher", "first_seen", "last_seen")),
        "j8_key_material": lambda spark, sf_dir: _with_keys(spark, sf_dir).groupBy("has_keys").agg(F.count("*").alias("sessions")),
        "j7_fingerprint_reputation": _known_prints,
        "t6_session_alerts": over(ALERTS, lambda p: handshake.session_alerts(p).select("a_ip", "a_port", "alert_level", "alert_description")),
        "a5_inventory": _inventory,
        "t7_weak_sessions": over(HELLOS, lambda p: fingerprints.weak_sessions(handshake.tls_sessions(p)).groupBy("sni", "cipher").agg(F.count("*").alias("sessions"))),
        "a26_session_totals": lambda spark, sf_dir: fingerprints.session_totals(_with_keys(spark, sf_dir)),
        "d_tls_weak": over(RECORDS, short(signatures.weak_tls)),
        "t4_quic": over(QUIC, lambda p: handshake.quic(p).select("no", "packet_type", "version", "destination_id", "source_id", "ratq")),
        "a18_quic_connections": over(QUIC, lambda p: handshake.quic_connections(handshake.quic(p)).withColumn("packet_types", F.array_join("packet_types", ","))),
        "d_os_guesses": over(WINDOWS, fingerprints.system_guesses),
        "d12_syn_flood": lambda spark, sf_dir: detect.syn_flood(packets(spark, sf_dir).withColumn("timestamp", F.col("timestamp") / 4), 3),
        "d_synf_bursts": lambda spark, sf_dir: fingerprints.syn_bursts(packets(spark, sf_dir), 12),
        "w4_strobes": lambda spark, sf_dir: fingerprints.strobes(packets(spark, sf_dir), 1, 2.0),
    }


def _in(table: str, sql: str) -> str:
    return f"WITH p AS ({table.replace('{events}', 'events')}), {sql}"


def oracle_sql() -> dict[str, str]:
    from netloom.plans.catalogue import _latch_sql

    ev = EVENTS.replace("{events}", "events")
    of = lambda size: part(size).replace("{events}", "events")
    port = "CAST(dst_port AS STRING)"
    pair = "concat_ws('|', src, dst)"
    alert = lambda source, name, severity, detail, key: f"no, timestamp, '{source}' AS source, '{name}' AS signature, '{severity}' AS severity, {detail} AS detail, {key} AS correlation_key"
    flags = f"WITH p AS ({SQL.replace('{events}', 'events')})"
    found = "concat_ws(' ', {0}, 'from', src, 'to', dst)"
    mac = "concat('02:00:00:00:00:0', u)"
    session = lambda k, gap: f"sum(new) OVER (PARTITION BY {k} ORDER BY t, n ROWS UNBOUNDED PRECEDING)"
    hello = f"SELECT *, concat('10.0.0.', d % 6 + 1) AS client, 20000 + d % 20000 AS port, concat(md5(concat('a', d)), md5(concat('b', d))) AS random, concat('host', d % 6 + 1, '.example') AS sni FROM {of(2)} o"
    third = lambda *x: f"CASE d % 3 WHEN 0 THEN '{x[0]}' WHEN 1 THEN '{x[1]}' ELSE '{x[2]}' END"
    chosen = "CASE d % 4 WHEN 0 THEN 5 WHEN 1 THEN 47 ELSE 49199 END"
    # a flow (source, port) comes again after 20000 pairs: what is said is the latest pair's
    flow = f"SELECT client AS a_ip, port AS a_port, '10.0.1.1' AS b_ip, 443 AS b_port, arg_max(771, d) AS version, arg_max(random, d) AS random, arg_max(sni, d) AS sni, 'h2' AS alpn, arg_max({chosen}, d) FILTER (part = 1) AS server_cipher, min(t) AS first_seen, max(t) AS last_seen, min(d) AS first_d FROM ({hello}) h GROUP BY client, port"
    flow = f"SELECT * REPLACE (arg AS server_cipher) FROM (SELECT *, server_cipher AS arg FROM ({flow}) q0) q1"
    keyed = f"SELECT s.*, random IN (SELECT concat(md5(concat('a', s_suppkey)), md5(concat('b', s_suppkey))) FROM supplier) AS has_keys FROM ({flow}) s"
    modbus = " ".join(f"WHEN k % 24 = {c} THEN '{w}'" for c, w in signatures.MODBUS.items())
    dnp3 = " ".join(f"WHEN k % 16 = {c} THEN '{w}'" for c, w in signatures.DNP3.items())
    s7 = " ".join(f"WHEN k % 42 = {c} THEN '{w}'" for c, w in signatures.S7.items())
    bacnet = " ".join(f"WHEN k % 24 = {c} THEN '{w}'" for c, w in signatures.BACNET.items())
    critical = "((e = 'click' AND k % 16 IN (4, 5, 6, 13, 14)) OR (e = 'error' AND k % 42 IN (40, 41)) OR (e = 'purchase' AND k % 24 IN (17, 20)))"
    reason = "CASE d % 7 WHEN 0 THEN 'conflicting Content-Length values' WHEN 1 THEN 'both Transfer-Encoding and Content-Length are present' WHEN 2 THEN 'whitespace-obfuscated content-length header' WHEN 3 THEN 'invalid Content-Length value' WHEN 4 THEN 'chunked transfer coding is not final' END"
    quic = "CASE k % 5 WHEN 1 THEN 'Initial' WHEN 2 THEN '0-RTT' WHEN 3 THEN 'Handshake' WHEN 4 THEN 'Retry' ELSE '1-RTT' END"
    long = "k % 5 <> 0"
    connection = "lower(concat('00000000000000', lpad(hex(k % 20), 2, '0')))"
    beat = "count(gap) OVER i + 1 >= 7 AND timestamp - min(timestamp) OVER l >= 30 AND avg(gap) OVER i >= 1 AND stddev_pop(gap) OVER i <= 0.15 * avg(gap) OVER i AND stddev_pop(length) OVER l <= 0.10 * avg(length) OVER l"
    out = {
        "d5_malformed_tcp": f"{flags} SELECT {alert('IDS', 'Malformed TCP header', 'HIGH', found.format('signature'), 'concat_ws(chr(124), src, dst, ' + port + ')')} FROM p WHERE no % 17 = 0",
        "d6_illegal_flags": f"{flags} SELECT {alert('IDS', 'Illegal TCP flag combination', 'HIGH', 'concat_ws(chr(32), CASE no % 13 WHEN 0 THEN ' + repr('SYN FIN') + ' ELSE ' + repr('SYN RST') + ' END, src, ' + repr('->') + ', dst)', pair)} FROM p WHERE no % 13 IN (0, 4)",
        "d9_stealth_probes": f"{flags} SELECT {alert('IDS', 'TCP stealth scan probe', 'MED', 'concat_ws(chr(32), CASE no % 13 WHEN 1 THEN ' + repr('NULL') + ' WHEN 2 THEN ' + repr('FIN') + ' ELSE ' + repr('Xmas') + ' END, ' + repr('probe') + ', src, ' + repr('->') + ', dst)', pair)} FROM p WHERE no % 13 IN (1, 2, 3)",
        "d1_d2_malformed_fragments": f"SELECT n + 1 AS no, unnest(CASE WHEN d % 5 = 3 THEN ['Tiny IPv4 fragment'] ELSE ['Malformed IPv4 fragment', 'Tiny IPv4 fragment'] END) AS signature, 'HIGH' AS severity FROM {of(4)} f WHERE (d % 5 = 3 AND part = 0) OR (d % 5 = 4 AND part = 2)",
        "d3_conflicting_fragments": f"SELECT n + 1 AS no, 'Conflicting IPv4 fragments' AS signature, 'CRIT' AS severity FROM {of(4)} f WHERE d % 5 = 1 AND part = 3",
        "d4_fragment_flood": f"SELECT n + 1 AS no, 'IPv4 fragment flood' AS signature, 'HIGH' AS severity FROM {of(100)} f WHERE part = 64",
        "d7_after_reset": f"SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, 'TCP payload after reset' AS signature, 'HIGH' AS severity, concat('10.0.0.', d % 6 + 1, ' -> 10.0.1.1') AS detail, concat('10.0.0.', d % 6 + 1, ':', 20000 + d % 20000, '|10.0.1.1:80') AS correlation_key FROM {of(4)} f WHERE d % 3 = 2 AND part = 3",
        "d8_conflicting_retransmission": f"SELECT n + 1 AS no, 'Conflicting TCP retransmission' AS signature, 'CRIT' AS severity FROM {of(4)} f WHERE d % 3 = 1 AND part = 2",
        "r1_reassembled": f"""SELECT concat('10.0.0.', d % 6 + 1) AS src, 20000 + d % 20000 AS src_port, d * 4 + 1 AS first_no, CASE WHEN part = 1 THEN 0 WHEN part = 3 AND d % 3 = 1 THEN 6 ELSE 5 END AS "offset", n + 1 AS no,
            CASE WHEN part = 1 THEN 'HELLO' WHEN part = 2 THEN CASE WHEN d % 3 = 1 THEN 'X' ELSE '' END WHEN d % 3 = 1 THEN 'ORLD' ELSE 'WORLD' END AS data, part = 2 AND d % 3 = 2 AS closed FROM {of(4)} f WHERE part IN (1, 3) OR (part = 2 AND d % 3 > 0)""",
        "r2_datagrams": f"""SELECT n + 1 AS no, CASE WHEN d % 4 < 2 AND part = 2 THEN 'complete' ELSE 'pending' END AS outcome, d % 4 = 2 AND part = 1 AS conflict, CASE WHEN d % 4 = 3 AND part > 0 THEN part ELSE part + 1 END AS fragments,
            CASE WHEN d % 4 < 2 AND part = 2 THEN concat('9C400050247B6A6E', hex('di:ldap://x/aaaa')) END AS payload FROM {of(3)} f""",
        "d31_conflicting_fragments6": f"SELECT n + 1 AS no, 'Conflicting IPv6 fragments' AS signature, 'CRIT' AS severity FROM {of(3)} f WHERE d % 4 = 2 AND part = 1",
        "d32_rejected_fragments6": f"SELECT n + 1 AS no, 'IPv6 fragment reassembly rejected' AS signature, 'HIGH' AS severity FROM {of(200)} f WHERE part >= 128",
        "d53_exploits_in_fragments6": f"SELECT n + 1 AS no, 'Log4Shell (CVE-2021-44228)' AS signature, 'CRIT' AS severity FROM {of(3)} f WHERE d % 4 < 2 AND part = 2",
        "d_arp_changes": f"SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, 'ARP binding changed' AS signature, 'HIGH' AS severity, concat('10.0.0.', u, ' moved from ', was, ' to ', mac) AS detail, concat('10.0.0.', u) AS correlation_key FROM (SELECT *, lag(mac) OVER (PARTITION BY u ORDER BY n) AS was FROM (SELECT *, CASE WHEN k % 10 = 0 THEN '02:00:00:00:00:ff' ELSE {mac} END AS mac FROM {ev} e) a) b WHERE was <> mac",
        "d_v1_vlan_alerts": f"""WITH RECURSIVE v AS (SELECT *, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 20 END AS vlan FROM {ev} e), a AS (
            SELECT n + 1 AS no, t AS timestamp, 'DTP' AS signature, 'CRIT' AS severity, concat('DTP frame from ', {mac}) AS detail, concat('DTP:', {mac}) AS correlation_key FROM v WHERE k % 13 = 0
            UNION ALL SELECT n + 1, t, 'VLAN-Hop', 'CRIT', concat_ws(' ', 'double tag 100', vlan, concat('10.0.0.', u)), concat('QINQ:100:', vlan) FROM v WHERE k % 7 = 0 AND vlan IS NOT NULL
            UNION ALL SELECT n + 1, t, 'Native-VLAN', 'WARN', concat('VLAN 1 used by 10.0.0.', u), 'NATIVE_VLAN1' FROM v WHERE vlan = 1
            UNION ALL SELECT n + 1, t, 'PCP-Abuse', 'WARN', concat_ws(' ', 'priority 7 from', concat('10.0.0.', u), vlan), concat('PCP7:10.0.0.', u, ':', vlan) FROM v WHERE k % 9 = 0 AND vlan IS NOT NULL),
            r AS (SELECT correlation_key, min(no) AS no FROM a GROUP BY 1 UNION ALL SELECT correlation_key, nx FROM (SELECT r.correlation_key, (SELECT min(a.no) FROM a WHERE a.correlation_key = r.correlation_key AND a.no >= r.no + 50) AS nx FROM r) z WHERE nx IS NOT NULL)
            SELECT no, timestamp, 'VLAN' AS source, signature, severity, detail, correlation_key FROM a JOIN r USING (correlation_key, no)""",
        "d_v4_mac_on_vlans": f"""WITH f AS (SELECT u, CASE k % 5 WHEN 0 THEN 1 ELSE 20 END AS vlan, min(n) AS n, arg_min(t, n) AS t FROM {ev} e WHERE k % 5 < 2 GROUP BY ALL)
            SELECT max(n) + 1 AS no, arg_max(t, n) AS timestamp, 'VLAN' AS source, 'MAC-VLAN-Cross' AS signature, 'WARN' AS severity, concat('MAC ', {mac}, ' on VLANs 1,20') AS detail, concat('MAC_CROSS:', {mac}) AS correlation_key FROM f GROUP BY u HAVING count(*) = 2""",
        "d19_topology_changes": f"SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, 'STP topology change' AS signature, 'MED' AS severity, concat('from ', {mac}) AS detail, {mac} AS correlation_key FROM {ev} e WHERE e IN ('view', 'click') AND k % 7 = 0",
        "d20_chassis_changes": f"SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, 'LLDP chassis identity changed' AS signature, 'HIGH' AS severity, concat({mac}, ' moved from ', was, ' to ', id) AS detail, {mac} AS correlation_key FROM (SELECT *, lag(id) OVER (PARTITION BY u ORDER BY n) AS was FROM (SELECT *, concat('0402000000', CASE WHEN k % 8 = 0 THEN '00ff' ELSE concat('000', u) END) AS id FROM {ev} e WHERE e NOT IN ('view', 'click')) a) b WHERE was <> id",
        "d14_extension_headers": f"SELECT n + 1 AS no, 'Excessive IPv6 extension headers' AS signature, 'HIGH' AS severity FROM {ev} e WHERE k % 12 > 8",
        "d15_ipv6_control": f"""WITH v AS (SELECT *, e IN ('view', 'click') AS ra FROM {ev} e), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY n) > 1 THEN 1 ELSE 0 END AS new FROM v WHERE ra AND k % 6 = 0), s AS (SELECT *, {session('u', 1)} AS s FROM g),
            h AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY n) > 1 THEN 1 ELSE 0 END AS new, count(*) OVER (PARTITION BY u ORDER BY t RANGE BETWEEN 1.0::DOUBLE PRECEDING AND CURRENT ROW) AS hits FROM v WHERE ra), hs AS (SELECT *, {session('u', 1)} AS s FROM h),
            m AS (SELECT *, CASE WHEN k % 7 = 0 THEN 255 ELSE u END AS link FROM v WHERE NOT ra), l AS (SELECT *, lag(link) OVER (PARTITION BY u ORDER BY n) AS was FROM m)
            SELECT n + 1 AS no, 'Invalid IPv6 neighbor discovery hop limit' AS signature, 'CRIT' AS severity, {mac} AS correlation_key FROM v WHERE k % 10 = 0
            UNION ALL SELECT min(n) + 1, 'Invalid IPv6 router advertisement source', 'CRIT', {mac} FROM s GROUP BY u, s UNION ALL SELECT min(n) + 1, 'IPv6 router advertisement flood', 'CRIT', {mac} FROM hs WHERE hits >= 3 GROUP BY u, s
            UNION ALL SELECT n + 1, 'IPv6 neighbor binding changed', 'CRIT', concat(repeat('0', 30), '0', u) FROM l WHERE was <> link""",
        "x6_messages": f"SELECT n + 1 AS no, CAST({_ID} AS INT) AS id, NOT {_ASKS} AS response, concat({_NAME}, '.example.com/1/1') AS question FROM {of(4)} f",
        "d36_dns_transactions": f"""SELECT n + 1 AS no, t AS timestamp, 'DNS' AS source, CASE d % 6 WHEN 1 THEN 'Unexpected DNS responder' WHEN 2 THEN 'DNS transaction question mismatch' WHEN 3 THEN 'Unsolicited DNS response' ELSE 'Conflicting DNS responses' END AS signature,
            CASE d % 6 WHEN 3 THEN 'HIGH' ELSE 'CRIT' END AS severity, CASE d % 6 WHEN 1 THEN 'asked 8.8.8.8, answered by 9.9.9.9' WHEN 2 THEN concat('a', d % 7, '.example.com/1/1 became b', d % 7, '.example.com/1/1') WHEN 3 THEN concat('8.8.8.8 answers 10.0.0.', d % 6 + 1) ELSE 'replies from 8.8.8.8 and 9.9.9.9' END AS detail,
            concat('10.0.0.', d % 6 + 1, '|', 30000 + d % 1000, '|', {_ID}) AS correlation_key FROM {of(4)} f WHERE (d % 6 IN (1, 2, 3) AND part = 1) OR (d % 6 = 4 AND part = 2)""",
        "j14_dns_latency": f"SELECT n + 1 AS no, t AS timestamp, 'dns' AS kind, '8.8.8.8' AS target, 25.0::DOUBLE AS latency_ms FROM {of(4)} f WHERE part = 1 AND d % 6 IN (0, 2, 4, 5)",
        "d_dns_tunnels": f"""WITH q AS (SELECT concat('t', u, '.net') AS apex, concat('x', substring(md5(CAST(n % 500 AS VARCHAR)), 1, CAST(4 + k % 28 AS INT))) AS sub FROM {ev} e), s AS (SELECT apex, sub, count(*) AS n, list_entropy(string_split(sub, '')) AS h FROM q GROUP BY ALL),
            a AS (SELECT apex, CAST(sum(n) AS BIGINT) AS queries, max(h) AS max_entropy, max(length(sub)) AS max_length, count(*) AS subdomains FROM s GROUP BY apex), z AS (SELECT *, queries / 10 + max_entropy + max_length / 10 AS raw FROM a)
            SELECT apex, queries, round(max_entropy, 6) AS max_entropy, max_length, subdomains, round(raw, 6) AS score, CASE WHEN raw > 12 THEN 'HIGH' WHEN raw >= 8 THEN 'MED' END AS severity, subdomains > 20 OR max_entropy > 3.5 OR max_length > 30 AS suspicious FROM z""",
        "d25_large_txt": f"SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, 'Oversized DNS TXT traffic' AS signature, 'MED' AS severity, concat('8.8.8.8 -> 10.0.0.', u) AS detail, concat('8.8.8.8|10.0.0.', u) AS correlation_key FROM {ev} e WHERE e = 'view' AND 400 + k * 2 > 512",
        "d21_beacons": _in(BEACONS, f"""g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY src ORDER BY timestamp, no) > 0 THEN timestamp - lag(timestamp) OVER (PARTITION BY src ORDER BY timestamp, no) END AS gap FROM p), h AS (SELECT *, {beat} AS hit FROM g
            WINDOW l AS (PARTITION BY src ORDER BY timestamp, no ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), i AS (PARTITION BY src ORDER BY timestamp, no ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))
            SELECT {alert('IDS', 'Periodic command-and-control beacon', 'HIGH', "concat(src, ' -> 203.0.113.7:443')", "concat(src, '|40000|203.0.113.7|443|HTTPS')")} FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY timestamp, no) AS r FROM h WHERE hit) z WHERE r = 1"""),
        "d23_outbound_entropy": f"""SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, 'High-entropy outbound transfer' AS signature, 'HIGH' AS severity, concat('10.0.0.', u, ' sent ', sent, ' high-entropy bytes') AS detail, concat('10.0.0.', u, '|203.0.113.', k % 2, '|443|TCP') AS correlation_key FROM (
            SELECT *, row_number() OVER (PARTITION BY u, k % 2 ORDER BY n) AS r, 384 * row_number() OVER (PARTITION BY u, k % 2 ORDER BY n) AS sent FROM {ev} e WHERE u < 4) a WHERE r = 14""",
        "d34_industrial": f"""SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, CASE WHEN {critical} THEN 'Critical industrial control command' ELSE 'Industrial state-changing command' END AS signature, CASE WHEN {critical} THEN 'CRIT' ELSE 'HIGH' END AS severity,
            concat_ws(' ', CASE e WHEN 'view' THEN 'Modbus' WHEN 'click' THEN 'DNP3' WHEN 'error' THEN 'S7comm' ELSE 'BACnet' END, op, 'from', concat('10.0.0.', u)) AS detail, concat('10.0.0.', u, '|10.0.1.1|', op) AS correlation_key FROM (
            SELECT *, CASE WHEN e = 'view' THEN CASE {modbus} END WHEN e = 'click' THEN CASE {dnp3} END WHEN e = 'error' THEN CASE {s7} END WHEN e = 'purchase' THEN CASE {bacnet} END END AS op FROM {ev} e) a WHERE op IS NOT NULL""",
        "d29_dhcp_servers": f"""WITH s AS (SELECT u, k % 9 = 0 AS odd, min(n) AS n, arg_min(t, n) AS t FROM {ev} e WHERE e = 'view' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n) AS place FROM s)
            SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, 'DHCP server identity changed' AS signature, 'HIGH' AS severity, concat('new server on VLAN ', u, ' from 10.0.0.', u) AS detail, concat(u, '|0a00000', CASE WHEN odd THEN 2 ELSE 1 END, '02000000000', u) AS correlation_key FROM r WHERE place > 1""",
        "d33_smuggling": f"SELECT n + 1 AS no, t AS timestamp, 'IDS' AS source, 'HTTP request smuggling ambiguity' AS signature, 'CRIT' AS severity, concat({reason}, ' from 10.0.0.', d % 6 + 1, ' to 10.0.1.1:8080') AS detail, concat('10.0.0.', d % 6 + 1, '|', 20000 + d % 20000, '|10.0.1.1|8080') AS correlation_key FROM {of(2)} f WHERE part = 1 AND d % 7 < 5",
        "d_http_records": f"SELECT n + 1 AS no, concat('10.0.0.', d % 6 + 1) AS src, '10.0.1.1' AS dst, 8080 AS port, 'POST' AS method, '/a' AS path, CASE WHEN d % 7 = 6 THEN concat('agent', d % 3) END AS user_agent, CAST(NULL AS INT) AS response_code FROM {of(1)} f",
        "t1_hellos": f"""SELECT n + 1 AS no, part + 1 AS kind, 771 AS version, random, CASE WHEN part = 0 THEN sni END AS sni, CASE WHEN part = 0 THEN 'h2' END AS alpn, CASE WHEN part = 1 THEN CAST({chosen} AS VARCHAR) ELSE concat('4865-49199', {third('-5', '-49200', '')}) END AS ciphers,
            CASE WHEN part = 0 THEN '0-16-13-10-11' ELSE '' END AS extensions, CASE WHEN part = 0 THEN '1027-2052' ELSE '' END AS signatures, CASE WHEN part = 0 THEN concat('t12d', {third('03', '03', '02')}, '05h2_', {third(*(c for c, _ in _PRINTS))}, '_', '{_PRINTS[0][1]}') END AS ja4 FROM ({hello}) h""",
        "t5_fingerprints": f"SELECT client AS a_ip, port AS a_port, 443 AS b_port, arg_min(md5(concat('771,4865-49199', {third('-5', '-49200', '')}, ',0-16-13-10-11,29-23,0')), d) AS ja3, arg_min(md5(concat('771,', {chosen}, ',')), d) FILTER (part = 1) AS ja3s FROM ({hello}) h GROUP BY client, port",
        "t6_tls_sessions": f"SELECT * EXCLUDE (first_d, arg) FROM ({flow}) s",
        "j8_key_material": f"SELECT has_keys, count(*) AS sessions FROM ({keyed}) k GROUP BY 1",
        "j7_fingerprint_reputation": f"SELECT n + 1 AS no, 'high' AS severity, 'tool' AS label FROM {of(2)} f WHERE part = 0 AND d % 3 < 2",
        "t6_session_alerts": f"SELECT concat('10.0.0.', u) AS a_ip, 40000 + u AS a_port, arg_max(k % 3, n) AS alert_level, arg_max(k, n) AS alert_description FROM {ev} e GROUP BY u",
        "a5_inventory": f"""WITH a AS (SELECT concat('10.0.0.', u) AS ip, arg_max(CASE WHEN k % 10 = 0 THEN '02:00:00:00:00:ff' ELSE {mac} END, n) AS mac FROM {ev} e GROUP BY u), f AS (SELECT n, CASE WHEN {_ASKS} THEN {_CLIENT} ELSE {_SERVER} END AS src, CASE WHEN {_ASKS} THEN {_SERVER} ELSE {_CLIENT} END AS dst FROM {of(4)} q),
            h AS (SELECT src AS ip, array_to_string(list_sort(list(DISTINCT concat('h', (n + 1) % 3, '.org'))), ',') AS hostnames FROM f GROUP BY src), i AS (SELECT ip FROM a UNION SELECT '10.0.0.99' UNION SELECT src FROM f UNION SELECT dst FROM f)
            SELECT i.ip, h.hostnames, a.mac, CASE WHEN starts_with(i.ip, '10.') THEN 'LAN' ELSE '??' END AS place FROM i LEFT JOIN a USING (ip) LEFT JOIN h USING (ip)""",
        "t7_weak_sessions": f"SELECT sni, CASE server_cipher WHEN 5 THEN 'RC4-SHA (WEAK)' ELSE 'unknown' END AS cipher, count(*) AS sessions FROM ({flow}) s WHERE server_cipher IN (5, 47) GROUP BY 1, 2",
        "a26_session_totals": f"SELECT count(*) AS sessions, count(*) AS named, count(*) FILTER (server_cipher IN (5, 47)) AS weak, count(*) FILTER (has_keys) AS with_keys FROM ({keyed}) k",
        "d_tls_weak": f"SELECT n + 1 AS no, unnest(CASE WHEN d % 3 = 0 OR has THEN ['TLS 1.0', 'RC4 Cipher Suite'] ELSE ['TLS 1.0'] END) AS signature, 'MED' AS severity FROM (SELECT *, true AS has FROM {of(2)} o) f WHERE part = 0",
        "t4_quic": f"""SELECT n + 1 AS no, {quic} AS packet_type, CASE WHEN {long} THEN 1 END AS version, CASE WHEN {long} THEN {connection} ELSE '' END AS destination_id, CASE WHEN {long} THEN '0a0b0c0d' ELSE '' END AS source_id,
            concat('ratq1_', substring(sha256(CASE WHEN {long} THEN concat('00000001|', {quic}, '|8|4|1') ELSE 'short|1-RTT|0|0|1' END), 1, 12)) AS ratq FROM {ev} e""",
        "a18_quic_connections": f"SELECT {connection} AS destination_id, count(*) AS packets, count(*) * 62 AS bytes, array_to_string(list_sort(list(DISTINCT {quic})), ',') AS packet_types, min(t) AS first_seen, max(t) AS last_seen, count(DISTINCT u) + 1 AS addresses, count(DISTINCT u) + 1 > 2 AS migrated FROM {ev} e WHERE {long} GROUP BY 1",
        "d_os_guesses": f"SELECT concat('10.0.0.', u) AS src, CASE u WHEN 1 THEN 'Linux 4.x+' WHEN 2 THEN 'Windows XP/2003' ELSE 'Network Device (Cisco/etc)' END AS os, CASE u WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 255 END AS ttl, CASE u WHEN 1 THEN 64240 WHEN 2 THEN 8192 ELSE 4660 END AS window, min(n) + 1 AS no FROM {ev} e WHERE u < 4 GROUP BY u",
        "d_synf_bursts": f"{flags} SELECT DISTINCT src, true AS tcp_anomaly FROM (SELECT src, count(*) OVER (PARTITION BY src ORDER BY timestamp RANGE BETWEEN 1.0::DOUBLE PRECEDING AND CURRENT ROW) AS hits FROM p) h WHERE hits >= 12",
        "w4_strobes": f"""{flags}, k AS (SELECT *, (src, src_port) <= (dst, dst_port) AS fwd FROM p), e AS (SELECT CASE WHEN fwd THEN src ELSE dst END AS a_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS a_port, CASE WHEN fwd THEN dst ELSE src END AS b_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS b_port, protocol, vlan_id, timestamp FROM k),
            m AS (SELECT *, max(timestamp) OVER (PARTITION BY a_ip, a_port, b_ip, b_port, protocol, vlan_id) AS last FROM e) SELECT a_ip, a_port, b_ip, b_port, protocol, vlan_id, count(*) > 1 AS strobe FROM m WHERE last - timestamp <= 2 GROUP BY ALL""",
    }
    bursts = {
        "d24_nxdomain": (ANSWERED, "contains(info, 'NXDOMAIN')", "dst", "count(*)", 20, 30, "dst", "DNS NXDOMAIN burst", "MED", "concat_ws(' ', dst, 'received NXDOMAIN replies')", "dst"),
        "d13_icmp_sweep": (ECHOES, "protocol = 'ICMP' AND info = 'Echo request'", "src", "count(DISTINCT dst)", 12, 15, "src", "ICMP address sweep", "MED", "concat_ws(' ', src, 'probes many hosts')", "src"),
        "d30_dhcp_clients": (LEASES, "dst_port = 67", "vlan_id", "count(DISTINCT client)", 5, 10, "vlan_id", "DHCP client identity burst", "CRIT", "concat('many clients on VLAN ', vlan_id)", "CAST(vlan_id AS VARCHAR)"),
        "d12_syn_flood": (f"SELECT * REPLACE (timestamp / 4 AS timestamp) FROM ({SQL}) s0", "true", "dst, dst_port", "count(*)", 3, 1, "dst, dst_port", "SYN flood", "CRIT", f"concat_ws(':', dst, {port})", f"concat_ws('|', dst, {port})"),
    }
    for name, (table, *rest) in bursts.items():
        sql = _latch_sql(*rest)
        table = table.replace("{events}", "events")
        if name == "d30_dhcp_clients":  # the client is the event's number
            table = f"SELECT q.*, k AS client FROM ({table}) q JOIN {ev} e ON q.no = e.n + 1"
        out[name] = f"WITH p AS ({table})" + sql[len("WITH p AS (") + len(SQL.replace("{events}", "events")) + 1 :]
    return out
