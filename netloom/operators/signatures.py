"""Byte signatures of single packets: one pass over the rows, no shuffle; each rule that holds gives an alert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.functions.packet import _sure, contains
from netloom.operators.decode import _kept
from netloom.operators.fields import _number, layout

#: Ports, byte patterns and words that the rules look for.
WEB = (80, 443, 8080)
SMB_EXPLOIT = bytes([0, 0, 0, 0, 0, 0x54, 0, 0, 0])
TPKT = bytes([3, 0, 0])
WPAD = bytes([0, 0x20, 0x43, 0x4B])
SPOOLER, DRIVER = bytes([0x1C, 0]), b"ndrv"
SHA1_OID = bytes([0x2A, 0x86, 0x48, 0x86, 0xF7, 0x0D, 1, 1, 5])
TLS10, SSL30 = bytes([0x16, 3, 1]), bytes([0x16, 3, 0])
RC4 = (bytes([0, 5]), bytes([0, 0x0A]))
SENSITIVE_PATHS = ("/admin", "/login", "/passwd", "/password", "/config", "/wp-admin")
SQL_WORDS = ("' or 1=1", "'; drop table", "union select")


def _has(data: bytes) -> Column:
    return _sure(F.contains(F.col("bytes"), F.lit(data).cast("binary")))


def _says(text: str, column: str = "_low") -> Column:
    return _sure(F.contains(F.col(column), F.lit(text.lower())))


def _begins(data: bytes) -> Column:
    return _sure(F.substring("bytes", 1, len(data)) == F.lit(data).cast("binary"))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _port(*ports: int, either: bool = False) -> Column:
    to = _sure(F.col("dst_port").isin(*ports))
    return to | _sure(F.col("src_port").isin(*ports)) if either else to


def _readable(packets: DataFrame) -> DataFrame:
    """packets with _text (a character a byte), its lower case, and the readable part after 54 bytes of headers."""
    rows = packets.withColumn("_text", F.decode("bytes", "ISO-8859-1"))
    return rows.withColumns({"_low": F.lower("_text"), "_body": F.expr("substring(_text, 55)")})


def _found(rows: DataFrame, source: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    hit = lambda name, severity, condition: F.when(condition, F.struct(F.lit(name).alias("signature"), F.lit(severity).alias("severity")))
    out = rows.select("no", "timestamp", F.lit(source).alias("source"), "src", "dst", "dst_port", F.inline(F.array_compact(F.array(*(hit(*r) for r in rules)))))
    return out.select("no", "timestamp", "source", "signature", "severity", F.concat_ws(" ", "signature", F.lit("from"), "src", F.lit("to"), "dst").alias("detail"), F.concat_ws("|", "src", "dst", F.col("dst_port").cast("string")).alias("correlation_key"))


def exploits(packets: DataFrame) -> DataFrame:
    """Known exploits by port and bytes. Every rule that a packet meets gives a row."""
    size = F.length("bytes")
    named = lambda *names: _any(contains("protocol", n) for n in names)
    claimed = _number(F.lit(3), 2)
    kerberos = _says("kerberos") | contains("info", "kerberos")
    rules = [
        ("EternalBlue", "CRIT", _port(445) & (_has(SMB_EXPLOIT) | _says("smbr"))),
        ("BlueKeep (CVE-2019-0708)", "CRIT", _port(3389) & (size > 100) & _has(TPKT)),
        ("Log4Shell (CVE-2021-44228)", "CRIT", _says("${jndi:")),
        ("Shellcode NOP sled", "HIGH", _has(b"\x90" * 16)),
        ("LLMNR Poisoning", "MED", (_port(5355) | _sure(F.col("dst") == "224.0.0.252")) & named("udp", "llmnr")),
        ("NBNS WPAD Poisoning", "MED", _port(137) & named("udp", "nbns") & _has(WPAD)),
        ("Directory Traversal", "HIGH", _port(*WEB) & _sure(F.regexp_count("_text", F.lit(r"\.\./")) >= 5)),
        ("SQL Injection Probe", "HIGH", _port(*WEB, 3000, 8000) & _any(_says(w) for w in SQL_WORDS)),
        ("XSS Probe", "MED", _says("<script>") | _says("javascript:")),
        ("Heartbleed (CVE-2014-0160)", "CRIT", _port(443, either=True) & (size >= 7) & _begins(bytes([0x18, 3])) & _sure(claimed > size + 64)),
        ("PrintNightmare (CVE-2021-1675)", "CRIT", _port(445, 135) & _has(SPOOLER) & (_says("spoolss") | _has(DRIVER))),
        ("Pass-the-Hash (suspected)", "HIGH", _port(445) & _says("ntlmssp") & ~kerberos),
        ("Log4Shell via DNS (CVE-2021-44228)", "CRIT", (_port(53, either=True) | named("dns")) & contains("info", "jndi")),
    ]
    return _found(_readable(packets), "IDS", rules)


def exposures(packets: DataFrame) -> DataFrame:
    """D-VULN: cleartext and weak services: sensitive paths, old TLS, Telnet and FTP log-ins, SMB null sessions."""
    tls = _port(443, either=True)
    rules = [
        ("Cleartext HTTP Sensitive Path", "HIGH", _port(80) & _any(_says(w, "_body_low") for w in SENSITIVE_PATHS)),
        ("Weak TLS 1.0", "HIGH", tls & _begins(TLS10)),
        ("Weak SSL 3.0", "HIGH", tls & _begins(SSL30)),
        ("Cleartext Telnet Credential", "HIGH", _port(23, either=True) & (_sure(F.contains("_body", F.lit("login:"))) | _sure(F.contains("_body", F.lit("Password:"))))),
        ("Anonymous FTP Login", "HIGH", _port(21, either=True) & (_says("user anonymous", "_body_low") | _says("user ftp", "_body_low"))),
        ("SMB Null Session", "HIGH", _port(445) & _says("ntlmssp") & _has(bytes(8))),
    ]
    return _found(_readable(packets).withColumn("_body_low", F.lower("_body")), "EXPOSURE", rules)


def weak_tls(packets: DataFrame) -> DataFrame:
    """D-TLS: old versions, SHA-1 certificates, RC4 offers on port 443."""
    there = _port(443, either=True) & (F.length("bytes") >= 6)
    hello = _begins(b"\x16") & _sure(F.substring("bytes", 6, 1) == F.lit(b"\x01").cast("binary"))
    rules = [
        ("TLS 1.0", "MED", there & _begins(TLS10)),
        ("SSL 3.0 (POODLE)", "MED", there & _begins(SSL30)),
        ("SHA-1 Certificate", "MED", there & _has(SHA1_OID)),
        ("RC4 Cipher Suite", "MED", there & hello & _any(_has(s) for s in RC4)),
    ]
    return _found(packets, "TLS", rules)


def malformed(packets: DataFrame, tiny: int = 8) -> DataFrame:
    """IPv4 fragments with impossible lengths or of a few bytes only; TCP headers that don't fit."""
    rows = layout(packets)
    at = lambda k, n=1: _number(F.col("_ip") + k, n)
    v4, ihl, total = F.col("_type") == "0800", at(0).bitwiseAND(15) * 4, at(2, 2)
    fragment = v4 & (at(6, 2).bitwiseAND(0x3FFF) != 0)
    more = at(6, 2).bitwiseAND(0x2000) != 0
    bad = (ihl < 20) | (total < ihl)
    tcp = v4 & (at(9) == 6) & (at(6, 2).bitwiseAND(0x1FFF) == 0) & (ihl >= 20)
    offset = F.shiftright(_number(F.col("_ip") + ihl.cast("int") + 12, 1), 4) * 4
    short = F.length("bytes") < F.col("_ip") + ihl + 20
    rules = [
        ("Malformed IPv4 fragment", "HIGH", _sure(fragment & bad)),
        ("Tiny IPv4 fragment", "HIGH", _sure(fragment & more & (F.greatest(total - ihl, F.lit(0)) < tiny))),
        ("Malformed TCP header", "HIGH", _sure(tcp & ((total < ihl + 20) | short | (offset < 20) | (total < ihl + offset)))),
    ]
    return _found(rows, "IDS", rules)


#: Beginnings of files, and the offsets at which frames are looked at.
MAGIC = {
    "ELF": b"\x7fELF", "PE/EXE": b"MZ", "PNG": b"\x89PNG\r\n\x1a\n", "JPEG": b"\xff\xd8\xff", "ZIP": b"PK\x03\x04", "PDF": b"%PDF", "gzip": b"\x1f\x8b", "LZ4": b"\x04\x22\x4d\x18",
    "Zstd": b"\xfd2std", "OGG": b"OggS", "RIFF": b"RIFF", "bzip2": b"BZh", "SQLite": b"SQLite", "7-Zip": b"7z\xbc\xaf\x27\x1c", "SSH-key": b"SSH-", "PEM": b"-----",
}
MAGIC_OFFSETS = (0, 14, 34, 42, 54, 66)
HTTP_PORTS = (80, 8080, 443, 8443, 3000, 8000, 8888)
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT")


def magic(packets: DataFrame, id_col: str = "no") -> DataFrame:
    """X11: the kinds of file whose beginning stands at one of the offsets: id, kind, offset."""
    hit = lambda kind, sig, at: F.when(F.substring("bytes", at + 1, len(sig)) == F.lit(sig).cast("binary"), F.struct(F.lit(kind).alias("kind"), F.lit(at).alias("offset")))
    return packets.select(id_col, F.inline(F.array_compact(F.array(*(hit(k, s, at) for at in MAGIC_OFFSETS for k, s in MAGIC.items())))))


def anomalies(packets: DataFrame, bits: float = 7.2) -> DataFrame:
    """HTTP or SSH on odd ports, high entropy in cleartext protocols, odd TCP flags at the usual offsets (the
    first offset that shows one counts)."""
    rows = packets.withColumn("_entropy", F.when(F.col("protocol").isin("HTTP", "FTP", "Telnet", "SMTP"), T.entropy(F.col("bytes"))))
    byte = lambda at: _number(F.lit(at), 1)
    odd = lambda f: F.when(f == 0x29, "TCP XMAS scan").when((f == 0) & (F.col("protocol") == "TCP"), "TCP NULL scan").when(f.bitwiseAND(3) == 3, "TCP SYN+FIN").when(f == 1, "TCP FIN-only probe")
    texts = [
        F.when((_has(b"HTTP") | _has(b"GET ") | _has(b"POST")) & ~_port(*HTTP_PORTS, either=True), "HTTP content on non-standard port"),
        F.when(_has(b"SSH-") & ~_port(22, either=True), "SSH banner on non-standard port"),
        F.when(_sure(F.col("_entropy") > bits), "High entropy in cleartext protocol"),
        F.coalesce(*(odd(byte(at)) for at in (47, 33, 13))),
    ]
    return rows.select("no", F.explode(F.array_compact(F.array(*texts))).alias("anomaly"))


def http_records(packets: DataFrame) -> DataFrame:
    """D-HTTP: method, path, user agent and answer code of packets on web ports, from the text after 54 bytes."""
    ports = (80, 8080, 8000, 3000, 8888)
    rows = _readable(packets.where(_port(*ports, either=True)))
    line = F.regexp_extract("_body", r"^([^\r\n]*)", 1)
    known = line.rlike("^(" + "|".join(METHODS) + ")")
    agent = F.trim(F.regexp_extract("_body", r"(?im)^user-agent:([^\r\n]*)", 1))
    out = rows.select("no", "src", "dst", F.when(_port(*ports), F.col("dst_port")).otherwise(F.col("src_port")).alias("port"),
        F.when(known, F.regexp_extract(line, "^(" + "|".join(METHODS) + ")", 1)).alias("method"), F.when(known, F.get(F.split(line, " "), F.lit(1))).alias("path"),
        F.nullif(agent, F.lit("")).alias("user_agent"), F.when(line.startswith("HTTP/"), F.get(F.split(line, " "), F.lit(1)).try_cast("int")).alias("response_code"))
    return out.where("method is not null or response_code is not null")


def credentials(packets: DataFrame, id_col: str = "no") -> DataFrame:
    """Log-ins in the text of payloads that are UTF-8: Basic, FTP, SMTP and IMAP; one row a find.

    An SMTP blob is a line of base64 of more than eight characters in a payload that asks for AUTH.
    """
    text = F.expr("try_validate_utf8(bytes)")
    plain = lambda b64: F.try_validate_utf8(F.try_to_binary(b64, F.lit("base64")))
    rows = packets.withColumn("_text", text).where("_text is not null").withColumn("_lines", F.transform(F.split("_text", "\r?\n"), lambda x: F.trim(x)))
    basic = plain(F.trim(F.regexp_extract("_text", r"Authorization: Basic ([^\r\n]*)", 1)))
    hit = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    upper = F.upper
    asks = F.contains("_text", F.lit("AUTH PLAIN")) | F.contains("_text", F.lit("AUTH LOGIN"))
    blobs = F.filter(F.transform(F.filter("_lines", lambda x: asks & x.rlike("^[A-Za-z0-9+/=]{9,}$")), plain), lambda v: v.isNotNull() & (F.contains(v, F.lit("\0")) | (F.length(v) > 3)))
    lines = lambda kind, test: F.transform(F.filter("_lines", test), lambda x: hit(kind, x))
    found = F.concat(
        F.when(F.length(basic) > 0, F.array(hit("HTTP-BasicAuth", basic))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
        lines("FTP-USER", lambda x: F.startswith(upper(x), F.lit("USER "))), lines("FTP-PASS", lambda x: F.startswith(upper(x), F.lit("PASS "))),
        F.transform(blobs, lambda v: hit("SMTP-AUTH", F.replace(v, F.lit("\0"), F.lit(":")))),
        lines("IMAP-LOGIN", lambda x: F.contains(upper(x), F.lit("LOGIN ")) & ~F.startswith(x, F.lit("*"))),
    )
    return rows.select(id_col, F.inline(found))


#: Commands of industrial protocols that change a plant's state, and whether they are critical.
MODBUS = {5: "write single coil", 6: "write single register", 8: "diagnostics", 15: "write multiple coils", 16: "write multiple registers", 21: "write file record", 22: "mask write register", 23: "read/write multiple registers"}
DNP3 = {2: "write", 3: "select", 4: "operate", 5: "direct operate", 6: "direct operate without response", 13: "cold restart", 14: "warm restart"}
S7 = {5: "write variable", 40: "PLC control", 41: "PLC stop"}
BACNET = {15: "WriteProperty", 16: "WritePropertyMultiple", 17: "DeviceCommunicationControl", 20: "ReinitializeDevice"}
CRITICAL = {"DNP3": (4, 5, 6, 13, 14), "S7comm": (40, 41), "BACnet": (17, 20)}


def industrial(packets: DataFrame) -> DataFrame:
    """State-changing commands of Modbus, DNP3, S7 and BACnet by their payload bytes."""
    rows = _kept(layout(packets))
    tcp = F.col("_l4") + (F.shiftright(_number(F.col("_l4") + 12, 1), 4) * 4).cast("int")
    rows = _kept(rows.withColumn("_at", F.when(F.col("_proto") == 6, tcp).when(F.col("_proto") == 17, F.col("_l4") + 8))).where("_at is not null")
    at = lambda k, n=1: _number(F.col("_at") + k, n)
    size = F.length("bytes") - F.col("_at")
    speaks = lambda port, name: _port(port, either=True) | _sure(F.lower("protocol") == name.lower())
    forms = [
        ("Modbus", 502, MODBUS, 7, (size >= 8) & (at(2, 2) == 0)),
        ("DNP3", 20000, DNP3, 12, (size >= 13) & (at(0, 2) == 0x0564)),
        ("S7comm", 102, S7, 17, (size >= 18) & (at(0, 2) == 0x0300) & (at(7) == 0x32)),
        ("BACnet", 47808, BACNET, 9, (size >= 10) & (at(0) == 0x81) & (at(4) == 1) & (at(5).bitwiseAND(0xA8) == 0) & (at(6) < 16)),
    ]
    kind = F.coalesce(*(F.when(speaks(port, name), F.lit(name)) for name, port, *_ in forms))
    rows = _kept(rows.withColumn("_speaks", kind)).where("_speaks is not null")
    is_ = lambda name: F.col("_speaks") == name
    code = F.coalesce(*(F.when(is_(name) & shape, at(k)) for name, _, _, k, shape in forms)).cast("int")
    rows = _kept(rows.withColumn("_code", code))
    table = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    operation = F.coalesce(*(F.when(is_(name), F.try_element_at(table(values), F.col("_code"))) for name, _, values, _, _ in forms))
    critical = _any(is_(name) & F.col("_code").isin(*codes) for name, codes in CRITICAL.items())
    found = _kept(rows.withColumns({"_operation": operation, "_critical": _sure(critical)})).where("_operation is not null")
    signature = F.when(F.col("_critical"), "Critical industrial control command").otherwise("Industrial state-changing command")
    return found.select("no", "timestamp", F.lit("IDS").alias("source"), signature.alias("signature"), F.when(F.col("_critical"), "CRIT").otherwise("HIGH").alias("severity"), F.concat_ws(" ", "_speaks", "_operation", F.lit("from"), "src").alias("detail"), F.concat_ws("|", "src", "dst", "_operation").alias("correlation_key"))
