"""TLS hellos, QUIC headers and their fingerprints; tables of sessions and connections."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.decode import _kept
from netloom.operators.fields import _number, layout
from netloom.operators.traffic import FLOW, with_flow_key

HELLO = "kind int, version int, random string, sni string, alpn string, ciphers array<int>, extensions array<int>, signatures array<int>, ech boolean"
#: Fixed value: the extension by which a client offers to encrypt its hello.
ECH = 0xFE0D


def _grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


def _u16s(data: bytes) -> list[int]:
    return [v for (v,) in struct.iter_unpack(">H", data[: len(data) // 2 * 2])]


def hello(frame: bytes) -> dict | None:
    """The first client (kind 1) or server hello (2) of a frame; None if there is none or it is cut off."""
    at = next((i for i in range(len(frame) - 9) if frame[i] == 0x16 and frame[i + 1] == 3 and frame[i + 5] in (1, 2)), None)
    if at is None:
        return None
    size = int.from_bytes(frame[at + 6 : at + 9])
    b = frame[at + 9 : min(at + 9 + size, at + 5 + int.from_bytes(frame[at + 3 : at + 5]))]
    try:
        out = {"kind": frame[at + 5], "version": int.from_bytes(b[:2]), "random": b[2:34].hex(), "sni": None, "alpn": None, "extensions": [], "signatures": [], "ech": False}
        p = 35 + b[34]
        if out["kind"] == 2:
            return out | {"ciphers": _u16s(b[p : p + 2])}
        n = int.from_bytes(b[p : p + 2])
        out["ciphers"] = [c for c in _u16s(b[p + 2 : p + 2 + n]) if not _grease(c)]
        p += 2 + n
        p += 1 + b[p]
        end = p + 2 + int.from_bytes(b[p : p + 2])
        p += 2
        while p + 4 <= min(end, len(b)):
            kind, n = struct.unpack_from(">HH", b, p)
            body, p = b[p + 4 : p + 4 + n], p + 4 + n
            if _grease(kind):
                continue
            out["extensions"].append(kind)
            out["ech"] = out["ech"] or kind == ECH
            if kind == 0 and len(body) > 5 and body[2] == 0:
                out["sni"] = body[5 : 5 + int.from_bytes(body[3:5])].decode("utf-8", "replace")
            elif kind == 16 and len(body) > 3:
                out["alpn"] = body[3 : 3 + body[2]].decode("utf-8", "replace")
            elif kind == 13:
                out["signatures"] = _u16s(body[2:])
            elif kind == 43:
                out["version"] = max((v for v in _u16s(body[1:]) if not _grease(v)), default=out["version"])
        return out
    except (IndexError, struct.error):
        return None


def hellos(packets: DataFrame) -> DataFrame:
    """Packets with a hello, its parts and, for a client's, the JA4-style fingerprint. Frames without the bytes of a
    handshake record never reach Python."""

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in HELLO.split(', '))}>")
    def parse(frames: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in HELLO.split(", ")]
        return pd.DataFrame([hello(bytes(f)) or dict.fromkeys(names) for f in frames], columns=names).astype({"kind": "Int32", "version": "Int32"})

    some = packets.where(F.contains(F.col("bytes"), F.lit(b"\x16\x03").cast("binary")))
    parse = parse.asNondeterministic()  # else the test of `kind` is moved before it and parses every frame a second time, in a worker of its own
    rows = some.withColumn("hello", parse("bytes")).select(*packets.columns, "hello.*").where("kind is not null")
    return rows.withColumn("ja4", F.when(F.col("kind") == 1, ja4(F.when(F.lower("protocol").isin("udp", "quic"), "q").otherwise("t"))))


def _sha12(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def ja4(transport: Column) -> Column:
    """Transport, version, whether a name is given, counts, the protocol asked for, and hashes of the lists."""
    hexed = lambda xs: F.array_join(F.transform(xs, lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")), ",")
    version = F.coalesce(*(F.when(F.col("version") == v, name) for v, name in ((0x0304, "13"), (0x0303, "12"), (0x0302, "11"), (0x0301, "10"))), F.lit("00"))
    count = lambda c: F.lpad(F.least(F.size(c), F.lit(99)).cast("string"), 2, "0")
    ends = F.when(F.length("alpn") > 0, F.concat(F.substring("alpn", 1, 1), F.substring("alpn", -1, 1))).otherwise("00")
    named = F.when(F.col("sni").isNotNull(), "d").otherwise("i")
    rest = F.array_sort(F.filter("extensions", lambda v: ~v.isin(0, 16)))
    return F.concat(transport, version, named, count("ciphers"), count("extensions"), ends, F.lit("_"), _sha12(hexed(F.array_sort("ciphers"))), F.lit("_"), _sha12(F.concat(hexed(rest), F.lit("_"), hexed(F.col("signatures")))))


def tls_sessions(packets: DataFrame) -> DataFrame:
    """One row a flow: what the latest client hello says, the latest server's cipher, first and last time."""
    rows = with_flow_key(hellos(packets))
    client, server = F.col("kind") == 1, F.col("kind") == 2
    last = lambda c, side: F.max_by(F.when(side, F.col(c)), F.when(side, F.col("no"))).alias(c)
    cipher = F.max_by(F.when(server, F.get("ciphers", F.lit(0))), F.when(server, F.col("no"))).alias("server_cipher")
    return rows.groupBy(*FLOW).agg(*(last(c, client) for c in ("version", "random", "sni", "alpn", "ja4")), cipher, F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def with_key_material(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """Sessions with has_keys: the key log knows their client random."""
    known = keys.select(F.col("client_random").alias("random"), F.lit(True).alias("has_keys")).distinct()
    return sessions.join(known, "random", "left").withColumn("has_keys", F.coalesce("has_keys", F.lit(False)))


def quic(packets: DataFrame) -> DataFrame:
    """T4: the invariant header of QUIC packets over UDP and its fingerprint, in built-in functions."""
    rows = _kept(layout(packets)).where("_proto = 17")
    at = F.col("_l4") + 8
    rows = _kept(rows.withColumns({"_at": at, "_first": _number(at, 1), "_version": _number(at + 1, 4), "_dlen": _number(at + 5, 1).cast("int")})).where("_first & 64 != 0")
    rows = _kept(rows.withColumns({"_long": F.col("_first").bitwiseAND(128) != 0, "_slen": _number(F.col("_at") + 6 + F.col("_dlen"), 1).cast("int")}))
    rows = rows.where("not _long or (_dlen <= 20 and _slen <= 20 and length(bytes) >= _at + 7 + _dlen + _slen)")
    cut = lambda start, n: F.lower(F.hex(F.substring(F.col("bytes"), start + 1, n)))
    long = F.col("_long")
    kind = F.when(~long, "1-RTT").when(F.col("_version") == 0, "Version Negotiation").otherwise(F.get(F.array(*(F.lit(x) for x in ("Initial", "0-RTT", "Handshake", "Retry"))), F.shiftright(F.col("_first").bitwiseAND(0x30), 4).cast("int")))
    out = _kept(rows.select("no", "timestamp", "src", "dst", "length", kind.alias("packet_type"), F.when(long, F.col("_version")).alias("version"), F.when(long, cut(F.col("_at") + 6, F.col("_dlen"))).otherwise("").alias("destination_id"), F.when(long, cut(F.col("_at") + 7 + F.col("_dlen"), F.col("_slen"))).otherwise("").alias("source_id")))
    shown = F.when(F.col("version").isNull(), "short").otherwise(F.lpad(F.lower(F.hex("version")), 8, "0"))
    size = lambda c: (F.length(c) / 2).cast("int").cast("string")
    return out.withColumn("ratq", F.concat(F.lit("ratq1_"), _sha12(F.concat_ws("|", shown, "packet_type", size("destination_id"), size("source_id"), F.lit("1")))))


def quic_connections(headers: DataFrame) -> DataFrame:
    """Packets, bytes, types and addresses of each connection id; over two addresses mean that it moved."""
    rows = headers.where("destination_id != ''")
    sums = rows.groupBy("destination_id").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.array_sort(F.collect_set("packet_type")).alias("packet_types"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    ends = rows.select("destination_id", F.explode(F.array("src", "dst")).alias("end")).groupBy("destination_id").agg(F.count_distinct("end").alias("addresses"))
    return sums.join(ends, "destination_id").withColumn("migrated", F.col("addresses") > 2)


def session_alerts(packets: DataFrame) -> DataFrame:
    """Level and description of each flow's latest TLS alert record, by the first of a frame."""
    at = F.instr(F.decode("bytes", "ISO-8859-1"), F.lit("\x15\x03"))
    rows = packets.where(F.contains(F.col("bytes"), F.lit(b"\x15\x03").cast("binary")) & ~F.contains(F.col("bytes"), F.lit(b"\x16\x03").cast("binary"))).withColumn("_at", at.cast("int"))
    rows = with_flow_key(rows.withColumns({"level": _number(F.col("_at") + 4, 1).cast("int"), "description": _number(F.col("_at") + 5, 1).cast("int")}).drop("bytes", "_at"))
    latest = F.max_by(F.struct("level", "description"), F.struct("timestamp", "no"))
    return rows.groupBy(*FLOW).agg(latest.alias("_a")).select(*FLOW, F.col("_a.level").alias("alert_level"), F.col("_a.description").alias("alert_description"))
