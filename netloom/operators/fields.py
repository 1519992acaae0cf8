"""Frames decoded into a long table of fields, its search, and the comparison of two packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.functions.packet import contains

#: Ethernet types of VLAN tags.
TAGS = ("8100", "88A8", "9100")
#: As many fields at most are compiled into one method; more of them are too large for the JVM, and are evaluated as they stand.
COMPILED = 16


def _cut(offset: Column, length: int) -> Column:
    return F.substring(F.col("bytes"), offset + 1, F.lit(length))


def _number(offset: Column, length: int) -> Column:
    """An unsigned number of the frame, high byte first; null beyond the frame's end."""
    part = _cut(offset, length)
    return F.when(F.length(part) == length, F.conv(F.hex(part), 16, 10).cast("long"))


def layout(packets: DataFrame) -> DataFrame:
    """packets with _tags (how many VLAN tags), _type (Ethernet type in hex), _ip and _l4 (offsets), _proto."""
    first = F.hex(F.substring("bytes", 13, 2)).isin(*TAGS)
    # all tags there are; only frames that begin with one are looked through
    found = F.regexp_extract(F.hex(F.expr("substring(bytes, 13)")), "^((?:(?:" + "|".join(TAGS) + ")[0-9A-F]{4})*)", 1)
    tags = F.when(first, (F.length(found) / 8).cast("int")).otherwise(0)
    rows = packets.withColumn("_tags", F.when(F.length("bytes") >= 14, tags))
    rows = rows.withColumn("_ip", 14 + 4 * F.col("_tags")).withColumn("_type", F.hex(_cut(F.col("_ip") - 2, 2)))
    v4 = (F.col("_type") == "0800") & (F.length("bytes") >= F.col("_ip") + 20)
    v6 = (F.col("_type") == "86DD") & (F.length("bytes") >= F.col("_ip") + 40)
    ihl = _number(F.col("_ip"), 1).bitwiseAND(15).cast("int") * 4
    return rows.withColumns({"_v": F.when(v4, 4).when(v6, 6), "_l4": F.when(v4, F.col("_ip") + ihl).when(v6, F.col("_ip") + 40), "_proto": F.when(v4, _number(F.col("_ip") + 9, 1)).when(v6, _number(F.col("_ip") + 6, 1))})


def fields(packets: DataFrame, layers: tuple[str, ...] | None = None, paths: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each field of each frame: no, layer, path, label, value, offset, length. With layers or paths
    only those fields are made, which is far less work than to make all and drop the others.

    A field that the frame is too short for, or whose layer isn't there, has no row. One pass, no shuffle: the
    fields are an array of each row's own bytes.
    """

    def field(layer: str, path: str, label: str, value: Column, offset: Column | None = None, length: int | None = None, there: Column | None = None) -> Column | None:
        if (layers is not None and layer not in layers) or (paths is not None and path not in paths):
            return None
        made = F.struct(F.lit(layer).alias("layer"), F.lit(path).alias("path"), F.lit(label).alias("label"), value.cast("string").alias("value"), (F.lit(None) if offset is None else offset).cast("int").alias("offset"), F.lit(length).cast("int").alias("length"))
        sure = value.isNotNull() if there is None else value.isNotNull() & there
        return F.when(sure, made)

    at = lambda base: (lambda k: F.col(base) + k)
    ip, l4, zero = at("_ip"), at("_l4"), F.lit(0)
    hexed = lambda n, width: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), width, "0"))
    v4, v6 = F.col("_v") == 4, F.col("_v") == 6
    tcp, udp = (F.col("_proto") == 6) & (F.length("bytes") >= l4(20)), (F.col("_proto") == 17) & (F.length("bytes") >= l4(8))

    def tag(k: int, layer: str, path: str, there: Column) -> list[Column | None]:
        off = F.lit(14 + 4 * k)
        tci = _number(off, 2)
        return [
            field(layer, f"{path}.id", "VLAN ID", tci.bitwiseAND(0x0FFF), off, 2, there),
            field(layer, f"{path}.pcp", "Priority Code Point", F.shiftright(tci, 13).bitwiseAND(7), off, 1, there),
            field(layer, f"{path}.dei", "Drop Eligible", F.shiftright(tci, 12).bitwiseAND(1), off, 1, there),
        ]

    groups = lambda data: F.regexp_replace(F.lower(F.hex(data)), r"(....)(?!$)", "$1:")
    record = _number(at("_pay")(0), 1)
    content = F.when(record == 20, "change_cipher_spec").when(record == 21, "alert").when(record == 22, "handshake").when(record == 23, "application_data")
    tls = (_number(at("_pay")(1), 1) == 3) & (F.length("bytes") >= at("_pay")(5))
    dtls = (_number(at("_pay")(1), 1) == 254) & (F.length("bytes") >= at("_pay")(13))
    every = [
        field("Frame", "frame.number", "Frame Number", F.col("no")),
        field("Frame", "frame.time", "Relative Time", F.format_string("%.6fs", F.col("timestamp"))),
        field("Frame", "frame.len", "Frame Length", F.col("length")),
        field("Frame", "proto", "Protocol", F.col("protocol")),
        field("Ethernet", "eth.dst", "Destination MAC", T.mac(F.substring("bytes", 1, 6)), zero, 6, F.col("_tags").isNotNull()),
        field("Ethernet", "eth.src", "Source MAC", T.mac(F.substring("bytes", 7, 6)), zero + 6, 6, F.col("_tags").isNotNull()),
        field("Ethernet", "eth.type", "EtherType", F.concat(F.lit("0x"), F.lower(F.col("_type"))), ip(-2), 2),
        *tag(0, "VLAN", "vlan", F.col("_tags") == 1), *tag(0, "Outer VLAN", "vlan.outer", F.col("_tags") >= 2), *tag(1, "VLAN", "vlan", F.col("_tags") >= 2),
        field("VLAN", "vlan.id", "VLAN ID", F.col("vlan_id"), there=F.col("_tags") == 0),
        field("IPv4", "ip.version", "Version", F.shiftright(_number(ip(0), 1), 4), ip(0), 1, v4),
        field("IPv4", "ip.hdr_len", "Header Length", _number(ip(0), 1).bitwiseAND(15) * 4, ip(0), 1, v4),
        field("IPv4", "ip.len", "Total Length", _number(ip(2), 2), ip(2), 2, v4),
        field("IPv4", "ip.id", "Identification", hexed(_number(ip(4), 2), 4), ip(4), 2, v4),
        field("IPv4", "ip.ttl", "Time To Live", _number(ip(8), 1), ip(8), 1, v4),
        field("IPv4", "ip.proto", "Protocol Number", _number(ip(9), 1), ip(9), 1, v4),
        field("IPv4", "ip.src", "Source Address", T.dotted(_cut(ip(12), 4)), ip(12), 4, v4),
        field("IPv4", "ip.dst", "Destination Address", T.dotted(_cut(ip(16), 4)), ip(16), 4, v4),
        field("IPv6", "ip.version", "Version", F.shiftright(_number(ip(0), 1), 4), ip(0), 1, v6),
        field("IPv6", "ipv6.payload_len", "Payload Length", _number(ip(4), 2), ip(4), 2, v6),
        field("IPv6", "ipv6.next_header", "Next Header", _number(ip(6), 1), ip(6), 1, v6),
        field("IPv6", "ipv6.hop_limit", "Hop Limit", _number(ip(7), 1), ip(7), 1, v6),
        field("IPv6", "ipv6.src", "Source Address", groups(_cut(ip(8), 16)), ip(8), 16, v6),
        field("IPv6", "ipv6.dst", "Destination Address", groups(_cut(ip(24), 16)), ip(24), 16, v6),
        field("TCP", "tcp.srcport", "Source Port", _number(l4(0), 2), l4(0), 2, tcp),
        field("TCP", "tcp.dstport", "Destination Port", _number(l4(2), 2), l4(2), 2, tcp),
        field("TCP", "tcp.seq", "Sequence Number", _number(l4(4), 4), l4(4), 4, tcp),
        field("TCP", "tcp.ack", "Acknowledgment Number", _number(l4(8), 4), l4(8), 4, tcp),
        field("TCP", "tcp.hdr_len", "Header Length", F.shiftright(_number(l4(12), 1), 4) * 4, l4(12), 1, tcp),
        field("TCP", "tcp.flags", "Flags", hexed(_number(l4(13), 1), 2), l4(13), 1, tcp),
        field("TCP", "tcp.window_size", "Window Size", _number(l4(14), 2), l4(14), 2, tcp),
        field("UDP", "udp.srcport", "Source Port", _number(l4(0), 2), l4(0), 2, udp),
        field("UDP", "udp.dstport", "Destination Port", _number(l4(2), 2), l4(2), 2, udp),
        field("UDP", "udp.length", "Length", _number(l4(4), 2), l4(4), 2, udp),
        field("UDP", "udp.checksum", "Checksum", hexed(_number(l4(6), 2), 4), l4(6), 2, udp),
        field("TLS", "tls.record.content_type", "Record Content Type", content, at("_pay")(0), 1, tls),
        field("TLS", "tls.record.version", "Record Version", hexed(_number(at("_pay")(1), 2), 4), at("_pay")(1), 2, tls),
        field("TLS", "tls.record.length", "Record Length", _number(at("_pay")(3), 2), at("_pay")(3), 2, tls),
        field("DTLS", "dtls.record.content_type", "Record Content Type", content, at("_pay")(0), 1, dtls),
        field("DTLS", "dtls.record.version", "Record Version", hexed(_number(at("_pay")(1), 2), 4), at("_pay")(1), 2, dtls),
        field("DTLS", "dtls.record.epoch", "Epoch", _number(at("_pay")(3), 2), at("_pay")(3), 2, dtls),
        field("DTLS", "dtls.record.sequence_number", "Sequence Number", _number(at("_pay")(5), 6), at("_pay")(5), 6, dtls),
        field("DTLS", "dtls.record.length", "Record Length", _number(at("_pay")(11), 2), at("_pay")(11), 2, dtls),
        field("Bytes", "payload.len", "Captured Bytes", F.length("bytes"), there=F.col("_tags").isNull()),
    ]
    rows = layout(packets)
    head = (F.shiftright(_number(F.col("_l4") + 12, 1), 4) * 4).cast("int")
    rows = rows.withColumn("_pay", F.when(F.col("_proto") == 6, F.col("_l4") + head).when(F.col("_proto") == 17, F.col("_l4") + 8))
    asked = [f for f in every if f is not None]
    if not asked:
        raise ValueError(f"no such fields: {layers} {paths}")
    made = F.array(*asked)
    if len(asked) > COMPILED:
        return rows.select("no", F.inline(F.array_compact(made)))
    return rows.select("no", F.inline(made)).where("path is not null")


def found_in(table: DataFrame, query: str) -> DataFrame:
    """Fields whose path, label, value or layer holds the text, whatever the case."""
    return table.where(reduce(lambda a, b: a | b, (contains(c, query) for c in ("path", "label", "value", "layer"))))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """The fields in which two packets differ: changed, left only, right only. Number and time don't count."""
    side = lambda p, name: fields(p).where("path not in ('frame.number', 'frame.time')").select("layer", "path", F.col("value").alias(name))
    both = side(left, "left").join(side(right, "right"), ["layer", "path"], "full_outer")
    change = F.when(F.col("left").isNull(), "right only").when(F.col("right").isNull(), "left only").otherwise("changed")
    return both.where("not (left <=> right)").withColumn("change", change)


def first_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The place of the first byte in which two packets differ and the bytes there, null where one has ended; no
    row if they are the same. Each side is one packet."""
    byte = lambda p, name: p.select(F.posexplode(F.regexp_extract_all(F.hex("bytes"), F.lit("(..)"), F.lit(1))).alias("offset", name))
    both = byte(left, "left").join(byte(right, "right"), "offset", "full_outer").where("not (left <=> right)")
    return both.orderBy("offset").limit(1)
