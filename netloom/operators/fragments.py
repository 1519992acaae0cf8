"""Pieces of datagrams and streams: fragments that contradict one another, floods of them, and IPv6 datagrams in whole."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.decode import _kept
from netloom.operators.detect import _alerts
from netloom.operators.fields import _number, layout
from netloom.operators.ranges import contradictions
from netloom.operators.signatures import exploits
from netloom.operators.streams import of_epochs, placed, segments
from netloom.operators.windows import first_of, folded, running, sessions
from netloom.sources.scratch import kept


def contradicted(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key whose bytes differ from those an earlier row has at the same place.

    pieces has no, timestamp, keys, start, data.
    """
    found = contradictions(pieces, keys, F.struct("timestamp", "no"))
    return pieces.drop("data").join(found.select(F.col("order.no").alias("_no")), F.col("no") == F.col("_no"), "left_semi")


FRAGMENT = ["f_src", "f_dst", "f_id", "f_proto"]


def ipv4_fragments(packets: DataFrame) -> DataFrame:
    """IPv4 fragments with the key of their datagram, start, data and the session (60 s) of the datagram."""
    rows = _kept(layout(packets)).where("_v = 4")
    at = lambda k, n=1: _number(F.col("_ip") + k, n)
    rows = rows.withColumns({"_flags": at(6, 2), "_head": (at(0).bitwiseAND(15) * 4).cast("int"), "_total": at(2, 2).cast("int")}).where("_flags & 16383 != 0")
    rows = _kept(rows)
    address = lambda k: F.hex(F.substring(F.col("bytes"), F.col("_ip") + k + 1, F.lit(4)))
    data = F.substring(F.col("bytes"), F.col("_ip") + F.col("_head") + 1, F.greatest(F.col("_total") - F.col("_head"), F.lit(0)))
    named = {"f_src": address(12), "f_dst": address(16), "f_id": at(4, 2), "f_proto": at(9), "start": F.col("_flags").bitwiseAND(0x1FFF) * 8, "data": data}
    return sessions(_kept(rows.select("no", "timestamp", "src", "dst", *(v.alias(k) for k, v in named.items()))), FRAGMENT, 60.0)


def _about_datagram(rows: DataFrame, signature: str, severity: str) -> DataFrame:
    return _alerts(rows, signature, severity, F.concat_ws(" ", "src", F.lit("->"), "dst"), F.concat_ws("|", *(F.col(c).cast("string") for c in FRAGMENT)))


def conflicting_fragments(packets: DataFrame) -> DataFrame:
    """D3: fragments of one datagram that carry different bytes for the same place; once a datagram."""
    return _about_datagram(contradicted(kept(ipv4_fragments(packets)), [*FRAGMENT, "session"]), "Conflicting IPv4 fragments", "CRIT")


def fragment_flood(packets: DataFrame, most: int = 64) -> DataFrame:
    """More than so many fragments of one datagram; once a datagram."""
    rows = ipv4_fragments(packets).drop("data")
    counted = running(rows, [*FRAGMENT, "session"], {"_n": F.lit(1)})
    return _about_datagram(counted.where(F.col("_n") == most + 1), "IPv4 fragment flood", "HIGH")


def conflicting_retransmission(packets: DataFrame) -> DataFrame:
    """Segments of one direction that carry different bytes for the same sequence numbers; once until the flow
    begins anew. Numbers are followed over their wrap."""
    direction = F.concat_ws(":", "src", F.col("src_port").cast("string"))
    keys = ["flow", "session", "epoch", "direction"]
    every = kept(segments(packets))
    rows = kept(placed(of_epochs(every).withColumn("direction", direction), keys).withColumnRenamed("place", "start").where("size > 0"))
    data = every.select(F.col("no").alias("_of"), F.col("payload").alias("data"))
    each = contradicted(kept(rows.join(data, F.col("no") == F.col("_of")).drop("_of")), keys)
    found = first_of(each, ["flow", "session", "epoch"])
    return _alerts(found, "Conflicting TCP retransmission", "CRIT", F.concat_ws(" ", "src", F.lit("->"), "dst"), F.col("flow"))


#: Next headers that extend an IPv6 header, apart from the fragment header.
EXTENSIONS = (0, 43, 51, 60)


def _fragment_header(frame: bytes, at: int) -> tuple | None:
    """(source, destination, id, next header, offset, more, data) of an IPv6 frame that is a fragment."""
    end, kind, here = min(len(frame), at + 40 + int.from_bytes(frame[at + 4 : at + 6])), frame[at + 6], at + 40
    while kind in EXTENSIONS:
        if here + 2 > len(frame):
            return None
        kind, here = frame[here], here + ((frame[here + 1] + 2) * 4 if kind == 51 else (frame[here + 1] + 1) * 8)
        if here > end:
            return None
    if kind != 44 or here + 8 > end:
        return None
    place = int.from_bytes(frame[here + 2 : here + 4])
    return frame[at + 8 : at + 24].hex(), frame[at + 24 : at + 40].hex(), int.from_bytes(frame[here + 4 : here + 8]), frame[here], place & 0xFFF8, bool(place & 1), frame[here + 8 : end]


DATAGRAM = ["f_src", "f_dst", "f_id", "f_proto"]
OUTCOME = "no long, timestamp double, src string, dst string, vlan_id int, f_src string, f_dst string, f_id long, f_proto int, outcome string, conflict boolean, fragments int, payload binary"


def ipv6_datagrams(packets: DataFrame, most: int = 128, size: int = 1 << 20) -> DataFrame:
    """R2: the outcome of each IPv6 fragment: pending, complete with the payload, or rejected, and whether it
    contradicts earlier bytes. Exact copies count once, later bytes overwrite; a datagram lapses after 60 s without a
    fragment. The limits are the operator's: so a datagram's state in the fold is bounded."""

    @F.pandas_udf("f_src string, f_dst string, f_id long, f_proto int, offset int, more boolean, data binary")
    def parse(frames: pd.Series, starts: pd.Series) -> pd.DataFrame:
        names = ["f_src", "f_dst", "f_id", "f_proto", "offset", "more", "data"]
        rows = [_fragment_header(bytes(f), int(a)) or (None,) * 7 for f, a in zip(frames, starts)]
        return pd.DataFrame(rows, columns=names).astype({"f_id": "Int64", "f_proto": "Int32", "offset": "Int32"})

    rows = _kept(layout(packets)).where("_v = 6").withColumn("_f", parse("bytes", F.col("_ip")))
    rows = rows.select("no", "timestamp", "src", "dst", "vlan_id", "_f.*").where("f_src is not null")
    rows = sessions(rows, DATAGRAM, 60.0)

    def step(state: dict, r) -> list[tuple]:
        head = (r.no, r.timestamp, r.src, r.dst, None if r.vlan_id is None or r.vlan_id != r.vlan_id else int(r.vlan_id), r.f_src, r.f_dst, r.f_id, r.f_proto)
        data, at = bytes(r.data), r.offset
        if at + len(data) > size:
            return [(*head, "rejected: size", False, len(state.get("parts", ())), None)]
        parts = state.setdefault("parts", [])
        if len(parts) >= most:
            return [(*head, "rejected: count", False, len(parts), None)]
        overlap = lambda a, x: (max(a, at), min(a + len(x), at + len(data)))
        conflict = any(lo < hi and x[lo - a : hi - a] != data[lo - at : hi - at] for a, x in parts for lo, hi in [overlap(a, x)])
        if not r.more:
            state["end"] = at + len(data)
        if (at, data) not in parts:
            parts.append((at, data))
        n, end = len(parts), state.get("end")
        if end is not None:
            upto = 0
            for a, x in sorted(parts, key=lambda p: p[0]):
                upto = max(upto, a + len(x)) if a <= upto else upto
            if upto >= end:
                whole = bytearray(end)
                for a, x in parts:
                    whole[a : min(a + len(x), end)] = x[: max(0, end - a)]
                state.clear()
                return [(*head, "complete", conflict, n, bytes(whole[:end]))]
        return [(*head, "pending", conflict, n, None)]

    return folded(rows, [*DATAGRAM, "session"], step, OUTCOME)


def ipv6_fragment_alerts(datagrams: DataFrame) -> DataFrame:
    """IPv6 fragments that contradict one another, and those that go beyond the limits."""
    by = lambda rows, name, severity: _alerts(rows, name, severity, F.concat_ws(" ", F.lit("from"), "src", "outcome"), F.concat_ws("|", *(F.col(c).cast("string") for c in DATAGRAM)))
    found = [by(datagrams.where("conflict"), "Conflicting IPv6 fragments", "CRIT"), by(datagrams.where("startswith(outcome, 'rejected')"), "IPv6 fragment reassembly rejected", "HIGH")]
    return reduce(DataFrame.unionByName, found)


def reassembled_packets(datagrams: DataFrame) -> DataFrame:
    """Whole datagrams as packets, with the ports of their payload: what signatures are looked for in."""
    port = lambda k: F.when(F.col("f_proto").isin(6, 17) & (F.length("payload") >= 4), F.conv(F.hex(F.substring("payload", k, 2)), 16, 10).cast("int"))
    name = F.when(F.col("f_proto") == 6, "TCP").when(F.col("f_proto") == 17, "UDP").when(F.col("f_proto") == 58, "ICMPv6").otherwise("IPv6-Reassembled")
    whole = datagrams.where("outcome = 'complete'")
    info = F.concat(F.lit("Reassembled from "), F.col("fragments").cast("string"), F.lit(" IPv6 fragments"))
    return whole.select("no", "timestamp", "src", "dst", name.alias("protocol"), F.least(F.length("payload"), F.lit(65535)).alias("length"), info.alias("info"), port(1).alias("src_port"), port(3).alias("dst_port"), "vlan_id", F.col("payload").alias("bytes"))


def exploits_in_fragments(datagrams: DataFrame) -> DataFrame:
    """The byte signatures D40 to D52 in reassembled datagrams."""
    return exploits(reassembled_packets(datagrams))
