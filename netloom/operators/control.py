"""Control protocols and framing: spanning tree, LLDP, DHCP, IPv6 extension headers, ambiguous HTTP requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators.decode import _kept
from netloom.operators.detect import _alerts
from netloom.operators.fields import _number, layout
from netloom.operators.layer2 import changed
from netloom.operators.streams import ENDS, segments
from netloom.operators.windows import folded, latched, sessions

#: The address of spanning tree frames and the bytes that begin their content.
BRIDGES = bytes([0x01, 0x80, 0xC2, 0x00, 0x00, 0x00])
BPDU = bytes([0x42, 0x42, 0x03, 0x00, 0x00])


def topology_changes(packets: DataFrame) -> DataFrame:
    """Spanning tree frames that announce a change, by their type or their flags."""
    here = (F.length("bytes") >= 22) & (F.substring("bytes", 1, 6) == F.lit(BRIDGES).cast("binary")) & (F.substring("bytes", 15, 5) == F.lit(BPDU).cast("binary"))
    told = (_number(F.lit(20), 1) == 0x80) | (_number(F.lit(21), 1).bitwiseAND(0x81) != 0)
    mac = T.mac(F.substring("bytes", 7, 6))
    return _alerts(packets.where(here & told), "STP topology change", "MED", F.concat_ws(" ", F.lit("from"), mac), mac)


def chassis_changes(packets: DataFrame) -> DataFrame:
    """A neighbour that announces another chassis by LLDP than before. Only frames of that type reach Python,
    which walks their few fields."""

    @F.pandas_udf("string")
    def chassis(frames: pd.Series, starts: pd.Series) -> pd.Series:
        def of(frame: bytes, at: int) -> str | None:
            while at + 2 <= len(frame):
                head = int.from_bytes(frame[at : at + 2])
                kind, size, at = head >> 9, head & 0x1FF, at + 2
                if kind == 0 or at + size > len(frame):
                    return None
                if kind == 1 and size >= 2:
                    return frame[at : at + size].hex()
                at += size
            return None

        return pd.Series([of(bytes(f), int(a)) for f, a in zip(frames, starts)], dtype=object)

    rows = _kept(layout(packets)).where("_type = '88CC'")
    rows = rows.withColumns({"mac": T.mac(F.substring("bytes", 7, 6)), "chassis": chassis("bytes", F.col("_ip"))}).drop("bytes")
    return changed(rows, "mac", "chassis", "LLDP chassis identity changed", "HIGH")


DHCP = "kind int, client string, server string"


def dhcp_messages(packets: DataFrame) -> DataFrame:
    """DHCP messages with their kind (option 53), client (option 61, else the hardware address) and server (option 54,
    else the address, with the hardware address). Only frames of the two ports with the magic number reach Python."""

    @F.pandas_udf(DHCP)
    def options(payloads: pd.Series) -> pd.DataFrame:
        def of(data: bytes) -> tuple:
            found, at = {}, 240
            while at < len(data) and data[at] != 255:
                if data[at] == 0:
                    at += 1
                    continue
                if at + 1 >= len(data) or at + 2 + data[at + 1] > len(data):
                    return None, None, None
                found[data[at], data[at + 1]] = data[at + 2 : at + 2 + data[at + 1]]
                at += 2 + data[at + 1]
            kind, server = found.get((53, 1)), found.get((54, 4))
            client = [v for (k, n), v in found.items() if k == 61 and n]
            return kind[0] if kind else None, (client[-1] if client else data[28 : 28 + min(data[2], 16)]).hex(), server.hex() if server else None

        return pd.DataFrame([of(bytes(d)) for d in payloads], columns=["kind", "client", "server"]).astype({"kind": "Int32"})

    rows = _kept(layout(packets)).where("_v = 4 and _proto = 17")
    l4 = F.col("_l4")
    rows = _kept(rows.withColumns({"_from": _number(l4, 2), "_to": _number(l4 + 2, 2), "_end": F.least(F.length("bytes"), l4 + _number(l4 + 4, 2).cast("int"))}))
    rows = rows.where("(_from = 67 and _to = 68) or (_from = 68 and _to = 67)").where("_end >= _l4 + 248")
    rows = rows.withColumn("_data", F.substring(F.col("bytes"), l4 + 9, F.col("_end") - l4 - 8)).where(F.substring("_data", 237, 4) == F.lit(bytes([99, 130, 83, 99])).cast("binary"))
    mac, own = F.hex(F.substring("bytes", 7, 6)), F.hex(F.substring(F.col("bytes"), F.col("_ip") + 13, F.lit(4)))
    out = rows.select("no", "timestamp", "src", "dst", "vlan_id", options("_data").alias("m"), F.lower(mac).alias("_mac"), F.lower(own).alias("_own"))
    server = F.concat(F.coalesce("m.server", "_own"), F.col("_mac"))
    return _kept(out.select("no", "timestamp", "src", "dst", "vlan_id", "m.kind", "m.client", server.alias("server"))).where("kind is not null")


def dhcp_servers(packets: DataFrame) -> DataFrame:
    """A server that offers or confirms addresses on a VLAN where another was seen first. Servers are summed up
    before they are ordered, so a window sees a row for each server of a VLAN."""
    from pyspark.sql import Window

    rows = dhcp_messages(packets).where("kind in (2, 5)")
    first = rows.groupBy("vlan_id", "server").agg(F.min_by(F.struct("no", "timestamp", "src"), F.struct("timestamp", "no")).alias("_at")).select("vlan_id", "server", "_at.*")
    later = first.withColumn("_k", F.row_number().over(Window.partitionBy("vlan_id").orderBy("timestamp", "no"))).where("_k > 1")
    vlan = F.coalesce(F.col("vlan_id").cast("string"), F.lit("untagged"))
    return _alerts(later, "DHCP server identity changed", "HIGH", F.concat_ws(" ", F.lit("new server on VLAN"), vlan, F.lit("from"), "src"), F.concat_ws("|", vlan, "server"))


def dhcp_clients(packets: DataFrame, clients: int = 64, seconds: float = 10.0) -> DataFrame:
    """Many clients that ask for addresses on one VLAN."""
    rows = dhcp_messages(packets).where("kind = 1 and client != ''")
    vlan = F.coalesce(F.col("vlan_id").cast("string"), F.lit("untagged"))
    return _alerts(latched(rows, ["vlan_id"], clients, seconds, "client"), "DHCP client identity burst", "CRIT", F.concat_ws(" ", F.lit("many clients on VLAN"), vlan), vlan)


def extension_headers(packets: DataFrame) -> DataFrame:
    """IPv6 frames with how many extension headers they have (the walk ends at 33)."""

    @F.pandas_udf("int")
    def count(frames: pd.Series, starts: pd.Series) -> pd.Series:
        def of(b: bytes, at: int) -> int | None:
            end, kind, here, n = min(len(b), at + 40 + int.from_bytes(b[at + 4 : at + 6])), b[at + 6], at + 40, 0
            while kind in (0, 43, 44, 51, 60) and here < end:
                n += 1
                if n > 32:
                    break
                if here + 2 > len(b):
                    return None
                kind, here = b[here], here + (8 if kind == 44 else (b[here + 1] + 2) * 4 if kind == 51 else (b[here + 1] + 1) * 8)
            return n

        return pd.Series([of(bytes(b), int(a)) for b, a in zip(frames, starts)], dtype="Int32")

    rows = _kept(layout(packets)).where("_v = 6 and hex(substring(bytes, _ip + 7, 1)) in ('00', '2B', '2C', '33', '3C')")
    return rows.select("no", "timestamp", "src", "dst", count("bytes", F.col("_ip")).alias("headers")).where("headers is not null")


def excessive_headers(packets: DataFrame, most: int = 8) -> DataFrame:
    """More extension headers than anyone needs."""
    return _alerts(extension_headers(packets).where(F.col("headers") > most), "Excessive IPv6 extension headers", "HIGH", F.concat_ws(" ", F.col("headers").cast("string"), F.lit("headers"), "src", F.lit("->"), "dst"), F.concat_ws("|", "src", "dst"))


#: Ports of web servers, methods, and the reasons in the order in which they are looked for.
HTTP_PORTS = (80, 3000, 8000, 8080, 8888)
METHODS = frozenset("GET POST PUT PATCH DELETE HEAD OPTIONS CONNECT TRACE".split())
HEADER_MOST = 32_768


def _number_of(value: str) -> int | None:
    digits = value.strip().removeprefix("+")
    return int(digits) if digits.isascii() and digits.isdigit() and int(digits) < 1 << 64 else None


def ambiguity(header: bytes) -> str | None:
    """Why two servers could read a request's header in two ways; None if they can't, or if it is no request."""
    lines = [x.rstrip("\r") for x in header.decode("utf-8", "replace").split("\n")]
    if not lines[0].split() or lines[0].split()[0] not in METHODS:
        return None
    lengths, codings, odd = [], [], None
    for line in lines[1:]:
        if not line:
            break
        raw, colon, value = line.partition(":")
        name = raw.strip().lower()
        if not colon or name not in ("content-length", "transfer-encoding"):
            continue
        odd = name if raw != raw.strip() else odd
        if name == "content-length":
            lengths += [_number_of(v) for v in value.split(",")]
        else:
            codings += [v.strip().lower() for v in value.split(",")]
    if odd:
        return f"whitespace-obfuscated {odd} header"
    if None in lengths:
        return "invalid Content-Length value"
    if len(set(lengths)) > 1:
        return "conflicting Content-Length values"
    if lengths and codings:
        return "both Transfer-Encoding and Content-Length are present"
    if "chunked" in codings and codings.index("chunked") + 1 != len(codings):
        return "chunked transfer coding is not final"
    return "bare-LF request framing" if b"\n\n" in header and b"\r\n\r\n" not in header else None


def smuggling(packets: DataFrame) -> DataFrame:
    """Requests whose framing is ambiguous, by the first header of each direction of a flow (anew after 30 idle
    seconds). Payloads are joined as they come, so headers in several segments count; the fold holds one header."""
    rows = segments(packets).where(F.col("dst_port").isin(*HTTP_PORTS)).where("length(payload) > 0 and not contains(src, ':')")
    rows = sessions(rows, ENDS, 30.0)

    def step(state: dict, r) -> list[tuple]:
        if state.get("done"):
            return []
        data = state["data"] = (state.get("data", b"") + bytes(r.payload))[:HEADER_MOST]
        end = data.find(b"\r\n\r\n") + 4
        end = end if end > 3 else data.find(b"\n\n") + 2
        if end < 2:
            state["done"] = len(data) >= HEADER_MOST
            return []
        state.update(done=True, data=b"")
        reason = ambiguity(data[:end])
        where = f"{r.src} to {r.dst}:{r.dst_port}"
        return [(r.no, r.timestamp, "IDS", "HTTP request smuggling ambiguity", "CRIT", f"{reason} from {where}", f"{r.src}|{r.src_port}|{r.dst}|{r.dst_port}")] if reason else []

    return folded(rows, [*ENDS, "session"], step, "no long, timestamp double, source string, signature string, severity string, detail string, correlation_key string")
