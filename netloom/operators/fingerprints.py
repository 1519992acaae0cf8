"""Fingerprints of TLS and SSH ends, names of cipher suites, guesses of operating systems, and what flows show at once."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.packet import tcp_flags
from netloom.operators.dns import messages
from netloom.operators.fields import _number
from netloom.operators.handshake import _u16s
from netloom.operators.traffic import FLOW, with_flow_key
from netloom.operators.windows import ORDER, latched, previous

#: Names of cipher suites and versions, and the suites that are weak.
CIPHERS = {
    0xC02B: "ECDHE-ECDSA-AES128-GCM-SHA256", 0xC02F: "ECDHE-RSA-AES128-GCM-SHA256", 0xC02C: "ECDHE-ECDSA-AES256-GCM-SHA384", 0xC030: "ECDHE-RSA-AES256-GCM-SHA384", 0x1301: "TLS_AES_128_GCM_SHA256 (TLS1.3)",
    0x1302: "TLS_AES_256_GCM_SHA384 (TLS1.3)", 0x1303: "TLS_CHACHA20_POLY1305_SHA256 (TLS1.3)", 0x0005: "RC4-SHA (WEAK)", 0x000A: "3DES-CBC-SHA (WEAK)",
}
WEAK = (0x0004, 0x0005, 0x000A, 0x002F, 0x0035, 0x0001, 0x0002)
VERSIONS = {0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
#: Operating systems by time to live and window; None for any window.
SYSTEMS = (
    (64, 5840, "Linux 2.x"), (64, 29200, "Linux 3.x"), (64, 64240, "Linux 4.x+"), (64, 65535, "macOS/FreeBSD"), (128, 65535, "Windows 10/11"), (128, 8192, "Windows XP/2003"),
    (128, 16384, "Windows Server"), (255, None, "Network Device (Cisco/etc)"), (32, None, "Windows 9x/ME"),
)


def _named(values: dict, code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), code.cast("int"))


def cipher_name(code: Column) -> Column:
    """The name of a cipher suite."""
    return F.coalesce(_named(CIPHERS, code), F.when(code.isNotNull(), "unknown"))


def is_weak(code: Column) -> Column:
    """Whether a cipher suite is weak; false if none is known."""
    return F.coalesce(code.isin(*WEAK), F.lit(False))


def version_name(code: Column) -> Column:
    """The name of a TLS version."""
    other = F.concat(F.lit("TLS "), F.shiftright(code, 8).cast("string"), F.lit("."), code.bitwiseAND(255).cast("string"))
    return F.coalesce(_named(VERSIONS, code), other)


def named_sessions(sessions: DataFrame) -> DataFrame:
    """TLS sessions that name a server."""
    return sessions.where("sni is not null and sni != ''")


def weak_sessions(sessions: DataFrame) -> DataFrame:
    """TLS sessions whose server chose a weak suite, with its name."""
    return sessions.where(is_weak(F.col("server_cipher"))).withColumn("cipher", cipher_name(F.col("server_cipher")))


def session_totals(sessions: DataFrame) -> DataFrame:
    """Sessions, those with a name, weak ones, and those whose keys are known, in one row."""
    keys = F.col("has_keys") if "has_keys" in sessions.columns else F.lit(False)
    return sessions.agg(F.count("*").alias("sessions"), F.count_if(F.coalesce(F.col("sni") != "", F.lit(False))).alias("named"), F.count_if(is_weak(F.col("server_cipher"))).alias("weak"), F.count_if(keys).alias("with_keys"))


def _loose(values: list[int]) -> list[str]:
    """Numbers as text without those of the reserved pattern, whose two bytes needn't be the same here."""
    return [str(v) for v in values if v & 0x0F0F != 0x0A0A]


def _record(frame: bytes, kind: int) -> int | None:
    return next((i + 5 for i in range(len(frame) - 5) if frame[i] == 0x16 and frame[i + 1] == 3 and frame[i + 5] == kind), None)


def _extensions(data: bytes, total: int):
    at = 0
    while at + 4 <= min(total, len(data)):
        kind, n = struct.unpack_from(">HH", data, at)
        yield kind, data[at + 4 : at + 4 + n], at + 4 + n <= len(data)
        at += 4 + n


def ja3(frame: bytes) -> str | None:
    """Version, suites, extensions, groups and point formats of a client hello, as their MD5."""
    at = _record(frame, 1)
    if at is None or len(frame) < at + 39:
        return None
    here = at + 4 + 34
    here += 1 + frame[here]
    if len(frame) < here + 2 or len(frame) < here + 2 + (n := int.from_bytes(frame[here : here + 2])):
        return None
    ciphers, here = _u16s(frame[here + 2 : here + 2 + n]), here + 2 + n
    if len(frame) < here + 1 or len(frame) < (here := here + 1 + frame[here]) + 2:
        return None
    total, data = int.from_bytes(frame[here : here + 2]), frame[here + 2 :]
    if len(data) < total:
        return None
    kinds, groups, formats = [], [], []
    for kind, body, whole in _extensions(data, total):
        kinds.append(kind)
        if not whole:
            break
        if kind == 10 and len(body) >= 2:
            groups += _u16s(body[2 : 2 + int.from_bytes(body[:2])])
        if kind == 11 and body:
            formats += body[1 : 1 + body[0]]
    parts = [str(int.from_bytes(frame[at + 4 : at + 6])), "-".join(_loose(ciphers)), "-".join(_loose(kinds)), "-".join(_loose(groups)), "-".join(map(str, formats))]
    return hashlib.md5(",".join(parts).encode()).hexdigest()


def ja3s(frame: bytes) -> str | None:
    """Version, suite and extensions of a server hello, as their MD5."""
    at = _record(frame, 2)
    if at is None or len(frame) < at + 39:
        return None
    here = at + 38
    here += 1 + frame[here]
    if len(frame) < here + 5:
        return None
    total, data = int.from_bytes(frame[here + 3 : here + 5]), frame[here + 5 :]
    kinds = [kind for kind, _, _ in _extensions(data, total)]
    text = f"{int.from_bytes(frame[at + 4 : at + 6])},{int.from_bytes(frame[here : here + 2])},{'-'.join(_loose(kinds))}"
    return hashlib.md5(text.encode()).hexdigest()


def hassh(frame: bytes) -> str | None:
    """The client's algorithms in an SSH key exchange, as their MD5; the first byte 0x14 is taken for its beginning."""
    at = frame.find(b"\x14")
    if at < 0:
        return None
    at, lists = at + 17, []
    while len(lists) < 10 and at + 4 <= len(frame):
        n = int.from_bytes(frame[at : at + 4])
        if at + 4 + n > len(frame):
            break
        try:
            lists.append(frame[at + 4 : at + 4 + n].decode("utf-8"))
        except UnicodeDecodeError:
            break
        at += 4 + n
    if len(lists) < 7:
        return None
    return hashlib.md5(f"{lists[0]};{lists[2]};{lists[4]};{lists[6][:100]}".encode()).hexdigest()


def flow_fingerprints(packets: DataFrame) -> DataFrame:
    """T5: each flow's first JA3, JA3S and HASSH. Only frames that hold a hello or come from or to port 22 reach
    Python; flows without any have no row."""

    @F.pandas_udf("ja3 string, ja3s string, hassh string")
    def marks(frames: pd.Series, ssh: pd.Series) -> pd.DataFrame:
        rows = [(ja3(b), ja3s(b), hassh(b) if s else None) for b, s in ((bytes(f), s) for f, s in zip(frames, ssh))]
        return pd.DataFrame(rows, columns=["ja3", "ja3s", "hassh"])

    ssh = F.coalesce((F.col("src_port") == 22) | (F.col("dst_port") == 22), F.lit(False))
    rows = packets.where(F.contains(F.col("bytes"), F.lit(b"\x16\x03").cast("binary")) | ssh).withColumn("_m", marks("bytes", ssh))
    rows = with_flow_key(rows.drop("bytes"))
    first = lambda c: F.min_by(F.col(f"_m.{c}"), F.when(F.col(f"_m.{c}").isNotNull(), F.col("no"))).alias(c)
    return rows.groupBy(*FLOW).agg(*(first(c) for c in ("ja3", "ja3s", "hassh"))).where("ja3 is not null or ja3s is not null or hassh is not null")


def system_guesses(packets: DataFrame) -> DataFrame:
    """D-OS: the operating system of each source by its first TCP frame whose time to live and window tell."""
    ttl, window = _number(F.lit(22), 1), _number(F.lit(48), 2)
    guess = F.lit(None).cast("string")
    for t, w, name in reversed(SYSTEMS):
        guess = F.when((ttl == t) & (F.lit(True) if w is None else window == w), name).otherwise(guess)
    rows = packets.where((F.upper("protocol") == "TCP") & (F.length("bytes") >= 50)).select("no", "timestamp", "src", guess.alias("os"), ttl.alias("ttl"), window.alias("window")).where("os is not null")
    return rows.groupBy("src").agg(F.min_by(F.struct("os", "ttl", "window", "no"), F.struct(*ORDER)).alias("_g")).select("src", "_g.*")


def with_systems(hosts: DataFrame, guesses: DataFrame) -> DataFrame:
    """Hosts with the guess of their operating system."""
    return hosts.join(guesses.select(F.col("src").alias("_src"), "os"), F.col("ip") == F.col("_src"), "left").drop("_src")


def strobes(packets: DataFrame, count: int = 100, seconds: float = 1.0) -> DataFrame:
    """Flows with whether their latest packet ends a second of more than so many packets. Only the last second of
    each flow is looked at, so flows of any length cost one aggregation and one join."""
    rows = with_flow_key(packets.select("no", "timestamp", "src", "dst", "src_port", "dst_port", "protocol", "vlan_id"))
    last = rows.groupBy(*(F.col(c).alias(f"_l_{c}") for c in FLOW)).agg(F.max("timestamp").alias("_last"))
    near = rows.join(last, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in FLOW]).where(F.col("_last") - F.col("timestamp") <= seconds)
    return near.groupBy(*FLOW).agg((F.count("*") > count).alias("strobe"))


def syn_bursts(packets: DataFrame, count: int = 51, seconds: float = 1.0) -> DataFrame:
    """D-SYNF: sources with more than 50 connection requests within a second: what marks their flows as anomalous."""
    flags = tcp_flags()
    rows = packets.where((flags.bitwiseAND(2) != 0) & (flags.bitwiseAND(0x10) == 0)).select("no", "timestamp", "src")
    return latched(rows, ["src"], count, seconds).select("src").distinct().withColumn("tcp_anomaly", F.lit(True))


def dns_latency(packets: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Milliseconds from the latest request to its answer, by client, server and id; a request is answered once
    and lapses after 30 seconds. Each answer looks at its predecessor among the key's messages."""
    m = messages(packets, named=False)
    ask = ~F.col("response") & (F.col("dst_port") == 53)
    rows = m.where(ask | (F.col("response") & (F.col("src_port") == 53)))
    end = lambda a, b: F.when(F.col("response"), F.col(a)).otherwise(F.col(b))
    rows = rows.select("no", "timestamp", "response", end("dst", "src").alias("client"), end("src", "dst").alias("target"), "id")
    paired = previous(rows, ["client", "target", "id"], {"_asked": F.col("timestamp"), "_was": F.col("response")})
    wait = F.col("timestamp") - F.col("_asked")
    return paired.where(F.col("response") & ~F.col("_was") & (wait <= seconds)).select("no", "timestamp", F.lit("dns").alias("kind"), "target", (F.greatest(wait, F.lit(0.0)) * 1000).alias("latency_ms"))
