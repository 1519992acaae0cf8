"""Links and neighbours: VLAN abuse, changed bindings of addresses, IPv6 control messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators.decode import _kept
from netloom.operators.detect import _alerts
from netloom.operators.fields import _cut, _number, layout
from netloom.operators.windows import first_of, latched, previous, sessions, spaced_by
from netloom.sources.scratch import kept

#: Fixed value: the address that trunk negotiation frames are sent to.
DTP = bytes([0x01, 0x00, 0x0C, 0xCC, 0xCC, 0xCC])


def spaced(alerts: DataFrame, distance: int = 1000) -> DataFrame:
    """An alert of a key only if it is the first or `distance` packets or more after the last one that was let
    through. Keys are cut where no alert of theirs comes for that long: the next one is let through anyway."""

    # a gap between numbers, as sessions does with time: what is before the gap can't suppress what is after it
    numbered = alerts.withColumns({"_t": F.col("timestamp"), "timestamp": F.col("no").cast("double")})
    cut = kept(sessions(numbered, ["correlation_key"], distance - 0.5).withColumn("timestamp", F.col("_t")).drop("_t"))
    keys = ["correlation_key", "session"]
    let = spaced_by(cut, keys, "no", distance).withColumnsRenamed({"correlation_key": "_key", "session": "_session", "place": "_no"})
    once = cut.groupBy(*keys, "no").agg(F.min(F.struct(*(c for c in alerts.columns if c not in (*keys, "no")))).alias("_row")).select(*keys, "no", "_row.*")
    through = [F.col("correlation_key").eqNullSafe(F.col("_key")), F.col("session") == F.col("_session"), F.col("no") == F.col("_no")]
    return once.join(let.hint("merge"), through, "left_semi").select(*alerts.columns)


def vlan_alerts(packets: DataFrame, distance: int = 1000) -> DataFrame:
    """D-V1, D-V2, D-V3, D-V5: trunk negotiation, double tags, the native VLAN, the highest priority; spaced by key."""
    mac = T.mac(F.substring("bytes", 7, 6))
    num = lambda c: F.col(c).cast("string")
    kinds = [
        (F.substring("bytes", 1, 6) == F.lit(DTP).cast("binary"), "DTP", "CRIT", F.concat(F.lit("DTP frame from "), mac), F.concat(F.lit("DTP:"), mac)),
        (F.col("outer_vlan_id").isNotNull() & F.col("vlan_id").isNotNull(), "VLAN-Hop", "CRIT", F.concat_ws(" ", F.lit("double tag"), num("outer_vlan_id"), num("vlan_id"), F.col("src")), F.concat_ws(":", F.lit("QINQ"), num("outer_vlan_id"), num("vlan_id"))),
        (F.col("vlan_id") == 1, "Native-VLAN", "WARN", F.concat(F.lit("VLAN 1 used by "), F.col("src")), F.lit("NATIVE_VLAN1")),
        ((F.col("vlan_pcp") == 7) & F.col("vlan_id").isNotNull(), "PCP-Abuse", "WARN", F.concat_ws(" ", F.lit("priority 7 from"), F.col("src"), num("vlan_id")), F.concat_ws(":", F.lit("PCP7"), F.col("src"), num("vlan_id"))),
    ]
    hit = lambda c, name, severity, detail, key: F.when(c, F.struct(F.lit("VLAN").alias("source"), F.lit(name).alias("signature"), F.lit(severity).alias("severity"), detail.alias("detail"), key.alias("correlation_key")))
    return spaced(packets.select("no", "timestamp", F.inline(F.array_compact(F.array(*(hit(*k) for k in kinds))))), distance)


def mac_on_vlans(packets: DataFrame) -> DataFrame:
    """D-V4, W12: the packet that shows an address on a second VLAN, once. First packets by (address, VLAN) are
    aggregated before they are ordered, so a window sees a row for each VLAN of an address."""
    rows = packets.where("vlan_id is not null and length(bytes) >= 12").withColumn("mac", T.mac(F.substring("bytes", 7, 6)))
    first = rows.groupBy("mac", "vlan_id").agg(F.min(F.struct("no", "timestamp")).alias("_at")).select("mac", "vlan_id", "_at.*")
    second = first.withColumn("_k", F.row_number().over(Window.partitionBy("mac").orderBy("no")))
    pair = second.where("_k <= 2").groupBy("mac").agg(F.max("no").alias("no"), F.max_by("timestamp", "no").alias("timestamp"), F.array_sort(F.collect_set("vlan_id")).alias("_vlans")).where("size(_vlans) = 2")
    listed = F.array_join(F.transform("_vlans", lambda v: v.cast("string")), ",")
    return pair.select("no", "timestamp", F.lit("VLAN").alias("source"), F.lit("MAC-VLAN-Cross").alias("signature"), F.lit("WARN").alias("severity"), F.concat_ws(" ", F.lit("MAC"), "mac", F.lit("on VLANs"), listed).alias("detail"), F.concat(F.lit("MAC_CROSS:"), "mac").alias("correlation_key"))


def changed(rows: DataFrame, key: str, value: str, signature: str, severity: str) -> DataFrame:
    """Rows whose value differs from the key's last one; a busy key is many groups (see previous)."""
    known = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).drop("bytes")
    found = previous(known, [key], {"_before": F.col(value)}).where(F.col("_before") != F.col(value))
    return _alerts(found, signature, severity, F.concat_ws(" ", key, F.lit("moved from"), "_before", F.lit("to"), value), F.col(key))


def arp_changes(packets: DataFrame) -> DataFrame:
    """D-ARP: an address answers from another hardware address, by the sender fields of ARP frames or by a summary
    "a is at b"."""
    arp = F.hex(F.substring("bytes", 13, 2)) == "0806"
    said = F.regexp_extract("info", r"^(\S+) is at (\S+)", 1), F.regexp_extract("info", r"^(\S+) is at (\S+)", 2)
    ip = F.when(arp & (F.length("bytes") >= 42), T.dotted(F.substring("bytes", 29, 4))).when(said[0] != "", said[0])
    mac = F.when(arp & (F.length("bytes") >= 42), T.mac(F.substring("bytes", 23, 6))).when(said[1] != "", F.lower(said[1]))
    return changed(packets.withColumns({"ip": ip, "mac": mac}), "ip", "mac", "ARP binding changed", "HIGH")


def ipv6_control(packets: DataFrame, count: int = 20, seconds: float = 1.0) -> DataFrame:
    """Neighbour discovery with a hop limit below 255, router advertisements from no link-local address or
    in floods, and neighbours that change their link-layer address."""
    rows = _kept(layout(packets)).where("_v = 6 and _proto = 58")
    kind = _number(F.col("_l4"), 1)
    rows = _kept(rows.withColumns({"_icmp": kind, "_hops": _number(F.col("_ip") + 7, 1), "_link_local": F.hex(_cut(F.col("_ip") + 8, 2)).rlike("^FE[89AB]"), "mac": T.mac(F.substring("bytes", 7, 6)), "target": F.lower(F.hex(_cut(F.col("_l4") + 8, 16))), "_option": F.hex(_cut(F.col("_l4") + 24, 2)), "_lladdr": T.mac(_cut(F.col("_l4") + 26, 6))}))
    ra = rows.where("_icmp = 134")
    rogue = first_of(sessions(ra.where("not _link_local"), ["mac"], seconds), ["mac", "session"])
    flood = latched(ra, ["mac"], count, seconds)
    moved = rows.where("_icmp = 136").withColumn("link", F.when(F.col("_option") == "0201", F.col("_lladdr")))
    by = lambda rows, name: _alerts(rows, name, "CRIT", F.concat_ws(" ", F.lit("from"), "src", "mac"), F.col("mac"))
    found = [
        by(rows.where("_icmp between 133 and 137 and _hops != 255"), "Invalid IPv6 neighbor discovery hop limit"), by(rogue, "Invalid IPv6 router advertisement source"), by(flood, "IPv6 router advertisement flood"),
        changed(moved, "target", "link", "IPv6 neighbor binding changed", "CRIT"),
    ]
    return reduce(DataFrame.unionByName, found)
