"""Summaries of a packet table: flows, hosts, conversations, time lines, sizes, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The size classes of the histogram.
SIZES = ((0, 63), (64, 127), (128, 255), (256, 511), (512, 767), (768, 1023), (1024, 1279), (1280, 1500), (1501, None))
FLOW = ("a_ip", "a_port", "b_ip", "b_port", "protocol", "vlan_id")


def with_flow_key(packets: DataFrame) -> DataFrame:
    """a and b are the smaller and the larger end of the packet."""
    src, dst = F.struct(F.col("src").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dst_port").alias("port"))
    a, b = F.when(src <= dst, src).otherwise(dst), F.when(src <= dst, dst).otherwise(src)
    return packets.withColumns({"a_ip": a.ip, "a_port": a.port, "b_ip": b.ip, "b_port": b.port})


def flows(packets: DataFrame) -> DataFrame:
    """A1: one row for each pair of ends, protocol and VLAN. Bytes out are the first sender's. Sums are kept for
    either end, so that one aggregation does: who was first is known only when all is summed."""
    rows = with_flow_key(packets.select("no", "timestamp", "src", "dst", "src_port", "dst_port", "protocol", "vlan_id", "length"))
    from_a = (F.col("src") == F.col("a_ip")) & F.col("src_port").eqNullSafe(F.col("a_port"))
    sums = rows.withColumn("from_a", from_a).groupBy(*FLOW).agg(
        F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.sum(F.when(F.col("from_a"), F.col("length")).otherwise(0)).alias("a_bytes"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min_by("from_a", F.struct("timestamp", "no")).alias("a_first"),
    )
    out = F.when(F.col("a_first"), F.col("a_bytes")).otherwise(F.col("bytes") - F.col("a_bytes"))
    duration = F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(0.001))
    return sums.select(*FLOW, "packets", "bytes", out.alias("bytes_out"), (F.col("bytes") - out).alias("bytes_in"), "first_seen", "last_seen", (F.col("bytes") / duration).alias("throughput"), (F.col("bytes") > 1_000_000).alias("is_large"), (F.col("last_seen") - F.col("first_seen") > 300).alias("is_long"))


def hosts(packets: DataFrame) -> DataFrame:
    """A5: bytes and packets in and out of each address, its ports and protocols. Empty and 0.0.0.0 are no hosts."""
    end = lambda ip, out: F.struct(F.col(ip).alias("ip"), F.lit(out).alias("out"))
    rows = packets.select(F.explode(F.array(end("src", True), end("dst", False))).alias("end"), "timestamp", "length", "dst_port", "protocol").select("end.*", "timestamp", "length", "dst_port", "protocol")
    side = lambda out, x: F.sum(F.when(F.col("out") == out, x).otherwise(0))
    return rows.where("ip not in ('', '0.0.0.0')").groupBy("ip").agg(
        side(True, F.col("length")).alias("bytes_out"), side(False, F.col("length")).alias("bytes_in"), side(True, F.lit(1)).alias("packets_out"), side(False, F.lit(1)).alias("packets_in"),
        F.array_sort(F.collect_set("dst_port")).alias("ports"), F.array_sort(F.collect_set("protocol")).alias("protocols"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )


def edges(packets: DataFrame) -> DataFrame:
    """Directed pairs with packets, bytes and the latest protocol."""
    return packets.groupBy("src", "dst").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.max_by("protocol", "no").alias("protocol"))


def timeline(packets: DataFrame, seconds: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Packets and bytes in tumbling buckets, late rows in the bucket of their time."""
    bucket = F.floor(F.col("timestamp") / seconds) * F.lit(seconds)
    return packets.groupBy(bucket.alias("bucket"), *by).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def protocols(packets: DataFrame) -> DataFrame:
    """Packets of each protocol and their share in percent; the total is one more sum over the few groups."""
    counts = packets.groupBy("protocol").agg(F.count("*").alias("packets"))
    from pyspark.sql import Window

    return counts.withColumn("percent", 100 * F.col("packets") / F.sum("packets").over(Window.partitionBy(F.lit(1))))


def conversations(packets: DataFrame) -> DataFrame:
    """Unordered pairs and protocol."""
    return packets.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "protocol").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def totals(packets: DataFrame, key: str) -> DataFrame:
    """Packets and bytes of each value."""
    return packets.groupBy(key).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def sizes(packets: DataFrame) -> DataFrame:
    """Packets of each size class, empty classes included."""
    name = lambda lo, hi: f"{lo}-{hi}" if hi else f"{lo}+"
    sums = [F.count_if((F.col("length") >= lo) & ((F.col("length") <= hi) if hi else F.lit(True))).alias(name(lo, hi)) for lo, hi in SIZES]
    pairs = ", ".join(f"'{name(lo, hi)}', `{name(lo, hi)}`" for lo, hi in SIZES)
    return packets.agg(*sums).selectExpr(f"stack({len(SIZES)}, {pairs}) as (size, packets)")


def summary(packets: DataFrame) -> DataFrame:
    """One row over all packets."""
    return packets.agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.avg("length").alias("mean_size"), (F.max("timestamp") - F.min("timestamp")).alias("duration"))


def vlans(packets: DataFrame) -> DataFrame:
    """Traffic of each VLAN; a host is an address with its hardware address."""
    host = F.concat_ws("/", "src", F.hex(F.substring("bytes", 7, 6)))
    return packets.where("vlan_id is not null").groupBy("vlan_id").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.count_distinct(host).alias("hosts"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def scanners(packets: DataFrame, targets: int = 5) -> DataFrame:
    """A4: sources that reached at least so many (address, port) pairs."""
    return packets.groupBy("src").agg(F.count_distinct(F.struct("dst", "dst_port")).alias("targets")).where(F.col("targets") >= targets)


IDENTITY = ("protocol", "src", "dst", "src_port", "dst_port", "length")


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Kinds of packets, by structure and not by time, that right lacks, each with its last packet."""
    kinds = left.groupBy(*IDENTITY).agg(F.max("no").alias("no"))
    seen = right.select(*(F.col(c).alias(f"of_{c}") for c in IDENTITY)).distinct()
    return kinds.join(seen, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in IDENTITY], "left_anti")


def deltas(first: DataFrame, second: DataFrame) -> DataFrame:
    """Packets of each protocol and destination port, and bytes of each source, in two sets of packets: kind, value,
    first, second. One aggregation over both sets, a row of three for each packet, reduced before its shuffle."""
    part = lambda kind, c, n: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"), n.cast("long").alias("n"))
    each = F.inline(F.array(part("protocol", "protocol", F.lit(1)), part("source", "src", F.col("length")), part("port", "dst_port", F.lit(1))))
    both = first.select(F.lit(True).alias("_first"), each).unionByName(second.select(F.lit(False).alias("_first"), each)).where("value is not null")
    side = lambda is_first, name: F.sum(F.when(F.col("_first") == is_first, F.col("n")).otherwise(0)).alias(name)
    return both.groupBy("kind", "value").agg(side(True, "first"), side(False, "second"))


def nodes(packets: DataFrame) -> DataFrame:
    """Packets and bytes that each address sent and received."""
    end = lambda ip, out: F.struct(F.col(ip).alias("ip"), F.lit(out).alias("out"))
    rows = packets.select(F.explode(F.array(end("src", True), end("dst", False))).alias("end"), "length").select("end.*", "length")
    side = lambda out, x: F.sum(F.when(F.col("out") == out, x).otherwise(0))
    return rows.groupBy("ip").agg(side(True, F.lit(1)).alias("tx_packets"), side(True, F.col("length")).alias("tx_bytes"), side(False, F.lit(1)).alias("rx_packets"), side(False, F.col("length")).alias("rx_bytes"))


def encrypted(packets: DataFrame, bits: float = 7.2, least: int = 20) -> DataFrame:
    """A2: flows with whether their latest packet, if it is over so many bytes, looks encrypted by its entropy. Each
    packet's entropy is a number before the flows are grouped, so no payload is shuffled."""
    from netloom.functions.text import entropy

    high = F.when(F.length("bytes") > least, entropy(F.col("bytes")) > bits).otherwise(False)
    rows = with_flow_key(packets.select("no", "timestamp", "src", "dst", "src_port", "dst_port", "protocol", "vlan_id", high.alias("_high")))
    return rows.groupBy(*FLOW).agg(F.max_by("_high", F.struct("timestamp", "no")).alias("is_encrypted"))


def ports(packets: DataFrame) -> DataFrame:
    """Packets and bytes of each destination port, with its service's name."""
    from netloom.operators.decode import TCP_PORTS, service_name

    return totals(packets, "dst_port").withColumn("service", service_name(TCP_PORTS, F.col("dst_port"), F.col("dst_port"), "TCP"))


def inventory(packets: DataFrame, ranges: DataFrame) -> DataFrame:
    """A5: hosts with the names in the summaries of what they sent, the latest hardware address that ARP gives them, and
    the place of their address (see enrich.places)."""
    from netloom.functions import text as T
    from netloom.operators.enrich import places

    base = hosts(packets)
    named = packets.where("protocol in ('DNS', 'mDNS', 'HTTP', 'HTTPS')").select(F.col("src").alias("_n"), T.domain(F.col("info")).alias("name")).where("name is not null")
    names = named.groupBy("_n").agg(F.array_sort(F.collect_set("name")).alias("hostnames"))
    arp = packets.where((F.hex(F.substring("bytes", 13, 2)) == "0806") & (F.length("bytes") >= 42)).select("no", T.dotted(F.substring("bytes", 29, 4)).alias("_m"), T.mac(F.substring("bytes", 23, 6)).alias("mac"))
    macs = arp.groupBy("_m").agg(F.max_by("mac", "no").alias("mac"))
    where = places(base.select(F.col("ip").alias("address")), ranges).withColumnRenamed("address", "_p")
    out = base.join(names, F.col("ip") == F.col("_n"), "left").join(macs, F.col("ip") == F.col("_m"), "left").join(where, F.col("ip") == F.col("_p"), "left")
    return out.drop("_n", "_m", "_p")
