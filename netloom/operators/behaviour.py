"""Behaviour over time: regular beacons, large and high-entropy transfers, DNS abuse, odd flags, handshake latency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.functions.packet import contains, is_internal, tcp_flags
from netloom.operators.detect import _alerts
from netloom.operators.traffic import FLOW, with_flow_key
from netloom.operators.windows import ORDER, first_of, last_of, latched, previous, reaching, running, sessions, with_lookback

PAIR = ("src", "src_port", "dst", "dst_port", "protocol")


def _spread(x: Column) -> Column:
    """Standard deviation over the mean, 1 at most; 1 if the mean is not positive."""
    return F.when(F.avg(x) > 0, F.least(F.stddev_pop(x) / F.avg(x), F.lit(1.0))).otherwise(1.0)


def beacon_scores(packets: DataFrame, last: int = 60) -> DataFrame:
    """A2, A3: each flow's regularity from 0 to 1: half for even intervals, 0.3 for even sizes, 0.2 for a minute's
    duration. Looks at the last 60 intervals of over a millisecond and the last 60 sizes; fewer than five
    intervals or a mean below half a second score 0. Flows of too few packets go before the ranking."""
    rows = with_flow_key(packets.select("no", "timestamp", "src", "dst", "src_port", "dst_port", "protocol", "vlan_id", "length"))
    rows = rows.select("no", "timestamp", *FLOW, "length")
    gap = F.col("timestamp") - F.col("_before")
    gaps = previous(rows, FLOW, {"_before": F.col("timestamp")}).where((gap > 0.001) & (F.col("_before") > 0)).select("no", "timestamp", *FLOW, gap.alias("interval"))
    none = F.lit(None).cast("double")
    parts = [
        last_of(gaps, FLOW, last).select(*FLOW, "interval", none.alias("length"), none.alias("first"), none.alias("final")),
        last_of(rows, FLOW, last).select(*FLOW, none.alias("interval"), F.col("length").cast("double").alias("length"), none.alias("first"), none.alias("final")),
        rows.groupBy(*FLOW).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("final")).select(*FLOW, none.alias("interval"), none.alias("length"), "first", "final"),
    ]
    gap, size = F.col("interval"), F.col("length")
    facts = reduce(DataFrame.unionByName, parts).groupBy(*FLOW).agg(F.count(gap).alias("n"), F.avg(gap).alias("mean"), _spread(gap).alias("cv"), F.count(size).alias("n_sizes"), _spread(size).alias("cv_size"), (F.max("final") - F.min("first")).alias("duration"))
    even_sizes = F.when(F.col("n_sizes") >= 5, 1 - F.col("cv_size")).otherwise(0.5)
    score = 0.5 * (1 - F.col("cv")) + 0.3 * even_sizes + 0.2 * F.least(F.col("duration") / 60, F.lit(1.0))
    score = F.when((F.col("n") >= 5) & (F.col("mean") >= 0.5), score).otherwise(0.0)
    return facts.select(*FLOW, score.alias("beacon_score"), (score > 0.7).alias("is_beacon"))


def beacons(packets: DataFrame, samples: int = 7) -> DataFrame:
    """A directed flow whose last 32 packets come at even intervals (spread 0.15) in even sizes (0.10), over
    half a minute or more and a second or more apart; the first such packet of each session of an hour."""
    rows = reaching(packets.where("src_port is not null and dst_port is not null"), list(PAIR), samples)
    rows = sessions(rows, list(PAIR), 3600.0)
    rows = with_lookback(rows.drop("bytes"), [*PAIR, "session"], 31)
    key = Window.partitionBy(*PAIR, "session", "_bucket").orderBy(*ORDER)
    lately, inner = key.rowsBetween(-31, 0), key.rowsBetween(-30, 0)
    gap = F.col("timestamp") - F.lag("timestamp").over(key)
    rows = rows.withColumn("_gap", F.when(gap > 0, gap))
    # the first of the 32 packets gives no interval
    enough = (F.count("_gap").over(inner) + 1 >= samples) & (F.col("timestamp") - F.min("timestamp").over(lately) >= 30) & (F.avg("_gap").over(inner) >= 1)
    even = (F.stddev_pop("_gap").over(inner) <= 0.15 * F.avg("_gap").over(inner)) & (F.stddev_pop("length").over(lately) <= 0.10 * F.avg("length").over(lately)) & (F.avg("length").over(lately) > 0)
    found = first_of(rows.withColumn("_hit", enough & even).where("_hit and not _lent").drop("_hit", "_gap", "_lent", "_bucket"), [*PAIR, "session"])
    port = F.col("dst_port").cast("string")
    return _alerts(found, "Periodic command-and-control beacon", "HIGH", F.concat_ws(" ", "src", F.lit("->"), F.concat_ws(":", "dst", port)), F.concat_ws("|", *PAIR))


def _outbound(packets: DataFrame) -> DataFrame:
    """Packets between an internal and an external end, with running sums of the session's bytes each way."""
    out = is_internal(F.col("src"))
    rows = packets.withColumn("outbound", out).where(out != is_internal(F.col("dst")))
    ends = {"internal": F.when(F.col("outbound"), F.col("src")).otherwise(F.col("dst")), "external": F.when(F.col("outbound"), F.col("dst")).otherwise(F.col("src")), "service": F.coalesce(F.when(F.col("outbound"), F.col("dst_port")).otherwise(F.col("src_port")), F.lit(0))}
    return rows.withColumns(ends)


TRANSFER = ["internal", "external", "service", "protocol"]


def outbound_volume(packets: DataFrame, volume: int = 1_000_000, ratio: float = 10.0) -> DataFrame:
    """So many bytes from an internal to an external end, ten times what came back; once a session of an hour."""
    n = F.col("length").cast("long")
    rows = sessions(_outbound(packets), TRANSFER, 3600.0)
    sums = running(rows, [*TRANSFER, "session"], {"sent": F.when(F.col("outbound"), n).otherwise(0), "received": F.when(F.col("outbound"), 0).otherwise(n)})
    hit = F.col("outbound") & (F.col("sent") >= volume) & (F.col("sent") / F.greatest("received", F.lit(1)) >= ratio)
    found = first_of(sums.where(hit), [*TRANSFER, "session"])
    return _alerts(found, "Large asymmetric outbound transfer", "HIGH", F.concat_ws(" ", "src", F.lit("sent"), F.col("sent").cast("string"), F.lit("bytes to"), "dst"), F.concat_ws("|", *(F.col(c).cast("string") for c in TRANSFER)))


def outbound_entropy(packets: DataFrame, volume: int = 262_144, bits: float = 7.2) -> DataFrame:
    """So many bytes sent out in packets of high entropy, four fifths of all sent; once a session of an hour."""
    n = F.col("length").cast("long")
    high = F.col("outbound") & (F.length("bytes") >= 64) & (T.entropy(F.col("bytes")) >= bits)
    rows = sessions(_outbound(packets).withColumn("high", F.coalesce(high, F.lit(False))), TRANSFER, 3600.0)
    sums = running(rows, [*TRANSFER, "session"], {"sent": F.when(F.col("outbound"), n).otherwise(0), "hidden": F.when(F.col("high"), n).otherwise(0)})
    hit = F.col("outbound") & (F.col("hidden") >= volume) & (F.floor(F.col("hidden") * 100 / F.greatest("sent", F.lit(1))) >= 80)
    found = first_of(sums.where(hit), [*TRANSFER, "session"])
    return _alerts(found, "High-entropy outbound transfer", "HIGH", F.concat_ws(" ", "src", F.lit("sent"), F.col("hidden").cast("string"), F.lit("high-entropy bytes")), F.concat_ws("|", *(F.col(c).cast("string") for c in TRANSFER)))


def is_dns() -> Column:
    return contains("protocol", "dns") | F.coalesce((F.col("src_port") == 53) | (F.col("dst_port") == 53), F.lit(False))


def nxdomain_burst(packets: DataFrame, replies: int = 20, seconds: float = 30.0) -> DataFrame:
    """A client gets many answers that a name doesn't exist."""
    client = F.when(F.col("src_port") == 53, F.col("dst")).otherwise(F.col("src"))
    found = latched(packets.where(is_dns() & contains("info", "nxdomain")).withColumn("client", client), ["client"], replies, seconds)
    return _alerts(found, "DNS NXDOMAIN burst", "MED", F.concat_ws(" ", "client", F.lit("received NXDOMAIN replies")), F.col("client"))


def large_txt(packets: DataFrame, size: int = 512) -> DataFrame:
    """Large DNS text records."""
    return _alerts(packets.where(is_dns() & contains("info", "txt") & (F.col("length") > size)), "Oversized DNS TXT traffic", "MED", F.concat_ws(" ", "src", F.lit("->"), "dst"), F.concat_ws("|", "src", "dst"))


def external_resolver(packets: DataFrame, port: int = 53, seconds: float = 3600.0) -> DataFrame:
    """An internal host asks an external resolver; a pair is new again after an hour without a packet."""
    rows = packets.where((F.col("dst_port") == port) & is_internal(F.col("src")) & ~is_internal(F.col("dst")))
    found = first_of(sessions(rows, ["src", "dst"], seconds), ["src", "dst", "session"])
    return _alerts(found, "Direct external DNS resolver use", "LOW", F.concat_ws(" ", "src", F.lit("asks"), "dst"), F.concat_ws("|", "src", "dst"))


def ntlm_fan_out(packets: DataFrame, hosts: int = 3, seconds: float = 300.0, mark: str = "NTLMSSP") -> DataFrame:
    """An internal host authenticates to several hosts by NTLM."""
    marked = F.contains(F.lower(F.decode(F.col("bytes"), "ISO-8859-1")), F.lit(mark.lower()))
    found = latched(packets.where(marked & is_internal(F.col("src"))), ["src"], hosts, seconds, "dst")
    return _alerts(found, "NTLM authentication fan-out", "HIGH", F.concat_ws(" ", "src", F.lit("to several hosts")), F.col("src"))


def icmp_sweep(packets: DataFrame, hosts: int = 12, seconds: float = 15.0) -> DataFrame:
    """Echo requests to many hosts."""
    rows = packets.where((F.upper("protocol") == "ICMP") & contains("info", "echo request"))
    return _alerts(latched(rows, ["src"], hosts, seconds, "dst"), "ICMP address sweep", "MED", F.concat_ws(" ", "src", F.lit("probes many hosts")), F.col("src"))


def stealth_probe(packets: DataFrame) -> DataFrame:
    """TCP segments without flags, with FIN alone, or with FIN, PSH and URG but none of SYN, ACK and RST."""
    flags = tcp_flags().bitwiseAND(0x3F)
    kind = F.when(flags == 0, "NULL").when(flags == 1, "FIN").when(flags.bitwiseAND(0x3F) == 0x29, "Xmas")
    return _alerts(packets.withColumn("_kind", kind).where("_kind is not null"), "TCP stealth scan probe", "MED", F.concat_ws(" ", "_kind", F.lit("probe"), "src", F.lit("->"), "dst"), F.concat_ws("|", "src", "dst"))


def illegal_flags(packets: DataFrame) -> DataFrame:
    """SYN together with FIN or RST."""
    flags = tcp_flags()
    return _alerts(packets.where((flags.bitwiseAND(2) != 0) & (flags.bitwiseAND(5) != 0)), "Illegal TCP flag combination", "HIGH", F.concat_ws(" ", T.flag_names(flags), "src", F.lit("->"), "dst"), F.concat_ws("|", "src", "dst"))


def handshakes(packets: DataFrame, seconds: float = 30.0, gateway: str | None = None) -> DataFrame:
    """Milliseconds from the latest SYN to its answer, for each answered connection request.

    A request is answered once; only requests of the last 30 seconds count. Each answer looks at its predecessor
    among the four-tuple's requests and answers, so no request meets more than one answer.
    """
    flags = tcp_flags()
    rows = packets.withColumn("_answer", F.when(flags.bitwiseAND(0x12) == 0x12, True).when(flags.bitwiseAND(0x12) == 2, False)).where("_answer is not null and src_port is not null and dst_port is not null")
    end = lambda a, b: F.when(F.col("_answer"), F.col(a)).otherwise(F.col(b))
    rows = rows.select("no", "timestamp", "_answer", end("dst", "src").alias("client"), end("src", "dst").alias("target"), end("dst_port", "src_port").alias("client_port"), end("src_port", "dst_port").alias("port"))
    paired = previous(rows, ["client", "target", "client_port", "port"], {"_asked": F.col("timestamp"), "_was_answer": F.col("_answer")})
    wait = F.col("timestamp") - F.col("_asked")
    kind = F.when(F.col("target") == F.lit(gateway), "gateway").otherwise("handshake")
    return paired.where(F.col("_answer") & ~F.col("_was_answer") & (wait <= seconds)).select("no", "timestamp", kind.alias("kind"), "target", (F.greatest(wait, F.lit(0.0)) * 1000).alias("latency_ms"))


#: Upper ends of the latency classes in milliseconds.
CLASSES_MS = (1, 10, 50, 100, 250)


def latency_summary(samples: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Samples, median and 95th percentile (the value at the rounded place, not an interpolation), and classes.
    Equal latencies are counted before they are placed, and the places come from running sums over buckets."""
    counts = samples.groupBy(*by, "latency_ms").agg(F.count("*").alias("_n"))
    totals = samples.groupBy(*(F.col(c).alias(f"_t_{c}") for c in by)).agg(F.count("*").alias("_all"))
    # buckets of ten milliseconds stand for time: a kind's latencies are as many groups as it has of these
    spread = running(counts.withColumns({"timestamp": F.col("latency_ms"), "no": F.lit(0)}), list(by), {"_upto": F.col("_n")}, 10.0)
    placed = spread.join(totals, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by])
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * q + 0.5), F.col("latency_ms")))
    edges = [None, *CLASSES_MS, None]
    name = lambda lo, hi: f"below_{hi}" if lo is None else f"from_{lo}"
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col("latency_ms") >= lo) & (F.lit(True) if hi is None else F.col("latency_ms") < hi)
    classes = [F.sum(F.when(inside(lo, hi), F.col("_n")).otherwise(0)).alias(name(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:])]
    return placed.groupBy(*by).agg(F.sum("_n").alias("samples"), at(0.5).alias("median_ms"), at(0.95).alias("p95_ms"), *classes)
