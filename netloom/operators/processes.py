"""Packets and the processes that own their sockets; reputation of addresses and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.enrich import identities

ANY = ("0.0.0.0", "::")


def attributed(packets: DataFrame, owners: DataFrame) -> DataFrame:
    """Packets with pid, process and outbound (whether the process sent it); packets of no known socket are left out.

    owners has seq, protocol, local_ip, local_port, remote_ip, remote_port, pid, process; 0.0.0.0, :: and port 0 stand
    for any. The packet's source is tried before its destination, and the newest fitting owner counts. Of a socket's
    owners only the newest can, so it alone is kept, and the join is one of equality: an end asks once for each of the
    at most eight choices of exact and any values that owners have, however many owners share a port. Each packet's
    best match is an aggregation, so nothing is ordered.
    """
    rows = packets.where("src_port is not null and dst_port is not null").withColumn("_proto", F.when(F.upper("protocol") == "UDP", "UDP").otherwise("TCP"))
    side = lambda out, a, b: F.struct(F.lit(out).alias("outbound"), F.col(a).alias("_ip"), F.col(f"{a}_port").alias("_port"), F.col(b).alias("_far"), F.col(f"{b}_port").alias("_far_port"))
    ends = rows.select("no", "timestamp", "length", "_proto", F.inline(F.array(side(True, "src", "dst"), side(False, "dst", "src"))))
    exact = [(1, "_ip", ~F.col("local_ip").isin(*ANY), "local_ip"), (2, "_far", ~F.col("remote_ip").isin(*ANY), "remote_ip"), (4, "_far_port", F.col("remote_port") != 0, "remote_port")]
    any_of = {"_ip": "", "_far": "", "_far_port": 0}
    known = owners.where("local_ip is not null and remote_ip is not null and remote_port is not null").select(
        "seq", F.struct("pid", "process").alias("_owner"), F.upper("protocol").alias("_proto"), F.col("local_port").alias("_port"),
        sum(F.when(e, bit).otherwise(0) for bit, _, e, _ in exact).alias("_exact"), *(F.when(e, F.col(c)).otherwise(F.lit(any_of[name])).alias(name) for _, name, e, c in exact),
    )
    socket = ["_proto", "_port", "_exact", *any_of]
    newest = known.groupBy(*socket).agg(F.max("seq").alias("seq"), F.max_by("_owner", "seq").alias("_owner"))
    asks = ends.crossJoin(F.broadcast(newest.select("_exact").distinct())).withColumns({name: F.when(F.col("_exact").bitwiseAND(bit) != 0, F.col(name)).otherwise(F.lit(any_of[name])) for bit, name, _, _ in exact})
    hits = asks.join(newest, socket)
    best = F.max_by(F.struct("timestamp", "length", F.col("_owner.pid").alias("pid"), F.col("_owner.process").alias("process"), "outbound"), F.struct("outbound", "seq")).alias("_best")
    return hits.groupBy("no").agg(best).select("no", "_best.*")


def process_totals(hits: DataFrame) -> DataFrame:
    """Packets and bytes that each process sent and received, and when it was last seen."""
    side = lambda out, x: F.sum(F.when(F.col("outbound") == out, x).otherwise(0))
    one, size = F.lit(1), F.col("length").cast("long")
    return hits.groupBy("pid").agg(
        F.max_by("process", "no").alias("process"), side(True, size).alias("bytes_out"), side(False, size).alias("bytes_in"), side(True, one).alias("packets_out"), side(False, one).alias("packets_in"), F.max("timestamp").alias("last_seen")
    )


def address_reputation(addresses: DataFrame, reputation: DataFrame) -> DataFrame:
    """Each distinct public address with the severity and label of its longest prefix; others are left out."""
    cidr = F.when(F.col("target").contains("/"), F.col("target")).when(F.col("target").contains(":"), F.concat("target", F.lit("/128"))).otherwise(F.concat("target", F.lit("/32")))
    known = reputation.where("kind = 'address'").select(cidr.alias("cidr"), F.col("severity").alias("asn"), F.col("label").alias("organization"))
    return identities(addresses, known).where("source = 'prefix map'").select("address", F.col("asn").alias("severity"), F.col("organization").alias("label"))


def fingerprint_reputation(sessions: DataFrame, reputation: DataFrame, column: str = "ja4") -> DataFrame:
    """Sessions whose fingerprint is known, whatever the case."""
    known = reputation.where("kind = 'fingerprint'").groupBy(F.lower("target").alias("_of")).agg(F.max("severity").alias("severity"), F.max("label").alias("label"))
    return sessions.withColumn("_of", F.lower(column)).join(known, "_of").drop("_of")
