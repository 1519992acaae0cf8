"""Detectors: packets in, one row for each alert out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.packet import is_internal, is_syn
from netloom.operators.windows import latched

#: What an alert says of a packet: detectors carry no more than that.
SHOWN = ("no", "timestamp", "src", "dst", "dst_port")

#: Ports of administrative services.
ADMIN_PORTS = (22, 135, 139, 445, 3389, 5985, 5986)
RANK = {"CRIT": 100, "HIGH": 80, "MED": 50}


def _alerts(rows: DataFrame, signature: str, severity: str, detail: Column, key: Column) -> DataFrame:
    return rows.select("no", "timestamp", F.lit("IDS").alias("source"), F.lit(signature).alias("signature"), F.lit(severity).alias("severity"), detail.alias("detail"), key.alias("correlation_key"))


#: What an FTP server says to a wrong log-in.
REFUSED = ("530 Login incorrect", "530 Failed")


def vertical_scan(packets: DataFrame, ports: int = 12, seconds: float = 15.0) -> DataFrame:
    """One source probes many ports of one target. Re-arms when the source pauses."""
    found = latched(packets.where(is_syn()).select(*SHOWN), ["src", "dst"], ports, seconds, "dst_port", ["src"])
    return _alerts(found, "Vertical port scan", "HIGH", F.concat_ws(" ", "src", F.lit("->"), "dst"), F.concat_ws("|", "src", "dst"))


def horizontal_scan(packets: DataFrame, hosts: int = 12, seconds: float = 15.0) -> DataFrame:
    """One source probes one port of many targets. Re-arms when the source pauses."""
    found = latched(packets.where(is_syn()).select(*SHOWN), ["src", "dst_port"], hosts, seconds, "dst", ["src"])
    return _alerts(found, "Horizontal host scan", "HIGH", F.concat_ws(" ", "src", F.lit("port"), F.col("dst_port").cast("string")), F.concat_ws("|", "src", F.col("dst_port").cast("string")))


def syn_flood(packets: DataFrame, count: int = 100, seconds: float = 1.0) -> DataFrame:
    """Many connection requests to one service."""
    found = latched(packets.where(is_syn()).select(*SHOWN), ["dst", "dst_port"], count, seconds)
    return _alerts(found, "SYN flood", "CRIT", F.concat_ws(":", "dst", F.col("dst_port").cast("string")), F.concat_ws("|", "dst", F.col("dst_port").cast("string")))


def admin_fan_out(packets: DataFrame, hosts: int = 8, seconds: float = 60.0) -> DataFrame:
    """One source reaches many internal hosts on an administrative port."""
    rows = packets.where(F.col("dst_port").isin(*ADMIN_PORTS) & is_internal(F.col("src")) & is_internal(F.col("dst"))).select(*SHOWN)
    found = latched(rows, ["src", "dst_port"], hosts, seconds, "dst")
    return _alerts(found, "Administrative service fan-out", "HIGH", F.concat_ws(" ", "src", F.lit("port"), F.col("dst_port").cast("string")), F.concat_ws("|", "src", F.col("dst_port").cast("string")))


def auth_burst(packets: DataFrame, attempts: int = 5, seconds: float = 30.0) -> DataFrame:
    """D-BF: repeated log-ins to SSH, refused FTP log-ins either way, refused HTTP requests or NTLM over SMB; once for each
    source and service. An answer from port 21 counts where its own destination is none of the services' ports."""
    text = F.decode(F.col("bytes"), "ISO-8859-1")
    ntlm = F.contains(F.lower(text), F.lit("ntlmssp"))
    refused = reduce(lambda a, b: a | b, (F.contains(F.substring(text, 55, 1 << 20), F.lit(t)) for t in REFUSED))
    ftp = (F.col("dst_port") == 21) | ((F.col("src_port") == 21) & ~F.coalesce(F.col("dst_port").isin(22, 80, 443, 445), F.lit(False)))
    service = F.when(F.col("dst_port") == 22, F.lit("SSH")).when(ftp & refused, F.lit("FTP")).when(F.col("dst_port").isin(80, 443) & F.col("info").contains("401"), F.lit("HTTP")).when((F.col("dst_port") == 445) & ntlm, F.lit("SMB"))
    rows = packets.withColumn("service", service).where("service is not null").select(*SHOWN, "service")
    found = latched(rows, ["src", "dst", "dst_port"], attempts, seconds, once=True)
    return _alerts(found, "Authentication burst", "HIGH", F.concat_ws(" ", "service", "src", F.lit("->"), "dst"), F.concat_ws("|", "src", "dst", F.col("dst_port").cast("string")))


def correlated(alerts: DataFrame) -> DataFrame:
    """Alerts of one source, signature and key as one finding, with its latest detail and highest priority."""
    priority = F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("severity")], F.lit(20))
    rows = alerts.withColumn("priority", priority)
    return rows.groupBy("source", "signature", "correlation_key").agg(
        F.count("*").alias("hit_count"), F.min("no").alias("first_no"), F.max("no").alias("last_no"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.max_by("detail", "no").alias("detail"), F.max("priority").alias("priority")
    )
