"""Finds of all kinds as one table of findings: indicators, log-ins, routes, rules beside what detectors say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.enrich import drift, routes

FINDING = ("no", "timestamp", "source", "signature", "severity", "detail", "correlation_key")


def _from(rows: DataFrame, source: str, signature, severity, detail, key) -> DataFrame:
    return rows.select("no", "timestamp", F.lit(source).alias("source"), signature.alias("signature"), severity.alias("severity"), detail.alias("detail"), key.alias("correlation_key"))


def from_indicators(hits: DataFrame) -> DataFrame:
    """D-IOC: each hit of an indicator; hits as indicator_hits gives them."""
    return _from(hits, "IOC", F.lit("IOC match"), F.lit("HIGH"), F.concat_ws(" ", "value", F.lit("as"), "context", "description"), F.concat_ws("|", "context", "value"))


def from_credentials(found: DataFrame, packets: DataFrame) -> DataFrame:
    """D-CRED: each log-in that a packet shows; the value itself never enters a finding."""
    rows = found.select("no", "kind").join(packets.select("no", "timestamp", "src", "dst"), "no")
    return _from(rows, "CREDENTIAL", F.lit("Credential exposure"), F.lit("HIGH"), F.concat_ws(" ", "kind", F.lit("from"), "src", F.lit("to"), "dst"), F.concat_ws("|", "kind", "src", "dst"))


def from_drift(packets: DataFrame, baseline: DataFrame, enforce: bool = True) -> DataFrame:
    """D-DRIFT, I9: routes that the baseline lacks, at their first packet, where drift is enforced; none elsewhere, as
    then it is only looked at."""
    there = packets.where("dst_port is not null and dst not in ('', '0.0.0.0')")
    new = drift(routes(packets), baseline)
    first = there.groupBy(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("dst_port").alias("_p"), F.col("protocol").alias("_r")).agg(F.min_by("no", F.struct("timestamp", "no")).alias("no"), F.min("timestamp").alias("timestamp"))
    rows = new.join(first, (F.col("subject") == F.col("_s")) & (F.col("target") == F.col("_d")) & (F.col("port") == F.col("_p")) & (F.col("protocol") == F.col("_r")))
    rows = rows if enforce else rows.limit(0)
    place = F.concat_ws(":", "target", F.col("port").cast("string"))
    return _from(rows, "DRIFT", F.lit("Route drift"), F.lit("HIGH"), F.concat_ws(" ", "subject", F.lit("->"), place, "protocol", "authority"), F.concat_ws("|", "subject", "target", F.col("port").cast("string"), "protocol", "authority"))


def from_rules(hits: DataFrame) -> DataFrame:
    """D-RULE: each action of a user's rule."""
    return _from(hits, "RULE", F.col("signature"), F.col("severity"), F.col("detail"), F.concat_ws("|", "rule_id", "action"))


def from_tunnels(tunnels: DataFrame, first: DataFrame) -> DataFrame:
    """DNS tunnels whose score is enough, at the first query of their domain; first has apex, no, timestamp."""
    rows = tunnels.where("severity is not null").join(first, "apex")
    return _from(rows, "DNS", F.lit("DNS tunnel"), F.col("severity"), F.concat_ws(" ", "apex", F.round("score", 1).cast("string")), F.col("apex"))


def union(*parts: DataFrame) -> DataFrame:
    """All findings as one table."""
    return reduce(DataFrame.unionByName, (p.select(*FINDING) for p in parts))
