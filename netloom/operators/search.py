"""Views over several tables: filters of hosts, notes, findings and graphs, one search over all, tags and notes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "__marked__"
#: What a view of one severity shows, priorities, and what to do about findings.
SEVERITIES = {"CRITICAL": ("CRITICAL", "CRIT"), "HIGH": ("HIGH",), "MEDIUM": ("MEDIUM", "MED", "WARN"), "LOW": ("LOW", "INFO")}
PRIORITY = {"CRITICAL": 100, "CRIT": 100, "HIGH": 80, "MEDIUM": 50, "MED": 50, "WARN": 50}
ADVICE_CRITICAL = "Review the triggering packet and retained conversation; require an independent signal before containment"
ADVICE = {
    "IOC": "Validate indicator provenance, then inspect related hosts and conversations",
    "CREDENTIAL": "Confirm exposure, identify the affected identity, and rotate the credential through the owning system",
    "VLAN": "Inspect tag stack and switch-port policy before escalating as VLAN penetration",
}
ADVICE_ELSE = "Inspect packet fields and surrounding stream, then confirm or mark benign"


def tagged(packets: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """packets that carry a tag; tags has no and tag. Marked packets carry the tag MARK."""
    with_it = tags.where(F.col("tag") == tag).select(F.col("no").alias("_no")).distinct()
    return packets.join(with_it, F.col("no") == F.col("_no"), "left_semi")


def of_severity(findings: DataFrame, severity: str) -> DataFrame:
    """findings of a severity under any of its names."""
    return findings.where(F.upper("severity").isin(*SEVERITIES.get({"CRIT": "CRITICAL", "MED": "MEDIUM"}.get(severity.upper(), severity.upper()), (severity.upper(),))))


def _holds(column: Column, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(query.lower())), F.lit(False))


def hosts_like(hosts: DataFrame, query: str) -> DataFrame:
    """F16: hosts whose address, a name, a protocol or a tag holds the text; the last three are lists."""
    test = _holds(F.col("ip"), query)
    for c in ("hostnames", "protocols", "tags"):
        if c in hosts.columns:
            test = test | F.coalesce(F.exists(F.col(c), lambda x: _holds(x, query)), F.lit(False))
    return hosts.where(test)


def notes_like(notes: DataFrame, query: str) -> DataFrame:
    """notes whose text or a tag holds the text."""
    return notes.where(_holds(F.col("text"), query) | F.coalesce(F.exists(F.col("tags"), lambda x: _holds(x, query)), F.lit(False)))


def notes_for(notes: DataFrame, evidence: str) -> DataFrame:
    """the notes about one piece of evidence, which is text like pkt#7."""
    return notes.where(F.col("evidence") == evidence)


def graph_view(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, least: float = 0.0, between: tuple[float, float] | None = None, label: str = "") -> tuple[DataFrame, DataFrame]:
    """nodes of some kinds, with a score, seen at some time, whose label holds a text; edges between two of them."""
    kept = nodes.where(F.col("score") >= least)
    if kinds:
        kept = kept.where(F.col("kind").isin(*kinds))
    if between:
        kept = kept.where((F.col("last_seen") >= between[0]) & (F.col("first_seen") <= between[1]))
    if label:
        kept = kept.where(_holds(F.col("label"), label))
    keys = kept.select(F.col("key").alias("_key"))
    ends = edges.join(keys, F.col("src") == F.col("_key"), "left_semi").join(keys.withColumnRenamed("_key", "_to"), F.col("dst") == F.col("_to"), "left_semi")
    return kept, ends


def search(tables: dict[str, DataFrame], query: str, most: dict[str, int] | None = None) -> DataFrame:
    """what holds a text in any table: source, label, detail, and the place among the source's finds. tables has,
    by source, DataFrames of label, detail, hay (more text to look in, may be empty) and place (what they are ordered
    by). The first so many of each source are the feature; the group limit cuts each task's rows before the shuffle."""
    parts = [df.select(F.lit(name).alias("source"), "label", "detail", F.concat_ws(" ", "label", "detail", "hay").alias("_hay"), F.col("place").cast("string").alias("place")) for name, df in tables.items()]
    found = reduce(DataFrame.unionByName, parts).where(_holds(F.col("_hay"), query))
    limit = F.lit(10)
    for name, n in (most or {"Packet": 20}).items():
        limit = F.when(F.col("source") == name, F.lit(n)).otherwise(limit)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.lpad("place", 20, "0"), "label", "detail"))
    return found.withColumn("rank", rank).where(F.col("rank") <= max(20, *(most or {"Packet": 20}).values())).where(F.col("rank") <= limit).select("source", "rank", "label", "detail")


def searches(tables: dict[str, DataFrame], queries: list[str], most: dict[str, int] | None = None) -> DataFrame:
    """F18 for many texts at once: as search, by query. One automaton looks for all of them in one pass over each table."""
    from netloom.operators.automaton import Pattern, automaton_of

    wanted = [q for q in dict.fromkeys(queries) if q]
    patterns = tuple(Pattern.literal(q.lower()) for q in wanted)

    @F.pandas_udf("array<string>")
    def held(hay: pd.Series) -> pd.Series:
        found: list[list[str]] = [[] for _ in hay]
        for row, i in dict.fromkeys((r, i) for r, i, _ in automaton_of(patterns).hits([h.encode() for h in hay]).tolist()):
            found[row].append(wanted[i])
        return pd.Series(found)

    parts = [df.select(F.lit(name).alias("source"), "label", "detail", F.lower(F.concat_ws(" ", "label", "detail", "hay")).alias("_hay"), F.col("place").cast("string").alias("place")) for name, df in tables.items()]
    found = reduce(DataFrame.unionByName, parts).select("source", "label", "detail", "place", F.explode(held("_hay")).alias("query"))
    limit = F.lit(10)
    for name, n in (most or {"Packet": 20}).items():
        limit = F.when(F.col("source") == name, F.lit(n)).otherwise(limit)
    rank = F.row_number().over(Window.partitionBy("query", "source").orderBy(F.lpad("place", 20, "0"), "label", "detail"))
    return found.withColumn("rank", rank).where(F.col("rank") <= max(20, *(most or {"Packet": 20}).values())).where(F.col("rank") <= limit).select("query", "source", "rank", "label", "detail")


def packet_finds(packets: DataFrame) -> DataFrame:
    """Packets as rows of the search."""
    label = F.concat(F.lit("#"), F.col("no").cast("string"), F.lit(" "), F.col("src"), F.lit(" → "), F.col("dst"), F.lit(" ["), F.col("protocol"), F.lit("]"))
    ports = F.concat_ws(" ", F.col("src_port").cast("string"), F.col("dst_port").cast("string"))
    return packets.select(label.alias("label"), F.col("info").alias("detail"), ports.alias("hay"), F.col("no").alias("place"))


def about(packets: DataFrame, findings: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Every finding about each packet, beside the packet's ends and, where flows are given, its flow's totals."""
    rows = findings.select("no", "source", "signature", "severity").join(packets.select("no", "src", "dst", "src_port", "dst_port", "protocol", "vlan_id"), "no")
    if flows is None:
        return rows
    from netloom.operators.traffic import FLOW, with_flow_key

    keyed = with_flow_key(rows)
    totals = flows.select(*(F.col(c).alias(f"_f_{c}") for c in FLOW), F.col("packets").alias("flow_packets"), F.col("bytes").alias("flow_bytes"))
    return keyed.join(totals, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in FLOW], "left").select("no", "source", "signature", "severity", "src", "dst", "flow_packets", "flow_bytes")


def security_summary(findings: DataFrame) -> DataFrame:
    """How many findings each source has, in one row: ids, arp, exposure, auth, tls, dns, vlan, ioc, rule,
    credential, and all."""
    names = ("IDS", "ARP", "EXPOSURE", "AUTH", "TLS", "DNS", "VLAN", "IOC", "RULE", "CREDENTIAL")
    return findings.agg(*(F.count_if(F.col("source") == n).alias(n.lower()) for n in names), F.count("*").alias("findings"))


def triaged(findings: DataFrame) -> DataFrame:
    """Findings with the priority of their severity, what to do, and whether they are pinned (80 or more)."""
    scale = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    priority = F.coalesce(F.try_element_at(scale, F.upper("severity")), F.lit(20))
    advice = F.lit(ADVICE_ELSE)
    for source, text in ADVICE.items():
        advice = F.when(F.col("source") == source, text).otherwise(advice)
    advice = F.when(priority == 100, ADVICE_CRITICAL).otherwise(advice)
    return findings.withColumns({"priority": priority, "recommendation": advice, "pinned": priority >= 80})


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Tags (evidence, tag) with new ones; a tag is on a piece of evidence once."""
    return tags.unionByName(new).distinct()


def drop_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    """Tags without some; gone has evidence and tag, or evidence alone, which clears all of its tags."""
    on = [F.col(c) == F.col(f"_g_{c}") for c in gone.columns]
    return tags.join(gone.select(*(F.col(c).alias(f"_g_{c}") for c in gone.columns)).distinct(), on, "left_anti")


def put_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes (id, text, timestamp, evidence, tags) with changes of the same columns: a known id is edited where
    the change has a value, a new id with a text is added, any other is passed over."""
    new = changes.select(*(F.col(c).alias(f"_n_{c}") for c in ("id", "text", "timestamp", "evidence", "tags")))
    both = notes.join(new, F.col("id") == F.col("_n_id"), "full_outer").where("id is not null or _n_text is not null")
    return both.select(*(F.coalesce(f"_n_{c}", c).alias(c) for c in ("id", "text", "timestamp", "evidence", "tags")))


def drop_notes(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Notes without some; what they were about is no longer linked, as the link is a column of the note."""
    return notes.join(ids.select(F.col("id").alias("_gone")).distinct(), F.col("id") == F.col("_gone"), "left_anti")


def reviewed(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """Incidents (incident_id, status, reviewed) with those that are named marked as reviewed."""
    rows = _named(incidents, ids)
    return rows.withColumn("reviewed", F.coalesce("reviewed", F.lit(False)) | F.col("_named")).drop("_named")


def acknowledged(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """Incidents with those that are named acknowledged, if they are pending and were reviewed; others stay."""
    rows = _named(incidents, ids)
    ready = F.col("_named") & (F.col("status") == "pending") & F.coalesce("reviewed", F.lit(False))
    return rows.withColumn("status", F.when(ready, "acknowledged").otherwise(F.col("status"))).drop("_named")


def _named(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    named = ids.select(F.col("incident_id").alias("_id"), F.lit(True).alias("_hit")).distinct()
    return incidents.join(named, F.col("incident_id") == F.col("_id"), "left").withColumn("_named", F.coalesce("_hit", F.lit(False))).drop("_id", "_hit")


def evidence_of(nodes_or_edges: DataFrame, touches: DataFrame, key: str) -> DataFrame:
    """The first and the latest packet that gave evidence of each node or edge, and how many did; touches has the
    key, no and timestamp of each. The list itself is the table of touches, of any length."""
    at = F.struct("timestamp", "no")
    sums = touches.groupBy(F.col(key).alias("_k")).agg(F.min_by("no", at).alias("first_no"), F.max_by("no", at).alias("last_no"), F.count_distinct("no").alias("evidence"))
    return nodes_or_edges.join(sums, F.col(key) == F.col("_k"), "left").drop("_k")
