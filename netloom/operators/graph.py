"""The entity graph as two tables, nodes and edges, and what is read from it: risks, paths, clusters, pivots.

Packets are summed by (src, dst, protocol, port) before anything is derived, so only that one aggregation sees all
of them. Every pattern is one hop, so groupings of edges do; nothing is traversed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = ("key", "kind", "label", "first_seen", "last_seen", "hits", "severity")
EDGE = ("src", "dst", "kind", "first_seen", "last_seen", "hits", "bytes")
#: Risks of alerts by severity.
ALERT_RISK = {"CRIT": 0.95, "CRITICAL": 0.95, "HIGH": 0.80, "MED": 0.55, "MEDIUM": 0.55, "LOW": 0.30}


def _key(kind: str, *parts) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def _node(key: Column, kind: str, label: Column, severity: Column | None = None) -> Column:
    return F.struct(key.alias("key"), F.lit(kind).alias("kind"), label.alias("label"), (F.lit(None).cast("string") if severity is None else severity).alias("severity"))


def _edge(src: Column, dst: Column, kind: str, size: Column | None = None) -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), (F.lit(0) if size is None else size).cast("long").alias("bytes"))


def _touches(rows: DataFrame, nodes: list[Column], edges: list[Column]) -> tuple[DataFrame, DataFrame]:
    """rows has first_seen, last_seen, hits; null nodes and edges fall away."""
    when = ("first_seen", "last_seen", "hits")
    return tuple(rows.select(*when, F.inline(F.array_compact(F.array(*parts)))) for parts in (nodes, edges))


def from_packets(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts, services, who talks to whom, which service belongs to whom and is used by whom."""
    p = packets.where("src not in ('', '0.0.0.0') and dst not in ('', '0.0.0.0')")
    sums = p.groupBy("src", "dst", "protocol", "dst_port").agg(F.count("*").alias("hits"), F.sum("length").alias("_bytes"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    port = F.col("dst_port").isNotNull()
    place = F.concat(F.concat_ws(":", "dst", F.col("dst_port").cast("string")), F.lit("/"), F.col("protocol"))
    src, dst, service = _key("Host", "src"), _key("Host", "dst"), F.concat(F.lit("Service:"), place)
    nodes = [_node(src, "Host", F.col("src")), _node(dst, "Host", F.col("dst")), F.when(port, _node(service, "Service", place))]
    edges = [_edge(src, dst, "CommunicatesWith", F.col("_bytes")), F.when(port, _edge(dst, service, "BelongsToHost")), F.when(port, _edge(src, service, "UsesService", F.col("_bytes")))]
    return _touches(sums, nodes, edges)


def _once(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"first_seen": F.col("timestamp"), "last_seen": F.col("timestamp"), "hits": F.lit(1).cast("long")})


def from_alerts(alerts: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each alert of a packet and its two hosts."""
    rows = _once(alerts.select("no", "timestamp", "signature", "severity").join(packets.select("no", "src", "dst"), "no"))
    alert = _key("Alert", "signature", "no")
    ends = [(F.col(c) != "", _key("Host", c), F.col(c)) for c in ("src", "dst")]
    nodes = [_node(alert, "Alert", F.concat(F.lit("["), "severity", F.lit("] "), "signature"), F.col("severity")), *(F.when(there, _node(k, "Host", label)) for there, k, label in ends)]
    return _touches(rows, nodes, [F.when(there, _edge(k, alert, "TriggersAlert")) for there, k, _ in ends])


def from_indicators(hits: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each indicator that a packet meets and the packet's source. hits has no, timestamp, value."""
    rows = _once(hits.select("no", "timestamp", "value").join(packets.select("no", "src"), "no"))
    key, host = _key("IOC", F.lit("ip"), "value"), _key("Host", "src")
    return _touches(rows, [_node(key, "IOC", F.concat(F.lit("[ip] "), "value")), F.when(F.col("src") != "", _node(host, "Host", F.col("src")))], [F.when(F.col("src") != "", _edge(host, key, "MatchesIoc"))])


def from_credentials(finds: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Credentials (no, scheme, username), who used them and where; values of passwords never enter the graph."""
    rows = _once(finds.select("no", "scheme", F.coalesce("username", F.lit("unknown")).alias("username")).join(packets.where("src != ''").select("no", "timestamp", "src", "dst"), "no"))
    key = _key("Cred", "scheme", "username", "dst")
    label = F.concat("scheme", F.lit("://"), "username", F.lit("@"), "dst")
    hosts = [_node(_key("Host", c), "Host", F.col(c)) for c in ("src", "dst")]
    return _touches(rows, [_node(key, "Credential", label), *hosts], [_edge(_key("Host", "src"), key, "AuthenticatedWith"), _edge(key, _key("Host", "dst"), "AuthenticatedWith")])


def from_sessions(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certificates or fingerprints of sessions (flow_id, sni, fingerprint, timestamp), their names and flows."""
    rows = _once(sessions.where("fingerprint != ''"))
    cert, name, flow = _key("Cert", "fingerprint"), _key("Identity", F.lit("tls-sni"), "sni"), _key("Flow", "flow_id")
    named = F.col("sni").isNotNull()
    nodes = [_node(cert, "Certificate", F.concat(F.lit("cert:"), F.coalesce("sni", F.substring("fingerprint", 1, 8)))), F.when(named, _node(name, "Identity", F.col("sni"))), _node(flow, "Flow", F.col("flow_id"))]
    return _touches(rows, nodes, [F.when(named, _edge(cert, name, "ResolvesTo")), _edge(flow, cert, "PresentsCertificate")])


def from_rule_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each packet that a user's rule hit; hits has no, timestamp, rule_id and signature (the rule's name)."""
    rows = _once(hits.select("no", "timestamp", "rule_id", "signature").dropDuplicates(["rule_id", "no"]))
    return _touches(rows, [_node(_key("RuleHit", "rule_id", "no"), "RuleHit", F.concat(F.lit("Rule: "), "signature"))], [F.lit(None).cast("struct<src:string,dst:string,kind:string,bytes:bigint>")])


def from_files(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Carved objects (sha256, kind, size, timestamp, and flow_id where it is known), linked to their flows."""
    rows = _once(objects)
    key, flow = _key("File", "sha256"), _key("Flow", "flow_id")
    size = F.when(F.col("size") < 1024, F.concat(F.col("size").cast("string"), F.lit("B"))).when(F.col("size") < 1 << 20, F.format_string("%.1fKB", F.col("size") / 1024)).otherwise(F.format_string("%.1fMB", F.col("size") / (1 << 20)))
    node = _node(key, "FileObject", F.concat("kind", F.lit(" ("), size, F.lit(")")))
    return _touches(rows, [node], [F.when(F.col("flow_id").isNotNull(), _edge(key, flow, "ExtractedFrom"))])


def merged(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """G1: one node a key and one edge a pair and kind, with first and last time, hits and bytes."""
    nodes, edges = (reduce(DataFrame.unionByName, side) for side in zip(*parts))
    seen = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hits")]
    return nodes.groupBy("key", "kind").agg(F.min("label").alias("label"), *seen, F.max("severity").alias("severity")).select(*NODE), edges.groupBy("src", "dst", "kind").agg(*seen, F.sum("bytes").alias("bytes")).select(*EDGE)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends, with the neighbour."""
    side = lambda way, me, other: edges.select(F.col(me).alias("key"), F.lit(way).alias("direction"), F.col("kind").alias("edge"), F.col(other).alias("neighbour"), F.col("hits").alias("edge_hits"), F.col("first_seen").alias("edge_first"), F.col("last_seen").alias("edge_last"))
    there = nodes.select(F.col("key").alias("neighbour"), F.col("kind").alias("neighbour_kind"), F.col("label").alias("neighbour_label"), F.col("severity").alias("neighbour_severity"))
    return side("out", "src", "dst").unionByName(side("in", "dst", "src")).join(there, "neighbour")


def scored(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with a risk from 0 to 1 by what they are linked to, and the reasons. A host's alert counts as grave
    if the alert's severity is HIGH or more."""
    edge, out, inward = F.col("edge"), F.col("direction") == "out", F.col("direction") == "in"
    n = lambda condition, name: F.count_if(condition).alias(name)
    facts = adjacency(nodes, edges).groupBy("key").agg(
        n(edge == "TriggersAlert", "alerts"), n(edge == "MatchesIoc", "indicators"), n(edge == "AuthenticatedWith", "logins"), n((edge == "AuthenticatedWith") & inward, "users"), n((edge == "PresentsCertificate") & inward, "presented"),
        n((edge == "PresentsCertificate") & out, "certificates"), n((edge == "ExtractedFrom"), "files"), n((edge == "TriggersAlert") & F.col("neighbour_severity").isin("HIGH", "CRIT", "CRITICAL"), "grave"),
        F.sum(F.when(out & (edge == "CommunicatesWith") & (F.col("edge_hits") > 30), F.col("edge_hits")).otherwise(0)).alias("repeated"),
    )
    rows = nodes.join(facts, "key", "left").na.fill(0)
    c = F.col
    part = lambda weight, name, full: weight * F.least(c(name), F.lit(full)) / full
    more = lambda condition, value: F.when(condition, value).otherwise(0.0)
    host = part(0.35, "indicators", 3) + part(0.25, "alerts", 5) + more(c("grave") > 0, 0.15) + part(0.15, "logins", 3) + more(c("repeated") > 100, 0.10)
    credential = 0.4 + more(c("users") > 1, 0.3 * F.least(c("users") / 5, F.lit(1.0)))
    risk = F.create_map(*(F.lit(x) for kv in ALERT_RISK.items() for x in kv))
    kind = lambda name, value: F.when(c("kind") == name, value)
    score = F.coalesce(
        kind("Host", host), kind("Credential", credential), kind("Certificate", more(c("presented") > 1, 0.2 * F.least(c("presented") / 5, F.lit(1.0)))), kind("IOC", F.least(0.5 + 0.1 * c("indicators"), F.lit(0.95))),
        kind("Alert", F.coalesce(F.try_element_at(risk, F.upper("severity")), F.lit(0.15))), kind("FileObject", F.lit(0.10)), kind("Flow", 0.05 + more(c("certificates") > 0, 0.15) + more(c("files") > 0, 0.20)), F.lit(0.0),
    )
    said = lambda condition, *text: F.when(condition, F.concat(*text))
    text = lambda name: c(name).cast("string")
    is_host = c("kind") == "Host"
    why = F.concat_ws(
        ", ", said(is_host & (c("indicators") > 0), text("indicators"), F.lit(" IOC hit(s)")), said(is_host & (c("alerts") > 0), text("alerts"), F.lit(" alert(s)")), said(is_host & (c("grave") > 0), F.lit("high-sev alert")), said(is_host & (c("logins") > 0), text("logins"), F.lit(" credential(s) seen")),
        said(is_host & (c("repeated") > 100), F.lit("beacon-like repetition")), said((c("kind") == "Credential") & (c("users") > 1), F.lit("seen from "), text("users"), F.lit(" sources")), said((c("kind") == "Certificate") & (c("presented") > 1), F.lit("reused in "), text("presented"), F.lit(" flows")),
    )
    return rows.select(*NODE, F.round(F.least(score, F.lit(1.0)), 6).alias("score"), why.alias("why"))


def _periodic(edges: DataFrame) -> DataFrame:
    """Edges of 20 packets or more over a minute or more, between 0.05 and 20 a second, with their score."""
    span = F.col("last_seen") - F.col("first_seen")
    rate = F.col("hits") / span
    rows = edges.where((F.col("kind") == "CommunicatesWith") & (F.col("hits") >= 20) & (span >= 60)).where((rate >= 0.05) & (rate <= 20))
    return rows.withColumn("score", F.least(0.4 + F.least(F.col("hits") / 200, F.lit(0.45)), F.lit(0.85)))


def paths(nodes: DataFrame, edges: DataFrame, top: int = 50) -> DataFrame:
    """Nodes must be scored. Reuse of credentials and certificates, contact with indicators, hosts with two kinds
    of trouble, periodic traffic: kind, node, members (how many), score; the 50 highest."""
    edge, out = F.col("edge"), F.col("direction") == "out"
    near = lambda kind: F.coalesce(out & (F.col("neighbour_kind") == kind), F.lit(False))
    n = lambda condition, name: F.count_if(condition).alias(name)
    # an edge is unique by its ends and kind, so counting edges counts neighbours
    facts = adjacency(nodes, edges).groupBy("key").agg(
        n(near("Host") & (edge == "AuthenticatedWith"), "reached"), n(~out & (edge == "MatchesIoc"), "contacts"), n(~out & (edge == "PresentsCertificate"), "presented"),
        (F.max(near("Alert").cast("int")) + F.max(near("IOC").cast("int")) + F.max(near("Credential").cast("int"))).cast("long").alias("troubles"),
    )
    rows = facts.join(nodes.select("key", F.col("kind").alias("of"), F.col("score").alias("risk")), "key")
    pattern = lambda of, kind, members, least, base, step, most: F.when((F.col("of") == of) & (F.col(members) >= least), F.struct(F.lit(kind).alias("kind"), F.col("key").alias("node"), F.col(members).alias("members"), F.least(base + step * F.col(members), F.lit(most)).alias("score")))
    patterns = [
        pattern("Credential", "CredentialReuse", "reached", 2, 0.4, 0.15, 0.95), pattern("IOC", "IndicatorContact", "contacts", 1, 0.5, 0.1, 0.95), pattern("Certificate", "CertificateReuse", "presented", 2, 0.45, 0.1, 0.9),
        F.when(F.col("risk") > 0.5, pattern("Host", "MultiStageSuspicious", "troubles", 2, 0.5, 0.15, 0.95)),
    ]
    periodic = _periodic(edges).select(F.lit("Periodic").alias("kind"), F.concat_ws(" -> ", "src", "dst").alias("node"), F.lit(2).cast("long").alias("members"), "score")
    found = [rows.select(F.inline(F.array_compact(F.array(*patterns)))), periodic]
    return reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "kind", "node").limit(top)


def clusters(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """Groups of one certificate, of one indicator, of all hosts with alerts, of all ends of periodic traffic."""
    group = lambda kind, edge, least, base: edges.where(F.col("kind") == edge).groupBy(F.col("dst").alias("label")).agg(F.count("*").alias("members")).where(F.col("members") >= least).select(F.lit(kind).alias("kind"), "label", "members", F.least(base + 0.1 * F.col("members"), F.lit(0.9 if kind == "CertificateReuse" else 0.95)).alias("score"))
    alerted = edges.where("kind = 'TriggersAlert'").agg(F.count_distinct("src").alias("members")).where("members >= 2").select(F.lit("AlertedHosts").alias("kind"), F.lit("Alerted Hosts").alias("label"), "members", F.lit(0.7).alias("score"))
    ends = _periodic(edges).select(F.explode(F.array("src", "dst")).alias("end"), "score").agg(F.count_distinct("end").alias("members"), F.max("score").alias("score")).where("members > 0")
    beacon = ends.select(F.lit("BeaconGroup").alias("kind"), F.lit("Beacon Candidates").alias("label"), "members", "score")
    found = [group("CertificateReuse", "PresentsCertificate", 2, 0.4), group("IndicatorGroup", "MatchesIoc", 1, 0.55), alerted, beacon]
    return reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "kind", "label").limit(top)


#: What to look at next, by kind of node: text, score, and the risk that the node must exceed.
HINTS = (
    ("Host", "Check certificate reuse", 0.6, -1.0), ("Host", "View exposed credentials", 0.75, 0.3), ("Certificate", "Find all hosts using this cert", 0.8, -1.0), ("Credential", "Check for credential reuse", 0.9, -1.0),
    ("IOC", "Find all matching hosts", 0.85, -1.0), ("Flow", "Follow stream", 0.7, -1.0), ("Flow", "Check for extracted files", 0.65, -1.0), ("FileObject", "Source stream", 0.8, -1.0), ("FileObject", "YARA hits", 0.9, -1.0),
)
CONFIDENCE = {"CommunicatesWith": 1.0, "BelongsToHost": 1.0, "UsesService": 1.0, "PresentsCertificate": 1.0, "TriggersAlert": 0.95, "MatchesIoc": 0.95, "AuthenticatedWith": 0.9, "ResolvesTo": 0.9, "ExtractedFrom": 0.85}


def pivots(scored_nodes: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """For each node its eight best next steps: neighbours by their risk or the edge's confidence, and hints. A
    node's neighbours are cut to eight for each task before the shuffle, by Spark's limit of a window's group."""
    sure = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    risk = scored_nodes.select(F.col("key").alias("neighbour"), F.col("score").alias("_risk"))
    near = adjacency(scored_nodes, edges).join(risk, "neighbour").select("key", F.concat("edge", F.lit(" -> "), "neighbour_label", F.lit(" ("), "neighbour_kind", F.lit(")")).alias("step"), F.greatest("_risk", F.coalesce(F.try_element_at(sure, F.col("edge")), F.lit(1.0)) * 0.5).alias("score")).distinct()
    hint = F.array_compact(F.array(*(F.when((F.col("kind") == k) & (F.col("score") > least), F.struct(F.lit(text).alias("step"), F.lit(s).alias("score"))) for k, text, s, least in HINTS)))
    hints = scored_nodes.select("key", F.inline(hint))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "step")
    return near.unionByName(hints).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
