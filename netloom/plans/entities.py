"""Registered queries over decoded frames, page payloads, the entity graph, rules and incidents, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import decode, detect, graph, incidents, processes, rules, signatures
from netloom.plans.lookups import _indicators
from netloom.plans.packets import SQL, packets
from netloom.sources import scratch

#: Every page as the payload of a packet to port 80, after 54 bytes for headers; every seventh asks for a log-in.
PAGES = """SELECT page_id + 1 AS no, CAST(page_id AS DOUBLE) / 10 AS timestamp, '10.0.2.1' AS src, '10.0.3.1' AS dst, 'HTTP' AS protocol, CAST(NULL AS INT) AS length, url AS info,
  40000 AS src_port, 80 AS dst_port, CAST(NULL AS INT) AS vlan_id, encode(concat(repeat(' ', 54), CASE WHEN page_id % 7 = 0 THEN 'GET /login ' ELSE 'GET / ' END, coalesce(html, '')), 'UTF-8') AS bytes FROM {pages}"""
#: Socket owners derived from the suppliers; some hold any address or any remote port.
OWNERS = """SELECT s_suppkey AS seq, 'TCP' AS protocol, CASE WHEN s_suppkey % 3 = 0 THEN '0.0.0.0' ELSE concat('10.0.0.', CAST(s_suppkey % 6 + 1 AS STRING)) END AS local_ip, CAST(40000 + s_suppkey % 9 AS INT) AS local_port,
  '0.0.0.0' AS remote_ip, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 443 END AS INT) AS remote_port, CAST(s_suppkey % 5 AS INT) AS pid, concat('p', CAST(s_suppkey % 5 AS STRING)) AS process FROM {supplier}"""
RULES = [
    {"id": "r1", "name": "log-in errors", "condition": {"And": [{"Equals": {"field": "proto", "value": "ssh"}}, {"Num": {"field": "port", "op": "Eq", "value": 22}}, {"Not": {"Contains": {"field": "dst", "value": "10.0.1.7"}}}]}, "actions": [{"Alert": {"message": "ssh", "severity": "HIGH"}}, {"Tag": {"tag": "ssh"}}]},
    {"id": "r2", "name": "outside", "condition": {"Or": [{"Contains": {"field": "ip.dst", "value": "203.0.113"}}, {"Num": {"field": "ip.ttl", "op": "Lt", "value": 10}}]}, "actions": [{"Log": {"message": "external"}}]},
    {"id": "r3", "name": "off", "enabled": False, "condition": {"And": []}, "actions": [{"Log": {"message": "never"}}]},
]
SHORT = ("no", "signature", "severity")


def _pages(spark, sf_dir):
    return spark.sql(PAGES, pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _kept(table):
    """table, written once: what is read from it doesn't derive it again."""
    path = scratch.folder(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _graph(spark, sf_dir):
    p = packets(spark, sf_dir)
    nodes, edges = graph.merged(graph.from_packets(p), graph.from_alerts(detect.auth_burst(p), p), graph.from_indicators(_indicators(spark, sf_dir), p))
    return _kept(nodes), _kept(edges)


def _scored(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return _kept(graph.scored(nodes, edges)), edges


def _incidents(spark, sf_dir):
    p = packets(spark, sf_dir)
    return incidents.incidents(detect.auth_burst(p), p, "HIGH")


def _credentials(spark, sf_dir):
    """Each document as the text that follows a log-in by its source's name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.concat(F.lit("USER "), F.coalesce("source", F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit(""))), "UTF-8").alias("bytes"))
    return signatures.credentials(docs, "doc_id")


def _attributed(spark, sf_dir):
    return processes.attributed(packets(spark, sf_dir), spark.sql(OWNERS, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet")))


def queries() -> dict:
    over = lambda f: lambda spark, sf_dir: f(packets(spark, sf_dir))
    return {
        "s2_decoded": over(lambda p: decode.decoded(p.select("no", "timestamp", "bytes")).drop("bytes")),
        "d40_page_exploits": lambda spark, sf_dir: signatures.exploits(_pages(spark, sf_dir)).select(*SHORT),
        "d_vuln_page_exposures": lambda spark, sf_dir: signatures.exposures(_pages(spark, sf_dir)).select(*SHORT),
        "x14_credentials": _credentials,
        "g1_nodes": lambda spark, sf_dir: _graph(spark, sf_dir)[0],
        "g1_edges": lambda spark, sf_dir: _graph(spark, sf_dir)[1],
        "g5_scores": lambda spark, sf_dir: _scored(spark, sf_dir)[0].select("key", "score", "why"),
        "g6_paths": lambda spark, sf_dir: graph.paths(*_scored(spark, sf_dir)),
        "g7_clusters": lambda spark, sf_dir: graph.clusters(*_scored(spark, sf_dir)),
        "d_rule_hits": over(lambda p: rules.hits(p, RULES)),
        "a23_rule_counts": over(lambda p: rules.rule_counts(p, RULES)),
        "j4_attributed": lambda spark, sf_dir: _attributed(spark, sf_dir).select("no", "pid", "process", "outbound"),
        "a15_processes": lambda spark, sf_dir: processes.process_totals(_attributed(spark, sf_dir)),
        "i4_incidents": lambda spark, sf_dir: _incidents(spark, sf_dir).drop("incident_id"),
        "j12_incident_packets": lambda spark, sf_dir: incidents.history(_incidents(spark, sf_dir), packets(spark, sf_dir)).groupBy("attacker").agg(F.count("*").alias("packets"), F.min("no").alias("first_no"), F.max("no").alias("last_no")),
        "i7_decisions": lambda spark, sf_dir: incidents.decisions(_incidents(spark, sf_dir)).drop("incident_id"),
    }


def oracle_sql(known: dict[str, str]) -> dict[str, str]:
    """known is the SQL of the alerts and of the indicators' hits."""
    p = "WITH p AS (" + SQL.replace("{events}", "events") + ")"
    names = lambda table, default: "CASE " + " ".join(f"WHEN src_port IN ({', '.join(map(str, ports))}) OR dst_port IN ({', '.join(map(str, ports))}) THEN '{name}'" for name, *ports in table) + f" ELSE '{default}' END"
    base = f"{p}, al AS (SELECT * FROM ({known['d_bf_auth_burst']}) x), io AS (SELECT * FROM ({known['j1_indicator_hits']}) x)"
    place = "concat(dst, ':', dst_port, '/', protocol)"
    host = lambda end, source: f"SELECT concat('Host:', {end}) AS key, 'Host' AS kind, {end} AS label, timestamp, NULL AS severity FROM {source}"
    of = lambda t: f"(SELECT {t}.timestamp, p.src, p.dst FROM {t} JOIN p USING (no)) z"
    nodes = f"""{base}, t AS ({host('src', 'p')} UNION ALL {host('dst', 'p')} UNION ALL {host('src', of('al'))} UNION ALL {host('dst', of('al'))} UNION ALL {host('src', of('io'))}
        UNION ALL SELECT concat('Service:', {place}), 'Service', {place}, timestamp, NULL FROM p UNION ALL SELECT concat('Alert:', signature, ':', no), 'Alert', concat('[', severity, '] ', signature), timestamp, severity FROM al
        UNION ALL SELECT concat('IOC:ip:', value), 'IOC', concat('[ip] ', value), timestamp, NULL FROM io),
        n AS (SELECT key, kind, min(label) AS label, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS hits, max(severity) AS severity FROM t GROUP BY key, kind),
        u AS (SELECT concat('Host:', src) AS src, concat('Host:', dst) AS dst, 'CommunicatesWith' AS kind, timestamp, length AS bytes FROM p UNION ALL SELECT concat('Host:', dst), concat('Service:', {place}), 'BelongsToHost', timestamp, 0 FROM p
        UNION ALL SELECT concat('Host:', src), concat('Service:', {place}), 'UsesService', timestamp, length FROM p
        UNION ALL SELECT concat('Host:', unnest([p.src, p.dst])), concat('Alert:', signature, ':', no), 'TriggersAlert', al.timestamp, 0 FROM al JOIN p USING (no) UNION ALL SELECT concat('Host:', p.src), concat('IOC:ip:', value), 'MatchesIoc', io.timestamp, 0 FROM io JOIN p USING (no)),
        e AS (SELECT src, dst, kind, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes FROM u GROUP BY src, dst, kind)"""
    scored = f"""{nodes}, f AS (SELECT src AS key, count(*) FILTER (kind = 'TriggersAlert') AS alerts, count(*) FILTER (kind = 'MatchesIoc') AS iocs, coalesce(sum(hits) FILTER (kind = 'CommunicatesWith' AND hits > 30), 0) AS rep FROM e GROUP BY src),
        m AS (SELECT dst AS key, count(*) AS hosts FROM e WHERE kind = 'MatchesIoc' GROUP BY dst),
        s AS (SELECT n.*, round(CASE kind WHEN 'Host' THEN 0.35 * least(coalesce(iocs, 0), 3) / 3 + 0.25 * least(coalesce(alerts, 0), 5) / 5 + CASE WHEN alerts > 0 THEN 0.15 ELSE 0 END + CASE WHEN rep > 100 THEN 0.1 ELSE 0 END
          WHEN 'IOC' THEN least(0.5 + 0.1 * coalesce(hosts, 0), 0.95) WHEN 'Alert' THEN 0.8 ELSE 0 END::DOUBLE, 6) AS score,
          CASE WHEN kind = 'Host' THEN concat_ws(', ', CASE WHEN iocs > 0 THEN concat(iocs, ' IOC hit(s)') END, CASE WHEN alerts > 0 THEN concat(alerts, ' alert(s)') END, CASE WHEN alerts > 0 THEN 'high-sev alert' END, CASE WHEN rep > 100 THEN 'beacon-like repetition' END) ELSE '' END AS why
          FROM n LEFT JOIN f USING (key) LEFT JOIN m USING (key))"""
    periodic = "SELECT *, least(0.4 + least(hits / 200, 0.45), 0.85) AS score FROM e WHERE kind = 'CommunicatesWith' AND hits >= 20 AND last_seen - first_seen >= 60 AND hits / (last_seen - first_seen) BETWEEN 0.05 AND 20"
    rounded = "CAST(round(score, 6) AS DOUBLE) AS score"
    inside = "regexp_matches(dst, '^203.0.113')"
    incident = f"{p}, i AS (SELECT source, signature AS detector, p.src AS attacker, p.dst AS target, count(*) AS findings, min(no) AS first_no, max(no) AS last_no, min(a.timestamp) AS first_time, max(a.timestamp) AS last_time, arg_min(detail, no) AS summary FROM ({known['d_bf_auth_burst']}) a JOIN p USING (no) GROUP BY ALL)"
    owned = f"""{p}, o AS ({OWNERS.format(supplier='supplier')}), w AS (SELECT *, true AS outbound, src AS ip, src_port AS port, dst AS far, dst_port AS far_port FROM p UNION ALL SELECT *, false, dst, dst_port, src, src_port FROM p),
        h AS (SELECT w.no, w.timestamp, w.length, o.pid, o.process, w.outbound, row_number() OVER (PARTITION BY w.no ORDER BY w.outbound DESC, o.seq DESC) AS k FROM w JOIN o ON w.port = o.local_port AND (o.local_ip = '0.0.0.0' OR o.local_ip = w.ip) AND (o.remote_port = 0 OR o.remote_port = w.far_port)), b AS (SELECT * FROM h WHERE k = 1)"""
    ssh = "protocol = 'SSH' AND dst_port = 22 AND NOT contains(dst, '10.0.1.7')"
    return {
        "s2_decoded": f"""{p} SELECT no, timestamp, src, dst, {names(decode.TCP_PORTS, 'TCP')} AS protocol, CAST(octet_length(bytes) AS INT) AS length, concat(src_port, ' → ', dst_port, ' [SYN] Seq=', no - 1) AS info, src_port, dst_port,
            CAST(NULL AS INT) AS vlan_id, CAST(NULL AS INT) AS vlan_pcp, CAST(NULL AS INT) AS vlan_dei, CAST(NULL AS INT) AS outer_vlan_id FROM p""",
        "d40_page_exploits": """WITH h AS (SELECT page_id + 1 AS no, lower(html) AS low FROM pages) SELECT no, 'XSS Probe' AS signature, 'MED' AS severity FROM h WHERE contains(low, '<script>') OR contains(low, 'javascript:')
            UNION ALL SELECT no, 'Log4Shell (CVE-2021-44228)', 'CRIT' FROM h WHERE contains(low, '${jndi:') UNION ALL SELECT no, 'SQL Injection Probe', 'HIGH' FROM h WHERE contains(low, 'union select') OR contains(low, ''' or 1=1') OR contains(low, '''; drop table')
            UNION ALL SELECT no, 'Directory Traversal', 'HIGH' FROM h WHERE (length(low) - length(replace(low, '../', ''))) / 3 >= 5""",
        "d_vuln_page_exposures": "SELECT page_id + 1 AS no, 'Cleartext HTTP Sensitive Path' AS signature, 'HIGH' AS severity FROM pages WHERE page_id % 7 = 0 OR regexp_matches(lower(html), '/admin|/login|/passwd|/password|/config|/wp-admin')",
        "x14_credentials": "SELECT doc_id, concat('FTP-', upper(substr(value, 1, 4))) AS kind, value FROM (SELECT doc_id, trim(unnest(string_split(concat('USER ', coalesce(source, '-'), chr(10), text), chr(10)))) AS value FROM documents) l WHERE starts_with(upper(value), 'USER ') OR starts_with(upper(value), 'PASS ')",
        "g1_nodes": f"{nodes} SELECT * FROM n",
        "g1_edges": f"{nodes} SELECT * FROM e",
        "g5_scores": f"{scored} SELECT key, score, why FROM s",
        "g6_paths": f"""{scored} SELECT kind, node, members, {rounded} FROM (SELECT 'IndicatorContact' AS kind, key AS node, hosts AS members, least(0.5 + 0.1 * hosts, 0.95) AS score FROM m
            UNION ALL SELECT 'MultiStageSuspicious', key, 2, 0.8 FROM s JOIN f USING (key) WHERE kind = 'Host' AND score > 0.5 AND alerts > 0 AND iocs > 0 UNION ALL SELECT 'Periodic', concat(src, ' -> ', dst), 2, score FROM ({periodic}) q) r ORDER BY score DESC, kind, node LIMIT 50""",
        "g7_clusters": f"""{nodes} SELECT kind, label, members, {rounded} FROM (SELECT 'IndicatorGroup' AS kind, dst AS label, count(*) AS members, least(0.55 + 0.1 * count(*), 0.95) AS score FROM e WHERE kind = 'MatchesIoc' GROUP BY dst
            UNION ALL SELECT 'AlertedHosts', 'Alerted Hosts', count(DISTINCT src), 0.7 FROM e WHERE kind = 'TriggersAlert' HAVING count(DISTINCT src) >= 2
            UNION ALL SELECT 'BeaconGroup', 'Beacon Candidates', count(DISTINCT o), max(score) FROM (SELECT unnest([src, dst]) AS o, score FROM ({periodic}) q) w HAVING count(*) > 0) r ORDER BY score DESC, kind, label LIMIT 20""",
        "d_rule_hits": f"""{p} SELECT no, timestamp, 'RULE' AS source, 'r1' AS rule_id, 'log-in errors' AS signature, unnest(['Alert', 'Tag']) AS action, unnest(['HIGH', 'INFO']) AS severity, 'ssh' AS detail FROM p WHERE {ssh}
            UNION ALL SELECT no, timestamp, 'RULE', 'r2', 'outside', 'Log', 'LOW', 'external' FROM p WHERE {inside}""",
        "a23_rule_counts": f"{p} SELECT 'r1' AS rule_id, count(*) AS hits FROM p WHERE {ssh} HAVING count(*) > 0 UNION ALL SELECT 'r2', count(*) FROM p WHERE {inside} HAVING count(*) > 0",
        "j4_attributed": f"{owned} SELECT no, pid, process, outbound FROM b",
        "a15_processes": f"{owned} SELECT pid, arg_max(process, no) AS process, sum(CASE WHEN outbound THEN length ELSE 0 END) AS bytes_out, sum(CASE WHEN outbound THEN 0 ELSE length END) AS bytes_in, count(*) FILTER (outbound) AS packets_out, count(*) FILTER (NOT outbound) AS packets_in, max(timestamp) AS last_seen FROM b GROUP BY pid",
        "i4_incidents": f"{incident} SELECT * FROM i",
        "j12_incident_packets": f"""{incident}, r AS (SELECT attacker, target, first_no, p.no FROM i JOIN p ON p.src = attacker OR p.dst = attacker), k AS (SELECT *, row_number() OVER (PARTITION BY attacker, target ORDER BY no) AS up FROM r),
            q AS (SELECT *, row_number() OVER (PARTITION BY attacker, target ORDER BY no DESC) AS down FROM k WHERE no >= first_no OR up <= 500) SELECT attacker, count(*) AS packets, min(no) AS first_no, max(no) AS last_no FROM q WHERE down <= 2000 GROUP BY attacker""",
        "i7_decisions": f"{incident} SELECT source, detector, attacker, target, 'preview' AS reason, 'previewed' AS status FROM i",
    }
