"""Registered queries over files and streams: tables derived from the given ones are written in a form that the readers
read, and come back through them. Each has an SQL twin over the tables that the files were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import behaviour, decode, detect, enrich, fields, graph, incidents, rules, traffic
from netloom.plans import entities, frames, lookups
from netloom.plans.packets import SQL, packets
from netloom.sources import exports, feeds, pcap, scratch
from netloom.streaming import live

#: When the capture is taken to have begun.
START = 1_700_000_000
PACKET = "no long, timestamp double, src string, dst string, protocol string, length int, info string, src_port int, dst_port int, vlan_id int, bytes binary"
#: Lines of feeds, from suppliers and customers; some are comments, some of unknown kinds.
INDICATOR_LINES = "SELECT CASE c_custkey % 7 WHEN 0 THEN concat('# ', c_name) WHEN 1 THEN concat('ip,10.9.', c_custkey % 200, '.1,', c_name) WHEN 2 THEN concat('Domain, d', c_custkey, '.org ,x, y') WHEN 3 THEN concat('hash,', md5(c_name)) WHEN 4 THEN concat('url,http://u/', c_custkey) WHEN 5 THEN concat('email,a@', c_custkey, '.org') ELSE concat('port,', c_custkey) END AS value FROM {customer}"
PLAIN_LINES = "SELECT CASE c_custkey % 4 WHEN 0 THEN concat('10.9.0.', c_custkey % 250) WHEN 1 THEN concat('d', c_custkey, '.example') WHEN 2 THEN concat('# ', c_name) ELSE concat('word', c_custkey) END AS value FROM {customer}"
PREFIX_LINES = "SELECT concat('198.', s_suppkey % 100, '.0.0/16, AS', s_suppkey, ', ', s_name) AS value FROM {supplier}"
REPUTATION_LINES = "SELECT CASE s_suppkey % 2 WHEN 0 THEN concat('198.', s_suppkey % 100, '.0.0/16,high,', s_name, ',feed') ELSE concat('t13d', s_suppkey, ',low,', s_name, ',feed') END AS value FROM {supplier}"
OWNER_LINES = "SELECT CASE s_suppkey % 5 WHEN 0 THEN concat('# stats kernel_lost=', s_suppkey, ' userspace_invalid=', s_suppkey % 3) ELSE concat('tcp,10.0.0.', s_suppkey % 6 + 1, ',', 40000 + s_suppkey % 9, ',0.0.0.0,443,', s_suppkey, ',', s_suppkey % 4, ',p', s_suppkey % 5, ',run a,b') END AS value FROM {supplier}"
KEY_LINES = "SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('CLIENT_RANDOM ', md5(s_name), md5(s_name), ' ', md5(s_name)) WHEN 1 THEN concat('OTHER_LABEL ', md5(s_name), md5(s_name), ' ', md5(s_name)) ELSE 'CLIENT_RANDOM zz zz' END AS value FROM {supplier}"
RULE_LINES = """SELECT concat('{{"id":"r', s_suppkey, '","name":"n', s_suppkey % 3, '","enabled":', CASE s_suppkey % 2 WHEN 0 THEN 'true' ELSE 'false' END, ',"condition":{{"Equals":{{"field":"proto","value":"ssh"}}}},"actions":[{{"Log":{{"message":"m"}}}}]}}') AS value FROM {supplier}"""


def _written(spark, sf_dir: str, lines: str, table: str) -> str:
    """The lines as text files."""
    path = scratch.folder(spark)
    spark.sql(lines, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")}).write.text(path)
    return path


def _rule_files(spark, sf_dir: str) -> str:
    """The rules of each name as one file, an array."""
    path = scratch.folder(spark)
    each = spark.sql(RULE_LINES, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet")).groupBy(F.get_json_object("value", "$.name").alias("name"))
    each.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).repartition("name").write.partitionBy("name").text(path)
    return f"{path}/*"


def _feed(lines: str, table: str, read):
    return lambda spark, sf_dir: read(spark, _written(spark, sf_dir, lines, table))


def _captures(spark, sf_dir):
    """Packets written as capture files, one for each protocol, and read back."""
    path = scratch.folder(spark)
    listed = pcap.write(packets(spark, sf_dir), path, by="protocol")
    assert listed.count() > 0
    frames_ = pcap.read(spark, f"{path}/*.pcap")
    return frames_.select(F.round("timestamp", 6).alias("timestamp"), "length", F.hex("bytes").alias("bytes"))


def _landed(spark, sf_dir: str) -> str:
    path = scratch.folder(spark)
    packets(spark, sf_dir).write.parquet(path)
    return path


def _streamed(spark, sf_dir: str, operator) -> DataFrame:
    """What a stream over the landed packets has written when all files are read."""
    rows, out = live.packets(spark, _landed(spark, sf_dir), PACKET, start=START), scratch.folder(spark)
    query = operator(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _stream_graph(spark, sf_dir):
    rows, out = live.packets(spark, _landed(spark, sf_dir), PACKET), scratch.folder(spark)
    live.graph_refresh(rows, out).option("checkpointLocation", scratch.folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/0/nodes").select("key", "kind", "hits")


def _stream_captures(spark, sf_dir):
    path, out = scratch.folder(spark), scratch.folder(spark)
    pcap.write(packets(spark, sf_dir), path)
    rows = decode.decoded(live.captures(spark, path).withColumn("no", F.col("record")).select("no", "timestamp", "bytes"))
    rows.select("protocol", "src", "dst_port").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("protocol", "src").agg(F.count("*").alias("packets"))


def _owner_stream(spark, sf_dir):
    path, out = _written(spark, sf_dir, OWNER_LINES, "supplier"), scratch.folder(spark)
    feeds.socket_owner_stream(spark, path).select("protocol", "local_ip", "local_port", "pid", "command").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _evidence(spark, sf_dir):
    path = scratch.folder(spark)
    found = entities._incidents(spark, sf_dir)
    rows = incidents.history(found, packets(spark, sf_dir))
    exports.evidence(rows, path)
    exports.evidence(rows, path)  # what is there stays as it is
    return spark.read.json(path).groupBy("attacker").agg(F.count("*").alias("packets"), F.min("no").alias("first_no"), F.max("no").alias("last_no"))


def _graph_files(spark, sf_dir):
    path = scratch.folder(spark)
    exports.graph(*graph.merged(graph.from_packets(packets(spark, sf_dir))), path, "csv")
    return spark.read.option("header", True).csv(f"{path}/edges").select("src", "dst", "kind", F.col("hits").cast("long").alias("hits"))


def _case(spark, sf_dir):
    path, p = scratch.folder(spark), packets(spark, sf_dir)
    known = lookups._indicators(spark, sf_dir)
    exports.case(exports.case_sections(p, {"ioc_hits": known, "alerts": detect.auth_burst(p)}), path)
    back = exports.load_case(spark, path)
    return back["ioc_hits"].groupBy("context").agg(F.count("*").alias("hits"), F.max("value").alias("value")).withColumns({"sections": F.lit(",".join(sorted(back))), "hosts": F.lit(back["hosts"].count())})


def _snapshot(spark, sf_dir) -> DataFrame:
    """All numbers: HTTPS packets are those in view, SSH packets those that a rule hits; incidents are pending, and one packet of each has been kept."""
    p = packets(spark, sf_dir)
    found = entities._incidents(spark, sf_dir)
    hits = enrich.indicator_hits(p, spark.sql(lookups.INDICATORS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet")))
    counted = {
        "visible_packets": p.where("dst_port = 443"), "rule_hits": p.where("protocol = 'SSH'"), "ioc_hits": hits, "pending_incidents": found.withColumn("status", F.when(F.col("first_no") % 2 == 0, "pending").otherwise("closed")),
        "evidence_exports": found, "enriched_addresses": p.select(F.explode(F.array("src", "dst")).alias("address")),
    }
    return exports.metrics(p, detect.auth_burst(p), counted=counted, capturing=True)


def _metrics(spark, sf_dir):
    return _snapshot(spark, sf_dir).drop("latency_p95_ms")


def _metrics_text(spark, sf_dir):
    return exports.open_metrics(_snapshot(spark, sf_dir))


def _summary(spark, sf_dir):
    nodes, edges = entities._scored(spark, sf_dir)
    parts = exports.graph_summary(nodes, graph.paths(nodes, edges), graph.clusters(nodes, edges))
    return parts["nodes"].select(F.lit("node").alias("part"), F.col("key").alias("name"), "score").unionByName(parts["paths"].select(F.lit("path").alias("part"), F.concat_ws(" ", "kind", "node").alias("name"), "score")).unionByName(parts["clusters"].select(F.lit("cluster").alias("part"), F.concat_ws(" ", "kind", "label").alias("name"), "score"))


TAGGED = frames.frames(frames.EVENTS, frames._IP, "'10.0.1.1'", ["'000000000001'", frames._MAC, f"CASE WHEN k % 3 = 0 THEN concat('88A8', {frames.hx('8192 * (k % 8) + 100', 4)}) ELSE '' END", "'8100'", frames.hx("8192 * (k % 8) + 4096 * (k % 2) + u", 4), "'0800'", *frames.ipv4("20", "06", frames._IP4, "'0A000101'"), *frames.tcp("40000", "80", "n")], "'HTTP'", sport="40000", dport="80")
DEEP = frames.frames(frames.EVENTS, frames._IP, "'10.0.1.1'", ["'000000000001'", frames._MAC, "repeat('81000001', CAST(k % 6 AS INT))", "'0800'", *frames.ipv4("8", "11", frames._IP4, "'0A000101'"), *frames.udp("5353", "5353", 0)], "'mDNS'", sport="5353", dport="5353")


def _layer(sql: str, layers: tuple[str, ...]):
    return frames.over(sql, lambda p: fields.fields(p, layers).select("no", "path", "value"))


def queries() -> dict:
    return {
        "s1_captures": _captures,
        "s3_decoded_names": frames.over(frames.NAMES, lambda p: decode.decoded(p.select("no", "timestamp", "bytes")).select("no", "protocol", "src", "dst", "info", "src_port")),
        "s3_decoded_arp": frames.over(frames.ARP, lambda p: decode.decoded(p.select("no", "timestamp", "bytes")).select("no", "protocol", "src", "dst", "info")),
        "s3_decoded_neighbours": frames.over(frames.NEIGHBOURS, lambda p: decode.decoded(p.select("no", "timestamp", "bytes")).select("no", "protocol", "src", "info")),
        "s3_decoded_tags": frames.over(TAGGED, lambda p: decode.decoded(p.select("no", "timestamp", "bytes")).select("no", "protocol", "vlan_id", "vlan_pcp", "vlan_dei", "outer_vlan_id", "dst_port")),
        "s3_decoded_deep_tags": frames.over(DEEP, lambda p: decode.decoded(p.select("no", "timestamp", "bytes")).select("no", "protocol", "dst")),
        "p2_vlan_fields": _layer(TAGGED, ("VLAN", "Outer VLAN")),
        "p2_deep_tags": frames.over(DEEP, lambda p: fields.fields(p, paths=("udp.dstport",)).select("no", "value", "offset")),
        "p3_ipv6_fields": _layer(frames.NEIGHBOURS, ("IPv6",)),
        "p4_udp_fields": _layer(frames.QUIC, ("UDP",)),
        "p5_tls_fields": _layer(frames.HELLOS, ("TLS",)),
        "s6_indicators": _feed(INDICATOR_LINES, "customer", lambda s, p: feeds.indicators(s, p).select("kind", "value", "description")),
        "s7_plain_indicators": _feed(PLAIN_LINES, "customer", lambda s, p: feeds.plain_indicators(s, p).select("kind", "value")),
        "s8_rules": lambda spark, sf_dir: (lambda s, p: s.createDataFrame([(r["id"], r["name"], r.get("enabled", True)) for r in rules.load(s, p)], "id string, name string, enabled boolean"))(spark, _rule_files(spark, sf_dir)),
        "s9_prefixes": _feed(PREFIX_LINES, "supplier", feeds.prefixes),
        "s10_reputation": _feed(REPUTATION_LINES, "supplier", feeds.reputation),
        "s11_socket_owners": _feed(OWNER_LINES, "supplier", lambda s, p: feeds.socket_owners(s, p).select("protocol", "local_ip", "local_port", "remote_port", "pid", "uid", "process", "command")),
        "s12_owner_stream": _owner_stream,
        "s13_key_log": _feed(KEY_LINES, "supplier", feeds.key_log),
        "s5_stream_captures": _stream_captures,
        "s15_evidence": _evidence,
        "s17_graph_files": _graph_files,
        "s18_graph_summary": _summary,
        "s21_case": _case,
        "s22_metrics": _metrics,
        "s22_metrics_text": _metrics_text,
        "z3_stream_timeline": lambda spark, sf_dir: _streamed(spark, sf_dir, lambda r: live.timeline(r, 5, "1 second").withColumn("bucket", F.col("bucket") - START)),
        "z4_stream_bursts": lambda spark, sf_dir: _streamed(spark, sf_dir, lambda r: live.sliding_bursts(r, ["src", "dst_port"], 8, 60.0, "dst")),
        "z5_stream_sessions": lambda spark, sf_dir: _streamed(spark, sf_dir, lambda r: live.bursts(r.where("dst_port = 22"), ["src"], 3, 1, "1 second")),
        "z6_stream_changes": lambda spark, sf_dir: _streamed(spark, sf_dir, lambda r: live.changes(r, "src", "protocol").select("src", "no", "before", "after")),
        "z9_stream_handshakes": lambda spark, sf_dir: _streamed(spark, sf_dir, lambda r: live.handshakes(_answered(r)).select("no", "client", "port", F.round("latency_ms", 3).alias("latency_ms"))),
        "z10_stream_indicators": lambda spark, sf_dir: _streamed(spark, sf_dir, lambda r: live.indicator_hits(r, spark.sql(lookups.INDICATORS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))).select("no", "context", "value", "description")),
        "z11_stream_graph": _stream_graph,
    }


def _answered(rows: DataFrame) -> DataFrame:
    """Every third request of a stream with an answer of its own, 20 ms later, and every sixth with another one 2 ms after that,
    which nobody waits for any more."""
    answer = lambda ms: F.struct(
        F.col("no"), (F.col("timestamp") + ms / 1000).alias("timestamp"), F.expr(f"event_time + interval {ms} milliseconds").alias("event_time"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port"),
        F.expr("unhex(concat(substring(hex(bytes), 1, 94), '12', substring(hex(bytes), 97)))").alias("bytes"),
    )
    own = F.struct("no", "timestamp", "event_time", "src", "dst", "src_port", "dst_port", "bytes")
    third, sixth = F.when(F.col("no") % 3 == 0, answer(20)), F.when(F.col("no") % 6 == 0, answer(22))
    return rows.select(F.inline(F.array_compact(F.array(own, third, sixth))))


def oracle_sql(known: dict[str, str]) -> dict[str, str]:
    p = f"WITH p AS ({SQL.replace('{events}', 'events')})"
    ev = frames.EVENTS.replace("{events}", "events")
    of = lambda size: frames.part(size).replace("{events}", "events")
    path = lambda rows: f"SELECT n + 1 AS no, unnest([{', '.join(repr(a) for a, _ in rows)}]) AS path, unnest([{', '.join(v for _, v in rows)}]) AS value"
    lines = lambda sql, table: f"({sql.replace('{' + table + '}', table).replace('{{', '{').replace('}}', '}')})"
    pcp, dei = "CAST(k % 8 AS VARCHAR)", "CAST(k % 2 AS VARCHAR)"
    outer = f"SELECT n + 1 AS no, unnest(['vlan.outer.id', 'vlan.outer.pcp', 'vlan.outer.dei']) AS path, unnest(['100', {pcp}, '0']) AS value FROM {ev} e WHERE k % 3 = 0"
    nodes = known["g1_nodes"]
    out = {
        "s1_captures": f"{p} SELECT round(timestamp, 6) AS timestamp, CAST(octet_length(bytes) AS INT) AS length, hex(bytes) AS bytes FROM p",
        "s3_decoded_names": f"SELECT n + 1 AS no, 'DNS' AS protocol, CASE WHEN {frames._ASKS} THEN {frames._CLIENT} ELSE '8.8.8.8' END AS src, CASE WHEN {frames._ASKS} THEN '8.8.8.8' ELSE {frames._CLIENT} END AS dst, concat(CASE WHEN {frames._ASKS} THEN concat(30000 + d % 1000, ' → 53') ELSE concat('53 → ', 30000 + d % 1000) END, ' Len=32') AS info, CASE WHEN {frames._ASKS} THEN 30000 + d % 1000 ELSE 53 END AS src_port FROM (SELECT * FROM {of(4)} f0 WHERE true) f",
        "s3_decoded_arp": f"SELECT n + 1 AS no, 'ARP' AS protocol, concat('10.0.0.', u) AS src, '10.0.0.99' AS dst, concat('Who has 10.0.0.99? Tell 10.0.0.', u, ' (reply)') AS info FROM {ev} e",
        "s3_decoded_neighbours": f"SELECT n + 1 AS no, 'ICMPv6' AS protocol, concat(CASE WHEN k % 6 = 0 THEN '2001' ELSE 'fe80' END, repeat(':0000', 6), ':000', u) AS src, CASE WHEN e IN ('view', 'click') THEN 'Router advertisement' ELSE 'Neighbor advertisement' END AS info FROM {ev} e",
        "s3_decoded_tags": f"SELECT n + 1 AS no, 'HTTP' AS protocol, u AS vlan_id, k % 8 AS vlan_pcp, k % 2 AS vlan_dei, CASE WHEN k % 3 = 0 THEN 100 END AS outer_vlan_id, 80 AS dst_port FROM {ev} e",
        "s3_decoded_deep_tags": f"SELECT n + 1 AS no, 'mDNS' AS protocol, '10.0.1.1' AS dst FROM {ev} e",
        "p2_vlan_fields": f"SELECT n + 1 AS no, unnest(['vlan.id', 'vlan.pcp', 'vlan.dei']) AS path, unnest([CAST(u AS VARCHAR), {pcp}, {dei}]) AS value FROM {ev} e UNION ALL {outer}",
        "p2_deep_tags": f"""SELECT n + 1 AS no, '5353' AS value, 36 + 4 * (k % 6) AS "offset" FROM {ev} e""",
        "p3_ipv6_fields": path([("ip.version", "'6'"), ("ipv6.payload_len", "'32'"), ("ipv6.next_header", "'58'"), ("ipv6.hop_limit", "CASE WHEN k % 10 = 0 THEN '64' ELSE '255' END"), ("ipv6.src", "concat(CASE WHEN k % 6 = 0 THEN '2001' ELSE 'fe80' END, repeat(':0000', 6), ':000', u)"), ("ipv6.dst", "'ff02:0000:0000:0000:0000:0000:0000:0001'")]) + f" FROM {ev} e",
        "p4_udp_fields": path([("udp.srcport", "CAST(40000 + u AS VARCHAR)"), ("udp.dstport", "'443'"), ("udp.length", "'32'"), ("udp.checksum", "'0x0000'")]) + f" FROM {ev} e",
        "p5_tls_fields": path([("tls.record.content_type", "'handshake'"), ("tls.record.version", "CASE WHEN part = 0 THEN '0x0301' ELSE '0x0303' END"), ("tls.record.length", "CASE WHEN part = 0 THEN '107' ELSE '44' END")]) + f" FROM {of(2)} f",
        "s6_indicators": f"""SELECT lower(trim(string_split(value, ',')[1])) AS kind, trim(string_split(value, ',')[2]) AS value, CASE WHEN starts_with(value, 'Domain') THEN 'x, y' WHEN starts_with(value, 'ip') THEN string_split(value, ',')[3] ELSE '' END AS description FROM {lines(INDICATOR_LINES, 'customer')} l WHERE NOT starts_with(value, '#') AND NOT starts_with(value, 'port')""",
        "s7_plain_indicators": f"SELECT CASE WHEN starts_with(value, 'd') THEN 'domain' ELSE 'ip' END AS kind, value FROM {lines(PLAIN_LINES, 'customer')} l WHERE contains(value, '.') AND NOT starts_with(value, '#')",
        "s8_rules": "SELECT concat('r', s_suppkey) AS id, concat('n', s_suppkey % 3) AS name, s_suppkey % 2 = 0 AS enabled FROM supplier",
        "s9_prefixes": "SELECT concat('198.', s_suppkey % 100, '.0.0/16') AS cidr, concat('AS', s_suppkey) AS asn, s_name AS organization FROM supplier",
        "s10_reputation": "SELECT CASE s_suppkey % 2 WHEN 0 THEN 'address' ELSE 'fingerprint' END AS kind, CASE s_suppkey % 2 WHEN 0 THEN concat('198.', s_suppkey % 100, '.0.0/16') ELSE concat('t13d', s_suppkey) END AS target, CASE s_suppkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS severity, s_name AS label, 'feed' AS source FROM supplier",
        "s11_socket_owners": "SELECT 'TCP' AS protocol, concat('10.0.0.', s_suppkey % 6 + 1) AS local_ip, 40000 + s_suppkey % 9 AS local_port, 443 AS remote_port, s_suppkey AS pid, s_suppkey % 4 AS uid, concat('p', s_suppkey % 5) AS process, 'run a,b' AS command FROM supplier WHERE s_suppkey % 5 > 0",
        "s12_owner_stream": "SELECT 'TCP' AS protocol, concat('10.0.0.', s_suppkey % 6 + 1) AS local_ip, 40000 + s_suppkey % 9 AS local_port, s_suppkey AS pid, 'run a,b' AS command FROM supplier WHERE s_suppkey % 5 > 0",
        "s13_key_log": "SELECT 'CLIENT_RANDOM' AS label, concat(md5(s_name), md5(s_name)) AS client_random, 16 AS secret_bytes FROM supplier WHERE s_suppkey % 3 = 0",
        "s5_stream_captures": f"{p} SELECT CASE protocol WHEN 'TCP' THEN 'TCP' ELSE protocol END AS protocol, src, count(*) AS packets FROM p GROUP BY ALL",
        "s15_evidence": known["j12_incident_packets"],
        "s17_graph_files": f"SELECT src, dst, kind, hits FROM ({known['g1_edges']}) e WHERE kind IN ('CommunicatesWith', 'BelongsToHost', 'UsesService')",
        "s18_graph_summary": f"SELECT 'node' AS part, key AS name, score FROM (SELECT * FROM ({known['g5_scores']}) s ORDER BY score DESC, key LIMIT 10) a UNION ALL SELECT 'path', concat_ws(' ', kind, node), score FROM (SELECT * FROM ({known['g6_paths']}) q ORDER BY score DESC, kind, node LIMIT 10) b UNION ALL SELECT 'cluster', concat_ws(' ', kind, label), score FROM (SELECT * FROM ({known['g7_clusters']}) q ORDER BY score DESC, kind, label LIMIT 10) c",
        "s21_case": f"{p} SELECT context, count(*) AS hits, max(value) AS value, 'alerts,hosts,ioc_hits,meta' AS sections, (SELECT count(*) FROM ({known['a5_hosts']}) h) AS hosts FROM ({known['j1_indicator_hits']}) i GROUP BY context",
        "s22_metrics": f"""{p} SELECT count(*) AS packets_total, sum(length) AS bytes_total, (SELECT count(*) FROM ({known['a1_flows']}) f) AS flows, (SELECT count(*) FROM ({known['a5_hosts']}) h) AS hosts, (SELECT count(*) FROM ({known['d_bf_auth_burst']}) d) AS security_findings, (SELECT count(*) FROM p WHERE floor(timestamp) = (SELECT floor(max(timestamp)) FROM p)) AS packets_per_second, (SELECT count(*) FROM p WHERE dst_port = 443) AS visible_packets, (SELECT count(*) FROM p WHERE protocol = 'SSH') AS rule_hits, (SELECT count(*) FROM ({known['j1_indicator_hits']}) h) AS ioc_hits, (SELECT count(*) FROM ({known['i4_incidents']}) h WHERE first_no % 2 = 0) AS pending_incidents,
            (SELECT count(*) FROM ({known['i4_incidents']}) h) AS evidence_exports, (SELECT count(DISTINCT a) FROM (SELECT src AS a FROM p UNION ALL SELECT dst FROM p) x) AS enriched_addresses, 1 AS capturing FROM p""",
        "z3_stream_timeline": f"{p} SELECT * FROM (SELECT floor(timestamp / 5) * 5.0::DOUBLE AS bucket, count(*) AS packets, sum(length) AS bytes FROM p GROUP BY 1) b WHERE bucket + 5 <= (SELECT max(timestamp) - 1 FROM p)",
        "z4_stream_bursts": f"""{p}, w AS (SELECT *, count(DISTINCT dst) OVER (PARTITION BY src, dst_port ORDER BY timestamp RANGE BETWEEN 60.0::DOUBLE PRECEDING AND CURRENT ROW) AS hits, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY src, dst_port ORDER BY timestamp, no) > 60 THEN 1 ELSE 0 END AS new FROM p),
            s AS (SELECT *, sum(new) OVER (PARTITION BY src, dst_port ORDER BY timestamp, no ROWS UNBOUNDED PRECEDING) AS session FROM w) SELECT src, dst_port, min(no) AS no, arg_min(timestamp, no) AS timestamp FROM s WHERE hits >= 8 GROUP BY src, dst_port, session""",
        "z5_stream_sessions": f"""{p}, w AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY src ORDER BY timestamp, no) > 1 THEN 1 ELSE 0 END AS new FROM p WHERE dst_port = 22), s AS (SELECT *, sum(new) OVER (PARTITION BY src ORDER BY timestamp, no ROWS UNBOUNDED PRECEDING) AS session FROM w)
            SELECT src, count(*) AS hits, min(no) AS first_no, max(no) AS last_no FROM s GROUP BY src, session HAVING count(*) >= 3 AND max(timestamp) + 1 <= (SELECT max(timestamp) - 1 FROM p WHERE dst_port = 22)""",
        "z6_stream_changes": f"{p} SELECT src, no, before, protocol AS after FROM (SELECT *, lag(protocol) OVER (PARTITION BY src ORDER BY timestamp, no) AS before FROM p) l WHERE before <> protocol",
        "z10_stream_indicators": f"SELECT no, context, value, description FROM ({known['j1_indicator_hits']}) i",
        "z11_stream_graph": f"SELECT key, kind, count(*) AS hits FROM ({p} SELECT concat('Host:', src) AS key, 'Host' AS kind FROM p UNION ALL SELECT concat('Host:', dst), 'Host' FROM p UNION ALL SELECT concat('Service:', dst, ':', dst_port, '/', protocol), 'Service' FROM p) t GROUP BY key, kind",
        "z9_stream_handshakes": f"{p} SELECT no, src AS client, dst_port AS port, 20.0::DOUBLE AS latency_ms FROM p WHERE no % 3 = 0",
    }
    text = " || ".join(f"'# TYPE netloom_{name} {kind}' || chr(10) || 'netloom_{name} ' || {'coalesce(CAST(' + c + ' AS VARCHAR), chr(48))' if c != 'latency_p95_ms' else chr(39) + '0' + chr(39)} || chr(10)" for c, (name, kind) in exports.METRICS.items())
    out["s22_metrics_text"] = f"SELECT {text} || '# EOF' || chr(10) AS text FROM ({out['s22_metrics']}) m"
    return out
