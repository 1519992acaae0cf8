"""Registered queries of predicates, searches, objects in payloads, layouts and small tables, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import packet as X
from netloom.functions import text as T
from netloom.operators import detect, enrich, fields, findings, graph, incidents, layouts, objects, processes, rules, search, signatures, strings, traffic
from netloom.operators import fingerprints as prints
from netloom.operators.windows import sessions, sliding
from netloom.plans import entities, frames, lookups
from netloom.plans.packets import SQL, packets

#: Tags of packets, notes about them, ranges, layouts and reputations, from the given tables; the SQL runs in both engines.
TAGS = "SELECT n + 1 AS no, CASE WHEN k % 3 = 0 THEN '__marked__' ELSE e END AS tag FROM " + frames.EVENTS + " e1 WHERE k % 5 = 0"
NOTES = "SELECT c_custkey AS id, c_name AS text, CAST(c_custkey AS DOUBLE) AS timestamp, concat('pkt#', CAST(c_custkey % 50 AS STRING)) AS evidence, array(concat('t', CAST(c_nationkey % 5 AS STRING))) AS tags FROM {customer}"
RANGES = "SELECT concat('203.0.113.', CAST(s_suppkey % 4 AS STRING), '/', CAST(24 + s_suppkey % 9 AS STRING)) AS cidr, concat('R', CAST(s_suppkey % 7 AS STRING)) AS label, s_suppkey AS priority FROM {supplier}"
LAYOUTS = "SELECT concat('L', CAST(s_suppkey AS STRING)) AS name, 'tcp' AS transport, CAST(CASE s_suppkey % 3 WHEN 0 THEN 22 WHEN 1 THEN 443 ELSE 1000 + s_suppkey END AS INT) AS port, CAST(s_suppkey % 10 AS INT) AS field_offset, CAST(s_suppkey % 4 + 1 AS INT) AS field_length, 'f' AS field_name, CASE s_suppkey % 2 WHEN 0 THEN 'dec' ELSE 'hex' END AS display FROM {supplier} WHERE s_suppkey <= 30"
REPUTATION = "SELECT 'address' AS kind, concat('203.0.113.', CAST(s_suppkey % 4 AS STRING), '/', CAST(24 + s_suppkey % 9 AS STRING)) AS target, CASE s_suppkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS severity, s_name AS label, 'feed' AS source FROM {supplier}"
#: Rules of patterns over pages: a rule of two patterns, one of bytes with a gap, one without a condition, one that asks for a name.
PATTERNS = [
    {"rule": "both", "pattern": "$a", "kind": "literal", "text": "<NAV>", "nocase": True, "condition": "all"}, {"rule": "both", "pattern": "$b", "kind": "literal", "text": "MIT License", "nocase": False, "condition": "all"},
    {"rule": "gap", "pattern": "$h", "kind": "hex", "text": "3C 68 ?? 3E", "nocase": False, "condition": "any"}, {"rule": "always", "pattern": "$t", "kind": "literal", "text": "<footer>", "nocase": False, "condition": "true"},
    {"rule": "named", "pattern": "$x", "kind": "literal", "text": "<article>", "nocase": False, "condition": "$y"}, {"rule": "named", "pattern": "$y", "kind": "literal", "text": "zzzzqqq", "nocase": False, "condition": "$y"},
]


def _sql(template: str, **tables: str):
    return lambda spark, sf_dir: spark.sql(template, **{k: spark.read.parquet(f"{sf_dir}/{v}.parquet") for k, v in tables.items()})


def _tags(spark, sf_dir) -> DataFrame:
    return _sql(TAGS, events="events")(spark, sf_dir)


def _notes(spark, sf_dir) -> DataFrame:
    return _sql(NOTES, customer="customer")(spark, sf_dir)


def _over(operator):
    return lambda spark, sf_dir: operator(packets(spark, sf_dir))


def _pages(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data"))


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = packets(spark, sf_dir)
    half = p.agg(F.max("timestamp")).first()[0] / 2
    return p.where(F.col("timestamp") < half), p.where(F.col("timestamp") >= half)


def _deltas(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return traffic.deltas(a, b)


def _findings(spark, sf_dir) -> DataFrame:
    p = packets(spark, sf_dir)
    return detect.vertical_scan(p).unionByName(detect.auth_burst(p))


def _search(spark, sf_dir):
    p = packets(spark, sf_dir)
    hosts = traffic.hosts(p).select(F.col("ip").alias("label"), F.concat(F.lit("pkts:"), (F.col("packets_out") + F.col("packets_in")).cast("string"), F.lit(" bytes:"), (F.col("bytes_out") + F.col("bytes_in")).cast("string")).alias("detail"), F.lit("").alias("hay"), F.col("ip").alias("place"))
    hits = lookups._indicators(spark, sf_dir).select(F.concat(F.lit("IP "), "value").alias("label"), F.col("context").alias("detail"), F.lit("").alias("hay"), F.col("no").alias("place"))
    return search.search({"Packet": search.packet_finds(p), "Host": hosts, "IOC Hit": hits}, "10.0.1.1")


def _compared(spark, sf_dir):
    p = packets(spark, sf_dir)
    return fields.compared(p.where("no = 1"), p.where("no = 8"))


def _first_difference(spark, sf_dir):
    p = packets(spark, sf_dir)
    return fields.first_difference(p.where("no = 1"), p.where("no = 8"))


def _graph_view(spark, sf_dir):
    nodes, edges = entities._scored(spark, sf_dir)
    kept, ends = search.graph_view(nodes, edges, ["Host", "IOC"], 0.1)
    return kept.select("key", "score")


def _pivots(spark, sf_dir):
    nodes, edges = entities._scored(spark, sf_dir)
    return graph.pivots(nodes.where("kind <> 'Alert'"), edges.where("kind <> 'TriggersAlert'")).groupBy("key").agg(F.count("*").alias("steps"), F.round(F.max("score"), 6).alias("best"))


def _evidence(spark, sf_dir):
    p = packets(spark, sf_dir)
    touches = p.select(F.concat(F.lit("Host:"), "src").alias("key"), "no", "timestamp").unionByName(p.select(F.concat(F.lit("Host:"), "dst").alias("key"), "no", "timestamp"))
    return search.evidence_of(graph.merged(graph.from_packets(p))[0].where("kind = 'Host'").select("key"), touches, "key")


def _put_notes(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    changes = notes.where("id % 10 = 0").select("id", F.concat("text", F.lit("!")).alias("text"), "timestamp", "evidence", "tags").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("new").alias("text"), F.lit(1.0).alias("timestamp"), F.lit("pkt#1").alias("evidence"), F.array().cast(notes.schema["tags"].dataType).alias("tags")))
    return search.drop_notes(search.put_notes(notes, changes), notes.where("id % 7 = 0")).select("id", "text", "evidence")


def _changed_tags(spark, sf_dir):
    tags = _tags(spark, sf_dir).select(F.concat(F.lit("pkt#"), F.col("no").cast("string")).alias("evidence"), "tag")
    more = tags.select("evidence", F.lit("seen").alias("tag"))
    return search.drop_tags(search.add_tags(tags, more), tags.where("tag = '__marked__'").select("evidence"))


def _moved_on(spark, sf_dir):
    found = entities._incidents(spark, sf_dir).withColumns({"status": F.lit("pending"), "reviewed": F.lit(False)})
    some = found.where("first_no % 2 = 0").select("incident_id")
    more = found.where("first_no % 3 = 0").select("incident_id")
    return search.acknowledged(search.reviewed(found, some), more).groupBy("status", "reviewed").agg(F.count("*").alias("incidents"))


def _dissect(payload: bytes, ends: dict) -> list[tuple[str, str, int]]:
    return [("kind", payload.decode("latin-1"), 0), ("size", str(len(payload)), 1)]


def _laid_out(spark, sf_dir):
    return layouts.laid_out(packets(spark, sf_dir), _sql(LAYOUTS, supplier="supplier")(spark, sf_dir))


def _annotated(spark, sf_dir):
    p = packets(spark, sf_dir)
    ranges = [(26, 4, "source", "ip"), (0, 6, "to", "mac"), (47, 1, "flags", "flags"), (34, 2, "port", "uint"), (36, 2, "far", "sint"), (54, 4, "text", "string"), (12, 2, "type", "bytes")]
    notes = p.select("no", F.inline(F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(n).alias("length"), F.lit(name).alias("name"), F.lit(kind).alias("kind")) for o, n, name, kind in ranges))))
    return layouts.annotated(p, notes).select("no", "name", "value")


def _ends(spark, sf_dir):
    return packets(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("address"))


def queries() -> dict:
    number = {"f4_longer": ("frame.len", ">", 60), "f4_length": ("frame.len", "==", 59.4), "f10_life": ("ip.ttl", "==", 64), "f10_number": ("frame.number", "<=", 10), "f5_port_other": ("tcp.port", "!=", 443)}
    text = {"f3_same_text": ("proto", "==", "ssh"), "f3_other_text": ("ip.dst", "!=", "10.0.1.7"), "f3_text_order": ("ip.src", ">=", "10.0.0.4"), "f9_port_text": ("tcp.dstport", "==", "443")}
    out = {k: _over(lambda p, v=v: p.where(X.number_is(*v)).select("no")) for k, v in number.items()}
    out |= {k: _over(lambda p, v=v: p.where(X.text_is(*v)).select("no")) for k, v in text.items()}
    matches = lambda spark, sf_dir: objects.pattern_hits(_pages(spark, sf_dir), PATTERNS, "page_id")
    carved = lambda spark, sf_dir: objects.carved(_pages(spark, sf_dir), "page_id", with_data=False)
    vlan = lambda spark, sf_dir: frames.made(frames.VLANS)(spark, sf_dir)
    info = lambda spark, sf_dir: frames.made(frames.TUNNELS)(spark, sf_dir)
    return out | {
        "f2_marked": lambda spark, sf_dir: search.tagged(packets(spark, sf_dir), _tags(spark, sf_dir), search.MARK).select("no"),
        "f2_tagged": lambda spark, sf_dir: search.tagged(packets(spark, sf_dir), _tags(spark, sf_dir), "view").select("no"),
        "f6_holds": _over(lambda p: p.where(X.contains("info", "URCH")).select("no")),
        "f7_in": _over(lambda p: p.where(X.is_in("proto", ["Http", "smb"]) | X.is_in("tcp.port", [22, 1007])).select("no")),
        "f8_logic": lambda spark, sf_dir: vlan(spark, sf_dir).where(~(X.number_is("vlan.id", "==", 20) | X.text_is("info", "==", "error")) & ~X.number_is("vlan.pcp", ">", 3)).select("no"),
        "f11_two_tags": lambda spark, sf_dir: vlan(spark, sf_dir).where(X.is_qinq()).select("no"),
        "f12_free_text": _over(lambda p: p.where(X.free_text("SsH")).select("no")),
        "f20_blockable": lambda spark, sf_dir: _ends(spark, sf_dir).unionByName(_ends(spark, sf_dir).select(F.concat(F.lit("224."), F.expr("substring(address, instr(address, '.') + 1)")).alias("address"))).distinct().select("address", incidents.is_blockable(F.col("address")).alias("blockable")),
        "p7_drill_down": _over(lambda p: p.where(reduce(lambda a, b: a & b, (X.field_predicate(*f) for f in (("ip.src", "10.0.0.2"), ("proto", "HTTPS"), ("frame.len", "58"))))).select("no")),
        "p14_names": lambda spark, sf_dir: info(spark, sf_dir).select("no", X.word_of(F.col("info"), 0).alias("method"), X.word_of(F.col("info"), 1).alias("uri"), X.dns_name(F.col("info")).alias("qname"), X.http_host(F.concat(F.lit("GET / Host: h"), F.col("no").cast("string"), F.lit(", x"))).alias("host")),
        "p8_layouts": _laid_out,
        "p10_annotations": _annotated,
        "p11_previews": lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", objects.preview(F.col("data")).alias("preview")),
        "e2_dissected": _over(lambda p: layouts.dissected(p, {("tcp", 22): _dissect}).select("no", "place", "label", "value", "indent")),
        "f14_graph_view": _graph_view,
        "f15_high": lambda spark, sf_dir: search.of_severity(_findings(spark, sf_dir), "high").groupBy("signature").agg(F.count("*").alias("findings")),
        "f16_hosts": _over(lambda p: search.hosts_like(traffic.hosts(p), "smb").select("ip")),
        "f17_notes": lambda spark, sf_dir: search.notes_like(_notes(spark, sf_dir), "T3").select("id"),
        "f17_notes_about": lambda spark, sf_dir: search.notes_for(_notes(spark, sf_dir), "pkt#7").select("id", "text"),
        "f18_search": _search,
        "j19_about_packets": lambda spark, sf_dir: search.about(packets(spark, sf_dir), _findings(spark, sf_dir), traffic.flows(packets(spark, sf_dir))),
        "a20_security_summary": lambda spark, sf_dir: search.security_summary(_findings(spark, sf_dir)),
        "x20_triaged": lambda spark, sf_dir: search.triaged(_findings(spark, sf_dir)).groupBy("source", "severity", "priority", "recommendation", "pinned").agg(F.count("*").alias("findings")),
        "k5_top_nodes": lambda spark, sf_dir: entities._scored(spark, sf_dir)[0].orderBy(F.desc("score"), "key").limit(20).select("key", "score"),
        "k8_top_hosts": _over(lambda p: objects.ranked(traffic.hosts(p).select("ip", "bytes_out"), "bytes_out", "ip", top=10)),
        "g8_pivots": _pivots,
        "g9_evidence": _evidence,
        "g3_other_nodes": _other_nodes,
        "u5_tags": _changed_tags,
        "u6_notes": _put_notes,
        "i6_reviewed": _moved_on,
        "j13_independent": lambda spark, sf_dir: incidents.independent(entities._incidents(spark, sf_dir).unionByName(entities._incidents(spark, sf_dir).where("first_no % 3 > 0").withColumn("detector", F.lit("other")))),
        "a14_deltas": _deltas,
        "j10_only_in_second": lambda spark, sf_dir: traffic.only_in(*_halves(spark, sf_dir)[::-1]),
        "j11_compared": _compared,
        "j11_first_difference": _first_difference,
        "j6_reputation": lambda spark, sf_dir: processes.address_reputation(_ends(spark, sf_dir), _sql(REPUTATION, supplier="supplier")(spark, sf_dir)),
        "j16_hosts_with_systems": lambda spark, sf_dir: prints.with_systems(traffic.hosts(frames.made(frames.WINDOWS)(spark, sf_dir)).select("ip"), prints.system_guesses(frames.made(frames.WINDOWS)(spark, sf_dir))),
        "x9_places": lambda spark, sf_dir: enrich.places(_ends(spark, sf_dir), _sql(RANGES, supplier="supplier")(spark, sf_dir)),
        "x4_ascii": _over(lambda p: p.select("no", T.ascii_payload(F.expr("substring(bytes, 50)")).alias("text"))),
        "x5_names": lambda spark, sf_dir: info(spark, sf_dir).select("no", T.domain(F.col("info")).alias("name"), T.apex(T.domain(F.col("info"))).alias("apex")),
        "x10_authority": lambda spark, sf_dir: info(spark, sf_dir).select("no", T.authority(F.expr("CASE no % 3 WHEN 0 THEN concat('TLS SNI=h', no, ', x') WHEN 1 THEN concat('GET / Host: ', no, '.org') ELSE info END")).alias("authority")),
        "x12_xor": lambda spark, sf_dir: frames.made("SELECT n + 1 AS no, unhex(concat(repeat(lpad(hex(128 + k % 100), 2, '0'), 12), repeat(lpad(hex(140 + k % 90), 2, '0'), 8))) AS data FROM " + frames.EVENTS + " e1")(spark, sf_dir).select("no", T.xor_key(F.col("data")).alias("x")).select("no", "x.key", F.round("x.score", 6).alias("score")),
        "x18_roles": _over(lambda p: p.select("no", T.service_role(F.col("dst_port"), F.expr("CASE WHEN no % 4 = 0 THEN protocol ELSE 'TCP' END")).alias("role"))),
        "x19_risk_labels": lambda spark, sf_dir: entities._scored(spark, sf_dir)[0].select("key", T.risk_label(F.col("score")).alias("label")),
        "x11_magic": lambda spark, sf_dir: signatures.magic(_magic(spark, sf_dir)),
        "x13_anomalies": lambda spark, sf_dir: signatures.anomalies(frames.made(frames.WHOLE.replace("CAST(8080 AS INT) AS dst_port", "CAST(CASE WHEN n % 2 = 0 THEN 8080 ELSE 9999 END AS INT) AS dst_port"))(spark, sf_dir)),
        "r3_found_at": lambda spark, sf_dir: objects.found_at(_pages(spark, sf_dir), b"THE", ["page_id"]).groupBy("page_id").agg(F.count("*").alias("places"), F.min("offset").alias("first")),
        "r4_http_streams": lambda spark, sf_dir: frames.made(frames.WHOLE)(spark, sf_dir).select("no", objects.is_http(F.expr("substring(bytes, 55)"), F.expr("CASE WHEN no % 3 = 0 THEN encode('HTTP/1.1 200', 'UTF-8') END")).alias("http"), objects.is_http(F.expr("substring(bytes, 56)")).alias("cut")),
        "r5_carved": carved,
        "r6_pattern_hits": lambda spark, sf_dir: matches(spark, sf_dir).select("page_id", "rule", "pattern", "offset", F.hex("bytes").alias("bytes")),
        "r7_unscanned": lambda spark, sf_dir: objects.unscanned(_pages(spark, sf_dir), matches(spark, sf_dir).where("page_id % 2 = 0"), "page_id").select("page_id"),
        "a25_rule_totals": lambda spark, sf_dir: objects.rule_totals(matches(spark, sf_dir), "page_id").withColumn("rules", F.array_join("rules", ",")),
        "j18_objects_with_rules": lambda spark, sf_dir: objects.with_rules(_pages(spark, sf_dir).select("page_id"), matches(spark, sf_dir), "page_id").withColumn("rules", F.array_join("rules", ",")),
        "w1_sliding_counts": _over(lambda p: sliding(p.select("no", "timestamp", "src"), ["src"], 2.0).select("no", "hits")),
        "w1_sliding_distinct": _over(lambda p: sliding(p.select("no", "timestamp", "src", "dst"), ["src"], 5.0, "dst").select("no", "hits")),
        "a2_encrypted": lambda spark, sf_dir: traffic.encrypted(frames.made(frames.NOISE)(spark, sf_dir).withColumn("vlan_id", F.lit(None).cast("int"))).select("a_ip", "b_ip", "is_encrypted"),
        "a6_nodes": _over(traffic.nodes),
        "a11_services": _over(traffic.ports),
        "a21_summary": lambda spark, sf_dir: strings.summary(strings.strings(_pages(spark, sf_dir), "page_id", "data")).withColumn("mean_entropy", F.round("mean_entropy", 6)),
        "u2_promotion": lambda spark, sf_dir: enrich.promotion(*(enrich.routes(h) for h in _halves(spark, sf_dir)[::-1])),
        "d_ioc_findings": lambda spark, sf_dir: findings.from_indicators(lookups._indicators(spark, sf_dir)),
        "d_cred_findings": lambda spark, sf_dir: findings.from_credentials(signatures.credentials(_logins(spark, sf_dir)), _logins(spark, sf_dir)),
        "d_drift_findings": _drifted,
        "u3_findings": lambda spark, sf_dir: findings.union(_findings(spark, sf_dir), findings.from_indicators(lookups._indicators(spark, sf_dir)), findings.from_rules(rules.hits(packets(spark, sf_dir), entities.RULES))).groupBy("source", "signature", "severity").agg(F.count("*").alias("findings")),
        "w1_sessions": _over(lambda p: sessions(p, ["src", "protocol"], 1.0).groupBy("src", "protocol", "session").agg(F.count("*").alias("packets"))),
        "x2_text_entropy": lambda spark, sf_dir: strings.strings(_pages(spark, sf_dir), "page_id", "data").where("length >= 5 and length < 40").groupBy("value").agg(F.round(F.max("entropy"), 6).alias("entropy")),
    }


MAGIC = "SELECT n + 1 AS no, unhex(concat(CASE k % 4 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN '504B03040000' ELSE repeat('00', 14) END, CASE WHEN k % 4 > 1 THEN '25504446' ELSE '' END, repeat('00', 60))) AS bytes FROM " + frames.EVENTS + " e1"


#: Every fifth event is a log-in by FTP, in clear.
LOGINS = "SELECT n + 1 AS no, t AS timestamp, concat('10.0.0.', CAST(u AS STRING)) AS src, '10.0.1.1' AS dst, encode(CASE k % 5 WHEN 0 THEN concat('USER u', CAST(k AS STRING)) WHEN 1 THEN concat('PASS p', CAST(n AS STRING)) ELSE e END, 'UTF-8') AS bytes FROM " + frames.EVENTS + " e1"


def _logins(spark, sf_dir):
    return frames.made(LOGINS)(spark, sf_dir)


def _other_nodes(spark, sf_dir):
    """What log-ins, rules and carved files add to the graph, by kind."""
    logins = _logins(spark, sf_dir)
    finds = signatures.credentials(logins).where("kind = 'FTP-USER'").select("no", F.lit("FTP").alias("scheme"), F.expr("substring(value, 6)").alias("username"))
    files = objects.carved(_pages(spark, sf_dir), "page_id", with_data=False).withColumns({"timestamp": F.lit(0.0), "flow_id": F.concat(F.lit("page"), F.col("page_id").cast("string"))})
    nodes, edges = graph.merged(graph.from_credentials(finds, logins), graph.from_rule_hits(rules.hits(packets(spark, sf_dir), entities.RULES)), graph.from_files(files))
    both = nodes.select("kind", "hits").unionByName(edges.select("kind", "hits"))
    return both.groupBy("kind").agg(F.count("*").alias("things"), F.sum("hits").alias("hits"))


def _drifted(spark, sf_dir):
    first, second = _halves(spark, sf_dir)
    return findings.from_drift(second, enrich.routes(first))


def _magic(spark, sf_dir):
    return frames.made(MAGIC)(spark, sf_dir)


def oracle_sql(known: dict[str, str]) -> dict[str, str]:
    """known has the SQL of queries that these ones begin with."""
    p = f"WITH p AS ({SQL.replace('{events}', 'events')})"
    ev = frames.EVENTS.replace("{events}", "events")
    tags = f"({TAGS.replace('{events}', 'events')})"
    notes = "(SELECT c_custkey AS id, c_name AS text, concat('pkt#', c_custkey % 50) AS evidence, concat('t', c_nationkey % 5) AS tag FROM customer)"
    tunnels = f"({frames.TUNNELS.replace('{events}', 'events')})"
    whole = f"({frames.WHOLE.replace('{events}', 'events')})"
    finds = f"(SELECT * FROM ({known['d10_vertical_scan']}) a UNION ALL SELECT * FROM ({known['d_bf_auth_burst']}) b)"
    number = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"
    ends = "(SELECT src AS address FROM p UNION SELECT dst FROM p)"
    inside = f"{number.format('a.address')} >> CAST(32 - x.bits AS INT) = {number.format('x.net')} >> CAST(32 - x.bits AS INT)"
    html = "(SELECT page_id, coalesce(html, '') AS html, translate(coalesce(html, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages)"
    where = {
        "f4_longer": "length > 60", "f4_length": "length = 59", "f10_life": "true", "f10_number": "no <= 10", "f5_port_other": "true", "f3_same_text": "protocol = 'SSH'", "f3_other_text": "dst <> '10.0.1.7'", "f3_text_order": "src >= '10.0.0.4'", "f9_port_text": "dst_port = 443",
        "f2_marked": f"no IN (SELECT no FROM {tags} t WHERE tag = '__marked__')", "f2_tagged": f"no IN (SELECT no FROM {tags} t WHERE tag = 'view')", "f6_holds": "info = 'purchase'", "f7_in": "protocol IN ('HTTP', 'SMB') OR dst_port IN (22, 1007)", "f12_free_text": "protocol = 'SSH'",
        "p7_drill_down": "src = '10.0.0.2' AND protocol = 'HTTPS' AND length = 58",
    }
    out = {k: f"{p} SELECT no FROM p WHERE {v}" for k, v in where.items()}
    ordered = lambda table, by, top: f"SELECT * FROM ({table}) o ORDER BY {by} LIMIT {top}"
    scores = known["g5_scores"]
    flow = known["a1_flows"]
    half = "(SELECT max(timestamp) / 2 FROM p)"
    delta = lambda kind, key, sum_: f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS value, CAST(coalesce(sum({sum_}) FILTER (timestamp < {half}), 0) AS BIGINT) AS first, CAST(coalesce(sum({sum_}) FILTER (timestamp >= {half}), 0) AS BIGINT) AS second FROM p GROUP BY {key}"
    # places of a text: the lengths of what comes before each of its occurrences, in bytes
    placed = lambda hay, hit: f"unnest(list_transform(range(1, len(string_split({hay}, '{hit}'))), lambda i: strlen(array_to_string(list_slice(string_split({hay}, '{hit}'), 1, i), '{hit}')))) AS place, '{hit}' AS hit"
    both = f"FROM {html} h WHERE contains(low, '<nav>') AND contains(html, 'MIT License')"
    hits = f"""SELECT page_id, 'both' AS rule, '$a' AS pattern, {placed('low', '<nav>')} {both} UNION ALL SELECT page_id, 'both', '$b', {placed('html', 'MIT License')} {both}
        UNION ALL SELECT page_id, 'gap', '$h', {placed('html', '<h1>')} FROM {html} h UNION ALL SELECT page_id, 'always', '$t', {placed('html', '<footer>')} FROM {html} h"""
    by_rule = f"(SELECT page_id, rule, count(*) AS n, min(place) AS place FROM ({hits}) h GROUP BY ALL)"
    out |= {
        "f8_logic": f"SELECT n + 1 AS no FROM {ev} e WHERE NOT (k % 5 = 1 OR e = 'error') AND k % 9 <> 0",
        "f11_two_tags": f"SELECT n + 1 AS no FROM {ev} e WHERE k % 7 = 0 AND k % 5 < 2",
        "f20_blockable": f"{p} SELECT address, NOT starts_with(address, '224.') AS blockable FROM (SELECT address FROM {ends} a UNION SELECT concat('224.', substring(address, position('.' IN address) + 1)) FROM {ends} a) z",
        "p14_names": f"SELECT no, 'Query' AS method, 'A' AS uri, string_split(info, ' ')[3] AS qname, concat('h', no) AS host FROM {tunnels} t",
        "p8_layouts": f"""{p}, l AS (SELECT * FROM ({LAYOUTS.format(supplier='supplier')}) s), z AS (SELECT no, name, port, field_offset, field_length, field_name, display, substring(hex(bytes), 85 + 2 * field_offset, 2 * field_length) AS part FROM p JOIN l ON l.port = p.dst_port)
            SELECT no, name AS layout, port, field_offset, field_name, CASE WHEN display = 'hex' THEN lower(rtrim(regexp_replace(part, '(..)', '\\1 ', 'g'))) WHEN field_length = 3 THEN array_to_string(list_transform(regexp_extract_all(part, '..'), lambda x: CAST(CAST('0x' || x AS BIGINT) AS VARCHAR)), ' ') ELSE CAST(CAST('0x' || part AS BIGINT) AS VARCHAR) END AS value FROM z""",
        "p10_annotations": f"""{p} SELECT no, unnest(['source', 'to', 'flags', 'port', 'far', 'text', 'type']) AS name, unnest([src, '00:00:00:00:00:01', '0b00000010', concat(src_port, ' (0x', lower(lpad(hex(src_port), 4, '0')), ')'), CAST(dst_port AS VARCHAR), substring(info, 1, 4), '08 00']) AS value FROM p""",
        "p11_previews": f"SELECT page_id, regexp_replace(regexp_replace(substring(regexp_replace(regexp_replace(html, '[\\x{{800}}-\\x{{FFFF}}]', '···', 'g'), '[\\x{{80}}-\\x{{7FF}}]', '··', 'g'), 1, 256), '[\\r\\n]', '↵', 'g'), '[^ -~↵]', '·', 'g') AS preview FROM (SELECT page_id, replace(html, '·', 'éé') AS html FROM {html} h0) h",
        "e2_dissected": f"{p} SELECT no, unnest([0, 1]) AS place, unnest(['kind', 'size']) AS label, unnest([info, CAST(length(info) AS VARCHAR)]) AS value, unnest([0, 1]) AS indent FROM p WHERE dst_port = 22",
        "f14_graph_view": f"SELECT key, score FROM ({scores}) s WHERE score >= 0.1 AND (starts_with(key, 'Host:') OR starts_with(key, 'IOC:'))",
        "f15_high": f"SELECT signature, count(*) AS findings FROM {finds} f WHERE severity = 'HIGH' GROUP BY 1",
        "f16_hosts": f"{p} SELECT DISTINCT unnest([src, dst]) AS ip FROM p WHERE protocol = 'SMB'",
        "f17_notes": f"SELECT id FROM {notes} n WHERE contains(lower(text), 't3') OR tag = 't3'",
        "f17_notes_about": f"SELECT id, text FROM {notes} n WHERE evidence = 'pkt#7'",
        "f18_search": f"""{p}, h AS ({known['a5_hosts']}), i AS ({known['j1_indicator_hits']}), u AS (SELECT 'Packet' AS source, concat('#', no, ' ', src, ' → ', dst, ' [', protocol, ']') AS label, info AS detail, lpad(CAST(no AS VARCHAR), 20, '0') AS place FROM p
            UNION ALL SELECT 'Host', ip, concat('pkts:', packets_out + packets_in, ' bytes:', bytes_out + bytes_in), lpad(ip, 20, '0') FROM h UNION ALL SELECT 'IOC Hit', concat('IP ', value), context, lpad(CAST(no AS VARCHAR), 20, '0') FROM i),
            r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place, label, detail) AS rank FROM u WHERE contains(lower(concat_ws(' ', label, detail)), '10.0.1.1')) SELECT source, rank, label, detail FROM r WHERE rank <= CASE source WHEN 'Packet' THEN 20 ELSE 10 END""",
        "j19_about_packets": f"""{p}, f AS ({flow}) SELECT z.no, source, signature, severity, p.src, p.dst, f.packets AS flow_packets, f.bytes AS flow_bytes FROM {finds} z JOIN p ON p.no = z.no LEFT JOIN f ON f.protocol = p.protocol AND f.vlan_id IS NOT DISTINCT FROM p.vlan_id
            AND f.a_ip = CASE WHEN (p.src, p.src_port) <= (p.dst, p.dst_port) THEN p.src ELSE p.dst END AND f.a_port = CASE WHEN (p.src, p.src_port) <= (p.dst, p.dst_port) THEN p.src_port ELSE p.dst_port END AND f.b_ip = CASE WHEN (p.src, p.src_port) <= (p.dst, p.dst_port) THEN p.dst ELSE p.src END AND f.b_port = CASE WHEN (p.src, p.src_port) <= (p.dst, p.dst_port) THEN p.dst_port ELSE p.src_port END""",
        "a20_security_summary": f"SELECT count(*) AS ids, 0 AS arp, 0 AS exposure, 0 AS auth, 0 AS tls, 0 AS dns, 0 AS vlan, 0 AS ioc, 0 AS rule, 0 AS credential, count(*) AS findings FROM {finds} f",
        "x20_triaged": f"SELECT source, severity, 80 AS priority, '{search.ADVICE_ELSE}' AS recommendation, true AS pinned, count(*) AS findings FROM {finds} f GROUP BY source, severity",
        "k5_top_nodes": ordered(f"SELECT key, score FROM ({scores}) s", "score DESC, key", 20),
        "k8_top_hosts": ordered(f"SELECT ip, bytes_out FROM ({known['a5_hosts']}) h", "bytes_out DESC, ip", 10),
        "g9_evidence": f"{p}, t AS (SELECT concat('Host:', src) AS key, no FROM p UNION ALL SELECT concat('Host:', dst), no FROM p) SELECT key, min(no) AS first_no, max(no) AS last_no, count(DISTINCT no) AS evidence FROM t GROUP BY key",
        "g3_other_nodes": f"""WITH l AS (SELECT u, k FROM {ev} e WHERE k % 5 = 0), r AS (SELECT DISTINCT rule_id, no FROM ({known['d_rule_hits']}) x) SELECT 'Credential' AS kind, count(DISTINCT k) AS things, count(*) AS hits FROM l UNION ALL SELECT 'Host', count(DISTINCT u) + 1, 2 * count(*) FROM l
            UNION ALL SELECT 'AuthenticatedWith', count(DISTINCT (u, k)) + count(DISTINCT k), 2 * count(*) FROM l UNION ALL SELECT 'RuleHit', count(*), count(*) FROM r UNION ALL SELECT kind, n, n FROM (SELECT unnest(['FileObject', 'ExtractedFrom']) AS kind, count(*) AS n FROM ({{carved}}) c) z""",
        "u5_tags": f"SELECT concat('pkt#', no) AS evidence, unnest([tag, 'seen']) AS tag FROM {tags} t WHERE tag <> '__marked__'",
        "u6_notes": f"SELECT id, CASE WHEN id % 10 = 0 THEN concat(text, '!') ELSE text END AS text, evidence FROM {notes} n WHERE id % 7 <> 0 UNION ALL SELECT -1, 'new', 'pkt#1'",
        "i6_reviewed": f"SELECT CASE WHEN first_no % 6 = 0 THEN 'acknowledged' ELSE 'pending' END AS status, first_no % 2 = 0 AS reviewed, count(*) AS incidents FROM ({known['i4_incidents']}) i GROUP BY ALL",
        "j13_independent": f"SELECT attacker, target, 2 AS detectors FROM ({known['i4_incidents']}) i WHERE first_no % 3 > 0",
        "a14_deltas": f"{p} {delta('protocol', 'protocol', '1')} UNION ALL {delta('source', 'src', 'length')} UNION ALL {delta('port', 'dst_port', '1')}",
        "j10_only_in_second": f"{p} SELECT protocol, src, dst, src_port, dst_port, length, max(no) AS no FROM p WHERE timestamp >= {half} AND (protocol, src, dst, src_port, dst_port, length) NOT IN (SELECT (protocol, src, dst, src_port, dst_port, length) FROM p WHERE timestamp < {half}) GROUP BY ALL",
        "j11_compared": f"""WITH f AS (SELECT * FROM ({known['p1_fields']}) x WHERE path NOT IN ('frame.number', 'frame.time')), a AS (SELECT layer, path, value AS "left" FROM f WHERE no = 1), b AS (SELECT layer, path, value AS "right" FROM f WHERE no = 8)
            SELECT layer, path, "left", "right", CASE WHEN "left" IS NULL THEN 'right only' WHEN "right" IS NULL THEN 'left only' ELSE 'changed' END AS change FROM a FULL JOIN b USING (layer, path) WHERE "left" IS DISTINCT FROM "right" """,
        "j11_first_difference": f"""{p}, x AS (SELECT regexp_extract_all((SELECT hex(bytes) FROM p WHERE no = 1), '..') AS l, regexp_extract_all((SELECT hex(bytes) FROM p WHERE no = 8), '..') AS r), i AS (SELECT unnest(range(0, 80)) AS k, l, r FROM x)
            SELECT CAST(k AS INT) AS "offset", l[k + 1] AS "left", r[k + 1] AS "right" FROM i WHERE l[k + 1] IS DISTINCT FROM r[k + 1] ORDER BY k LIMIT 1""",
        "j6_reputation": f"""{p}, x AS (SELECT split_part(target, '/', 1) AS net, CAST(split_part(target, '/', 2) AS INT) AS bits, severity, label FROM ({REPUTATION.format(supplier='supplier')}) s), r AS (SELECT a.address, x.severity, x.label, row_number() OVER (PARTITION BY address ORDER BY bits DESC, x.label DESC, x.severity DESC) AS k FROM {ends} a JOIN x ON {inside} WHERE starts_with(a.address, '203'))
            SELECT address, severity, label FROM r WHERE k = 1""",
        "j16_hosts_with_systems": f"WITH g AS ({known['d_os_guesses']}), h AS (SELECT DISTINCT concat('10.0.0.', u) AS ip FROM {ev} e UNION SELECT '10.0.1.1') SELECT h.ip, g.os FROM h LEFT JOIN g ON g.src = h.ip",
        "x9_places": f"""{p}, x AS (SELECT split_part(cidr, '/', 1) AS net, CAST(split_part(cidr, '/', 2) AS INT) AS bits, label, priority FROM ({RANGES.format(supplier='supplier')}) s), r AS (SELECT a.address, x.label, row_number() OVER (PARTITION BY address ORDER BY priority, x.label) AS k FROM {ends} a JOIN x ON {inside})
            SELECT a.address, CASE WHEN starts_with(a.address, '10.') THEN 'LAN' ELSE coalesce(r.label, '??') END AS place FROM {ends} a LEFT JOIN r ON r.address = a.address AND r.k = 1""",
        "x4_ascii": f"{p} SELECT no, concat('.....', info) AS text FROM p",
        "x5_names": f"SELECT no, string_split(info, ' ')[3] AS name, concat(string_split(string_split(info, ' ')[3], '.')[2], '.net') AS apex FROM {tunnels} t",
        "x10_authority": f"SELECT no, CASE no % 3 WHEN 0 THEN concat('h', no) WHEN 1 THEN concat(no, '.org') ELSE 'a' END AS authority FROM {tunnels} t",
        "x18_roles": f"{p} SELECT no, CASE WHEN no % 4 > 0 OR protocol = 'TCP' THEN CASE dst_port WHEN 22 THEN 'SSH' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 445 THEN 'SMB' END END AS role FROM p",
        "x19_risk_labels": f"SELECT key, CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH' WHEN score >= 0.40 THEN 'MEDIUM' WHEN score >= 0.15 THEN 'LOW' ELSE 'INFO' END AS label FROM ({scores}) s",
        "x11_magic": f"""SELECT n + 1 AS no, CASE k % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'ZIP' ELSE 'PDF' END AS kind, CASE WHEN k % 4 > 1 THEN 14 ELSE 0 END AS "offset" FROM {ev} e""",
        "x13_anomalies": f"SELECT n + 1 AS no, unnest(CASE WHEN n % 2 = 1 THEN ['HTTP content on non-standard port', 'TCP FIN-only probe'] ELSE ['TCP FIN-only probe'] END) AS anomaly FROM {ev} e",
        "r3_found_at": f"SELECT page_id, len(string_split(low, 'the')) - 1 AS places, strlen(string_split(low, 'the')[1]) AS first FROM {html} l WHERE contains(low, 'the')",
        "r4_http_streams": f"SELECT no, true AS http, false AS cut FROM (SELECT no, no % 3 = 0 AS x FROM {whole} w) q",
        "r6_pattern_hits": f"""SELECT page_id, rule, pattern, CAST(place AS INT) AS "offset", hex(hit) AS bytes FROM ({hits}) h""",
        "r7_unscanned": f"SELECT page_id FROM {html} h WHERE page_id % 2 = 1 OR page_id NOT IN (SELECT page_id FROM ({hits}) z)",
        "a25_rule_totals": f"SELECT page_id, CAST(sum(n) AS BIGINT) AS matches, string_agg(rule, ',' ORDER BY place, rule) AS rules FROM {by_rule} r GROUP BY page_id",
        "j18_objects_with_rules": f"SELECT h.page_id, coalesce(r.rules, '') AS rules FROM {html} h LEFT JOIN (SELECT page_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM {by_rule} q GROUP BY page_id) r ON r.page_id = h.page_id",
        "r5_carved": f"""SELECT arg_min(page_id, (page_id, pos)) AS page_id, CAST(arg_min(pos, (page_id, pos)) AS INT) AS "offset", 'text/html' AS kind, max(size) AS size, sha256 FROM (SELECT page_id, pos, strlen(whole) AS size, sha256(whole) AS sha256 FROM (
            SELECT page_id, pos, CASE WHEN position('</html>' IN rest) > 0 THEN substring(rest, 1, position('</html>' IN rest) + 6) ELSE rest END AS whole FROM (SELECT page_id, 0 AS pos, html AS rest FROM {html} h WHERE starts_with(html, '<!DOCTYPE html') UNION ALL SELECT page_id, position('<html' IN html) - 1, substring(html, position('<html' IN html)) FROM {html} h WHERE contains(html, '<html')) r) w) s GROUP BY sha256""",
        "w1_sliding_counts": f"{p} SELECT no, count(*) OVER (PARTITION BY src ORDER BY timestamp RANGE BETWEEN 2.0::DOUBLE PRECEDING AND CURRENT ROW) AS hits FROM p",
        "w1_sliding_distinct": f"{p} SELECT no, count(DISTINCT dst) OVER (PARTITION BY src ORDER BY timestamp RANGE BETWEEN 5.0::DOUBLE PRECEDING AND CURRENT ROW) AS hits FROM p",
        "a2_encrypted": f"SELECT DISTINCT concat('10.0.0.', u) AS a_ip, concat('203.0.113.', k % 2) AS b_ip, u < 4 AS is_encrypted FROM {ev} e",
        "a6_nodes": f"{p}, e AS (SELECT src AS ip, 1 AS o, length FROM p UNION ALL SELECT dst, 0, length FROM p) SELECT ip, sum(o) AS tx_packets, sum(o * length) AS tx_bytes, sum(1 - o) AS rx_packets, sum((1 - o) * length) AS rx_bytes FROM e GROUP BY ip",
        "a11_services": f"{p} SELECT dst_port, count(*) AS packets, sum(length) AS bytes, CASE dst_port WHEN 22 THEN 'SSH' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 445 THEN 'SMB' ELSE 'TCP' END AS service FROM p GROUP BY dst_port",
        "a21_summary": f"WITH f AS (SELECT value, {lookups._class_sql('value')} AS kind, list_entropy(string_split(value, '')) AS entropy FROM (SELECT unnest(regexp_extract_all(html, '[ -~]{{4,}}')) AS value FROM {html} h) v), g AS (SELECT kind, count(*) AS n FROM f GROUP BY kind) SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM f WHERE kind IN ('sensitive', 'key', 'shell')) AS sensitive, (SELECT round(avg(entropy), 6) FROM f) AS mean_entropy, (SELECT kind FROM g ORDER BY n DESC, kind LIMIT 1) AS top_kind",
        "u2_promotion": f"{p} SELECT count(*) AS added FROM (SELECT DISTINCT src, dst, dst_port, protocol FROM p WHERE timestamp >= {half} EXCEPT SELECT DISTINCT src, dst, dst_port, protocol FROM p WHERE timestamp < {half}) x",
        "d_ioc_findings": f"SELECT no, timestamp, 'IOC' AS source, 'IOC match' AS signature, 'HIGH' AS severity, concat_ws(' ', value, 'as', context, description) AS detail, concat_ws('|', context, value) AS correlation_key FROM ({known['j1_indicator_hits']}) h",
        "d_cred_findings": f"SELECT n + 1 AS no, t AS timestamp, 'CREDENTIAL' AS source, 'Credential exposure' AS signature, 'HIGH' AS severity, concat('FTP-', CASE k % 5 WHEN 0 THEN 'USER' ELSE 'PASS' END, ' from 10.0.0.', u, ' to 10.0.1.1') AS detail, concat('FTP-', CASE k % 5 WHEN 0 THEN 'USER' ELSE 'PASS' END, '|10.0.0.', u, '|10.0.1.1') AS correlation_key FROM {ev} e WHERE k % 5 < 2",
        "d_drift_findings": f"{p} SELECT min(no) AS no, min(timestamp) AS timestamp, 'DRIFT' AS source, 'Route drift' AS signature, 'HIGH' AS severity, concat(src, ' -> ', dst, ':', dst_port, ' ', protocol) AS detail, concat_ws('|', src, dst, CAST(dst_port AS VARCHAR), protocol) AS correlation_key FROM p WHERE timestamp >= {half} AND (src, dst, dst_port, protocol) NOT IN (SELECT (src, dst, dst_port, protocol) FROM p WHERE timestamp < {half}) GROUP BY src, dst, dst_port, protocol",
        "u3_findings": f"SELECT source, signature, severity, count(*) AS findings FROM (SELECT source, signature, severity FROM {finds} f UNION ALL SELECT 'IOC', 'IOC match', 'HIGH' FROM ({known['j1_indicator_hits']}) h UNION ALL SELECT source, signature, severity FROM ({known['d_rule_hits']}) r) u GROUP BY ALL",
        "w1_sessions": f"{p}, a AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY src, protocol ORDER BY timestamp, no) > 1 THEN 1 ELSE 0 END AS new FROM p), s AS (SELECT *, sum(new) OVER (PARTITION BY src, protocol ORDER BY timestamp, no ROWS UNBOUNDED PRECEDING) AS session FROM a) SELECT src, protocol, session, count(*) AS packets FROM s GROUP BY ALL",
        "x2_text_entropy": f"SELECT value, round(list_entropy(string_split(value, '')), 6) AS entropy FROM (SELECT DISTINCT unnest(regexp_extract_all(html, '[ -~]{{4,}}')) AS value FROM {html} h) v WHERE length(value) >= 5 AND length(value) < 40",
        "x12_xor": f"""WITH s AS (SELECT n, key, ((CASE WHEN xor(128 + k % 100, key) BETWEEN 32 AND 126 THEN 12 ELSE 0 END) + (CASE WHEN xor(140 + k % 90, key) BETWEEN 32 AND 126 THEN 8 ELSE 0 END)) / 20 AS score FROM {ev} e, (SELECT CAST(unnest(range(1, 256)) AS INT) AS key) r)
            SELECT n + 1 AS no, CAST(CASE WHEN max(score) > 0.7 THEN arg_max(key, (score, key)) END AS INT) AS key, CASE WHEN max(score) > 0.7 THEN max(score) END AS score FROM s GROUP BY n""",
        "g8_pivots": f"""WITH s AS (SELECT key, score FROM ({scores}) x WHERE NOT starts_with(key, 'Alert:')), e AS (SELECT src, dst, kind FROM ({known['g1_edges']}) y WHERE kind <> 'TriggersAlert'), n AS (SELECT DISTINCT key, kind, nb FROM (SELECT src AS key, kind, dst AS nb FROM e UNION ALL SELECT dst, kind, src FROM e) z),
            c AS (SELECT n.key, greatest(s.score, CASE n.kind WHEN 'MatchesIoc' THEN 0.475 ELSE 0.5 END) AS score FROM n JOIN s ON s.key = n.nb UNION ALL SELECT key, 0.6 FROM s WHERE starts_with(key, 'Host:') UNION ALL SELECT key, 0.75 FROM s WHERE starts_with(key, 'Host:') AND score > 0.3 UNION ALL SELECT key, 0.85 FROM s WHERE starts_with(key, 'IOC:'))
            SELECT key, least(count(*), 8) AS steps, CAST(round(max(score), 6) AS DOUBLE) AS best FROM c GROUP BY key""",
    }
    out["g3_other_nodes"] = out["g3_other_nodes"].replace("{carved}", out["r5_carved"])
    return out
