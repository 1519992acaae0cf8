"""More registered queries and their SQL twins: decoded fields, strings, enrichment, behaviour over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators import behaviour, enrich, fields, strings, traffic
from netloom.operators.windows import running, sessions
from netloom.plans.packets import SQL, packets

HALF = "(SELECT max(timestamp) / 2 FROM p)"
#: Dimension tables derived from the given tables; the SQL runs in Spark and in DuckDB alike.
INDICATORS = "SELECT 'ip' AS kind, concat('10.0.1.', CAST(c_custkey % 40 AS STRING)) AS value, c_name AS description FROM {customer}"
PREFIXES = "SELECT concat('203.0.113.', CAST(s_suppkey % 4 AS STRING), '/', CAST(22 + s_suppkey % 11 AS STRING)) AS cidr, CAST(s_nationkey AS STRING) AS asn, s_name AS organization FROM {supplier}"
#: Every third packet is a request that is answered 0 to 60 ms later.
ANSWERS = """SELECT no + 100000000 AS no, timestamp + CAST(no % 61 AS DOUBLE) / 1000 AS timestamp, dst AS src, src AS dst, protocol, length, info, dst_port AS src_port, src_port AS dst_port, vlan_id,
  unhex(concat(substring(hex(bytes), 1, 94), '12', substring(hex(bytes), 97))) AS bytes FROM {p} WHERE no % 3 = 0"""


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(operator):
    return lambda spark, sf_dir: operator(packets(spark, sf_dir))


def _halves(operator):
    def run(spark, sf_dir):
        p = packets(spark, sf_dir)
        half = p.agg(F.max("timestamp")).first()[0] / 2
        return operator(enrich.routes(p.where(F.col("timestamp") >= half)), enrich.routes(p.where(F.col("timestamp") < half)))

    return run


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("bytes"))


def _indicators(spark, sf_dir):
    return enrich.indicator_hits(packets(spark, sf_dir), spark.sql(INDICATORS, customer=_table(spark, sf_dir, "customer")))


def _identities(spark, sf_dir):
    ends = packets(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("address"))
    return enrich.identities(ends, spark.sql(PREFIXES, supplier=_table(spark, sf_dir, "supplier")))


def _latency(spark, sf_dir):
    p = packets(spark, sf_dir)
    samples = behaviour.handshakes(p.unionByName(spark.sql(ANSWERS, p=p)))
    return behaviour.latency_summary(samples).withColumns({c: F.round(c, 6) for c in ("median_ms", "p95_ms")})


def _domains(spark, sf_dir):
    """Words of documents that are, or end with, the domain of some document's e-mail address."""
    docs = _table(spark, sf_dir, "documents")
    known = docs.select(F.lit("domain").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit("@([a-z0-9.-]+[.][a-z]+)"), F.lit(1))).alias("value")).distinct()
    return enrich.domain_hits(docs, "doc_id", "text", known)


def _running(p):
    rows = sessions(p, ["src"], 0.5)
    return running(rows, ["src", "session"], {"sent": F.col("length").cast("long")}).select("no", "src", "session", "sent")


def queries() -> dict:
    top = lambda df, n, *order: df.orderBy(*order).limit(n)
    return {
        "p1_fields": _over(fields.fields),
        "p6_field_search": _over(lambda p: fields.found_in(fields.fields(p), "Port").groupBy("path", "value").agg(F.count("*").alias("packets"))),
        "p12_strings": lambda spark, sf_dir: strings.strings(_documents(spark, sf_dir), "doc_id", "bytes").groupBy("doc_id", "value", "kind", "sensitive").agg(F.count("*").alias("n"), F.round(F.max("entropy"), 6).alias("entropy")),
        "a21_string_classes": lambda spark, sf_dir: strings.totals(strings.strings(_documents(spark, sf_dir), "doc_id", "bytes")).withColumn("mean_entropy", F.round("mean_entropy", 6)),
        "x1_entropy": _over(lambda p: p.select("no", F.round(T.entropy(F.col("bytes")), 6).alias("entropy"))),
        "a3_beacon_scores": _over(lambda p: behaviour.beacon_scores(p).withColumn("beacon_score", F.round("beacon_score", 6))),
        "w10_running_bytes": _over(_running),
        "d22_outbound_volume": _over(lambda p: behaviour.outbound_volume(p, volume=100).select("no", "timestamp", "signature", "detail", "correlation_key")),
        "d26_external_pairs": _over(lambda p: behaviour.external_resolver(p, port=1003, seconds=20.0).select("no", "timestamp", "signature", "detail", "correlation_key")),
        "d28_marked_fan_out": _over(lambda p: behaviour.ntlm_fan_out(p, hosts=5, seconds=10.0, mark="signup").select("no", "timestamp", "signature", "detail", "correlation_key")),
        "j1_indicator_hits": _indicators,
        "j2_domain_hits": _domains,
        "j5_identities": _identities,
        "a24_routes": _over(enrich.routes),
        "j9_drift": _halves(enrich.drift),
        "u2_promoted": _halves(enrich.promoted),
        "a16_latency": _latency,
        "k1_top_flows": _over(lambda p: top(traffic.flows(p).select(*traffic.FLOW, "bytes", "packets"), 50, F.desc("bytes"), *traffic.FLOW)),
        "k2_top_protocols": _over(lambda p: top(traffic.totals(p, "protocol"), 3, F.desc("packets"), "protocol")),
        "k3_top_edges": _over(lambda p: top(traffic.edges(p).select("src", "dst", "packets", "bytes"), 20, F.desc("bytes"), "src", "dst")),
        "k7_last_buckets": _over(lambda p: top(traffic.timeline(p), 60, F.desc("bucket"))),
        "a27_peak": _over(lambda p: traffic.timeline(p).agg(F.max("packets").alias("packets"), F.max("bytes").alias("bytes"))),
    }


_P = "WITH p AS (" + SQL.replace("{events}", "events") + ")"


def _class_sql(v: str) -> str:
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    one = {"holds": lambda w: f"contains(lower({v}), {quote(w)})", "begins": lambda w: f"starts_with(lower({v}), {quote(w)})", "matches": lambda w: "(" + " AND ".join(f"regexp_matches({v}, {quote(x)})" for x in w.split(" & ")) + ")"}
    return "CASE " + " ".join(f"WHEN {' OR '.join(one[how](w) for w in words)} THEN '{name}'" for name, how, words in T.CLASSES) + " ELSE 'ascii' END"


def oracle_sql() -> dict[str, str]:
    internal = "regexp_matches({0}, '^(10|127)\\.|^192\\.168\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.')"
    cell = lambda at, n: f"CAST(CAST('0x' || substring(hex(bytes), {2 * at + 1}, {2 * n}) AS BIGINT) AS STRING)"
    raw = lambda at, n: f"lower(substring(hex(bytes), {2 * at + 1}, {2 * n}))"
    macs = lambda at: f"rtrim(regexp_replace({raw(at, 6)}, '(..)', '\\1:', 'g'), ':')"
    rows = [
        ("Frame", "frame.number", "Frame Number", "CAST(no AS STRING)", None, None), ("Frame", "frame.time", "Relative Time", "printf('%.6fs', timestamp)", None, None),
        ("Frame", "frame.len", "Frame Length", "CAST(length AS STRING)", None, None), ("Frame", "proto", "Protocol", "protocol", None, None),
        ("Ethernet", "eth.dst", "Destination MAC", macs(0), 0, 6), ("Ethernet", "eth.src", "Source MAC", macs(6), 6, 6), ("Ethernet", "eth.type", "EtherType", f"'0x' || {raw(12, 2)}", 12, 2),
        ("VLAN", "vlan.id", "VLAN ID", "CAST(vlan_id AS STRING)", None, None),
        ("IPv4", "ip.version", "Version", "'4'", 14, 1), ("IPv4", "ip.hdr_len", "Header Length", "'20'", 14, 1), ("IPv4", "ip.len", "Total Length", cell(16, 2), 16, 2), ("IPv4", "ip.id", "Identification", f"'0x' || {raw(18, 2)}", 18, 2),
        ("IPv4", "ip.ttl", "Time To Live", cell(22, 1), 22, 1), ("IPv4", "ip.proto", "Protocol Number", cell(23, 1), 23, 1), ("IPv4", "ip.src", "Source Address", "src", 26, 4), ("IPv4", "ip.dst", "Destination Address", "dst", 30, 4),
        ("TCP", "tcp.srcport", "Source Port", cell(34, 2), 34, 2), ("TCP", "tcp.dstport", "Destination Port", cell(36, 2), 36, 2), ("TCP", "tcp.seq", "Sequence Number", cell(38, 4), 38, 4), ("TCP", "tcp.ack", "Acknowledgment Number", cell(42, 4), 42, 4),
        ("TCP", "tcp.hdr_len", "Header Length", "'20'", 46, 1), ("TCP", "tcp.flags", "Flags", f"'0x' || {raw(47, 1)}", 47, 1), ("TCP", "tcp.window_size", "Window Size", cell(48, 2), 48, 2),
    ]
    null = lambda x: "CAST(NULL AS INT)" if x is None else f"CAST({x} AS INT)"
    fields_sql = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT no, '{la}' AS layer, '{pa}' AS path, '{lb}' AS label, {v} AS value, {null(o)} AS \"offset\", {null(n)} AS length FROM p" for la, pa, lb, v, o, n in rows) + ") f WHERE value IS NOT NULL"
    runs = "SELECT doc_id, unnest(regexp_extract_all(text, '[ -~]{4,}')) AS value FROM documents"
    found = f"SELECT doc_id, value, length(value) AS length, {_class_sql('value')} AS kind, list_entropy(string_split(value, '')) AS entropy FROM ({runs}) r"
    sensitive = "kind IN ('sensitive', 'key', 'shell')"
    route = "src AS subject, dst AS target, dst_port AS port, protocol, CAST(NULL AS STRING) AS authority"
    later, earlier = (f"(SELECT DISTINCT {route} FROM p WHERE timestamp {c} {HALF})" for c in (">=", "<"))
    session = lambda part, gap: f"sum(new) OVER (PARTITION BY {part} ORDER BY timestamp, no ROWS UNBOUNDED PRECEDING)"
    new = lambda part, gap: f"CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY {part} ORDER BY timestamp, no) > {gap} THEN 1 ELSE 0 END AS new"
    number = lambda a: " + ".join(f"CAST(split_part({a}, '.', {k}) AS BIGINT) * {256 ** (4 - k)}" for k in (1, 2, 3, 4))
    key = "a_ip, a_port, b_ip, b_port, protocol, vlan_id"
    ends = "SELECT CASE WHEN (src, src_port) <= (dst, dst_port) THEN src ELSE dst END AS a_ip, CASE WHEN (src, src_port) <= (dst, dst_port) THEN src_port ELSE dst_port END AS a_port, CASE WHEN (src, src_port) <= (dst, dst_port) THEN dst ELSE src END AS b_ip, CASE WHEN (src, src_port) <= (dst, dst_port) THEN dst_port ELSE src_port END AS b_port, protocol, vlan_id, no, timestamp, length FROM p"
    n = "count(*) AS packets, sum(length) AS bytes"
    over_p = {
        "p1_fields": fields_sql,
        "p6_field_search": f"SELECT path, value, count(*) AS packets FROM ({fields_sql}) g WHERE contains(lower(concat_ws(' ', path, label, value, layer)), 'port') GROUP BY path, value",
        "x1_entropy": "SELECT no, round(list_entropy(regexp_extract_all(hex(bytes), '..')), 6) AS entropy FROM p",
        "a3_beacon_scores": f"""SELECT {key}, round(CASE WHEN n >= 5 AND mean >= 0.5 THEN 0.5 * (1 - least(sd / mean, 1)) + 0.3 * CASE WHEN ns >= 5 THEN 1 - least(sds / means, 1) ELSE 0.5 END + 0.2 * least(duration / 60, 1) ELSE 0 END, 6) AS beacon_score,
            CASE WHEN n >= 5 AND mean >= 0.5 THEN 0.5 * (1 - least(sd / mean, 1)) + 0.3 * CASE WHEN ns >= 5 THEN 1 - least(sds / means, 1) ELSE 0.5 END + 0.2 * least(duration / 60, 1) ELSE 0 END > 0.7 AS is_beacon FROM (
            SELECT {key}, count(gap) FILTER (gr <= 60) AS n, avg(gap) FILTER (gr <= 60) AS mean, stddev_pop(gap) FILTER (gr <= 60) AS sd, count(length) FILTER (sr <= 60) AS ns, avg(length) FILTER (sr <= 60) AS means, stddev_pop(length) FILTER (sr <= 60) AS sds, max(timestamp) - min(timestamp) AS duration FROM (
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY timestamp DESC, no DESC) AS sr, count(gap) OVER (PARTITION BY {key} ORDER BY timestamp DESC, no DESC ROWS UNBOUNDED PRECEDING) AS gr FROM (
            SELECT *, CASE WHEN timestamp - before > 0.001 AND before > 0 THEN timestamp - before END AS gap FROM (SELECT *, lag(timestamp) OVER (PARTITION BY {key} ORDER BY timestamp, no) AS before FROM ({ends}) e) l) g) r GROUP BY ALL) s""",
        "w10_running_bytes": f"SELECT no, src, session, sum(length) OVER (PARTITION BY src, session ORDER BY timestamp, no ROWS UNBOUNDED PRECEDING) AS sent FROM (SELECT *, {session('src', 0.5)} AS session FROM (SELECT *, {new('src', 0.5)} FROM p) a) b",
        "d22_outbound_volume": f"""SELECT no, timestamp, 'Large asymmetric outbound transfer' AS signature, concat_ws(' ', src, 'sent', CAST(sent AS STRING), 'bytes to', dst) AS detail, concat_ws('|', src, dst, CAST(dst_port AS STRING), protocol) AS correlation_key FROM (
            SELECT *, row_number() OVER (PARTITION BY src, dst, dst_port, protocol ORDER BY timestamp, no) AS k FROM (SELECT *, sum(length) OVER (PARTITION BY src, dst, dst_port, protocol ORDER BY timestamp, no ROWS UNBOUNDED PRECEDING) AS sent FROM p WHERE {internal.format('src')} AND NOT {internal.format('dst')}) a WHERE sent >= 100) b WHERE k = 1""",
        "d26_external_pairs": f"""SELECT no, timestamp, 'Direct external DNS resolver use' AS signature, concat_ws(' ', src, 'asks', dst) AS detail, concat_ws('|', src, dst) AS correlation_key FROM (
            SELECT *, lag(timestamp) OVER (PARTITION BY src, dst ORDER BY timestamp, no) AS before FROM p WHERE dst_port = 1003 AND {internal.format('src')} AND NOT {internal.format('dst')}) a WHERE before IS NULL OR timestamp - before > 20""",
        "d28_marked_fan_out": f"""SELECT no, timestamp, 'NTLM authentication fan-out' AS signature, concat_ws(' ', src, 'to several hosts') AS detail, src AS correlation_key FROM (SELECT *, row_number() OVER (PARTITION BY src, session ORDER BY timestamp, no) AS k FROM (
            SELECT *, {session('src', 10)} AS session, count(DISTINCT dst) OVER (PARTITION BY src ORDER BY timestamp RANGE BETWEEN 10.0::DOUBLE PRECEDING AND CURRENT ROW) AS hits FROM (SELECT *, {new('src', 10)} FROM p WHERE info = 'signup') a) b WHERE hits >= 5) c WHERE k = 1""",
        "j1_indicator_hits": f"SELECT e.value, no, timestamp, context, description, 'auto' AS source FROM (SELECT no, timestamp, 'src' AS context, src AS value FROM p UNION ALL SELECT no, timestamp, 'dst', dst FROM p) e JOIN (SELECT value, max(description) AS description FROM ({INDICATORS.format(customer='customer')}) i GROUP BY value) k ON e.value = k.value",
        "j5_identities": f"""SELECT address, asn, organization, source FROM (SELECT a.address, CASE WHEN {internal.format('address')} THEN NULL ELSE x.asn END AS asn, CASE WHEN {internal.format('address')} THEN 'Private network' ELSE coalesce(x.organization, 'Unresolved') END AS organization,
            CASE WHEN {internal.format('address')} THEN 'local classification' WHEN x.organization IS NOT NULL THEN 'prefix map' ELSE 'observed' END AS source, row_number() OVER (PARTITION BY address ORDER BY bits DESC NULLS LAST, x.organization DESC, x.asn DESC) AS k
            FROM (SELECT src AS address FROM p UNION SELECT dst FROM p) a LEFT JOIN (SELECT *, CAST(split_part(cidr, '/', 2) AS INT) AS bits, {number("split_part(cidr, '/', 1)")} AS net FROM ({PREFIXES.format(supplier='supplier')}) s) x ON ({number('a.address')}) >> (32 - x.bits) = x.net >> (32 - x.bits)) z WHERE k = 1""",
        "a24_routes": f"SELECT DISTINCT {route} FROM p",
        "j9_drift": f"SELECT * FROM {later} EXCEPT SELECT * FROM {earlier}",
        "u2_promoted": f"SELECT * FROM {later} UNION SELECT * FROM {earlier}",
        "a16_latency": f"""SELECT 'handshake' AS kind, count(*) AS samples, round(list_sort(list(ms))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS INT) + 1], 6) AS median_ms, round(list_sort(list(ms))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS INT) + 1], 6) AS p95_ms,
            count(*) FILTER (ms < 1) AS below_1, {', '.join(f'count(*) FILTER (ms >= {lo} AND ms < {hi}) AS from_{lo}' for lo, hi in zip(behaviour.CLASSES_MS, [*behaviour.CLASSES_MS[1:], 1000000]))} FROM (
            SELECT answer, (timestamp - lag(timestamp) OVER w) * 1000 AS ms, lag(answer) OVER w AS was FROM (SELECT no, timestamp, src, src_port, dst, dst_port, false AS answer FROM p UNION ALL SELECT no + 100000000, timestamp + CAST(no % 61 AS DOUBLE) / 1000, src, src_port, dst, dst_port, true FROM p WHERE no % 3 = 0) u
            WINDOW w AS (PARTITION BY src, src_port, dst, dst_port ORDER BY timestamp, no)) l WHERE answer AND NOT was AND ms <= 30000""",
        "k1_top_flows": f"SELECT {key}, sum(length) AS bytes, count(*) AS packets FROM ({ends}) e GROUP BY ALL ORDER BY bytes DESC, a_ip, a_port, b_ip, b_port, protocol, vlan_id NULLS FIRST LIMIT 50",
        "k2_top_protocols": f"SELECT protocol, {n} FROM p GROUP BY 1 ORDER BY packets DESC, protocol LIMIT 3",
        "k3_top_edges": f"SELECT src, dst, {n} FROM p GROUP BY 1, 2 ORDER BY bytes DESC, src, dst LIMIT 20",
        "k7_last_buckets": f"SELECT floor(timestamp) AS bucket, {n} FROM p GROUP BY 1 ORDER BY bucket DESC LIMIT 60",
        "a27_peak": f"SELECT max(packets) AS packets, max(bytes) AS bytes FROM (SELECT {n} FROM p GROUP BY floor(timestamp)) b",
    }
    out = {k: f"{_P} {v}" for k, v in over_p.items()}
    out["p12_strings"] = f"SELECT doc_id, value, kind, {sensitive} AS sensitive, count(*) AS n, round(max(entropy), 6) AS entropy FROM ({found}) f GROUP BY ALL"
    out["a21_string_classes"] = f"SELECT kind, count(*) AS found, count(*) FILTER ({sensitive}) AS sensitive, sum(length) AS bytes, round(avg(entropy), 6) AS mean_entropy FROM ({found}) f GROUP BY kind"
    out["j2_domain_hits"] = """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '@([a-z0-9.-]+[.][a-z]+)', 1)) AS domain FROM documents),
        w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[\\s,;()<>"'']+')) AS word FROM documents)
        SELECT doc_id, word, arg_max(domain, length(domain)) AS domain, word = arg_max(domain, length(domain)) AS exact FROM w JOIN k ON contains(word, '.') AND ends_with(word, domain) GROUP BY doc_id, word"""
    return out
