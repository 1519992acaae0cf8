"""The registered queries of the traffic operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import packet as X
from netloom.operators import detect, traffic
from netloom.plans import entities, files, frames, lookups, patterns, sequences, views
from netloom.plans.packets import SQL, packets

def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _over(operator):
    return lambda spark, sf_dir: operator(packets(spark, sf_dir))


def _halves(spark, sf_dir):
    p = packets(spark, sf_dir)
    half = p.agg(F.max("timestamp")).first()[0] / 2
    return traffic.only_in(p.where(F.col("timestamp") < half), p.where(F.col("timestamp") >= half))


def queries() -> dict:
    text = lambda c: F.concat_ws(",", c)
    return {
        "a1_flows": _over(lambda p: _rounded(traffic.flows(p), "throughput")),
        "a4_scanners": _over(traffic.scanners),
        "a5_hosts": _over(lambda p: traffic.hosts(p).withColumns({"ports": text("ports"), "protocols": text("protocols")})),
        "a6_edges": _over(traffic.edges),
        "a7_timeline": _over(lambda p: traffic.timeline(p, 10.0)),
        "a7_timeline_by_protocol": _over(lambda p: traffic.timeline(p, 10.0, ("protocol",))),
        "a8_protocols": _over(lambda p: _rounded(traffic.protocols(p), "percent")),
        "a9_conversations": _over(traffic.conversations),
        "a10_endpoints": _over(lambda p: traffic.totals(p, "src")),
        "a11_ports": _over(lambda p: traffic.totals(p, "dst_port")),
        "a12_sizes": _over(traffic.sizes),
        "a13_summary": _over(lambda p: _rounded(traffic.summary(p), "mean_size", "duration")),
        "a17_vlans": _over(traffic.vlans),
        "k4_top_conversations": _over(lambda p: traffic.conversations(p).orderBy(F.desc("bytes"), "a", "b", "protocol").limit(20)),
        "d10_vertical_scan": _over(detect.vertical_scan),
        "d11_horizontal_scan": _over(detect.horizontal_scan),
        "d27_admin_fan_out": _over(detect.admin_fan_out),
        "d_bf_auth_burst": _over(detect.auth_burst),
        "a22_findings": _over(lambda p: detect.correlated(detect.vertical_scan(p).unionByName(detect.horizontal_scan(p)).unionByName(detect.admin_fan_out(p)).unionByName(detect.auth_burst(p)))),
        "f1_protocol": _over(lambda p: p.where(X.has_protocol("ssh")).select("no")),
        "f5_port_differs": _over(lambda p: p.where(X.any_port(lambda c: c < 100) & ~X.contains("info", "VIEW")).select("no")),
        "f19_internal": _over(lambda p: p.where(~X.is_internal(F.col("dst"))).groupBy("src").agg(F.count("*").alias("external"))),
        "u1_only_in_first_half": _halves,
    } | lookups.queries() | entities.queries() | frames.queries() | views.queries() | files.queries() | patterns.queries() | sequences.queries()


_P = "WITH p AS (" + SQL.replace("{events}", "events") + ")"


def _latch_sql(where: str, keys: str, measure: str, threshold: int, seconds: float, rearm: str | None, signature: str, severity: str, detail: str, key: str) -> str:
    """A burst detector: gap sessions of `rearm` (none: one alert ever), the sliding measure, the first row over it."""
    session = f"sum(new) OVER (PARTITION BY {rearm} ORDER BY timestamp, no ROWS UNBOUNDED PRECEDING)" if rearm else "0"
    new = f"CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY {rearm} ORDER BY timestamp, no) > {seconds} THEN 1 ELSE 0 END" if rearm else "0"
    return f"""{_P}, r AS (SELECT *, {new} AS new FROM p WHERE {where}), s AS (SELECT *, {session} AS session FROM r),
    m AS (SELECT *, {measure} OVER (PARTITION BY {keys} ORDER BY timestamp RANGE BETWEEN {seconds}::DOUBLE PRECEDING AND CURRENT ROW) AS hits FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY {keys}, session ORDER BY timestamp, no) AS k FROM m WHERE hits >= {threshold})
    SELECT no, timestamp, 'IDS' AS source, '{signature}' AS signature, '{severity}' AS severity, {detail} AS detail, {key} AS correlation_key FROM f WHERE k = 1"""


def oracle_sql() -> dict[str, str]:
    n = "count(*) AS packets, sum(length) AS bytes"
    internal = "regexp_matches({0}, '^(10|127)\\.|^192\\.168\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.')"
    port = "CAST(dst_port AS STRING)"
    out = {
        "a1_flows": """, k AS (SELECT *, (src, src_port) <= (dst, dst_port) AS fwd FROM p), e AS (SELECT CASE WHEN fwd THEN src ELSE dst END AS a_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS a_port,
            CASE WHEN fwd THEN dst ELSE src END AS b_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS b_port, * FROM k),
            s AS (SELECT a_ip, a_port, b_ip, b_port, protocol, vlan_id, count(*) AS packets, sum(length) AS bytes, sum(CASE WHEN fwd THEN length ELSE 0 END) AS ab, min(timestamp) AS first_seen, max(timestamp) AS last_seen, arg_min(fwd, no) AS af FROM e GROUP BY ALL)
            SELECT a_ip, a_port, b_ip, b_port, protocol, vlan_id, packets, bytes, CASE WHEN af THEN ab ELSE bytes - ab END AS bytes_out, CASE WHEN af THEN bytes - ab ELSE ab END AS bytes_in, first_seen, last_seen,
            round(bytes / greatest(last_seen - first_seen, 0.001), 6) AS throughput, bytes > 1000000 AS is_large, last_seen - first_seen > 300 AS is_long FROM s""",
        "a4_scanners": " SELECT src, count(DISTINCT (dst, dst_port)) AS targets FROM p GROUP BY src HAVING count(DISTINCT (dst, dst_port)) >= 5",
        "a5_hosts": """, e AS (SELECT src AS ip, true AS o, * FROM p UNION ALL SELECT dst, false, * FROM p)
            SELECT ip, sum(CASE WHEN o THEN length ELSE 0 END) AS bytes_out, sum(CASE WHEN o THEN 0 ELSE length END) AS bytes_in, sum(CASE WHEN o THEN 1 ELSE 0 END) AS packets_out, sum(CASE WHEN o THEN 0 ELSE 1 END) AS packets_in,
            array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS ports, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM e GROUP BY ip""",
        "a6_edges": f" SELECT src, dst, {n}, arg_max(protocol, no) AS protocol FROM p GROUP BY src, dst",
        "a7_timeline": f" SELECT floor(timestamp / 10) * 10.0::DOUBLE AS bucket, {n} FROM p GROUP BY 1",
        "a7_timeline_by_protocol": f" SELECT floor(timestamp / 10) * 10.0::DOUBLE AS bucket, protocol, {n} FROM p GROUP BY 1, 2",
        "a8_protocols": " SELECT protocol, count(*) AS packets, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM p GROUP BY protocol",
        "a9_conversations": f" SELECT least(src, dst) AS a, greatest(src, dst) AS b, protocol, {n} FROM p GROUP BY 1, 2, 3",
        "a10_endpoints": f" SELECT src, {n} FROM p GROUP BY src",
        "a11_ports": f" SELECT dst_port, {n} FROM p GROUP BY dst_port",
        "a12_sizes": " SELECT size, (SELECT count(*) FROM p WHERE length BETWEEN lo AND hi) AS packets FROM (VALUES " + ", ".join(f"('{lo}-{hi}', {lo}, {hi})" if hi else f"('{lo}+', {lo}, 1000000)" for lo, hi in traffic.SIZES) + ") v(size, lo, hi)",
        "a13_summary": f" SELECT {n}, round(avg(length), 6) AS mean_size, round(max(timestamp) - min(timestamp), 6) AS duration FROM p",
        "a17_vlans": f" SELECT vlan_id, {n}, count(DISTINCT src) AS hosts, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM p WHERE vlan_id IS NOT NULL GROUP BY vlan_id",
        "k4_top_conversations": f" SELECT least(src, dst) AS a, greatest(src, dst) AS b, protocol, {n} FROM p GROUP BY 1, 2, 3 ORDER BY bytes DESC, a, b, protocol LIMIT 20",
        "f1_protocol": " SELECT no FROM p WHERE lower(protocol) = 'ssh' OR contains(lower(info), 'ssh') OR contains(src, 'ssh') OR contains(dst, 'ssh')",
        "f5_port_differs": " SELECT no FROM p WHERE (src_port < 100 OR dst_port < 100) AND NOT contains(lower(info), 'view')",
        "f19_internal": f" SELECT src, count(*) AS external FROM p WHERE NOT {internal.format('dst')} GROUP BY src",
        "u1_only_in_first_half": f" SELECT protocol, src, dst, src_port, dst_port, length, max(no) AS no FROM p WHERE timestamp < (SELECT max(timestamp) / 2 FROM p) AND (protocol, src, dst, src_port, dst_port, length) NOT IN (SELECT (protocol, src, dst, src_port, dst_port, length) FROM p WHERE timestamp >= (SELECT max(timestamp) / 2 FROM p)) GROUP BY ALL",
    }
    out = {k: _P + v for k, v in out.items()}
    bursts = {
        "d10_vertical_scan": ("true", "src, dst", "count(DISTINCT dst_port)", 12, 15, "src", "Vertical port scan", "HIGH", "concat_ws(' ', src, '->', dst)", "concat_ws('|', src, dst)"),
        "d11_horizontal_scan": ("true", "src, dst_port", "count(DISTINCT dst)", 12, 15, "src", "Horizontal host scan", "HIGH", f"concat_ws(' ', src, 'port', {port})", f"concat_ws('|', src, {port})"),
        "d27_admin_fan_out": (f"dst_port IN {detect.ADMIN_PORTS} AND {internal.format('src')} AND {internal.format('dst')}", "src, dst_port", "count(DISTINCT dst)", 8, 60, "src, dst_port", "Administrative service fan-out", "HIGH", f"concat_ws(' ', src, 'port', {port})", f"concat_ws('|', src, {port})"),
        "d_bf_auth_burst": ("dst_port = 22", "src, dst, dst_port", "count(*)", 5, 30, None, "Authentication burst", "HIGH", "concat_ws(' ', 'SSH', src, '->', dst)", f"concat_ws('|', src, dst, {port})"),
    }
    out |= {k: _latch_sql(*v) for k, v in bursts.items()}
    union = " UNION ALL ".join(f"SELECT * FROM ({out[k]})" for k in ("d10_vertical_scan", "d11_horizontal_scan", "d27_admin_fan_out", "d_bf_auth_burst"))
    out["a22_findings"] = f"SELECT source, signature, correlation_key, count(*) AS hit_count, min(no) AS first_no, max(no) AS last_no, min(timestamp) AS first_time, max(timestamp) AS last_time, arg_max(detail, no) AS detail, 80 AS priority FROM ({union}) GROUP BY ALL"
    out |= lookups.oracle_sql()
    out |= entities.oracle_sql(out) | frames.oracle_sql()
    out |= views.oracle_sql(out)
    return out | files.oracle_sql(out) | patterns.oracle_sql() | sequences.oracle_sql(out)
