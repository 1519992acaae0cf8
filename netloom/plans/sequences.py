"""Registered queries of decisions in order and of streams: late rows, answers as they come, files that grow. Each has an SQL twin."""

from __future__ import annotations

from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import behaviour, incidents, objects, traffic
from netloom.plans import frames
from netloom.plans.files import OWNER_LINES, PACKET, START
from netloom.plans.frames import EVENTS
from netloom.plans.packets import SQL, packets
from netloom.sources import scratch, tail
from netloom.streaming import live

#: Incidents of two detectors; some attackers are shown by one of them only.
FOUND = f"""SELECT concat(e, '-', CAST(k % 50 AS STRING), '-', CAST(u AS STRING)) AS incident_id, 'IDS' AS source, e AS detector, concat('203.0.', CAST(k % 50 AS STRING), '.', CAST(u AS STRING)) AS attacker, '10.0.1.1' AS target, min(t) AS first_time
  FROM {EVENTS} f0 WHERE e = 'error' OR (e = 'click' AND k % 3 > 0) GROUP BY e, k % 50, u"""
MOST, EXPIRES, NOW = 5, 1.5, 20.0


def _automatic(spark, sf_dir):
    found = frames.made(FOUND)(spark, sf_dir)
    protected = found.select(F.col("attacker").alias("address")).distinct().where(F.split("address", r"\.")[2].cast("int") % 7 == 0)
    return incidents.decisions(found, protected, "automatic", MOST, expires=EXPIRES, now=NOW).select("incident_id", "reason", "status")


#: Rows that come in the last of three files; all but the latest of them are late by then.
BEHIND, PATIENCE = "no % 10 = 0", 2


def _late(spark, sf_dir) -> DataFrame:
    """Packets land in three files, one a batch; the last has every tenth packet. Both tables of the writer, put together."""
    landed = scratch.folder(spark)
    rows = packets(spark, sf_dir)
    half = rows.agg(F.max("timestamp")).first()[0] / 2
    for k, part in enumerate((rows.where(f"not ({BEHIND})").where(F.col("timestamp") < half), rows.where(f"not ({BEHIND})").where(F.col("timestamp") >= half), rows.where(BEHIND))):
        part.coalesce(1).write.parquet(f"{landed}/{k}")
    stream = live.packets(spark, f"{landed}/*", PACKET, files=1, start=START)
    on_time, side = scratch.folder(spark), scratch.folder(spark)
    live.split_late(stream, on_time, side, f"{PATIENCE} seconds").option("checkpointLocation", scratch.folder(spark)).trigger(availableNow=True).start().awaitTermination()
    both = spark.read.parquet(on_time).withColumn("late", F.lit(False)).unionByName(spark.read.parquet(side).withColumn("late", F.lit(True)))
    return both.select("no", "late", "batch")


def _dns_stream(spark, sf_dir):
    landed, out = scratch.folder(spark), scratch.folder(spark)
    frames.made(frames.NAMES)(spark, sf_dir).write.parquet(landed)
    found = live.dns_answers(live.packets(spark, landed, PACKET, start=START), start=START)
    found.select("no", "server", F.round("latency_ms", 3).alias("latency_ms")).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _put(path: str, data: bytes) -> None:
    fs, inner = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path) if ":" in path else (pafs.LocalFileSystem(), path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inner) as file:
        file.write(data)


def _tail(spark, sf_dir) -> DataFrame:
    """Suppliers' lines in a file that is half there, then whole, then cut off and begun anew with its first lines; a batch each time."""
    rows = spark.sql(OWNER_LINES, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet")).orderBy(F.col("value"))
    text = "".join(f"{r.value}\n" for r in rows.toLocalIterator()).encode()  # a file is one writer's work
    folder, out, checkpoint = scratch.folder(spark), scratch.folder(spark), scratch.folder(spark)
    for data in (text[: len(text) // 2], text, text[: text.find(b"\n", len(text) // 4) + 1]):
        _put(f"{folder}/owners.csv", data)
        query = tail.owners(spark, folder).select("local_port", "pid", "command").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("pid", "local_port", "command").agg(F.count("*").alias("times"))


def _flows_by(measure: str, top: int = 30):
    """K1: flows by another measure than bytes."""

    def query(spark, sf_dir):
        p = packets(spark, sf_dir)
        rows = traffic.flows(p).select(*traffic.FLOW, "packets", "first_seen")
        if measure == "beacon_score":
            keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in traffic.FLOW]
            scores = behaviour.beacon_scores(p).select(*(F.col(c).alias(f"_{c}") for c in traffic.FLOW), F.round("beacon_score", 6).alias("beacon_score"))
            rows = rows.join(scores, keys).select(*traffic.FLOW, "beacon_score")
        return objects.ranked(rows, measure, *traffic.FLOW, top=top).select(*traffic.FLOW, measure)

    return query


def _nodes_by_bytes(spark, sf_dir):
    """K3: the ends of the conversations, by what they sent and received."""
    hosts = traffic.hosts(packets(spark, sf_dir)).select("ip", (F.col("bytes_out") + F.col("bytes_in")).alias("bytes"), (F.col("packets_out") + F.col("packets_in")).alias("packets"))
    return objects.ranked(hosts, "bytes", "ip", top=20)


def _tables_by_bytes(spark, sf_dir):
    """K4: endpoints, ports and protocols, the five largest of each."""
    p = packets(spark, sf_dir)
    parts = [traffic.totals(p, c).select(F.lit(name).alias("kind"), F.col(c).cast("string").alias("value"), "packets", "bytes") for name, c in (("endpoint", "src"), ("port", "dst_port"), ("protocol", "protocol"))]
    return objects.ranked(reduce(DataFrame.unionByName, parts), "bytes", "value", top=5, within="kind")


def queries() -> dict:
    return {
        "k1_flows_by_packets": _flows_by("packets"),
        "k1_flows_by_time": _flows_by("first_seen"),
        "k1_flows_by_beacon": _flows_by("beacon_score"),
        "k3_top_nodes": _nodes_by_bytes,
        "k4_top_tables": _tables_by_bytes,
        "i7_automatic": _automatic, "z2_late_rows": _late, "j14_stream_dns": _dns_stream, "s12_growing_file": _tail}


def oracle_sql(known: dict[str, str]) -> dict[str, str]:
    p = f"WITH p AS ({SQL.replace('{events}', 'events')})"
    owner = OWNER_LINES.replace("{supplier}", "supplier").replace("{{", "{").replace("}}", "}")
    flow = ", ".join(traffic.FLOW)
    ranked = lambda rows, measure: f"SELECT {flow}, {measure} FROM ({rows}) x ORDER BY {measure} DESC, {', '.join(c + ' NULLS FIRST' for c in traffic.FLOW)} LIMIT 30"
    table = lambda kind, c: f"SELECT '{kind}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS packets, sum(length)::BIGINT AS bytes FROM p GROUP BY {c}"
    return {
        "k1_flows_by_packets": ranked(known["a1_flows"], "packets"),
        "k1_flows_by_time": ranked(known["a1_flows"], "first_seen"),
        "k1_flows_by_beacon": ranked(f"SELECT {flow}, round(beacon_score, 6) AS beacon_score FROM ({known['a3_beacon_scores']}) b", "beacon_score"),
        "k3_top_nodes": f"SELECT ip, (bytes_out + bytes_in)::BIGINT AS bytes, (packets_out + packets_in)::BIGINT AS packets FROM ({known['a5_hosts']}) h ORDER BY bytes DESC, ip LIMIT 20",
        "k4_top_tables": f"""{p}, t AS ({table('endpoint', 'src')} UNION ALL {table('port', 'dst_port')} UNION ALL {table('protocol', 'protocol')})
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY bytes DESC, value) AS rank FROM t) r WHERE rank <= 5""",
        "i7_automatic": f"""WITH RECURSIVE i AS ({FOUND.replace("{events}", "events")}), g AS (SELECT attacker, count(DISTINCT detector) > 1 AS gated FROM i GROUP BY attacker),
            d AS (SELECT i.*, gated, CAST(string_split(attacker, '.')[3] AS INT) % 7 = 0 AS kept FROM i JOIN g USING (attacker)),
            o AS (SELECT *, row_number() OVER (ORDER BY first_time, incident_id) AS k FROM d WHERE gated AND NOT kept),
            s AS (SELECT 0::BIGINT AS k, []::DOUBLE[] AS held, false AS let UNION ALL
              SELECT o.k, CASE WHEN len(list_filter(s.held, lambda e: o.first_time < e)) < {MOST} THEN list_append(list_filter(s.held, lambda e: o.first_time < e), o.first_time + {EXPIRES}) ELSE list_filter(s.held, lambda e: o.first_time < e) END,
                len(list_filter(s.held, lambda e: o.first_time < e)) < {MOST} FROM s JOIN o ON o.k = s.k + 1)
            SELECT incident_id, CASE WHEN kept THEN 'address is on the protection list' WHEN gated AND NOT let THEN 'most active blocks reached' ELSE 'automatic' END AS reason,
              CASE WHEN kept THEN 'rejected' WHEN NOT gated THEN 'pending approval' WHEN NOT let THEN 'rejected' WHEN first_time + {EXPIRES} <= {NOW} THEN 'expired' ELSE 'applied' END AS status
            FROM d LEFT JOIN (SELECT incident_id, let FROM s JOIN o USING (k)) x USING (incident_id)""",
        "z2_late_rows": f"""{p}, b AS (SELECT no, timestamp, {BEHIND} AS behind, CASE WHEN {BEHIND} THEN 2 WHEN timestamp < (SELECT max(timestamp) / 2 FROM p) THEN 0 ELSE 1 END AS batch FROM p)
            SELECT no, behind AND floor((timestamp + {START}) * 1000) < (SELECT floor((max(timestamp) + {START}) * 1000) - {PATIENCE * 1000} FROM b WHERE NOT behind) AS late, batch FROM b""",
        "j14_stream_dns": f"SELECT no, target AS server, latency_ms FROM ({known['j14_dns_latency']}) j",
        "s12_growing_file": f"""WITH l AS (SELECT value, sum(strlen(value) + 1) OVER (ORDER BY value) AS upto FROM ({owner}) o), a AS (SELECT *, upto - strlen(value) - 1 AS begins, (SELECT max(upto) FROM l) AS size FROM l),
            t AS (SELECT *, 1 + CASE WHEN begins <= size // 4 THEN 1 ELSE 0 END AS times FROM a WHERE NOT starts_with(trim(value), '#') AND trim(value) <> '')
            SELECT CAST(string_split(value, ',')[6] AS INT) AS pid, CAST(string_split(value, ',')[3] AS INT) AS local_port, array_to_string(string_split(value, ',')[9:], ',') AS command, sum(times)::BIGINT AS times FROM t GROUP BY ALL""",
    }
