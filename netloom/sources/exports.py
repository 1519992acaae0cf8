"""Writers of findings, graphs and cases: one folder for each table, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 1
#: Columns that hold secrets and never leave in a case.
SECRET = ("value", "secret", "password")
#: Columns that mark a table of indicators, of their hits or of fields, whose values aren't secrets.
PUBLIC = frozenset({"description", "context", "path"})


def evidence(incident_packets: DataFrame, path: str) -> None:
    """The packets of each incident as JSON lines in a folder of its own; incidents that are there stay as they are."""
    spark = incident_packets.sparkSession
    try:
        there = spark.read.json(path).select("incident_id").distinct()
        incident_packets = incident_packets.join(there, "incident_id", "left_anti")
    except AnalysisException:  # nothing has been written yet
        pass
    incident_packets.write.mode("append").partitionBy("incident_id").json(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "json") -> None:
    """Nodes and edges as JSON or CSV with a head line."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if form == "csv" else writer.json)(f"{path}/{name}")


def case(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a case as Parquet, columns of secrets left out, and its version beside them.

    Indicators, their hits and field tables keep their values; the table named credentials never does.
    """
    for name, df in tables.items():
        public = name != "credentials" and PUBLIC & set(df.columns)
        df.drop(*(c for c in SECRET if not (public and c == "value"))).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION, sorted(tables))], "version int, tables array<string>").write.mode("overwrite").json(f"{path}/manifest")


def load_case(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a case of this version; another version is an error."""
    manifest = spark.read.schema("version int, tables array<string>").json(f"{path}/manifest").first()
    if manifest is None or manifest["version"] != VERSION:
        raise ValueError("a case of another version")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def graph_summary(nodes: DataFrame, paths: DataFrame, clusters: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """The highest nodes, paths and clusters; nodes must be scored. Text is the caller's to make."""
    return {
        "nodes": nodes.orderBy(F.desc("score"), "key").limit(top).select("key", "kind", "label", "score", "why"),
        "paths": paths.orderBy(F.desc("score"), "kind", "node").limit(top),
        "clusters": clusters.orderBy(F.desc("score"), "kind", "label").limit(top),
    }


#: Tables that metrics counts where they are given, by the name of the number.
COUNTED = ("visible_packets", "rule_hits", "ioc_hits", "pending_incidents", "evidence_exports", "enriched_addresses")


def metrics(packets: DataFrame, findings: DataFrame, latency: DataFrame | None = None, counted: dict[str, DataFrame] | None = None, capturing: bool = False) -> DataFrame:
    """Counters and gauges in one row: packets, bytes, flows, hosts, findings, packets in the last second and the
    95th percentile of latency; the rows of further tables, by the names of COUNTED (0 where one isn't given); whether a capture runs. Of
    incidents those that are pending count, of addresses the distinct ones. Flows and hosts are counted after they are grouped."""
    from netloom.operators.traffic import FLOW, hosts, with_flow_key

    counted = counted or {}
    sums = packets.agg(F.count("*").alias("packets_total"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_total"))
    flows = with_flow_key(packets).groupBy(*FLOW).agg(F.count("*").alias("_n")).agg(F.count("*").alias("flows"))
    known = hosts(packets).agg(F.count("*").alias("hosts"))
    found = findings.agg(F.count("*").alias("security_findings"))
    rate = packets.groupBy(F.floor("timestamp").alias("_s")).agg(F.count("*").alias("_n")).agg(F.max_by("_n", "_s").alias("packets_per_second"))
    p95 = latency.agg(F.max("p95_ms").alias("latency_p95_ms")) if latency is not None else sums.select(F.lit(None).cast("double").alias("latency_p95_ms"))
    out = sums
    for one in (flows, known, found, rate, p95):  # one row each
        out = out.join(F.broadcast(one))
    for name in COUNTED:
        if name not in counted:
            out = out.withColumn(name, F.lit(0).cast("long"))
            continue
        rows = counted[name]
        rows = rows.where("status = 'pending'") if name == "pending_incidents" and "status" in rows.columns else rows.select("address").distinct() if name == "enriched_addresses" else rows
        out = out.join(F.broadcast(rows.agg(F.count("*").alias(name))))
    return out.withColumn("capturing", F.lit(int(capturing)))


#: What each column of metrics is called in text: name, kind.
METRICS = {
    "packets_total": ("packets_observed_total", "counter"), "bytes_total": ("bytes_observed_total", "counter"), "visible_packets": ("visible_packets", "gauge"), "flows": ("active_flows", "gauge"), "hosts": ("hosts_observed", "gauge"),
    "security_findings": ("security_findings", "gauge"), "rule_hits": ("rule_hits", "gauge"), "ioc_hits": ("ioc_hits", "gauge"), "pending_incidents": ("pending_incidents", "gauge"), "evidence_exports": ("evidence_exports", "gauge"),
    "packets_per_second": ("packets_per_second", "gauge"), "capturing": ("capture_active", "gauge"), "latency_p95_ms": ("latency_p95_milliseconds", "gauge"), "enriched_addresses": ("enriched_addresses", "gauge"),
}


def open_metrics(snapshot: DataFrame, prefix: str = "netloom") -> DataFrame:
    """A snapshot as OpenMetrics text, in one row."""
    lines = [F.concat(F.lit(f"# TYPE {prefix}_{name} {kind}\n{prefix}_{name} "), F.when(F.col(c).isNull(), "0").otherwise(F.format_string("%.3f", F.col(c)) if c == "latency_p95_ms" else F.col(c).cast("string")), F.lit("\n")) for c, (name, kind) in METRICS.items()]
    return snapshot.select(F.concat(*lines, F.lit("# EOF\n")).alias("text"))


#: The tables of a case in full, in the order in which they are read.
SECTIONS = ("meta", "hosts", "ioc_hits", "rule_hits", "pattern_matches", "alerts", "findings", "credentials", "notes", "incidents", "evidence", "processes", "drift", "containment", "latency", "identity", "graph")


def case_sections(packets: DataFrame, tables: dict[str, DataFrame], top: int = 20) -> dict[str, DataFrame]:
    """The seventeen tables of a case: meta and hosts from the packets, the graph's highest nodes, and what is
    given under the other names; a table that isn't given is left out. Values of credentials are dropped by `case`."""
    from netloom.operators.traffic import hosts, summary

    made = {"meta": summary(packets), "hosts": hosts(packets)} | tables
    if "graph" in made:
        made["graph"] = made["graph"].orderBy(F.desc("score"), "key").limit(top)
    unknown = sorted(set(made) - set(SECTIONS))
    if unknown:
        raise ValueError(f"no such part of a case: {', '.join(unknown)}")
    return {name: made[name] for name in SECTIONS if name in made}


def references(spark: SparkSession, files: list[str], path: str) -> None:
    """The lightweight form of a case: where its capture files are, and no packets."""
    spark.createDataFrame([(VERSION, files)], "version int, files array<string>").write.mode("overwrite").json(f"{path}/references")


def load_references(spark: SparkSession, path: str) -> list[str]:
    """The capture files of a lightweight case; another version is an error."""
    row = spark.read.schema("version int, files array<string>").json(f"{path}/references").first()
    if row is None or row["version"] != VERSION:
        raise ValueError("a case of another version")
    return list(row["files"])


def merge_case(own: dict[str, DataFrame], other: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A case with another's notes, tags, indicators and metadata of objects: rows that are there already come
    once, by all their columns."""
    shared = ("notes", "tags", "indicators", "objects")
    out = dict(own)
    for name in shared:
        if name in other:
            both = own[name].unionByName(other[name], allowMissingColumns=True) if name in own else other[name]
            out[name] = both.dropDuplicates()
    return out
