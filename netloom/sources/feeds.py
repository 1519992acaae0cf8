"""Readers of small reference files: indicators, prefix maps, reputation, socket owners, TLS key logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("ip", "domain", "hash", "url", "email")
#: The labels of TLS key logs.
KEY_LABELS = (
    "CLIENT_RANDOM", "CLIENT_EARLY_TRAFFIC_SECRET", "CLIENT_HANDSHAKE_TRAFFIC_SECRET", "SERVER_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0", "EXPORTER_SECRET", "EARLY_EXPORTER_SECRET",
    "QUIC_CLIENT_EARLY_TRAFFIC_SECRET", "QUIC_CLIENT_HANDSHAKE_TRAFFIC_SECRET", "QUIC_SERVER_HANDSHAKE_TRAFFIC_SECRET", "QUIC_CLIENT_TRAFFIC_SECRET_0", "QUIC_SERVER_TRAFFIC_SECRET_0",
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments, with the file they come from."""
    rows = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("source"))
    return rows.where("line != '' and not startswith(line, '#')")


def _part(k: int, limit: int = -1) -> Column:
    return F.trim(F.get(F.split("line", ",", limit), F.lit(k)))


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """Type,value[,description]; unknown types are passed over."""
    rows = _lines(spark, path).select(F.lower(_part(0, 3)).alias("kind"), _part(1, 3).alias("value"), F.coalesce(_part(2, 3), F.lit("")).alias("description"), "source")
    return rows.where(F.col("kind").isin(*KINDS) & (F.col("value") != ""))


def plain_indicators(spark: SparkSession, path: str) -> DataFrame:
    """An IPv4 address or a dotted name on each line."""
    kind = F.when(F.col("line").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(F.col("line").contains("."), "domain")
    return _lines(spark, path).select(kind.alias("kind"), F.col("line").alias("value"), F.lit("").alias("description"), "source").where("kind is not null")


def _checked(rows: DataFrame, good: Column) -> DataFrame:
    return rows.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "line")).isNull()))


def prefixes(spark: SparkSession, path: str) -> DataFrame:
    """CIDR,ASN,organization; any other line is an error."""
    rows = _checked(_lines(spark, path), (F.size(F.split("line", ",")) >= 3) & _part(0).rlike("^[0-9A-Fa-f.:]+/[0-9]{1,3}$"))
    return rows.select(_part(0, 3).alias("cidr"), _part(1, 3).alias("asn"), _part(2, 3).alias("organization"))


def reputation(spark: SparkSession, path: str) -> DataFrame:
    """Target,severity,label,source, the target being an address, a prefix or a fingerprint (see kind)."""
    rows = _checked(_lines(spark, path), F.size(F.split("line", ",")) >= 4)
    kind = F.when(_part(0).rlike(r"^\d{1,3}(\.\d{1,3}){3}(/\d+)?$") | _part(0).rlike(r"^[0-9A-Fa-f]*:[0-9A-Fa-f:]*(/\d+)?$"), "address").otherwise("fingerprint")
    return rows.select(kind.alias("kind"), _part(0).alias("target"), _part(1).alias("severity"), _part(2).alias("label"), _part(3).alias("source"))


def key_log(spark: SparkSession, path: str) -> DataFrame:
    """Label, client random and secret of each valid line; the secret itself is dropped, its length stays."""
    word = lambda k: F.get(F.split("line", r"\s+"), F.lit(k))
    rows = _lines(spark, path).where(word(0).isin(*KEY_LABELS) & word(1).rlike("^[0-9A-Fa-f]{64}$") & word(2).rlike("^([0-9A-Fa-f]{2})+$"))
    return rows.select(word(0).alias("label"), F.lower(word(1)).alias("client_random"), (F.length(word(2)) / 2).cast("int").alias("secret_bytes"))


OWNER = ("protocol", "local_ip", "local_port", "remote_ip", "remote_port", "pid", "uid", "process", "command")


def _owners(lines: DataFrame) -> DataFrame:
    """Lines of nine fields as socket owners; any other line is an error."""
    port = lambda k: _part(k, 9).try_cast("int")
    good = (F.size(F.split("line", ",", 9)) == 9) & F.upper(_part(0, 9)).isin("TCP", "UDP") & port(2).between(0, 65535) & port(4).between(0, 65535) & port(5).isNotNull() & port(6).isNotNull()
    good = good & _part(1, 9).rlike("^[0-9A-Fa-f.:]+$") & _part(3, 9).rlike("^[0-9A-Fa-f.:]+$")
    rows = _checked(lines, good)
    return rows.select(F.upper(_part(0, 9)).alias("protocol"), *(_part(k, 9).alias(OWNER[k]) if k not in (2, 4, 5, 6) else port(k).alias(OWNER[k]) for k in range(1, 9)))


def socket_owners(spark: SparkSession, path: str) -> DataFrame:
    """Protocol,local address and port,remote address and port,pid,uid,process,command of each line."""
    return _owners(_lines(spark, path))


def socket_losses(spark: SparkSession, path: str) -> DataFrame:
    """What the collector says it lost, from the latest comment of each file that tells: kernel_lost and
    userspace_invalid."""
    number = lambda name: F.nullif(F.regexp_extract("value", rf"(?:^|\s){name}=(\d+)", 1), F.lit("")).cast("long").alias(name)
    rows = spark.read.text(path).where("startswith(trim(value), '#')").select(F.col("_metadata.file_name").alias("source"), F.monotonically_increasing_id().alias("_at"), number("kernel_lost"), number("userspace_invalid"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    return rows.groupBy("source").agg(last("kernel_lost"), last("userspace_invalid")).where("kernel_lost is not null or userspace_invalid is not null")


def socket_owner_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Owners as new files of them land; the checkpoint of the query keeps what has been read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder).select(F.trim("value").alias("line"))
    return _owners(lines.where("line != '' and not startswith(line, '#')"))
