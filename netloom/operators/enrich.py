"""Joins with what is known: indicators, prefixes, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.functions.packet import ipv4_number, is_internal

ROUTE = ("subject", "target", "port", "protocol", "authority")


def indicator_hits(packets: DataFrame, indicators: DataFrame) -> DataFrame:
    """Packets whose source or destination is an indicator of kind ip; both ends may hit. indicators has
    kind, value, description; repeated ones count once, the source is `auto` unless given."""
    known = indicators.where("kind = 'ip'").groupBy("value").agg(F.max("description").alias("description"), *([F.max("source").alias("source")] if "source" in indicators.columns else []))
    known = known.withColumn("source", F.coalesce(F.col("source") if "source" in known.columns else F.lit(None), F.lit("auto")))
    end = lambda c: F.struct(F.lit(c).alias("context"), F.col(c).alias("value"))
    ends = packets.select("no", "timestamp", F.explode(F.array(end("src"), end("dst"))).alias("e")).select("no", "timestamp", "e.*")
    return ends.join(known, "value")


def domain_hits(rows: DataFrame, id_col: str, text_col: str, indicators: DataFrame) -> DataFrame:
    """Words of a text that are, or end with, an indicator of kind domain; the longest one of each word.

    Every suffix of a word is looked up by an equality join, so no text is compared with all indicators. Only
    suffixes as long as some indicator are made; a word comes once a text.
    """
    known = indicators.where("kind = 'domain'").select(F.lower("value").alias("domain")).where("length(domain) between 1 and 253").distinct()
    sizes = [r["n"] for r in known.select(F.length("domain").alias("n")).distinct().collect()]  # 253 at most, as a name is no longer
    word = rows.select(id_col, F.explode(F.array_distinct(F.split(F.lower(text_col), r"[\s,;()<>\"']+"))).alias("word")).where("contains(word, '.')")
    cut = word.select(id_col, "word", F.explode(F.array(*(F.lit(n) for n in sizes or [0]))).alias("_n")).where("_n <= length(word)")
    hits = cut.withColumn("domain", F.expr("right(word, _n)")).join(known, "domain")
    return hits.groupBy(id_col, "word").agg(F.max_by("domain", F.length("domain")).alias("domain")).withColumn("exact", F.col("word") == F.col("domain"))


def _network(number: Column, bits: Column) -> Column:
    rest = F.lit(32) - bits
    return F.call_function("shiftleft", F.call_function("shiftright", number, rest), rest)


def identities(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each distinct address with who holds it: private first, then the longest prefix, else Unresolved.

    prefixes has cidr, asn, organization; of equal prefixes the largest name counts. The lengths of prefixes are
    33 at most, so each address meets one network of each length that is there, by an equality join.
    """
    part = lambda k: F.get(F.split("cidr", "/"), F.lit(k))
    bits, number = part(1).try_cast("int"), ipv4_number(part(0))
    nets = prefixes.select(bits.alias("_bits"), _network(number, bits).alias("_net"), "asn", "organization").where("_bits between 0 and 32 and _net is not null")
    nets = nets.groupBy("_bits", "_net").agg(F.max(F.struct("organization", "asn")).alias("_who"))
    lengths = [r["_bits"] for r in nets.select("_bits").distinct().collect()]  # 33 at most
    one = addresses.select("address").where("address is not null").distinct().withColumn("_private", is_internal(F.col("address")))
    number = ipv4_number(F.col("address"))
    tried = one.where(~F.col("_private")).select("address", F.explode(F.array(*(F.struct(F.lit(n).alias("_bits"), _network(number, F.lit(n)).alias("_net")) for n in lengths or [0]))).alias("t")).select("address", "t.*")
    best = tried.join(nets, ["_bits", "_net"]).groupBy("address").agg(F.max_by("_who", "_bits").alias("_who"))
    six = longest_ipv6(one.where(~F.col("_private")), prefixes, F.struct("organization", "asn"))
    out = one.join(best.unionByName(six.withColumnRenamed("value", "_who")), "address", "left")
    name = F.when(F.col("_private"), "Private network").otherwise(F.coalesce("_who.organization", F.lit("Unresolved")))
    source = F.when(F.col("_private"), "local classification").when(F.col("_who").isNotNull(), "prefix map").otherwise("observed")
    return out.select("address", F.col("_who.asn").alias("asn"), name.alias("organization"), source.alias("source"))


def routes(packets: DataFrame, subject: str = "src") -> DataFrame:
    """Distinct routes: who (the source or a process) reaches what, where and by which name."""
    rows = packets.where("dst_port is not null and dst not in ('', '0.0.0.0')")
    return rows.select(F.col(subject).alias("subject"), F.col("dst").alias("target"), F.col("dst_port").alias("port"), "protocol", T.authority(F.col("info")).alias("authority")).distinct()


def drift(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Observed routes that the baseline lacks; two missing names are the same."""
    there = baseline.select(*(F.col(c).alias(f"of_{c}") for c in ROUTE))
    return observed.join(there, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ROUTE], "left_anti")


def promoted(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """The baseline with all that was observed."""
    return baseline.select(*ROUTE).unionByName(observed.select(*ROUTE)).distinct()


#: Addresses of special use, in the order in which they are tried.
SPECIAL = (("127.0.0.0/8", "LOOP"), ("10.0.0.0/8", "LAN"), ("172.16.0.0/12", "LAN"), ("192.168.0.0/16", "LAN"), ("169.254.0.0/16", "LINK"), ("224.0.0.0/4", "MCAST"), ("100.64.0.0/10", "CGNAT"), ("255.255.255.255/32", "BCAST"))


def places(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each distinct address with the label of the first range that holds it, special ones before all: ranges has
    cidr, label and priority (the least is tried first), such as those of clouds, then of regions. Other addresses,
    and what is no IPv4 address, are ??. As in identities, each prefix length is one equality join."""
    part = lambda k: F.get(F.split("cidr", "/"), F.lit(k))
    spark = addresses.sparkSession
    special = spark.createDataFrame([(c, n, i - len(SPECIAL)) for i, (c, n) in enumerate(SPECIAL)], "cidr string, label string, priority long")
    least = ranges.agg(F.min("priority").alias("m")).first()["m"] or 0
    all_ = special.withColumn("priority", F.col("priority") + F.lit(min(0, least))).unionByName(ranges.select("cidr", "label", F.col("priority").cast("long").alias("priority")))
    bits = part(1).try_cast("int")
    nets = all_.select(bits.alias("_bits"), _network(ipv4_number(part(0)), bits).alias("_net"), "label", "priority").where("_bits between 0 and 32 and _net is not null")
    nets = nets.groupBy("_bits", "_net").agg(F.min(F.struct("priority", "label")).alias("_what"))
    lengths = [r["_bits"] for r in nets.select("_bits").distinct().collect()]  # 33 at most
    one = addresses.select("address").where("address is not null").distinct()
    number = ipv4_number(F.col("address"))
    tried = one.select("address", F.explode(F.array(*(F.struct(F.lit(n).alias("_bits"), _network(number, F.lit(n)).alias("_net")) for n in lengths))).alias("t")).select("address", "t.*")
    best = tried.join(nets, ["_bits", "_net"]).groupBy("address").agg(F.min("_what").alias("_what"))
    return one.join(best, "address", "left").select("address", F.coalesce("_what.label", F.lit("??")).alias("place"))


def ipv6_hex(address: Column) -> Column:
    """An IPv6 address as 32 hex digits; null for anything else. One run of zeros may be left out."""
    low = F.lower(address)
    ok = low.rlike("^[0-9a-f:]+$") & low.contains(":") & ~low.contains(":::") & ~low.rlike("::.*::")
    halves = F.split(low, "::")
    groups = lambda k: F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    head, tail = groups(0), groups(1)
    gap = 8 - F.size(head) - F.size(tail)
    zeros = F.when(low.contains("::") & (gap > 0), F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(head, zeros, tail)
    return F.when(ok & (F.size(all_) == 8) & ~F.exists(all_, lambda g: F.length(g) > 4), F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), ""))


def _bits_of(hexed: Column) -> Column:
    """32 hex digits as 128 binary ones."""
    return F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(4)))


def longest_ipv6(addresses: DataFrame, prefixes: DataFrame, value: Column) -> DataFrame:
    """J5, J6 for IPv6: (address, value) of the longest prefix that holds each distinct IPv6 address; of equal prefixes
    the largest value. prefixes has cidr. The lengths are 129 at most; each is one equality join."""
    part = lambda k: F.get(F.split("cidr", "/"), F.lit(k))
    bits = F.coalesce(part(1).try_cast("int"), F.lit(128))
    nets = prefixes.select(bits.alias("_n"), _bits_of(ipv6_hex(part(0))).alias("_all"), value.alias("_value")).where("_n between 0 and 128 and _all is not null")
    nets = nets.groupBy("_n", F.expr("left(_all, _n)").alias("_net")).agg(F.max("_value").alias("_value"))
    lengths = [r["_n"] for r in nets.select("_n").distinct().collect()]  # 129 at most
    one = addresses.select("address").where("address is not null").distinct().withColumn("_all", _bits_of(ipv6_hex(F.col("address")))).where("_all is not null")
    tried = one.select("address", "_all", F.explode(F.array(*(F.lit(n) for n in lengths or [0]))).alias("_n")).withColumn("_net", F.expr("left(_all, _n)"))
    return tried.join(nets, ["_n", "_net"]).groupBy("address").agg(F.max_by("_value", "_n").alias("value"))


def promotion(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """How many routes the baseline gains, in one row."""
    return drift(observed.select(*ROUTE).distinct(), baseline).agg(F.count("*").alias("added"))
