"""Raw frames decoded into packet columns (S2 to S4): built-in functions over each row's own bytes, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators.fields import _cut, _number

#: Names of services by port, the first one that has either port.
TCP_PORTS = (
    ("HTTP", 80, 8080), ("HTTPS", 443), ("SSH", 22), ("SMTP", 25, 587), ("IMAP", 143), ("IMAPS", 993), ("POP3", 110), ("MySQL", 3306), ("PostgreSQL", 5432),
    ("Redis", 6379), ("MongoDB", 27017), ("Elasticsearch", 9200), ("Modbus", 502), ("MQTT", 1883), ("MQTT-TLS", 8883), ("OPC-UA", 4840), ("DNP3", 20000),
    ("EtherNet/IP", 44818), ("S7comm", 102), ("IEC-104", 2404), ("FTP", 20, 21), ("Telnet", 23), ("BGP", 179), ("LDAP", 389), ("SIP", 5060), ("SIPS", 5061),
    ("DoIP", 13400), ("SOME/IP", 30490), ("SMB", 445), ("RDP", 3389), ("Kerberos", 88), ("NetBIOS-SSN", 139), ("RTSP", 554), ("Kafka", 9092), ("AMQP", 5672),
    ("NATS", 4222), ("Memcached", 11211), ("VNC", 5900), ("Docker", 2375, 2376), ("Prometheus", 9090), ("etcd", 2379, 2380),
)
UDP_PORTS = (
    ("DNS", 53), ("mDNS", 5353), ("DHCP", 67, 68), ("NTP", 123), ("QUIC", 443), ("SNMP", 161), ("SNMP-trap", 162), ("Syslog", 514), ("CoAP", 5683), ("CoAP-DTLS", 5684),
    ("BACnet", 47808), ("DNP3", 20000), ("EtherNet/IP", 2222), ("PTP", 319, 320), ("DHCPv6", 546, 547), ("VXLAN", 4789), ("GTP", 2152), ("WireGuard", 51820), ("SIP", 5060),
    ("SIPS", 5061), ("Radius", 1812, 1813, 1645, 1646), ("SOME/IP", 30490), ("WoL", 9), ("NBNS", 137), ("TFTP", 69), ("STUN", 3478), ("SSDP", 1900), ("RIP", 520), ("Kerberos", 88),
)
#: Names by IP protocol number, of ICMP types, PPPoE codes, OSPF and PIM messages.
IP_NAMES = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 88: "EIGRP", 89: "OSPF", 103: "PIM", 112: "VRRP"}
ICMP = {0: "Echo reply", 3: "Destination unreachable", 8: "Echo request", 11: "Time exceeded"}
ICMP6 = {128: "Echo request", 129: "Echo reply", 133: "Router solicitation", 134: "Router advertisement", 135: "Neighbor solicitation", 136: "Neighbor advertisement"}
PPPOE = {0x07: "PADO", 0x09: "PADI", 0x19: "PADR", 0x65: "PADS", 0xA7: "PADT"}
OSPF = {1: "Hello", 2: "DBD", 3: "LSR", 4: "LSU", 5: "LSAck"}
PIM = dict(enumerate(("Hello", "Register", "Register-Stop", "Join/Prune", "Bootstrap", "Assert", "Graft", "State-Refresh", "Candidate-RP")))
NO_ADDRESS = "?.?.?.?"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def service_name(table: tuple, src_port: Column, dst_port: Column, default: str) -> Column:
    """The name of the first entry of a port table that has one of the two ports."""
    ranked: dict = {}
    for rank, (name, *ports) in enumerate(table):
        for port in ports:
            ranked.setdefault(port, f"{rank:03d}{name}")
    by_port = _map(ranked)
    return F.coalesce(F.substring(F.least(F.try_element_at(by_port, src_port), F.try_element_at(by_port, dst_port)), 4, 100), F.lit(default))


def _kept(rows: DataFrame) -> DataFrame:
    """rows, their columns computed once: a generator, so the optimiser doesn't copy them into all later expressions."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def decoded(frames: DataFrame) -> DataFrame:
    """Packets from frames (no, timestamp, bytes): addresses, protocol, summary, ports and VLAN tags.

    A frame that is too short or of another kind is RAW with the address ?.?.?.?; null bytes count as an empty
    frame. Any number of VLAN tags is passed over; only frames that begin with one are looked through for more.
    """
    rows = frames.select("no", "timestamp", F.coalesce("bytes", F.lit(b"").cast("binary")).alias("bytes"))
    tags = F.regexp_extract(F.hex(F.expr("substring(bytes, 13)")), "^((?:(?:8100|88A8)[0-9A-F]{4})*)", 1)
    tagged = F.hex(F.substring("bytes", 13, 2)).isin("8100", "88A8")
    rows = rows.withColumn("_tags", F.when(tagged, (F.length(tags) / 8).cast("int")).otherwise(0)).withColumn("_net", 14 + 4 * F.col("_tags"))
    rows = rows.withColumns({"_size": F.length("bytes"), "_type": F.hex(_cut(F.col("_net") - 2, 2)), "_rest": F.length("bytes") - F.col("_net")})
    rows = _kept(rows)
    net = lambda k: F.col("_net") + k
    ihl = _number(net(0), 1).bitwiseAND(15).cast("int") * 4
    v4 = (F.col("_type") == "0800") & (F.col("_rest") >= 20) & (F.col("_rest") >= ihl)
    v6 = (F.col("_type") == "86DD") & (F.col("_rest") >= 40)
    link = F.when((F.col("_type") == "0806") & (F.col("_rest") >= 28), "ARP").when(F.col("_type").isin("8847", "8848"), "MPLS").when(F.col("_type").isin("8863", "8864"), "PPPoE")
    kind = F.when(F.col("_size") < 14, "RAW").when(v4 | v6, "IP").otherwise(F.coalesce(link, F.lit("RAW")))
    rows = rows.withColumns({"_kind": kind, "_six": F.col("_type") == "86DD", "_l4": F.when(F.col("_type") == "0800", F.col("_net") + ihl).otherwise(net(40)), "_proto": F.when(F.col("_type") == "0800", _number(net(9), 1)).otherwise(_number(net(6), 1)).cast("int")})
    rows = _kept(rows.withColumn("_t", F.col("_size") - F.col("_l4")))  # bytes of the transport layer

    l4 = lambda k, n=1: _number(F.col("_l4") + k, n).cast("int" if n < 4 else "long")
    named = lambda values, code: F.try_element_at(_map(values), code.cast("int"))
    tag = lambda back: F.when(F.col("_tags") >= back, _number(F.col("_net") - 4 * back, 2).cast("int"))
    ported = F.when(F.col("_kind") == "IP", ((F.col("_proto") == 6) & (F.col("_t") >= 20)) | ((F.col("_proto") == 17) & (F.col("_t") >= 8))).otherwise(False)
    plain = _kept(rows.withColumns({"src_port": F.when(ported, l4(0, 2)), "dst_port": F.when(ported, l4(2, 2))}))

    ports = (F.col("src_port"), F.col("dst_port"))
    udp = service_name(UDP_PORTS, *ports, "UDP")
    udp = F.when((udp == "UDP") & (F.col("_t") >= 12) & (F.shiftright(l4(8), 6) == 2), "RTP").otherwise(udp)
    transport = F.when(F.col("_proto") == 6, service_name(TCP_PORTS, *ports, "TCP")).when(F.col("_proto") == 17, udp).otherwise(F.coalesce(named(IP_NAMES, F.col("_proto")), F.concat(F.lit("IP("), F.col("_proto").cast("string"), F.lit(")"))))
    say = lambda form, *values: F.format_string(form, *values)
    spi = lambda name, at, least: F.concat(F.lit(f"IPSec {name} SPI="), F.when(F.col("_t") >= least, say("0x%08x", l4(at, 4))).otherwise("?"))
    group = T.dotted(_cut(F.col("_l4") + 4, 4))
    igmp = F.when(l4(0) == 0x11, F.concat(F.lit("Membership Query group="), group)).when(l4(0) == 0x16, F.concat(F.lit("Membership Report v2 group="), group)).when(l4(0) == 0x17, F.concat(F.lit("Leave Group "), group)).when(l4(0) == 0x22, "Membership Report v3").otherwise(say("IGMP type=0x%02x", l4(0)))
    inner = F.hex(_cut(F.col("_l4") + 2, 2))
    words = {
        1: F.when(F.col("_t") >= 2, F.coalesce(named(ICMP, l4(0)), say("ICMP type=%d", l4(0)))).otherwise("ICMP"),
        2: F.when(F.col("_t") >= 8, igmp).otherwise("IGMP"),
        6: F.when(F.col("_t") < 20, "TCP (truncated)").otherwise(say("%d → %d [%s] Seq=%d", *ports, T.flag_names(l4(13)), l4(4, 4))),
        17: F.when(F.col("_t") < 8, "UDP (truncated)").otherwise(say("%d → %d Len=%d", *ports, F.col("_t") - 8)),
        47: F.concat(F.lit("GRE Encapsulated"), F.when(inner == "0800", " (IPv4)").when(inner == "86DD", " (IPv6)").otherwise("")),
        50: spi("ESP", 0, 4),
        51: spi("AH", 4, 8),
        58: F.when(F.col("_t") >= 2, F.coalesce(named(ICMP6, l4(0)), say("ICMPv6 type=%d", l4(0)))).otherwise("ICMPv6"),
        88: say("EIGRP opcode=%d", F.coalesce(l4(1), F.lit(0))),
        89: F.concat(F.lit("OSPF "), F.when(F.col("_t") < 2, "OSPF").otherwise(F.coalesce(named(OSPF, l4(1)), F.lit("Unknown")))),
        103: F.concat(F.lit("PIM "), F.coalesce(named(PIM, F.coalesce(l4(1), F.lit(0)).bitwiseAND(15)), F.lit("Unknown"))),
        112: F.when(F.col("_t") >= 4, say("VRRPv%d VRID=%d Priority=%d", F.shiftright(l4(0), 4), l4(1), l4(2))).otherwise("VRRP"),
    }
    about = F.lit("Unknown IP protocol")
    for number, text in words.items():
        about = F.when(F.col("_proto") == number, text).otherwise(about)

    groups = lambda data: F.regexp_replace(F.lower(F.hex(data)), r"(....)(?!$)", "$1:")
    end = lambda arp, four, six: F.when(F.col("_kind") == "ARP", T.dotted(_cut(net(arp), 4))).when(F.col("_kind") != "IP", NO_ADDRESS).when(F.col("_six"), groups(_cut(net(six), 16))).otherwise(T.dotted(_cut(net(four), 4)))
    plain = plain.withColumns({"_service": transport, "src": end(14, 12, 8), "dst": end(24, 16, 24)})
    plain = _kept(plain)
    code = _number(net(1), 1)
    pppoe = F.when(F.col("_type") == "8864", say("PPPoE Session id=0x%04x", F.coalesce(F.when(F.col("_rest") >= 4, _number(net(2), 2)), F.lit(0)))).otherwise(F.coalesce(F.concat(F.lit("PPPoE "), named(PPPOE, code)), say("PPPoE code=0x%02x", F.coalesce(code, F.lit(0)))))
    arp = F.concat(F.lit("Who has "), "dst", F.lit("? Tell "), "src", F.when(_number(net(6), 2) == 1, " (request)").otherwise(" (reply)"))
    mpls = say("MPLS Label=%d", F.coalesce(F.shiftright(_number(net(0), 4), 12), F.lit(0)))
    info = F.when(F.col("_kind") == "RAW", "Unparseable frame").when(F.col("_kind") == "ARP", arp).when(F.col("_kind") == "MPLS", mpls).when(F.col("_kind") == "PPPoE", pppoe).otherwise(about)
    known = F.col("_kind") != "RAW"
    return plain.select(
        "no", "timestamp", "src", "dst", F.when(F.col("_kind") == "IP", F.col("_service")).otherwise(F.col("_kind")).alias("protocol"), F.col("_size").alias("length"), info.alias("info"), "src_port", "dst_port",
        F.when(known, tag(1).bitwiseAND(0x0FFF)).alias("vlan_id"), F.when(known, F.shiftright(tag(1), 13).bitwiseAND(7)).alias("vlan_pcp"), F.when(known, F.shiftright(tag(1), 12).bitwiseAND(1)).alias("vlan_dei"), F.when(known, tag(2).bitwiseAND(0x0FFF)).alias("outer_vlan_id"), "bytes",
    )
