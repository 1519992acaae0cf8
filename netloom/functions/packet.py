"""Column expressions over packets: addresses, header bytes, filters. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte(col: str, offset: int) -> Column:
    """The byte at an offset from 0 as a number; null beyond the end."""
    return F.conv(F.hex(F.substring(F.col(col), offset + 1, 1)), 16, 10).cast("int")


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    parts = F.split(address, r"\.")
    ok = address.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    at = lambda i: F.get(parts, F.lit(i)).cast("long")
    return F.when(ok, ((at(0) * 256 + at(1)) * 256 + at(2)) * 256 + at(3))


_OCTET = r"\.(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Private, loopback and link-local addresses, as one pattern: it is looked at once for each address.
_INTERNAL = rf"^(?:(?:10|127)(?:{_OCTET}){{3}}|(?:192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))(?:{_OCTET}){{2}})$"


def is_internal(address: Column) -> Column:
    """Private, loopback or link-local IPv4; loopback, link-local or unique-local IPv6. False for other text and null."""
    v6 = address.contains(":") & (F.lower(address).rlike("^(fe[89ab]|f[cd])[0-9a-f]*:") | F.lower(address).rlike("^(0*:)*:?0*1$"))
    return F.coalesce(address.rlike(_INTERNAL), F.lit(False)) | F.coalesce(v6, F.lit(False))


def _flag_digits(frame: str) -> Column:
    """The flag byte of a TCP segment in an untagged IPv4 frame as two hex digits, null for other frames. The frame's
    head is turned into digits once, however the frame itself comes about."""

    def of(head: Column) -> Column:
        cut = lambda byte_at, n: F.substring(head, 2 * (byte_at - 12) + 1, n)
        words = F.instr(F.lit("0123456789ABCDEF"), F.substring(head, 6, 1)) - 1
        flags = F.substring(head, 2 * (15 + 4 * words) + 1, F.lit(2))
        return F.when((cut(12, 4) == "0800") & (cut(23, 2) == "06") & (F.length(flags) == 2), flags)

    return F.get(F.transform(F.array(F.hex(F.substring(F.col(frame), 13, 76))), of), F.lit(0))


def tcp_flags(frame: str = "bytes") -> Column:
    """The flag byte of a TCP segment in an untagged IPv4 frame; null for other frames."""
    return F.conv(_flag_digits(frame), 16, 10).cast("int")


def is_syn(frame: str = "bytes") -> Column:
    """SYN without ACK: the flags' first digit is even, and the second has its second bit."""
    return F.coalesce(_flag_digits(frame).rlike("^[02468ACE][2367ABEF]$"), F.lit(False))


# Filters. A missing field is "no match", so every filter is true or false and can be negated.


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def has_protocol(name: str) -> Column:
    """the protocol is, or the summary or an address holds, the name, whatever the case."""
    p = name.lower()
    return _sure(F.lower("protocol") == p) | _sure(F.lower("info").contains(p)) | _sure(F.lower("src").contains(p)) | _sure(F.lower("dst").contains(p))


def any_port(test) -> Column:
    """some port of the packet passes; so any_port(lambda p: p != 80) asks for a port that differs."""
    return _sure(test(F.col("src_port"))) | _sure(test(F.col("dst_port")))


def contains(column: str, text: str) -> Column:
    """holds the text, whatever the case; the text is no pattern."""
    return _sure(F.lower(column).contains(text.lower()))


#: Fields that are text. A missing one is an empty text.
TEXT_FIELDS = {
    "ip.src": lambda: F.col("src"), "ip.addr": lambda: F.col("src"), "ip.dst": lambda: F.col("dst"),
    "tcp.srcport": lambda: F.col("src_port").cast("string"), "udp.srcport": lambda: F.col("src_port").cast("string"),
    **{name: lambda: F.col("dst_port").cast("string") for name in ("tcp.dstport", "udp.dstport", "tcp.port", "udp.port")},
    "proto": lambda: F.col("protocol"), "ip.proto": lambda: F.col("protocol"), "info": lambda: F.col("info"), "frame.info": lambda: F.col("info"),
    "http.host": lambda: http_host(F.col("info")), "http.method": lambda: word_of(F.col("info"), 0), "http.uri": lambda: word_of(F.col("info"), 1), "http.request.uri": lambda: word_of(F.col("info"), 1), "dns.qname": lambda: dns_name(F.col("info")),
}
#: Fields that are numbers. A missing one has no value; the time to live of a frame too short for it is 0.
NUMBER_FIELDS = {
    "frame.len": lambda: F.col("length"), "frame.length": lambda: F.col("length"), "frame.number": lambda: F.col("no"),
    "tcp.srcport": lambda: F.col("src_port"), "udp.srcport": lambda: F.col("src_port"), "tcp.dstport": lambda: F.col("dst_port"), "udp.dstport": lambda: F.col("dst_port"),
    "ip.ttl": lambda: F.coalesce(byte("bytes", 22), F.lit(0)), "vlan.id": lambda: F.col("vlan_id"), "vlan.pcp": lambda: F.col("vlan_pcp"), "vlan.dei": lambda: F.col("vlan_dei"), "vlan.outer": lambda: F.col("outer_vlan_id"), "vlan.outer_id": lambda: F.col("outer_vlan_id"),
}
#: Fields with several values: some value has to pass.
PORTS = ("tcp.port", "udp.port")
OPERATORS = ("==", "!=", "<", ">", "<=", ">=")


def word_of(text: Column, k: int) -> Column:
    """The k-th word of a summary, from 0; a request's method and address."""
    return F.coalesce(F.get(F.split(F.trim(text), r"\s+"), F.lit(k)), F.lit(""))


def http_host(text: Column) -> Column:
    """The word after Host: in a summary, without commas at its end."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(text, r"Host:\s*(\S+)", 1), ",+$", ""), F.lit(""))


def dns_name(text: Column) -> Column:
    """The first word of a summary with a dot in it, numbers in hex apart."""
    return F.coalesce(F.get(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.contains(".") & ~w.startswith("0x")), F.lit(0)), F.lit(""))


def _text(field: str) -> Column:
    return F.coalesce(TEXT_FIELDS[field](), F.lit("")) if field in TEXT_FIELDS else F.lit("")


def _compared(a: Column, op: str, b: Column) -> Column:
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def text_is(field: str, op: str, value: str) -> Column:
    """a field of text compared with a text: equality whatever the case, order by the bytes as they are."""
    own = _text(field)
    if op in ("==", "!="):
        same = F.lower(own) == value.lower()
        return same if op == "==" else ~same
    return _compared(own, op, F.lit(value))


def number_is(field: str, op: str, value: float) -> Column:
    """a field of numbers compared with a number, equality within a half; of several values one has to pass,
    so != holds where some value differs. Without a value nothing holds."""

    def test(own: Column) -> Column:
        if op in ("==", "!="):
            near = F.abs(own - F.lit(float(value))) < 0.5
            return near if op == "==" else ~near
        return _compared(own.cast("double"), op, F.lit(float(value)))

    if field in PORTS:
        return any_port(test)
    return _sure(test(NUMBER_FIELDS[field]())) if field in NUMBER_FIELDS else F.lit(False)


def is_in(field: str, values: list) -> Column:
    """a field is one of some texts, whatever the case, or numbers, within a half."""
    found = F.lit(False)
    for v in values:
        found = found | (text_is(field, "==", v) if isinstance(v, str) else number_is(field, "==", v))
    return found


def field_predicate(path: str, value: str) -> Column | None:
    """The predicate that a decoded field stands for; None for fields that can't be filtered by."""
    if path in ("ip.src", "ip.dst"):
        return text_is(path, "==", value)
    if path == "proto":
        return has_protocol(value)
    if path in ("frame.len", "frame.number", "ip.ttl", "vlan.id", "vlan.pcp", "vlan.dei", "tcp.srcport", "tcp.dstport", "udp.srcport", "udp.dstport"):
        return number_is(path, "==", float(value))
    return None


def is_qinq() -> Column:
    """both VLAN tags are there."""
    return F.col("outer_vlan_id").isNotNull() & F.col("vlan_id").isNotNull()


def free_text(text: str) -> Column:
    """the text in protocol, addresses or summary."""
    return contains("protocol", text) | contains("src", text) | contains("dst", text) | contains("info", text)
