"""Column expressions over payloads and their text: entropy, strings' classes, names in summaries, labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of strings in the order they are tried; a class holds if a text holds or begins with a word.
SENSITIVE = ("sensitive", "key", "shell")
CLASSES = (
    ("sensitive", "holds", ("password", "passwd", "secret", "shadow", "credential", "private_key")),
    ("key", "holds", ("begin rsa", "begin private", "ssh-rsa", "api_key", "api-key", "token=")),
    ("shell", "begins", ("exec(",)),
    ("shell", "holds", ("/bin/sh", "/bin/bash", "system(", "cmd.exe", "powershell")),
    ("ot-proto", "holds", ("modbus", "bacnet", "profibus", "profinet", "ethernetip", "coap", "opcua", "opc-ua", "dnp3")),
    ("ot-field", "holds", ("holding register", "coil", "discrete input", "function code", "unit id", "transaction id")),
    ("ot-sys", "holds", ("plc", " hmi", "scada", " rtu", " dcs", "outstation", "setpoint")),
    ("ot-vendor", "holds", ("siemens", "schneider", "rockwell", "omron", "mitsubishi", "honeywell", "emerson", "abb")),
    ("mqtt", "holds", ("sensors/", "actuators/", "plant/", "connack", "publish", "subscribe")),
    ("http", "begins", ("get ", "post ", "put ", "delete ", "http/")),
    ("http-hdr", "begins", ("content-", "authorization:", "host:", "user-agent:", "accept", "cookie:")),
    ("sql", "begins", ("select ", "insert ", "update ", "delete from", "drop ")),
    ("jwt", "begins", ("eyj",)),
    ("base64", "matches", (r"^[A-Za-z0-9+/=]{15,}=$",)),
    ("path", "begins", ("/",)),
    ("path", "holds", ("c:\\", "/etc/", "/proc/", ".conf", ".dll", ".so")),
    ("ip", "matches", (r"^[0-9.]{3,15}$ & ^[^.]*[.][^.]*[.][^.]*[.][^.]*$",)),
    ("domain", "matches", (r"^[A-Za-z0-9.-]{1,64}$ & [.]",)),
    ("error", "holds", ("error", "fail", "exception", "timeout", "refused", "denied")),
    ("version", "holds", ("version", "firmware", "build", "release", "copyright")),
)


def string_class(text: Column, low: Column | None = None) -> Column:
    """The first class that holds, else ascii. Patterns look at the text as it is, words at its lower case, which
    may be given as a column: it is asked for once a word."""
    low, out = F.lower(text) if low is None else low, F.lit("ascii")
    for name, how, words in reversed(CLASSES):
        one = {"holds": lambda w: F.contains(low, F.lit(w)), "begins": lambda w: F.startswith(low, F.lit(w)), "matches": lambda w: reduce(lambda a, b: a & b, (text.rlike(x) for x in w.split(" & ")))}[how]
        out = F.when(reduce(lambda a, b: a | b, (one(w) for w in words)), F.lit(name)).otherwise(out)
    return F.when(text.isNotNull(), out)


#: Payloads and bytes that are counted at once.
_ROWS, _BYTES = 4096, 1 << 20


def _counts(values: Sequence[bytes | None]) -> Iterator[np.ndarray]:
    """How often each payload has each byte, 256 numbers a row; some payloads at once, a long one in pieces."""
    start = 0
    while start < len(values):
        end, size = start, 0
        while end < len(values) and end - start < _ROWS and (end == start or size + len(values[end] or b"") <= _BYTES):
            size += len(values[end] or b"")
            end += 1
        part = [v or b"" for v in values[start:end]]
        if end - start == 1:
            data = np.frombuffer(part[0], np.uint8)
            yield sum((np.bincount(data[k : k + _BYTES], minlength=256) for k in range(0, len(data), _BYTES)), np.zeros(256, np.int64))[None]
        else:
            row = np.repeat(np.arange(len(part)) * 256, [len(v) for v in part])
            yield np.bincount(row + np.frombuffer(b"".join(part), np.uint8), minlength=256 * len(part)).reshape(-1, 256)
        start = end


def entropies(values: Sequence[bytes | None]) -> np.ndarray:
    """Shannon entropy of each payload's bytes in bits; 0 for none."""
    out = [np.zeros(0)]
    for counts in _counts(values):
        n, places = counts.sum(axis=1), np.flatnonzero(counts)
        some = counts.ravel()[places].astype(float)
        total = np.maximum(n, 1).astype(float)
        out.append(np.maximum(np.log2(total) - np.bincount(places >> 8, some * np.log2(some), minlength=len(n)) / total, 0.0))
    return np.concatenate(out)


def entropy(data: Column) -> Column:
    """Shannon entropy of the bytes in bits; 0 for none and for null. Bytes are counted in Arrow batches, many payloads at
    once: a count of each byte as a built-in expression is hundreds of steps a payload."""

    @F.pandas_udf("double")
    def of(payloads: pd.Series) -> pd.Series:
        return pd.Series(entropies(payloads.tolist()))

    return of(data)


def ascii_payload(data: Column) -> Column:
    """Printable text, line ends and tabs; a dot for any other byte."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7e\r\n\t]", ".")


def domain(info: Column) -> Column:
    """The last word of a summary that has a dot within and doesn't begin with a digit, in lower case."""
    words = F.transform(F.split(F.trim(info), r"\s+"), lambda w: F.regexp_replace(w, r"\.+$", ""))
    named = F.filter(words, lambda w: w.contains(".") & ~w.rlike("^[0-9]"))
    return F.lower(F.get(named, F.size(named) - 1))


def apex(name: Column) -> Column:
    """The last two labels of a name."""
    return F.substring_index(name, ".", -2)


def authority(info: Column) -> Column:
    """The word after SNI=, Host: or Query, the first of these that is there."""
    after = lambda mark: F.nullif(F.regexp_replace(F.regexp_extract(info, mark + r"\s*(\S+)", 1), "^[,;]+|[,;]+$", ""), F.lit(""))
    return F.lower(F.coalesce(after("SNI="), after("Host: "), after("Query ")))


def flag_names(flags: Column) -> Column:
    """The names of TCP flags; NONE if none of these is set."""
    names = {0x02: "SYN", 0x10: "ACK", 0x01: "FIN", 0x04: "RST", 0x08: "PSH", 0x20: "URG"}
    text = F.array_join(F.array_compact(F.array(*(F.when(flags.bitwiseAND(bit) != 0, F.lit(n)) for bit, n in names.items()))), " ")
    return F.when(text == "", F.lit("NONE")).otherwise(text)


def mac(data: Column) -> Column:
    """Six bytes with colons."""
    return F.regexp_replace(F.lower(F.hex(data)), r"(..)(?!$)", "$1:")


def dotted(data: Column) -> Column:
    """Four bytes as an IPv4 address."""
    part = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10)
    return F.when(F.length(data) == 4, F.concat_ws(".", *(part(k) for k in (1, 2, 3, 4))))


def risk_label(score: Column) -> Column:
    """A score's step on the scale of risks."""
    return F.when(score >= 0.85, "CRITICAL").when(score >= 0.65, "HIGH").when(score >= 0.40, "MEDIUM").when(score >= 0.15, "LOW").otherwise("INFO")


#: Roles of services by port.
ROLES = {21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 143: "IMAP", 443: "HTTPS", 445: "SMB", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 6379: "Redis", 8080: "HTTP-Alt", 8443: "HTTPS-Alt"}


def service_role(port: Column, protocol: Column) -> Column:
    """The role of a service by its port, where the protocol says no more than TCP or UDP."""
    role = F.try_element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), port)
    return F.when(protocol.isin("TCP", "UDP"), role)


def xor_key(data: Column) -> Column:
    """(key, score) of the byte that makes most of the first 512 bytes printable by exclusive or; null for under 16
    bytes, for bytes of which over three quarters are printable as they are, and where no key makes over 70 %.

    A key's hits are those of the distinct bytes, which are counted first for many payloads at once: a product of the counts
    with the table of what each key makes printable. Of equal keys the largest counts.
    """

    @F.pandas_udf("key int, score double")
    def best(payloads: pd.Series) -> pd.DataFrame:
        keys, scores = [np.zeros(0, int)], [np.zeros(0)]
        for counts in _counts(payloads.tolist()):
            n = counts.sum(axis=1)
            hits = counts.astype(np.float32) @ _PRINTABLE  # at most 512, so exact
            top = 255 - hits[:, :0:-1].argmax(axis=1)
            score = hits[np.arange(len(n)), top].astype(float) / np.maximum(n, 1)
            found = (n >= 16) & (hits[:, 0] / np.maximum(n, 1) <= 0.75) & (score > 0.70)
            keys.append(np.where(found, top, 0))
            scores.append(score)
        key = pd.Series(np.concatenate(keys), dtype="Int32")
        return pd.DataFrame({"key": key.mask(key == 0), "score": np.concatenate(scores)})

    x = best(F.substring(data, 1, 512))
    return F.when(x.key.isNotNull(), x)


_KEYS = np.arange(256)
#: For each byte and key whether their exclusive or is printable; key 0 leaves a byte as it is.
_PRINTABLE = (((_KEYS[:, None] ^ _KEYS) >= 32) & ((_KEYS[:, None] ^ _KEYS) < 127)).astype(np.float32)
