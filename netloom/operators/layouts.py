"""Fields that users describe: layouts by port, interpretations of byte ranges, annotations, user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T

#: Where payloads are taken to begin: the headers of Ethernet, IPv4 and UDP.
PAYLOAD = 42


def _spaced(data: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(data)), "(..)(?!$)", "$1 ")


def _number(data: Column) -> Column:
    """The bytes as an unsigned number of any size: text, as it may be beyond 64 bits."""
    return F.when(F.length(data) == 0, "0").otherwise(F.conv(F.hex(data), 16, 10))


def shown(data: Column, display: Column) -> Column:
    """Bytes as dec (numbers of 1, 2 and 4 bytes, else each byte), ascii, or hex."""
    bytes_ = F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10))
    dec = F.when(F.length(data).isin(1, 2, 4), _number(data)).otherwise(F.array_join(bytes_, " "))
    ascii_ = F.regexp_replace(F.decode(data, "UTF-8"), "[^\\x20-\\x7e]", ".")
    return F.when(display == "dec", dec).when(display == "ascii", ascii_).otherwise(_spaced(data))


def laid_out(packets: DataFrame, layouts: DataFrame) -> DataFrame:
    """The fields of user layouts: layouts has name, transport (tcp, udp), port, field_offset, field_length,
    field_name, display. A layout applies to packets with its port at either end; a field beyond the payload says so."""
    known = layouts.where(F.lower("transport").isin("tcp", "udp")).select(F.col("name").alias("layout"), F.col("port").alias("_port"), "field_offset", "field_length", "field_name", "display")
    ports = F.array_distinct(F.array_compact(F.array("src_port", "dst_port")))
    rows = packets.select("no", F.expr(f"substring(bytes, {PAYLOAD + 1})").alias("_payload"), F.explode(ports).alias("_port"))
    met = rows.join(known, "_port")
    size = F.length("_payload")
    data = F.substring(F.col("_payload"), F.col("field_offset") + 1, F.col("field_length"))
    value = F.when(F.col("field_offset") + F.col("field_length") <= size, shown(data, F.col("display"))).otherwise(F.concat(F.lit("(out of range: payload "), size.cast("string"), F.lit(" bytes)")))
    return met.select("no", "layout", F.col("_port").alias("port"), "field_offset", "field_name", value.alias("value"))


def interpreted(data: Column, kind: Column) -> Column:
    """A byte range as uint, sint (which isn't sign-extended), bytes, string, ip, mac or flags."""
    hexed = F.lower(F.hex(data))
    number = _number(data)
    bits = F.lpad(F.conv(F.hex(data), 16, 2), (F.length(data) * 8).cast("int"), F.lit("0"))
    return (
        F.when(kind == "uint", F.concat(number, F.lit(" (0x"), hexed, F.lit(")")))
        .when(kind == "sint", number)
        .when(kind == "string", F.decode(data, "UTF-8"))
        .when((kind == "ip") & (F.length(data) == 4), T.dotted(data))
        .when((kind == "mac") & (F.length(data) == 6), T.mac(data))
        .when(kind == "flags", F.concat(F.lit("0b"), bits))
        .otherwise(_spaced(data))
    )


def annotated(packets: DataFrame, annotations: DataFrame) -> DataFrame:
    """P10: named byte ranges of packets: annotations has no, offset, length, name, kind. A range that goes beyond the
    packet has no row."""
    rows = annotations.select(F.col("no").alias("_no"), "offset", F.col("length").alias("size"), "name", "kind")
    met = packets.select("no", "bytes").join(rows, F.col("no") == F.col("_no")).where(F.col("offset") + F.col("size") <= F.length("bytes"))
    data = F.substring(F.col("bytes"), F.col("offset") + 1, F.col("size"))
    return met.select("no", "offset", F.col("size").alias("length"), "name", "kind", interpreted(data, F.col("kind")).alias("value"))


Dissector = Callable[[bytes, dict], list[tuple[str, str, int]]]


def dissected(packets: DataFrame, dissectors: dict[tuple[str, int], Dissector]) -> DataFrame:
    """What user functions say of packets by (transport, port): rows of label, value and indent.

    A function takes the payload and the packet's ends. Only packets with one of the ports reach Python, in Arrow
    batches; a function that fails says so in a row, so one bad packet doesn't end the job.
    """
    ports = sorted({port for _, port in dissectors})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ends = {"src": row.src, "dst": row.dst, "src_port": row.src_port, "dst_port": row.dst_port}
                for (transport, port), function in dissectors.items():
                    if transport == row.transport and port in (row.src_port, row.dst_port):
                        try:
                            said = function(bytes(row.payload), ends)
                        except Exception as e:  # the user's code, whatever it raises
                            said = [("error", f"{type(e).__name__}: {e}", 0)]
                        out += [(row.no, k, label, str(value), indent) for k, (label, value, indent) in enumerate(said)]
            yield pd.DataFrame(out, columns=["no", "place", "label", "value", "indent"])

    from netloom.operators.decode import _kept
    from netloom.operators.fields import _number as at
    from netloom.operators.fields import layout

    rows = _kept(layout(packets.where(F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports))))
    head = (F.shiftright(at(F.col("_l4") + 12, 1), 4) * 4).cast("int")
    rows = rows.withColumns({"transport": F.when(F.col("_proto") == 6, "tcp").when(F.col("_proto") == 17, "udp"), "_pay": F.when(F.col("_proto") == 6, F.col("_l4") + head).when(F.col("_proto") == 17, F.col("_l4") + 8)})
    rows = rows.where("transport is not null").select("no", "src", "dst", "src_port", "dst_port", "transport", F.substring(F.col("bytes"), F.col("_pay") + 1, F.length("bytes")).alias("payload"))
    return rows.mapInPandas(run, "no long, place int, label string, value string, indent int")


def helped(rows: DataFrame, helper: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """E5: rows through a user's function of batches, such as one that asks a service; none comes with this library."""
    return rows.mapInPandas(helper, schema)
