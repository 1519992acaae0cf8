"""Byte ranges of pieces that may overlap: cut at all borders, so that what covers a place is a plain grouping.

Places are cut into cells of a fixed width, then each cell at every border of a piece in it. An elementary interval is
covered by a piece whole or not at all, so pieces are compared, and the first or best of them chosen, by equality.
A piece of n bytes makes n intervals at the very most, so a flood of overlaps stays linear in its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.windows import with_first

#: Bytes of a cell; cells of a block, in which running values are one window's.
CELL, BLOCK = 256, 1 << 20


def on(left: list[str], prefix: str) -> list[Column]:
    """Equality of columns with their prefixed namesakes, null being a value."""
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in left]


def in_cells(pieces: DataFrame, cell: int = CELL) -> DataFrame:
    """pieces(start, end) by cell, with the part from lo to hi that lies in the cell."""
    cells = F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))
    spread = pieces.where("end > start").withColumn("_cell", F.explode(cells))
    return spread.withColumns({"lo": F.greatest(F.col("start"), F.col("_cell") * cell), "hi": F.least(F.col("end"), (F.col("_cell") + 1) * cell)})


def intervals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """parts, as in_cells gives them, by elementary interval: a row for each part and interval from lo to hi in it.

    A cell's borders are one list, of no more entries than the cell has bytes and one.
    """
    place = [*keys, "_cell"]
    borders = parts.groupBy(*(F.col(c).alias(f"_b_{c}") for c in place)).agg(F.array_sort(F.array_union(F.collect_set("lo"), F.collect_set("hi"))).alias("_borders"))
    steps = F.expr("filter(transform(sequence(1, size(_borders) - 1), i -> struct(_borders[i - 1] AS _lo, _borders[i] AS _hi)), x -> x._lo >= lo AND x._hi <= hi)")
    rest = [c for c in parts.columns if c not in ("lo", "hi")]
    return parts.join(borders, on(place, "_b_")).select(*rest, F.inline(steps)).withColumnsRenamed({"_lo": "lo", "_hi": "hi"})


def carried(rows: DataFrame, keys: list[str], place: str, sums: dict[str, Column], most: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """rows with sums, and largest values, of a key's rows from the first place up to the row's, itself included.

    A block of places is one window; what the blocks before it come to is one row for each key and block, so a long key is many tasks.
    """
    most = most or {}
    named = rows.withColumns({**{f"_s_{n}": c for n, c in sums.items()}, **{f"_m_{n}": c for n, c in most.items()}, "_block": F.floor(F.col(place) / block)})
    of_block = named.groupBy(*keys, "_block").agg(*(F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums), *(F.max(f"_m_{n}").alias(f"_m_{n}") for n in most))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = of_block.select(*keys, "_block", *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums), *(F.max(f"_m_{n}").over(earlier).alias(f"_u_{n}") for n in most))
    inside = Window.partitionBy(*keys, "_block").orderBy("_own", place).rowsBetween(Window.unboundedPreceding, 0)
    out = with_first(named, before)
    out = out.withColumns({**{n: F.max(f"_t_{n}").over(inside) + F.sum(f"_s_{n}").over(inside) for n in sums}, **{n: F.greatest(F.max(f"_u_{n}").over(inside), F.max(f"_m_{n}").over(inside)) for n in most}}).where("_own")
    return out.select(*rows.columns, *sums, *most)


def contradictions(pieces: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """(keys, order): the first piece of each key whose bytes differ from those an earlier piece has at the same place.

    pieces has start and data. Up to the first contradiction all pieces say the same of a place, so it is the
    first piece that differs from a place's first. Copies of a part are one row before anything is cut finer, and cells that
    hold one distinct part are passed over.
    """
    sized = pieces.select(*keys, order.alias("_order"), "start", (F.col("start") + F.length("data")).alias("end"), "data")
    cut = F.substring(F.col("data"), (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    parts = in_cells(sized).select(*keys, "_cell", "lo", "hi", "_order", cut.alias("_part"))
    once = parts.groupBy(*keys, "_cell", "lo", "hi", "_part").agg(F.min("_order").alias("_order"))
    place = [*keys, "_cell"]
    several = once.groupBy(*(F.col(c).alias(f"_n_{c}") for c in place)).count().where("count > 1")
    some = once.join(several, on(place, "_n_"), "left_semi").withColumn("_from", F.col("lo"))
    fine = intervals(some, keys)
    said = F.substring(F.col("_part"), (F.col("lo") - F.col("_from") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    versions = fine.groupBy(*place, "lo", said.alias("_said")).agg(F.min("_order").alias("_order"))
    nth = F.row_number().over(Window.partitionBy(*place, "lo").orderBy("_order"))
    return versions.withColumn("_nth", nth).where("_nth = 2").groupBy(*keys).agg(F.min("_order").alias("order"))
