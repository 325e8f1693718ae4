"""Layouts that let a filter skip files: boxes along a space-filling curve, validity in dyadic years.

Both are partition columns computed from the row, and a filter on them computed from
the question; the rest is Spark's partition pruning and the statistics of sorted files.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions.dates import valid_at
from terrachron.functions.geometry import meets_box
from terrachron.functions.tiles import HALF_WORLD

WORLD = 2 * HALF_WORLD
#: Bits of the curve along each axis.
BITS = 16
BOX_COLUMNS = ["_level", "_cell"]
YEAR_COLUMNS = ["_span", "_years"]


def hilbert(x: Column, y: Column) -> Column:
    """Place of a cell on the Hilbert curve over 2 ** BITS cells along each axis; its leading bits are those of coarser grids."""
    full = (1 << BITS) - 1

    def turn(state: Column, bit: Column) -> Column:
        side = F.pow(F.lit(2.0), F.lit(BITS - 1) - bit).cast("long")
        rx = (state["x"].bitwiseAND(side) > 0).cast("long")
        ry = (state["y"].bitwiseAND(side) > 0).cast("long")
        flip = (ry == 0) & (rx == 1)
        u = F.when(flip, F.lit(full) - state["x"]).otherwise(state["x"])
        v = F.when(flip, F.lit(full) - state["y"]).otherwise(state["y"])
        place = state["d"] + side * side * (rx * 3).bitwiseXOR(ry)
        return F.struct(F.when(ry == 0, v).otherwise(u).alias("x"), F.when(ry == 0, u).otherwise(v).alias("y"), place.alias("d"))

    begin = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), begin, turn)["d"]


def hilbert_number(x: int, y: int) -> int:
    """The same for plain numbers."""
    place, side = 0, 1 << (BITS - 1)
    while side:
        rx, ry = int(bool(x & side)), int(bool(y & side))
        place += side * side * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = (1 << BITS) - 1 - x, (1 << BITS) - 1 - y
            x, y = y, x
        side >>= 1
    return place


def box_place(levels: int) -> dict[str, Column]:
    """``_level`` by the size of the row's box (xmin, ymin, xmax, ymax), ``_cell`` of its centre at that level, and ``_curve``.

    At a level cells are at least as large as the boxes, so a box reaches half a cell beyond its own at most.
    Rows without a box have level -1.
    """
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1e-3))
    level = F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(F.log2(F.lit(WORLD) / size)))).cast("int")
    cells = 1 << BITS
    at = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(cells - 1.0), F.floor(((F.col(a) + F.col(b)) / 2 + HALF_WORLD) / WORLD * cells)))
    curve = hilbert(at("xmin", "xmax"), at("ymin", "ymax"))
    known = F.col("xmin").isNotNull() & F.col("ymin").isNotNull() & F.col("xmax").isNotNull() & F.col("ymax").isNotNull()
    return {
        "_curve": F.when(known, curve).otherwise(0),
        "_level": F.when(known, level).otherwise(-1),
        "_cell": F.when(known, F.expr("shiftright(_curve, 2 * ({} - _level))".format(BITS))).otherwise(0),
    }


def clustered(df: DataFrame, levels: int) -> DataFrame:
    """Rows with their ``_level`` and ``_cell``, dealt out and sorted along the curve; crowded cells take several tasks."""
    place = box_place(levels)
    rows = df.withColumn("_curve", place["_curve"]).withColumn("_level", place["_level"]).withColumn("_cell", place["_cell"])
    return rows.repartitionByRange("_level", "_curve").sortWithinPartitions("_level", "_curve").drop("_curve")


def meets_cells(levels: int, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Partitions that can hold a box that meets this one, as ranges along the curve."""
    found = []
    for level in range(levels + 1):
        size, most = WORLD / (1 << level), (1 << level) - 1
        cell = lambda v: min(most, max(0, math.floor((v + HALF_WORLD) / size)))  # noqa: E731, B023
        xs = range(cell(xmin - size / 2), cell(xmax + size / 2) + 1)
        ys = range(cell(ymin - size / 2), cell(ymax + size / 2) + 1)
        up, down = BITS - level, 2 * (BITS - level)
        numbers = sorted(hilbert_number(x << up, y << up) >> down for x in xs for y in ys)
        ranges: list[list[int]] = []
        for n in numbers:
            if ranges and n == ranges[-1][1] + 1:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])
        found += [(F.col("_level") == level) & F.col("_cell").between(a, b) for a, b in ranges]
    return reduce(lambda a, b: a | b, found)


def in_box(df: DataFrame, levels: int, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows of a clustered table whose box meets this one."""
    return df.filter(meets_cells(levels, xmin, ymin, xmax, ymax) & meets_box(xmin, ymin, xmax, ymax)).drop(*BOX_COLUMNS)


# ---- validity ----

#: Years are counted from here, so that all are positive; ranges shorter than a finest bucket share it.
EPOCH, FINEST, TOP = 1 << 19, 3, 20
OPEN_END, OPEN_START, ALWAYS = 100, 101, 102
#: Years of a bucket of ranges open on one side.
OPEN_BITS = 5


def _year(date: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << TOP) - 1), F.floor(date) + EPOCH)).cast("long")


def year_place(start: Column, end: Column) -> dict[str, Column]:
    """``_span`` and ``_years``: the smallest dyadic bucket of years that holds a validity range.

    Ranges open on one side go by the block of their other date.
    """
    low, high = _year(start), _year(end)
    differs = low.bitwiseXOR(high)
    level = F.greatest(F.lit(FINEST), F.when(differs == 0, 0).otherwise(F.floor(F.log2(differs)) + 1)).cast("int")
    span = F.when(start.isNull() & end.isNull(), ALWAYS).when(end.isNull(), OPEN_END).when(start.isNull(), OPEN_START).otherwise(level)
    block = F.lit(1 << OPEN_BITS)
    bucket = F.floor(low / F.pow(F.lit(2.0), level))
    years = F.when(start.isNull() & end.isNull(), 0).when(end.isNull(), F.floor(low / block)).when(start.isNull(), F.floor(high / block)).otherwise(bucket)
    return {"_span": span, "_years": years.cast("int")}


def write_timeline(df: DataFrame, path: str, start: str = "start_decdate", end: str = "end_decdate") -> None:
    """A table partitioned by the years in which rows are valid; crowded buckets take several tasks."""
    rows = df.withColumns(year_place(F.col(start), F.col(end)))
    rows.repartitionByRange(*YEAR_COLUMNS, start).sortWithinPartitions(*YEAR_COLUMNS, start).write.partitionBy(*YEAR_COLUMNS).parquet(path)


def as_of(df: DataFrame, moment: float, start: str = "start_decdate", end: str = "end_decdate") -> DataFrame:
    """Rows of such a table that are valid at a moment: one bucket of each level is read, and the open ranges on the right side."""
    year = min((1 << TOP) - 1, max(0, math.floor(moment) + EPOCH))
    span, years = F.col("_span"), F.col("_years")
    buckets = [(span == level) & (years == year >> level) for level in range(FINEST, TOP + 1)]
    buckets += [(span == OPEN_END) & (years <= year >> OPEN_BITS), (span == OPEN_START) & (years >= year >> OPEN_BITS), span == ALWAYS]
    found = df.filter(reduce(lambda a, b: a | b, buckets) & valid_at(F.col(start), F.col(end), moment))
    return found.drop(*YEAR_COLUMNS)
