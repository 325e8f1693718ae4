"""Event sweeps over overlapping ranges: what holds between two dates, without listing who is there.

Every range adds its share at its start and takes it away at its end. Running sums over the
dates of a group then give counts and set hashes of all segments between dates, with two
rows for each range, however many segments it spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.operators.skew import HotGroups, OrderedGroups

LOW, HIGH = float("-inf"), float("inf")
#: Nodes of the binary tree over positions that together make up a to b - 1, at most two a level.
_NODES = """filter(flatten(transform(sequence(0, cast(log2(b) AS int)), l -> array(
    if(shiftright(a + shiftleft(1L, l) - 1, l) < shiftright(b, l) AND shiftright(a + shiftleft(1L, l) - 1, l) % 2 = 1,
       struct(l, shiftright(a + shiftleft(1L, l) - 1, l) AS n), NULL),
    if(shiftright(a + shiftleft(1L, l) - 1, l) < shiftright(b, l) AND shiftright(b, l) % 2 = 1,
       struct(l, shiftright(b, l) - 1 AS n), NULL)))), x -> x IS NOT NULL)"""
#: Nodes above position i, in a tree over n positions.
_ABOVE = "transform(sequence(0, cast(log2(n) AS int)), l -> struct(l, shiftright(i, l) AS n))"


def signed_hash(*columns: Column) -> list[Column]:
    """Four 32-bit parts of a hash of a row; signed sums of them tell multisets apart."""
    text = F.concat_ws("|", *columns)
    hashes = [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
    return [part for h in hashes for part in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def events(ranges: DataFrame, columns: Sequence[str], start: str = "start_decdate", end: str = "end_decdate") -> DataFrame:
    """Two rows for each range: its ``columns``, the date ``at`` and a ``sign``. Open ends give no row, open starts a NULL date."""
    ends = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("sign")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("sign")))
    return ranges.select(*columns, F.inline(ends)).filter("sign = 1 OR at IS NOT NULL")


def toggles(marks: DataFrame, keys: Sequence[str], hot: HotGroups | None = None) -> DataFrame:
    """Dates at which a key comes to be held by any range (1), or by none any more (-1)."""
    sums = marks.groupBy(*keys, "at").agg(F.sum("sign").alias("_change"))
    running = OrderedGroups(sums, keys, [F.col("at").asc_nulls_first()], hot).running_sum("_change", "_held").frame()
    change = (F.col("_held") > 0).cast("int") - (F.col("_held") > F.col("_change")).cast("int")
    return running.select(*keys, "at", change.alias("sign")).filter("sign <> 0")


def presence(marks: DataFrame, keys: Sequence[str], hot: HotGroups | None = None) -> DataFrame:
    """Disjoint ranges during which a key is held by any range."""
    changes = OrderedGroups(toggles(marks, keys, hot), keys, [F.col("at").asc_nulls_first()], hot).lead("at", "end_decdate").frame()
    return changes.filter("sign = 1").select(*keys, F.col("at").alias("start_decdate"), "end_decdate")


def least_over(points: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least value of the ranges over each point, for points with any.

    Points have positions ``i`` of ``n`` in their group, ranges go from ``a`` to before ``b``. A range is
    cut into nodes of a binary tree, a point looks at the nodes above it: both are logarithmic in the group.
    """
    nodes = ranges.select(*keys, value, F.explode(F.expr(_NODES)).alias("_node"))
    nodes = nodes.groupBy(*keys, "_node").agg(F.min(value).alias(value))
    asked = points.select(*keys, "i", F.explode(F.expr(_ABOVE)).alias("_node"))
    best = asked.join(nodes, [*keys, "_node"]).groupBy(*keys, "i").agg(F.min(value).alias(value))
    return points.join(best, [*keys, "i"])


def first_at_any_time(ranges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For each group disjoint ranges with the least value of those that overlap there.

    ``keys`` hold no NULL. Ranges must not be empty.
    """
    bounds = {"_from": F.coalesce("start_decdate", F.lit(LOW)), "_to": F.coalesce("end_decdate", F.lit(HIGH))}
    ranges = ranges.withColumns(bounds)
    points = ranges.select(*keys, F.explode(F.array("_from", "_to")).alias("at")).distinct()
    group = Window.partitionBy(*keys)
    ordered = group.orderBy("at")
    points = points.withColumns(
        {"i": F.row_number().over(ordered).cast("long"), "_next": F.lead("at").over(ordered), "n": F.count(F.lit(1)).over(group)}
    )
    place = lambda date, name: points.select(*keys, F.col("at").alias(date), F.col("i").alias(name))
    placed = ranges.join(place("_from", "a"), [*keys, "_from"]).join(place("_to", "b"), [*keys, "_to"])
    known = lambda c: F.when(F.abs(c) < HIGH, F.col(c))
    return least_over(points, placed.select(*keys, "a", "b", value), keys, value).select(
        *keys, known("at").alias("start_decdate"), known("_next").alias("end_decdate"), value
    )
