"""Measures over geometry values, as native expressions.

A geometry is ``struct<gtype, parts>``: part, ring, vertex. A line is a part
with one ring, a point a ring with one vertex, and the first ring of a polygon
part is its shell. Coordinates are EPSG:3857 metres.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType(
    [
        T.StructField("gtype", T.StringType()),
        T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))),
    ]
)
POINT, LINE, MULTI_LINE = "point", "linestring", "multilinestring"
POLYGON, MULTI_POLYGON = "polygon", "multipolygon"
LINES = [LINE, MULTI_LINE]
POLYGONS = [POLYGON, MULTI_POLYGON]
EARTH_RADIUS = 6378137.0


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def single(gtype: str, *rings: Column) -> Column:
    """Geometry with one part, from arrays of vertices."""
    return F.struct(F.lit(gtype).alias("gtype"), F.array(F.array(*rings)).alias("parts"))


def point(x: Column, y: Column) -> Column:
    return single(POINT, F.array(vertex(x, y)))


def line(vertices: Column) -> Column:
    return single(LINE, vertices)


def rectangle(xmin: Column, ymin: Column, width: Column, height: Column) -> Column:
    xmax, ymax = xmin + width, ymin + height
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return single(POLYGON, F.array(*[vertex(x, y) for x, y in corners]))


def _over_edges(ring: Column, term) -> Column:
    """Sum of ``term(from, to)`` over the edges of a ring."""
    last = F.size(ring) - 2
    steps = F.when(last >= 0, F.sequence(F.lit(0), last))
    total = F.aggregate(
        steps, F.lit(0.0), lambda acc, i: acc + term(F.get(ring, i), F.get(ring, i + 1))
    )
    return F.coalesce(total, F.lit(0.0))


def ring_area(ring: Column) -> Column:
    origin = F.get(ring, 0)

    def cross(a: Column, b: Column) -> Column:
        return (a["x"] - origin["x"]) * (b["y"] - origin["y"]) - (b["x"] - origin["x"]) * (
            a["y"] - origin["y"]
        )

    return F.abs(_over_edges(ring, cross)) / 2


def area(geometry: Column) -> Column:
    """Shells minus holes; 0 for anything that is not a polygon."""

    def part_area(part: Column) -> Column:
        holes = F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))
        return ring_area(F.get(part, 0)) - F.aggregate(
            holes, F.lit(0.0), lambda acc, ring: acc + ring_area(ring)
        )

    total = F.aggregate(
        geometry["parts"], F.lit(0.0), lambda acc, part: acc + part_area(part)
    )
    return F.when(geometry["gtype"].isin(POLYGONS), total).when(geometry.isNotNull(), F.lit(0.0))


def length(geometry: Column) -> Column:
    """Summed length of the lines; 0 for anything that is not a line."""

    def distance(a: Column, b: Column) -> Column:
        return F.hypot(b["x"] - a["x"], b["y"] - a["y"])

    total = F.aggregate(
        F.flatten(geometry["parts"]), F.lit(0.0), lambda acc, ring: acc + _over_edges(ring, distance)
    )
    return F.when(geometry["gtype"].isin(LINES), total).when(geometry.isNotNull(), F.lit(0.0))


def vertex_count(geometry: Column) -> Column:
    return F.size(F.flatten(F.flatten(geometry["parts"])))


def bounds(geometry: Column) -> dict[str, Column]:
    """Envelope columns."""
    vertices = F.flatten(F.flatten(geometry["parts"]))
    xs = F.transform(vertices, lambda v: v["x"])
    ys = F.transform(vertices, lambda v: v["y"])
    return {
        "xmin": F.array_min(xs),
        "ymin": F.array_min(ys),
        "xmax": F.array_max(xs),
        "ymax": F.array_max(ys),
    }


def meets_box(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Rows whose envelope columns meet a box; plain comparisons reach the scan."""
    return (
        (F.col("xmin") <= xmax)
        & (F.col("xmax") >= xmin)
        & (F.col("ymin") <= ymax)
        & (F.col("ymax") >= ymin)
    )


def to_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    x = F.radians(lon) * EARTH_RADIUS
    y = F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH_RADIUS
    return x, y


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres to EPSG:4326 degrees."""
    return F.degrees(x / EARTH_RADIUS), F.degrees(F.atan(F.sinh(y / EARTH_RADIUS)))


def grow_point_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, metres: float = 10.0):
    """Widen an envelope that is a single point by a distance on the ground."""
    is_point = (xmin == xmax) & (ymin == ymax)
    _, lat = to_degrees(xmin, ymin)
    reach = F.when(is_point, F.lit(metres) / F.cos(F.radians(lat))).otherwise(F.lit(0.0))
    return xmin - reach, ymin - reach, xmax + reach, ymax + reach


def broken_way(kind: Column, area_tag: Column, node_count: Column) -> Column:
    """Ways with too few nodes for their shape; 0 nodes means unknown."""
    is_area = F.coalesce(area_tag == "yes", F.lit(False))
    too_few = F.when(is_area, node_count < 4).otherwise(node_count < 2)
    return (kind == "way") & (node_count > 0) & too_few
