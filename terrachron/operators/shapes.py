"""Thinning and label points, per Arrow batch.

Spark partitions the rows; each task sees flat coordinate arrays of its batch
and returns the same rows with a new geometry column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from terrachron.functions.geometry import GEOMETRY


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices first[i] .. first[i] + count[i] - 1 of all ranges, and the range of each index."""
    owner = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return np.arange(len(owner)) - begin[owner] + first[owner], owner


def _kept_vertices(
    x: np.ndarray, y: np.ndarray, begin: np.ndarray, end: np.ndarray, tolerance: float, rounds: int | None = None
) -> np.ndarray:
    """Mask of the vertices that stay under distance-based thinning.

    ``begin`` and ``end`` bound the rings in the flat coordinates; all rings of a
    batch are halved together. With ``rounds`` every span is split that often
    whatever its distance.
    """
    keep = np.zeros(len(x), dtype=bool)
    full = end > begin
    keep[begin[full]] = True
    keep[end[full] - 1] = True
    first, last = begin[full], end[full] - 1
    while rounds is None or rounds > 0:
        inner = last - first > 1
        first, last = first[inner], last[inner]
        if not len(first):
            break
        at, span = _ranges(first + 1, last - first - 1)
        dx, dy = x[last] - x[first], y[last] - y[first]
        square = dx * dx + dy * dy
        safe = np.where(square == 0.0, 1.0, square)
        px, py = x[at] - x[first][span], y[at] - y[first][span]
        along = np.clip((px * dx[span] + py * dy[span]) / safe[span], 0.0, 1.0)
        distance = np.hypot(px - along * dx[span], py - along * dy[span])
        heads = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
        farthest = np.maximum.reduceat(distance, heads)
        # First vertex of each span that reaches its largest distance.
        reached = np.flatnonzero(distance == farthest[span])
        middle = at[reached[np.r_[True, span[reached][1:] != span[reached][:-1]]]]
        split = np.ones(len(first), dtype=bool) if rounds is not None else farthest > tolerance
        middle, first, last = middle[split], first[split], last[split]
        keep[middle] = True
        first, last = np.concatenate([first, middle]), np.concatenate([middle, last])
        if rounds is not None:
            rounds -= 1
    return keep


def _crossing(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges ``a`` to ``b`` of one owner that meet anywhere but in a shared vertex.

    Edges lie in a grid whose cells are as large as they are, a power of two, so an edge covers four cells
    at most, and looks for others at its own level and the coarser ones of its owner.
    """
    none = np.zeros(0, np.int64)
    if len(a) < 2:
        return none, none
    low_x, high_x = np.minimum(x[a], x[b]), np.maximum(x[a], x[b])
    low_y, high_y = np.minimum(y[a], y[b]), np.maximum(y[a], y[b])
    span = np.maximum(np.maximum(high_x - low_x, high_y - low_y), 1e-9)
    level = np.ceil(np.log2(span)).astype(np.int64)

    def cells(edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the cells of edges at levels, and the edge of each."""
        size = np.exp2(at)
        x0, y0 = np.floor(low_x[edge] / size).astype(np.int64), np.floor(low_y[edge] / size).astype(np.int64)
        wide, tall = (np.floor(h[edge] / size).astype(np.int64) - c + 1 for h, c in ((high_x, x0), (high_y, y0)))
        place, which = _ranges(np.zeros(len(edge), np.int64), wide * tall)
        keys = owner[edge][which].astype(np.uint64)
        for part in (at[which], x0[which] + place % wide[which], y0[which] + place // wide[which]):
            keys = (keys ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
        return keys, edge[which]

    keys, held = cells(np.arange(len(a)), level)
    order = np.argsort(keys, kind="stable")
    keys, held = keys[order], held[order]
    known = np.unique(np.stack([owner, level], axis=1), axis=0)
    # levels of each owner from an edge's own one on
    begin = np.searchsorted(known[:, 0], owner)
    count = np.searchsorted(known[:, 0], owner, side="right") - begin
    at, edge = _ranges(begin, count)
    coarser = known[at, 1] >= level[edge]
    asked, edge = cells(edge[coarser], known[at, 1][coarser])
    first = np.searchsorted(keys, asked)
    at, which = _ranges(first, np.searchsorted(keys, asked, side="right") - first)
    p, q = np.minimum(edge[which], held[at]), np.maximum(edge[which], held[at])
    apart = (p == q) | (owner[p] != owner[q])
    for u, v in ((a, a), (a, b), (b, a), (b, b)):
        apart |= (x[u[p]] == x[v[q]]) & (y[u[p]] == y[v[q]])
    apart |= (low_x[p] > high_x[q]) | (low_x[q] > high_x[p]) | (low_y[p] > high_y[q]) | (low_y[q] > high_y[p])
    p, q = p[~apart], q[~apart]

    def side(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.sign((x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i]))

    meets = (side(a[p], b[p], a[q]) * side(a[p], b[p], b[q]) <= 0) & (side(a[q], b[q], a[p]) * side(a[q], b[q], b[p]) <= 0)
    pairs = np.unique(np.stack([p[meets], q[meets]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _without_crossings(shapes: _Coordinates, keep: np.ndarray) -> None:
    """Put vertices back until no edge made by thinning crosses another edge of its geometry."""
    ring_of = np.repeat(np.arange(len(shapes.ring_part)), np.diff(shapes.vertex_at))
    row_of = shapes.part_row[shapes.ring_part]
    while True:
        at = np.flatnonzero(keep)
        inside = ring_of[at[:-1]] == ring_of[at[1:]] if len(at) else np.zeros(0, bool)
        a, b = at[:-1][inside], at[1:][inside]
        known = np.isfinite(shapes.x[a] + shapes.y[a] + shapes.x[b] + shapes.y[b])
        a, b = a[known], b[known]
        p, q = _crossing(shapes.x, shapes.y, a, b, row_of[ring_of[a]])
        edges = np.unique(np.r_[p, q])
        edges = edges[b[edges] - a[edges] > 1]
        if not len(edges):
            return
        keep |= _kept_vertices(shapes.x, shapes.y, a[edges], b[edges] + 1, 0.0, rounds=1)


class _Coordinates:
    """Flat view of one geometry column."""

    def __init__(self, column: pa.StructArray):
        self.kinds = column.field("gtype")
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)
        parts = column.field("parts")
        self.part_at = parts.offsets.to_numpy()
        rings = parts.values
        self.ring_at = rings.offsets.to_numpy()
        vertices = rings.values
        self.vertex_at = vertices.offsets.to_numpy()
        self.x = vertices.values.field("x").to_numpy(zero_copy_only=False)
        self.y = vertices.values.field("y").to_numpy(zero_copy_only=False)
        names = np.array(self.kinds.to_pylist(), dtype=object)
        self.is_area = np.array([k is not None and k.endswith("polygon") for k in names], dtype=bool)
        # Owner of each ring and part.
        self.ring_part = np.repeat(np.arange(len(self.ring_at) - 1), np.diff(self.ring_at))
        self.part_row = np.repeat(np.arange(len(self.part_at) - 1), np.diff(self.part_at))


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.int32())


def _geometry_array(kinds, valid, parts_per_row, rings_per_part, vertices_per_ring, x, y) -> pa.Array:
    """A geometry column from counts and flat coordinates."""
    vertices = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
    rings = pa.ListArray.from_arrays(_offsets(vertices_per_ring), vertices)
    parts = pa.ListArray.from_arrays(_offsets(rings_per_part), rings)
    column = pa.ListArray.from_arrays(_offsets(parts_per_row), parts)
    return pa.StructArray.from_arrays(
        [kinds, column], names=["gtype", "parts"], mask=pa.array(~valid, pa.bool_())
    )


def _count(owner: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(owner, minlength=size)


def _thinned(shapes: _Coordinates, tolerance: float, preserve: bool) -> pa.Array:
    begin, end = shapes.vertex_at[:-1].astype(np.int64), shapes.vertex_at[1:].astype(np.int64)
    closed = shapes.is_area[shapes.part_row[shapes.ring_part]]
    keep = _kept_vertices(shapes.x, shapes.y, begin, end, tolerance)
    ring_of = np.repeat(np.arange(len(begin)), end - begin)

    def kept_per_ring() -> np.ndarray:
        return np.bincount(ring_of, weights=keep, minlength=len(begin)).astype(np.int64)

    collapsed = closed & (kept_per_ring() < 4)
    ring_stays = np.ones(len(begin), dtype=bool)
    if preserve:
        # Keep the outline by its extreme vertices: two rounds of splits give four corners.
        keep |= _kept_vertices(shapes.x, shapes.y, begin[collapsed], end[collapsed], 0.0, rounds=2)
        _without_crossings(shapes, keep)
        part_stays = np.ones(len(shapes.part_row), dtype=bool)
    else:
        ring_stays = ~collapsed
        shell = shapes.ring_at[:-1]
        has_ring = np.diff(shapes.ring_at) > 0
        part_stays = np.zeros(len(shapes.part_row), dtype=bool)
        part_stays[has_ring] = ring_stays[shell[has_ring]]
        ring_stays &= part_stays[shapes.ring_part]
    keep &= ring_stays[ring_of]
    parts_per_row = _count(shapes.part_row[part_stays], len(shapes.valid))
    valid = shapes.valid & ((parts_per_row > 0) | (np.diff(shapes.part_at) == 0))
    return _geometry_array(
        shapes.kinds,
        valid,
        parts_per_row,
        _count(shapes.ring_part[ring_stays], len(part_stays))[part_stays],
        kept_per_ring()[ring_stays],
        shapes.x[keep],
        shapes.y[keep],
    )


def _with_geometry(df: DataFrame, column: str, work) -> DataFrame:
    """Replace a geometry column by ``work(coordinates)`` in every Arrow batch."""
    schema = T.StructType(
        [T.StructField(f.name, GEOMETRY if f.name == column else f.dataType) for f in df.schema]
    )

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            source = batch.column(at)
            replaced = work(_Coordinates(source)).cast(source.type)
            arrays = [replaced if i == at else a for i, a in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return df.mapInArrow(convert, schema)


def simplify(
    df: DataFrame, tolerance: float, column: str = "geometry", preserve: bool = True
) -> DataFrame:
    """Thin every geometry by a distance in metres.

    With ``preserve`` a polygon ring keeps at least four vertices, and where thinning would make
    edges of a geometry cross or touch, the vertices farthest off are put back. Without it a
    collapsed hole goes, and a polygon whose shells all collapse becomes NULL.
    """
    if tolerance <= 0:
        return df

    return _with_geometry(df, column, lambda shapes: _thinned(shapes, tolerance, preserve))


PAIRS = 4_000_000


class _Outlines:
    """Polygon parts of a batch with their edges in flat arrays."""

    def __init__(self, shapes: _Coordinates):
        areas = shapes.valid & shapes.is_area
        self.parts = np.flatnonzero(areas[shapes.part_row] & (np.diff(shapes.ring_at) > 0))
        self.rows = shapes.part_row[self.parts]
        rings, part = _ranges(shapes.ring_at[self.parts], np.diff(shapes.ring_at)[self.parts])
        begin, end = shapes.vertex_at[rings], shapes.vertex_at[rings + 1]
        at, ring = _ranges(begin, np.maximum(end - begin - 1, 0))
        self.ax, self.ay = shapes.x[at], shapes.y[at]
        self.bx, self.by = shapes.x[at + 1], shapes.y[at + 1]
        self.count = _count(part[ring], len(self.parts))
        self.first = np.cumsum(self.count) - self.count
        shell = shapes.ring_at[self.parts]
        at, owner = _ranges(shapes.vertex_at[shell], np.diff(shapes.vertex_at)[shell])
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
        x, y = shapes.x[at], shapes.y[at]
        self.left, self.bottom = np.minimum.reduceat(x, heads), np.minimum.reduceat(y, heads)
        self.width = np.maximum.reduceat(x, heads) - self.left
        self.height = np.maximum.reduceat(y, heads) - self.bottom
        self.start_x, self.start_y = x[heads], y[heads]

    def distance(self, part: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Signed distance of each point to the outline of its part; positive inside."""
        result = np.empty(len(part))
        begin = 0
        while begin < len(part):
            total = np.cumsum(self.count[part[begin:]])
            stop = begin + max(1, int(np.searchsorted(total, PAIRS)))
            result[begin:stop] = self._block(part[begin:stop], x[begin:stop], y[begin:stop])
            begin = stop
        return result

    def _block(self, part: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        edge, point = _ranges(self.first[part], self.count[part])
        heads = np.cumsum(self.count[part]) - self.count[part]
        ax, ay, bx, by = self.ax[edge], self.ay[edge], self.bx[edge], self.by[edge]
        dx, dy, px, py = bx - ax, by - ay, x[point], y[point]
        square = dx * dx + dy * dy
        along = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(square == 0, 1.0, square), 0.0, 1.0)
        distance = np.hypot(px - ax - along * dx, py - ay - along * dy)
        crosses = (ay > py) != (by > py)
        crosses &= px < ax + (py - ay) * dx / np.where(dy == 0, 1.0, dy)
        inside = np.add.reduceat(crosses.astype(np.int64), heads) % 2 == 1
        nearest = np.minimum.reduceat(distance, heads)
        return np.where(inside, nearest, -nearest)


def _best(part: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts that occur, and the position of the largest distance of each."""
    order = np.lexsort((-distance, part))
    heads = np.r_[True, part[order][1:] != part[order][:-1]]
    return part[order][heads], order[heads]


def _label_points(
    shapes: _Coordinates, precision: float | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre of the largest inscribed circle of each polygon, all of a batch together.

    Square cells cover each part; a cell is split into four while it can still
    hold a better point than the best so far.
    """
    outlines = _Outlines(shapes)
    size = len(outlines.parts)
    best_x, best_y = outlines.start_x.copy(), outlines.start_y.copy()
    best = np.zeros(size)
    flat = (outlines.width == 0) | (outlines.height == 0)
    accuracy = np.maximum(outlines.width, outlines.height) / 1000.0
    if precision:
        accuracy[:] = precision
    half = np.where(flat, 1.0, np.minimum(outlines.width, outlines.height) / 2)
    columns = np.where(flat, 0, np.ceil(outlines.width / (2 * half))).astype(np.int64)
    lines = np.where(flat, 0, np.ceil(outlines.height / (2 * half))).astype(np.int64)
    cell, part = _ranges(np.zeros(size, np.int64), columns * lines)
    columns = np.maximum(columns, 1)
    x = outlines.left[part] + half[part] * (1 + 2 * (cell % columns[part]))
    y = outlines.bottom[part] + half[part] * (1 + 2 * (cell // columns[part]))
    best[~flat] = -np.inf
    while len(part):
        distance = outlines.distance(part, x, y)
        found, at = _best(part, distance)
        better = distance[at] > best[found]
        found, at = found[better], at[better]
        best[found], best_x[found], best_y[found] = distance[at], x[at], y[at]
        reach = distance + half[part] * np.sqrt(2.0)
        open_cells = reach > best[part] + accuracy[part]
        # No circle is wider than the shorter side of the envelope.
        open_cells &= best[part] + accuracy[part] < np.minimum(outlines.width, outlines.height)[part] / 2
        part, x, y = part[open_cells], x[open_cells], y[open_cells]
        half = half / 2
        step = half[part]
        part = np.tile(part, 4)
        x = np.concatenate([x - step, x + step, x - step, x + step])
        y = np.concatenate([y - step, y - step, y + step, y + step])
    rows, at = _best(outlines.rows, best) if size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return rows, best_x[at], best_y[at]


def label_points(df: DataFrame, column: str = "geometry", precision: float | None = None) -> DataFrame:
    """Replace polygons by the centre of their largest inscribed circle.

    Of several parts the one with the largest circle counts. Other geometries
    are left as they are.
    """

    def work(shapes: _Coordinates) -> pa.Array:
        rows, x, y = _label_points(shapes, precision)
        is_label = np.zeros(len(shapes.valid), dtype=bool)
        is_label[rows] = True
        kinds = np.array(shapes.kinds.to_pylist(), dtype=object)
        kinds[is_label] = "point"
        # Labels count as one part with one ring and one vertex; the rest is copied.
        part_stays = ~is_label[shapes.part_row]
        ring_stays = part_stays[shapes.ring_part]
        ring_of = np.repeat(np.arange(len(shapes.ring_part)), np.diff(shapes.vertex_at))
        vertex_stays = ring_stays[ring_of]
        part_row = np.r_[shapes.part_row[part_stays], rows]
        rings = np.r_[np.diff(shapes.ring_at)[part_stays], np.ones(len(rows), np.int64)]
        ring_row = np.r_[shapes.part_row[shapes.ring_part[ring_stays]], rows]
        vertices = np.r_[np.diff(shapes.vertex_at)[ring_stays], np.ones(len(rows), np.int64)]
        vertex_row = np.r_[shapes.part_row[shapes.ring_part[ring_of[vertex_stays]]], rows]
        by_part, by_ring, by_vertex = (np.argsort(r, kind="stable") for r in (part_row, ring_row, vertex_row))
        return _geometry_array(
            pa.array(kinds, pa.string()),
            shapes.valid,
            _count(part_row, len(shapes.valid)),
            rings[by_part],
            vertices[by_ring],
            np.r_[shapes.x[vertex_stays], x][by_vertex],
            np.r_[shapes.y[vertex_stays], y][by_vertex],
        )

    return _with_geometry(df, column, work)
