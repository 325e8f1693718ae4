"""Geometries cut to map tiles by descent through the quadtree.

A feature starts at the deepest cell that holds its envelope. Level by level every cell is
halved both ways, and a child gets what remains of the geometry in its buffered box: lines by
Liang-Barsky, rings by Sutherland-Hodgman, for all geometries of a batch together. Boxes nest, so a
child never needs more than its parent carries. A cell that an area fills leaves
the descent at once; its tiles are listed without any geometry. What is in flight thus follows the
outlines of areas and not their tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from terrachron.functions import tiles
from terrachron.functions.geometry import GEOMETRY
from terrachron.operators.shapes import _Coordinates, _geometry_array, _ranges
from terrachron.operators.tiles import _ranges_of_features

#: Vertices cut at once, and levels descended before the rows are dealt out anew.
VERTICES, LEVELS = 2_000_000, 6
OPEN, DONE, FILLED = 0, 1, 2
POINT, LINE, AREA = 0, 1, 2
GRID = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))))


@dataclass
class Chains:
    """Rings, lines and points of many geometries in flat arrays. ``owner`` ascends; of an area's
    chains those with ``shell`` begin a part."""

    x: np.ndarray
    y: np.ndarray
    size: np.ndarray
    owner: np.ndarray
    kind: np.ndarray
    shell: np.ndarray

    def take(self, which: np.ndarray, owner: np.ndarray) -> Chains:
        at, _ = _ranges(np.cumsum(self.size)[which] - self.size[which], self.size[which])
        return Chains(self.x[at], self.y[at], self.size[which], owner, self.kind[which], self.shell[which])

    def of(self, rows: np.ndarray) -> Chains:
        """Chains of the given owners, which may repeat, numbered anew."""
        begin = np.searchsorted(self.owner, rows)
        at, new = _ranges(begin, np.searchsorted(self.owner, rows, side="right") - begin)
        return self.take(at, new)

    def joined(self, other: Chains) -> Chains:
        """Both, in the order of owners; an owner's chains keep theirs."""
        both = Chains(*[np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.__dataclass_fields__])
        order = np.argsort(both.owner, kind="stable")
        return both.take(order, both.owner[order])


def clip_rings(rings: Chains, box: np.ndarray) -> Chains:
    """Closed rings cut to a box each (xmin, ymin, xmax, ymax) by Sutherland-Hodgman; what is left closes again."""
    closing = np.cumsum(rings.size) - 1
    keep = np.ones(len(rings.x), bool)
    keep[closing[rings.size > 0]] = False  # the last vertex repeats the first
    x, y, size = rings.x[keep], rings.y[keep], np.maximum(rings.size - 1, 0)
    for along_x, side, sign in ((True, 0, 1), (True, 2, -1), (False, 1, 1), (False, 3, -1)):
        ring = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        before = np.arange(len(x)) - 1
        before[first[size > 0]] = (first + size - 1)[size > 0]
        bound = box[ring, side]
        value, other = (x, y) if along_x else (y, x)
        inside = (value - bound) * sign >= 0
        crosses = inside != inside[before]
        count = inside.astype(np.int64) + crosses
        place = np.cumsum(count) - count
        new_value, new_other = np.zeros(int(count.sum())), np.zeros(int(count.sum()))
        at = np.flatnonzero(crosses)
        share = (bound[at] - value[before[at]]) / (value[at] - value[before[at]])
        new_value[place[at]] = bound[at]
        new_other[place[at]] = other[before[at]] + share * (other[at] - other[before[at]])
        at = np.flatnonzero(inside)
        new_value[place[at] + crosses[at]], new_other[place[at] + crosses[at]] = value[at], other[at]
        size = np.bincount(ring, weights=count, minlength=len(size)).astype(np.int64)
        x, y = (new_value, new_other) if along_x else (new_other, new_value)
    left = np.flatnonzero(size >= 3)
    at, owner = _ranges((np.cumsum(size) - size)[left], size[left] + 1)
    last = np.cumsum(size[left] + 1) - 1
    at[last] = (np.cumsum(size) - size)[left]
    return Chains(x[at], y[at], size[left] + 1, rings.owner[left], rings.kind[left], rings.shell[left])


def clip_lines(lines: Chains, box: np.ndarray) -> Chains:
    """Lines cut to a box each by Liang-Barsky; a line may fall into several pieces."""
    chain = np.repeat(np.arange(len(lines.size)), lines.size)
    start = np.flatnonzero(chain[:-1] == chain[1:]) if len(chain) else np.zeros(0, np.int64)
    chain = chain[start]
    x, y = lines.x[start], lines.y[start]
    dx, dy = lines.x[start + 1] - x, lines.y[start + 1] - y
    enter, leave = np.zeros(len(start)), np.ones(len(start))
    meets = (dx != 0) | (dy != 0)
    for step, room in ((-dx, x - box[chain, 0]), (dx, box[chain, 2] - x), (-dy, y - box[chain, 1]), (dy, box[chain, 3] - y)):
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = room / step
        enter = np.where(step < 0, np.maximum(enter, reach), enter)
        leave = np.where(step > 0, np.minimum(leave, reach), leave)
        meets &= (step != 0) | (room >= 0)
    kept = np.flatnonzero(meets & (enter < leave))
    x, y, dx, dy, enter, leave, chain, start = (a[kept] for a in (x, y, dx, dy, enter, leave, chain, start))
    # a piece goes on where the segment before ended uncut and this one begins uncut
    goes_on = np.zeros(len(kept), bool)
    if len(kept):
        goes_on[1:] = (start[1:] == start[:-1] + 1) & (chain[1:] == chain[:-1]) & (leave[:-1] == 1) & (enter[1:] == 0)
    place = np.cumsum(2 - goes_on) - 1  # of each segment's end; a new piece has its start before it
    out_x, out_y = np.zeros(int(place[-1]) + 1 if len(place) else 0), np.zeros(int(place[-1]) + 1 if len(place) else 0)
    whole = leave == 1
    out_x[place] = np.where(whole, lines.x[start + 1], x + leave * dx)
    out_y[place] = np.where(whole, lines.y[start + 1], y + leave * dy)
    new = ~goes_on
    out_x[place[new] - 1], out_y[place[new] - 1] = (x + enter * dx)[new], (y + enter * dy)[new]
    first = place[new] - 1
    size = np.diff(np.r_[first, len(out_x)])
    return Chains(out_x, out_y, size, lines.owner[chain[new]], lines.kind[chain[new]], lines.shell[chain[new]])


def clip(shapes: Chains, box: np.ndarray) -> Chains:
    """All chains cut to the boxes of their owners. An area whose shell is gone loses the holes of that part too."""
    boxes = box[shapes.owner]
    area, line = shapes.kind == AREA, shapes.kind == LINE
    first = np.cumsum(shapes.size) - shapes.size
    points = np.flatnonzero((shapes.kind == POINT) & (shapes.size > 0))
    x, y = shapes.x[first[points]], shapes.y[first[points]]
    points = points[(x >= boxes[points, 0]) & (y >= boxes[points, 1]) & (x <= boxes[points, 2]) & (y <= boxes[points, 3])]
    numbered = lambda which: shapes.take(which, which)  # noqa: E731 - chains keep their number as owner for a while
    found = clip_rings(numbered(np.flatnonzero(area)), boxes[area])
    for other in (clip_lines(numbered(np.flatnonzero(line)), boxes[line]), numbered(points)):
        found = found.joined(other)
    part = np.cumsum(shapes.shell)
    there = np.isin(part[found.owner], part[found.owner[found.shell]]) | (found.kind != AREA)
    found = found.take(np.flatnonzero(there), found.owner[there])
    found.owner = shapes.owner[found.owner]
    return found


def ring_areas(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Area of each closed chain, about its first vertex."""
    if not len(size):
        return np.zeros(0)
    first = np.cumsum(size) - size
    chain = np.repeat(np.arange(len(size)), size)
    u, v = x - x[first][chain], y - y[first][chain]
    cross = np.zeros(len(x))
    cross[:-1] = np.where(chain[1:] == chain[:-1], u[:-1] * v[1:] - u[1:] * v[:-1], 0)
    return np.abs(np.add.reduceat(cross, first)) / 2


def on_grid(shapes: Chains, left: np.ndarray, top: np.ndarray, size: np.ndarray, extent: int) -> Chains:
    """Whole grid coordinates, y downwards, without repeated vertices; rings without area and lines
    of one vertex are gone, as is what is left of their part."""
    chain = np.repeat(np.arange(len(shapes.size)), shapes.size)
    own = shapes.owner[chain]
    x = np.floor((shapes.x - left[own]) / size[own] * extent + 0.5)
    y = np.floor((top[own] - shapes.y) / size[own] * extent + 0.5)
    fresh = np.ones(len(x), bool)
    fresh[1:] = (chain[1:] != chain[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y, count = x[fresh], y[fresh], np.bincount(chain[fresh], minlength=len(shapes.size))
    areas = ring_areas(x, y, count)
    stays = np.where(shapes.kind == AREA, (count >= 4) & (areas > 0), (shapes.kind == POINT) | (count >= 2))
    part = np.cumsum(shapes.shell)
    stays &= (shapes.kind != AREA) | np.isin(part, part[shapes.shell & stays])
    out = Chains(x, y, count, shapes.owner, shapes.kind, shapes.shell)
    return out.take(np.flatnonzero(stays), shapes.owner[stays])


def chains_of(column: pa.StructArray) -> Chains:
    """The geometries of an Arrow column; rows without one have no chains."""
    flat = _Coordinates(column)
    kinds = np.array([AREA if k and k.endswith("polygon") else LINE if k and k.endswith("linestring") else POINT for k in flat.kinds.to_pylist()])
    size = np.diff(flat.vertex_at).astype(np.int64)
    owner = flat.part_row[flat.ring_part]
    shell = np.zeros(len(size), bool)
    first = flat.ring_at[:-1][np.diff(flat.ring_at) > 0]
    shell[first - flat.ring_at[0]] = True
    kind = kinds[owner] if len(owner) else np.zeros(0, np.int64)
    stays = flat.valid[owner] & (size > 0) if len(owner) else np.zeros(0, bool)
    begin = int(flat.vertex_at[0]) if len(flat.vertex_at) else 0
    out = Chains(flat.x[begin:], flat.y[begin:], size, owner, kind, shell | (kind != AREA))
    return out.take(np.flatnonzero(stays), owner[stays])


def geometry_of(shapes: Chains, rows: int, kinds: pa.Array | None = None) -> pa.Array:
    """An Arrow column of ``rows`` geometries, or of grids where no kinds are given."""
    new_part = shapes.shell
    parts = np.bincount(shapes.owner[new_part], minlength=rows)
    rings = np.bincount(np.cumsum(new_part) - 1, minlength=int(new_part.sum())) if len(new_part) else np.zeros(0, np.int64)
    if kinds is None:
        plain = _geometry_array(pa.nulls(rows, pa.string()), np.ones(rows, bool), parts, rings, shapes.size, shapes.x.astype(np.int32), shapes.y.astype(np.int32))
        return plain.field("parts")
    return _geometry_array(kinds, np.ones(rows, bool), parts, rings, shapes.size, shapes.x, shapes.y)


@dataclass
class Cells:
    """Rows in descent: number of the source row, cell, and what of the geometry lies in its buffered box."""

    row: np.ndarray
    z: np.ndarray
    x: np.ndarray
    y: np.ndarray
    shapes: Chains

    def pick(self, which: np.ndarray) -> Cells:
        return Cells(self.row[which], self.z[which], self.x[which], self.y[which], self.shapes.of(which))


def edges(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 2 * tiles.HALF_WORLD / np.exp2(z)
    return x * size - tiles.HALF_WORLD, tiles.HALF_WORLD - y * size, size


def buffered(cells: Cells, share: float) -> np.ndarray:
    left, top, size = edges(cells.z, cells.x, cells.y)
    room = size * share
    return np.stack([left - room, top - size - room, left + size + room, top + room], axis=1)


def filled(cells: Cells, box: np.ndarray) -> np.ndarray:
    """Cells whose buffered box is one ring of an area without holes."""
    count = np.bincount(cells.shapes.owner, minlength=len(cells.row))
    area = np.bincount(cells.shapes.owner, weights=ring_areas(cells.shapes.x, cells.shapes.y, cells.shapes.size), minlength=len(cells.row))
    areal = np.bincount(cells.shapes.owner, weights=cells.shapes.kind == AREA, minlength=len(cells.row)) == 1
    return areal & (count == 1) & (area >= (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]) * (1 - 1e-12))


def children(cells: Cells, ranges: np.ndarray, deepest: int, share: float) -> Cells:
    """The four cells below each that its row's range meets, with what remains there."""
    times = np.repeat(np.arange(len(cells.row)), 4)
    z = cells.z[times] + 1
    x, y = cells.x[times] * 2 + np.tile([0, 1, 0, 1], len(cells.row)), cells.y[times] * 2 + np.tile([0, 0, 1, 1], len(cells.row))
    x0, x1, y0, y1 = (ranges[cells.row[times], k] >> (deepest - z) for k in range(4))
    meets = np.flatnonzero((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1))
    below = Cells(cells.row[times[meets]], z[meets], x[meets], y[meets], cells.shapes.of(times[meets]))
    below.shapes = clip(below.shapes, buffered(below, share))
    return below.pick(np.unique(below.shapes.owner))


def descend(cells: Cells, ranges: np.ndarray, zooms: Sequence[int], stop: int, share: float) -> Iterator[tuple[Cells, int]]:
    """Cells at the wanted zooms (done), cells that are filled, and, at ``stop``, those that go on."""
    deepest, wanted = max(zooms), np.array(sorted(zooms))
    stack = [cells]
    while stack:
        cells = stack.pop()
        if len(cells.shapes.x) > VERTICES and len(cells.row) > 1:
            half = len(cells.row) // 2
            stack += [cells.pick(np.arange(half, len(cells.row))), cells.pick(np.arange(half))]
            continue
        full = filled(cells, buffered(cells, share))
        if full.any():
            yield cells.pick(np.flatnonzero(full)), FILLED
            cells = cells.pick(np.flatnonzero(~full))
        at = np.flatnonzero(np.isin(cells.z, wanted))
        if len(at):
            yield cells.pick(at), DONE
        cells = cells.pick(np.flatnonzero(cells.z < deepest))
        if not len(cells.row):
            continue
        late = cells.z >= stop
        if late.any():
            yield cells.pick(np.flatnonzero(late)), OPEN
            cells = cells.pick(np.flatnonzero(~late))
        if len(cells.row):
            stack.append(children(cells, ranges, deepest, share))


def clip_to_tiles(df: DataFrame, max_zoom: int | None, zooms: Sequence[int], column: str = "geometry") -> DataFrame:
    """Features on the tiles that their envelope meets, cut to the buffered tile: z, x, y, extent, buffer and ``grid``.

    ``grid`` replaces the geometry: parts, rings and whole-numbered vertices, y downwards. What leaves nothing on
    a tile's grid has no row there. ``df`` has xmin, ymin, xmax, ymax; rows without them have none.
    """
    extent = 1024 if max_zoom is not None and max_zoom <= 5 else 2048 if max_zoom is not None and max_zoom <= 9 else 4096
    margin, deepest = extent // 16, max(zooms)
    share = margin / extent
    ranged = _ranges_of_features(df, [deepest]).drop("z")
    # where the descent starts: the deepest cell that holds the whole range
    wide = F.greatest(F.col("_x0").bitwiseXOR(F.col("_x1")), F.col("_y0").bitwiseXOR(F.col("_y1")))
    up = F.when(wide == 0, 0).otherwise(F.floor(F.log2(wide)) + 1).cast("int")
    state = ranged.withColumn("_up", up).withColumns(
        {
            "z": F.lit(deepest) - F.col("_up"),
            "x": F.expr("shiftright(_x0, _up)"),
            "y": F.expr("shiftright(_y0, _up)"),
            "_state": F.lit(OPEN),
            "_begun": F.lit(False),
            "grid": F.lit(None).cast(GRID),
        }
    ).drop("_up")
    schema = T.StructType([T.StructField(f.name, GEOMETRY if f.name == column else f.dataType) for f in state.schema])
    lowest = sorted(zooms)

    def work(stop: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
                open_ = get("_state").to_numpy() == OPEN
                if not open_.all():
                    settled = batch.filter(pa.array(~open_))
                    yield pa.RecordBatch.from_arrays(settled.columns, names=batch.schema.names)
                    batch = batch.filter(pa.array(open_))
                if not batch.num_rows:
                    continue
                ranges = np.stack([get(c).to_numpy() for c in ("_x0", "_x1", "_y0", "_y1")], axis=1).astype(np.int64)
                z, x, y = (get(c).to_numpy().astype(np.int64) for c in ("z", "x", "y"))
                shapes = chains_of(get(column))
                rows = np.unique(shapes.owner)
                cells = Cells(rows, z[rows], x[rows], y[rows], shapes.of(rows))
                begun = get("_begun").to_numpy(zero_copy_only=False)
                # tiles above the first cell hold the feature alone
                for zoom in lowest:
                    above = np.flatnonzero((cells.z > zoom) & ~begun[cells.row])
                    if len(above):
                        whole = cells.pick(above)
                        shift = whole.z - zoom
                        over = Cells(whole.row, np.full(len(above), zoom), whole.x >> shift, whole.y >> shift, whole.shapes)
                        over.shapes = clip(over.shapes, buffered(over, share))  # it may reach over the edge of the world
                        yield from answer(batch, over, DONE)
                # what begins at a cell is cut to it once; what comes from an earlier round is so already
                cells.shapes = clip(cells.shapes, buffered(cells, share))
                cells = cells.pick(np.unique(cells.shapes.owner))
                fresh = ~begun[cells.row] | ~np.isin(cells.z, lowest)
                if not fresh.all():  # was answered in the round before: only its children are due
                    again = children(cells.pick(np.flatnonzero(~fresh)), ranges, deepest, share)
                    for found, state_ in descend(again, ranges, lowest, stop, share):
                        yield from answer(batch, found, state_)
                for found, state_ in descend(cells.pick(np.flatnonzero(fresh)), ranges, lowest, stop, share):
                    yield from answer(batch, found, state_)

        def answer(batch: pa.RecordBatch, cells: Cells, state_: int) -> Iterator[pa.RecordBatch]:
            grids = None
            if state_ == DONE:
                flat = on_grid(cells.shapes, *edges(cells.z, cells.x, cells.y), extent)
                left = np.unique(flat.owner)
                cells = Cells(cells.row[left], cells.z[left], cells.x[left], cells.y[left], cells.shapes)
                grids = geometry_of(Chains(flat.x, flat.y, flat.size, np.searchsorted(left, flat.owner), flat.kind, flat.shell), len(left))
            if not len(cells.row):
                return
            taken = batch.take(pa.array(cells.row))
            columns = []
            for name, old in zip(batch.schema.names, taken.columns):
                if name in "zxy":
                    columns.append(pa.array(getattr(cells, name), pa.int32()))
                elif name == "_state":
                    columns.append(pa.array(np.full(len(cells.row), state_), pa.int32()))
                elif name == "_begun":
                    columns.append(pa.array(np.ones(len(cells.row), bool)))
                elif name == column:
                    columns.append(geometry_of(cells.shapes, len(cells.row), old.field("gtype")).cast(old.type) if state_ == OPEN else pa.nulls(len(cells.row), old.type))
                elif name == "grid":
                    columns.append(grids.cast(old.type) if grids is not None else pa.nulls(len(cells.row), old.type))
                else:
                    columns.append(old)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return run

    stops = [*range(LEVELS, deepest, LEVELS), deepest + 1]
    for k, stop in enumerate(stops):
        if k:  # outlines of large areas are many cells by now: deal them out
            state = state.repartition("z", "x", "y")
        state = state.mapInArrow(work(stop), schema)
    # cells that are filled: their tiles at all wanted zooms, by numbers alone
    square = [(-margin, -margin), (extent + margin, -margin), (extent + margin, extent + margin), (-margin, extent + margin), (-margin, -margin)]
    box = F.array(F.array(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in square])))
    full = state.filter(F.col("_state") == FILLED).withColumn("_zoom", F.explode(F.array(*[F.lit(z) for z in lowest])))
    full = full.filter("_zoom >= z").withColumn("_down", F.expr(f"{deepest} - _zoom"))
    for axis in "xy":
        low = F.expr(f"greatest(shiftleft({axis}, _zoom - z), shiftright(_{axis}0, _down))")
        high = F.expr(f"least(shiftleft({axis} + 1, _zoom - z) - 1, shiftright(_{axis}1, _down))")
        full = full.withColumns({f"_{axis}a": low, f"_{axis}b": high}).filter(f"_{axis}a <= _{axis}b")
    for axis in "xy":
        full = full.withColumn(f"_{axis}", F.explode(F.sequence(f"_{axis}a", f"_{axis}b")))
    names = [c for c in df.columns if c != column]
    full = full.select(*names, F.col("_zoom").alias("z"), F.col("_x").alias("x"), F.col("_y").alias("y"), box.cast(GRID).alias("grid"))
    cut = state.filter(F.col("_state") == DONE).select(*names, "z", "x", "y", "grid")
    return cut.unionByName(full).withColumns({"extent": F.lit(extent), "buffer": F.lit(margin)})
