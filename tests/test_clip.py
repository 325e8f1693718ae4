"""Clipping to tiles against vertex by vertex loops, and the quadtree descent against all tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.functions import geometry as geo, tiles
from terrachron.operators import clip, tiles as tile_ops


def chains(lists, kind):
    size = np.array([len(v) for v in lists], np.int64)
    x, y = (np.array([v[k] for r in lists for v in r], float) for k in (0, 1))
    return clip.Chains(x, y, size, np.arange(len(lists)), np.full(len(lists), kind), np.ones(len(lists), bool))


def lists_of(found, n):
    out, ends = [[] for _ in range(n)], np.cumsum(found.size)
    for owner, end, size in zip(found.owner.tolist(), ends.tolist(), found.size.tolist()):
        out[owner].append(list(zip(found.x[end - size : end].tolist(), found.y[end - size : end].tolist())))
    return out


def brute_ring(ring, box):
    """One ring, plane by plane, vertex by vertex."""
    points = ring[:-1]
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        left = []
        for k, cur in enumerate(points):
            prev = points[k - 1]
            inside = [(p[axis] - bound) * sign >= 0 for p in (prev, cur)]
            if inside[0] != inside[1]:
                t = (bound - prev[axis]) / (cur[axis] - prev[axis])
                other = prev[1 - axis] + t * (cur[1 - axis] - prev[1 - axis])
                left.append((bound, other) if axis == 0 else (other, bound))
            if inside[1]:
                left.append(cur)
        points = left
    return [[*points, points[0]]] if len(points) >= 3 else []


def brute_line(line, box):
    pieces = []
    for (x0, y0), (x1, y1) in zip(line, line[1:]):
        t0, t1, dx, dy = 0.0, 1.0, x1 - x0, y1 - y0
        meets = dx != 0 or dy != 0
        for p, q in ((-dx, x0 - box[0]), (dx, box[2] - x0), (-dy, y0 - box[1]), (dy, box[3] - y0)):
            if p == 0:
                meets &= q >= 0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if not meets or t0 >= t1:
            continue
        a, b = (x0 + t0 * dx, y0 + t0 * dy), (x1, y1) if t1 == 1 else (x0 + t1 * dx, y0 + t1 * dy)
        if pieces and t0 == 0 and pieces[-1][1] and pieces[-1][0][-1] == (x0, y0) and pieces[-1][2] == (x0, y0):
            pieces[-1] = ([*pieces[-1][0], b], t1 == 1, (x1, y1))
        else:
            pieces.append(([a, b], t1 == 1, (x1, y1)))
    return [p for p, _, _ in pieces]


def random_ring(draw, n, reach=20):
    points = [(draw.uniform(-reach, reach), draw.uniform(-reach, reach)) for _ in range(n)]
    return [*points, points[0]]


def test_rings_and_lines_vertex_by_vertex():
    draw = random.Random(1)
    boxes = np.array([[-5.0, -4.0, 6.0, 7.0]] * 300)
    rings = [random_ring(draw, draw.randrange(3, 12)) for _ in range(300)]
    rings[0] = [(-5, -4), (6, -4), (6, 7), (-5, 7), (-5, -4)]
    assert lists_of(clip.clip_rings(chains(rings, clip.AREA), boxes), 300) == [brute_ring(r, boxes[0]) for r in rings]
    lines = [random_ring(draw, draw.randrange(2, 12))[:-1] for _ in range(300)]
    lines[0], lines[1] = [(0, 0), (0, 0), (3, 3), (3, 9)], [(-9, 7), (9, 7)]
    assert lists_of(clip.clip_lines(chains(lines, clip.LINE), boxes), 300) == [brute_line(v, boxes[0]) for v in lines]
    empty = chains([], clip.AREA)
    assert not len(clip.clip(empty, boxes).x)


SCHEMA = f"id int, geometry {geo.GEOMETRY.simpleString()}"


def frame(spark, shapes):
    rows = [(i, (kind, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts])) for i, (kind, parts) in enumerate(shapes)]
    return spark.createDataFrame(rows, SCHEMA).withColumns(geo.bounds(F.col("geometry")))


def brute_tiles(shapes, zooms, extent, buffer):
    """Every shape on every tile that its envelope meets, clipped from the whole shape."""
    found = {}
    for i, (kind, parts) in enumerate(shapes):
        xs, ys = ([v[k] for part in parts for ring in part for v in ring] for k in (0, 1))
        for z in zooms:
            size = 2 * tiles.HALF_WORLD / 2**z
            cell = lambda v: min(2**z - 1, max(0, int((v + tiles.HALF_WORLD) / size)))  # noqa: E731, B023
            for x in range(cell(min(xs)), cell(max(xs)) + 1):
                for y in range(cell(-max(ys)), cell(-min(ys)) + 1):
                    left, top, room = x * size - tiles.HALF_WORLD, tiles.HALF_WORLD - y * size, size * buffer / extent
                    box = (left - room, top - size - room, left + size + room, top + room)
                    snap = lambda v: (int(np.floor((v[0] - left) / size * extent + 0.5)), int(np.floor((top - v[1]) / size * extent + 0.5)))  # noqa: E731, B023
                    grid = []
                    for part in parts:
                        rings = []
                        for k, ring in enumerate(part):
                            if kind == "point":
                                pieces = [ring] if box[0] <= ring[0][0] <= box[2] and box[1] <= ring[0][1] <= box[3] else []
                            else:
                                pieces = brute_ring(ring, box) if kind == "polygon" else brute_line(ring, box)
                            for piece in pieces:
                                flat = [snap(v) for v in piece]
                                flat = [v for n, v in enumerate(flat) if not n or v != flat[n - 1]]
                                area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(flat, flat[1:])))
                                if kind == "point" or (kind == "polygon" and area) or (kind == "linestring" and len(flat) > 1):
                                    rings.append(flat)
                            if kind == "polygon" and not k and not rings:
                                break
                        if rings:
                            grid += [rings] if kind == "polygon" else [[r] for r in rings]
                    if grid:
                        found[i, z, x, y] = grid
    return found


def shape_of(grid):
    """Corners as a set for each ring: where a ring begins depends on the way it was cut."""
    return [[frozenset(r) for r in part] for part in grid]


@pytest.mark.parametrize("levels", [2, 6])
def test_descent_against_all_tiles(spark, monkeypatch, levels):
    monkeypatch.setattr(clip, "LEVELS", levels)
    draw = random.Random(4)
    mm = 1_000_000
    shapes = [("polygon", [[[(-7 * mm, -6 * mm), (5 * mm, -6.5 * mm), (6 * mm, 7 * mm), (-6 * mm, 6 * mm), (-7 * mm, -6 * mm)], [(0, 0), (0, mm), (mm, mm), (mm, 0), (0, 0)]]])]
    shapes += [("linestring", [[[(draw.uniform(-9, 9) * mm, draw.uniform(-9, 9) * mm) for _ in range(6)]]]) for _ in range(8)]
    shapes += [("point", [[[(draw.uniform(-9, 9) * mm, draw.uniform(-9, 9) * mm)]]]) for _ in range(5)]
    for _ in range(6):
        cx, cy = draw.uniform(-9, 9) * mm, draw.uniform(-9, 9) * mm
        shapes.append(("polygon", [[[(cx, cy), (cx + 3e5, cy + 1e5), (cx + 1e5, cy + 4e5), (cx, cy)]]]))
    shapes.append(("polygon", [[[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]]))  # nothing on the grid until deep zooms
    zooms = [2, 5, 7]
    got = clip.clip_to_tiles(frame(spark, shapes), 9, zooms).collect()
    want = brute_tiles(shapes, zooms, 2048, 128)
    found = {(r.id, r.z, r.x, r.y): [[[(v.x, v.y) for v in ring] for ring in part] for part in r.grid] for r in got}
    assert len(found) == len(got) and set(found) == set(want)
    for key, grid in found.items():
        assert all(-128 <= c <= 2176 for part in grid for ring in part for v in ring for c in v)
        assert shape_of(grid) == shape_of(want[key]), key


def test_odd_rows(spark):
    shapes = [("polygon", []), ("linestring", [[[(0, 0)]]]), ("polygon", [[[(0, 0), (0, 0), (0, 0), (0, 0)]]])]
    rows = frame(spark, shapes).unionByName(frame(spark, [("point", [[[(5, 5)]]])]).withColumn("geometry", F.lit(None).cast(geo.GEOMETRY)))
    assert clip.clip_to_tiles(rows, None, [0, 3]).count() == 0


def test_country_at_a_deep_zoom(spark, monkeypatch):
    """Cells in flight follow the outline: an area of a quarter of a million tiles at zoom 14."""
    taken = []
    inner = clip.children
    monkeypatch.setattr(clip, "children", lambda cells, *a: taken.append(len(cells.row)) or inner(cells, *a))
    mm = 1_000_000
    ring = [(0.5 * mm, 5 * mm), (1.7 * mm, 5.1 * mm), (1.8 * mm, 6.3 * mm), (0.4 * mm, 6.2 * mm), (0.5 * mm, 5 * mm)]
    whole = clip.chains_of(__import__("pyarrow").array([{"gtype": "polygon", "parts": [[[{"x": x, "y": y} for x, y in ring]]]}]))
    size = 2 * tiles.HALF_WORLD / 2**14
    ranges = np.array([[int((f + tiles.HALF_WORLD) / size) for f in (0.4 * mm, 1.8 * mm, -6.3 * mm, -5 * mm)]])
    cells = clip.Cells(*[np.zeros(1, np.int64)] * 4, whole)
    boundary = {"n": 0, "filled": 0}
    for found, state in clip.descend(cells, ranges, [14], 15, 1 / 16):
        if state == clip.FILLED:
            boundary["filled"] += int((4.0 ** (14 - found.z)).sum())
        else:
            boundary["n"] += len(found.row)
    assert boundary["filled"] + boundary["n"] > 230_000 and boundary["n"] < 6_000
    assert max(taken) < 6_000 and sum(taken) < 15_000


def test_tiles_of_boxes_agree_with_the_plain_listing(spark):
    boxes = spark.range(40).select(
        F.col("id").cast("int").alias("id"),
        geo.rectangle(F.col("id") * 700_000.0 - 1.5e7, F.col("id") * 300_000.0 - 6e6, F.lit(900_000.0), F.lit(500_000.0)).alias("geometry"),
    )
    boxes = boxes.withColumns(geo.bounds(F.col("geometry")))
    listed = {tuple(r) for r in tile_ops.tiles_of_features(boxes, [3, 6]).select("id", "z", "x", "y").collect()}
    assert {tuple(r) for r in clip.clip_to_tiles(boxes, 9, [3, 6]).select("id", "z", "x", "y").collect()} == listed
