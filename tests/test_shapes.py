import math
import random

import numpy as np
from pyspark.sql import functions as F, types as T

from terrachron.functions.geometry import GEOMETRY, area
from terrachron.operators.shapes import _kept_vertices, label_points, simplify

SCHEMA = T.StructType().add("id", T.IntegerType()).add("geometry", GEOMETRY)


def kept_by_hand(points, tolerance):
    """Textbook recursion over one line."""
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    square = (bx - ax) ** 2 + (by - ay) ** 2

    def distance(p):
        along = 0 if square == 0 else max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / square))
        return math.hypot(p[0] - ax - along * (bx - ax), p[1] - ay - along * (by - ay))

    far = max(range(1, len(points) - 1), key=lambda i: distance(points[i]))
    if distance(points[far]) <= tolerance:
        return [points[0], points[-1]]
    return kept_by_hand(points[: far + 1], tolerance)[:-1] + kept_by_hand(points[far:], tolerance)


def vertices(row):
    return [[[(v.x, v.y) for v in ring] for ring in part] for part in row.geometry.parts]


def test_simplify_matches_recursion(spark):
    random.seed(5)
    lines = [[(float(i), random.uniform(0, 5)) for i in range(random.randint(2, 40))] for _ in range(50)]
    df = spark.createDataFrame([(i, ("linestring", [[p]])) for i, p in enumerate(lines)], SCHEMA)
    for r in simplify(df, 1.5).collect():
        assert vertices(r)[0][0] == kept_by_hand(lines[r.id], 1.5)


def ring(n, radius, cx=0.0, cy=0.0):
    points = [(cx + radius * math.cos(2 * math.pi * i / n), cy + radius * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return points + points[:1]


def test_simplify_polygons(spark):
    shapes = [(1, ("polygon", [[ring(40, 100.0), ring(12, 3.0)]])), (2, ("multipolygon", [[ring(20, 2.0)], [ring(20, 500.0)]])), (3, None), (4, ("polygon", [[ring(30, 1.0)]]))]
    df = spark.createDataFrame(shapes, SCHEMA)
    kept = {r.id: r for r in simplify(df, 10.0).collect()}
    assert [len(p) for p in vertices(kept[1])] == [2] and len(vertices(kept[2])) == 2 and kept[3].geometry is None
    assert all(len(x) >= 4 and x[0] == x[-1] for i in (1, 2, 4) for p in vertices(kept[i]) for x in p)
    plain = {r.id: r for r in simplify(df, 10.0, preserve=False).collect()}
    assert [len(p) for p in vertices(plain[1])] == [1] and len(vertices(plain[2])) == 1 and plain[4].geometry is None
    source = {x for p in shapes[0][1][1] for rr in p for x in rr}
    assert {v for p in vertices(kept[1]) for rr in p for v in rr} <= source


def inside(point, rings):
    x, y = point
    hits = 0
    for points in rings:
        for (ax, ay), (bx, by) in zip(points, points[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                hits += 1
    return hits % 2 == 1


def test_label_points_lie_inside(spark):
    random.seed(7)
    shapes = []
    for i in range(60):
        # A star around a random centre, some with a hole in the middle.
        n, cx, cy = random.randint(5, 25), random.uniform(-1e6, 1e6), random.uniform(-1e6, 1e6)
        star = [(cx + random.uniform(20, 100) * math.cos(2 * math.pi * k / n), cy + random.uniform(20, 100) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        rings = [star + star[:1]] + ([ring(8, 10.0, cx, cy)] if i % 3 == 0 else [])
        shapes.append((i, ("polygon", [rings])))
    shapes.append((99, ("point", [[[(1.0, 2.0)]]])))
    df = spark.createDataFrame(shapes, SCHEMA)
    for r in label_points(df).collect():
        at = vertices(r)[0][0][0]
        assert r.geometry.gtype == "point"
        assert at == (1.0, 2.0) if r.id == 99 else inside(at, shapes[r.id][1][1][0])


def test_area_subtracts_holes(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    df = spark.createDataFrame([(1, ("polygon", [[square, hole]]))], SCHEMA)
    assert df.select(area(F.col("geometry")).alias("a")).first().a == 96.0


def brute_crossings(rings):
    """Pairs of edges of one geometry that meet, but in a shared vertex."""
    edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:])]
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1]))
    found = 0
    for k, (a, b) in enumerate(edges):
        for c, d in edges[:k]:
            if {a, b} & {c, d}:
                continue
            if any(max(a[i], b[i]) < min(c[i], d[i]) or max(c[i], d[i]) < min(a[i], b[i]) for i in (0, 1)):
                continue
            found += side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0
    return found


def winding_ring(draw, n):
    """A ring that does not cross itself: a star around the origin with deep narrow bays."""
    angles = sorted(draw.uniform(0, 2 * np.pi) for _ in range(n))
    points = [(float(r * np.cos(t)), float(r * np.sin(t))) for t in angles for r in [draw.choice([20, 100]) * draw.uniform(0.7, 1)]]
    return [*points, points[0]]


def band(draw, n, width=2.0):
    """A narrow band along a wave, its two banks sampled at places of their own."""
    bank = lambda dy: [(x, 30 * math.sin(x / 10) + dy) for x in sorted(draw.uniform(0, 200) for _ in range(n))]
    points = [*bank(width), *bank(0.0)[::-1]]
    return [*points, points[0]]


def test_thinning_makes_no_crossings(spark):
    draw = random.Random(8)
    shapes = []
    for _ in range(60):
        shell = winding_ring(draw, draw.randrange(30, 120))
        hole = [(0.1 * x, 0.1 * y) for x, y in winding_ring(draw, 40)]
        if not brute_crossings([shell, hole]):
            shapes.append([shell, hole])
        narrow = [band(draw, 60)]
        if not brute_crossings(narrow):
            shapes.append([*narrow, [(500.0, 500.0), (501.0, 500.0), (501.0, 501.0), (500.0, 500.0)]])
    assert len(shapes) > 60
    rows = [(i, ("polygon", [[[(x, y) for x, y in ring] for ring in rings]])) for i, rings in enumerate(shapes)]
    frame = spark.createDataFrame(rows, f"id int, geometry {GEOMETRY.simpleString()}")
    for tolerance in (5.0, 30.0):
        thin = {r.id: [[(v.x, v.y) for v in ring] for ring in r.geometry.parts[0]] for r in simplify(frame, tolerance).collect()}
        assert not any(map(brute_crossings, thin.values()))
        assert all(len(ring) >= 4 and ring[0] == ring[-1] for rings in thin.values() for ring in rings)
        assert sum(len(r) for rings in thin.values() for r in rings) < 0.9 * sum(len(r) for rings in shapes for r in rings)
        assert all(set(thin[i][k]) <= set(shapes[i][k]) for i in thin for k in (0, 1))
    # without it some do cross: the rule has work to do
    plain = [_kept_vertices(*map(np.array, zip(*rings[0])), np.array([0]), np.array([len(rings[0])]), 30.0) for rings in shapes]
    assert sum(map(brute_crossings, ([[p for p, k in zip(rings[0], kept) if k]] for rings, kept in zip(shapes, plain)))) > 0


def test_crossing_rings_stay_as_they_are(spark):
    """What crosses from the start neither loops for ever nor loses its vertices."""
    bow = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    rows = [(1, ("polygon", [[bow]])), (2, ("polygon", [[[(5.0, 5.0)] * 6]])), (3, ("linestring", [[[(0.0, 0.0), (4.0, 0.1), (8.0, 0.0)]]])), (4, None)]
    frame = spark.createDataFrame(rows, f"id int, geometry {GEOMETRY.simpleString()}")
    found = {r.id: r.geometry for r in simplify(frame, 1.0).collect()}
    assert [(v.x, v.y) for v in found[1].parts[0][0]] == bow and len(found[3].parts[0][0]) == 2 and found[4] is None
