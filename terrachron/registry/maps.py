"""Geometry measures, tiles and expiry (G), tile lists (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrachron.functions import geometry as geo, text, tiles
from terrachron.operators import clip, shapes, tiles as ops
from terrachron.plans.serving import serving_bands
from terrachron.registry.base import query
from terrachron.session import work_path
from terrachron.sources.files import parse_state, read_tile_list

C = F.col
HALF = "20037508.342789244"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def sql_clamp(fraction: str, z: str) -> str:
    return (
        f"CAST(CASE WHEN {fraction} <= 0 THEN 0 WHEN {fraction} >= 1 THEN (1 << {z}) - 1 "
        f"ELSE floor(({fraction} + 1e-14) * (1 << {z})) END AS INTEGER)"
    )


def sql_tx(lon: str, z: str) -> str:
    return sql_clamp(f"({lon} / 360.0 + 0.5)", z)


def sql_ty(lat: str, z: str) -> str:
    s = f"sin(radians({lat}))"
    return sql_clamp(f"(0.5 - ln((1 + {s}) / (1 - {s})) * 0.25 / 3.141592653589793)", z)


def sql_mx(x: str, z: str) -> str:
    return sql_clamp(f"(({x} + {HALF}) / (2 * {HALF}))", z)


def sql_my(y: str, z: str) -> str:
    return sql_clamp(f"(({HALF} - {y}) / (2 * {HALF}))", z)


@query("feature_area", "rects", "SELECT id, round(w * h, 6) AS area FROM rects")
def _(t):
    return t.rects().select("id", F.round(geo.area(C("geometry")), 6).alias("area"))


@query("feature_length", "polylines", "SELECT id, osm_id, round(length, 6) AS length FROM polylines")
def _(t):
    return t.polylines().select("id", "osm_id", F.round(geo.length(C("geometry")), 6).alias("length"))


@query(
    "feature_bbox",
    "polylines",
    "SELECT id, osm_id, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM polylines",
)
def _(t):
    box = {k: F.round(v, 6) for k, v in geo.bounds(C("geometry")).items()}
    return t.polylines().withColumns(box).select("id", "osm_id", *box)


_THIN = 50.0
# A line is split at its farthest vertex as long as that is beyond the tolerance, so it keeps one
# vertex for each split besides its ends. The rectangles are all thinner than the
# tolerance; they keep their corners.
_POINT = "{{'x': x0 + {i} * q, 'y': y0 + ({i} * {i}) % 7 * q}}"
_SIMPLIFIED = f"""WITH RECURSIVE spans AS (
      SELECT l_orderkey AS id, row_number() OVER () AS ln, l_partkey AS osm_id, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS x0, CAST(l_partkey AS DOUBLE) AS y0,
        CAST(0 AS BIGINT) AS a, CAST(l_linenumber + 1 AS BIGINT) AS b FROM lineitem
      UNION ALL SELECT id, ln, osm_id, q, x0, y0, unnest([a, m]) AS a, unnest([m, b]) AS b FROM (
        SELECT *, a + list_position(far, list_max(far)) AS m FROM (
          SELECT *, list_transform(range(a + 1, b), lambda i: list_transform([{{'px': {_POINT.format(i='i')}.x - pa.x, 'py': {_POINT.format(i='i')}.y - pa.y}}], lambda p:
              list_transform([greatest(0, least(1, (p.px * dx + p.py * dy) / CASE WHEN dx * dx + dy * dy = 0 THEN 1 ELSE dx * dx + dy * dy END))], lambda w:
                sqrt((p.px - w * dx) * (p.px - w * dx) + (p.py - w * dy) * (p.py - w * dy)))[1])[1]) AS far FROM (
            SELECT *, pb.x - pa.x AS dx, pb.y - pa.y AS dy FROM (SELECT *, {_POINT.format(i='a')} AS pa, {_POINT.format(i='b')} AS pb FROM spans WHERE b - a > 1)))
        WHERE list_max(far) > {_THIN}))
    SELECT id, osm_id, CAST(2 + (count(*) - 1) // 2 AS INTEGER) AS vertices, CAST(0 AS DOUBLE) AS area FROM spans GROUP BY id, ln, osm_id
    UNION ALL SELECT c_custkey, c_custkey, 5, round((abs(c_acctbal) / 100 + 1) * 5, 4) FROM customer"""


@query("simplify_job", "", _SIMPLIFIED)
def _(t):
    lines = t.polylines().select("id", "osm_id", "geometry")
    areas = t.rects().select("id", "osm_id", "geometry")
    both = shapes.simplify(lines.unionByName(areas), _THIN)
    area = F.round(geo.area(C("geometry")), 4).alias("area")
    return both.select("id", "osm_id", geo.vertex_count(C("geometry")).alias("vertices"), area)


def clearance():
    """Distance from a label to the outline of its rectangle."""
    at, box = C("geometry.parts")[0][0][0], geo.bounds(C("outline"))
    return F.least(at["x"] - box["xmin"], box["xmax"] - at["x"], at["y"] - box["ymin"], box["ymax"] - at["y"])


@query("label_point_job", "rects", "SELECT id, 'point' AS gtype, TRUE AS is_centre FROM rects")
def _(t):
    rows = t.rects().select("id", "geometry", C("geometry").alias("outline"))
    box = geo.bounds(C("outline"))
    width, height = box["xmax"] - box["xmin"], box["ymax"] - box["ymin"]
    best = F.least(width, height) / 2 - F.greatest(width, height) / 1000
    return shapes.label_points(rows).select("id", "geometry.gtype", (clearance() >= best).alias("is_centre"))


# The label point lies on the long middle line, at the best distance from the outline: half the shorter side.
@query("batch_udfs", "rects", "SELECT id, name, round(least(w, h) / 2, 0) AS clearance FROM rects")
def _(t):
    thin = shapes.simplify(t.rects().select("id", "name", "geometry"), 0.5)
    placed_ = shapes.label_points(thin.withColumn("outline", C("geometry")))
    return placed_.select("id", "name", F.round(clearance(), 0).alias("clearance"))


@query(
    "project_coords",
    "features",
    """SELECT id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(degrees(x / 6378137.0), 6) + 0.0 AS lon, round(degrees(atan(sinh(y / 6378137.0))), 6) + 0.0 AS lat FROM features""",
)
def _(t):
    x, y = geo.to_metres(C("lon"), C("lat"))
    back = geo.to_degrees(C("x"), C("y"))
    return t.features().select(
        "id",
        # Adding zero turns a negative zero into a plain one.
        (F.round(x, 4) + 0.0).alias("x"),
        (F.round(y, 4) + 0.0).alias("y"),
        (F.round(back[0], 6) + 0.0).alias("lon"),
        (F.round(back[1], 6) + 0.0).alias("lat"),
    )


_BOXES = """boxes AS (SELECT id, lon AS min_lon, lat AS min_lat, CASE WHEN lon + k / CAST(40 AS DOUBLE) > 180 THEN lon + k / CAST(40 AS DOUBLE) - 360 ELSE lon + k / CAST(40 AS DOUBLE) END AS max_lon,
   lat + k / CAST(80 AS DOUBLE) AS max_lat FROM features)"""


def boxes(t):
    reach = C("lon") + C("k") / 40.0
    return t.features().select(
        "id",
        C("lon").alias("min_lon"),
        C("lat").alias("min_lat"),
        F.when(reach > 180, reach - 360).otherwise(reach).alias("max_lon"),
        (C("lat") + C("k") / 80.0).alias("max_lat"),
    )


_ZOOMS = [0, 4, 8]
_TILES_IN_BOX = f"""{_BOXES}, halves AS (SELECT id, CASE WHEN min_lon > max_lon THEN -180 ELSE min_lon END AS w, max_lon AS e, min_lat, max_lat FROM boxes
      UNION ALL SELECT id, min_lon, 180, min_lat, max_lat FROM boxes WHERE min_lon > max_lon),
    c AS (SELECT id, greatest(-180.0, w) AS w, least(180.0, e) AS e, greatest(-85.051129, min_lat) AS s, least(85.051129, max_lat) AS n, unnest({_ZOOMS}) AS z FROM halves),
    rg AS (SELECT id, z, {sql_tx('w', 'z')} AS x0, {sql_tx('(e - 1e-11)', 'z')} AS x1, {sql_ty('n', 'z')} AS y0, {sql_ty('(s + 1e-11)', 'z')} AS y1 FROM c),
    xs AS (SELECT *, unnest(generate_series(x0, x1)) AS x FROM rg WHERE x0 <= x1 AND y0 <= y1)"""


@query(
    "tiles_in_bbox",
    "features",
    f"WITH {_TILES_IN_BOX} SELECT id, z, CAST(x AS INTEGER) AS x, CAST(unnest(generate_series(y0, y1)) AS INTEGER) AS y FROM xs",
)
def _(t):
    return ops.tiles_of_box(boxes(t), _ZOOMS).select("id", "z", "x", "y")


@query(
    "tile_of_point",
    "features",
    f"SELECT id, 16 AS z, {sql_tx('lon', '16')} AS x, {sql_ty('lat', '16')} AS y FROM features",
)
def _(t):
    z = F.lit(16)
    return t.features().select(
        "id", z.alias("z"), tiles.tile_x(C("lon"), z).alias("x"), tiles.tile_y(C("lat"), z).alias("y")
    )


@query(
    "tile_envelope",
    "features",
    f"""WITH p AS (SELECT id, CAST(id % 17 + 4 AS INTEGER) AS z, lon, lat FROM features), q AS (SELECT id, z, {sql_tx('lon', 'z')} AS x, {sql_ty('lat', 'z')} AS y, 2 * {HALF} / pow(2.0, z) AS size FROM p)
        SELECT id, z, round(x * size - {HALF}, 4) + 0.0 AS xmin, round({HALF} - y * size - size, 4) + 0.0 AS ymin, round(x * size - {HALF} + size, 4) + 0.0 AS xmax, round({HALF} - y * size, 4) + 0.0 AS ymax FROM q""",
)
def _(t):
    z = (C("id") % 17 + 4).cast("int")
    rows = t.features().select("id", z.alias("z"), "lon", "lat")
    box = tiles.tile_bounds(C("z"), tiles.tile_x(C("lon"), C("z")), tiles.tile_y(C("lat"), C("z")))
    return rows.select("id", "z", *[(F.round(v, 4) + 0.0).alias(k) for k, v in box.items()])


def _band_values() -> str:
    rows = [
        f"('{g}', '{layer}', '{s}', '{v}', {lo}, {hi}, {'NULL' if top is None else top})"
        for g, layer, s, v, lo, hi, top, _ in serving_bands()
    ]
    return "bands(grp, layer, source_layer, view, lo, hi, max_zoom) AS (VALUES " + ", ".join(rows) + ")"


_LAYERS = sorted({row[1] for row in serving_bands()})
_REQUEST = f"SELECT event_id, ({_LAYERS})[CAST(event_id % {len(_LAYERS)} + 1 AS INTEGER)] AS layer, CAST(event_id // 29 % 21 AS INTEGER) AS z FROM events"


def requests(t):
    n = C("event_id")
    layer = F.get(F.array(*[F.lit(v) for v in _LAYERS]), (n % len(_LAYERS)).cast("int"))
    return t.events.select(n, layer.alias("layer"), (F.floor(n / 29) % 21).cast("int").alias("z"))


@query(
    "zoom_band_dispatch",
    "",
    f"WITH {_band_values()}, q AS ({_REQUEST}) SELECT event_id, layer, z, grp AS served_by, view FROM q JOIN bands USING (layer) WHERE z BETWEEN lo AND hi",
)
def _(t):
    found = ops.dispatch_bands(requests(t), ops.band_table(t.spark, serving_bands()))
    return found.select("event_id", "layer", "z", C("group").alias("served_by"), "view")


@query(
    "tile_extent_params",
    "",
    f"""WITH {_band_values()}, q AS ({_REQUEST}) SELECT event_id, layer, z, CASE WHEN max_zoom <= 5 THEN 1024 WHEN max_zoom <= 9 THEN 2048 ELSE 4096 END AS extent,
        CASE WHEN max_zoom <= 5 THEN 64 WHEN max_zoom <= 9 THEN 128 ELSE 256 END AS buffer FROM q JOIN bands USING (layer) WHERE z BETWEEN lo AND hi""",
)
def _(t):
    found = ops.dispatch_bands(requests(t), ops.band_table(t.spark, serving_bands()))
    top = C("max_zoom")
    return found.select("event_id", "layer", "z", tiles.extent(top).alias("extent"), tiles.buffer(top).alias("buffer"))


def placed(t):
    """Rectangles spread over the world, with their envelope."""
    n = C("c_custkey")
    shape = geo.rectangle(
        (n * 7919 % 40000) * 1000.0 - 2.0e7, (n * 104729 % 39000) * 1000.0 - 1.95e7, F.abs("c_acctbal") * 100 + 1, F.lit(500000.0)
    )
    rows = t.customer.select(n.alias("osm_id"), C("c_name").alias("name"), C("c_mktsegment").alias("layer"), shape.alias("geometry"))
    return rows.withColumns(geo.bounds(C("geometry")))


_PLACED = """placed AS (SELECT c_custkey AS osm_id, c_name AS name, c_mktsegment AS layer, (c_custkey * 7919 % 40000) * CAST(1000.0 AS DOUBLE) - 2.0e7 AS xmin, (c_custkey * 104729 % 39000) * CAST(1000.0 AS DOUBLE) - 1.95e7 AS ymin,
  (c_custkey * 7919 % 40000) * CAST(1000.0 AS DOUBLE) - 2.0e7 + (abs(c_acctbal) * 100 + 1) AS xmax, (c_custkey * 104729 % 39000) * CAST(1000.0 AS DOUBLE) - 1.95e7 + CAST(500000.0 AS DOUBLE) AS ymax FROM customer)"""


def _tiles_sql(zooms) -> str:
    return f"""{_PLACED}, pr AS (SELECT *, {sql_mx('xmin', 'z')} AS x0, {sql_mx('xmax', 'z')} AS x1, {sql_my('ymax', 'z')} AS y0, {sql_my('ymin', 'z')} AS y1 FROM (SELECT *, unnest({zooms}) AS z FROM placed)),
       px AS (SELECT *, CAST(unnest(generate_series(x0, x1)) AS INTEGER) AS x FROM pr), pt AS (SELECT *, CAST(unnest(generate_series(y0, y1)) AS INTEGER) AS y FROM px)"""


@query(
    "tile_join",
    "features",
    f"""WITH {_tiles_sql([3, 6])}, want AS (SELECT DISTINCT z, x, y FROM (SELECT unnest([3, 6]) AS z, lon, lat FROM features) f, LATERAL (SELECT {sql_tx('lon', 'z')} AS x, {sql_ty('lat', 'z')} AS y))
        SELECT osm_id, z, x, y FROM pt JOIN want USING (z, x, y)""",
)
def _(t):
    points = t.features().select("lon", "lat", F.explode(F.array(F.lit(3), F.lit(6))).alias("z"))
    wanted = points.select(
        "z", tiles.tile_x(C("lon"), C("z")).alias("x"), tiles.tile_y(C("lat"), C("z")).alias("y")
    )
    return ops.features_on_tiles(placed(t), wanted, [3, 6]).select("osm_id", "z", "x", "y")


@query(
    "tile_features",
    "",
    f"""WITH {_tiles_sql([4, 7])}, s AS (SELECT *, 2 * {HALF} / pow(2.0, z) AS size FROM pt)
        SELECT osm_id, name, layer, z, x, y, 2048 AS extent, 128 AS buffer,
          CAST(floor((xmin - (x * size - {HALF})) / size * 2048 + 0.5) AS INTEGER) AS first_x, CAST(floor(({HALF} - y * size - ymin) / size * 2048 + 0.5) AS INTEGER) AS first_y,
          CAST(floor((xmax - (x * size - {HALF})) / size * 2048 + 0.5) AS INTEGER) AS third_x, CAST(floor(({HALF} - y * size - ymax) / size * 2048 + 0.5) AS INTEGER) AS third_y FROM s""",
)
def _(t):
    rows = ops.tile_features(placed(t), 9, [4, 7])
    ring = C("grid")[0][0]
    return rows.select(
        "osm_id", "name", "layer", "z", "x", "y", "extent", "buffer",
        ring[0]["x"].alias("first_x"), ring[0]["y"].alias("first_y"), ring[2]["x"].alias("third_x"), ring[2]["y"].alias("third_y"),
    )


_GRID = """g AS (SELECT *, x * size - {half} AS l, {half} - y * size AS t FROM (SELECT *, 2 * {half} / pow(2.0, z) AS size FROM pt)),
  b AS (SELECT *, l - size * 0.0625 AS bl, t - size - size * 0.0625 AS bb, l + size + size * 0.0625 AS br, t + size * 0.0625 AS bt FROM g)""".format(half=HALF)


def _snap(value: str) -> str:
    return f"CAST(floor({value} / size * 2048 + 0.5) AS INTEGER)"


@query(
    "tile_clip_rings",
    "",
    f"""WITH {_tiles_sql([5, 8])}, {_GRID}, c AS (SELECT *, greatest(xmin, bl) AS cx0, least(xmax, br) AS cx1, greatest(ymin, bb) AS cy0, least(ymax, bt) AS cy1 FROM b),
        s AS (SELECT osm_id, name, z, x, y, {_snap('(cx0 - l)')} AS x0, {_snap('(cx1 - l)')} AS x1, {_snap('(t - cy1)')} AS y0, {_snap('(t - cy0)')} AS y1 FROM c)
        SELECT *, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS cells FROM s WHERE x1 > x0 AND y1 > y0""",
)
def _(t):
    """Boxes cut to the buffered tile; those without area on the grid are gone."""
    rows = clip.clip_to_tiles(placed(t), 9, [5, 8])
    ring = F.flatten(F.flatten("grid"))
    of = lambda axis, pick: pick(F.transform(ring, lambda v: v[axis]))
    found = rows.select(
        "osm_id", "name", "z", "x", "y", of("x", F.array_min).alias("x0"), of("x", F.array_max).alias("x1"), of("y", F.array_min).alias("y0"), of("y", F.array_max).alias("y1")
    )
    return found.withColumn("cells", ((C("x1") - C("x0")) * (C("y1") - C("y0"))).cast("long"))


@query(
    "tile_clip_lines",
    "",
    f"""WITH {_tiles_sql([5, 8])}, {_GRID},
        e AS (SELECT *, greatest(CAST(0.0 AS DOUBLE), (bl - xmin) / (xmax - xmin), (bb - ymin) / (ymax - ymin)) AS t0, least(CAST(1.0 AS DOUBLE), (br - xmin) / (xmax - xmin), (bt - ymin) / (ymax - ymin)) AS t1 FROM b),
        s AS (SELECT osm_id, z, x, y, {_snap('(xmin + t0 * (xmax - xmin) - l)')} AS from_x, {_snap('(t - (ymin + t0 * (ymax - ymin)))')} AS from_y,
          {_snap('(xmin + t1 * (xmax - xmin) - l)')} AS to_x, {_snap('(t - (ymin + t1 * (ymax - ymin)))')} AS to_y FROM e WHERE t0 < t1)
        SELECT * FROM s WHERE from_x <> to_x OR from_y <> to_y""",
)
def _(t):
    """Diagonals cut to the buffered tile; those of one grid point are gone."""
    boxes = placed(t)
    diagonal = geo.line(F.array(geo.vertex(C("xmin"), C("ymin")), geo.vertex(C("xmax"), C("ymax"))))
    line = clip.clip_to_tiles(boxes.withColumn("geometry", diagonal), 9, [5, 8]).withColumn("line", C("grid")[0][0])
    ends = [(name, C("line")[at]) for name, at in (("from", 0), ("to", 1))]
    return line.select("osm_id", "z", "x", "y", *[end[a].alias(f"{name}_{a}") for name, end in ends for a in "xy"])


@query(
    "composite_tile",
    "",
    f"""WITH {_tiles_sql([1, 4])}, n AS (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY layer, osm_id) AS rn FROM pt)
        SELECT 'main' AS grp, z, x, y, CAST((rn - 1) // 10000 AS INTEGER) AS page, count(*) AS n, string_agg(layer || '/' || osm_id, ',' ORDER BY rn) AS features FROM n GROUP BY z, x, y, page""",
)
def _(t):
    rows = ops.tiles_of_features(placed(t), [1, 4]).withColumn("group", F.lit("main"))
    composed = ops.composite_tiles(rows, F.concat_ws("/", "layer", C("osm_id").cast("string")))
    return composed.select(
        C("group").alias("grp"), "z", "x", "y", "page", F.size("features").cast("long").alias("n"), F.array_join("features", ",").alias("features")
    )


_EXPIRED = f"SELECT CAST(12 + id % 4 AS INTEGER) AS z, {sql_tx('lon', 'CAST(12 + id % 4 AS INTEGER)')} AS x FROM features"
_SHORT = "CASE WHEN length(CAST(x AS VARCHAR)) <= 2 THEN CAST(x AS VARCHAR) WHEN length(CAST(x AS VARCHAR)) = 3 THEN substr(CAST(x AS VARCHAR), 1, 2) ELSE substr(CAST(x AS VARCHAR), 1, length(CAST(x AS VARCHAR)) - 2) END"


def expired(t):
    z = (12 + C("id") % 4).cast("int")
    rows = t.features().select("id", z.alias("z"), "lon", "lat")
    return rows.select("id", "z", tiles.tile_x(C("lon"), C("z")).alias("x"), tiles.tile_y(C("lat"), C("z")).alias("y"))


@query("tile_prefix", "features", f"SELECT id, z || '/' || {_SHORT} AS prefix FROM (SELECT id, z, x FROM (SELECT id, CAST(12 + id % 4 AS INTEGER) AS z, {sql_tx('lon', 'CAST(12 + id % 4 AS INTEGER)')} AS x FROM features))")
def _(t):
    return expired(t).select("id", tiles.tile_prefix(C("z"), C("x")).alias("prefix"))


_EXPAND_ZOOMS = [8, 10, 11, 12, 13, 14, 16]
_EXPAND = f"""ex AS (SELECT DISTINCT z, x FROM ({_EXPIRED})), tz AS (SELECT *, unnest({_EXPAND_ZOOMS}) AS tz FROM ex),
   lim AS (SELECT tz, CASE WHEN tz <= z THEN x >> (z - tz) ELSE x << (tz - z) END AS lo, CASE WHEN tz <= z THEN x >> (z - tz) ELSE ((x + 1) << (tz - z)) - 1 END AS hi FROM tz),
   al AS (SELECT tz, unnest(generate_series(lo, hi)) AS x FROM lim), pre AS (SELECT DISTINCT tz || '/' || {_SHORT} AS prefix FROM al)"""


@query("tile_expand_parents_children", "features", f"WITH {_EXPAND} SELECT prefix FROM pre")
def _(t):
    return ops.expand_prefixes(expired(t), _EXPAND_ZOOMS)


_PATHS = ["/maps/main", "/maps/admin", "/maps/other_boundaries"]


@query(
    "expire_batches",
    "features",
    f"""WITH {_EXPAND}, n AS (SELECT prefix, row_number() OVER (ORDER BY prefix) AS rn FROM pre)
        SELECT (rn - 1) // 200 AS batch, count(*) AS prefixes, '^(?:{'|'.join(_PATHS)})/(' || string_agg(prefix, '|' ORDER BY prefix) || ')[0-9]*/[0-9]+(\\.pbf)?$' AS regex FROM n GROUP BY 1""",
)
def _(t):
    return ops.expire_batches(ops.expand_prefixes(expired(t), _EXPAND_ZOOMS), _PATHS)


@query(
    "degenerate_bbox_expand",
    "features",
    """WITH b AS (SELECT id, x AS xmin, y AS ymin, CASE WHEN id % 3 = 0 THEN x + 5 ELSE x END AS xmax, y AS ymax FROM features),
       g AS (SELECT *, CASE WHEN xmin = xmax AND ymin = ymax THEN 10 / cos(radians(degrees(atan(sinh(ymin / 6378137.0))))) ELSE 0 END AS reach FROM b)
       SELECT id, round(xmin - reach, 4) AS xmin, round(ymin - reach, 4) AS ymin, round(xmax + reach, 4) AS xmax, round(ymax + reach, 4) AS ymax FROM g""",
)
def _(t):
    wide = F.when(C("id") % 3 == 0, C("x") + 5).otherwise(C("x"))
    rows = t.features().select("id", C("x").alias("xmin"), C("y").alias("ymin"), wide.alias("xmax"), C("y").alias("ymax"))
    names = ["xmin", "ymin", "xmax", "ymax"]
    grown = geo.grow_point_box(*[C(n) for n in names])
    return rows.select("id", *[F.round(g, 4).alias(n) for g, n in zip(grown, names)])


@query(
    "invalid_geometry_flag",
    "tagged",
    "SELECT osm_id, type = 'way' AND node_count > 0 AND CASE WHEN osm_id % 7 = 0 THEN node_count < 4 ELSE node_count < 2 END AS broken FROM tagged",
)
def _(t):
    area_tag = text.tag(C("tags"), "area")
    return t.tagged().select("osm_id", geo.broken_way(C("type"), area_tag, C("node_count")).alias("broken"))


# ---- small text formats ----


@query(
    "tile_list_scan",
    "features",
    f"""SELECT z, x, y FROM (SELECT id, CAST(12 + id % 4 AS INTEGER) AS z, {sql_tx('lon', 'CAST(12 + id % 4 AS INTEGER)')} AS x, {sql_ty('lat', 'CAST(12 + id % 4 AS INTEGER)')} AS y FROM features) WHERE id % 6 <> 0""",
)
def _(t):
    path = work_path(t.spark, "tiles")
    line = F.concat_ws("/", *[C(c).cast("string") for c in ("z", "x", "y")])
    text_line = F.when(C("id") % 6 == 0, F.concat(F.lit("bad "), line)).otherwise(F.concat(line, F.lit(" ")))
    expired(t).select(text_line.alias("value")).write.text(path)
    return read_tile_list(t.spark, path)


@query(
    "replication_state_scan",
    "",
    """SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 0 ELSE event_id END AS sequence, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM events""",
)
def _(t):
    n = C("event_id")
    stamp = F.replace(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(":"), F.lit("\\:"))
    body = F.concat(
        F.lit("#comment\n"),
        F.when(n % 8 == 0, "").otherwise(F.concat(F.lit("sequenceNumber = "), n.cast("string"), F.lit("\n"))),
        F.lit("timestamp="),
        F.when(n % 5 == 0, "not a time").otherwise(stamp),
    )
    state = parse_state(C("body"))
    rows = t.events.select("event_id", body.alias("body"))
    at = F.date_format(state["timestamp"], "yyyy-MM-dd HH:mm:ss")
    return rows.select("event_id", state["sequence"].alias("sequence"), at.alias("at"))
