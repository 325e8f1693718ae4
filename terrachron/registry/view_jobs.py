"""View builders (V) and sinks (K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from terrachron.functions import geometry as geo
from terrachron.operators import languages as lang
from terrachron.plans import publish, views
from terrachron.plans.pyramid import catalogue
from terrachron.registry.base import query, sql_decimal
from terrachron.registry.tags import _KEYS, _LANG, language_layers
from terrachron.session import work_path
from terrachron.sources.layers import CARRIER, COMMUNICATION
from terrachron.sources.static import LAKE_TABLES

C = F.col
ENGLISH = ["name:en"]


def decimals(df):
    return df.withColumns({c: F.round(c, 6) for c in ("start_decdate", "end_decdate")})


def measured(df):
    """Rounded, without the geometry."""
    named = {c: F.round(c, 6) for c in ("area", "length") if c in df.columns}
    return decimals(df).withColumns(named).drop("geometry", "tags")


def boxed(df):
    return df.withColumns(geo.bounds(C("geometry")))


def placed(labels):
    """Does the label lie inside the box of its shape? NULL where there is no box."""
    at = C("geometry.parts")[0][0][0]
    inside = at["x"].between(C("xmin"), C("xmax")) & at["y"].between(C("ymin"), C("ymax"))
    flagged = labels.withColumn("inside", inside & (C("geometry.gtype") == geo.POINT))
    return measured(flagged).drop("xmin", "ymin", "xmax", "ymax")


_M2 = "CAST(round(CAST(area AS DECIMAL(30,10)), 1) AS DECIMAL(20,1))"
_KM2 = "CAST(round(CAST(CAST(area AS DECIMAL(30,10)) / 1000000 AS DECIMAL(30,10)), 1) AS DECIMAL(20,1))"
_DATES = f"round({sql_decimal('start_date', 'start')}, 6) AS start_decdate, round({sql_decimal('end_date', 'end')}, 6) AS end_decdate"
_NAMES = "{en} AS name_en, CAST(NULL AS VARCHAR) AS short_name, CAST(NULL AS VARCHAR) AS official_name"
_AREAS = f"""SELECT id, osm_id, NULLIF(name, '') AS name, NULLIF(type, '') AS type, upper(class) AS class, NULLIF(start_date, '') AS start_date, NULLIF(end_date, '') AS end_date,
  round(area, 6) AS area, {_M2} AS area_m2, {_KM2} AS area_km2, {_DATES}, {_NAMES.format(en='name_en_tag')}, 'polygon' AS source, capital FROM rects WHERE area > 40.00001 AND (type <> 'BUILDING')"""


def areas(t, tolerance=0):
    return views.areas_view(
        t.rects(),
        tolerance,
        40.00001,
        "type <> 'BUILDING'",
        ["tags['capital'] AS capital"],
        {"class": F.upper("class")},
        ENGLISH,
    )


@query("areas_view", "rects", _AREAS)
def _(t):
    return measured(areas(t))


@query(
    "derived_area_view",
    "rects",
    f"SELECT * FROM ({_AREAS}) WHERE area >= 100.00001 AND type IN ('MACHINERY', 'HOUSEHOLD')",
)
def _(t):
    return measured(views.derive_areas(areas(t), 0.5, 100.00001, "type IN ('MACHINERY', 'HOUSEHOLD')"))


def points(t):
    f = t.features().withColumns(
        {"geometry": geo.point(C("x"), C("y")), "tags": F.create_map(F.lit("name:en"), C("name"))}
    )
    return views.points_view(
        f.drop("lon", "lat", "x", "y", "ts", "k", "changeset"), ["CAST(NULL AS STRING) AS height"], {"class": F.upper("class")}, ENGLISH
    )


_POINTS = (
    f"""SELECT id, osm_id, upper(class) AS class, NULLIF(type, '') AS type, NULLIF(name, '') AS name, NULLIF(start_date, '') AS start_date, NULLIF(end_date, '') AS end_date,
        CAST(NULL AS DOUBLE) AS area, CAST(NULL AS DECIMAL(20,1)) AS area_m2, CAST(NULL AS DECIMAL(20,1)) AS area_km2, {_DATES}, {_NAMES.format(en='name')}, CAST(NULL AS VARCHAR) AS height, 'point' AS source FROM features"""
)


@query("points_view", "features", _POINTS)
def _(t):
    return measured(points(t))


@query(
    "points_centroids_view",
    "rects features",
    f"""SELECT *, TRUE AS inside FROM ({_AREAS}) UNION ALL BY NAME SELECT * EXCLUDE (height), CAST(NULL AS VARCHAR) AS capital, CAST(NULL AS BOOLEAN) AS inside FROM ({_POINTS})""",
)
def _(t):
    empty = {c: F.lit(None).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")}
    theme = points(t).drop("height").withColumns({"capital": F.lit(None).cast("string"), **empty})
    return placed(views.label_view(boxed(areas(t)), theme))


@query(
    "lines_view",
    "polylines",
    f"""SELECT id, osm_id, class, type, supplier, round(length, 6) AS length, CAST(round(CAST(round(length, 6) AS DECIMAL(30,10)), 1) AS DECIMAL(20,1)) AS length_m,
        CAST(round(CAST(CAST(round(length, 6) AS DECIMAL(30,10)) / 1000 AS DECIMAL(30,10)), 1) AS DECIMAL(20,1)) AS length_km, start_date, CAST(NULL AS VARCHAR) AS end_date,
        round({sql_decimal('start_date', 'start')}, 6) AS start_decdate, CAST(NULL AS DOUBLE) AS end_decdate, CAST(NULL AS VARCHAR) AS short_name, CAST(NULL AS VARCHAR) AS official_name, 'line' AS source
        FROM (SELECT *, CAST(1900 + supplier % 100 AS VARCHAR) AS start_date FROM polylines) WHERE length > 300.00001 AND type IN ('A', 'R')""",
)
def _(t):
    return measured(lines(t))


def lines(t, tolerance=0):
    rows = t.polylines().withColumns(
        {
            "length": F.round("length", 6),
            "start_date": (F.lit(1900) + C("supplier") % 100).cast("string"),
            "end_date": F.lit(""),
            "tags": F.create_map(F.lit("k"), C("type")),
        }
    )
    return views.lines_view(rows, tolerance, 300.00001, "type IN ('A', 'R')")


@query(
    "derived_line_view",
    "polylines",
    """SELECT id, osm_id, class, type, round(length, 6) AS length, mode FROM polylines, (SELECT unnest(['default', 'strict']) AS mode)
       WHERE length > 300.00001 AND type IN ('A', 'R') AND (type = 'A' OR class = 'F')""",
)
def _(t):
    base = lines(t)
    where = "type = 'A' OR class = 'F'"
    plain = views.derive_lines(base, 5, where).withColumn("mode", F.lit("default"))
    strict = views.derive_lines(base, 5, where, strict_reference=True).withColumn("mode", F.lit("strict"))
    return plain.unionByName(strict).select("id", "osm_id", "class", "type", F.round("length", 6).alias("length"), "mode")


@query("derived_centroid_view", "rects", f"SELECT *, TRUE AS inside FROM ({_AREAS}) WHERE area > 60.00001")
def _(t):
    return placed(views.derive_labels(boxed(areas(t)), "area > 60.00001"))


@query(
    "generic_view",
    "features",
    f"""SELECT abs(osm_id) AS osm_id, k, type, NULLIF(name, '') AS name, NULLIF(start_date, '') AS start_date, NULLIF(end_date, '') AS end_date, {_DATES}, {_NAMES.format(en='name')}
        FROM (SELECT *, row_number() OVER (PARTITION BY k, type ORDER BY {sql_decimal('start_date', 'start')} NULLS LAST, {sql_decimal('end_date', 'end')} NULLS LAST, NULLIF(name, '') NULLS LAST, id) AS rn FROM features) WHERE rn = 1""",
)
def _(t):
    f = t.features().withColumns(
        {"geometry": geo.point(C("x"), C("y")), "tags": F.create_map(F.lit("name:en"), C("name"))}
    )
    view = views.generic_view(f.select("id", "osm_id", "k", "type", "name", "start_date", "end_date", "tags", "geometry"), ["k", "type"], ENGLISH)
    return decimals(view).drop("geometry", "tags", "id")


@query(
    "admin_centroids",
    "rects",
    f"""SELECT *, TRUE AS inside FROM ({_AREAS}) WHERE name IS NOT NULL AND osm_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
)
def _(t):
    role = F.when((C("o_orderpriority") == "1-URGENT") & (C("o_orderstatus") == "F"), "label").otherwise("outer")
    members = t.orders.select(C("o_custkey").alias("osm_id"), role.alias("role"), F.lit("administrative").alias("type"))
    return placed(views.admin_labels(boxed(areas(t)), members))


def place_layers(t):
    f = t.features().withColumns(
        {"geometry": geo.point(C("x"), C("y")), "tags": F.create_map(F.lit("capital"), F.lit("yes"))}
    )
    return t.rects(), f


@query(
    "place_points",
    "rects features",
    f"""SELECT osm_id, NULLIF(name, '') AS name, type, start_date, NULLIF(end_date, '') AS end_date, {_DATES}, CAST(round_even(area, 0) AS BIGINT) AS area_m2, capital, name_en_tag AS name_en, CAST(NULL AS VARCHAR) AS short_name, CAST(NULL AS VARCHAR) AS official_name
          FROM rects WHERE name <> '' AND type IN ('MACHINERY')
        UNION ALL SELECT osm_id, NULLIF(name, ''), type, start_date, end_date, {_DATES}, NULL, 'yes', NULL, NULL, NULL FROM features WHERE type IN ('click', 'error')""",
)
def _(t):
    view = views.place_points(*place_layers(t), ["MACHINERY"], ["click", "error"], ENGLISH)
    return decimals(view).drop("geometry")


@query(
    "place_areas",
    "rects",
    f"""SELECT osm_id, NULLIF(name, '') AS name, type, start_date, NULLIF(end_date, '') AS end_date, {_DATES}, CAST(round_even(round(area, 6), 0) AS BIGINT) AS area_m2, capital, name_en_tag AS name_en, CAST(NULL AS VARCHAR) AS short_name, CAST(NULL AS VARCHAR) AS official_name
        FROM rects WHERE type IN ('MACHINERY', 'FURNITURE')""",
)
def _(t):
    return decimals(views.place_areas(t.rects(), ["MACHINERY", "FURNITURE"], ENGLISH)).drop("geometry")


_CARRIER_COLUMNS = [*COMMUNICATION, *CARRIER]


def communication(t):
    blank = {c: F.lit("") for c in _CARRIER_COLUMNS}
    lines_ = t.part.select(
        F.lit(1).cast("long").alias("id"), C("p_partkey").alias("osm_id"), geo.line(F.array(geo.vertex(C("p_size"), F.lit(0)), geo.vertex(F.lit(0), C("p_size")))).alias("geometry"),
        C("p_name").alias("name"), C("p_type").alias("type"), F.lit("1880").alias("start_date"), F.lit("").alias("end_date"), F.create_map(F.lit("k"), C("p_brand")).alias("tags"),
        *[v.alias(k) for k, v in {**blank, "telecom": C("p_brand")}.items()],
    )
    multi = t.supplier.select(
        F.lit(2).cast("long").alias("id"), (-C("s_suppkey")).alias("osm_id"), geo.line(F.array(geo.vertex(F.lit(0), F.lit(0)), geo.vertex(F.lit(1), F.lit(1)))).alias("geometry"),
        F.lit("").alias("name"), F.lit("line").alias("type"), F.lit("").alias("start_date"), F.lit("1950").alias("end_date"), F.create_map(F.lit("k"), C("s_name")).alias("tags"),
        *[v.alias(k) for k, v in {**blank, "operator": C("s_name")}.items()],
    )
    return lines_, multi


def _carrier(name: str, value: str) -> str:
    return ", ".join(f"{value if c == name else 'CAST(NULL AS VARCHAR)'} AS {c}" for c in _CARRIER_COLUMNS)


@query(
    "communication_lines_union",
    "",
    f"""SELECT 1::BIGINT AS id, p_partkey AS osm_id, p_name AS name, p_type AS type, '1880' AS start_date, CAST(NULL AS VARCHAR) AS end_date, round({sql_decimal("'1880'", 'start')}, 6) AS start_decdate, CAST(NULL AS DOUBLE) AS end_decdate,
          'line' AS source_type, {_carrier('telecom', 'p_brand')} FROM part
        UNION ALL SELECT 2, s_suppkey, NULL, 'line', NULL, '1950', NULL, round({sql_decimal("'1950'", 'end')}, 6), 'relation', {_carrier('operator', 's_name')} FROM supplier""",
)
def _(t):
    return decimals(views.communication_lines(*communication(t))).drop("geometry", "tags")


def lakes(t):
    """Three lake tables; every fourth lake of each is too small for the tolerance."""
    made = {}
    for at, (table, key, name) in enumerate((("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))):
        n = C(key)
        side = F.when(n % 4 == 0, 20.0).otherwise(4000.0)
        shape = geo.rectangle(n * 100.0, F.lit(at * 10.0), side, side)
        made[LAKE_TABLES[at]] = getattr(t, table).select(n.alias("ogc_fid"), C(name).alias("name"), shape.alias("geometry"))
    return made


@query(
    "lakes_union",
    "",
    f"""SELECT row_number() OVER (ORDER BY ord, name, key) AS id, name, source_table FROM (SELECT 0 AS ord, c_custkey AS key, c_name AS name, '{LAKE_TABLES[0]}' AS source_table FROM customer
        UNION ALL SELECT 1, s_suppkey, s_name, '{LAKE_TABLES[1]}' FROM supplier UNION ALL SELECT 2, p_partkey, p_name, '{LAKE_TABLES[2]}' FROM part) WHERE key % 4 <> 0""",
)
def _(t):
    return views.lakes_union(lakes(t)).drop("geometry")


# A square vanishes once half its diagonal is below the tolerance.
_LAND = ", ".join(f"('{v.name}', {v.tolerance})" for v in catalogue() if v.kind == "land")


@query(
    "land_pyramid",
    "",
    f"""WITH b(band, tolerance) AS (VALUES {_LAND}) SELECT band, c_custkey AS ogc_fid, 5 AS vertices FROM b, customer
        WHERE CASE WHEN c_custkey % 4 = 0 THEN 20 ELSE 4000 END * sqrt(2) / 2 > tolerance""",
)
def _(t):
    land = lakes(t)[LAKE_TABLES[0]].select("ogc_fid", "geometry")
    parts = [
        views.land_band(land, v.tolerance).select(F.lit(v.name).alias("band"), "ogc_fid", geo.vertex_count(C("geometry")).alias("vertices"))
        for v in catalogue()
        if v.kind == "land"
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- sinks ----


@query("publish_view", "rects", _AREAS)
def _(t):
    root = work_path(t.spark, "views")
    view = areas(t).withColumns(geo.bounds(C("geometry")))
    for _ in range(2):
        publish.publish(view, root, "areas", ["id", "osm_id", "type"])
    return measured(publish.open_view(t.spark, root, "areas")).drop("xmin", "ymin", "xmax", "ymax")


@query(
    "unique_key_check",
    "members",
    "SELECT member, ref, count(*) AS count FROM members WHERE ref IS NOT NULL GROUP BY member, ref HAVING count(*) > 1",
)
def _(t):
    return publish.duplicate_keys(t.members(), ["member", "ref"])


@query(
    "geojson_export",
    "tagged name_tags",
    f"""SELECT lower(regexp_replace(k, '[:\\-]', '_', 'g')) AS alias, 'Feature' AS kind, CAST(count(*) AS VARCHAR) AS count, round(degrees(min(x) / 6378137.0), 6) AS west, round(degrees(atan(sinh(max(y) / 6378137.0))), 6) AS north
        FROM {_KEYS} WHERE regexp_matches(k, {_LANG}) GROUP BY 1 HAVING count(*) >= 100""",
)
def _(t):
    table = lang.update_languages(None, lang.search_languages(language_layers(t)), 100, "2026-01-01 00:00:00")
    path = work_path(t.spark, "languages")
    publish.languages_as_geojson(table).select("feature").write.text(path)

    def read(place: str):
        return F.get_json_object("value", place)

    return t.spark.read.text(path).select(
        read("$.properties.alias").alias("alias"),
        read("$.type").alias("kind"),
        read("$.properties.count").alias("count"),
        F.round(read("$.geometry.coordinates[0][0][0]").cast("double"), 6).alias("west"),
        F.round(read("$.geometry.coordinates[0][2][1]").cast("double"), 6).alias("north"),
    )


@query(
    "changeset_partitioned_sink",
    "elements",
    "SELECT CAST(changeset AS INTEGER) AS changeset, osm_id, version, action FROM elements",
)
def _(t):
    path = work_path(t.spark, "changesets")
    publish.write_by_changeset(t.elements().select("changeset", "osm_id", "version", "action", "part", "price"), path)
    return t.spark.read.schema("changeset int, osm_id long, version int, action string").json(path)
