"""The full catalogue of published views, and how to build it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.functions.geometry import bounds
from terrachron.functions.text import first_present
from terrachron.operators import boundaries, override, routes
from terrachron.operators.changes import with_decimal_dates
from terrachron.operators.shapes import simplify
from terrachron.plans import views
from terrachron.plans.publish import is_published, open_view, publish
from terrachron.plans.serving import CLOSE, STANDARD, band_name
from terrachron.sources.static import LAKE_TABLES


@dataclass(frozen=True)
class View:
    """One published view: what it is made of and how."""

    name: str
    kind: str
    sources: tuple[str, ...]
    tolerance: float = 0
    minimum: float = 0
    where: str | None = None
    options: dict = field(default_factory=dict)
    unique: tuple[str, ...] = ("id", "osm_id")


def _types(*names: str) -> str:
    return "type IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _levels(top: int) -> str:
    return f"admin_level BETWEEN 1 AND {top}"


DETAILED = list(reversed(STANDARD))
FINE = ("id", "osm_id", "type")
LABEL = ("id", "source", "osm_id")
# Tolerances of the seven standard bands, finest first, and the highest
# administrative level each band shows.
ADMIN_TOLERANCE = [1, 5, 20, 100, 200, 1000, 5000]
ADMIN_AREA_LEVEL = [11, None, 10, 9, 6, 4, 2]
ADMIN_LINE_LEVEL = [11, 10, None, 9, 6, 4, 2]
LAND_TOLERANCE = [1, 5, 10, 30, 70, 200, 500]
NON_ADMIN_TAGS = ["religion", "denomination", "timezone", "utc", "postal_code", "ref", "political_division"]
# Line types kept at each transport band.
MAIN_ROADS = ["motorway", "motorway_link", "trunk", "trunk_link", "construction", "primary", "primary_link", "rail", "secondary", "secondary_link"]
MIDDLE_ROADS = ["tertiary", "tertiary_link", "miniature", "narrow_gauge", "dismantled", "abandoned", "disused", "razed", "light_rail", "preserved", "proposed", "tram", "funicular", "monorail", "taxiway", "runway"]
SMALL_ROADS = ["raceway", "residential", "service", "unclassified", "track", "path", "footway", "cycleway", "pedestrian", "living_street", "steps", "bridleway"]
# Roads that are not shown as areas.
ROADS_NOT_AREAS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "service", "living_street", "cycleway", "bridleway"]
# Place types by band.
WIDE_PLACES = ["ocean", "sea", "archipelago", "country", "territory", "unorganized territory"]
STATES = ["state", "province", "region"]
TOWNS = ["county", "municipality", "city", "town"]
LOCAL_PLACES = ["village", "suburb", "locality", "hamlet", "islet", "neighbourhood", "district", "borough", "quarter", "isolated_dwelling", "farm"]
SMALL_AREAS = ["plot", "square", "islet"]


def _cascade(family: str, kind: str, first: View, steps: Iterable[tuple]) -> list[View]:
    """A detailed view and coarser ones, each made from the one before.

    A step is (lo, hi, tolerance, minimum, filter).
    """
    made = [first]
    for lo, hi, tolerance, minimum, where in steps:
        made.append(
            View(band_name(family, lo, hi), kind, (made[-1].name,), tolerance, minimum, where, unique=first.unique)
        )
    return made


def _areas(family: str, layer: str, first: tuple, steps: Iterable[tuple] = (), where=None, **options) -> list[View]:
    lo, hi, tolerance, minimum = first
    view = View(band_name(family, lo, hi), "areas", (layer,), tolerance, minimum, where, options, FINE)
    return _cascade(family, "derived_areas", view, steps)


def _lines(family: str, layer: str, first: tuple, steps: Iterable[tuple] = (), where=None) -> list[View]:
    lo, hi, tolerance = first
    view = View(band_name(family, lo, hi), "lines", (layer,), tolerance, 0, where, unique=FINE)
    return _cascade(family, "derived_lines", view, steps)


def _labels(family: str, areas: str, bands, points: str | None = None, with_points=()) -> list[View]:
    made = []
    for lo, hi in bands:
        sources = (band_name(areas, lo, hi),)
        if points and (lo, hi) in with_points:
            sources += (points,)
        made.append(View(band_name(family, lo, hi), "labels", sources, unique=LABEL))
    return made


def _points(name: str, layer: str, **options) -> View:
    return View(name, "points", (layer,), options=options, unique=LABEL)


def _administrative() -> list[View]:
    steps = [
        (*band, tolerance, 0, level and _levels(level))
        for band, tolerance, level in zip(DETAILED[1:], ADMIN_TOLERANCE[1:], ADMIN_AREA_LEVEL[1:])
    ]
    made = _areas("admin_areas", "admin_areas", (16, 20, 1, 0), steps, _levels(11))
    made += [
        View(band_name("admin_centroids", *b), "admin_labels", (band_name("admin_areas", *b), "admin_relation_members"), unique=FINE)
        for b in STANDARD
    ]
    merged = View("boundary_members", "boundary_members", ("admin_relation_members",), unique=("admin_level", "member", "type", "group_id"))
    both = View("boundary_relations_ways", "boundary_union", (merged.name, "admin_lines"), unique=("admin_level", "member", "group_id"))
    first = View(band_name("admin_lines", 16, 20), "boundary_lines", (both.name,), 1, unique=("id",))
    steps = [
        (*band, tolerance, 0, level and _levels(level))
        for band, tolerance, level in zip(DETAILED[1:], ADMIN_TOLERANCE[1:], ADMIN_LINE_LEVEL[1:])
    ]
    made += [merged, both, *_cascade("admin_lines", "derived_lines", first, steps)]
    for lo, hi, tolerance in ((0, 5, 2000), (6, 9, 500), (10, 15, 10)):
        made += _lines("maritime_lines", "admin_lines", (lo, hi, tolerance), where="maritime = 'yes'")
    tags = [f"tags['{t}'] AS {t}" for t in NON_ADMIN_TAGS]
    steps = [(*band, tolerance, 0, None) for band, tolerance in zip(DETAILED[1:], ADMIN_TOLERANCE[1:])]
    made += _areas("non_admin_areas", "admin_areas", (16, 20, 1, 0), steps, "type <> 'administrative'", tag_columns=tags)
    return made + _labels("non_admin_centroids", "non_admin_areas", STANDARD)


def _sites() -> list[View]:
    made = []
    for family, layer, points, extra in (
        ("amenity", "amenity_areas", "amenity_points", ()),
        ("building", "buildings", "buildings_points", ("CAST(NULL AS STRING) AS height",)),
    ):
        made.append(_points(f"{family}_points", points, extra=extra))
        made += _areas(f"{family}_areas", layer, (14, 15, 5, 5000))
        made += _areas(f"{family}_areas", layer, (16, 20, 0, 0))
        made += _labels(f"{family}_centroids", f"{family}_areas", CLOSE, f"{family}_points", CLOSE)
    return made


def _land_use() -> list[View]:
    steps = [(13, 15, 5, 1e4, None), (10, 12, 20, 5e4, None), (8, 9, 100, 1e6, None), (6, 7, 200, 1e7, None)]
    made = _areas("landuse_areas", "landuse_areas", (16, 20, 0, 0), steps, "NOT (type = 'water' AND class = 'natural')")
    made.append(_points("landuse_points", "landuse_points"))
    made += _labels("landuse_centroids", "landuse_areas", DETAILED[:5], "landuse_points", DETAILED[:2])
    return made + _lines("landuse_lines", "landuse_lines", (16, 20, 5), [(14, 15, 5, 0, None)], _types("tree_row"))


def _others() -> list[View]:
    made = []
    for first in ((8, 9, 100, 1e6), (10, 12, 20, 5e4), (13, 15, 5, 5000), (16, 20, 0, 0)):
        made += _areas("other_areas", "other_areas", first)
    made.append(_points("other_points", "other_points"))
    made += _labels("other_centroids", "other_areas", DETAILED[:4], "other_points", DETAILED[:2])
    return made + _lines("other_lines", "other_lines", (16, 20, 0), [(14, 15, 5, 0, None)])


def _networks() -> list[View]:
    both = ("communication_lines", "communication_multilines")
    first = View(band_name("communication_lines", 16, 20), "communication", both, unique=("id", "osm_id", "source_type"))
    made = _cascade("communication_lines", "derived_lines", first, [(13, 15, 5, 0, None), (10, 12, 20, 0, None)])
    # The label of a place is its airport code, or its ref.
    made += _areas(
        "transport_areas",
        "transport_areas",
        (16, 20, 0, 0),
        [(13, 15, 5, 0, None), (10, 12, 20, 100, _types("aerodrome", "apron", "terminal"))],
        f"NOT (class = 'highway' AND {_types(*ROADS_NOT_AREAS)})",
        codes=True,
    )
    made.append(_points("transport_points", "transport_points", codes=True))
    made += _labels("transport_centroids", "transport_areas", DETAILED[:3], "transport_points", DETAILED[:2])
    ways = ("transport_lines", "street_multilines", "transport_multilines")
    first = View(band_name("transport_lines", 16, 20), "transport_lines", ways, unique=("id",))
    rail = " OR class = 'railway'"
    fine = _types(*MAIN_ROADS, *MIDDLE_ROADS, *SMALL_ROADS, "ferry") + rail
    middle = _types(*MAIN_ROADS, *MIDDLE_ROADS, "ferry") + rail
    main = _types(*MAIN_ROADS, "ferry") + rail
    steps = [(13, 15, 5, 0, fine), (10, 12, 20, 0, middle), (8, 9, 100, 0, None), (6, 7, 200, 0, main), (5, 5, 1000, 0, None)]
    return made + _cascade("transport_lines", "derived_lines", first, steps)


def _water() -> list[View]:
    still = ["water", "pond", "basin", "canal", "mill_pond", "riverbank"]
    steps = [
        (13, 15, 5, 0, None),
        (10, 12, 20, 100, _types(*still)),
        (8, 9, 100, 1e4, None),
        (6, 7, 200, 1e6, None),
        (3, 5, 1000, 5e7, None),
        (0, 2, 5000, 1e8, _types("water", "riverbank")),
    ]
    made = _areas("water_areas", "water_areas", (16, 20, 0, 0), steps)
    made += [View(band_name("water_centroids", *b), "derived_labels", (band_name("water_areas", *b),)) for b in DETAILED[:4]]
    flow = ["river", "canal", "cliff", "dam", "stream", "ditch", "drain"]
    lines = [(13, 15, 5, 0, _types(*flow[:5])), (10, 12, 20, 0, _types(*flow[:4])), (8, 9, 100, 0, _types(*flow[:2]))]
    return made + _lines("water_lines", "water_lines", (16, 20, 0), lines, _types(*flow))


def _routes() -> list[View]:
    base = View("routes_normalized", "routes_normalized", ("route_multilines", "route_lines"), unique=("way_id", "min_start_decdate", "max_end_decdate"))
    indexed = View("routes_indexed", "routes_indexed", (base.name, f"{base.name}_members"), unique=("way_id", "min_start_decdate", "max_end_decdate"))
    first = View(band_name("route_lines", 16, 20), "routes_view", (indexed.name,), unique=("id",))
    steps = [(13, 15, 5, 0, None), (10, 12, 20, 0, None), (8, 9, 100, 0, None), (6, 7, 200, 0, None), (5, 5, 1000, 0, None)]
    return [base, indexed, *_cascade("route_lines", "derived_lines", first, steps)]


def _places() -> list[View]:
    made = []
    for band, areas, points in (
        ((0, 2), ["island"], WIDE_PLACES),
        ((3, 5), ["island"], WIDE_PLACES + STATES),
        ((6, 10), ["island"], WIDE_PLACES + STATES + TOWNS),
        ((11, 20), SMALL_AREAS, STATES + TOWNS + LOCAL_PLACES),
    ):
        options = {"area_types": areas, "point_types": points}
        made.append(View(band_name("place_points", *band), "place_points", ("place_areas", "place_points"), options=options, unique=("osm_id", "type")))
    made.append(View("place_areas_z14_20", "place_areas", ("place_areas",), options={"types": SMALL_AREAS}, unique=("osm_id", "type")))
    return made


def catalogue() -> list[View]:
    """All views, each after the views it reads."""
    made = [
        *_administrative(),
        *_sites(),
        *_land_use(),
        *_others(),
        *_networks(),
        *_places(),
        *_water(),
        *_routes(),
        View("address_points_z16_20", "points", ("address_points",), unique=("id", "osm_id")),
        View("lakes", "lakes", tuple(LAKE_TABLES), 100, unique=("id",)),
    ]
    for band, tolerance in zip(DETAILED, LAND_TOLERANCE):
        made.append(View(band_name("land", *band), "land", ("land_polygons",), tolerance, unique=("ogc_fid",)))
    return made


def dated(df: DataFrame) -> DataFrame:
    """Decimal dates, unless the table was loaded with them."""
    return df if "start_decdate" in df.columns else with_decimal_dates(df)


def build(view: View, tables: Mapping[str, DataFrame], languages: list[str] = ()) -> DataFrame:
    """The rows of one view from its source tables."""
    given = [tables[s] for s in view.sources]
    options = dict(view.options)
    if options.pop("codes", False):
        options["overrides"] = {"ref": first_present(*[F.col(c) for c in ("faa", "iata", "icao", "ref")])}
    match view.kind:
        case "areas":
            return views.areas_view(given[0], view.tolerance, view.minimum, view.where, languages=languages, **options)
        case "points":
            return views.points_view(given[0], languages=languages, **options)
        case "lines":
            return views.lines_view(given[0], view.tolerance, view.minimum, view.where, languages=languages)
        case "labels":
            return views.label_view(*given)
        case "derived_areas":
            return views.derive_areas(given[0], view.tolerance, view.minimum, view.where)
        case "derived_lines":
            return views.derive_lines(given[0], view.tolerance, view.where)
        case "derived_labels":
            return views.derive_labels(given[0], view.where)
        case "admin_labels":
            return views.admin_labels(*given, view.where)
        case "boundary_members":
            return boundaries.merge_members(dated(given[0]))
        case "boundary_union":
            return boundaries.relations_and_ways(*given)
        case "boundary_lines":
            return simplify(boundaries.boundary_lines(given[0]), view.tolerance)
        case "communication":
            return views.communication_lines(*given)
        case "transport_lines":
            return override.override_lines(*given, languages=list(languages))
        case "place_points":
            return views.place_points(*given, languages=languages, **options)
        case "place_areas":
            return views.place_areas(given[0], languages=languages, **options)
        case "routes_normalized":
            return routes.normalize_routes(routes.route_sources(*map(dated, given)))[0]
        case "routes_indexed":
            return routes.index_routes(*given)
        case "routes_view":
            return routes.routes_view(given[0])
        case "lakes":
            return views.lakes_union(dict(zip(view.sources, given)), view.tolerance)
        case "land":
            return views.land_band(given[0], view.tolerance)
    raise ValueError(f"unknown kind of view {view.kind}")


class Published(dict):
    """Layers by name; other names are opened as published views."""

    def __init__(self, spark: SparkSession, root: str, layers: Mapping[str, DataFrame]):
        super().__init__(layers)
        self.spark, self.root = spark, root

    def __missing__(self, name: str) -> DataFrame:
        return open_view(self.spark, self.root, name).drop("xmin", "ymin", "xmax", "ymax")


def build_all(
    spark: SparkSession,
    layers: Mapping[str, DataFrame],
    root: str,
    languages: list[str] = (),
    only: Iterable[str] | None = None,
    resume: bool = False,
) -> list[str]:
    """Build and publish the catalogue; each band is read back by the next one.

    Every view is written once, with its envelope as columns, sorted by it
    inside the files. Sources that are not built in this call are opened as they were
    published. With ``resume``, views published already are left as they are, so
    a build that failed goes on where it stopped. Returns the views built.
    """
    wanted = None if only is None else set(only)
    tables = Published(spark, root, layers)
    built = []
    for view in catalogue():
        if wanted is not None and view.name not in wanted:
            continue
        if resume and is_published(spark, root, view.name):
            continue
        if view.kind == "routes_normalized":
            periods, members = routes.normalize_routes(
                routes.route_sources(*[dated(tables[s]) for s in view.sources])
            )
            publish(members, root, f"{view.name}_members")
            rows = periods
        else:
            rows = build(view, tables, languages)
        if "xmin" not in rows.columns:
            rows = rows.withColumns(bounds(F.col("geometry")))
        publish(rows, root, view.name, view.unique)
        tables.pop(view.name, None)
        built.append(view.name)
    return built
