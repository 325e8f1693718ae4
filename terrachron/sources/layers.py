"""The 27 source layers: mapping rules and columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from terrachron.functions.geometry import GEOMETRY
from terrachron.functions.text import tag

ANY = "__any__"
TAGS = T.MapType(T.StringType(), T.StringType())

# Column groups shared by layers. A name maps to a tag key where they differ.
ADDRESS = {
    f"addr_{part}": f"addr:{part}"
    for part in ("housenumber", "housename", "unit", "street", "city", "postcode")
}
DATES = ["start_date", "end_date"]
CODES = ["ref", "iata", "icao", "faa"]
DISPUTE = ["indefinite", "disputed", "disputed_by"]
ROUTE = {
    "route": "route",
    "ref": "ref",
    "network": "network",
    "network_wikidata": "network:wikidata",
    "direction": "direction",
    "operator": "operator",
}
COMMUNICATION_KINDS = [
    "telephone",
    "telegraph",
    "internet",
    "cable_television",
    "television",
    "radio",
    "microwave",
    "bos",
    "mobile_phone",
    "satellite",
    "amateur_radio",
    "optical",
    "space",
    "gsm-r",
]
COMMUNICATION = {f"communication_{k.replace('-', '_')}": f"communication:{k}" for k in COMMUNICATION_KINDS}
CARRIER = ["telecom", "operator", "location", "layer"]
STREET_TEXT = [
    "ref",
    "access",
    "service",
    "ford",
    "electrified",
    "highspeed",
    "usage",
    "railway",
    "aeroway",
    "highway",
    "route",
]
STREET_FLAGS = ["tunnel", "bridge", "expressway"]
# Tags dropped at load time; a trailing star is a prefix.
EXCLUDED_TAGS = """created_by source source:* source_ref note note:* fixme fixme:* FIXME todo
description description:* comment wikimedia_commons image image:* website url email phone fax
contact:* opening_hours opening_hours:* is_in is_in:* attribution license tiger:* gnis:* NHD:*
nhd:* NHDPlus:* ref:* nysgissam:* nypl:* nygisid bkln:* base_bbl yh:* nl_ahcb:* ign:* istatcom:*
hf:* gvr:* LINZ:* TMC:* NJDOT_* A45_* ANR FIPS EDGE_ID OBJECTID GlobalID GLOBALID HFCS zhb_code
import import:* import_uuid import_edge_id converted_by upload pre_download dataset odbl odbl:note
history roof:* building:levels building:part building:material building:colour generator:*
tactile_paving crossing:markings crossing:island crossing:barrier traffic_sign traffic_sign:*
traffic_signals traffic_signals:* button_operated sidewalk:* parking:* lit smoothness direction
ele""".split()
# Classes whose nodes are not address points of their own.
ADDRESS_REJECT = """building shop amenity tourism office craft leisure historic man_made emergency
healthcare public_transport aeroway railway highway power natural landuse place military""".split()

ELEMENT_TYPES = {
    "point": ["node"],
    "linestring": ["way"],
    "polygon": ["way", "relation"],
    "relation_member": ["relation"],
}


@dataclass(frozen=True)
class Layer:
    """Which elements a layer takes and which columns it has."""

    geometry: str
    mapping: dict[str, list[str]]
    text: dict[str, str] = field(default_factory=dict)
    typed: dict[str, str] = field(default_factory=dict)
    member: dict[str, str] = field(default_factory=dict)
    reject: dict[str, list[str]] = field(default_factory=dict)
    exclude: dict[str, list[str]] = field(default_factory=dict)


def _any(*keys: str) -> dict[str, list[str]]:
    return {k: [ANY] for k in keys}


def _text(*groups) -> dict[str, str]:
    columns: dict[str, str] = {}
    for group in groups:
        columns.update(group if isinstance(group, dict) else {name: name for name in group})
    return columns


def _layers() -> dict[str, Layer]:
    area = {"area": "area"}
    street = {**{f: "boolint" for f in STREET_FLAGS}, "oneway": "direction", "z_order": "wayzorder"}
    land = _any("landuse", "leisure", "natural")
    other = _any("barrier", "historic", "man_made", "power", "military")
    transport = _any("railway", "highway", "aeroway", "route")
    border = {"admin_level": "integer", "has_label": "boolint"}
    coast = {"natural": ["coastline"]}
    me_border = {"me_maritime": "maritime", **{f"me_{c}": c for c in DISPUTE}, "me_name": "name"}
    road = {"area": ["yes"]}
    return {
        "address_points": Layer(
            "point", _any("addr:housenumber"), _text(ADDRESS), reject=_any(*ADDRESS_REJECT)
        ),
        "admin_areas": Layer(
            "polygon", _any("boundary"), _text(["border_type"], DISPUTE), {**border, **area}
        ),
        "admin_lines": Layer("linestring", _any("boundary"), _text(["maritime"], DISPUTE), border),
        "admin_relation_members": Layer(
            "relation_member", _any("boundary"), {}, {"admin_level": "integer"}, me_border
        ),
        "amenity_areas": Layer("polygon", _any("amenity"), _text(ADDRESS), area),
        "amenity_points": Layer("point", _any("amenity"), _text(ADDRESS)),
        "buildings": Layer("polygon", _any("building"), _text(["height"], ADDRESS), area),
        "buildings_points": Layer("point", _any("building"), _text(ADDRESS)),
        "communication_lines": Layer(
            "linestring", _any("communication"), _text(COMMUNICATION, CARRIER)
        ),
        "communication_multilines": Layer(
            "relation_member", _any("communication"), _text(COMMUNICATION, CARRIER)
        ),
        "landuse_areas": Layer(
            "polygon", land, {}, area, reject=coast, exclude={"natural": ["water"]}
        ),
        "landuse_lines": Layer(
            "linestring", land, reject={"area": ["yes"], **coast, "boundary": ["administrative"]}
        ),
        "landuse_points": Layer("point", land, {}, area),
        "other_areas": Layer("polygon", other, {}, area),
        "other_lines": Layer("linestring", other),
        "other_points": Layer("point", {**other, **_any("tourism", "shop", "craft")}),
        "place_areas": Layer("polygon", _any("place"), {}, {"population": "integer", **area}),
        "place_points": Layer("point", _any("place"), {}, {"population": "integer"}),
        "route_lines": Layer("linestring", _any("route"), _text(ROUTE, ["highway"])),
        "route_multilines": Layer(
            "relation_member",
            _any("route"),
            _text(ROUTE),
            {},
            {"me_name": "name", "me_highway": "highway"},
        ),
        "street_multilines": Layer(
            "relation_member", {"type": ["street"]}, _text(STREET_TEXT), street
        ),
        "transport_areas": Layer("polygon", transport, _text(CODES), area),
        "transport_lines": Layer("linestring", transport, _text(STREET_TEXT), street, reject=road),
        "transport_multilines": Layer(
            "relation_member",
            _any("railway", "highway"),
            {**_text(STREET_TEXT), "relation_type": "type"},
            street,
            reject=road,
        ),
        "transport_points": Layer("point", transport, _text(CODES)),
        "water_areas": Layer(
            "polygon",
            {"waterway": [ANY], "landuse": ["basin", "reservoir"], "natural": ["water"]},
            {},
            area,
        ),
        "water_lines": Layer(
            "linestring",
            {"waterway": [ANY], "barrier": ["ditch"], "natural": ["cliff"]},
            _text(["bridge"]),
        ),
    }


LAYERS = _layers()
RELATION_TYPES = sorted(
    {"multipolygon", "boundary", "street"}
    | {
        key
        for layer in LAYERS.values()
        if layer.geometry == "relation_member"
        for key in layer.mapping
        if key != "type"
    }
)
# Drawing order by class, added to ten times the layer number.
CLASS_ORDER = {
    "motorway": 9,
    "trunk": 8,
    "rail": 7,
    "primary": 6,
    "secondary": 5,
    "tertiary": 4,
    "residential": 3,
    "unclassified": 3,
    "road": 3,
    "living_street": 3,
    "service": 2,
    "track": 1,
}
SPARK_TYPES = {
    "integer": T.IntegerType(),
    "boolint": T.IntegerType(),
    "direction": T.IntegerType(),
    "wayzorder": T.IntegerType(),
    "area": T.DoubleType(),
}


def layer_schema(name: str) -> T.StructType:
    """Fixed schema of a layer table."""
    layer = LAYERS[name]
    schema = T.StructType().add("id", T.LongType()).add("osm_id", T.LongType())
    schema = schema.add("geometry", GEOMETRY)
    for column in ("name", "type", "class", *DATES, *layer.text):
        schema = schema.add(column, T.StringType())
    for column, kind in layer.typed.items():
        schema = schema.add(column, SPARK_TYPES[kind])
    schema = schema.add("tags", TAGS)
    if layer.geometry == "relation_member":
        schema = schema.add("member", T.LongType()).add("role", T.StringType()).add("me_tags", TAGS)
        for column in layer.member:
            schema = schema.add(column, T.StringType())
    return schema


def read_layer(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored layer table, rows with a geometry only."""
    rows = spark.read.schema(layer_schema(name)).parquet(path)
    return rows.filter(F.col("geometry").isNotNull())


def typed_value(tags: Column, key: str, kind: str) -> Column:
    """A tag as the typed field of a layer."""
    value = tag(tags, key)
    if kind == "integer":
        return value.try_cast("int")
    if kind == "boolint":
        return F.when(value.isin("yes", "true", "1"), 1).otherwise(0)
    if kind == "direction":
        forward = value.isin("yes", "true", "1")
        return F.when(forward, 1).when(value == "-1", -1).otherwise(0)
    raise ValueError(f"unknown field type {kind}")


def drawing_order(tags: Column) -> Column:
    """Layer number times ten, plus class, bridge and tunnel."""
    kind = F.coalesce(tag(tags, "highway"), tag(tags, "railway"))
    order = F.lit(0)
    for name, rank in CLASS_ORDER.items():
        order = F.when(kind == name, rank).otherwise(order)
    level = F.coalesce(tag(tags, "layer").try_cast("int"), F.lit(0)) * 10
    raised = typed_value(tags, "bridge", "boolint") - typed_value(tags, "tunnel", "boolint")
    return level + order + raised * 10
