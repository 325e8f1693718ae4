"""Street relations that override the attributes of their ways over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.functions.dates import to_decimal
from terrachron.functions.geometry import LINE
from terrachron.functions.text import (
    construction_type,
    differs,
    empty_to_null,
    joined_id,
    language_columns,
    merge_tags,
    override,
    tag,
    zero_to_null,
)
from terrachron.operators.skew import dealt, first_per_key
from terrachron.session import materialize

TEXT = [
    "name",
    "highway",
    "ref",
    "access",
    "service",
    "ford",
    "electrified",
    "highspeed",
    "usage",
    "railway",
    "aeroway",
    "route",
]
FLAGS = ["expressway", "tunnel", "bridge", "oneway"]
NUMBERS = [*FLAGS, "z_order"]


def _any_difference(relation: str, way: str) -> Column:
    condition = F.lit(False)
    for c in TEXT:
        condition = condition | differs(F.col(f"{relation}.{c}"), F.col(f"{way}.{c}"))
    for c in FLAGS:
        value = F.col(f"{relation}.{c}")
        condition = condition | (value.isNotNull() & ~value.eqNullSafe(F.col(f"{way}.{c}")))
    return condition


def pair_ways_with_streets(ways: DataFrame, streets: DataFrame) -> DataFrame:
    """Ways joined to the street relations they are members of, with a difference flag."""
    tl = ways.filter(F.col("geometry").isNotNull()).alias("tl")
    sm = streets.filter(F.col("geometry.gtype") == LINE).alias("sm")
    return tl.join(sm, F.col("sm.member") == F.col("tl.osm_id")).withColumn(
        "_differs", _any_difference("sm", "tl")
    )


def override_lines(
    ways: DataFrame,
    streets: DataFrame,
    relations: DataFrame,
    languages: list[str] | None = None,
    by_decimal: bool = False,
) -> DataFrame:
    """Transport lines with street relations applied over time.

    A way ends where the first relation that changes one of its attributes
    begins; the relation's copy of the way follows. Ways that are members of a
    transport relation are shown through it. Text dates are compared as text;
    ``by_decimal`` compares them as dates instead.
    """
    # read twice: once for the earliest change, where Spark reads only what that needs, and once for the copies
    streets = materialize(streets, "streets")
    members, lines = streets.count(), ways.count() + relations.count()
    pairs = pair_ways_with_streets(ways, dealt(streets, ["member"], members))
    changed = pairs.filter("_differs").select(
        F.col("tl.osm_id").alias("way"), F.col("sm.osm_id").alias("rel"),
        empty_to_null(F.col("sm.start_date")).alias("rel_start"),
    )
    earliest_start = (
        F.min_by("rel_start", to_decimal(F.col("rel_start"), "start")) if by_decimal else F.min("rel_start")
    )
    earliest = changed.filter(F.col("rel_start").isNotNull()).groupBy("way").agg(
        earliest_start.alias("earliest_rel_start")
    )
    standing = ways.filter(F.col("geometry").isNotNull()).join(
        earliest, F.col("osm_id") == F.col("way"), "left"
    )
    own_end = empty_to_null(F.col("end_date"))
    if by_decimal:
        own, cut = to_decimal(own_end, "end"), to_decimal(F.col("earliest_rel_start"), "start")
        end = F.when(own_end.isNull() | (cut < own), F.col("earliest_rel_start")).otherwise(own_end)
        end = F.coalesce(end, own_end)
    else:
        end = F.least(own_end, F.col("earliest_rel_start"))
    kept = ["geometry", "type", "class", *TEXT, *NUMBERS, "tags"]
    own_rows = standing.select(
        joined_id(F.col("id"), F.col("osm_id")).alias("id"),
        "osm_id",
        *kept,
        "start_date",
        end.alias("end_date"),
        F.lit(None).cast("long").alias("street"),
    )
    # a street counts for a way if any of its rows differs; the join has dealt the rows by way already
    same = Window.partitionBy("tl.osm_id", "sm.osm_id")
    copies = pairs.withColumn("_any", F.max("_differs").over(same)).filter("_any").select(
        joined_id(F.col("sm.osm_id"), F.col("tl.osm_id")).alias("id"),
        F.col("tl.osm_id").alias("osm_id"),
        *[F.col(f"tl.{c}").alias(c) for c in ("geometry", "type", "class")],
        *[override(F.col(f"sm.{c}"), F.col(f"tl.{c}")).alias(c) for c in TEXT],
        *[F.coalesce(F.col(f"sm.{c}"), F.col(f"tl.{c}")).alias(c) for c in NUMBERS],
        merge_tags(F.col("sm.tags"), F.col("tl.tags")).alias("tags"),
        F.col("sm.start_date").alias("start_date"),
        F.col("sm.end_date").alias("end_date"),
        F.col("sm.osm_id").alias("street"),
    )
    member_ways = relations.select(F.col("member").alias("_member")).distinct()
    expanded = own_rows.unionByName(copies).join(
        member_ways, F.col("osm_id") == F.col("_member"), "left_anti"
    )
    way_rows = expanded.withColumns({"source_type": F.lit("way"), "relation": F.abs("street")}).drop("street")
    relation_rows = relations.filter(F.col("geometry.gtype") == LINE).select(
        joined_id(F.col("id"), F.col("osm_id")).alias("id"),
        F.col("member").alias("osm_id"),
        *kept,
        "start_date",
        "end_date",
        F.abs("osm_id").alias("relation"),
        F.lit("relation").alias("source_type"),
    )
    combined = way_rows.unionByName(relation_rows)
    order = [F.col(c).asc_nulls_last() for c in ("source_type", "relation", "osm_id", "start_date", "end_date", "name", "highway")]
    unique = first_per_key(dealt(combined, ["id"], members + lines), ["id"], order)
    text = [c for c in TEXT if c != "highway"]
    return unique.select(
        "id",
        F.abs("osm_id").alias("osm_id"),
        "geometry",
        construction_type(F.col("highway"), F.col("tags"), F.col("type")).alias("type"),
        empty_to_null(tag(F.col("tags"), "construction")).alias("construction"),
        "class",
        *[empty_to_null(F.col(c)).alias(c) for c in [*text, "highway", "start_date", "end_date"]],
        *[zero_to_null(F.col(c)).alias(c) for c in FLAGS],
        "z_order",
        to_decimal(F.col("start_date"), "start").alias("start_decdate"),
        to_decimal(F.col("end_date"), "end").alias("end_decdate"),
        "tags",
        "relation",
        "source_type",
        *language_columns(languages or [], F.col("tags")),
    )
