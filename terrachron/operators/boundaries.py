"""Administrative boundary lines over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrachron.functions.dates import to_decimal
from terrachron.functions.geometry import LINE
from terrachron.functions.text import empty_to_null
from terrachron.operators.intervals import merge_intervals
from terrachron.operators.relational import not_in
from terrachron.operators.skew import number_rows

KEYS = ["type", "admin_level", "member"]
ATTRIBUTES = ["indefinite", "maritime", "disputed", "disputed_by"]
ADMINISTRATIVE = "administrative"
RESULT = [*KEYS, "geometry", "group_id", "start_decdate", "end_decdate", "start_date", "end_date", *ATTRIBUTES]


def merge_members(members: DataFrame) -> DataFrame:
    """Member lines of administrative relations with their touching periods merged."""
    lines = members.filter(
        (F.col("type") == ADMINISTRATIVE) & (F.col("geometry.gtype") == LINE)
    )
    return merge_intervals(
        lines,
        KEYS,
        tie="osm_id",
        first=["geometry"],
        largest={a: f"me_{a}" for a in ATTRIBUTES},
    )


def relations_and_ways(merged: DataFrame, lines: DataFrame) -> DataFrame:
    """Merged members, and administrative lines that are in no relation."""
    relations = merged.withColumnsRenamed(
        {
            "min_start_decdate": "start_decdate",
            "max_end_decdate": "end_decdate",
            "min_start_date_iso": "start_date",
            "max_end_date_iso": "end_date",
        }
    ).select(*RESULT)
    alone = not_in(lines.filter(F.col("type") == ADMINISTRATIVE), "osm_id", merged, "member")
    ways = alone.select(
        "type",
        "admin_level",
        F.col("osm_id").alias("member"),
        "geometry",
        F.lit(0).cast("long").alias("group_id"),
        to_decimal(F.col("start_date"), "start").alias("start_decdate"),
        to_decimal(F.col("end_date"), "end").alias("end_decdate"),
        "start_date",
        "end_date",
        *ATTRIBUTES,
    )
    return relations.unionByName(ways)


def boundary_lines(combined: DataFrame, top_level: int = 11) -> DataFrame:
    """The most detailed published form, with a sequential id."""
    shown = combined.filter(F.col("admin_level").between(1, top_level))
    numbered = number_rows(shown, [F.col(c) for c in ("admin_level", "member", "group_id")])
    return numbered.withColumnRenamed("member", "osm_id").withColumns(
        {a: empty_to_null(F.col(a)) for a in ATTRIBUTES}
    )
