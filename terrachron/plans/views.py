"""Builders for the published views; filters run before geometries are thinned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions.dates import to_decimal
from terrachron.functions.geometry import LINES, POLYGONS, area
from terrachron.functions.text import (
    empty_to_null,
    half_even_long,
    language_columns,
    tag,
)
from terrachron.operators.relational import (
    area_columns,
    at_least,
    cleaned_columns,
    filtered,
    larger_than,
    length_columns,
    longer_than,
    named,
    not_in,
    of_types,
)
from terrachron.operators.shapes import label_points, simplify
from terrachron.operators.skew import first_per_key, number_rows
from terrachron.sources.layers import CARRIER, COMMUNICATION

DECIMALS = ["start_decdate", "end_decdate"]


def decimal_dates() -> dict[str, Column]:
    return {
        "start_decdate": to_decimal(F.col("start_date"), "start"),
        "end_decdate": to_decimal(F.col("end_date"), "end"),
    }


def _base(
    df: DataFrame,
    source: str,
    measures: Mapping[str, Column],
    languages: Sequence[str],
    extra: Sequence[str | Column],
    overrides: Mapping[str, Column] | None,
) -> DataFrame:
    """All source columns cleaned, then dates, measures, languages and the source literal."""
    overrides = overrides or {}
    fresh = {k: v for k, v in measures.items() if k not in overrides}
    own = df.drop(*DECIMALS, *fresh)
    # Measures and extras read the source columns, which the cleaned ones would hide.
    return df.select(
        *cleaned_columns(own, overrides),
        *[v.alias(k) for k, v in fresh.items()],
        *[v.alias(k) for k, v in decimal_dates().items()],
        *language_columns(languages, F.col("tags")),
        *[F.expr(e) if isinstance(e, str) else e for e in extra],
        F.lit(source).alias("source"),
    )


def areas_view(
    df: DataFrame,
    tolerance: float = 0,
    minimum: float = 0,
    where: str | Column | None = None,
    tag_columns: Sequence[str] = (),
    overrides: Mapping[str, Column] | None = None,
    languages: Sequence[str] = (),
) -> DataFrame:
    """Polygons of a layer: cleaned columns, areas, decimal dates, names by language."""
    rows = filtered(larger_than(df.filter("geometry IS NOT NULL"), minimum), where)
    view = _base(rows, "polygon", area_columns(F.col("area")), languages, tag_columns, overrides)
    return simplify(view, tolerance)


def points_view(
    df: DataFrame,
    extra: Sequence[str] = (),
    overrides: Mapping[str, Column] | None = None,
    languages: Sequence[str] = (),
) -> DataFrame:
    """Points of a layer with the columns of an areas view; areas are NULL."""
    rows = df.filter("geometry IS NOT NULL")
    supplied = {e.rsplit(None, 1)[-1].strip('`"') for e in extra}
    return _base(rows.drop(*supplied), "point", area_columns(None), languages, extra, overrides)


def lines_view(
    df: DataFrame,
    tolerance: float = 0,
    minimum: float = 0,
    where: str | Column | None = None,
    languages: Sequence[str] = (),
) -> DataFrame:
    """Lines of a layer; lengths where the layer has them."""
    rows = filtered(longer_than(df.filter("geometry IS NOT NULL"), minimum), where)
    measures = length_columns(F.col("length")) if "length" in df.columns else {}
    return simplify(_base(rows, "line", measures, languages, (), None), tolerance)


def label_view(areas: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Label points of named polygons, with the points of the same theme; points have no area."""
    labels = label_points(named(areas.filter("geometry IS NOT NULL")))
    if points is not None:
        has = set(points.columns)
        same = points.filter("geometry IS NOT NULL").select(
            *[F.col(f.name) if f.name in has else F.lit(None).cast(f.dataType).alias(f.name) for f in labels.schema]
        )
        labels = labels.unionByName(same)
    order = [F.col(c).asc_nulls_last() for c in ("type", "name", "start_date") if c in labels.columns]
    return first_per_key(labels, ["id", "source", "osm_id"], order)


def derive_areas(
    view: DataFrame, tolerance: float, minimum: float = 0, where: str | None = None
) -> DataFrame:
    """The next coarser band of an areas view."""
    return simplify(filtered(at_least(view.filter("geometry IS NOT NULL"), minimum), where), tolerance)


def derive_lines(
    view: DataFrame, tolerance: float, where: str | None = None, strict_reference: bool = False
) -> DataFrame:
    """The next coarser band of a lines view.

    With ``strict_reference`` the filter text follows the other conditions
    without parentheses, so a top-level OR widens the view.
    """
    kinds = ", ".join(f"'{k}'" for k in LINES)
    lines = f"geometry IS NOT NULL AND geometry.gtype IN ({kinds})"
    if where and where.strip():
        lines += f" AND {where}" if strict_reference else f" AND ({where})"
    return simplify(view.filter(lines), tolerance)


def derive_labels(view: DataFrame, where: str | None = None) -> DataFrame:
    """Label points of the polygons of a view."""
    return label_points(filtered(view.filter(F.col("geometry.gtype").isin(POLYGONS)), where))


def generic_view(
    df: DataFrame, keys: Sequence[str] = ("osm_id",), languages: Sequence[str] = ()
) -> DataFrame:
    """One row per key with a positive id, cleaned names and decimal dates."""
    replaced = ["geometry", "name", "start_date", "end_date", *DECIMALS]
    cleaned = ["name", "start_date", "end_date"]
    rows = df.filter("geometry IS NOT NULL").select(
        *[
            F.abs("osm_id").alias("osm_id") if c == "osm_id" else F.col(c)
            for c in df.columns
            if c not in replaced
        ],
        *[empty_to_null(F.col(c)).alias(c) for c in cleaned],
        *[v.alias(k) for k, v in decimal_dates().items()],
        *language_columns(languages, F.col("tags")),
        "geometry",
    )
    order = [F.col(c).asc_nulls_last() for c in ("start_decdate", "end_decdate", "name")]
    order += [F.col(c).asc_nulls_last() for c in ("id", "type") if c in rows.columns]
    return first_per_key(rows, keys, order)


def admin_labels(areas: DataFrame, members: DataFrame, where: str | None = None) -> DataFrame:
    """Label points of named areas whose relation brings no label of its own."""
    labelled = members.filter("role = 'label' AND type = 'administrative'")
    own = areas.filter("geometry IS NOT NULL AND name IS NOT NULL AND name <> ''")
    return label_points(filtered(not_in(own, "osm_id", labelled, "osm_id"), where))


def _place(df: DataFrame, area_m2: Column, languages: Sequence[str]) -> DataFrame:
    return df.select(
        "geometry",
        "osm_id",
        empty_to_null(F.col("name")).alias("name"),
        "type",
        *[empty_to_null(F.col(c)).alias(c) for c in ("start_date", "end_date")],
        *[v.alias(k) for k, v in decimal_dates().items()],
        area_m2.alias("area_m2"),
        tag(F.col("tags"), "capital").alias("capital"),
        *language_columns(languages, F.col("tags")),
    )


def place_points(
    areas: DataFrame,
    points: DataFrame,
    area_types: Sequence[str],
    point_types: Sequence[str],
    languages: Sequence[str] = (),
) -> DataFrame:
    """Labels of named places drawn as areas, and all places drawn as points."""
    named_areas = of_types(areas.filter("name IS NOT NULL AND name <> ''"), area_types)
    labels = label_points(_place(named_areas, half_even_long(F.col("area")), languages))
    nodes = _place(of_types(points, point_types), F.lit(None).cast("long"), languages)
    return labels.unionByName(nodes)


def place_areas(
    areas: DataFrame, types: Sequence[str] | None = None, languages: Sequence[str] = ()
) -> DataFrame:
    size = half_even_long(area(F.col("geometry")))
    return _place(of_types(areas, types), size, languages)


def communication_lines(lines: DataFrame, multilines: DataFrame) -> DataFrame:
    """Communication ways and relation members as one view."""

    def shaped(df: DataFrame, source: str, osm_id: Column) -> DataFrame:
        text = ["name", "start_date", "end_date", *COMMUNICATION, *CARRIER]
        return df.select(
            "id",
            osm_id.alias("osm_id"),
            "geometry",
            "type",
            *[empty_to_null(F.col(c)).alias(c) for c in text],
            *[v.alias(k) for k, v in decimal_dates().items()],
            "tags",
            F.lit(source).alias("source_type"),
        )

    ways = shaped(lines.filter("geometry IS NOT NULL"), "line", F.col("osm_id"))
    members = multilines.filter(F.col("geometry.gtype").isin(LINES))
    return ways.unionByName(shaped(members, "relation", F.abs("osm_id")))


def lakes_union(tables: Mapping[str, DataFrame], tolerance: float = 100) -> DataFrame:
    """Lake tables in their given order under one numbering."""
    parts = [
        df.filter("geometry IS NOT NULL").select(
            "name", "geometry", F.lit(source).alias("source_table"), F.lit(at).alias("_at"), "ogc_fid"
        )
        for at, (source, df) in enumerate(tables.items())
    ]
    thin = simplify(reduce(DataFrame.unionByName, parts), tolerance, preserve=False)
    kept = thin.filter("geometry IS NOT NULL")
    order = [F.col("_at"), F.col("name").asc_nulls_last(), F.col("ogc_fid")]
    return number_rows(kept, order).select("id", "name", "geometry", "source_table")


def land_band(land: DataFrame, tolerance: float) -> DataFrame:
    """Land polygons of one band; those that vanish at the tolerance are left out."""
    rows = land.filter("geometry IS NOT NULL").select("ogc_fid", "geometry")
    return simplify(rows, tolerance, preserve=False).filter("geometry IS NOT NULL")
