"""Projections, filters and joins that the view builders share."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrachron.functions.geometry import area, length
from terrachron.functions.text import empty_to_null, rounded_decimal
from terrachron.operators.skew import OrderedGroups, attach


def cleaned_columns(df: DataFrame, overrides: Mapping[str, Column] | None = None) -> list[Column]:
    """Every column; text with '' as NULL, and named overrides instead of the default."""
    overrides = overrides or {}
    columns = []
    for f in df.schema:
        value = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            value = empty_to_null(value)
        columns.append(overrides.get(f.name, value).alias(f.name))
    return columns


def project_all(df: DataFrame, overrides: Mapping[str, Column] | None = None) -> DataFrame:
    return df.select(*cleaned_columns(df, overrides))


def project_without(df: DataFrame, drop: Iterable[str], extra: Sequence[str] = ()) -> DataFrame:
    """All columns but ``drop``, and but those that ``extra`` supplies again.

    ``extra`` holds SQL expressions of the form ``expression AS name``.
    """
    supplied = {e.rsplit(None, 1)[-1].strip("`\"") for e in extra}
    return df.select(*cleaned_columns(df.drop(*drop, *supplied)), *[F.expr(e) for e in extra])


def area_columns(value: Column | None) -> dict[str, Column]:
    """Rounded areas in square metres and square kilometres; NULLs for points."""
    if value is None:
        none = F.lit(None)
        return {
            "area": none.cast("double"),
            "area_m2": none.cast("decimal(20,1)"),
            "area_km2": none.cast("decimal(20,1)"),
        }
    exact = value.cast("decimal(30,10)")
    return {"area": value, "area_m2": rounded_decimal(value), "area_km2": rounded_decimal(exact / 1_000_000)}


def length_columns(value: Column) -> dict[str, Column]:
    """Rounded lengths in metres and kilometres."""
    exact = value.cast("decimal(30,10)")
    return {"length": value, "length_m": rounded_decimal(value), "length_km": rounded_decimal(exact / 1_000)}


def filtered(df: DataFrame, where: str | Column | None) -> DataFrame:
    """An optional free-form filter; none when absent or empty."""
    if where is None or (isinstance(where, str) and not where.strip()):
        return df
    return df.filter(where)


def larger_than(df: DataFrame, minimum: float, geometry: str = "geometry") -> DataFrame:
    """Base views: computed area strictly above the minimum."""
    return df.filter(area(F.col(geometry)) > minimum) if minimum > 0 else df


def at_least(df: DataFrame, minimum: float, column: str = "area") -> DataFrame:
    """Derived views: stored area at or above the minimum."""
    return df.filter(F.col(column) >= minimum) if minimum > 0 else df


def longer_than(df: DataFrame, minimum: float, geometry: str = "geometry") -> DataFrame:
    return df.filter(length(F.col(geometry)) > minimum) if minimum > 0 else df


def of_types(df: DataFrame, types: Sequence[str] | None, column: str = "type") -> DataFrame:
    """Rows whose type is in the list; no list means all."""
    return df.filter(F.col(column).isin(list(types))) if types else df


def named(df: DataFrame) -> DataFrame:
    """Rows with a name in any language."""
    has_name = F.col("name").isNotNull() & (F.col("name") != "")
    for column in df.columns:
        if column.startswith("name_"):
            has_name = has_name | F.col(column).isNotNull()
    return df.filter(has_name)


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL ``NOT IN``: one NULL on the right empties the result, NULLs on the left never pass.

    The NULL test is a one-row aggregate inside the plan, so the rest is a plain anti
    join that shuffles on the key instead of a broadcast of the right side.
    """
    keys = other.select(F.col(other_column).alias("_other"))
    nulls = keys.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("_other").isNull()).alias("_nulls"))
    missing = df.join(keys, F.col(column) == F.col("_other"), "left_anti")
    passes = (F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())
    return missing.crossJoin(F.broadcast(nulls)).filter(passes).drop("_rows", "_nulls")


def lookup_in_tables(tables: Mapping[str, DataFrame], wanted: DataFrame, key: str = "osm_id") -> DataFrame:
    """Which tables hold a wanted id; one hit per table and id."""
    ids = wanted.select(key).distinct()
    parts = [
        df.select(F.lit(name).alias("tbl"), key).join(ids, key, "left_semi").distinct()
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def rows_of_members(relations: DataFrame, members: DataFrame, rows: DataFrame, way: str) -> DataFrame:
    """Relation ids to the rows of their member ways."""
    pairs = relations.join(members.select("osm_id", "member"), "osm_id").distinct()
    return pairs.join(rows.withColumnRenamed(way, "member"), "member")


def missing_ids(existing: DataFrame, column: str, start: int, step: int, last: int, limit: int | None = None) -> DataFrame:
    """Ids start, start + step, ... up to ``last`` that do not occur yet."""
    end = last if limit is None else min(last, start + step * (limit - 1))
    candidates = existing.sparkSession.range(start, end + 1, step).withColumnRenamed("id", column)
    return candidates.join(existing.select(column), column, "left_anti")


def sample_per_group(
    df: DataFrame, group: str, percent: float, seed: int, identity: Sequence[str]
) -> DataFrame:
    """A repeatable share of each group: at least one row, rounded up.

    Rows are ranked by a seeded hash, so the same rows come out on every run.
    """
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    ranked = OrderedGroups(
        df.withColumn("_ticket", ticket), [group], [F.col("_ticket"), *[F.col(c) for c in identity]]
    ).row_number("_n").frame()
    wanted = F.greatest(F.lit(1), F.ceil(F.col("_size") * percent / 100))
    return attach(ranked, sizes, [group]).filter(F.col("_n") <= wanted).drop("_ticket", "_n", "_size")


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """One page of a sorted report, pages counted from 1."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.ceil(F.count(F.lit(1)) / size).alias("pages"))
