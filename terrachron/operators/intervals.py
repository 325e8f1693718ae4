"""Interval algebra over valid-time ranges in decimal years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions.dates import decimal_to_iso
from terrachron.operators.skew import HotGroups, OrderedGroups

# One day in decimal years, with room for leap years; and an open end.
DAY_GAP = 0.003
SEGMENT_GAP = 1.0 / 365.0
FAR_FUTURE = 9999.0


def gap_flag(start: Column, previous_end: Column, gap: float = DAY_GAP) -> Column:
    """1 where a new island begins; an unknown bound never begins one."""
    joined = previous_end.isNull() | start.isNull() | (start - previous_end < gap)
    return F.when(joined, 0).otherwise(1)


def new_segment_flag(start: Column, previous_end: Column) -> Column:
    """1 where there is no earlier end, or more than a day since it."""
    apart = previous_end.isNull() | (start - previous_end > F.lit(SEGMENT_GAP))
    return F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0)


def open_min(column: str) -> Column:
    """Minimum, or NULL when any value is NULL."""
    return F.when(~F.bool_or(F.col(column).isNull()), F.min(column))


def open_max(column: str) -> Column:
    """Maximum, or NULL when any value is NULL."""
    return F.when(~F.bool_or(F.col(column).isNull()), F.max(column))


def first_by_start(value: str, start: str, tie: str) -> Column:
    """Value of the row with the earliest start; unknown starts come first."""
    return F.min_by(value, F.struct(F.col(start).isNotNull(), F.col(start), F.col(tie)))


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    tie: str,
    start: str = "start_decdate",
    end: str = "end_decdate",
    first: Sequence[str] = (),
    largest: dict[str, str] | None = None,
    gap: float = DAY_GAP,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Merge the ranges of a group that touch or overlap the range before them.

    Only the range directly before is looked at. ``first`` columns come from the
    earliest row, ``largest`` maps output names to columns taken by maximum.
    """
    islands = (
        OrderedGroups(df, keys, [F.col(start).asc_nulls_first(), F.col(tie).asc_nulls_first()], hot)
        .lag(end, "_previous_end")
        .map(lambda d: d.withColumn("_gap", gap_flag(F.col(start), F.col("_previous_end"), gap)))
        .running_sum("_gap", "group_id")
        .frame()
    )
    merged = islands.groupBy(*keys, "group_id").agg(
        F.count(F.lit(1)).alias("merged_row_count"),
        open_min(start).alias("min_start_decdate"),
        open_max(end).alias("max_end_decdate"),
        *[first_by_start(c, start, tie).alias(c) for c in first],
        *[F.max(c).alias(name) for name, c in (largest or {}).items()],
    )
    return merged.withColumns(
        {
            "min_start_date_iso": decimal_to_iso(F.col("min_start_decdate")),
            "max_end_date_iso": decimal_to_iso(F.col("max_end_decdate")),
        }
    )


def cut_segments(
    df: DataFrame,
    key: str,
    start: str = "start_decdate",
    end: str = "end_decdate",
    keep_open_start: bool = False,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Consecutive segments between all known dates of a key.

    ``keep_open_start`` adds the segment before the first date, which is left
    out by default.
    """
    points = df.select(key, F.explode(F.array(start, end)).alias("seg_start"))
    points = points.filter(F.col("seg_start").isNotNull()).distinct()
    if keep_open_start:
        points = points.unionByName(points.select(key, F.lit(None).cast("double").alias("seg_start")).distinct())
    order = [F.col("seg_start").asc_nulls_first()]
    segments = OrderedGroups(points, [key], order, hot).row_number("seg").lead("seg_start", "seg_end")
    return segments.frame()


def join_overlapping(
    segments: DataFrame,
    ranges: DataFrame,
    key: str,
    start: str = "start_decdate",
    end: str = "end_decdate",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Pairs of disjoint numbered segments and the ranges that overlap them.

    Two sorted sweeps over segments and ranges together give each range its
    first and last segment number, so no pair is formed that is not a result.
    """
    low, high = float("-inf"), float("inf")
    columns = ranges.columns
    marks = segments.select(
        key,
        F.lit(0).alias("_is_range"),
        F.coalesce("seg_start", F.lit(low)).alias("_opens"),
        F.coalesce("seg_end", F.lit(FAR_FUTURE)).alias("_closes"),
    )
    spans = ranges.withColumns(
        {
            "_is_range": F.lit(1),
            "_closes": F.coalesce(start, F.lit(low)),
            "_opens": F.coalesce(end, F.lit(high)),
        }
    )
    both = marks.unionByName(spans, allowMissingColumns=True)
    hot = hot or HotGroups(both, [key])
    is_segment = F.lit(1) - F.col("_is_range")
    # Segments closed at or before the start of the range: the first overlap is the next one.
    closed = OrderedGroups(both, [key], [F.col("_closes"), F.col("_is_range")], hot)
    closed = closed.running_sum(is_segment, "_first").frame()
    # Segments opened before the end of the range: the last of them is the last overlap.
    opened = OrderedGroups(closed, [key], [F.col("_opens"), F.col("_is_range").desc()], hot)
    opened = opened.running_sum(is_segment, "_last").frame()
    reached = (
        opened.filter((F.col("_is_range") == 1) & (F.col("_first") < F.col("_last")))
        .withColumn("seg", F.explode(F.sequence(F.col("_first") + 1, F.col("_last"))))
        .select(*columns, "seg")
    )
    return reached.join(segments, [key, "seg"])
