"""Ordered work inside groups of any size.

A window over a group runs in one task. ``OrderedGroups`` keeps that plain
form for ordinary groups and cuts the few oversized ones into consecutive
chunks by a range partitioning, runs the window inside each chunk, and carries
one small value per chunk over to the next. No row is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.session import checkpoint

GROUP_ROWS_SETTING = "terrachron.groupRows"
GROUP_ROWS = 2_000_000
#: Rows sorted by one task.
TASK_ROWS = 250_000


def group_rows(df: DataFrame) -> int:
    """Rows one task may hold for one group."""
    return int(df.sparkSession.conf.get(GROUP_ROWS_SETTING, str(GROUP_ROWS)))


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Rows dealt out by ``keys`` to as many tasks as ``rows`` rows need, so that no task grows with the table."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on NULL-safe keys and keep the left copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_r_{key}"])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


class HotGroups:
    """Groups above the row limit: a small table, at most rows / limit long."""

    def __init__(self, df: DataFrame, keys: Sequence[str], limit: int | None = None):
        self.keys = list(keys)
        self.limit = limit or group_rows(df)
        self.table = (
            df.groupBy(*self.keys)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .filter(F.col("_rows") > self.limit)
        )
        self.rows = self.table.agg(F.sum("_rows")).first()[0] or 0

    @classmethod
    def none(cls, keys: Sequence[str]) -> HotGroups:
        """For rows whose groups are known to be small."""
        empty = object.__new__(cls)
        empty.keys, empty.limit, empty.table, empty.rows = list(keys), GROUP_ROWS, None, 0
        return empty

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        if not self.rows:
            return df, None
        hot_keys = self.table.select(*self.keys)
        condition = same_keys(df, hot_keys, self.keys)
        return df.join(hot_keys, condition, "left_anti"), df.join(hot_keys, condition, "left_semi")


class OrderedGroups:
    """Rows grouped by ``keys`` and put in ``order`` inside each group.

    ``order`` is a list of sort columns that together are total within a group.
    ``hot`` may carry an earlier measurement on a subset of the keys.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[Column],
        hot: HotGroups | None = None,
        limit: int | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        hot = hot or HotGroups(df, self.keys, limit)
        self.plain, oversized = hot.split(df)
        self.split = None
        if oversized is not None:
            pieces = max(2, -(-hot.rows // hot.limit))
            ranged = oversized.repartitionByRange(
                pieces, *[F.col(k) for k in self.keys], *self.order
            ).withColumn("_chunk", F.spark_partition_id())
            self.split = checkpoint(ranged)

    def _next(self, plain: DataFrame, split: DataFrame | None) -> OrderedGroups:
        clone = object.__new__(OrderedGroups)
        clone.keys, clone.order, clone.plain, clone.split = self.keys, self.order, plain, split
        return clone

    def _window(self, chunked: bool):
        keys = self.keys + (["_chunk"] if chunked else [])
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _carry(self, frame: DataFrame, per_chunk: DataFrame, value: str) -> DataFrame:
        return attach(frame, per_chunk.select(*self.keys, "_chunk", value), [*self.keys, "_chunk"])

    def map(self, step: Callable[[DataFrame], DataFrame]) -> OrderedGroups:
        """Apply a row-wise step."""
        return self._next(step(self.plain), step(self.split) if self.split is not None else None)

    def _neighbour(self, value: str, name: str, back: bool) -> OrderedGroups:
        shift = F.lag if back else F.lead
        plain = self.plain.withColumn(name, shift(value).over(self._window(False)))
        split = self.split
        if split is not None:
            window = self._window(True)
            marked = split.withColumns(
                {
                    name: shift(value).over(window),
                    "_at_edge": shift(F.lit(1)).over(window).isNull(),
                    "_far_edge": (F.lead if back else F.lag)(F.lit(1)).over(window).isNull(),
                }
            )
            chunks = Window.partitionBy(*self.keys).orderBy("_chunk")
            edges = (
                marked.filter("_far_edge")
                .select(*self.keys, "_chunk", F.col(value).alias("_edge"))
                .withColumn("_edge", shift("_edge").over(chunks))
            )
            split = (
                self._carry(marked, edges, "_edge")
                .withColumn(name, F.when(F.col("_at_edge"), F.col("_edge")).otherwise(F.col(name)))
                .drop("_at_edge", "_far_edge", "_edge")
            )
        return self._next(plain, split)

    def lag(self, value: str, name: str) -> OrderedGroups:
        """Value of the row before, within the group."""
        return self._neighbour(value, name, back=True)

    def lead(self, value: str, name: str) -> OrderedGroups:
        """Value of the row after, within the group."""
        return self._neighbour(value, name, back=False)

    def running_sum(self, value: Column | str, name: str) -> OrderedGroups:
        """Sum of all rows up to and with this one."""
        value = F.col(value) if isinstance(value, str) else value

        def running(frame: DataFrame, chunked: bool) -> DataFrame:
            frame_window = self._window(chunked).rowsBetween(Window.unboundedPreceding, 0)
            return frame.withColumn(name, F.sum(value).over(frame_window))

        split = self.split
        if split is not None:
            chunks = Window.partitionBy(*self.keys).orderBy("_chunk")
            before = chunks.rowsBetween(Window.unboundedPreceding, -1)
            sums = (
                split.groupBy(*self.keys, "_chunk")
                .agg(F.sum(value).alias("_sum"))
                .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
            )
            split = self._carry(running(split, True), sums, "_offset")
            split = split.withColumn(name, F.col(name) + F.col("_offset")).drop("_offset")
        return self._next(running(self.plain, False), split)

    def row_number(self, name: str) -> OrderedGroups:
        """Position in the group, from 1."""
        plain = self.plain.withColumn(name, F.row_number().over(self._window(False)).cast("long"))
        split = None
        if self.split is not None:
            only_split = self._next(self.split.drop("_chunk").limit(0), self.split)
            split = only_split.running_sum(F.lit(1).cast("long"), name).split
        return self._next(plain, split)

    def frame(self) -> DataFrame:
        """All rows again, with the added columns."""
        if self.split is None:
            return self.plain
        return self.plain.unionByName(self.split.drop("_chunk"))


def running_sum_of_peers(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str
) -> DataFrame:
    """Running sum where rows with an equal ``order`` share one value.

    Peers are summed first, so a heavily repeated value costs one row.
    """
    sums = df.groupBy(*keys, order).agg(F.sum(value).alias("_sum"))
    running = OrderedGroups(sums, keys, [F.col(order).asc_nulls_last()]).running_sum("_sum", name)
    return attach(df, running.frame().drop("_sum"), [*keys, order])


def paged_lists(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    page_rows: int = 10_000,
) -> DataFrame:
    """Ordered list per group, in pages of at most ``page_rows`` entries.

    Ordinary groups come out as their single page 0; a group of any size stays
    whole over its pages.
    """
    numbered = (
        OrderedGroups(df.withColumn("_value", value), keys, order)
        .row_number("_n")
        .frame()
        .withColumn("page", F.floor((F.col("_n") - 1) / page_rows).cast("int"))
    )
    lists = numbered.groupBy(*keys, "page").agg(
        # Values may hold maps, which have no order: compare positions only.
        F.array_sort(
            F.collect_list(F.struct("_n", "_value")), lambda a, b: F.signum(a["_n"] - b["_n"]).cast("int")
        ).alias("_list")
    )
    return lists.select(*keys, "page", F.transform("_list", lambda e: e["_value"]).alias(name))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank filter is pushed below the shuffle, so each task sends at most one
    row per key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, name: str
) -> DataFrame:
    """The first ``count`` rows per key with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= count)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "id") -> DataFrame:
    """Consecutive numbers from 1 in a global order, without a single-task window.

    Rows are range partitioned and sorted once and kept by a checkpoint; the
    number is the offset of the partition plus the position inside it.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = checkpoint(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_position": position})
    )
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per partition.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_position") + 1)
        .drop("_part", "_position", "_offset")
    )
