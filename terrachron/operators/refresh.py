"""Rebuild only the parts of a view whose inputs changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrachron.operators.skew import same_keys
from terrachron.session import materialize


def refresh_groups(
    view: DataFrame,
    rows: DataFrame,
    changed: DataFrame,
    keys: Sequence[str],
    build: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """A view of independent key groups after some rows changed.

    Untouched groups are taken over; touched ones are built again from all
    their rows. ``changed`` must hold the keys from before and after the edit.
    """
    touched = changed.select(*keys).distinct()
    kept = view.join(touched, same_keys(view, touched, keys), "left_anti")
    inputs = rows.join(touched, same_keys(rows, touched, keys), "left_semi")
    return kept.unionByName(build(inputs))


class GroupedView:
    """A stored view of independent key groups, in partitions by a hash of the keys.

    A refresh replaces only the partitions with changed groups, by a dynamic partition
    overwrite. Every partition it touches holds one row that is no group, so
    that a partition without groups is replaced like any other.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], parts: int = 64):
        """``parts`` should grow with the view, so that a part stays a few files."""
        self.spark, self.path, self.keys, self.parts = spark, path, list(keys), parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, replace: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", replace)
        writer.partitionBy("part").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows.withColumns({"part": self._part(), "is_group": F.lit(True)}), "static")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path).filter("is_group").drop("is_group")

    def read(self) -> DataFrame:
        return self._stored().drop("part")

    def refresh(self, rows: DataFrame, changed: DataFrame, build: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Bring the view up to date with ``rows`` after the groups in ``changed`` changed.

        ``changed`` must hold the keys from before and after the edit. Returns the parts
        replaced; at most ``parts`` numbers come to the driver.
        """
        touched = materialize(changed.select(*self.keys).distinct(), "touched")
        parts = sorted(r["part"] for r in touched.select(self._part().alias("part")).distinct().collect())
        if not parts:
            return parts
        stored = self._stored().filter(F.col("part").isin(parts))
        kept = stored.join(touched, same_keys(stored, touched, self.keys), "left_anti").drop("part")
        made = build(rows.join(touched, same_keys(rows, touched, self.keys), "left_semi"))
        fresh = kept.unionByName(made).withColumns({"part": self._part(), "is_group": F.lit(True)})
        marks = self.spark.createDataFrame([(p, False) for p in parts], "part int, is_group boolean")
        # made aside: the rows kept are read from the partitions that are replaced
        self._write(materialize(fresh.unionByName(marks, allowMissingColumns=True), "parts"), "dynamic")
        return parts
