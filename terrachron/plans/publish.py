"""Build a table aside, check it, then put it in the place of the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from terrachron.functions.geometry import meets_box, to_degrees
from terrachron.plans.cluster import BOX_COLUMNS, clustered, in_box

#: One row for each table that was published: its folder is one of two that take turns.
LOG = "_published"
LOG_SCHEMA = "name string, build long, slot int, levels int"


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a key with a NULL never clashes."""
    return df.dropna(subset=list(keys)).groupBy(*keys).count().filter("count > 1")


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/{LOG}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _current(spark: SparkSession, root: str, name: str) -> Row | None:
    """The last publication of a table."""
    log = _log(spark, root)
    if log is None:
        return None
    return log.filter(F.col("name") == name).agg(F.max_by(F.struct("build", "slot", "levels"), "build").alias("last")).first()["last"]


def publish(df: DataFrame, root: str, name: str, unique: Sequence[str] = (), levels: int = 0) -> None:
    """Write ``name`` below ``root``; readers see the old table until the new one is complete.

    A table has two folders that take turns. The new rows overwrite the one that is not
    current, are checked, and one row added to the log of publications then makes it current. The
    table before stays for readers that have it open. The new table is rejected when
    ``unique`` columns repeat.

    Rows with a box are sorted by it inside each file. With ``levels`` they lie along a Hilbert curve
    and are partitioned by its cells: choose as many as make 4 ** levels partitions of a useful size.
    """
    spark = df.sparkSession
    last = _current(spark, root, name)
    slot = 1 - last["slot"] if last else 0
    path = f"{root}/{name}/slot={slot}"
    if levels:
        clustered(df, levels).write.mode("overwrite").partitionBy(*BOX_COLUMNS).parquet(path)
    else:
        by = [c for c in ("xmin", "ymin") if c in df.columns]
        (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(path)
    if unique:
        clash = duplicate_keys(spark.read.parquet(path), unique).limit(3).collect()
        if clash:
            raise ValueError(f"{name}: {', '.join(unique)} are not unique, e.g. {clash}")
    build = last["build"] + 1 if last else 0
    row = [F.lit(name).alias("name"), F.lit(build).cast("long").alias("build"), F.lit(slot).alias("slot"), F.lit(levels).alias("levels")]
    spark.range(1).coalesce(1).select(*row).write.mode("append").parquet(f"{root}/{LOG}")


def is_published(spark: SparkSession, root: str, name: str) -> bool:
    return _current(spark, root, name) is not None


def open_view(spark: SparkSession, root: str, name: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A published table, or its rows whose box meets the given xmin, ymin, xmax, ymax."""
    last = _current(spark, root, name)
    if last is None:
        raise FileNotFoundError(f"{root}/{name}")
    rows = spark.read.parquet(f"{root}/{name}/slot={last['slot']}")
    if box is None:
        return rows.drop(*BOX_COLUMNS)
    return in_box(rows, last["levels"], *box) if last["levels"] else rows.filter(meets_box(*box))


def write_by_changeset(df: DataFrame, path: str) -> None:
    """One gzip folder per changeset.

    Tasks take ranges of changesets and, inside one, of row hashes. So small changesets
    share a task and have a file each, and a changeset of any size is cut into as many
    ranges as its rows fill.
    """
    spread = df.repartitionByRange(F.col("changeset"), F.xxhash64(*df.columns))
    spread.write.mode("overwrite").partitionBy("changeset").option("compression", "gzip").json(path)


def languages_as_geojson(languages: DataFrame) -> DataFrame:
    """One GeoJSON feature per language with a box, in degrees."""
    west, south = to_degrees(F.col("xmin"), F.col("ymin"))
    east, north = to_degrees(F.col("xmax"), F.col("ymax"))
    ring = F.array(*[F.array(x, y) for x, y in ((west, south), (west, north), (east, north), (east, south), (west, south))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct("alias", "key_name", "count", "is_new")
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    rows = languages.filter(F.col("xmin").isNotNull())
    return rows.select("alias", F.to_json(feature).alias("feature"))
