"""Static land and lake polygons, already in EPSG:3857."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from terrachron.functions.geometry import GEOMETRY

STATIC_SCHEMA = (
    T.StructType()
    .add("ogc_fid", T.LongType())
    .add("name", T.StringType())
    .add("geometry", GEOMETRY)
)
# The three lake tables of the lakes view.
LAKE_TABLES = ["ne_10m_lakes", "ne_10m_lakes_europe", "ne_10m_lakes_north_america"]


def read_static(spark: SparkSession, path: str, source_table: str) -> DataFrame:
    """A static table stored as Parquet, or as JSON lines where files say so."""
    reader = spark.read.schema(STATIC_SCHEMA)
    is_json = bool(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path").head(1))
    rows = reader.json(path) if is_json else reader.parquet(path)
    return rows.filter(F.col("geometry").isNotNull()).withColumn("source_table", F.lit(source_table))
