"""Change documents and changeset lists in XML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ACTIONS = ["create", "modify", "delete"]
#: Blocks in one written file, about 80 MB of text before compression.
FILE_BLOCKS = 250_000
_FIELDS = (
    "_id: bigint, _version: int, _changeset: bigint, _timestamp: string, "
    "tag: array<struct<_k: string, _v: string>>"
)
# One row per action block; a lone child must still be read as an array.
BLOCK_SCHEMA = (
    f"way array<struct<{_FIELDS}, nd: array<struct<_ref: bigint>>>>, "
    f"relation array<struct<{_FIELDS}, member: array<struct<_type: string, _ref: bigint, _role: string>>>>"
)
CHANGESET_SCHEMA = (
    "_id bigint, _created_at string, _closed_at string, _min_lon double, _min_lat double, "
    "_max_lon double, _max_lat double"
)


def _moment(column: str) -> Column:
    """ISO time in UTC; NULL when it cannot be read."""
    text = F.replace(F.regexp_replace(column, "Z$", ""), F.lit("T"), F.lit(" "))
    return text.try_cast("timestamp_ntz")


def write_blocks(blocks: DataFrame, path: str, action: str) -> None:
    """Change documents with a block of one action for each row, compressed and of bounded size, as readers cannot split them."""
    writer = blocks.write.format("xml").option("rootTag", "osmChange").option("rowTag", action)
    writer.option("compression", "gzip").option("maxRecordsPerFile", FILE_BLOCKS).save(path)


def _elements(blocks: DataFrame, kind: str, action: str) -> DataFrame:
    rows = blocks.select(F.explode(kind).alias("e"))
    tags = F.map_from_entries(
        F.transform(
            F.coalesce("e.tag", F.array().cast("array<struct<_k:string,_v:string>>")),
            lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")),
        )
    )

    def count(children: str):
        return F.coalesce(F.array_size(children), F.lit(0))

    return rows.select(
        F.lit(action).alias("action"),
        F.lit(kind).alias("type"),
        F.col("e._id").alias("osm_id"),
        F.col("e._version").alias("version"),
        F.col("e._changeset").alias("changeset"),
        _moment("e._timestamp").alias("timestamp"),
        tags.alias("tags"),
        (count("e.nd") if kind == "way" else F.lit(0)).alias("node_count"),
        (count("e.member") if kind == "relation" else F.lit(-1)).alias("member_count"),
    )


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Ways and relations of change documents with their action; nodes are left out."""
    parts = []
    for action in ACTIONS:
        blocks = spark.read.format("xml").option("rowTag", action).schema(BLOCK_SCHEMA).load(path)
        parts += [_elements(blocks, kind, action) for kind in ("way", "relation")]
    return reduce(DataFrame.unionByName, parts)


def read_changesets(spark: SparkSession, path: str) -> DataFrame:
    """Changesets with times and box; one without a complete box has ``has_box`` false."""
    rows = spark.read.format("xml").option("rowTag", "changeset").schema(CHANGESET_SCHEMA).load(path)

    box = ["min_lon", "min_lat", "max_lon", "max_lat"]
    complete = reduce(lambda a, b: a & b, [F.col(f"_{c}").isNotNull() for c in box])
    return rows.select(
        F.col("_id").alias("id"),
        _moment("_created_at").alias("created_at"),
        _moment("_closed_at").alias("closed_at"),
        *[F.col(f"_{c}").alias(c) for c in box],
        complete.alias("has_box"),
    )
