"""Small text formats and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TILE_LINE = r"^(\d+)/(\d+)/(\d+)"


def tile_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``z/x/y`` at the start of a line; other lines are dropped."""
    parts = [F.regexp_extract(column, TILE_LINE, i).try_cast("int") for i in (1, 2, 3)]
    rows = lines.select(*[p.alias(n) for p, n in zip(parts, ("z", "x", "y"))])
    return rows.dropna()


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    return tile_lines(spark.read.text(path))


def _setting(text: Column, key: str) -> Column:
    return F.trim(F.nullif(F.regexp_extract(text, rf"(?m)^\s*{key}\s*=(.*)$", 1), F.lit("")))


def parse_state(text: Column) -> dict[str, Column]:
    """Sequence and time of a replication state text of ``key=value`` lines.

    Colons may be escaped; a bad time becomes NULL, a missing sequence 0.
    """
    stamp = F.replace(_setting(text, "timestamp"), F.lit("\\:"), F.lit(":"))
    sequence = F.coalesce(_setting(text, "sequenceNumber").try_cast("long"), F.lit(0).cast("long"))
    moment = F.replace(F.regexp_replace(stamp, "Z$", ""), F.lit("T"), F.lit(" "))
    return {"sequence": sequence, "timestamp": moment.try_cast("timestamp_ntz")}


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per state file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), *[c.alias(n) for n, c in parse_state(F.col("value")).items()])


def listed_files(spark: SparkSession, path: str, modified_after: str | None = None, pattern: str = "*") -> DataFrame:
    """Name and md5 of the files below a folder, and the folder each is in.

    The hash needs a file's whole content in one row, so this is for files of
    moderate size, such as change documents.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.load(path)
    return files.select(
        F.substring_index("path", "/", -1).alias("name"),
        F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("folder"),
        "length",
        "modificationTime",
        F.md5("content").alias("md5"),
    )


def changed_files(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files with ``status`` new, changed or unchanged against the tracked name and md5."""
    known = tracked.select(F.col("name"), F.col("md5").alias("_known"))
    status = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_known") != F.col("md5"), "changed")
        .otherwise("unchanged")
    )
    return files.join(known, "name", "left").withColumn("status", status).drop("_known")
