"""Which languages the name tags use, and the columns made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from terrachron.functions.geometry import grow_point_box
from terrachron.functions.text import key_alias, language_key

BOX = ["xmin", "ymin", "xmax", "ymax"]


def search_languages(layers: list[DataFrame], strict_reference: bool = False) -> DataFrame:
    """Count and bounding box of every language key over all layers.

    Each layer has tags and xmin, ymin, xmax, ymax.
    """
    rows = reduce(
        DataFrame.unionByName,
        [d.select("tags", *BOX).filter("tags is not null and xmin is not null") for d in layers],
    )
    keys = rows.select(F.explode(F.map_keys("tags")).alias("language_key"), *BOX)
    found = keys.filter(language_key(F.col("language_key"), strict_reference))
    return found.groupBy("language_key").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.min("xmin").alias("xmin"),
        F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"),
        F.max("ymax").alias("ymax"),
    ).withColumn("alias", key_alias(F.col("language_key")))


def summarize_languages(found: DataFrame, minimum: int) -> DataFrame:
    """Languages by alias, with at least ``minimum`` features; point boxes are widened."""
    merged = found.groupBy("alias").agg(
        F.min("language_key").alias("key_name"),
        F.sum("total_count").alias("count"),
        F.min("xmin").alias("xmin"),
        F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"),
        F.max("ymax").alias("ymax"),
    ).filter(F.col("count") >= minimum)
    grown = grow_point_box(*[F.col(c) for c in BOX])
    return merged.select("alias", "key_name", "count", *[g.alias(c) for g, c in zip(grown, BOX)])


def update_languages(
    known: DataFrame | None, found: DataFrame, minimum: int, now, force: bool = False
) -> DataFrame:
    """New state of the language table.

    Known rows keep their key and are no longer new; count, box and date follow
    the search. Rows that are not found any more stay. ``force`` starts over.
    """
    fresh = summarize_languages(found, minimum)
    stamp = F.lit(now).cast("timestamp")
    if known is None or force:
        return fresh.withColumns({"date_added": stamp, "is_new": F.lit(True)})
    old = known.select("alias", *[F.col(c).alias(f"_old_{c}") for c in ("key_name", "count", "date_added", *BOX)])
    new = fresh.withColumn("_found", F.lit(True))
    both = old.join(new, "alias", "full")
    seen = F.col("_found").isNotNull()

    def newest(column: str):
        return F.when(seen, F.col(column)).otherwise(F.col(f"_old_{column}")).alias(column)

    return both.select(
        "alias",
        F.coalesce("_old_key_name", "key_name").alias("key_name"),
        newest("count"),
        *[newest(c) for c in BOX],
        F.when(seen, stamp).otherwise(F.col("_old_date_added")).alias("date_added"),
        F.col("_old_key_name").isNull().alias("is_new"),
    )


def language_keys(languages: DataFrame) -> list[str]:
    """Keys for ``language_columns``, sorted.

    A column list has to be known to plan a view, so all keys come to the driver; how many
    there are follows from the minimum count given to ``update_languages``.
    """
    return sorted(r.key_name for r in languages.select("key_name").distinct().collect())


def tag_key_stats(elements: DataFrame, minimum: int = 10) -> DataFrame:
    """Elements per tag key."""
    keys = elements.select(F.explode(F.map_keys("tags")).alias("key"))
    return keys.groupBy("key").count().filter(F.col("count") >= minimum)


def tag_pair_stats(elements: DataFrame, minimum: int = 10) -> DataFrame:
    """Elements per combination of two keys; the pairs of one element stay in its row."""
    keys = F.array_sort(F.map_keys("tags"))
    first = elements.select(keys.alias("keys")).select("keys", F.posexplode("keys").alias("at", "key"))
    rest = F.slice("keys", F.col("at") + 2, F.greatest(F.size("keys") - F.col("at") - 1, F.lit(0)))
    pairs = first.select("key", F.explode(rest).alias("other_key"))
    return pairs.groupBy("key", "other_key").count().filter(F.col("count") >= minimum)


def relation_type_stats(elements: DataFrame, minimum: int = 10) -> DataFrame:
    """Relations per value of their ``type`` tag."""
    kind = F.try_element_at("tags", F.lit("type"))
    types = elements.filter(F.col("type") == "relation").select(kind.alias("relation_type"))
    counts = types.filter(F.col("relation_type").isNotNull()).groupBy("relation_type").count()
    return counts.filter(F.col("count") >= minimum)
