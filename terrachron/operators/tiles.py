"""Features on map tiles, zoom bands, and expiry of cached tiles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.functions import tiles
from terrachron.operators.skew import number_rows, paged_lists

TOP_ZOOM = 20
BAND_SCHEMA = (
    "group string, layer string, source_layer string, view string, lo int, hi int, max_zoom int, "
    "exclude_columns array<string>"
)


def band_table(spark: SparkSession, bands: Iterable[tuple]) -> DataFrame:
    """Serving bands as a table: which view answers a layer at a zoom."""
    return spark.createDataFrame(list(bands), BAND_SCHEMA)


def dispatch_bands(requests: DataFrame, bands: DataFrame) -> DataFrame:
    """The view for each (layer, z); nothing below the first zoom of a layer."""
    # The band table has a fixed size, one row per view.
    small = F.broadcast(bands)
    return requests.join(small, "layer").filter(F.col("z").between(F.col("lo"), F.col("hi")))


def ranges_of_box(df: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Ranges ``_x0`` to ``_x1`` and ``_y0`` to ``_y1`` of tiles that meet min_lon, min_lat, max_lon, max_lat, at every zoom.

    Boxes over the antimeridian are taken in two halves.
    """
    if max(zooms) > TOP_ZOOM:
        raise ValueError(f"zoom cannot exceed {TOP_ZOOM}")
    west, east = F.col("min_lon"), F.col("max_lon")
    halves = F.when(
        west > east,
        F.array(F.struct(F.lit(-180.0).alias("w"), east.alias("e")), F.struct(west.alias("w"), F.lit(180.0).alias("e"))),
    ).otherwise(F.array(F.struct(west.alias("w"), east.alias("e"))))
    boxes = df.withColumn("_box", F.explode(halves)).withColumns(
        {
            "_w": F.greatest(F.lit(-180.0), F.col("_box.w")),
            "_e": F.least(F.lit(180.0), F.col("_box.e")),
            "_s": F.greatest(F.lit(-tiles.MAX_LAT), F.col("min_lat")),
            "_n": F.least(F.lit(tiles.MAX_LAT), F.col("max_lat")),
            "z": F.explode(F.array(*[F.lit(z) for z in zooms])),
        }
    )
    z = F.col("z")
    ranges = boxes.withColumns(
        {
            "_x0": tiles.tile_x(F.col("_w"), z),
            "_x1": tiles.tile_x(F.col("_e") - tiles.CORNER, z),
            "_y0": tiles.tile_y(F.col("_n"), z),
            "_y1": tiles.tile_y(F.col("_s") + tiles.CORNER, z),
        }
    )
    return ranges.filter((F.col("_x0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_y1")))


def tiles_of_box(df: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """All tiles of geographic boxes, as rows."""
    return _tiles_in_ranges(ranges_of_box(df, zooms), df.columns)


def _tiles_in_ranges(whole: DataFrame, columns: Sequence[str]) -> DataFrame:
    by_x = whole.withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    return by_x.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).select(*columns, "z", "x", "y")


def tiles_of_features(df: DataFrame, zooms: Sequence[int] | None = None) -> DataFrame:
    """Tiles whose envelope meets xmin, ymin, xmax, ymax (metres).

    Zooms come from the list, or from the columns ``lo`` and ``hi`` of the row.
    A box that ends exactly on a tile edge touches the next tile too.
    """
    return _tiles_in_ranges(_ranges_of_features(df, zooms), df.columns)


def _ranges_of_features(df: DataFrame, zooms: Sequence[int] | None) -> DataFrame:
    zoom = (
        F.explode(F.array(*[F.lit(z) for z in zooms])) if zooms else F.explode(F.sequence("lo", "hi"))
    )
    rows = df.filter(F.col("xmin").isNotNull()).withColumn("z", zoom)
    z = F.col("z")
    ranges = rows.withColumns(
        {
            "_x0": tiles.metre_tile_x(F.col("xmin"), z),
            "_x1": tiles.metre_tile_x(F.col("xmax"), z),
            "_y0": tiles.metre_tile_y(F.col("ymax"), z),
            "_y1": tiles.metre_tile_y(F.col("ymin"), z),
        }
    )
    return ranges.filter((F.col("_x0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_y1")))


def features_on_tiles(df: DataFrame, wanted: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Feature and tile pairs for a table of wanted tiles (z, x, y).

    The tiles of a feature are not listed. At a level where its range is at most two cells wide and
    high it meets the ancestors of the wanted tiles, and the range decides. So a feature
    makes four rows at most at any zoom, and a tile one for each level above it.
    """
    ranges = _ranges_of_features(df, zooms)
    wide = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    ranges = ranges.withColumn("_up", F.when(wide <= 0, 0).otherwise(F.floor(F.log2(wide)) + 1).cast("int"))
    for axis in "xy":
        first, last = (F.expr(f"shiftright(_{axis}{end}, _up)") for end in "01")
        ranges = ranges.withColumn(f"_c{axis}", F.explode(F.sequence(first, last)))
    tiles_ = wanted.select("z", "x", "y").distinct()
    tiles_ = tiles_.withColumn("_up", F.explode(F.sequence(F.lit(0), F.col("z").cast("int"))))
    tiles_ = tiles_.withColumns({f"_c{axis}": F.expr(f"shiftright({axis}, _up)") for axis in "xy"})
    met = ranges.join(tiles_, ["z", "_up", "_cx", "_cy"])
    inside = F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1"))
    return met.filter(inside).select(*df.columns, "z", "x", "y")


def tile_features(df: DataFrame, max_zoom: int | None, zooms: Sequence[int] | None = None) -> DataFrame:
    """Features per tile with coordinates on the integer grid of the tile.

    Geometries are kept whole: there is no clipping to the tile buffer. Adds
    extent, buffer and ``grid``, the vertices as (x, y) with y pointing down.
    """
    placed = tiles_of_features(df, zooms)
    edge = tiles.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    band = F.lit(max_zoom).cast("int")
    placed = placed.withColumns(
        {
            "extent": tiles.extent(band),
            "buffer": tiles.buffer(band),
            "_left": edge["xmin"],
            "_top": edge["ymax"],
            "_size": tiles.tile_size(F.col("z")),
        }
    )

    def snap(offset):
        return F.floor(offset / F.col("_size") * F.col("extent") + 0.5).cast("int")

    def on_grid(v):
        return F.struct(snap(v["x"] - F.col("_left")).alias("x"), snap(F.col("_top") - v["y"]).alias("y"))

    grid = F.transform(
        F.col("geometry.parts"), lambda part: F.transform(part, lambda ring: F.transform(ring, on_grid))
    )
    return placed.withColumn("grid", grid).drop("_left", "_top", "_size")


def composite_tiles(features: DataFrame, value, page_rows: int = 10_000) -> DataFrame:
    """All features of a group on one tile, in pages of bounded size.

    ``features`` has group, layer, osm_id, z, x and y.
    """
    order = [F.col("layer"), F.col("osm_id")]
    return paged_lists(features, ["group", "z", "x", "y"], order, value, "features", page_rows)


def expand_prefixes(df: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Distinct ``z/x`` prefixes of each tile, its parents and its children.

    ``df`` has z and x, or z and ranges ``_x0`` to ``_x1``, as prefixes do not need y. Children are counted on the shortened x, so the work follows the number of
    prefixes and not the number of tiles.
    """
    wanted = F.explode(F.array(*[F.lit(z) for z in sorted(set(zooms))]))
    first, last = ("_x0", "_x1") if "_x0" in df.columns else ("x", "x")
    rows = df.select("z", *[F.col(c).cast("long").alias(n) for c, n in ((first, "_first"), (last, "_last"))]).distinct()
    rows = rows.select("z", "_first", "_last", wanted.alias("to_z"))
    above = F.col("to_z") <= F.col("z")
    up = {c: F.expr(f"shiftright({c}, greatest(z - to_z, 0))") for c in ("_first", "_last")}
    low = F.expr("shiftleft(_first, greatest(to_z - z, 0))")
    high = F.expr("shiftleft(_last + 1, greatest(to_z - z, 0)) - 1")
    bounds = rows.withColumns(
        {"_low": F.when(above, up["_first"]).otherwise(low), "_high": F.when(above, up["_last"]).otherwise(high)}
    )
    # x up to 99 counts singly, up to 999 by tens, beyond by hundreds.
    ranges = []
    for first, last, step in ((0, 99, 1), (100, 999, 10), (1000, 1 << 40, 100)):
        begin = F.greatest(F.col("_low"), F.lit(first))
        end = F.least(F.col("_high"), F.lit(last))
        ranges.append(
            F.when(
                begin <= end,
                F.transform(
                    F.sequence(F.floor(begin / step), F.floor(end / step)), lambda n, s=step: n.cast("string")
                ),
            ).otherwise(F.array().cast("array<string>"))
        )
    short = F.explode(F.flatten(F.array(*ranges)))
    return bounds.select("to_z", short.alias("_short")).select(
        F.concat_ws("/", F.col("to_z").cast("string"), "_short").alias("prefix")
    ).distinct()


def expire_batches(prefixes: DataFrame, paths: Sequence[str], size: int = 200) -> DataFrame:
    """Sorted prefixes in chunks, each as one regular expression over cached paths."""
    numbered = number_rows(prefixes.select("prefix"), [F.col("prefix")], "_n")
    chunks = numbered.groupBy(F.floor((F.col("_n") - 1) / size).alias("batch")).agg(
        F.count(F.lit(1)).alias("prefixes"),
        F.array_join(F.array_sort(F.collect_list("prefix")), "|").alias("_alternatives"),
    )
    group = "(?:" + "|".join(paths) + ")"
    regex = F.concat(F.lit(f"^{group}/("), "_alternatives", F.lit(r")[0-9]*/[0-9]+(\.pbf)?$"))
    return chunks.select("batch", "prefixes", regex.alias("regex"))
