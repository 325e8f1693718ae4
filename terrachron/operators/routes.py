"""Concurrent routes on one way over time: segment, merge, rank, pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.functions.dates import decimal_to_iso
from terrachron.functions.routes import (
    ROUTE_TYPES,
    SLOT_ATTRIBUTES,
    SLOTS,
    route_priority,
    slot_columns,
)
from terrachron.functions.text import empty_to_null, trimmed_upper
from terrachron.operators.intervals import FAR_FUTURE, join_overlapping, new_segment_flag
from terrachron.session import materialize
from terrachron.operators.skew import (
    HotGroups,
    OrderedGroups,
    attach,
    first_per_key,
    group_rows,
    number_rows,
    paged_lists,
    top_per_key,
)
from terrachron.operators.sweep import events, first_at_any_time, presence, signed_hash, toggles

ROUTE_COLUMNS = [
    "osm_id",
    "ref",
    "route",
    "network",
    "network_wikidata",
    "name",
    "type",
    "operator",
    "direction",
    "tags",
]
#: Ways with more routes go by a sweep over events; those of the others fit a list.
LISTED_ROUTES = 128
#: Routes of a way with the same values are repeats of each other.
IDENTITY = ["ref", "network", "direction"]


def set_hash(*columns: Column) -> Column:
    """Aggregate: one hash for a multiset of rows, in any order.

    Two 60-bit slices of an md5 are summed, so partial sums combine below the
    shuffle and no list is built.
    """
    digest = F.md5(F.concat_ws("|", *columns))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]
    sums = [F.sum(h).cast("decimal(38,0)").cast("string") for h in halves]
    return F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums))


def route_sources(multilines: DataFrame, lines: DataFrame) -> DataFrame:
    """Relation members and plain ways as one table of routes per way."""
    columns = [*ROUTE_COLUMNS, "geometry", "start_decdate", "end_decdate"]
    members = multilines.filter(F.col("geometry").isNotNull()).select(
        F.col("member").alias("way_id"), *columns, F.col("me_highway").alias("highway")
    )
    ways = lines.filter(F.col("geometry").isNotNull()).select(
        F.col("osm_id").alias("way_id"), *columns, "highway"
    )
    return members.unionByName(ways)


def mark_repeats(sources: DataFrame) -> DataFrame:
    """With ``_valid`` (the range is not empty), ``_repeats`` (valid routes of the way with the same
    ref, network and direction) and ``_same`` (rows of the way with the same osm_id)."""
    valid = F.col("start_decdate").isNull() | F.col("end_decdate").isNull() | (F.col("start_decdate") < F.col("end_decdate"))
    return sources.withColumn("_valid", valid).withColumns(
        {
            "_repeats": F.count(F.when(F.col("_valid"), 1)).over(Window.partitionBy("way_id", *IDENTITY)),
            "_same": F.count(F.lit(1)).over(Window.partitionBy("way_id", "osm_id")),
        }
    )


def reigns(marked: DataFrame) -> DataFrame:
    """Routes with the ranges in which they count, ``_shared`` if their osm_id may have several.

    Of routes of a way with the same ref, network and direction only the first, by osm_id, type, name, operator
    and route, counts at any time.
    """
    columns = ["way_id", *ROUTE_COLUMNS, "highway", "start_decdate", "end_decdate"]
    alone = marked.filter("_valid AND _repeats = 1").select(*columns, (F.col("_same") > 1).alias("_shared"))
    last = [c for column in ("osm_id", "type", "name", "operator", "route") for c in (F.col(column).isNull().alias(f"_no_{column}"), column)]
    entries = F.array_sort(F.map_entries("tags")).alias("_entries")
    value = F.struct(*last, *IDENTITY, "network_wikidata", "highway", entries)
    key = F.struct(*[x for c in IDENTITY for x in (F.col(c).isNull().alias(f"no_{c}"), F.coalesce(F.col(c), F.lit("")).alias(c))])
    repeats = marked.filter("_valid AND _repeats > 1").select("way_id", key.alias("_key"), value.alias("_route"), "start_decdate", "end_decdate")
    first = first_at_any_time(repeats, ["way_id", "_key"], "_route")
    fields = [F.col(f"_route.{c}").alias(c) if c != "tags" else F.map_from_entries("_route._entries").alias(c) for c in [*ROUTE_COLUMNS, "highway"]]
    return alone.unionByName(first.select("way_id", *fields, "start_decdate", "end_decdate", F.lit(True).alias("_shared")))


def route_segments(
    marked: DataFrame, counted: DataFrame, keep_open_start: bool = False, hot: HotGroups | None = None
) -> DataFrame:
    """One row per way and segment between known dates: counts, highway and a hash of the route set.

    A sweep over the dates of a way, with two events for each reign. Segments without
    routes are left out, as is the one before the first date unless ``keep_open_start``.
    """
    parts = signed_hash(trimmed_upper(F.col("ref")), trimmed_upper(F.col("network")))
    hashes = [f"_h{k}" for k in range(len(parts))]
    own = F.when(~F.col("_shared") & F.col("osm_id").isNotNull(), 1).otherwise(0).alias("_own")
    steps = counted.select(*["way_id", "start_decdate", "end_decdate", own, *[p.alias(h) for p, h in zip(parts, hashes)]])
    steps = events(steps, ["way_id", "_own", *hashes])
    steps = steps.select("way_id", "at", F.col("sign").alias("_rows"), *[(F.col(c) * F.col("sign")).alias(c) for c in ("_own", *hashes)])
    # An osm_id with several reigns counts once: its first and last presence are the events.
    shared = events(counted.filter("_shared AND osm_id IS NOT NULL"), ["way_id", "osm_id"])
    once = toggles(shared, ["way_id", "osm_id"]).select("way_id", "at", F.col("sign").alias("_own"))
    # Dates of routes that never count there cut all the same.
    cuts = marked.filter("NOT _valid OR _repeats > 1").select("way_id", F.explode(F.array("start_decdate", "end_decdate")).alias("at"))
    cuts = cuts.filter("at IS NOT NULL").distinct()
    every = steps.unionByName(once, allowMissingColumns=True).unionByName(cuts, allowMissingColumns=True)
    sums = ["_rows", "_own", *hashes]
    deltas = every.groupBy("way_id", "at").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    swept = OrderedGroups(deltas, ["way_id"], [F.col("at").asc_nulls_first()], hot)
    for c in sums:
        swept = swept.running_sum(c, f"_all{c}")
    swept = swept.lead("at", "end_decdate").row_number("seg").frame()
    held = F.col("_all_rows") > 0
    segments = swept.filter(held if keep_open_start else held & F.col("at").isNotNull()).select(
        "way_id",
        F.col("at").alias("start_decdate"),
        "end_decdate",
        F.col("_all_own").alias("num_routes"),
        F.concat_ws(":", "_all_rows", *[f"_all{h}" for h in hashes]).alias("routeset_hash"),
        "seg",
    )
    return with_highway(segments, counted, hot).withColumns(
        {
            "start_date": decimal_to_iso(F.col("start_decdate")),
            "end_date": decimal_to_iso(F.col("end_decdate")),
        }
    )


def with_highway(segments: DataFrame, counted: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """The greatest highway value of the routes in each segment.

    Values are few on a way, whatever the number of routes: ranges are merged per value first.
    """
    marks = events(counted.filter("highway IS NOT NULL"), ["way_id", "highway"])
    values = presence(marks, ["way_id", "highway"], hot)
    numbered = segments.select("way_id", "seg", F.col("start_decdate").alias("seg_start"), F.col("end_decdate").alias("seg_end"))
    there = join_overlapping(number_segments(numbered, hot), values, "way_id", hot=hot)
    best = there.groupBy("way_id", "seg_start").agg(F.max("highway").alias("highway"))
    best = best.withColumnRenamed("seg_start", "start_decdate")
    return attach(segments.drop("seg"), best, ["way_id", "start_decdate"])


def number_segments(segments: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Disjoint segments of ways numbered from 1, as overlaps want them."""
    order = [F.col("seg_start").asc_nulls_first()]
    return OrderedGroups(segments.select("way_id", "seg_start", "seg_end"), ["way_id"], order, hot).row_number("seg").frame()


def merge_segments(segments: DataFrame, hot: HotGroups | None = None, lists: bool = False) -> DataFrame:
    """Join neighbouring segments of a way that carry the same route set.

    As in the source system the merged end is the largest known end, so an open
    end is lost when a closed segment is merged with it. The first segment
    gives the routes; its start and end are kept as ``first_start`` and
    ``first_end``, or with ``lists`` its ``routes`` and the way's ``geometry``.
    """
    runs = (
        OrderedGroups(
            segments, ["way_id", "routeset_hash"], [F.col("start_decdate").asc_nulls_first()], hot
        )
        .lag("end_decdate", "_previous_end")
        .map(
            lambda d: d.withColumn(
                "_new", new_segment_flag(F.col("start_decdate"), F.col("_previous_end"))
            )
        )
        .running_sum("_new", "_run")
        .frame()
    )
    # The row that opens a run; a struct keeps a NULL end apart from a missing row.
    given = ["routes", "geometry"] if lists else ["start_decdate", "end_decdate"]
    first = F.min_by(
        F.struct(*given),
        F.struct(F.col("start_decdate").isNotNull(), "start_decdate"),
    )
    return (
        runs.groupBy("way_id", "routeset_hash", "_run")
        .agg(
            F.min("start_decdate").alias("min_start_decdate"),
            F.max("end_decdate").alias("max_end_decdate"),
            F.min("start_date").alias("min_start_date_iso"),
            F.max("end_date").alias("max_end_date_iso"),
            F.max("num_routes").alias("num_routes"),
            F.max("highway").alias("highway"),
            first.alias("_first"),
        )
        .select(
            "way_id",
            "min_start_decdate",
            "max_end_decdate",
            "min_start_date_iso",
            "max_end_date_iso",
            "num_routes",
            "highway",
            *[F.col(f"_first.{c}").alias(c if lists else f"first_{c.removesuffix('_decdate')}") for c in given],
        )
    )


HEADER = [
    "way_id",
    "min_start_decdate",
    "max_end_decdate",
    "min_start_date_iso",
    "max_end_date_iso",
    "num_routes",
    "highway",
]


def listed_segments(sources: DataFrame, keep_open_start: bool = False) -> DataFrame:
    """Segments of ways with few routes, with the routes in each as a list.

    Rows are dealt out by way once; everything after works inside a way, on the same partitions.
    """
    last = ["osm_id", "type", "name", "operator", "route"]
    rest = [*IDENTITY, "network_wikidata", "highway", "entries", "start", "end", "geometry"]
    row = F.struct(
        *last, *rest[:5], F.array_sort(F.map_entries("tags")).alias("entries"),
        F.col("start_decdate").alias("start"), F.col("end_decdate").alias("end"), "geometry",
    )
    # in the order by which the first of repeats is chosen, and the way's geometry
    ordered = lambda r: F.struct(*[x for c in last for x in (r[c].isNull().alias(f"no_{c}"), r[c].alias(c))], *[r[c].alias(c) for c in rest])
    ways = sources.repartition("way_id").groupBy("way_id").agg(F.collect_list(row).alias("rows"))
    ways = ways.select("way_id", F.array_sort(F.transform("rows", ordered)).alias("rows"))
    dates = F.flatten(F.transform("rows", lambda r: F.array(r["start"], r["end"])))
    dates = F.array_sort(F.array_distinct(F.filter(dates, lambda d: d.isNotNull())))
    ways = ways.select("way_id", "rows", F.col("rows")[0]["geometry"].alias("geometry"), dates.alias("dates"))
    # Routes of a way without dates are one segment, in which none is a repeat.
    undated, unknown = F.size("dates") == 0, F.array(F.lit(None).cast("double"))
    starts = F.concat(unknown, "dates") if keep_open_start else F.when(undated, unknown).otherwise(F.col("dates"))
    starts = F.when(undated, unknown).otherwise(starts)

    def here(at: Column, place: Column) -> Column:
        def holds(r: Column) -> Column:
            valid = r["start"].isNull() | r["end"].isNull() | (r["start"] < r["end"])
            return valid & (r["start"].isNull() | (r["start"] <= at)) & (r["end"].isNull() | at.isNull() | (r["end"] > at))

        return F.struct(at.alias("at"), F.get("starts", place + 1).alias("until"), F.filter("rows", holds).alias("held"))

    ways = ways.select("way_id", "geometry", "rows", undated.alias("undated"), starts.alias("starts"))
    segments = ways.select("way_id", "geometry", "undated", F.explode(F.transform("starts", here)).alias("s"))
    segments = segments.select("way_id", "geometry", "undated", F.col("s.at").alias("start_decdate"), F.col("s.until").alias("end_decdate"), "s.held")
    same = lambda r: F.struct(*[r[c].alias(c) for c in IDENTITY])
    first = F.filter("held", lambda r, place: F.array_position(F.transform("held", same), same(r)) == place + 1)
    segments = segments.filter(F.size("held") > 0).withColumn("counted", F.when(F.col("undated"), F.col("held")).otherwise(first))
    shown = lambda r: F.col("end_decdate").isNotNull() | r["start"].isNull() | (r["start"] < FAR_FUTURE)
    by = ("ref", "osm_id", "type", "name", "network", "direction")
    listed = lambda r: F.struct(*[x for c in by for x in (r[c].isNull().alias(f"no_{c}"), r[c].alias(c))], r.alias("r"))
    routes = F.transform(F.array_sort(F.transform(F.filter("counted", shown), listed)), lambda x: x["r"])
    osm_ids = F.filter(F.transform("counted", lambda r: r["osm_id"]), lambda i: i.isNotNull())
    sets = F.transform("counted", lambda r: F.concat_ws("|", trimmed_upper(r["ref"]), trimmed_upper(r["network"])))
    full = lambda r: F.struct(*[F.map_from_entries(r["entries"]).alias(c) if c == "tags" else r[c].alias(c) for c in ROUTE_COLUMNS])
    return segments.withColumn("shown", routes).select(
        "way_id",
        "geometry",
        "start_decdate",
        "end_decdate",
        decimal_to_iso(F.col("start_decdate")).alias("start_date"),
        decimal_to_iso(F.col("end_decdate")).alias("end_date"),
        F.size(F.array_distinct(osm_ids)).cast("long").alias("num_routes"),
        F.array_max(F.transform("shown", lambda r: r["highway"])).alias("highway"),
        F.array_sort(sets).alias("routeset_hash"),
        F.transform("shown", full).alias("routes"),
    )


def listed_periods(sources: DataFrame, keep_open_start: bool = False) -> DataFrame:
    """Periods of ways with few routes: header, ``routes`` ordered by ref, geometry. Partitioned by way."""
    return merge_segments(listed_segments(sources, keep_open_start), HotGroups.none(["way_id"]), lists=True)


def ways_by_size(sources: DataFrame, listed: int = LISTED_ROUTES) -> tuple[DataFrame, DataFrame | None]:
    """Routes of ways with at most ``listed`` of them, and the others, if there are any."""
    sources = sources.filter(F.col("way_id").isNotNull())
    return HotGroups(sources, ["way_id"], listed).split(sources)


def normalize_routes(
    sources: DataFrame, keep_open_start: bool = False, listed: int = LISTED_ROUTES
) -> tuple[DataFrame, DataFrame]:
    """Periods of each way with a constant route set, and the routes of each period.

    The second table has one row per period and route. Ways with more than ``listed`` routes are swept
    over the cluster, the others each as a list.
    """
    ordinary, large = ways_by_size(sources, listed)
    known = materialize(listed_periods(ordinary, keep_open_start), "listed-periods")
    periods, members = known.select(*HEADER, "geometry"), known.select(*HEADER, F.inline("routes"))
    if large is None:
        return periods, members
    swept, swept_members = swept_periods(large, keep_open_start)
    return periods.unionByName(swept), members.unionByName(swept_members)


def swept_periods(sources: DataFrame, keep_open_start: bool = False) -> tuple[DataFrame, DataFrame]:
    """Periods and their routes for ways of any size.

    A way with any number of routes stays spread over the cluster. Geometries do not travel through
    the sweep: the period takes that of the first route on its way.
    """
    sources = sources.filter(F.col("way_id").isNotNull())
    shapes = first_per_key(
        sources.select("way_id", "geometry", "osm_id", "type", "name"),
        ["way_id"],
        [F.col(c).asc_nulls_last() for c in ("osm_id", "type", "name")],
    ).select("way_id", "geometry")
    sources = sources.drop("geometry")
    # A way has at most twice as many segments as routes.
    hot = HotGroups(sources, ["way_id"], max(1, group_rows(sources) // 2))
    marked = materialize(mark_repeats(sources), "marked-routes")
    counted = materialize(reigns(marked), "route-reigns")
    periods = merge_segments(route_segments(marked, counted, keep_open_start, hot), hot)
    periods = materialize(periods, "route-periods")
    dated_ways = sources.filter(
        F.col("start_decdate").isNotNull() | F.col("end_decdate").isNotNull()
    ).select("way_id").distinct()
    undated = sources.join(dated_ways, "way_id", "left_anti")
    unknown = F.lit(None)
    undated_periods = undated.groupBy("way_id").agg(
        F.count_distinct("osm_id").alias("num_routes"),
        F.max("highway").alias("highway"),
    ).select(
        "way_id",
        unknown.cast("double").alias("min_start_decdate"),
        unknown.cast("double").alias("max_end_decdate"),
        unknown.cast("string").alias("min_start_date_iso"),
        unknown.cast("string").alias("max_end_date_iso"),
        "num_routes",
        "highway",
    )
    # Only the first segment of a period is expanded into its routes.
    firsts = periods.select(*HEADER, F.col("first_start").alias("seg_start"), F.col("first_end").alias("seg_end"))
    numbered = number_segments(firsts, hot)
    reached = join_overlapping(numbered, counted.drop("highway", "_shared"), "way_id", hot=hot)
    dated_routes = attach(reached.drop("seg", "start_decdate", "end_decdate", "seg_end"), firsts.drop("seg_end"), ["way_id", "seg_start"], "inner")
    dated_routes = dated_routes.select(*HEADER, *ROUTE_COLUMNS)
    undated_routes = undated_periods.join(
        undated.select("way_id", *ROUTE_COLUMNS), "way_id"
    ).select(*HEADER, *ROUTE_COLUMNS)
    all_periods = periods.drop("first_start", "first_end").unionByName(undated_periods)
    all_periods = all_periods.join(shapes, "way_id")
    return all_periods, dated_routes.unionByName(undated_routes)


def routes_with_lists(periods: DataFrame, routes: DataFrame, page_rows: int = 10_000) -> DataFrame:
    """Numbered periods with their routes as an array, ordered by ref.

    A period with more than ``page_rows`` routes comes out as several pages.
    """
    numbered = number_rows(
        periods,
        [F.col(c).asc_nulls_last() for c in ("way_id", "min_start_decdate", "max_end_decdate")],
        "uid",
    )
    key = ["way_id", "min_start_decdate", "max_end_decdate"]
    order = [F.col(c).asc_nulls_last() for c in ("ref", "osm_id", "type", "name", "network", "direction")]
    lists = paged_lists(routes, key, order, F.struct(*ROUTE_COLUMNS), "routes", page_rows)
    return attach(numbered, lists, key)


def normalized_lists(sources: DataFrame, page_rows: int = 10_000, listed: int = LISTED_ROUTES) -> DataFrame:
    """Numbered periods with their routes, as ``routes_with_lists`` gives them; lists of ordinary ways are not taken apart."""
    ordinary, large = ways_by_size(sources, min(listed, page_rows))
    order = [F.col(c).asc_nulls_last() for c in HEADER[:3]]
    known = listed_periods(ordinary).withColumn("page", F.when(F.size("routes") > 0, 0))
    known = known.select(*HEADER, "geometry", "page", F.when(F.size("routes") > 0, F.col("routes")).alias("routes"))
    if large is None:
        return number_rows(known, order, "uid")
    periods, routes = swept_periods(large)
    marked = known.withColumn("_swept", F.lit(False)).unionByName(periods.withColumn("_swept", F.lit(True)), allowMissingColumns=True)
    numbered = number_rows(marked, order, "uid")
    by = [F.col(c).asc_nulls_last() for c in ("ref", "osm_id", "type", "name", "network", "direction")]
    lists = paged_lists(routes, HEADER[:3], by, F.struct(*ROUTE_COLUMNS), "routes", page_rows)
    swept = attach(numbered.filter("_swept").drop("page", "routes"), lists, HEADER[:3])
    return numbered.filter("NOT _swept").unionByName(swept).drop("_swept")


def pivot_slots(ranked: DataFrame, keys: list[str], carried: Sequence[str] = ()) -> DataFrame:
    """One column per route type, rank and attribute, from one map per group. Rows without a rank have no slot.

    A map is built once per group; 252 separate conditional maxima would each
    look at every row.
    """
    slot = F.concat_ws("_", "type", "type_rnk")
    entry = F.struct(slot.alias("slot"), F.struct(*SLOT_ATTRIBUTES).alias("route"))
    entry = F.when(F.col("type_rnk").isNotNull(), entry)
    any_of = [F.any_value(c).alias(c) for c in carried]
    slots = ranked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_slots"), *any_of)
    keys = [*keys, *carried]
    names = [f"{kind}_{i}" for kind in ROUTE_TYPES for i in range(1, SLOTS + 1)]
    # One lookup per slot first; the attributes are then plain fields.
    routes = slots.select(*keys, *[F.try_element_at("_slots", F.lit(n)).alias(n) for n in names])
    columns = [F.col(n)[a].alias(f"route_{n}_{a}") for n in names for a in SLOT_ATTRIBUTES]
    return routes.select(*keys, *columns)


def index_routes(periods: DataFrame, routes: DataFrame) -> DataFrame:
    """Per period, the best routes of each type in fixed slots.

    Routes with a ref come first, then the higher priority. Only the slots that
    are shown leave each task, so the pivot sees at most 42 routes per period.
    """
    period = ["way_id", "min_start_decdate", "max_end_decdate"]
    scored = routes.filter(F.col("type").isin(ROUTE_TYPES)).withColumn(
        "prio", route_priority(F.col("type"), F.col("network"), F.col("ref"))
    )
    ranked = top_per_key(scored, [*period, "type"], slot_order(), SLOTS, "type_rnk")
    slots = pivot_slots(ranked, period)
    return attach(periods, slots, period)


def normalized_slots(sources: DataFrame, listed: int = LISTED_ROUTES) -> DataFrame:
    """Per period the best routes of each type, as ``index_routes`` gives them; ordinary ways stay on their partitions."""
    ordinary, large = ways_by_size(sources, listed)
    known = listed_periods(ordinary).select(*HEADER, "geometry", F.inline_outer("routes"))
    prio = route_priority(F.col("type"), F.col("network"), F.col("ref"))
    window = Window.partitionBy(*HEADER[:3], "type").orderBy(*slot_order())
    rank = F.row_number().over(window)
    shown = F.when(F.col("type").isin(ROUTE_TYPES) & (F.col("type_rnk") <= SLOTS), F.col("type_rnk"))
    ranked = known.withColumn("prio", prio).withColumn("type_rnk", rank).withColumn("type_rnk", shown)
    slots = pivot_slots(ranked, HEADER, ["geometry"])
    if large is None:
        return slots
    return slots.unionByName(index_routes(*swept_periods(large)))


def slot_order() -> list[Column]:
    return [F.col("ref").isNull(), F.col("prio").desc(), F.col("osm_id"), F.col("direction"), F.col("name")]


def routes_view(indexed: DataFrame) -> DataFrame:
    """The published form: renamed columns, empty slots as NULL, a sequential id."""
    named = indexed.select(
        F.col("way_id").alias("osm_id"),
        F.col("min_start_decdate").alias("start_decdate"),
        F.col("max_end_decdate").alias("end_decdate"),
        F.col("min_start_date_iso").alias("start_date"),
        F.col("max_end_date_iso").alias("end_date"),
        "geometry",
        empty_to_null(F.col("highway")).alias("highway"),
        *[
            empty_to_null(F.col(c)).alias(c)
            for kind in ROUTE_TYPES
            for c in slot_columns(kind)
        ],
    )
    order = [F.col(c).asc_nulls_last() for c in ("osm_id", "start_decdate", "end_decdate")]
    return number_rows(named, order)
