"""Projections and filters (F), joins (J), aggregates (A), sets (U), order (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrachron.functions import dates, geometry as geo, text
from terrachron.operators import intervals, relational as rel
from terrachron.operators.routes import set_hash
from terrachron.operators.skew import HotGroups, first_per_key, group_rows, paged_lists
from terrachron.plans import cluster, publish
from terrachron.registry.base import query, sql_decimal
from terrachron.session import work_path

C = F.col
LONG = "long"


def n_rows(name="n"):
    return F.count(F.lit(1)).alias(name)


# ---- projections and filters ----


@query(
    "project_all_with_overrides",
    "features",
    """SELECT id, osm_id, NULLIF(class, '') AS class, upper(type) AS type, NULLIF(name, '') AS name, NULLIF(start_date, '') AS start_date,
       NULLIF(end_date, '') AS end_date, area, k, changeset FROM features""",
)
def _(t):
    rows = t.features().drop("lon", "lat", "x", "y", "ts")
    return rel.project_all(rows, {"type": F.upper("type")})


@query(
    "project_exclude",
    "features",
    """SELECT id, osm_id, NULLIF(class, '') AS class, NULLIF(type, '') AS type, NULLIF(start_date, '') AS start_date, NULLIF(end_date, '') AS end_date,
       k, changeset, lower(name) AS name, k * 2 AS height FROM features""",
)
def _(t):
    rows = t.features().drop("lon", "lat", "x", "y", "ts")
    return rel.project_without(rows, ["area"], ["lower(name) AS name", "k * 2 AS height"])


@query(
    "add_area_columns",
    "features",
    """SELECT id, area, CAST(round(CAST(area AS DECIMAL(30,10)), 1) AS DECIMAL(20,1)) AS area_m2,
       CAST(round(CAST(area * 12345.678 / 1000000 AS DECIMAL(30,10)), 1) AS DECIMAL(20,1)) AS large_km2 FROM features""",
)
def _(t):
    plain = rel.area_columns(C("area"))
    large = rel.area_columns(C("area") * 12345.678)
    return t.features().select(
        "id", "area", plain["area_m2"].alias("area_m2"), large["area_km2"].alias("large_km2")
    )


@query(
    "add_length_columns",
    "polylines",
    """SELECT id, osm_id, round(length, 6) AS length, CAST(round(CAST(round(length, 6) AS DECIMAL(30,10)), 1) AS DECIMAL(20,1)) AS length_m,
       CAST(round(CAST(CAST(round(length, 6) AS DECIMAL(30,10)) / 1000 AS DECIMAL(30,10)), 1) AS DECIMAL(20,1)) AS length_km FROM polylines""",
)
def _(t):
    columns = rel.length_columns(F.round("length", 6))
    return t.polylines().select("id", "osm_id", *[v.alias(k) for k, v in columns.items()])


@query(
    "add_source_literal",
    "features",
    """SELECT id, 'point' AS source FROM features UNION ALL SELECT c_custkey, 'polygon' FROM customer
       UNION ALL SELECT l_orderkey, 'line' FROM lineitem""",
)
def _(t):
    parts = [(t.features(), "point"), (t.rects(), "polygon"), (t.polylines(), "line")]
    tagged = [df.select("id", F.lit(s).alias("source")) for df, s in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "optional_predicate",
    "features",
    "SELECT id, k FROM features WHERE (k > 50 OR type = 'click') UNION ALL SELECT id, k FROM features",
)
def _(t):
    rows = t.features().select("id", "k", "type")
    chosen = rel.filtered(rows, "k > 50 OR type = 'click'")
    return chosen.unionByName(rel.filtered(rel.filtered(rows, None), " ")).select("id", "k")


@query(
    "min_area_filter",
    "rects",
    """SELECT id, 'computed' AS kind, round(area, 4) AS area FROM rects WHERE area > 55 + 1e-9
       UNION ALL SELECT id, 'stored', round(area, 4) FROM rects WHERE area >= 100 - 1e-9""",
)
def _(t):
    rects = t.rects()
    computed = rel.larger_than(rects, 55 + 1e-9).select("id", F.lit("computed").alias("kind"), F.round("area", 4).alias("area"))
    stored = rel.at_least(rects, 100 - 1e-9).select("id", F.lit("stored").alias("kind"), F.round("area", 4).alias("area"))
    return computed.unionByName(stored)


@query("min_length_filter", "polylines", "SELECT id, osm_id, round(length, 4) AS length FROM polylines WHERE length > 500.0001")
def _(t):
    return rel.longer_than(t.polylines(), 500.0001).select("id", "osm_id", F.round("length", 4).alias("length"))


@query(
    "geometry_type_filter",
    "",
    """SELECT 'polygon' AS gtype, c_custkey AS id FROM customer
       UNION ALL SELECT 'linestring', l_orderkey FROM lineitem""",
)
def _(t):
    both = t.rects().select("id", "geometry").unionByName(t.polylines().select("id", "geometry"))
    kind = C("geometry.gtype")
    areas = both.filter(kind.isin(geo.POLYGONS)).select(kind.alias("gtype"), "id")
    return areas.unionByName(both.filter(kind.isin(geo.LINES)).select(kind.alias("gtype"), "id"))


@query("type_list_filter", "features", "SELECT id, type FROM features WHERE type IN ('click', 'purchase')")
def _(t):
    return rel.of_types(rel.of_types(t.features(), None), ["click", "purchase"]).select("id", "type")


@query(
    "named_features_filter",
    "tagged",
    """SELECT osm_id, CASE WHEN osm_id % 4 = 0 THEN NULL WHEN osm_id % 4 = 1 THEN '' ELSE 'n' || osm_id END AS name,
       CASE WHEN language = 'en' THEN 'l' || osm_id END AS name_en, CASE WHEN language = 'fr' THEN 'l' || osm_id END AS name_fr
       FROM tagged WHERE osm_id % 4 > 1 OR language IN ('en', 'fr')""",
)
def _(t):
    n = C("osm_id")
    name = F.when(n % 4 == 0, None).when(n % 4 == 1, "").otherwise(text.tag(C("tags"), "name"))
    columns = text.language_columns(["name:en", "name:fr"], C("tags"))[:2]
    return rel.named(t.tagged().select("osm_id", name.alias("name"), *columns))


@query(
    "composite_exclusion",
    "tagged",
    """SELECT osm_id, main_key AS class, main_value AS type FROM tagged
       WHERE NOT (main_key = 'highway' AND main_value IN ('service', 'track')) AND NOT (main_value = 'water' AND main_key = 'natural')""",
)
def _(t):
    rows = t.tagged().select("osm_id", F.map_keys("tags")[0].alias("class"), F.map_values("tags")[0].alias("type"))
    minor = (C("class") == "highway") & C("type").isin("service", "track")
    return rows.filter(~minor & ~((C("type") == "water") & (C("class") == "natural")))


@query("nullif_int", "", "SELECT p_partkey, NULLIF(p_size % 3, 0) AS tunnel FROM part")
def _(t):
    return t.part.select("p_partkey", text.zero_to_null(C("p_size") % 3).alias("tunnel"))


@query(
    "null_safe_difference",
    "",
    """SELECT l_orderkey, l_linenumber, l_partkey, (NULLIF(CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN 'A' END, '') IS NOT NULL
         AND CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN 'A' END IS DISTINCT FROM l_returnflag)
         OR (l_linestatus IS DISTINCT FROM 'O') AS differs FROM lineitem""",
)
def _(t):
    relation = F.when(C("l_linenumber") % 3 == 0, "").when(C("l_linenumber") % 3 == 1, "A")
    flag = text.differs(relation, C("l_returnflag")) | text.differs(C("l_linestatus"), F.lit("O"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("differs"))


@query(
    "age_window_filter",
    "",
    """WITH now AS (SELECT max(o_orderdate) AS moment FROM orders)
       SELECT o_orderkey, o_orderdate AS closed_at FROM orders, now
       WHERE o_orderdate >= moment - INTERVAL 400 DAY AND o_orderdate <= moment - INTERVAL 30 DAY
       ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
)
def _(t):
    from terrachron.operators.quality import closed_in_window

    now = t.orders.agg(F.max("o_orderdate")).first()[0]
    rows = t.orders.select("o_orderkey", C("o_orderdate").alias("closed_at"))
    day = 86_400
    return closed_in_window(rows, now, 30 * day, 400 * day, limit=50, tie="o_orderkey")


@query(
    "as_of_time_filter",
    "members",
    """SELECT osm_id, member FROM members WHERE (start_decdate IS NULL OR start_decdate <= 1996.5) AND (end_decdate IS NULL OR end_decdate > 1996.5)""",
)
def _(t):
    alive = dates.valid_at(C("start_decdate"), C("end_decdate"), 1996.5)
    return t.members().filter(alive).select("osm_id", "member")


@query(
    "bbox_filter",
    "rects",
    "SELECT id, x0 AS xmin, x0 + w AS xmax FROM rects WHERE x0 <= 9000 AND x0 + w >= 3000 AND y0 <= 200 AND y0 + h >= 50",
)
def _(t):
    rects = t.rects().withColumns(geo.bounds(C("geometry")))
    return rects.filter(geo.meets_box(3000, 50, 9000, 200)).select("id", "xmin", "xmax")


@query(
    "as_of_buckets",
    "members",
    """SELECT osm_id, member, 1996.5 AS moment FROM members WHERE (start_decdate IS NULL OR start_decdate <= 1996.5) AND (end_decdate IS NULL OR end_decdate > 1996.5)
       UNION ALL SELECT osm_id, member, 1993.25 FROM members WHERE (start_decdate IS NULL OR start_decdate <= 1993.25) AND (end_decdate IS NULL OR end_decdate > 1993.25)""",
)
def _(t):
    """The as-of filter over a table partitioned by dyadic buckets of years."""
    path = work_path(t.spark, "timeline")
    cluster.write_timeline(t.members().select("osm_id", "member", "start_decdate", "end_decdate"), path)
    table = t.spark.read.parquet(path)
    parts = [cluster.as_of(table, m).select("osm_id", "member", F.lit(m).alias("moment")) for m in (1996.5, 1993.25)]
    return parts[0].unionByName(parts[1])


@query(
    "bbox_clustered",
    "rects",
    "SELECT id, x0 AS xmin, x0 + w AS xmax FROM rects WHERE x0 <= 9000 AND x0 + w >= 3000 AND y0 <= 200 AND y0 + h >= 50",
)
def _(t):
    """The box filter over a published table that lies along a Hilbert curve."""
    root = work_path(t.spark, "clustered")
    rows = t.rects().select("id", "geometry")
    publish.publish(rows.withColumns(geo.bounds(C("geometry"))), root, "rects", ["id"], levels=4)
    return publish.open_view(t.spark, root, "rects", (3000, 50, 9000, 200)).select("id", "xmin", "xmax")


# ---- joins ----


@query(
    "inner_equi_join",
    "",
    """SELECT p_partkey, -l_orderkey AS relation, p_brand FROM part JOIN lineitem ON l_partkey = p_partkey""",
)
def _(t):
    streets = t.lineitem.select((-C("l_orderkey")).alias("relation"), C("l_partkey").alias("member"))
    joined = t.part.join(streets, C("member") == C("p_partkey"))
    return joined.select("p_partkey", "relation", "p_brand")


@query(
    "left_join_optional",
    "",
    """SELECT c_custkey, s.first_order FROM customer LEFT JOIN (SELECT o_custkey, min(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS first_order
       FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) s ON o_custkey = c_custkey""",
)
def _(t):
    day = C("o_orderdate").cast("date").cast("string")
    first = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min(day).alias("first_order"))
    return t.customer.join(first, C("c_custkey") == C("o_custkey"), "left").select("c_custkey", "first_order")


@query(
    "semi_join",
    "",
    "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P')",
)
def _(t):
    open_orders = t.orders.filter("o_orderstatus = 'P'")
    found = t.lineitem.join(open_orders, C("l_orderkey") == C("o_orderkey"), "left_semi")
    return found.select("l_orderkey", "l_partkey", "l_linenumber")


@query(
    "anti_join",
    "",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
)
def _(t):
    large = t.orders.filter("o_totalprice > 300000")
    return t.customer.join(large, C("o_custkey") == C("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "null_aware_anti_join",
    "members",
    """SELECT c_custkey, 'without' AS kind FROM customer WHERE c_custkey NOT IN (SELECT member FROM members WHERE type = 'road')
       UNION ALL SELECT c_custkey, 'with' FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN start_date IS NOT NULL THEN member END FROM members WHERE type = 'road')""",
)
def _(t):
    customers = t.customer.select("c_custkey")
    road = t.members().filter("type = 'road'")
    without = rel.not_in(customers, "c_custkey", road, "member").withColumn("kind", F.lit("without"))
    nullable = road.withColumn("member", F.when(C("start_date").isNotNull(), C("member")))
    return without.unionByName(rel.not_in(customers, "c_custkey", nullable, "member").withColumn("kind", F.lit("with")))


@query(
    "in_subquery_join",
    "members",
    "SELECT osm_id, member FROM members WHERE member IN (SELECT member FROM members WHERE start_date IS NULL)",
)
def _(t):
    m = t.members()
    undated = m.filter("start_date IS NULL").select("member")
    return m.join(undated, "member", "left_semi").select("osm_id", "member")


@query(
    "interval_overlap_join",
    "members",
    """d AS (SELECT DISTINCT member, unnest([start_decdate, end_decdate]) AS s FROM members), g AS (SELECT member, s, lead(s) OVER (PARTITION BY member ORDER BY s) AS e FROM d WHERE s IS NOT NULL)
       SELECT g.member, osm_id, round(s, 6) AS seg_start, round(e, 6) AS seg_end FROM g JOIN members m ON m.member = g.member
        AND (start_decdate IS NULL OR start_decdate < COALESCE(e, 9999)) AND (end_decdate IS NULL OR end_decdate > s)""".replace(
        "d AS", "WITH d AS", 1
    ),
)
def _(t):
    m = t.members().select("member", "osm_id", "start_decdate", "end_decdate")
    # A member has at most twice as many segments as ranges.
    hot = HotGroups(m, ["member"], group_rows(m) // 2)
    segments = intervals.cut_segments(m, "member", hot=hot)
    pairs = intervals.join_overlapping(segments, m, "member", hot=hot)
    return pairs.select("member", "osm_id", F.round("seg_start", 6).alias("seg_start"), F.round("seg_end", 6).alias("seg_end"))


@query(
    "lateral_explode_json",
    "",
    """SELECT event_id, item FROM (SELECT event_id, unnest(CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 4 = 1 THEN [event_type] ELSE [event_type, CAST(user_id AS VARCHAR)] END) AS item FROM events)""",
)
def _(t):
    items = (
        F.when(C("event_id") % 4 == 0, "[]")
        .when(C("event_id") % 4 == 1, F.to_json(F.array("event_type")))
        .otherwise(F.to_json(F.array(C("event_type"), C("user_id").cast("string"))))
    )
    parsed = F.from_json(items, "array<string>")
    return t.events.select("event_id", F.explode(parsed).alias("item"))


@query("lateral_explode_map", "tag_rows", "SELECT osm_id, k AS key, v AS value FROM tag_rows WHERE k LIKE 'name:%'")
def _(t):
    rows = t.tagged().select("osm_id", F.explode("tags"))
    return rows.filter(C("key").startswith("name:"))


@query(
    "update_join",
    "features",
    f"""SELECT id, type, CASE WHEN type = 'click' AND k % 2 = 0 THEN round({sql_decimal('start_date', 'start')}, 6) ELSE CAST(k AS DOUBLE) END AS start_decdate FROM features""",
)
def _(t):
    missing = (C("type") == "click") & (C("k") % 2 == 0)
    filled = F.when(missing, F.round(dates.to_decimal(C("start_date"), "start"), 6)).otherwise(C("k").cast("double"))
    return t.features().withColumn("start_decdate", filled).select("id", "type", "start_decdate")


@query(
    "multi_table_lookup",
    "",
    """SELECT DISTINCT 'lines' AS tbl, l_partkey AS osm_id FROM lineitem WHERE l_partkey IN (SELECT s_suppkey * 3 FROM supplier)
       UNION ALL SELECT DISTINCT 'orders', o_custkey FROM orders WHERE o_custkey IN (SELECT s_suppkey * 3 FROM supplier)
       UNION ALL SELECT DISTINCT 'parts', p_partkey FROM part WHERE p_partkey IN (SELECT s_suppkey * 3 FROM supplier)""",
)
def _(t):
    tables = {
        "lines": t.lineitem.select(C("l_partkey").alias("osm_id")),
        "orders": t.orders.select(C("o_custkey").alias("osm_id")),
        "parts": t.part.select(C("p_partkey").alias("osm_id")),
    }
    wanted = t.supplier.select((C("s_suppkey") * 3).alias("osm_id"))
    return rel.lookup_in_tables(tables, wanted)


@query(
    "member_expansion_join",
    "members",
    """SELECT DISTINCT m.osm_id, m.member, c_name FROM members m JOIN customer ON c_custkey = m.member WHERE m.type = 'tram'""",
)
def _(t):
    m = t.members()
    return rel.rows_of_members(
        m.filter("type = 'tram'").select("osm_id"), m, t.customer.select("c_custkey", "c_name"), "c_custkey"
    ).select("osm_id", "member", "c_name")


@query(
    "sparse_id_gap_join",
    "",
    """SELECT CAST(g AS BIGINT) AS o_custkey FROM range(5, CAST((SELECT max(o_custkey) + 500 FROM orders) AS BIGINT) + 1, 3) r(g)
       WHERE g NOT IN (SELECT o_custkey FROM orders)""",
)
def _(t):
    last = t.orders.agg(F.max("o_custkey") + 500).first()[0]
    return rel.missing_ids(t.orders, "o_custkey", 5, 3, last)


# ---- aggregates ----


@query("group_count", "", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(n_rows())


@query("count_distinct", "members", "SELECT member, count(DISTINCT type) AS types, count(DISTINCT osm_id) AS relations FROM members GROUP BY member")
def _(t):
    return t.members().groupBy("member").agg(
        F.count_distinct("type").alias("types"), F.count_distinct("osm_id").alias("relations")
    )


@query(
    "min_max_null_poison",
    "members",
    """SELECT member, status, round(CASE WHEN bool_or(start_decdate IS NULL) THEN NULL ELSE min(start_decdate) END, 6) AS start_decdate,
       round(CASE WHEN bool_or(end_decdate IS NULL) THEN NULL ELSE max(end_decdate) END, 6) AS end_decdate FROM members GROUP BY member, status""",
)
def _(t):
    return t.members().groupBy("member", "status").agg(
        F.round(intervals.open_min("start_decdate"), 6).alias("start_decdate"),
        F.round(intervals.open_max("end_decdate"), 6).alias("end_decdate"),
    )


@query("bool_or", "members", "SELECT member, bool_or(end_date IS NULL) AS any_open, bool_or(type = 'road') AS any_road FROM members GROUP BY member")
def _(t):
    return t.members().groupBy("member").agg(
        F.bool_or(C("end_date").isNull()).alias("any_open"), F.bool_or(C("type") == "road").alias("any_road")
    )


@query("max_text_attributes", "members", "SELECT member, max(ref) AS ref, max(network) AS network FROM members GROUP BY member")
def _(t):
    return t.members().groupBy("member").agg(F.max("ref").alias("ref"), F.max("network").alias("network"))


@query(
    "first_by_order",
    "members",
    """SELECT member, price FROM (SELECT member, price, row_number() OVER (PARTITION BY member ORDER BY start_decdate NULLS FIRST, osm_id) AS rn FROM members) WHERE rn = 1""",
)
def _(t):
    return t.members().groupBy("member").agg(intervals.first_by_start("price", "start_decdate", "osm_id").alias("price"))


@query("any_value_agg", "members", "SELECT member, arg_min(price, osm_id) AS price FROM members GROUP BY member")
def _(t):
    return t.members().groupBy("member").agg(F.min_by("price", "osm_id").alias("price"))


@query(
    "array_of_structs_agg",
    "members",
    """SELECT member, CAST((rn - 1) // 10000 AS INTEGER) AS page, string_agg(osm_id || ':' || COALESCE(ref, '-') || ':' || network, ',' ORDER BY rn) AS routes, count(*) AS n
       FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ref NULLS LAST, osm_id) AS rn FROM members) GROUP BY 1, 2""",
)
def _(t):
    lists = paged_lists(
        t.members(), ["member"], [C("ref").asc_nulls_last(), C("osm_id")], F.struct("osm_id", "ref", "network"), "routes"
    )
    shown = F.transform(
        "routes", lambda r: F.concat_ws(":", r["osm_id"].cast("string"), F.coalesce(r["ref"], F.lit("-")), r["network"])
    )
    return lists.select("member", "page", F.array_join(shown, ",").alias("routes"), F.size("routes").cast(LONG).alias("n"))


@query(
    "set_hash",
    "members",
    """SELECT member, md5(count(*) || ':' || sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(d, 16, 15) AS BIGINT))) AS hash
       FROM (SELECT member, md5(trim(upper(COALESCE(ref, ''))) || '|' || trim(upper(COALESCE(network, '')))) AS d FROM members) GROUP BY member""",
)
def _(t):
    return t.members().groupBy("member").agg(
        set_hash(text.trimmed_upper(C("ref")), text.trimmed_upper(C("network"))).alias("hash")
    )


@query("having_threshold", "members", "SELECT member, sum(price) AS total FROM members GROUP BY member HAVING count(*) >= 12".replace("sum(price)", "count(*)"))
def _(t):
    return t.members().groupBy("member").agg(n_rows("total")).filter("total >= 12")


@query("sum_agg", "", "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("total"))


@query("min_non_empty_text", "members", "SELECT member, min(NULLIF(CASE WHEN status = 'P' THEN '' ELSE start_date END, '')) AS first_start FROM members GROUP BY member")
def _(t):
    raw = F.when(C("status") == "P", "").otherwise(C("start_date"))
    return t.members().groupBy("member").agg(F.min(text.empty_to_null(raw)).alias("first_start"))


@query(
    "extent_agg",
    "features",
    "SELECT type, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM features GROUP BY type",
)
def _(t):
    return t.features().groupBy("type").agg(
        F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax")
    )


@query(
    "string_agg_ordered",
    "members",
    """SELECT member, CAST((rn - 1) // 10000 AS INTEGER) AS page, string_agg(CAST(osm_id AS VARCHAR), ',' ORDER BY rn) AS ids
       FROM (SELECT member, osm_id, row_number() OVER (PARTITION BY member ORDER BY osm_id DESC) AS rn FROM members) GROUP BY 1, 2""",
)
def _(t):
    lists = paged_lists(t.members(), ["member"], [C("osm_id").desc()], C("osm_id").cast("string"), "ids")
    return lists.withColumn("ids", F.array_join("ids", ","))


@query("dedup_distinct", "members", "SELECT DISTINCT member, type FROM members")
def _(t):
    return t.members().select("member", "type").distinct()


@query(
    "distinct_on",
    "members",
    """SELECT member, ref, network, osm_id FROM (SELECT *, row_number() OVER (PARTITION BY member, ref, network ORDER BY osm_id) AS rn FROM members) WHERE rn = 1""",
)
def _(t):
    return first_per_key(t.members(), ["member", "ref", "network"], [C("osm_id")]).select("member", "ref", "network", "osm_id")


@query(
    "geo_grid_density",
    "features",
    "SELECT CAST(floor(lon) AS BIGINT) AS lon, CAST(floor(lat) AS BIGINT) AS lat, count(*) AS n FROM features GROUP BY 1, 2",
)
def _(t):
    return t.features().groupBy(F.floor("lon").alias("lon"), F.floor("lat").alias("lat")).agg(n_rows())


# ---- order, limits, samples ----


@query(
    "order_by_desc",
    "",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey",
)
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(n_rows()).orderBy(C("n").desc(), "l_partkey")


@query(
    "nulls_first_order",
    "members",
    """SELECT osm_id, round(start_decdate, 6) AS start_decdate, row_number() OVER (ORDER BY start_decdate NULLS FIRST, osm_id) AS position FROM members""",
)
def _(t):
    from terrachron.operators.skew import number_rows

    rows = t.members().select("osm_id", "start_decdate")
    placed = number_rows(rows, [C("start_decdate").asc_nulls_first(), C("osm_id")], "position")
    return placed.withColumn("start_decdate", F.round("start_decdate", 6))


@query("top_k_recent", "", "SELECT event_id, event_type, ts FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    rows = t.events.filter("event_type <> 'view'").select("event_id", "event_type", "ts")
    return rows.orderBy(C("ts").desc(), C("event_id").desc()).limit(50)


@query(
    "paginate",
    "",
    """SELECT o_orderkey, o_totalprice, (SELECT CAST(ceil(count(*) / 25) AS BIGINT) FROM orders) AS pages
       FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    third = rel.page(rows, [C("o_totalprice").desc(), C("o_orderkey")], 25, 3)
    # The page count is a single row.
    return third.crossJoin(F.broadcast(rel.page_count(t.orders, 25)))


@query(
    "sample_percent",
    "elements",
    """e AS (SELECT *, md5(7 || '|' || type || '|' || osm_id || '|' || version || '|' || part || '|' || CAST(CAST(timestamp AS DATE) AS VARCHAR)) AS ticket FROM elements WHERE action <> 'delete'),
       r AS (SELECT *, row_number() OVER (PARTITION BY changeset ORDER BY ticket) AS rn, count(*) OVER (PARTITION BY changeset) AS n FROM e)
       SELECT changeset, osm_id, version, part FROM r WHERE rn <= greatest(1, ceil(n * 25 / 100))""".replace("e AS", "WITH e AS", 1),
)
def _(t):
    e = t.elements().filter("action <> 'delete'").withColumn("day", C("timestamp").cast("date"))
    picked = rel.sample_per_group(e, "changeset", 25, 7, ["type", "osm_id", "version", "part", "day"])
    return picked.select("changeset", "osm_id", "version", "part")


# ---- set operations ----


@query(
    "union_all_aligned",
    "features",
    """SELECT id, NULLIF(name, '') AS name, 'point' AS source FROM features
       UNION ALL SELECT c_custkey, c_name, 'polygon' FROM customer""",
)
def _(t):
    points = t.features().select("id", text.empty_to_null(C("name")).alias("name"), F.lit("point").alias("source"))
    areas = t.customer.select(F.lit("polygon").alias("source"), C("c_custkey").alias("id"), C("c_name").alias("name"))
    return points.unionByName(areas)


@query(
    "union_all_many",
    "",
    " UNION ALL ".join(
        f"SELECT '{name}' AS layer, {key} AS id FROM {name}"
        for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "event_id"), ("documents", "doc_id"))
    ),
)
def _(t):
    from functools import reduce

    keys = {
        "customer": "c_custkey",
        "supplier": "s_suppkey",
        "part": "p_partkey",
        "orders": "o_orderkey",
        "lineitem": "l_orderkey",
        "events": "event_id",
        "documents": "doc_id",
    }
    parts = [getattr(t, n).select(F.lit(n).alias("layer"), C(k).alias("id")) for n, k in keys.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "union_distinct",
    "members",
    """SELECT member, round(start_decdate, 6) AS d FROM members WHERE start_decdate IS NOT NULL UNION SELECT member, round(end_decdate, 6) FROM members WHERE end_decdate IS NOT NULL""",
)
def _(t):
    m = t.members()
    starts = m.select("member", F.round("start_decdate", 6).alias("d"))
    ends = m.select("member", F.round("end_decdate", 6).alias("d"))
    return starts.union(ends).filter("d IS NOT NULL").distinct()


@query(
    "union_tagged_source",
    "",
    "SELECT c_name AS name, 'world' AS source_table FROM customer UNION ALL SELECT s_name, 'europe' FROM supplier UNION ALL SELECT p_name, 'america' FROM part",
)
def _(t):
    parts = [(t.customer, "c_name", "world"), (t.supplier, "s_name", "europe"), (t.part, "p_name", "america")]
    tagged = [df.select(C(c).alias("name"), F.lit(s).alias("source_table")) for df, c, s in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
