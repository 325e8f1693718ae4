"""Windows (W) and the temporal jobs: boundaries, overrides, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrachron.functions import geometry as geo, routes as route_functions
from terrachron.operators import boundaries, intervals, override, routes
from terrachron.operators.skew import (
    OrderedGroups,
    first_per_key,
    number_rows,
    running_sum_of_peers,
    top_per_key,
)
from terrachron.registry.base import query, sql_decimal, sql_iso, sql_priority
from terrachron.session import materialize

C = F.col


def rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


def grouped(t):
    by_start = [C("start_decdate").asc_nulls_first(), C("osm_id")]
    return OrderedGroups(t.members(), ["status", "member"], by_start)


_LAG = """o AS (SELECT *, lag(end_decdate) OVER (PARTITION BY status, member ORDER BY start_decdate NULLS FIRST, osm_id) AS prev_end FROM members),
 f AS (SELECT *, CASE WHEN prev_end IS NULL OR start_decdate IS NULL OR start_decdate - prev_end < 0.003 THEN 0 ELSE 1 END AS gap FROM o),
 g AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY status, member ORDER BY start_decdate NULLS FIRST, osm_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS group_id FROM f)"""


@query("lag_prev_end", "members", f"WITH {_LAG} SELECT osm_id, round(prev_end, 6) AS prev_end FROM o")
def _(t):
    return grouped(t).lag("end_decdate", "prev_end").frame().select("osm_id", *rounded("prev_end"))


def flagged(t):
    return grouped(t).lag("end_decdate", "prev_end").map(
        lambda d: d.withColumn("gap", intervals.gap_flag(C("start_decdate"), C("prev_end")))
    )


@query("gap_flag", "members", f"WITH {_LAG} SELECT osm_id, gap FROM f")
def _(t):
    return flagged(t).frame().select("osm_id", "gap")


@query("running_group_id", "members", f"WITH {_LAG} SELECT osm_id, group_id FROM g")
def _(t):
    return flagged(t).running_sum("gap", "group_id").frame().select("osm_id", "group_id")


@query(
    "running_sum_range",
    "members",
    """SELECT osm_id, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY type ORDER BY start_date) AS BIGINT) AS grp FROM members""",
)
def _(t):
    flag = F.when(C("status") == "F", 1).otherwise(0)
    return running_sum_of_peers(t.members(), ["type"], "start_date", flag, "grp").select("osm_id", "grp")


@query(
    "lead_segment_end",
    "members",
    """d AS (SELECT DISTINCT member, unnest([start_decdate, end_decdate]) AS s FROM members)
       SELECT member, round(s, 6) AS seg_start, round(lead(s) OVER (PARTITION BY member ORDER BY s), 6) AS seg_end FROM d WHERE s IS NOT NULL""".replace(
        "d AS", "WITH d AS", 1
    ),
)
def _(t):
    segments = intervals.cut_segments(t.members(), "member")
    return segments.select("member", *rounded("seg_start", "seg_end"))


@query(
    "row_number_global_id",
    "",
    "SELECT row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS id, o_orderkey FROM orders",
)
def _(t):
    order = [C("o_custkey"), C("o_orderdate"), C("o_orderkey")]
    return number_rows(t.orders, order).select("id", "o_orderkey")


@query(
    "row_number_rank_slots",
    "route_rows",
    f"""SELECT osm_id, way_id, type, row_number() OVER (PARTITION BY way_id, highway, type
        ORDER BY CASE WHEN ref IS NULL THEN 1 ELSE 0 END, {sql_priority('type', 'network', 'ref')} DESC, osm_id) AS type_rnk FROM route_rows""",
)
def _(t):
    scored = t.route_rows().withColumn(
        "prio", route_functions.route_priority(C("type"), C("network"), C("ref"))
    )
    order = [C("ref").isNull(), C("prio").desc(), C("osm_id")]
    ranked = OrderedGroups(scored, ["way_id", "highway", "type"], order).row_number("type_rnk")
    return ranked.frame().select("osm_id", "way_id", "type", "type_rnk")


@query(
    "row_number_unordered",
    "",
    """SELECT row_number() OVER (ORDER BY source, name, key) AS id, source, name FROM (SELECT 1 AS source, c_name AS name, c_custkey AS key FROM customer
       UNION ALL SELECT 2, s_name, s_suppkey FROM supplier UNION ALL SELECT 3, p_name, p_partkey FROM part)""",
)
def _(t):
    parts = [(t.customer, "c_name", "c_custkey"), (t.supplier, "s_name", "s_suppkey"), (t.part, "p_name", "p_partkey")]
    tagged = [
        df.select(F.lit(i).alias("source"), C(n).alias("name"), C(k).alias("key"))
        for i, (df, n, k) in enumerate(parts, 1)
    ]
    union = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return number_rows(union, [C("source"), C("name"), C("key")]).select("id", "source", "name")


@query(
    "new_segment_flag",
    "members",
    """p AS (SELECT *, lag(end_decdate) OVER (PARTITION BY member, type ORDER BY start_decdate, osm_id) AS prev FROM members WHERE start_decdate IS NOT NULL)
       SELECT osm_id, CASE WHEN prev IS NULL OR start_decdate - prev > CAST(1 AS DOUBLE) / 365 THEN 1 ELSE 0 END AS is_new FROM p""".replace(
        "p AS", "WITH p AS", 1
    ),
)
def _(t):
    dated = t.members().filter("start_decdate IS NOT NULL")
    rows = OrderedGroups(dated, ["member", "type"], [C("start_decdate"), C("osm_id")]).lag("end_decdate", "prev").frame()
    return rows.select("osm_id", intervals.new_segment_flag(C("start_decdate"), C("prev")).alias("is_new"))


@query(
    "latest_per_key",
    "",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def _(t):
    return first_per_key(t.events, ["user_id"], [C("event_id").desc()]).select("user_id", "event_id", "event_type")


@query(
    "first_seen_newest_wins",
    "elements",
    """SELECT osm_id, version, changeset FROM (SELECT *, row_number() OVER (PARTITION BY type, osm_id ORDER BY timestamp DESC, version DESC, part, changeset, price) AS rn FROM elements) WHERE rn = 1""",
)
def _(t):
    order = [C("timestamp").desc(), C("version").desc(), C("part"), C("changeset"), C("price")]
    return first_per_key(t.elements(), ["type", "osm_id"], order).select("osm_id", "version", "changeset")


# ---- boundaries ----

_ISLANDS = """m AS (SELECT status, member, group_id, count(*) AS merged_row_count,
   CASE WHEN bool_or(start_decdate IS NULL) THEN NULL ELSE min(start_decdate) END AS s,
   CASE WHEN bool_or(end_decdate IS NULL) THEN NULL ELSE max(end_decdate) END AS e,
   max(ref) AS ref, max(network) AS network FROM g GROUP BY status, member, group_id)"""


@query(
    "boundary_interval_merge",
    "members",
    f"""WITH {_LAG}, {_ISLANDS}, first AS (SELECT status, member, group_id, price FROM (SELECT *, row_number() OVER (PARTITION BY status, member, group_id ORDER BY start_decdate NULLS FIRST, osm_id) AS rn FROM g) WHERE rn = 1)
        SELECT status, member, group_id, merged_row_count, round(s, 6) AS min_start_decdate, round(e, 6) AS max_end_decdate,
          {sql_iso('s')} AS min_start_date_iso, {sql_iso('e')} AS max_end_date_iso, price, ref, network
        FROM m JOIN first USING (status, member, group_id)""",
)
def _(t):
    merged = intervals.merge_intervals(
        t.members(),
        ["status", "member"],
        tie="osm_id",
        first=["price"],
        largest={"ref": "ref", "network": "network"},
    )
    return merged.withColumns(
        {c: F.round(c, 6) for c in ("min_start_decdate", "max_end_decdate")}
    )


_LEVEL = "CASE status WHEN 'F' THEN 2 WHEN 'O' THEN 4 ELSE 6 END"


def boundary_inputs(t):
    m = t.members()
    level = F.when(C("status") == "F", 2).when(C("status") == "O", 4).otherwise(6)
    members = m.select(
        F.lit("administrative").alias("type"),
        level.alias("admin_level"),
        "member",
        "osm_id",
        geo.line(F.array(geo.vertex(C("price"), C("osm_id")), geo.vertex(C("osm_id"), C("price")))).alias("geometry"),
        "start_decdate",
        "end_decdate",
        C("ref").alias("me_indefinite"),
        F.when(C("network") == "US:I", "yes").otherwise("").alias("me_maritime"),
        C("network").alias("me_disputed"),
        F.lit("").alias("me_disputed_by"),
    )
    n = C("c_custkey")
    lines = t.customer.select(
        F.lit("administrative").alias("type"),
        (C("c_nationkey") % 13 + 1).alias("admin_level"),
        (n * 2).alias("osm_id"),
        geo.line(F.array(geo.vertex(n, n), geo.vertex(n + 1, n))).alias("geometry"),
        (F.lit(1700) + n % 300).cast("string").alias("start_date"),
        F.lit("").alias("end_date"),
        F.lit("").alias("indefinite"),
        F.lit("yes").alias("maritime"),
        F.lit(None).cast("string").alias("disputed"),
        C("c_mktsegment").alias("disputed_by"),
    )
    return members, lines


@query(
    "boundary_lines",
    "members",
    f"""WITH {_LAG}, m AS (SELECT {_LEVEL} AS admin_level, member, group_id,
          CASE WHEN bool_or(start_decdate IS NULL) THEN NULL ELSE min(start_decdate) END AS s,
          CASE WHEN bool_or(end_decdate IS NULL) THEN NULL ELSE max(end_decdate) END AS e,
          NULLIF(max(ref), '') AS indefinite, NULLIF(max(CASE WHEN network = 'US:I' THEN 'yes' ELSE '' END), '') AS maritime,
          NULLIF(max(network), '') AS disputed, CAST(NULL AS VARCHAR) AS disputed_by FROM g GROUP BY ALL),
        u AS (SELECT admin_level, member, group_id, s, e, {sql_iso('s')} AS start_date, {sql_iso('e')} AS end_date, indefinite, maritime, disputed, disputed_by FROM m
          UNION ALL SELECT c_nationkey % 13 + 1, c_custkey * 2, 0, {sql_decimal('CAST(1700 + c_custkey % 300 AS VARCHAR)', 'start')}, NULL,
            CAST(1700 + c_custkey % 300 AS VARCHAR), '', NULL, 'yes', NULL, c_mktsegment FROM customer
            WHERE c_custkey * 2 NOT IN (SELECT member FROM m))
        SELECT row_number() OVER (ORDER BY admin_level, member, group_id) AS id, admin_level, member AS osm_id, group_id,
          round(s, 6) AS start_decdate, round(e, 6) AS end_decdate, start_date, end_date, indefinite, maritime, disputed, disputed_by
        FROM u WHERE admin_level BETWEEN 1 AND 11""",
)
def _(t):
    members, lines = boundary_inputs(t)
    merged = materialize(boundaries.merge_members(members), "boundary-members")
    combined = boundaries.relations_and_ways(merged, lines)
    view = boundaries.boundary_lines(combined).drop("geometry", "type")
    return view.withColumns({c: F.round(c, 6) for c in ("start_decdate", "end_decdate")})


# ---- street overrides ----

_TRANSPORT = """ways AS (SELECT 1 AS id, p_partkey AS osm_id, p_brand AS name, CASE WHEN p_size % 9 = 0 THEN 'construction' ELSE lower(p_type) END AS highway,
   CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS ref, lower(p_type) AS type, 0 AS tunnel, p_size % 2 AS bridge, p_size AS z_order,
   '1915' AS start_date, CASE WHEN p_partkey % 4 = 0 THEN '1996-06' ELSE '' END AS end_date, p_brand AS tag_name, lower(p_type) AS planned FROM part),
 streets AS (SELECT -l_orderkey AS osm_id, l_partkey AS member, CASE WHEN l_orderkey % 2 = 1 THEN 'S' || l_orderkey ELSE p_brand END AS name,
   CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
 pairs AS (SELECT t.osm_id AS way, s.osm_id AS rel, s.start_date FROM ways t JOIN streets s ON s.member = t.osm_id WHERE NULLIF(s.name, '') IS NOT NULL AND s.name IS DISTINCT FROM t.name),
 early AS (SELECT way, min(NULLIF(start_date, '')) AS cut FROM pairs GROUP BY way),
 expanded AS (SELECT t.id || '_' || t.osm_id AS id, t.osm_id, name, highway, ref, type, tunnel, bridge, z_order, start_date,
     least(NULLIF(end_date, ''), cut) AS end_date, tag_name, planned, CAST(NULL AS BIGINT) AS relation FROM ways t LEFT JOIN early ON way = osm_id
   UNION ALL SELECT s.osm_id || '_' || t.osm_id, t.osm_id, COALESCE(NULLIF(s.name, ''), t.name), highway, ref, type, tunnel, bridge, z_order, s.start_date, '', tag_name, planned, abs(s.osm_id)
     FROM ways t JOIN streets s ON s.member = t.osm_id WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.way = t.osm_id AND p.rel = s.osm_id)),
 combined AS (SELECT *, 'way' AS source_type FROM expanded WHERE osm_id NOT IN (SELECT s_suppkey * 7 FROM supplier)
   UNION ALL SELECT '3_' || -s_suppkey, s_suppkey * 7, s_name, 'primary', '', 'primary', NULL, NULL, NULL, '1900', '', s_name, NULL, s_suppkey, 'relation' FROM supplier)"""


@query(
    "transport_lines_override",
    "",
    f"""WITH {_TRANSPORT}, one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_type, relation, start_date, end_date, name) AS rn FROM combined)
        SELECT id, osm_id, CASE WHEN highway = 'construction' THEN COALESCE(NULLIF(planned, '') || '_construction', 'road_construction') ELSE type END AS type,
          planned AS construction, NULLIF(name, '') AS name, NULLIF(ref, '') AS ref, NULLIF(highway, '') AS highway, NULLIF(tunnel, 0) AS tunnel, NULLIF(bridge, 0) AS bridge, z_order,
          NULLIF(start_date, '') AS start_date, NULLIF(end_date, '') AS end_date, round({sql_decimal('start_date', 'start')}, 6) AS start_decdate,
          round({sql_decimal('end_date', 'end')}, 6) AS end_decdate, tag_name, relation, source_type FROM one WHERE rn = 1""",
)
def _(t):
    rows = override.override_lines(*t.transport())
    return rows.select(
        "id", "osm_id", "type", "construction", "name", "ref", "highway", "tunnel", "bridge", "z_order", "start_date", "end_date",
        *rounded("start_decdate", "end_decdate"), F.try_element_at("tags", F.lit("name")).alias("tag_name"), "relation", "source_type",
    )


# ---- routes ----

_PERIODS = f"""cut AS (SELECT DISTINCT way_id, unnest([start_decdate, end_decdate]) AS s FROM route_rows),
 seg AS (SELECT way_id, s, lead(s) OVER (PARTITION BY way_id ORDER BY s) AS e FROM cut WHERE s IS NOT NULL),
 act AS (SELECT seg.s, seg.e, u.* FROM seg JOIN route_rows u ON u.way_id = seg.way_id AND (u.start_decdate IS NULL OR u.start_decdate < COALESCE(e, 9999)) AND (u.end_decdate IS NULL OR u.end_decdate > s)),
 dis AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY way_id, s, e, ref, network, direction ORDER BY osm_id) AS rn FROM act) WHERE rn = 1),
 base AS (SELECT way_id, s, e, {sql_iso('s')} AS si, {sql_iso('e')} AS ei, count(DISTINCT osm_id) AS num_routes, max(highway) AS highway,
   md5(string_agg(trim(upper(COALESCE(ref, ''))) || '|' || trim(upper(COALESCE(network, ''))), ';' ORDER BY trim(upper(COALESCE(ref, ''))), trim(upper(COALESCE(network, ''))))) AS hash FROM dis GROUP BY way_id, s, e),
 fl AS (SELECT *, CASE WHEN lag(e) OVER w IS NULL THEN 1 WHEN s - lag(e) OVER w > CAST(1 AS DOUBLE) / 365 THEN 1 ELSE 0 END AS is_new FROM base WINDOW w AS (PARTITION BY way_id, hash ORDER BY s)),
 gr AS (SELECT *, sum(is_new) OVER (PARTITION BY way_id, hash ORDER BY s) AS grp FROM fl),
 mer AS (SELECT way_id, min(s) AS s, max(e) AS e, min(si) AS si, max(ei) AS ei, max(num_routes) AS num_routes, max(highway) AS highway FROM gr GROUP BY way_id, hash, grp),
 und AS (SELECT way_id, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS e, CAST(NULL AS VARCHAR) AS si, CAST(NULL AS VARCHAR) AS ei,
   count(DISTINCT osm_id) AS num_routes, max(highway) AS highway FROM route_rows WHERE way_id NOT IN (SELECT way_id FROM cut WHERE s IS NOT NULL) GROUP BY way_id),
 per AS (SELECT * FROM mer UNION ALL SELECT * FROM und),
 rou AS (SELECT per.way_id, per.s, per.e, dis.* EXCLUDE (way_id, s, e, rn) FROM per JOIN dis ON dis.way_id = per.way_id AND dis.s = per.s
   UNION ALL SELECT und.way_id, und.s, und.e, r.* EXCLUDE (way_id) FROM und JOIN route_rows r ON r.way_id = und.way_id)"""


def normalized(t):
    rows = t.route_rows()
    # Every fifth way has its dates removed, so both branches have work. Adding NULL
    # keeps the date expressions out of a conditional, where they would be repeated.
    blank = F.when(C("way_id") % 5 != 0, 0.0)
    dated = rows.withColumns({c: C(c) + blank for c in ("start_decdate", "end_decdate")})
    # A layer table is written once at load, with its decimal dates.
    return materialize(dated, "route-rows")


def _periods_sql(tail: str) -> str:
    body = _PERIODS.replace("route_rows", "rr")
    blank = ", ".join(
        f"CASE WHEN way_id % 5 <> 0 THEN {c} END AS {c}" for c in ("start_decdate", "end_decdate")
    )
    return f"WITH rr AS (SELECT * REPLACE ({blank}) FROM route_rows), {body} {tail}"


@query(
    "routes_normalized",
    "route_rows",
    _periods_sql(
        """, lists AS (SELECT way_id, s, e, string_agg(CAST(osm_id AS VARCHAR), ',' ORDER BY ref NULLS LAST, osm_id) AS routes FROM rou GROUP BY way_id, s, e)
        SELECT row_number() OVER (ORDER BY per.way_id, per.s, per.e) AS uid, per.way_id, round(per.s, 6) AS min_start_decdate, round(per.e, 6) AS max_end_decdate, si AS min_start_date_iso,
          ei AS max_end_date_iso, (SELECT arg_min(geometry, osm_id) FROM rr WHERE rr.way_id = per.way_id) AS x, num_routes, highway, 0 AS page, routes
        FROM per LEFT JOIN lists ON lists.way_id = per.way_id AND lists.s IS NOT DISTINCT FROM per.s AND lists.e IS NOT DISTINCT FROM per.e"""
    ),
)
def _(t):
    rows = routes.normalized_lists(normalized(t))
    ids = F.array_join(F.transform("routes", lambda r: r["osm_id"].cast("string")), ",")
    return rows.select(
        "uid", "way_id", *rounded("min_start_decdate", "max_end_decdate"), "min_start_date_iso", "max_end_date_iso",
        C("geometry.parts")[0][0][0]["x"].alias("x"), "num_routes", "highway", "page", ids.alias("routes"),
    )


_SLOTS = ", ".join(
    f"max(CASE WHEN type = '{kind}' AND rnk = {i} THEN {a} END) AS route_{kind}_{i}_{a}"
    for kind in route_functions.ROUTE_TYPES
    for i in range(1, 7)
    for a in route_functions.SLOT_ATTRIBUTES
)
_RANKED = f""", rk AS (SELECT *, row_number() OVER (PARTITION BY way_id, s, e, type ORDER BY CASE WHEN ref IS NULL THEN 1 ELSE 0 END, {sql_priority('type', 'network', 'ref')} DESC, osm_id) AS rnk FROM rou),
 pv AS (SELECT way_id, s, e, {_SLOTS} FROM rk GROUP BY way_id, s, e)"""
_SLOT_NAMES = [c for kind in route_functions.ROUTE_TYPES for c in route_functions.slot_columns(kind)]


@query(
    "routes_indexed",
    "route_rows",
    _periods_sql(
        _RANKED
        + f""" SELECT per.way_id, round(per.s, 6) AS min_start_decdate, round(per.e, 6) AS max_end_decdate, si AS min_start_date_iso, ei AS max_end_date_iso, num_routes, highway,
        {', '.join('pv.' + c for c in _SLOT_NAMES)} FROM per LEFT JOIN pv ON pv.way_id = per.way_id AND pv.s IS NOT DISTINCT FROM per.s AND pv.e IS NOT DISTINCT FROM per.e"""
    ),
)
def _(t):
    indexed = routes.normalized_slots(normalized(t)).drop("geometry")
    return indexed.withColumns({c: F.round(c, 6) for c in ("min_start_decdate", "max_end_decdate")})


@query(
    "routes_by_zoom",
    "route_rows",
    _periods_sql(
        _RANKED
        + f""" SELECT row_number() OVER (ORDER BY per.way_id, per.s, per.e) AS id, per.way_id AS osm_id, round(per.s, 6) AS start_decdate, round(per.e, 6) AS end_decdate, si AS start_date, ei AS end_date,
        NULLIF(highway, '') AS highway, {', '.join(f"NULLIF(pv.{c}, '') AS {c}" for c in _SLOT_NAMES)} FROM per LEFT JOIN pv ON pv.way_id = per.way_id AND pv.s IS NOT DISTINCT FROM per.s AND pv.e IS NOT DISTINCT FROM per.e"""
    ),
)
def _(t):
    view = routes.routes_view(routes.normalized_slots(normalized(t))).drop("geometry")
    return view.withColumns({c: F.round(c, 6) for c in ("start_decdate", "end_decdate")})


@query(
    "conditional_max_pivot",
    "route_rows",
    f"""WITH rk AS (SELECT *, row_number() OVER (PARTITION BY way_id, type ORDER BY osm_id) AS rnk FROM route_rows)
        SELECT way_id, {_SLOTS} FROM rk WHERE type IN ({', '.join(f"'{k}'" for k in route_functions.ROUTE_TYPES)}) GROUP BY way_id""",
)
def _(t):
    known = t.route_rows().filter(C("type").isin(route_functions.ROUTE_TYPES))
    ranked = top_per_key(known, ["way_id", "type"], [C("osm_id")], route_functions.SLOTS, "type_rnk")
    return routes.pivot_slots(ranked, ["way_id"])
