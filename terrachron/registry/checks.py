"""Reconciliation of edits against published tables (R), status roll-ups (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrachron.functions import tiles
from terrachron.operators import mapping, quality, relational as rel
from terrachron.operators.skew import paged_lists
from terrachron.registry.base import ORACLE, query
from terrachron.registry.maps import sql_tx, sql_ty

C = F.col


@query(
    "replication_lag",
    "",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value * 7) AS BIGINT) END AS lag_seconds,
       CASE WHEN event_id % 5 = 0 THEN 'warning' WHEN floor(value * 7) > 300 THEN 'critical' ELSE 'ok' END AS status FROM events""",
)
def _(t):
    late = F.floor(C("value") * 7).cast("int")
    arrived = C("ts") + F.make_dt_interval(secs=late)
    stamp = F.when(C("event_id") % 5 != 0, C("ts"))
    check = quality.replication_lag(arrived, stamp, 300)
    return t.events.select("event_id", *[v.alias(k) for k, v in check.items()])


@query(
    "replication_covers",
    "",
    """WITH s AS (SELECT max(ts) - INTERVAL 5 DAY AS state FROM events)
       SELECT event_id, CASE WHEN state >= ts THEN 'ok' ELSE 'critical' END AS status,
         CASE WHEN state < ts THEN round(trunc((epoch_us(ts) - epoch_us(state)) / 1000000) / 60, 1) END AS minutes_behind FROM events, s""",
)
def _(t):
    state = t.events.agg((F.max("ts") - F.make_dt_interval(days=F.lit(5))).alias("timestamp"))
    rows = t.events.select("event_id", C("ts").alias("closed_at"))
    return quality.replication_covers(rows, state).select("event_id", "status", "minutes_behind")


@query(
    "missing_percentage",
    "elements",
    """SELECT changeset, count(*) AS total, count(*) FILTER (version >= 7) AS missing, round(count(*) FILTER (version >= 7) / count(*) * 100, 6) AS missing_pct,
       CASE WHEN count(*) FILTER (version >= 7) / count(*) * 100 >= 14 THEN 'failed' ELSE 'warning' END AS severity FROM elements GROUP BY changeset""",
)
def _(t):
    checked = t.elements().withColumn("is_missing", C("version") >= 7)
    return quality.missing_shares(checked, 14.0).withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "worst_status_rollup",
    "",
    """WITH r AS (SELECT CASE WHEN l_quantity >= 50 THEN 2 WHEN l_quantity >= 45 THEN 1 ELSE 0 END AS severity, l_suppkey, l_partkey FROM lineitem),
       v AS (SELECT l_suppkey AS grp, l_partkey AS view, max(severity) AS s FROM r GROUP BY 1, 2), g AS (SELECT grp, max(s) AS s FROM v GROUP BY 1)
       SELECT 'group' AS level, grp, (['ok', 'warning', 'critical'])[s + 1] AS status FROM g UNION ALL SELECT 'overall', -1, (['ok', 'warning', 'critical'])[max(s) + 1] FROM g""",
)
def _(t):
    q = C("l_quantity")
    status = F.when(q >= 50, "critical").when(q >= 45, "warning").otherwise("ok")
    rows = t.lineitem.select(C("l_suppkey").alias("grp"), C("l_partkey").alias("view"), status.alias("status"))
    views = rows.groupBy("grp", "view").agg(quality.worst("status").alias("status"))
    groups = views.groupBy("grp").agg(quality.worst("status").alias("status"))
    overall = groups.agg(quality.worst("status").alias("status"))
    return groups.select(F.lit("group").alias("level"), "grp", "status").unionByName(
        overall.select(F.lit("overall").alias("level"), F.lit(-1).cast("long").alias("grp"), "status")
    )


_PRESENT = """tab AS (SELECT 'lines' AS name, o_orderkey AS osm_id FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'areas', -o_orderkey FROM orders WHERE o_totalprice > 200000),
   vie AS (SELECT 'v_lines' AS name, o_orderkey AS osm_id FROM orders WHERE o_orderstatus = 'F'), gone AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 7),
   el AS (SELECT *, CASE WHEN version = 2 THEN 'relation' ELSE 'way' END AS kind FROM elements),
   pre AS (SELECT el.*, ft, fv, g.l_orderkey IS NOT NULL AND kind = 'way' AS is_gone FROM el LEFT JOIN (SELECT osm_id AS id, string_agg(DISTINCT name, ',' ORDER BY name) AS ft FROM tab GROUP BY 1) a ON a.id = CASE WHEN kind = 'relation' THEN -el.osm_id ELSE el.osm_id END
     LEFT JOIN (SELECT osm_id AS id, string_agg(DISTINCT name, ',' ORDER BY name) AS fv FROM vie GROUP BY 1) b ON b.id = CASE WHEN kind = 'relation' THEN -el.osm_id ELSE el.osm_id END LEFT JOIN gone g ON g.l_orderkey = el.osm_id),
   res AS (SELECT *, CASE WHEN action = 'delete' AND ft IS NOT NULL THEN 'not_deleted' WHEN action = 'delete' THEN 'ok' WHEN ft IS NOT NULL THEN 'ok' WHEN is_gone THEN 'skipped' ELSE 'missing' END AS outcome FROM pre)"""


def presence(t):
    elements = t.elements().withColumn("type", F.when(C("version") == 2, "relation").otherwise("way"))
    key = C("o_orderkey")
    lines = t.orders.filter("o_orderstatus <> 'P'").select(F.lit("lines").alias("name"), key.alias("osm_id"))
    areas = t.orders.filter("o_totalprice > 200000").select(F.lit("areas").alias("name"), (-key).alias("osm_id"))
    views = t.orders.filter("o_orderstatus = 'F'").select(F.lit("v_lines").alias("name"), key.alias("osm_id"))
    gone = t.lineitem.filter("l_linenumber = 7").select(F.lit("way").alias("type"), C("l_orderkey").alias("osm_id"))
    return quality.element_presence(elements, lines.unionByName(areas), views, gone)


@query(
    "element_presence",
    "elements",
    f"""WITH {_PRESENT} SELECT changeset, kind AS type, osm_id, version, action, ft AS found_in_tables, CASE WHEN action <> 'delete' AND ft IS NOT NULL THEN fv END AS found_in_views, outcome FROM res""",
)
def _(t):
    rows = presence(t)
    return rows.select(
        "changeset", "type", "osm_id", "version", "action", *[F.array_join(c, ",").alias(c) for c in ("found_in_tables", "found_in_views")], "outcome"
    )


@query(
    "changeset_status",
    "elements",
    f"""WITH {_PRESENT}, out AS (SELECT CASE WHEN outcome = 'not_deleted' AND version < 7 THEN 'ok' WHEN outcome = 'missing' AND part % 50 <> 0 THEN 'ok' ELSE outcome END AS outcome, changeset * 100 + part % 100 AS changeset FROM res)
        SELECT changeset, count(*) AS checked, CASE WHEN bool_or(outcome = 'not_deleted') THEN 'warning' WHEN bool_or(outcome = 'missing') THEN 'retry_pending'
          WHEN changeset IN (SELECT o_custkey FROM orders) THEN 'warning' ELSE 'ok' END AS status FROM out GROUP BY changeset""",
)
def _(t):
    settled = (
        F.when((C("outcome") == "not_deleted") & (C("version") < 7), "ok")
        .when((C("outcome") == "missing") & (C("part") % 50 != 0), "ok")
        .otherwise(C("outcome"))
    )
    rows = presence(t).withColumns({"outcome": settled, "changeset": C("changeset") * 100 + C("part") % 100})
    return quality.changeset_status(rows, t.orders.select(C("o_custkey").alias("changeset")))


@query(
    "skip_passed_changesets",
    "",
    "SELECT c_custkey AS changeset FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000)",
)
def _(t):
    status = F.when((C("o_orderstatus") == "P") & (C("o_totalprice") > 250000), "ok").otherwise("warning")
    history = t.orders.select(C("o_custkey").alias("changeset"), status.alias("status"))
    return quality.not_yet_passed(t.customer.select(C("c_custkey").alias("changeset")), history)


@query(
    "view_freshness",
    "",
    """WITH x AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'water' ELSE 'transport' END AS grp, c_custkey AS view, CASE WHEN c_custkey % 2 = 0 THEN 8640000 ELSE 17280000 END AS max_age FROM customer),
       s AS (SELECT o_custkey AS view, count(*) FILTER (o_orderstatus <> 'P') AS n, max(o_orderdate) AS newest FROM orders GROUP BY 1), now AS (SELECT max(o_orderdate) AS moment FROM orders)
       SELECT grp, view, n AS rows, CAST(date_diff('second', newest, moment) AS BIGINT) AS age_seconds, CASE WHEN n IS NULL THEN 'critical' WHEN n = 0 OR COALESCE(date_diff('second', newest, moment) > max_age, FALSE) THEN 'warning' ELSE 'ok' END AS status
       FROM x LEFT JOIN s USING (view), now""",
)
def _(t):
    n = C("c_custkey")
    expected = t.customer.select(
        F.when(n % 2 == 0, "water").otherwise("transport").alias("group"), n.alias("view"), F.when(n % 2 == 0, 8_640_000).otherwise(17_280_000).alias("max_age")
    )
    stats = t.orders.groupBy(C("o_custkey").alias("view")).agg(
        F.count_if(C("o_orderstatus") != "P").alias("rows"), F.max("o_orderdate").alias("newest")
    )
    now = t.orders.agg(F.max("o_orderdate")).first()[0]
    return quality.view_freshness(expected, stats, now).withColumnRenamed("group", "grp")


@query(
    "stale_tile_check",
    "features",
    f"""WITH tl AS (SELECT id AS changeset, ts AS closed_at, 6 AS z, {sql_tx('lon', '6')} AS x, {sql_ty('lat', '6')} AS y FROM features),
        cache AS (SELECT z, x, y, max(closed_at) - INTERVAL 2 DAY AS last_modified FROM tl WHERE changeset % 3 <> 0 GROUP BY z, x, y)
        SELECT changeset, z, x, y, 'main' AS prefix FROM tl JOIN cache USING (z, x, y) WHERE last_modified < closed_at""",
)
def _(t):
    z = F.lit(6)
    touched = t.features().select(
        C("id").alias("changeset"), C("ts").alias("closed_at"), z.alias("z"), tiles.tile_x(C("lon"), z).alias("x"), tiles.tile_y(C("lat"), z).alias("y")
    )
    newest = (F.max("closed_at") - F.make_dt_interval(days=F.lit(2))).alias("last_modified")
    cache = touched.filter("changeset % 3 <> 0").groupBy("z", "x", "y").agg(newest).withColumn("prefix", F.lit("main"))
    return quality.stale_tiles(touched, cache).select("changeset", "z", "x", "y", "prefix")


@query("comment_drafts")
def _(t):
    checked = mapping.skip_reasons(t.tagged())
    drafts = quality.comment_lines(checked)
    lines = paged_lists(drafts, ["changeset"], [C("type"), C("osm_id")], C("line"), "lines", 500)
    return lines.select("changeset", "page", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("body"))


# The drafts follow from the checked skip reasons; their SQL is put on top of that one.
_SKIPS = ORACLE["skip_reason"]
ORACLE["comment_drafts"] = f"""SELECT e.user_id AS changeset, CAST((rn - 1) // 500 AS INTEGER) AS page, CAST(count(*) AS INTEGER) AS n, string_agg(line, chr(10) ORDER BY rn) AS body
  FROM (SELECT e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY kind, s.osm_id) AS rn, '- ' || kind || ' ' || s.osm_id || ': ' || skip_reason AS line
    FROM ({_SKIPS}) s JOIN (SELECT *, (['node', 'way', 'relation'])[CAST((event_id // 72) % 3 + 1 AS INTEGER)] AS kind FROM events) e ON e.event_id = s.osm_id WHERE commentable) e GROUP BY 1, 2"""


@query(
    "alert_transitions",
    "",
    """WITH r AS (SELECT user_id AS check_id, ts, event_id, CASE WHEN value < 5 THEN 'critical' WHEN value < 15 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN value < 2 THEN 1 ELSE 0 END AS newly FROM events),
       p AS (SELECT *, lag(status) OVER (PARTITION BY check_id ORDER BY ts, event_id) AS prev FROM r),
       e AS (SELECT *, CASE WHEN newly > 0 THEN 'failed' WHEN status = 'warning' AND (prev IS NULL OR prev = 'ok') THEN 'warning' WHEN status = 'ok' AND prev IN ('critical', 'warning') THEN 'recovered' END AS event FROM p)
       SELECT check_id, event_id, event FROM e WHERE event IS NOT NULL""",
)
def _(t):
    v = C("value")
    runs = t.events.select(
        C("user_id").alias("check"), C("ts").alias("run_at"), C("event_id").alias("run_id"),
        F.when(v < 5, "critical").when(v < 15, "warning").otherwise("ok").alias("status"), F.when(v < 2, 1).otherwise(0).alias("newly_failed"),
    )
    alerts = quality.alert_transitions(runs)
    return alerts.select(C("check").alias("check_id"), C("run_id").alias("event_id"), "event")


@query(
    "missing_ids_by_date",
    "",
    """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01')
       SELECT CAST(g AS BIGINT) AS id FROM b, LATERAL (SELECT unnest(generate_series(lo, hi)) AS g) WHERE g NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def _(t):
    dated = t.orders.filter("o_orderdate >= DATE'1995-01-01' AND o_orderdate < DATE'1996-01-01'")
    low, high = dated.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    present = t.lineitem.select(C("l_orderkey").alias("id"))
    return rel.missing_ids(present, "id", low, 1, high)
