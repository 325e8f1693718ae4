"""Layer scans, tag mapping and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrachron.functions import geometry as geo, text
from terrachron.operators import languages as lang, mapping
from terrachron.registry.base import query
from terrachron.session import work_path
from terrachron.sources import layers as src

C = F.col


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def rules_sql(chosen=None) -> str:
    """The mapping rules as a VALUES table."""
    rows = []
    for i, (layer, geometry, key, accepted, excluded, reject, types) in enumerate(mapping.rule_rows(chosen)):
        wild = [k for k, v in reject.items() if src.ANY in v]
        pairs = [f"{k}={v}" for k, vs in reject.items() for v in vs if v != src.ANY]
        coast = pairs + (["natural=coastline"] if "natural" in src.LAYERS[layer].mapping and "natural=coastline" not in pairs else [])
        rows.append(
            f"({i}, '{layer}', '{geometry}', '{key}', {_sql_list(accepted)}, {_sql_list(excluded)}, "
            f"{_sql_list(types)}, {_sql_list(wild)}, {_sql_list(pairs)}, {_sql_list(coast)})"
        )
    return (
        "rules(ord, layer, geometry, key, accepted, excluded, types, wild, pairs, coast) AS (VALUES "
        + ", ".join(rows)
        + ")"
    )


_PAIRS = "prs AS (SELECT osm_id, list(k || '=' || v) AS have, list(k) AS keys FROM tag_rows GROUP BY osm_id)"


def _mapped_sql(chosen=None) -> str:
    return f"""WITH {rules_sql(chosen)}, {_PAIRS}
        SELECT t.osm_id, t.type, r.layer, r.geometry, t.k AS class, t.v AS type_value FROM tag_rows t JOIN rules r ON r.key = t.k JOIN prs ON prs.osm_id = t.osm_id
        WHERE (list_contains(accepted, '__any__') OR list_contains(accepted, t.v)) AND NOT list_contains(excluded, t.v) AND list_contains(types, t.type)
          AND NOT list_has_any(pairs, have) AND NOT list_has_any(wild, keys)"""


@query(
    "scan_layer",
    "rects",
    """SELECT osm_id, name, type, round(area, 6) AS area FROM rects WHERE osm_id % 10 <> 0""",
)
def _(t):
    path = work_path(t.spark, "place_areas")
    shape = F.when(C("osm_id") % 10 != 0, C("geometry"))
    t.rects().withColumns({"geometry": shape, "population": F.lit(None).cast("int")}).write.parquet(path)
    rows = src.read_layer(t.spark, "place_areas", path)
    return rows.select("osm_id", "name", "type", F.round("area", 6).alias("area"))


@query("tag_mapping_scan", "tag_rows", _mapped_sql())
def _(t):
    mapped = mapping.map_elements(t.tagged())
    return mapped.select("osm_id", "type", "layer", C("shape").alias("geometry"), "class", "type_value")


CHOSEN = ["water_areas", "water_lines", "place_points", "no_such_layer"]


@query("backfill_by_layer", "tag_rows", _mapped_sql(CHOSEN))
def _(t):
    from terrachron.plans.publish import open_view, publish

    mapped = mapping.map_elements(t.tagged(), CHOSEN)
    rows = mapped.select("osm_id", "type", "layer", C("shape").alias("geometry"), "class", "type_value")
    root = work_path(t.spark, "backfill")
    publish(rows, root, "water_and_places", ["osm_id", "layer", "class"])
    return open_view(t.spark, root, "water_and_places")


@query(
    "tag_exclude",
    "tag_rows",
    """SELECT osm_id, k, v FROM tag_rows WHERE k NOT IN ('source') AND k NOT LIKE 'source:%' AND k NOT LIKE 'name:e%'""",
)
def _(t):
    kept = text.drop_tags(C("tags"), ["source", "source:*", "name:e*"])
    return t.tagged().select("osm_id", F.explode(kept).alias("k", "v"))


@query(
    "relation_member_scan",
    "tagged",
    """SELECT t.osm_id, t.main_value AS relation_value, m.ref AS member, m.role, CASE WHEN e.osm_id IS NOT NULL THEN 'n' || e.osm_id END AS me_name, e.main_value AS me_value
       FROM tagged t, (SELECT osm_id, unnest([osm_id * 2, osm_id + 1, osm_id + 1000000]) AS ref, unnest(['outer', 'label', '']) AS role FROM tagged) m
       LEFT JOIN tagged e ON e.osm_id = m.ref AND e.type = 'way' WHERE t.type = 'relation' AND m.osm_id = t.osm_id""",
)
def _(t):
    n = C("osm_id")

    def member(ref, role):
        return F.struct(F.lit("way").alias("type"), ref.alias("ref"), F.lit(role).alias("role"))

    elements = t.tagged().withColumn("geometry", geo.point(C("x"), C("y")))
    listed = F.array(member(n * 2, "outer"), member(n + 1, "label"), member(n + 1_000_000, ""))
    relations = elements.filter("type = 'relation'").withColumn("members", listed)
    rows = mapping.relation_members(relations, elements.filter("type = 'way'"))
    return rows.select(
        "osm_id",
        F.map_values("tags")[0].alias("relation_value"),
        "member",
        "role",
        text.tag(C("me_tags"), "name").alias("me_name"),
        F.map_values("me_tags")[0].alias("me_value"),
    )


@query(
    "static_land_scan",
    "",
    """SELECT ogc_fid, source_table, x0 AS xmin FROM (SELECT c_custkey AS ogc_fid, 'land_polygons' AS source_table, c_custkey * CAST(10.0 AS DOUBLE) AS x0 FROM customer
       UNION ALL SELECT s_suppkey, 'ne_10m_lakes', s_suppkey * CAST(10.0 AS DOUBLE) FROM supplier)""",
)
def _(t):
    from terrachron.sources.static import read_static

    root = work_path(t.spark, "static")
    land = t.rects().select(C("osm_id").alias("ogc_fid"), "name", "geometry")
    n = C("s_suppkey")
    lake = geo.rectangle(n * 10.0, n * 1.0, F.lit(3.0), F.lit(2.0))
    lakes = t.supplier.select(n.alias("ogc_fid"), C("s_name").alias("name"), lake.alias("geometry"))
    land.write.parquet(f"{root}/land_polygons")
    lakes.write.json(f"{root}/ne_10m_lakes")
    rows = read_static(t.spark, f"{root}/land_polygons", "land_polygons").unionByName(
        read_static(t.spark, f"{root}/ne_10m_lakes", "ne_10m_lakes")
    )
    return rows.select("ogc_fid", "source_table", geo.bounds(C("geometry"))["xmin"].alias("xmin"))


# ---- languages ----


def language_layers(t):
    def boxed(df):
        return df.select("tags", C("x").alias("xmin"), C("y").alias("ymin"), C("x").alias("xmax"), C("y").alias("ymax"))

    return [boxed(t.tagged()), boxed(t.name_tags())]


_LANG = "'^name:[a-z]{2,3}(-[A-Z][a-z]{3})?((-[a-z]{2,}|x-[a-z]{2,})(-[a-z]{2,})?)?(-([A-Z]{2}|\\d{3}))?$'"
_BOX = "round(min(x), 3) AS xmin, round(min(y), 3) AS ymin, round(max(x), 3) AS xmax, round(max(y), 3) AS ymax"
_KEYS = "(SELECT 'name:' || language AS k, x, y FROM tagged UNION ALL SELECT 'name:' || lang, x, y FROM name_tags)"


def rounded_box(df, digits=3):
    return df.withColumns({c: F.round(c, digits) for c in lang.BOX})


_SEARCH = f"""SELECT lower(regexp_replace(k, '[:\\-]', '_', 'g')) AS alias, k AS language_key, count(*) AS total_count, {_BOX}
       FROM {_KEYS} WHERE regexp_matches(k, {_LANG}) GROUP BY k"""


@query("languages_search", "tagged name_tags", _SEARCH + " ORDER BY total_count DESC, language_key")
def _(t):
    found = rounded_box(lang.search_languages(language_layers(t)))
    return found.orderBy(C("total_count").desc(), "language_key")


@query("table_function_languages", "tagged name_tags", _SEARCH)
def _(t):
    layers = language_layers(t)
    layers[0].unionByName(layers[1]).createOrReplaceTempView("terrachron_named_layers")
    pattern = text.LANGUAGE_KEY.replace("\\", "\\\\")
    t.spark.sql(
        f"""create or replace temporary function search_languages()
            returns table (alias string, language_key string, total_count bigint, xmin double, ymin double, xmax double, ymax double)
            return select lower(regexp_replace(key, '[:\\\\-]', '_')), key, count(*), min(xmin), min(ymin), max(xmax), max(ymax)
            from (select explode(map_keys(tags)) as key, xmin, ymin, xmax, ymax from terrachron_named_layers)
            where key rlike '{pattern}' group by key"""
    )
    return rounded_box(t.spark.sql("select * from search_languages()"))


@query(
    "languages_upsert",
    "tagged name_tags",
    f"""WITH old AS (SELECT 'name_' || lang AS alias, 'name:' || lang AS key_name, count(*) AS count, {_BOX} FROM name_tags GROUP BY lang HAVING count(*) >= 110),
        new AS (SELECT lower(regexp_replace(k, '[:\\-]', '_', 'g')) AS alias, min(k) AS key_name, count(*) AS count, {_BOX} FROM (SELECT 'name:' || language AS k, x, y FROM tagged WHERE language <> 'de')
           WHERE regexp_matches(k, {_LANG}) GROUP BY 1 HAVING count(*) >= 110)
        SELECT alias, COALESCE(old.key_name, new.key_name) AS key_name, COALESCE(new.count, old.count) AS count, COALESCE(new.xmin, old.xmin) AS xmin, COALESCE(new.ymin, old.ymin) AS ymin,
          COALESCE(new.xmax, old.xmax) AS xmax, COALESCE(new.ymax, old.ymax) AS ymax, CASE WHEN new.alias IS NULL THEN '2020-01-01' ELSE '2026-03-01' END AS date_added, old.alias IS NULL AS is_new
        FROM old FULL JOIN new USING (alias)""",
)
def _(t):
    events, documents = language_layers(t)
    known = lang.update_languages(None, lang.search_languages([documents]), 110, "2020-01-01 00:00:00")
    german = C("tags").isNotNull() & ~F.map_contains_key("tags", F.lit("name:de"))
    found = lang.search_languages([events.filter(german)])
    state = rounded_box(lang.update_languages(known, found, 110, "2026-03-01 00:00:00"))
    return state.withColumn("date_added", F.substring(C("date_added").cast("string"), 1, 10))


@query(
    "language_columns",
    "tagged",
    """SELECT osm_id, """
    + ", ".join(
        f"CASE WHEN language = '{k}' THEN 'l' || osm_id END AS name_{k.lower().replace('-', '_')}"
        for k in ("ar-Latn", "de", "en", "es", "es-419", "fr")
    )
    + ", CAST(NULL AS VARCHAR) AS short_name, CAST(NULL AS VARCHAR) AS official_name FROM tagged",
)
def _(t):
    layers = language_layers(t)[:1]
    table = lang.update_languages(None, lang.search_languages(layers), 100, "2026-01-01 00:00:00")
    return t.tagged().select("osm_id", *text.language_columns(lang.language_keys(table), C("tags")))


# ---- tag statistics ----


@query("tag_key_stats", "tag_rows", "SELECT k AS key, count(*) AS count FROM tag_rows GROUP BY k HAVING count(*) >= 10")
def _(t):
    return lang.tag_key_stats(t.tagged())


@query(
    "tag_pair_stats",
    "tag_rows",
    """SELECT a.k AS key, b.k AS other_key, count(*) AS count FROM tag_rows a JOIN tag_rows b ON a.osm_id = b.osm_id AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def _(t):
    return lang.tag_pair_stats(t.tagged())


@query(
    "relation_type_stats",
    "tagged",
    "SELECT main_value AS relation_type, count(*) AS count FROM tagged WHERE type = 'relation' AND main_key = 'type' GROUP BY 1 HAVING count(*) >= 10",
)
def _(t):
    return lang.relation_type_stats(t.tagged())


# ---- why an element is or is not imported ----


@query(
    "skip_reason",
    "tag_rows",
    f"""WITH {rules_sql()}, {_PAIRS},
     hit AS (SELECT t.osm_id, r.ord, CASE
        WHEN NOT list_contains(types, t.type) THEN layer || ' requires ' || geometry || ' geometry (not compatible with ' || t.type || ')'
        WHEN key <> 'type' AND list_has_any(coast, have) THEN layer || ': rejected because ' || list_filter(coast, lambda x: list_contains(have, x))[1]
        WHEN key <> 'type' AND NOT list_contains(accepted, '__any__') AND NOT list_contains(accepted, t.v) THEN layer || ': ' || key || '=' || t.v || ' is not an accepted value'
        WHEN list_contains(excluded, t.v) THEN layer || ': ' || key || '=' || t.v || ' is excluded' ELSE '' END AS reason
       FROM tag_rows t JOIN rules r ON r.key = t.k AND (key <> 'type' OR list_contains(accepted, t.v)) JOIN prs ON prs.osm_id = t.osm_id),
     agg AS (SELECT osm_id, string_agg(reason, '; ' ORDER BY ord) AS reasons, bool_or(reason = '') AS taken FROM hit GROUP BY osm_id),
     c AS (SELECT t.*, reasons, taken, type = 'way' AND node_count > 0 AND CASE WHEN t.osm_id % 7 = 0 THEN node_count < 4 ELSE node_count < 2 END AS broken FROM tagged t LEFT JOIN agg ON agg.osm_id = t.osm_id)
     SELECT osm_id, CASE WHEN type = 'relation' AND member_count = 0 THEN 'Relation has no members'
       WHEN type = 'relation' AND main_key = 'type' AND main_value NOT IN ({', '.join(f"'{r}'" for r in src.RELATION_TYPES)}) THEN 'Relation type ''' || main_value || ''' is not imported'
       WHEN broken AND osm_id % 7 = 0 THEN 'Way has area=yes but only ' || node_count || ' nodes' WHEN broken THEN 'Way has only ' || node_count || ' node(s)'
       WHEN reasons IS NULL THEN 'No tags match the import rules' WHEN NOT taken THEN 'Rejected by all layers: ' || reasons END AS skip_reason,
       CASE WHEN type = 'relation' AND member_count = 0 THEN FALSE
       WHEN type = 'relation' AND main_key = 'type' AND main_value NOT IN ({', '.join(f"'{r}'" for r in src.RELATION_TYPES)}) THEN FALSE
       WHEN broken THEN TRUE WHEN reasons IS NULL THEN FALSE WHEN NOT taken THEN TRUE ELSE FALSE END AS commentable FROM c""",
)
def _(t):
    return mapping.skip_reasons(t.tagged()).select("osm_id", "skip_reason", "commentable")


@query(
    "candidate_tables",
    "tag_rows",
    f"""WITH {rules_sql()}, fit AS (SELECT t.osm_id, t.type, t.k, t.v, r.layer, ends_with(r.layer, '_points') AS is_point FROM tag_rows t JOIN rules r ON r.key = t.k
          AND (key <> 'type' OR list_contains(accepted, t.v)) WHERE NOT (t.k = 'natural' AND t.v = 'coastline')),
        ok AS (SELECT osm_id, k FROM fit WHERE (type = 'node') = is_point GROUP BY osm_id, k)
        SELECT e.osm_id, COALESCE(string_agg(DISTINCT layer, ',' ORDER BY layer), '') AS layers FROM tagged e LEFT JOIN (SELECT fit.* FROM fit JOIN ok USING (osm_id, k)) f ON f.osm_id = e.osm_id GROUP BY e.osm_id""",
)
def _(t):
    return mapping.candidate_layers(t.tagged()).select("osm_id", F.array_join("layers", ",").alias("layers"))
