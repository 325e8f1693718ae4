"""Scalar functions (X) and callable SQL functions (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrachron.functions import dates, routes, sql as sql_functions, text
from terrachron.registry.base import (
    query,
    sql_complete,
    sql_decimal,
    sql_iso,
    sql_leap,
    sql_pad,
    sql_priority,
)

C = F.col


@query("nullif_empty", "features", "SELECT id, NULLIF(name, '') AS name FROM features")
def _(t):
    return t.features().select("id", text.empty_to_null(C("name")).alias("name"))


@query(
    "coalesce_chain",
    "features",
    """SELECT id, COALESCE(NULLIF(name, ''), NULLIF(end_date, ''), NULLIF(start_date, ''), NULLIF(type, '')) AS label
       FROM features""",
)
def _(t):
    chain = text.first_present(C("name"), C("end_date"), C("start_date"), C("type"))
    return t.features().select("id", chain.alias("label"))


@query(
    "attribute_override",
    "",
    """SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(NULLIF(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END, ''), p_brand) AS name
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(t):
    relation = F.when(C("l_linenumber") % 2 == 0, "").otherwise(C("l_returnflag"))
    joined = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", text.override(relation, C("p_brand")).alias("name")
    )


@query(
    "case_mapping",
    "tagged",
    """SELECT osm_id, CASE WHEN main_value = 'construction' THEN COALESCE(CASE WHEN osm_id % 4 = 0 THEN 'primary' END || '_construction', 'road_construction')
         ELSE main_key END AS kind FROM tagged""",
)
def _(t):
    rows = t.tagged()
    main = F.map_values("tags")[0]
    kind = text.construction_type(main, C("tags"), F.map_keys("tags")[0])
    return rows.select("osm_id", kind.alias("kind"))


@query(
    "concat_ids",
    "members",
    "SELECT osm_id, COALESCE(CAST(osm_id AS VARCHAR), '') || '_' || COALESCE(CAST(CASE WHEN osm_id % 11 <> 0 THEN member END AS VARCHAR), '') AS key FROM members",
)
def _(t):
    member = F.when(C("osm_id") % 11 != 0, C("member"))
    return t.members().select("osm_id", text.joined_id(C("osm_id"), member).alias("key"))


@query("abs_id", "features", "SELECT id, abs(osm_id) AS abs_id, -osm_id AS negated FROM features")
def _(t):
    return t.features().select("id", F.abs("osm_id").alias("abs_id"), (-C("osm_id")).alias("negated"))


@query(
    "least_skip_null",
    "features",
    "SELECT id, least(NULLIF(end_date, ''), start_date) AS first_date FROM features",
)
def _(t):
    first = F.least(text.empty_to_null(C("end_date")), C("start_date"))
    return t.features().select("id", first.alias("first_date"))


@query(
    "safe_numeric",
    "features",
    "SELECT id, CASE WHEN end_date IS NULL THEN NULL ELSE COALESCE(TRY_CAST(CASE WHEN id % 2 = 0 THEN CAST(area AS VARCHAR) ELSE end_date END AS DOUBLE), -1) END AS number FROM features",
)
def _(t):
    raw = F.when(C("end_date").isNotNull(), F.when(C("id") % 2 == 0, C("area").cast("string")).otherwise(C("end_date")))
    return t.features().select("id", text.as_numeric(raw).alias("number"))


@query(
    "strip_to_number",
    "features",
    "SELECT id, TRY_CAST(NULLIF(regexp_replace(CASE WHEN id % 3 = 0 THEN 'ca. ' || id || '.5 m' ELSE name || '-x' END, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS height FROM features",
)
def _(t):
    raw = F.when(C("id") % 3 == 0, F.concat(F.lit("ca. "), C("id").cast("string"), F.lit(".5 m"))).otherwise(
        F.concat("name", F.lit("-x"))
    )
    return t.features().select("id", text.digits_and_dot(raw).alias("height"))


@query(
    "regex_match",
    "members",
    "SELECT osm_id, network, regexp_matches(network, '^US:[A-Z]{2}$') AS is_state, regexp_matches(network, '^US:[A-Z]{2}:.+') AS is_below FROM members",
)
def _(t):
    n = C("network")
    return t.members().select(
        "osm_id", "network", n.rlike(r"^US:[A-Z]{2}$").alias("is_state"), n.rlike(r"^US:[A-Z]{2}:.+").alias("is_below")
    )


@query(
    "language_key_match",
    "tag_rows",
    """SELECT osm_id, k, regexp_matches(k, '^name:[a-z]{2,3}(-[A-Z][a-z]{3})?((-[a-z]{2,}|x-[a-z]{2,})(-[a-z]{2,})?)?(-([A-Z]{2}|\\d{3}))?$') AS matched,
       regexp_matches(k, '^name:[a-z]{2,3}(-[A-Z][a-z]{3})?((-[a-z]{2,}|x-[a-z]{2,})(-[a-z]{2,})?)?(-([A-Z]{2}|\\\\d{3}))?$') AS strict_match
       FROM tag_rows WHERE k LIKE 'name%'""",
)
def _(t):
    keys = t.tagged().select("osm_id", F.explode(F.map_keys("tags")).alias("k"))
    return keys.filter(C("k").startswith("name")).select(
        "osm_id",
        "k",
        text.language_key(C("k")).alias("matched"),
        text.language_key(C("k"), strict_reference=True).alias("strict_match"),
    )


@query(
    "key_alias",
    "tag_rows",
    "SELECT k, lower(regexp_replace(k, '[:\\-]', '_', 'g')) AS alias, regexp_replace(lower(k), '[^a-z0-9]', '_', 'g') AS column_name, count(*) AS n FROM tag_rows GROUP BY ALL",
)
def _(t):
    keys = t.tagged().select(F.explode(F.map_keys("tags")).alias("k"))
    column = F.regexp_replace(F.lower("k"), "[^a-z0-9]", "_")
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(
        "k", text.key_alias(C("k")).alias("alias"), column.alias("column_name"), "n"
    )


@query(
    "count_char",
    "members",
    "SELECT osm_id, CAST(length(network) - length(replace(network, ':', '')) AS INTEGER) AS colons FROM members",
)
def _(t):
    return t.members().select("osm_id", text.count_char(C("network"), ":").alias("colons"))


@query(
    "digits_to_int",
    "members",
    "SELECT osm_id, COALESCE(TRY_CAST(regexp_replace(ref, '\\D', '', 'g') AS INTEGER), 999999) AS ref_number FROM members",
)
def _(t):
    return t.members().select("osm_id", text.digits_to_int(C("ref")).alias("ref_number"))


@query("like_suffix", "members", "SELECT osm_id, network LIKE '%:national' AS is_national FROM members")
def _(t):
    return t.members().select("osm_id", C("network").like("%:national").alias("is_national"))


@query("trim_upper", "members", "SELECT osm_id, trim(upper(COALESCE(ref, ''))) AS ref, trim(upper(COALESCE(' ' || type || ' ', ''))) AS type FROM members")
def _(t):
    padded = F.concat(F.lit(" "), C("type"), F.lit(" "))
    return t.members().select(
        "osm_id", text.trimmed_upper(C("ref")).alias("ref"), text.trimmed_upper(padded).alias("type")
    )


@query("md5_hash", "", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("digest"))


@query(
    "lpad_split_path",
    "",
    """SELECT o_orderkey, substr(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 1, 3) || '/' || substr(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 4, 3)
       || '/' || substr(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 7, 3) || '.osc.gz' AS path FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", text.sequence_path(C("o_orderkey")).alias("path"))


@query(
    "round_decimal",
    "features",
    """SELECT id, CAST(round(CAST(area AS DECIMAL(30,10)), 1) AS DECIMAL(20,1)) AS area_m2,
       CAST(round_even(area / 2, 0) AS BIGINT) AS whole FROM features""",
)
def _(t):
    return t.features().select(
        "id", text.rounded_decimal(C("area")).alias("area_m2"), text.half_even_long(C("area") / 2).alias("whole")
    )


@query(
    "human_duration",
    "",
    """WITH s AS (SELECT o_orderkey, CAST(o_totalprice * (o_orderkey % 5) / 3 AS BIGINT) AS seconds FROM orders)
       SELECT o_orderkey, CASE WHEN seconds < 60 THEN seconds || 's ago' WHEN seconds < 3600 THEN (seconds // 60) || 'm ago'
         WHEN seconds < 86400 THEN (seconds // 3600) || 'h' || CASE WHEN seconds // 60 % 60 > 0 THEN ' ' || (seconds // 60 % 60) || 'm' ELSE '' END || ' ago'
         ELSE (seconds // 86400) || 'd' || CASE WHEN seconds // 3600 % 24 > 0 THEN ' ' || (seconds // 3600 % 24) || 'h' ELSE '' END || ' ago' END AS age FROM s""",
)
def _(t):
    seconds = F.round(C("o_totalprice") * (C("o_orderkey") % 5) / 3).cast("long")
    return t.orders.select("o_orderkey", text.human_duration(seconds).alias("age"))


@query(
    "map_get",
    "tagged",
    "SELECT osm_id, 'n' || osm_id AS name, CASE WHEN osm_id % 7 = 0 THEN 'yes' END AS area, CAST(NULL AS VARCHAR) AS capital FROM tagged",
)
def _(t):
    tags = C("tags")
    return t.tagged().select("osm_id", *[text.tag(tags, k).alias(k) for k in ("name", "area", "capital")])


@query(
    "map_merge",
    "tagged",
    """SELECT osm_id, main_key, main_value AS main, 'n' || osm_id AS name, 'left' AS only_left,
       CAST(5 + CASE WHEN osm_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN osm_id % 4 = 0 THEN 1 ELSE 0 END + 1 AS INTEGER) AS size FROM tagged""",
)
def _(t):
    left = F.create_map(F.lit("name"), F.lit("x"), F.lit("only_left"), F.lit("left"))
    merged = text.merge_tags(left, C("tags"))
    main = F.map_keys("tags")[0]
    return t.tagged().select(
        "osm_id",
        main.alias("main_key"),
        F.try_element_at(merged, main).alias("main"),
        text.tag(merged, "name").alias("name"),
        text.tag(merged, "only_left").alias("only_left"),
        F.size(merged).alias("size"),
    )


@query("map_to_entries", "tag_rows", "SELECT osm_id, k AS key, v AS value FROM tag_rows")
def _(t):
    entries = t.tagged().select("osm_id", F.explode(F.map_entries("tags")).alias("e"))
    return entries.select("osm_id", "e.key", "e.value")


@query(
    "json_build",
    "route_rows",
    """SELECT osm_id, '{"osm_id":' || osm_id || CASE WHEN ref IS NULL THEN '' ELSE ',"ref":"' || ref || '"' END || ',"network":"' || network || '"}' AS route FROM route_rows""",
)
def _(t):
    return t.route_rows().select("osm_id", F.to_json(F.struct("osm_id", "ref", "network")).alias("route"))


@query(
    "json_extract",
    "",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events",
)
def _(t):
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
    )


@query(
    "array_index_any",
    "members",
    """SELECT osm_id, list_contains([ref, network, type], 'R7') OR FALSE AS has_r7, ([ref, network, type])[1] AS first_item, item
       FROM (SELECT *, unnest([ref, network, type]) AS item FROM members)""",
)
def _(t):
    items = F.array("ref", "network", "type")
    return t.members().select(
        "osm_id",
        F.coalesce(F.array_contains(items, F.lit("R7")), F.lit(False)).alias("has_r7"),
        F.get(items, 0).alias("first_item"),
        F.explode(items).alias("item"),
    )


_CHECKED = "CASE WHEN id % 4 = 0 THEN end_date WHEN id % 9 = 0 THEN '1999-02-' || lpad(CAST(id % 31 AS VARCHAR), 2, '0') ELSE start_date END"
_V = sql_complete("d", "start")


@query(
    "is_date_valid",
    "features",
    f"""WITH c AS (SELECT id, {_CHECKED} AS d FROM features)
        SELECT id, d, COALESCE(regexp_matches(d, '^\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?$') AND {_V['valid']} AND NOT starts_with(d, '0000'), FALSE) AS valid FROM c""",
)
def _(t):
    february = F.concat(F.lit("1999-02-"), F.lpad((C("id") % 31).cast("string"), 2, "0"))
    checked = F.when(C("id") % 4 == 0, C("end_date")).when(C("id") % 9 == 0, february).otherwise(C("start_date"))
    rows = t.features().select("id", checked.alias("d"))
    return rows.select("id", "d", dates.valid_date(C("d")).alias("valid"))


@query(
    "leap_year",
    "",
    f"SELECT event_id, event_id % 4100 - 2000 AS year, {sql_leap('event_id % 4100 - 2000')} AS leap FROM events",
)
def _(t):
    year = C("event_id") % 4100 - 2000
    return t.events.select("event_id", year.alias("year"), dates.is_leap(year).alias("leap"))


@query(
    "decimal_to_iso",
    "features",
    f"""WITH d AS (SELECT id, (id % 4100 - 2000) + (id % 997) / CAST(997 AS DOUBLE) AS value FROM features)
        SELECT id, value, {sql_iso('value')} AS iso FROM d""",
)
def _(t):
    value = (C("id") % 4100 - 2000) + (C("id") % 997) / F.lit(997.0)
    rows = t.features().select("id", value.alias("value"))
    return rows.withColumn("iso", dates.decimal_to_iso(C("value")))


@query(
    "pad_date",
    "features",
    f"SELECT id, {sql_pad('start_date', 'start')} AS first_day, {sql_pad('start_date', 'end')} AS last_day FROM features",
)
def _(t):
    return t.features().select(
        "id",
        dates.pad_date(C("start_date"), "start").alias("first_day"),
        dates.pad_date(C("start_date"), "end").alias("last_day"),
    )


@query(
    "iso_to_decimal",
    "features",
    f"""SELECT id, round({sql_decimal('start_date', 'start')}, 6) AS start_decdate, round({sql_decimal('end_date', 'end')}, 6) AS end_decdate,
        CASE WHEN length(start_date) > 8 THEN round({sql_decimal('start_date', 'start')}, 6) END AS full_only FROM features""",
)
def _(t):
    padded = dates.iso_to_decimal(dates.pad_date(C("start_date"), "start"))
    return t.features().select(
        "id",
        F.round(padded, 6).alias("start_decdate"),
        F.round(dates.to_decimal(C("end_date"), "end"), 6).alias("end_decdate"),
        F.round(dates.iso_to_decimal(C("start_date")), 6).alias("full_only"),
    )


@query(
    "route_priority",
    "route_rows",
    f"SELECT osm_id, type, network, ref, {sql_priority('type', 'network', 'ref')} AS prio FROM route_rows",
)
def _(t):
    prio = routes.route_priority(C("type"), C("network"), C("ref"))
    return t.route_rows().select("osm_id", "type", "network", "ref", prio.alias("prio"))


@query(
    "register_sql_functions",
    "features members",
    f"""WITH r AS (SELECT osm_id, {sql_priority('type', 'network', 'ref')} AS prio FROM members),
        f AS (SELECT id, start_date, name, round({sql_decimal('start_date', 'start')}, 6) AS start_decdate, {sql_decimal('start_date', 'start')} AS exact, {sql_pad('start_date', 'end')} AS last_day FROM features)
        SELECT id, start_decdate, last_day, {sql_iso('exact')} AS iso,
          CASE WHEN name = '' THEN -1 ELSE -1 END + CAST(0 AS DOUBLE) AS number,
          COALESCE(regexp_matches(start_date, '^\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?$') AND NOT starts_with(start_date, '0000'), FALSE) AS valid, prio
        FROM f LEFT JOIN r ON id = osm_id""",
)
def _(t):
    sql_functions.register(t.spark)
    start = "isodatetodecimaldate(pad_date(start_date, 'start'))"
    rows = t.features().join(t.members().withColumnRenamed("type", "kind").select(
        C("osm_id").alias("rel"), "kind", "network", "ref"), C("id") == C("rel"), "left")
    return rows.selectExpr(
        "id",
        f"round({start}, 6) AS start_decdate",
        "pad_date(start_date, 'end') AS last_day",
        f"convert_decimal_to_iso_date({start}) AS iso",
        "as_numeric(name) AS number",
        "is_date_valid(start_date) AS valid",
        "CASE WHEN rel IS NOT NULL THEN route_priority(kind, network, ref) END AS prio",
    )


@query(
    "column_generators",
    "tagged",
    """SELECT osm_id, CASE WHEN language = 'en' THEN 'l' || osm_id END AS name_en, CASE WHEN language = 'ar-Latn' THEN 'l' || osm_id END AS name_ar_latn,
       CAST(NULL AS VARCHAR) AS short_name, CAST(NULL AS VARCHAR) AS official_name, CAST(36 AS INTEGER) AS slot_columns FROM tagged""",
)
def _(t):
    names = text.language_columns(["name:en", "name:ar-Latn"], C("tags"))
    return t.tagged().select("osm_id", *names, F.lit(len(routes.slot_columns("road"))).alias("slot_columns"))
