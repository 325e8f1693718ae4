"""Registry of queries with their checking SQL, and feature-shaped adapters.

The adapters turn the given tables into map features by pure column
expressions; the same rules stand in ``CTE`` as SQL. They read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrachron.functions import dates, geometry as geo
from terrachron.operators.skew import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given Parquet tables and the adapters over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def features(self) -> DataFrame:
        """Dated point features from events."""
        e, n = self.events, F.col("event_id")
        year = (n % 4100 - 2000).cast("int")
        month, day = two((n % 12) + 1), two((n % 28) + 1)
        kind = n % 3
        start = (
            F.when(kind == 0, dates.year_text(year))
            .when(kind == 1, F.concat_ws("-", dates.year_text(year), month))
            .otherwise(F.concat_ws("-", dates.year_text(year), month, day))
        )
        end = F.when(n % 5 != 0, F.concat_ws("-", dates.year_text(year + (n % 60).cast("int")), month, day))
        lon = (n * 37 % 36000) / 100.0 - 180.0
        lat = (n * 53 % 17000) / 100.0 - 85.0
        x, y = geo.to_metres(lon, lat)
        return e.select(
            n.alias("id"),
            F.when(n % 10 == 0, -n).otherwise(n).alias("osm_id"),
            F.lit("event").alias("class"),
            F.col("event_type").alias("type"),
            F.when(kind == 0, "").otherwise(F.concat(F.lit("n"), n.cast("string"))).alias("name"),
            start.alias("start_date"),
            end.alias("end_date"),
            F.col("value").alias("area"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            lon.alias("lon"),
            lat.alias("lat"),
            x.alias("x"),
            y.alias("y"),
            F.col("user_id").alias("changeset"),
            "ts",
        )

    def tagged(self) -> DataFrame:
        """Raw tagged elements from events."""
        f, n = self.features(), F.col("id")
        key = F.get(F.array(*[F.lit(k) for k in KEYS]), (n % 12).cast("int"))
        at = (n % 12).cast("int") * 6 + (F.floor(n / 12) % 6).cast("int")
        value = F.get(F.array(*[F.lit(v) for vs in VALUES for v in vs]), at)
        language = F.get(F.array(*[F.lit(v) for v in LANGUAGES]), (n % len(LANGUAGES)).cast("int"))
        pairs = F.array(
            _pair(key, value),
            _pair("name", F.concat(F.lit("n"), n.cast("string"))),
            _pair(F.concat(F.lit("name:"), language), F.concat(F.lit("l"), n.cast("string"))),
            _pair("source", "survey"),
            _pair("source:date", F.col("start_date")),
            _pair("area", F.when(n % 7 == 0, "yes")),
            _pair("construction", F.when(n % 4 == 0, "primary")),
        )
        tags = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
        kinds = F.array(F.lit("node"), F.lit("way"), F.lit("relation"))
        return f.select(
            F.get(kinds, (F.floor(n / 72) % 3).cast("int")).alias("type"),
            n.alias("osm_id"),
            (n % 5 + 1).cast("int").alias("version"),
            "changeset",
            tags.alias("tags"),
            (n % 6).cast("int").alias("node_count"),
            (n % 4).cast("int").alias("member_count"),
            "ts",
            "x",
            "y",
        )

    def members(self) -> DataFrame:
        """Dated relation members from orders: the member is the customer."""
        o, n = self.orders, F.col("o_orderkey")
        date = F.col("o_orderdate").cast("date")
        start = F.when(n % 17 != 0, date.cast("string"))
        end = F.when(n % 13 != 0, F.date_add(date, (n % 400).cast("int")).cast("string"))
        rows = o.select(
            n.alias("osm_id"),
            F.col("o_custkey").alias("member"),
            F.col("o_orderstatus").alias("status"),
            _pick(ROUTE_KINDS, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("type"),
            F.when(n % 11 != 0, F.concat(F.lit("R"), (n % 40).cast("string"))).alias("ref"),
            _pick(NETWORKS, (n % 6).cast("int")).alias("network"),
            start.alias("start_date"),
            end.alias("end_date"),
            F.col("o_totalprice").alias("price"),
        )
        return rows.withColumns(
            {
                "start_decdate": dates.to_decimal(F.col("start_date"), "start"),
                "end_decdate": dates.to_decimal(F.col("end_date"), "end"),
            }
        )

    def route_rows(self) -> DataFrame:
        """Members as routes on ways; the price takes the place of the geometry."""
        m, n = self.members(), F.col("osm_id")
        return m.select(
            F.col("member").alias("way_id"),
            "osm_id",
            "ref",
            "type",
            F.col("type").alias("route"),
            "network",
            F.when(n % 2 == 0, F.concat(F.lit("Q"), n.cast("string"))).alias("network_wikidata"),
            F.concat(F.lit("N"), (n % 9).cast("string")).alias("name"),
            F.when(n % 3 == 0, F.lit("op")).alias("operator"),
            _pick(["north", "south", None], (n % 3).cast("int")).alias("direction"),
            F.create_map(F.lit("k"), F.col("status")).alias("tags"),
            geo.point(F.col("price"), n).alias("geometry"),
            "start_decdate",
            "end_decdate",
            F.col("status").alias("highway"),
        )

    def elements(self) -> DataFrame:
        """Versioned changes from lineitem."""
        action = F.create_map(*[F.lit(v) for pair in ACTIONS.items() for v in pair])
        return self.lineitem.select(
            F.lit("way").alias("type"),
            F.col("l_orderkey").alias("osm_id"),
            F.col("l_linenumber").alias("version"),
            F.col("l_suppkey").alias("changeset"),
            F.try_element_at(action, F.col("l_returnflag")).alias("action"),
            F.col("l_shipdate").alias("timestamp"),
            F.col("l_partkey").alias("part"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("quantity"),
        )

    def rects(self) -> DataFrame:
        """Rectangles from customers."""
        shape = geo.rectangle(
            F.col("c_custkey") * 10.0,
            F.col("c_nationkey") * 10.0,
            F.abs("c_acctbal") / 100 + 1,
            F.lit(5.0),
        )
        return self.customer.select(
            F.col("c_custkey").alias("id"),
            (F.col("c_custkey") * 1).alias("osm_id"),
            F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("name"),
            F.col("c_mktsegment").alias("type"),
            F.lit("area").alias("class"),
            F.concat((F.col("c_custkey") % 2000).cast("string"), F.lit("")).alias("start_date"),
            F.lit("").alias("end_date"),
            geo.area(shape).alias("area"),
            F.create_map(F.lit("name:en"), F.col("c_name"), F.lit("capital"), F.col("c_nationkey").cast("string")).alias("tags"),
            shape.alias("geometry"),
        )

    def polylines(self) -> DataFrame:
        """One line per lineitem row, with two vertices more than its line number."""
        steps = F.sequence(F.lit(0), F.col("l_linenumber") + 1)
        vertices = F.transform(
            steps,
            lambda i: geo.vertex(
                F.col("l_extendedprice") + i * F.col("l_quantity"),
                F.col("l_partkey") + (i * i) % 7 * F.col("l_quantity"),
            ),
        )
        shape = geo.line(vertices)
        return self.lineitem.select(
            F.col("l_orderkey").alias("id"),
            F.col("l_partkey").alias("osm_id"),
            F.col("l_linestatus").alias("class"),
            F.col("l_returnflag").alias("type"),
            F.col("l_suppkey").alias("supplier"),
            geo.length(shape).alias("length"),
            shape.alias("geometry"),
        )

    def name_tags(self) -> DataFrame:
        """Documents as features named in the language of the text."""
        n = F.col("doc_id")
        x, y = geo.to_metres((n * 37 % 36000) / 100.0 - 180.0, (n * 53 % 17000) / 100.0 - 85.0)
        tags = F.create_map(
            F.concat(F.lit("name:"), F.col("lang")), F.col("text"), F.lit("source"), F.col("source")
        )
        return self.documents.select("doc_id", "lang", tags.alias("tags"), x.alias("x"), y.alias("y"))

    def transport(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ways from parts, street relations from line items, route members from suppliers."""
        none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
        empty = ["access", "service", "ford", "electrified", "highspeed", "usage", "railway", "aeroway", "route"]

        def shape(df, **columns):
            base = {c: none_text for c in empty}
            base.update({c: none_int for c in ("tunnel", "bridge", "oneway", "expressway", "z_order")})
            base.update(columns)
            return df.select(*[v.alias(k) for k, v in base.items()])

        ways = shape(
            self.part,
            id=F.lit(1).cast("long"),
            osm_id=F.col("p_partkey"),
            geometry=geo.line(F.array(geo.vertex(F.col("p_retailprice"), F.col("p_size")), geo.vertex(F.col("p_size"), F.col("p_retailprice")))),
            name=F.col("p_brand"),
            highway=F.when(F.col("p_size") % 9 == 0, "construction").otherwise(F.lower("p_type")),
            ref=F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""),
            type=F.lower("p_type"),
            **{"class": F.lit("highway")},
            tunnel=F.lit(0),
            bridge=(F.col("p_size") % 2).cast("int"),
            z_order=F.col("p_size").cast("int"),
            start_date=F.lit("1915"),
            end_date=F.when(F.col("p_partkey") % 4 == 0, "1996-06").otherwise(""),
            tags=F.create_map(F.lit("name"), F.col("p_brand"), F.lit("construction"), F.lower("p_type")),
        )
        rows = self.lineitem.count()
        joined = dealt(self.lineitem, ["l_orderkey"], rows).join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        joined = dealt(joined, ["l_partkey"], rows).join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        odd = F.col("l_orderkey") % 2 == 1
        streets = shape(
            joined,
            id=F.lit(2).cast("long"),
            osm_id=-F.col("l_orderkey"),
            member=F.col("l_partkey"),
            geometry=geo.line(F.array(geo.vertex(F.lit(0), F.lit(0)), geo.vertex(F.lit(1), F.lit(1)))),
            name=F.when(odd, F.concat(F.lit("S"), F.col("l_orderkey").cast("string"))).otherwise(F.col("p_brand")),
            highway=F.lit(""),
            ref=none_text,
            start_date=F.col("o_orderdate").cast("date").cast("string"),
            end_date=F.lit(""),
            tags=F.create_map(F.lit("name"), F.lit("relation")),
        )
        relations = shape(
            self.supplier,
            id=F.lit(3).cast("long"),
            osm_id=-F.col("s_suppkey"),
            member=F.col("s_suppkey") * 7,
            geometry=geo.line(F.array(geo.vertex(F.lit(0), F.lit(0)), geo.vertex(F.lit(2), F.lit(2)))),
            name=F.col("s_name"),
            highway=F.lit("primary"),
            ref=F.lit(""),
            type=F.lit("primary"),
            **{"class": F.lit("highway")},
            start_date=F.lit("1900"),
            end_date=F.lit(""),
            tags=F.create_map(F.lit("name"), F.col("s_name")),
        )
        return ways, streets, relations


def two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def _pair(key, value) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    value = F.lit(value) if isinstance(value, str) else value
    return F.struct(key.alias("key"), value.alias("value"))


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


KEYS = ["highway", "building", "natural", "waterway", "boundary", "landuse", "place", "amenity", "shop", "route", "type", "foo"]
VALUES = [
    ["primary", "residential", "construction", "motorway", "service", "track"],
    ["yes", "house", "church", "barn", "shed", "mill"],
    ["water", "coastline", "cliff", "wood", "tree_row", "peak"],
    ["river", "stream", "canal", "dam", "ditch", "riverbank"],
    ["administrative", "political", "religious", "census", "postal_code", "maritime"],
    ["basin", "reservoir", "forest", "farm", "grass", "meadow"],
    ["island", "city", "town", "village", "plot", "square"],
    ["cafe", "school", "bank", "pub", "place_of_worship", "theatre"],
    ["books", "bakery", "yes", "car", "tea", "toys"],
    ["road", "train", "bus", "tram", "ferry", "subway"],
    ["street", "site", "route", "multipolygon", "waterway", "boundary"],
    ["bar"] * 6,
]
LANGUAGES = ["en", "fr", "de", "es", "ar-Latn", "es-419", "EN"]
ROUTE_KINDS = ["road", "train", "tram", "bus", "other"]
NETWORKS = ["US:I", "US:US", "US:CA", "US:CA:XX", "x:national", ""]
ACTIONS = {"A": "create", "N": "modify", "R": "delete"}


# ---- the same rules as SQL ----

def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def sql_year(year: str) -> str:
    return (
        f"(CASE WHEN {year} < 1 THEN '-' || lpad(CAST(1 - ({year}) AS VARCHAR), 4, '0') "
        f"ELSE lpad(CAST({year} AS VARCHAR), 4, '0') END)"
    )


def sql_leap(year: str) -> str:
    return f"((({year}) % 4 = 0 AND ({year}) % 100 <> 0) OR ({year}) % 400 = 0)"


def _sql_part(text: str, group: int) -> str:
    return f"regexp_extract({text}, '^(-?)(\\d{{1,4}})(?:-(\\d{{1,2}}))?(?:-(\\d{{1,2}}))?$', {group})"


def sql_complete(text: str, which: str) -> dict[str, str]:
    """Year, month and day of a completed partial date, and their validity."""
    y = _sql_part(text, 2)
    year = f"(CASE WHEN {y} = '' THEN NULL WHEN {_sql_part(text, 1)} = '-' THEN 1 - TRY_CAST({y} AS INTEGER) ELSE TRY_CAST({y} AS INTEGER) END)"
    month = f"COALESCE(TRY_CAST(NULLIF({_sql_part(text, 3)}, '') AS INTEGER), {1 if which == 'start' else 12})"
    last = (
        f"([31,28,31,30,31,30,31,31,30,31,30,31][{month}] + "
        f"CASE WHEN {month} = 2 AND {sql_leap(year)} THEN 1 ELSE 0 END)"
    )
    day = f"COALESCE(TRY_CAST(NULLIF({_sql_part(text, 4)}, '') AS INTEGER), {1 if which == 'start' else last})"
    valid = f"({year} IS NOT NULL AND {month} BETWEEN 1 AND 12 AND {day} >= 1 AND {day} <= {last})"
    return {"year": year, "month": month, "day": day, "valid": valid}


def sql_pad(text: str, which: str) -> str:
    p = sql_complete(text, which)
    return (
        f"(CASE WHEN {p['valid']} THEN {_sql_part(text, 1)} || lpad({_sql_part(text, 2)}, 4, '0') || '-' || "
        f"lpad(CAST({p['month']} AS VARCHAR), 2, '0') || '-' || lpad(CAST({p['day']} AS VARCHAR), 2, '0') END)"
    )


def sql_decimal(text: str, which: str) -> str:
    p = sql_complete(text, which)
    return (
        f"(CASE WHEN {p['valid']} THEN {p['year']} + ([0,31,59,90,120,151,181,212,243,273,304,334][{p['month']}] "
        f"+ {p['day']} + CASE WHEN {p['month']} > 2 AND {sql_leap(p['year'])} THEN 1 ELSE 0 END - CAST(0.5 AS DOUBLE)) "
        f"/ CASE WHEN {sql_leap(p['year'])} THEN 366 ELSE 365 END END)"
    )


def sql_iso(value: str) -> str:
    y = f"CAST(floor({value}) AS INTEGER)"
    days = f"(CASE WHEN {sql_leap(y)} THEN 366 ELSE 365 END)"
    ordinal = f"CAST(greatest(ceil(({value} - floor({value})) * {days}), 1) AS INTEGER)"
    return (
        f"(CASE WHEN {value} BETWEEN -9998 AND 9999.999999 THEN {sql_year(y)} || "
        f"substr(CAST((CASE WHEN {sql_leap(y)} THEN DATE '2000-01-01' ELSE DATE '2001-01-01' END + ({ordinal} - 1)) AS VARCHAR), 5, 6) END)"
    )


def sql_priority(kind: str, network: str, ref: str) -> str:
    return f"""CAST((CASE {kind} WHEN 'road' THEN 1000000000000 WHEN 'train' THEN 900000000000
      WHEN 'subway' THEN 850000000000 WHEN 'light_rail' THEN 800000000000 WHEN 'tram' THEN 750000000000
      WHEN 'trolleybus' THEN 700000000000 WHEN 'bus' THEN 650000000000 ELSE 100000000000 END)
      + (CASE WHEN {network} = 'US:I' THEN 1000000 WHEN {network} = 'US:US' THEN 900000
         WHEN regexp_matches({network}, '^US:[A-Z]{{2}}$') THEN 800000
         WHEN regexp_matches({network}, '^US:[A-Z]{{2}}:.+') THEN 700000
         WHEN {network} LIKE '%:national' THEN 700000 WHEN {network} LIKE '%:regional' THEN 600000 ELSE 0 END)
      + (CASE WHEN {kind} = 'road' THEN (100 - (length(COALESCE({network}, '')) - length(replace(COALESCE({network}, ''), ':', '')))) * CAST(1000000000 AS BIGINT)
            + (1000000 - COALESCE(TRY_CAST(regexp_replace({ref}, '\\D', '', 'g') AS INTEGER), 999999))
         ELSE 1000 - length(COALESCE({network}, '')) END) AS DECIMAL(20,0))"""


R = "6378137.0"
_X = f"radians(lon) * {R}"
_Y = f"ln(tan(0.7853981633974483 + radians(lat) / 2)) * {R}"
_YEAR = "(event_id % 4100 - 2000)"
_MONTH = "lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0')"
_DAY = "lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0')"

CTE = {
    "features": f"""features AS (SELECT *, {_X} AS x, {_Y} AS y FROM (SELECT event_id AS id,
        CASE WHEN event_id % 10 = 0 THEN -event_id ELSE event_id END AS osm_id,
        'event' AS class, event_type AS type,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE 'n' || event_id END AS name,
        CASE WHEN event_id % 3 = 0 THEN {sql_year(_YEAR)}
             WHEN event_id % 3 = 1 THEN {sql_year(_YEAR)} || '-' || {_MONTH}
             ELSE {sql_year(_YEAR)} || '-' || {_MONTH} || '-' || {_DAY} END AS start_date,
        CASE WHEN event_id % 5 <> 0 THEN {sql_year(f"({_YEAR} + event_id % 60)")} || '-' || {_MONTH} || '-' || {_DAY} END AS end_date,
        value AS area, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        (event_id * 37 % 36000) / CAST(100.0 AS DOUBLE) - 180.0 AS lon,
        (event_id * 53 % 17000) / CAST(100.0 AS DOUBLE) - 85.0 AS lat,
        user_id AS changeset, ts FROM events))""",
    "tagged": f"""tagged AS (SELECT (['node','way','relation'])[CAST((id // 72) % 3 + 1 AS INTEGER)] AS type, id AS osm_id,
        CAST(id % 5 + 1 AS INTEGER) AS version, changeset,
        CAST(id % 6 AS INTEGER) AS node_count, CAST(id % 4 AS INTEGER) AS member_count, ts, x, y,
        ({_list(KEYS)})[CAST(id % 12 + 1 AS INTEGER)] AS main_key,
        ({_list([v for vs in VALUES for v in vs])})[CAST((id % 12) * 6 + (id // 12) % 6 + 1 AS INTEGER)] AS main_value,
        ({_list(LANGUAGES)})[CAST(id % {len(LANGUAGES)} + 1 AS INTEGER)] AS language, start_date FROM features)""",
    "tag_rows": """tag_rows AS (
        SELECT osm_id, type, main_key AS k, main_value AS v FROM tagged
        UNION ALL SELECT osm_id, type, 'name', 'n' || osm_id FROM tagged
        UNION ALL SELECT osm_id, type, 'name:' || language, 'l' || osm_id FROM tagged
        UNION ALL SELECT osm_id, type, 'source', 'survey' FROM tagged
        UNION ALL SELECT osm_id, type, 'source:date', start_date FROM tagged
        UNION ALL SELECT osm_id, type, 'area', 'yes' FROM tagged WHERE osm_id % 7 = 0
        UNION ALL SELECT osm_id, type, 'construction', 'primary' FROM tagged WHERE osm_id % 4 = 0)""",
    "members": f"""members AS (SELECT *, {sql_decimal('start_date', 'start')} AS start_decdate,
        {sql_decimal('end_date', 'end')} AS end_decdate FROM (SELECT o_orderkey AS osm_id, o_custkey AS member,
        o_orderstatus AS status, ({_list(ROUTE_KINDS)})[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS type,
        CASE WHEN o_orderkey % 11 <> 0 THEN 'R' || (o_orderkey % 40) END AS ref,
        ({_list(NETWORKS)})[CAST(o_orderkey % 6 + 1 AS INTEGER)] AS network,
        CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS start_date,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS VARCHAR) END AS end_date,
        o_totalprice AS price FROM orders))""",
    "route_rows": """route_rows AS (SELECT member AS way_id, osm_id, ref, type, type AS route, network,
        CASE WHEN osm_id % 2 = 0 THEN 'Q' || osm_id END AS network_wikidata, 'N' || (osm_id % 9) AS name,
        CASE WHEN osm_id % 3 = 0 THEN 'op' END AS operator,
        (['north', 'south', NULL])[CAST(osm_id % 3 + 1 AS INTEGER)] AS direction,
        price AS geometry, start_decdate, end_decdate, status AS highway FROM members)""",
    "elements": """elements AS (SELECT 'way' AS type, l_orderkey AS osm_id, l_linenumber AS version, l_suppkey AS changeset,
        CASE l_returnflag WHEN 'A' THEN 'create' WHEN 'N' THEN 'modify' WHEN 'R' THEN 'delete' END AS action,
        l_shipdate AS timestamp, l_partkey AS part, l_extendedprice AS price, l_quantity AS quantity FROM lineitem)""",
    "rects": """rects AS (SELECT c_custkey AS id, c_custkey AS osm_id,
        CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END AS name, c_mktsegment AS type, 'area' AS class,
        CAST(c_custkey % 2000 AS VARCHAR) AS start_date, '' AS end_date,
        c_custkey * CAST(10.0 AS DOUBLE) AS x0, c_nationkey * CAST(10.0 AS DOUBLE) AS y0,
        abs(c_acctbal) / 100 + 1 AS w, CAST(5.0 AS DOUBLE) AS h, (abs(c_acctbal) / 100 + 1) * 5 AS area,
        c_name AS name_en_tag, CAST(c_nationkey AS VARCHAR) AS capital FROM customer)""",
    "polylines": """polylines AS (SELECT l_orderkey AS id, l_partkey AS osm_id, l_linestatus AS class, l_returnflag AS type,
        l_suppkey AS supplier, list_sum(list_transform(range(0, CAST(l_linenumber + 1 AS BIGINT)), lambda i:
          sqrt(pow(l_quantity, 2) + pow((((i + 1) * (i + 1)) % 7 - (i * i) % 7) * l_quantity, 2)))) AS length,
        l_extendedprice AS xmin, l_extendedprice + (l_linenumber + 1) * l_quantity AS xmax, l_linenumber + 2 AS vertices,
        l_partkey + list_min(list_transform(range(0, CAST(l_linenumber + 2 AS BIGINT)), lambda i: (i * i) % 7)) * l_quantity AS ymin,
        l_partkey + list_max(list_transform(range(0, CAST(l_linenumber + 2 AS BIGINT)), lambda i: (i * i) % 7)) * l_quantity AS ymax
        FROM lineitem)""",
    "name_tags": f"""name_tags AS (SELECT doc_id, lang, text, source, {_X} AS x, {_Y} AS y FROM (SELECT *,
        (doc_id * 37 % 36000) / CAST(100.0 AS DOUBLE) - 180.0 AS lon,
        (doc_id * 53 % 17000) / CAST(100.0 AS DOUBLE) - 85.0 AS lat FROM documents))""",
}
NEEDS = {
    "tagged": ["features"],
    "tag_rows": ["tagged"],
    "route_rows": ["members"],
}


def with_adapters(names: str, sql: str) -> str:
    """Prefix the CTEs of the named adapters, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    prefix = ", ".join(CTE[n] for n in ordered)
    body = sql.strip()
    if not prefix:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {prefix}, {body[5:]}"
    return f"WITH {prefix} {body}"


def query(name: str, adapters: str = "", sql: str | None = None):
    """Register a query over ``Tables`` and, where there is one, its checking SQL."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = with_adapters(adapters, sql)
        return build

    return add
