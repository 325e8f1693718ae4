import math
import random

import pytest
from pyspark.sql import functions as F, types as T

from terrachron.functions.geometry import GEOMETRY
from terrachron.operators import intervals, languages, mapping, override, relational, routes, skew
from terrachron.operators.changes import advance_retries
from terrachron.registry.base import Tables

LINE = ("linestring", [[[(0.0, 0.0), (1.0, 1.0)]]])


def ordered_reference(rows):
    """Lag, lead, running sum and row number in plain Python."""
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = 0.0
        for i, r in enumerate(members):
            total += r[3]
            before = members[i - 1][3] if i else None
            after = members[i + 1][3] if i + 1 < len(members) else None
            out.append((*r, before, after, total, i + 1))
    return sorted(map(str, out))


@pytest.mark.parametrize("limit", [10**6, 20])
def test_ordered_groups(spark, limit):
    """One key holds most rows; split groups give the same result as whole ones."""
    random.seed(1)
    rows = [(random.choice(["a", "a", "a", "b", None]), random.choice([None, *map(float, range(30))]), i, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t double, i int, v double")
    groups = skew.OrderedGroups(df, ["k"], [F.col("t").asc_nulls_first(), F.col("i")], limit=limit)
    assert (groups.split is not None) == (limit == 20)
    got = groups.lag("v", "b").lead("v", "a").running_sum("v", "s").row_number("n").frame()
    assert sorted(map(str, map(tuple, got.select("k", "t", "i", "v", "b", "a", "s", "n").collect()))) == ordered_reference(rows)


def test_number_rows_and_pages(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit("k").alias("k"))
    numbered = skew.number_rows(df, [F.col("v")])
    assert numbered.filter("id <> v + 1").count() == 0
    pages = skew.paged_lists(df, ["k"], [F.col("v")], F.col("v"), "vs", 300)
    lists = [r.vs for r in pages.orderBy("page").collect()]
    assert [len(v) for v in lists] == [300, 300, 300, 100] and sum(lists, []) == list(range(1000))


def test_gap_golden(spark):
    rows = [(1, 1900.0, 1910.0), (2, 1910.002, 1920.0), (3, 1920.01, 1930.0), (4, None, 1800.0)]
    df = spark.createDataFrame([("m", *r) for r in rows], "m string, osm_id int, start_decdate double, end_decdate double")
    merged = intervals.merge_intervals(df, ["m"], tie="osm_id").orderBy("group_id").collect()
    # The unknown start sorts first and its end lies before the next start: a gap.
    assert [(r.group_id, r.merged_row_count) for r in merged] == [(0, 1), (1, 2), (2, 1)]
    assert merged[0].min_start_decdate is None and merged[1].max_end_decdate == 1920.0


def brute_overlaps(rows):
    out = []
    for key in {r[0] for r in rows}:
        cuts = sorted({x for k, _, s, e in rows if k == key for x in (s, e) if x is not None})
        for a, b in zip(cuts, [*cuts[1:], None]):
            for k, i, s, e in rows:
                if k == key and (s is None or s < (9999 if b is None else b)) and (e is None or e > a):
                    out.append((key, a, -1 if b is None else b, i))
    return sorted(out)


@pytest.mark.parametrize("split", [False, True])
def test_overlaps_match_brute_force(spark, split):
    random.seed(2)
    dates = [None, *map(float, range(15))]
    rows = [(random.choice("aab"), i, random.choice(dates), random.choice(dates)) for i in range(60)]
    df = spark.createDataFrame(rows, "w string, i int, start_decdate double, end_decdate double")
    if split:
        spark.conf.set(skew.GROUP_ROWS_SETTING, "10")
    try:
        joined = intervals.join_overlapping(intervals.cut_segments(df, "w"), df, "w")
        got = sorted((r.w, r.seg_start, -1 if r.seg_end is None else r.seg_end, r.i) for r in joined.collect())
    finally:
        spark.conf.unset(skew.GROUP_ROWS_SETTING)
    assert got == brute_overlaps(rows)


def route(osm_id, start, end, way=1, ref="1"):
    return (way, osm_id, ref, "road", "road", "n", None, "N", None, None, {}, LINE, start, end, "primary")


ROUTE_SCHEMA = (
    "way_id long, osm_id long, ref string, type string, route string, network string, network_wikidata string, name string, "
    "operator string, direction string, tags map<string,string>, geometry " + GEOMETRY.simpleString() + ", start_decdate double, end_decdate double, highway string"
)


def test_sweep_golden(spark):
    rows = [route(1, 1900.0, 1950.0, ref="1"), route(2, 1920.0, None, ref="2"), route(3, None, 1950.0, way=2)]
    periods, active = routes.normalize_routes(spark.createDataFrame(rows, ROUTE_SCHEMA))
    got = sorted((r.way_id, r.min_start_decdate, r.max_end_decdate, r.num_routes) for r in periods.collect())
    assert [(w, s, n) for w, s, _, n in got] == [(1, 1900.0, 1), (1, 1920.0, 2), (1, 1950.0, 1)]
    assert active.count() == 4
    kept, _ = routes.normalize_routes(spark.createDataFrame(rows, ROUTE_SCHEMA), keep_open_start=True)
    assert kept.filter("way_id = 2 AND max_end_decdate = 1950").count() == 1


def test_routes_do_not_depend_on_row_order_or_splitting(spark, small_groups):
    random.seed(3)
    dates = [None, *map(float, range(1900, 1912))]
    rows = [route(i, random.choice(dates), random.choice(dates), way=i % 3 and 1, ref=str(i % 4)) for i in range(60)]
    results = []
    for limit, order in ((10, rows), (10**6, rows[::-1])):
        spark.conf.set(skew.GROUP_ROWS_SETTING, str(limit))
        periods, active = routes.normalize_routes(spark.createDataFrame(order, ROUTE_SCHEMA))
        results.append(sorted(map(str, periods.drop("geometry").collect())) + sorted(map(str, active.drop("tags").collect())))
    assert results[0] == results[1]


def street_case(spark, relation_name):
    t = Tables(spark, "/root/testdata/sf0.001")
    ways, streets, relations = t.transport()
    text = "access service ford electrified highspeed usage railway aeroway route ref".split()
    blank = {c: None for c in [*text, "tunnel", "bridge", "oneway", "expressway", "z_order"]}
    way = {**blank, "id": 1, "osm_id": 100, "geometry": LINE, "name": "Old Road" if relation_name == "Oak Street" else relation_name, "highway": "residential", "type": "residential", "class": "highway", "start_date": "1915", "end_date": "", "tags": {"name": "way"}}
    street = {**blank, "id": 2, "osm_id": -5000, "member": 100, "geometry": LINE, "name": relation_name, "highway": "", "start_date": "1984", "end_date": "", "tags": {"name": "rel"}}

    def frame(like, row):
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in like.schema])
        return spark.createDataFrame([tuple(row[c] for c in like.columns)], schema)

    return override.override_lines(frame(ways, way), frame(streets, street), relations.limit(0))


def test_overrides_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 1)
    lines = street_case(spark, "Oak Street")
    assert lines.rdd.getNumPartitions() == 2 and lines.count() == 2


def test_override_goldens(spark):
    got = {r.id: (r.name, r.start_date, r.end_date, r.relation) for r in street_case(spark, "Oak Street").collect()}
    assert got == {"1_100": ("Old Road", "1915", "1984", None), "-5000_100": ("Oak Street", "1984", None, 5000)}
    same = street_case(spark, "Same Street").collect()
    assert [(r.id, r.start_date, r.end_date) for r in same] == [("1_100", "1915", None)]


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(2,), (None,)], "b int")
    assert relational.not_in(left, "a", right, "b").count() == 0
    assert [r.a for r in relational.not_in(left, "a", right.dropna(), "b").collect()] == [1]
    assert relational.not_in(left, "a", right.limit(0), "b").count() == 3


def test_skip_reasons(spark):
    rows = [
        ("way", 1, {"area": "yes", "building": "yes"}, 3, 0, True, True),
        ("relation", 2, {"type": "site"}, 0, 3, True, False),
        ("way", 3, {"natural": "coastline"}, 9, 0, True, True),
        ("way", 4, {"highway": "primary"}, 3, 0, False, False),
        ("relation", 5, {"type": "street"}, 0, 2, False, False),
        ("way", 6, {"foo": "bar"}, 9, 0, True, False),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "type string, osm_id long, tags map<string,string>, node_count int, member_count int")
    got = {r.osm_id: (r.skip_reason is not None, r.commentable) for r in mapping.skip_reasons(df).collect()}
    assert got == {r[1]: r[5:] for r in rows}


def test_mapping_moves_no_rows(spark):
    """Rules are looked up inside the row: no shuffle and no join, and only matches are exploded."""
    df = spark.createDataFrame([("way", 1, {"highway": "primary"})], "type string, osm_id long, tags map<string,string>")
    plan = mapping.map_elements(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate inline" in plan
    rows = spark.createDataFrame([("way", 1, {"highway": "primary", "foo": "bar"}), ("way", 2, {}), ("way", 3, None)], "type string, osm_id long, tags map<string,string>")
    assert {(r.osm_id, r["class"], r.type_value, r.layer) for r in mapping.map_elements(rows).collect()} == {(1, "highway", "primary", n) for n in ("transport_areas", "transport_lines")}
    assert mapping.map_elements(rows, ["no_such_layer"]).count() == 0


def test_retry_golden(spark):
    state = spark.createDataFrame([(1, "way", 10, 2, 3, "pending"), (2, "way", 20, 2, 3, "pending"), (3, "way", 30, 0, 3, "pending")], "changeset long, type string, osm_id long, retry_count int, max_retries int, status string")
    missing = state.select("changeset", "type", "osm_id")
    settled = spark.createDataFrame([("way", 30)], "type string, osm_id long")
    shares = spark.createDataFrame([(2, 4.0)], "changeset long, missing_pct double")
    after = {r.osm_id: (r.retry_count, r.status) for r in advance_retries(state, missing, settled, shares).collect()}
    assert after == {10: (3, "failed"), 20: (3, "warning")}


def test_language_update(spark):
    found = spark.createDataFrame([("name:es", 5, 0.0, 0.0, 0.0, 0.0, "name_es"), ("name:fr", 2, 0.0, 0.0, 1.0, 1.0, "name_fr")], "language_key string, total_count long, xmin double, ymin double, xmax double, ymax double, alias string")
    first = languages.update_languages(None, found, 3, "2020-01-01 00:00:00")
    assert [(r.key_name, r.is_new) for r in first.collect()] == [("name:es", True)]
    assert math.isclose(first.first().xmax, 10.0)
    second = languages.update_languages(first, found, 1, "2021-01-01 00:00:00")
    assert {r.key_name: r.is_new for r in second.collect()} == {"name:es": False, "name:fr": True}


def test_tile_join_lists_no_tiles(spark):
    """A feature over a whole zoom meets its tiles without a row for each; results equal the listing."""
    from terrachron.operators import tiles as tile_ops

    world = 20_037_508.0
    boxes = [(1, -world + 1, -world + 1, world - 1, world - 1), (2, 10.0, 10.0, 20.0, 20.0), (3, -5e6, 1e6, 7e6, 2e6), (4, None, None, None, None)]
    df = spark.createDataFrame(boxes, "id int, xmin double, ymin double, xmax double, ymax double")
    wanted = spark.createDataFrame([(z, x * 3 % (1 << z), x * 7 % (1 << z)) for z in (0, 3, 6) for x in range(60)], "z int, x int, y int")
    pairs = tile_ops.features_on_tiles(df, wanted, [0, 3, 6]).select("id", "z", "x", "y")
    listed = tile_ops.tiles_of_features(df, [0, 3, 6]).join(wanted.distinct(), ["z", "x", "y"]).select("id", "z", "x", "y")
    assert sorted(pairs.collect()) == sorted(listed.collect())
    far = tile_ops.features_on_tiles(df.filter("id = 1"), spark.createDataFrame([(18, 5, 9)], "z int, x int, y int"), [18])
    assert far.count() == 1  # its listing would have 2 ** 36 rows
