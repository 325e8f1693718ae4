import pytest
from pyspark.sql import functions as F

from terrachron.functions import geometry as geo
from terrachron.operators.mapping import layer_table, load_layers
from terrachron.plans import publish, pyramid
from terrachron.plans.serving import serving_bands
from terrachron.registry.base import Tables
from terrachron.session import work_path
from terrachron.sources.layers import LAYERS, layer_schema


def test_catalogue_is_complete_and_ordered():
    views = pyramid.catalogue()
    assert len(views) == len({v.name for v in views}) == 127
    known = {*LAYERS, "land_polygons", "ne_10m_lakes", "ne_10m_lakes_europe", "ne_10m_lakes_north_america"}
    for view in views:
        assert set(view.sources) <= known | {"routes_normalized_members"}
        known.add(view.name)
    assert {row[3] for row in serving_bands()} <= known


@pytest.mark.parametrize("name", sorted(LAYERS))
def test_layers_have_their_schema(spark, name):
    elements = Tables(spark, "/root/testdata/sf0.001").tagged().withColumns(
        {"geometry": geo.point(F.col("x"), F.col("y")), "member": F.lit(1).cast("long"), "role": F.lit(""), "me_tags": F.col("tags")}
    )
    table = layer_table(elements, name)
    expected = layer_schema(name)
    assert {f.name: f.dataType.simpleString() for f in table.schema} == {f.name: f.dataType.simpleString() for f in expected}


def test_pyramid_of_water(spark):
    elements = Tables(spark, "/root/testdata/sf0.001").tagged()
    square = geo.rectangle(F.col("x"), F.col("y"), (F.col("osm_id") % 50) * 300.0 + 1, (F.col("osm_id") % 50) * 300.0 + 1)
    track = geo.line(F.array(geo.vertex(F.col("x"), F.col("y")), geo.vertex(F.col("x") + 500, F.col("y"))))
    layers = {"water_areas": layer_table(elements.withColumn("geometry", square), "water_areas"), "water_lines": layer_table(elements.withColumn("geometry", track), "water_lines")}
    root = work_path(spark, "pyramid")
    names = [v.name for v in pyramid.catalogue() if v.name.startswith("water_")]
    assert pyramid.build_all(spark, layers, root, ["name:en"], names) == names and len(names) == 15
    counts = {n: publish.open_view(spark, root, n).count() for n in names}
    assert counts["water_areas_z16_20"] > counts["water_areas_z8_9"] >= counts["water_areas_z6_7"] > 0
    detailed = publish.open_view(spark, root, "water_areas_z16_20")
    assert {"area_km2", "start_decdate", "name_en", "source", "xmin"} <= set(detailed.columns)


def test_all_layers_from_one_scan(spark):
    """The stored matches give the same tables as a scan for each layer, and each table reads its own folder."""
    elements = Tables(spark, "/root/testdata/sf0.001").tagged().limit(400).withColumns(
        {"geometry": geo.point(F.col("x"), F.col("y")), "member": F.lit(1).cast("long"), "role": F.lit(""), "me_tags": F.col("tags")}
    )
    tables = load_layers(elements, work_path(spark, "layers"))
    assert set(tables) == set(LAYERS)
    for name in ("water_areas", "place_points", "transport_lines"):
        columns = ["id", "osm_id", "class", "type"]
        assert sorted(tables[name].select(columns).collect()) == sorted(layer_table(elements, name).select(columns).collect())
        plan = tables[name]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and f"layer#" in plan.split("PartitionFilters")[1][:120]


def test_build_resumes_and_opens_published_sources(spark):
    elements = Tables(spark, "/root/testdata/sf0.001").tagged()
    square = geo.rectangle(F.col("x"), F.col("y"), (F.col("osm_id") % 50) * 300.0 + 1, (F.col("osm_id") % 50) * 300.0 + 1)
    layers = {"water_areas": layer_table(elements.withColumn("geometry", square), "water_areas")}
    root = work_path(spark, "resumed")
    names = [v.name for v in pyramid.catalogue() if v.name.startswith("water_areas")][:3]
    assert pyramid.build_all(spark, layers, root, only=names[:1]) == names[:1]
    assert pyramid.build_all(spark, layers, root, only=names, resume=True) == names[1:]
    assert pyramid.build_all(spark, {}, root, only=names[1:2]) == names[1:2]  # its source is a published view


def test_every_view_of_the_catalogue_is_built(spark):
    elements = Tables(spark, "/root/testdata/sf0.001").tagged().limit(500).withColumns(
        {"member": (F.col("osm_id") + 1).cast("long"), "role": F.lit("outer"), "me_tags": F.col("tags")}
    )
    x, y, side = F.col("x"), F.col("y"), (F.col("osm_id") % 50) * 300.0 + 1
    track = geo.line(F.array(geo.vertex(x, y), geo.vertex(x + 500, y)))
    square = geo.rectangle(x, y, side, side)
    shapes = {"point": geo.point(x, y), "polygon": square}
    layers = {}
    for kind in {layer.geometry for layer in LAYERS.values()}:
        names = [n for n, layer in LAYERS.items() if layer.geometry == kind]
        shaped = elements.withColumn("geometry", shapes.get(kind, track))
        layers.update(load_layers(shaped, work_path(spark, f"layers-{kind}"), names))
    squares = elements.select(F.col("osm_id").alias("ogc_fid"), F.lit("lake").alias("name"), square.alias("geometry"))
    layers.update({n: squares for n in ("land_polygons", "ne_10m_lakes", "ne_10m_lakes_europe", "ne_10m_lakes_north_america")})
    root = work_path(spark, "catalogue")
    names = [v.name for v in pyramid.catalogue()]
    assert pyramid.build_all(spark, layers, root, ["name:en"]) == names
    assert all(publish.is_published(spark, root, n) for n in names)
    assert pyramid.build_all(spark, layers, root, ["name:en"], resume=True) == []


def test_publish_rejects_duplicates_and_keeps_the_old_view(spark):
    root = work_path(spark, "publish")
    good = spark.range(5).withColumn("v", F.lit("a"))
    publish.publish(good, root, "view", ["id"])
    with pytest.raises(ValueError):
        publish.publish(good.unionByName(good), root, "view", ["id"])
    assert publish.open_view(spark, root, "view").count() == 5
    publish.publish(spark.range(3), root, "view", ["id"])
    assert publish.open_view(spark, root, "view").count() == 3


def test_box_filter_reaches_the_scan(spark):
    root = work_path(spark, "boxes")
    t = Tables(spark, "/root/testdata/sf0.001")
    publish.publish(t.rects().withColumns(geo.bounds(F.col("geometry"))), root, "rects")
    found = publish.open_view(spark, root, "rects").filter(geo.meets_box(0, 0, 100, 100)).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(xmin" in plan and "geometry" not in plan.split("ReadSchema")[1]
