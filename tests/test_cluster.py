"""Clustered layouts: what a box or a moment reads, and that it finds everything."""

import random

import pytest
from pyspark.sql import functions as F

from terrachron.functions.geometry import meets_box
from terrachron.plans import cluster, publish
from terrachron.session import work_path


def scan(df):
    """The file scan of a plan without exchanges, after it has run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0)


def files_read(df):
    return scan(df).metrics().apply("numFiles").value()


def test_curve_visits_every_cell_once_and_step_by_step(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BITS", 5)
    cells = spark.range(1024).select((F.col("id") % 32).alias("x"), F.floor(F.col("id") / 32).alias("y"))
    rows = {r.h: (r.x, r.y) for r in cells.select("x", "y", cluster.hilbert(F.col("x"), F.col("y")).alias("h")).collect()}
    assert sorted(rows) == list(range(1024)) and all(cluster.hilbert_number(*xy) == h for h, xy in rows.items())
    assert all(abs(rows[h][0] - rows[h + 1][0]) + abs(rows[h][1] - rows[h + 1][1]) == 1 for h in range(1023))


def boxes(spark, n=20_000):
    draw = random.Random(4)
    rows = []
    for i in range(n):
        size = 10 ** draw.uniform(1, 5) if i % 100 else 10 ** draw.uniform(5, 7.7)
        x, y = draw.uniform(-2e7, 2e7), draw.uniform(-2e7, 2e7)
        rows.append((i, x, y, x + size, y + size * draw.random()))
    rows += [(n, None, None, None, None), (n + 1, 3e7, 3e7, 3.1e7, 3.1e7), (n + 2, -9e7, -9e7, 9e7, 9e7), (n + 3, 5.0, 5.0, 5.0, 5.0)]
    return spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double")


def test_one_percent_box_reads_few_files(spark):
    rows = boxes(spark)
    root = work_path(spark, "clustered")
    publish.publish(rows, root, "boxes", ["id"], levels=5)
    whole = publish.open_view(spark, root, "boxes")
    assert sorted(whole.columns) == sorted(rows.columns) and whole.count() == rows.count()
    total = files_read(whole)
    for box in ((-1e6, 3e6, 3e6, 7e6), (1.5e7, -1.6e7, 1.9e7, -1.2e7)):  # a tenth of the world each way
        found = publish.open_view(spark, root, "boxes", box)
        want = sorted(r.id for r in rows.filter(meets_box(*box)).select("id").collect())
        assert sorted(r.id for r in found.collect()) == want and len(want) > 100
        assert files_read(found) < 0.05 * total
    for box in ((2.9e7, 2.9e7, 4e7, 4e7), (5, 5, 5, 5), (-1e9, -1e9, 1e9, 1e9)):
        found = publish.open_view(spark, root, "boxes", box)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in rows.filter(meets_box(*box)).select("id").collect())


@pytest.mark.parametrize("levels", [0, 3])
def test_published_tables_take_turns(spark, levels):
    root = work_path(spark, "turns")
    rows = boxes(spark, 200)
    for n in (150, 100, 50):
        publish.publish(rows.filter(F.col("id") < n), root, "boxes", ["id"], levels=levels)
        assert publish.open_view(spark, root, "boxes").count() == n
    with pytest.raises(ValueError):
        publish.publish(rows.unionByName(rows), root, "boxes", ["id"], levels=levels)
    assert publish.open_view(spark, root, "boxes").count() == 50
    assert not publish.is_published(spark, root, "others")
    with pytest.raises(FileNotFoundError):
        publish.open_view(spark, root, "others")


def test_timeline_reads_one_bucket_a_level(spark):
    draw = random.Random(9)
    rows = []
    for i in range(4000):
        start = draw.uniform(-3000, 2020)
        end = start + draw.choice([0.2, 3, 40, 400]) * draw.random()
        rows.append((i, None if i % 17 == 0 else start, None if i % 5 == 0 else end))
    rows += [(5000, 1950.0, 1950.0), (5001, 1960.0, 1950.0), (5002, -1e7, 1e7), (5003, None, None), (5004, 1999.5, 2000.5)]
    frame = spark.createDataFrame(rows, "id int, start_decdate double, end_decdate double")
    path = work_path(spark, "timeline")
    cluster.write_timeline(frame, path)
    table = spark.read.parquet(path)
    total = files_read(table.select("id"))
    for moment in (-2999.5, -44.2, 0.0, 1066.0, 1950.0, 1999.9, 2500.0):
        found = cluster.as_of(table, moment)
        want = sorted(i for i, s, e in rows if (s is None or s <= moment) and (e is None or e > moment))
        assert found.columns == frame.columns and sorted(r.id for r in found.collect()) == want
        closed = cluster.as_of(table.filter(F.col("_span") <= cluster.TOP), moment)
        assert files_read(closed) <= 3 * (cluster.TOP - cluster.FINEST + 1) < total / 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_years" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
