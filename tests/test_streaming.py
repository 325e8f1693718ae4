from pathlib import Path

from pyspark.sql import functions as F

from terrachron.operators.changes import advance_retries, apply_changes
from terrachron.operators import skew
from terrachron.operators.refresh import GroupedView
from terrachron.session import work_path
from terrachron.sources import xml
from terrachron.streaming import ingest
from terrachron.streaming.retries import stream_retries

SCHEMA = "type string, osm_id long, version int, action string, changeset long, sequence int"


def test_stream_equals_batch_and_resumes(spark):
    """Late and deleted elements, two runs, and a batch that is run again."""
    rows = [("way", i % 40, i // 40 + 1, "delete" if i % 11 == 0 else "modify", i, i // 20) for i in range(400)]
    changes = spark.createDataFrame(rows, SCHEMA)
    root = work_path(spark, "stream")
    table = ingest.ChangeLog(spark, f"{root}/state")
    # The later half arrives first.
    for half in (changes.filter("sequence >= 10"), changes.filter("sequence < 10")):
        half.repartition(3).write.mode("append").parquet(f"{root}/in")
        ingest.ingest_changes(spark, f"{root}/in", SCHEMA, table, f"{root}/checkpoint", files_per_batch=2)
    batch = apply_changes(None, changes)
    columns = ["type", "osm_id", "version", "changeset"]
    assert sorted(table.elements().select(columns).collect()) == sorted(batch.select(columns).collect())
    before = sorted(table.elements().select(columns).collect())
    last = spark.read.parquet(f"{root}/state").agg(F.max("batch")).first()[0]
    table.add(changes, last)
    assert sorted(table.elements().select(columns).collect()) == before


def files_below(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_small_batch_rewrites_no_old_file(spark):
    rows = [("way", i % 40, i // 40 + 1, "delete" if i % 11 == 0 else "modify", i, 0) for i in range(400)]
    path = f"{work_path(spark, 'log')}/state"
    table = ingest.ChangeLog(spark, path)
    table.add(spark.createDataFrame(rows, SCHEMA), 0)
    old = files_below(path)
    first = sorted(table.elements().collect())
    table.add(spark.createDataFrame([("way", 3, 99, "modify", 7, 1), ("way", 4, 99, "delete", 7, 1)], SCHEMA), 1)
    assert old.items() <= files_below(path).items() and len(files_below(path)) - len(old) <= 2
    columns = ["type", "osm_id", "version", "changeset"]
    before = sorted(table.elements().select(columns).collect())
    assert ("way", 3, 99, 7) in [tuple(r) for r in before] and 4 not in {r.osm_id for r in before}
    # an old version of a deleted element stays dead; a batch that runs again changes nothing
    table.add(spark.createDataFrame([("way", 4, 5, "modify", 8, 2)], SCHEMA), 2)
    table.add(spark.createDataFrame(rows, SCHEMA), 0)
    assert sorted(table.elements().select(columns).collect()) == before
    assert sorted(table.elements(up_to=0).collect()) == first


def test_refresh_replaces_touched_parts_only(spark):
    path = f"{work_path(spark, 'grouped')}/view"
    rows = spark.range(300).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    build = lambda df: df.groupBy("k").agg(F.sum("v").alias("total"))
    view = GroupedView(spark, path, ["k"], parts=20)
    view.create(build(rows))
    old = files_below(path)
    edited = rows.filter("k <> 8").withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v")))
    parts = view.refresh(edited, rows.filter("k in (7, 8)"), build)
    assert 1 <= len(parts) <= 2 and sorted(view.read().collect()) == sorted(build(edited).collect())
    kept = {p: t for p, t in old.items() if not any(f"part={k}/" in p for k in parts)}
    assert kept.items() <= files_below(path).items()
    # a partition that has lost all its groups is replaced too
    view.refresh(edited.filter("k < 0"), rows.filter("k < 40"), build)
    assert sorted(r.k for r in view.read().collect()) == list(range(40, 50)) and view.refresh(edited, rows.limit(0), build) == []


def test_retries_as_a_stream_equal_the_batch(spark):
    """Four runs; elements are missed by several changesets, settle, and are missed again."""
    key = "changeset long, type string, osm_id long"
    missing = [[(c, "way", i) for c in (1, 2) for i in range(12) if (i + c + run) % 3 == 0] for run in range(4)]
    settled = [[("way", i) for i in range(12) if (i + run) % 7 == 0] for run in range(4)]
    shares = [(1, 4.0)]  # that of changeset 2 is unknown
    state = spark.createDataFrame([], f"{key}, retry_count int, max_retries int, status string")
    root, events = work_path(spark, "retries"), "run long, kind string, changeset long, type string, osm_id long, missing_pct double"
    for run in range(4):
        pending = [(r.changeset, r.type, r.osm_id) for r in state.filter("status = 'pending'").collect()]
        rows = [(run, "missing", *k, dict(shares).get(k[0])) for k in missing[run]]
        rows += [(run, "run", *k, dict(shares).get(k[0])) for k in pending if k not in missing[run]]
        rows += [(run, "settled", None, *e, None) for e in settled[run]]
        spark.createDataFrame(rows, events).coalesce(1).write.mode("append").parquet(f"{root}/in")
        after = advance_retries(
            state, spark.createDataFrame(missing[run], key), spark.createDataFrame(settled[run], "type string, osm_id long"),
            spark.createDataFrame(shares, "changeset long, missing_pct double"),
        )
        state = spark.createDataFrame(after.collect(), after.schema)
        stream = spark.readStream.schema(events).parquet(f"{root}/in")
        query = (
            stream_retries(stream).writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
            .foreachBatch(lambda df, batch: df.write.mode("append").parquet(f"{root}/out")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    seen = {}
    for r in sorted(spark.read.parquet(f"{root}/out").collect(), key=lambda r: r.run):
        seen[(r.changeset, r.type, r.osm_id)] = (r.retry_count, r.status)
    got = {k: v for k, v in seen.items() if v[1] != "settled"}
    assert got == {(r.changeset, r.type, r.osm_id): (r.retry_count, r.status) for r in state.collect()}
    assert {s for _, s in got.values()} >= {"pending"} and len(got) > 5


def test_change_documents_are_compressed_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(xml, "FILE_BLOCKS", 4)
    path = work_path(spark, "documents")
    fields = "_id: bigint, _version: int, _changeset: bigint, _timestamp: string, tag: array<struct<_k: string, _v: string>>"
    rows = [((i, 1, i, "2026-01-01T00:00:00Z", [("note", "a & b")], [(k,) for k in range(i % 3)]),) for i in range(10)]
    blocks = spark.createDataFrame(rows, f"way struct<{fields}, nd: array<struct<_ref: bigint>>>").coalesce(1)
    for action in ("create", "delete"):
        xml.write_blocks(blocks, f"{path}/{action}", action)
    files = [p for p in Path(path.removeprefix("file:")).rglob("part-*")]
    assert len(files) == 6 and all(p.name.endswith(".gz") for p in files)
    got = sorted((r.action, r.osm_id, r.node_count, r.tags["note"]) for r in xml.read_changes(spark, f"{path}/*").collect())
    assert got == sorted((a, i, i % 3, "a & b") for a in ("create", "delete") for i in range(10))


def test_a_large_batch_is_dealt_out(spark, monkeypatch):
    """Tasks take a bounded number of rows, whatever the number of shuffle partitions."""
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    rows = [("way", i, 1, "modify", i, 0) for i in range(400)]
    path = f"{work_path(spark, 'dealt')}/state"
    table = ingest.ChangeLog(spark, path)
    table.add(spark.createDataFrame(rows, SCHEMA), 0)
    assert len(files_below(path)) == 8
    assert table.elements().rdd.getNumPartitions() == 8 and table.elements().count() == 400
