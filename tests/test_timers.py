"""Delayed runs as a stream against the batch filter, over a restart."""

import datetime

from pyspark.sql import functions as F

from terrachron.operators.changes import due_reprocessing
from terrachron.session import work_path
from terrachron.streaming.timers import stream_reprocessing

BEGIN = datetime.datetime(2026, 1, 1)
SCHEMA = "expiry_id long, received_at timestamp"


def run(spark, root):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = (
        stream_reprocessing(stream).writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(lambda rows, batch: rows.write.mode("append").parquet(f"{root}/out")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress


def test_timers_equal_the_batch_and_survive_a_restart(spark):
    root = work_path(spark, "timers")
    given = []
    for part in range(3):
        rows = [(part * 100 + i, BEGIN + datetime.timedelta(seconds=part * 5000 + i * 137)) for i in range(25)]
        rows += [(part * 100, rows[0][1])]  # sent twice
        given += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        progress = run(spark, root)  # every run goes on from the checkpoint of the one before
        got = sorted((r.expiry_id, r.delay, r.due_at) for r in spark.read.parquet(f"{root}/out").collect())
        expiries = spark.createDataFrame(sorted(set(given)), SCHEMA)
        now = max(t for _, t in given)
        batch = due_reprocessing(expiries, expiries.limit(0).select("expiry_id", F.lit(0).alias("delay")), F.lit(now).cast("timestamp"))
        want = {(r.expiry_id, r.delay, r.due_at) for r in batch.collect()}
        assert len(got) == len(set(got)) and set(got) == want
    # the last run of an expiry ends its state
    done = {i for i, d, _ in got if d == 10_800}
    held = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert done and held[-1] == len({i for i, _ in given}) - len(done)


def test_expiries_share_state(spark):
    """Four keys hold the expiries of all numbers: calls do not grow with expiries, each keeps its own first arrival."""
    root = work_path(spark, "shared-timers")
    first = [(i, BEGIN + datetime.timedelta(seconds=i * 137 % 9000)) for i in range(300)]
    again = [(i, t + datetime.timedelta(seconds=9000)) for i, t in first]  # sent again before the last run
    progress = []
    for rows in (first, again, [(1000, BEGIN + datetime.timedelta(days=1))]):
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        query = stream_reprocessing(stream, buckets=4).writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
        query = query.option("checkpointLocation", f"{root}/checkpoint").start(f"{root}/out")
        query.awaitTermination()
        progress += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    got = sorted((r.expiry_id, r.delay, r.due_at) for r in spark.read.parquet(f"{root}/out").collect())
    want = [(i, d, t + datetime.timedelta(seconds=d)) for i, t in first for d in (0, 900, 7200, 10_800)]
    assert got == sorted([*want, (1000, 0, BEGIN + datetime.timedelta(days=1))])
    assert max(progress) <= 4 and progress[-1] == 1
