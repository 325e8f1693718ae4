"""Change documents (S) and incremental work (T)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from terrachron.operators import changes as ops, intervals, tiles as tile_ops
from terrachron.operators.refresh import GroupedView
from terrachron.registry.base import query, sql_decimal, sql_iso
from terrachron.registry.maps import _BOXES, _EXPAND_ZOOMS, _SHORT, boxes, sql_tx, sql_ty
from terrachron.registry.temporal import _ISLANDS, _LAG
from terrachron.session import work_path
from terrachron.sources.files import changed_files, listed_files
from terrachron.sources.xml import ACTIONS, read_changes, read_changesets, write_blocks
from terrachron.streaming import ingest
from terrachron.streaming.timers import stream_reprocessing

C = F.col
TIES = ["part", "changeset", "price", "quantity", "timestamp"]
_TIES = "part, changeset, price, quantity, timestamp"


def _iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query(
    "change_scan",
    "elements",
    """SELECT action, CASE WHEN part % 4 = 0 THEN 'relation' ELSE 'way' END AS type, osm_id, version, changeset, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day,
       CASE WHEN part % 4 = 0 THEN 0 ELSE version END AS node_count, CASE WHEN part % 4 = 0 THEN version - 1 ELSE -1 END AS member_count,
       CAST(part AS VARCHAR) AS part, CASE WHEN part % 3 = 0 THEN 'a & b' END AS note FROM elements""",
)
def _(t):
    is_relation = C("part") % 4 == 0
    tags = F.array(
        F.struct(F.lit("part").alias("_k"), C("part").cast("string").alias("_v")),
        F.when(C("part") % 3 == 0, F.struct(F.lit("note").alias("_k"), F.lit("a & b").alias("_v"))),
    )
    nodes = F.transform(F.sequence(F.lit(1), C("version")), lambda i: F.struct(i.alias("_ref")))
    ways = F.transform(
        F.sequence(F.lit(1), C("version")),
        lambda i: F.struct(F.lit("way").alias("_type"), i.alias("_ref"), F.lit("").alias("_role")),
    )
    common = [
        C("osm_id").alias("_id"),
        C("version").alias("_version"),
        C("changeset").alias("_changeset"),
        _iso("timestamp").alias("_timestamp"),
        F.filter(tags, lambda x: x.isNotNull()).alias("tag"),
    ]
    blocks = t.elements().select(
        "action",
        F.when(~is_relation, F.struct(*common, nodes.alias("nd"))).alias("way"),
        F.when(is_relation, F.struct(*common, F.slice(ways, 1, C("version") - 1).alias("member"))).alias("relation"),
    )
    path = work_path(t.spark, "diffs")
    for action in ACTIONS:
        rows = blocks.filter(C("action") == action).drop("action")
        write_blocks(rows, f"{path}/{action}", action)
    path = f"{path}/*"
    rows = read_changes(t.spark, path)
    return rows.select(
        "action", "type", "osm_id", "version", "changeset", C("timestamp").cast("date").cast("string").alias("day"),
        "node_count", "member_count", *[F.try_element_at("tags", F.lit(k)).alias(k) for k in ("part", "note")],
    )


@query(
    "changeset_scan",
    "",
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created, CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS closed, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 10000 END AS min_lon, o_orderkey % 9 <> 0 AS has_box FROM orders""",
)
def _(t):
    n = C("o_orderkey")
    attributes = t.orders.select(
        n.alias("_id"),
        _iso("o_orderdate").alias("_created_at"),
        F.when(n % 6 != 0, _iso("o_orderdate")).alias("_closed_at"),
        F.when(n % 9 != 0, C("o_totalprice") / 10000).alias("_min_lon"),
        F.lit(1.0).alias("_min_lat"),
        F.lit(50.0).alias("_max_lon"),
        F.lit(2.0).alias("_max_lat"),
        F.lit("x").alias("comment"),
    )
    path = work_path(t.spark, "changesets")
    attributes.write.format("xml").option("rootTag", "osm").option("rowTag", "changeset").save(path)
    rows = read_changesets(t.spark, path)
    return rows.select(
        "id", *[F.date_format(f"{c}_at", "yyyy-MM-dd").alias(c) for c in ("created", "closed")], "min_lon", "has_box"
    )


FILES = 20


def _written_files(t, label: str) -> str:
    """Files with contents that follow from the documents: one for each remainder of the number."""
    path = work_path(t.spark, label)
    number = F.pmod("doc_id", F.lit(FILES)).alias("part")
    rows = t.documents.select(number, "doc_id", "text").repartition(FILES, "part").sortWithinPartitions("part", "doc_id")
    rows.select("part", "text").write.partitionBy("part").text(path)
    return path


@query(
    "changed_files_scan",
    "",
    f"""WITH f AS (SELECT doc_id % {FILES} AS part, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS md5, sum(strlen(text) + 1)::BIGINT AS length FROM documents GROUP BY 1)
        SELECT 'part=' || part AS name, length, md5, CASE part % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'unchanged' END AS status FROM f""",
)
def _(t):
    files = listed_files(t.spark, _written_files(t, "files"), pattern="part-*").drop("name").withColumnRenamed("folder", "name")
    number = F.substring_index("name", "=", -1).cast("int") % 3
    # The tracking table: one third unknown, one third with an old hash.
    tracked = files.filter(number != 0).select("name", F.when(number == 1, "old").otherwise(C("md5")).alias("md5"))
    return changed_files(files, tracked).select("name", "length", "md5", "status")


@query(
    "recent_file_window",
    "",
    "SELECT 'recent' AS kind, event_id, event_type FROM events",
)
def _(t):
    path = work_path(t.spark, "recent")
    t.events.select("event_id", "event_type").write.parquet(path)
    now = datetime.datetime.now(datetime.timezone.utc)

    def changed_since(minutes: int):
        since = (now - datetime.timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S")
        reader = t.spark.read.schema("event_id long, event_type string")
        return reader.option("modifiedAfter", since).option("timeZone", "UTC").parquet(path)

    recent = changed_since(60).withColumn("kind", F.lit("recent"))
    return recent.unionByName(changed_since(-60).withColumn("kind", F.lit("later"))).select("kind", "event_id", "event_type")


# ---- snapshots ----

_NEWEST = f"""SELECT *, row_number() OVER (PARTITION BY type, osm_id ORDER BY version DESC, {_TIES}) AS rn FROM elements"""
_SEQUENCE = "CAST(date_diff('day', DATE '1992-01-01', CAST(timestamp AS DATE)) // 100 AS INTEGER)"


def sequenced(t):
    days = F.datediff(C("timestamp").cast("date"), F.lit("1992-01-01").cast("date"))
    return t.elements().withColumn("sequence", F.floor(days / 100).cast("int"))


@query(
    "stream_change_ingest",
    "elements",
    f"""SELECT osm_id, version, changeset, part FROM (SELECT *, row_number() OVER (PARTITION BY type, osm_id ORDER BY version DESC, {_TIES}) AS rn FROM elements WHERE {_SEQUENCE} >= 5) WHERE rn = 1 AND action <> 'delete'""",
)
def _(t):
    root = work_path(t.spark, "ingest")
    rows = sequenced(t)
    rows.repartitionByRange(8, "sequence").write.parquet(f"{root}/diffs")
    log = ingest.ChangeLog(t.spark, f"{root}/changes", ties=TIES)
    ingest.ingest_changes(t.spark, f"{root}/diffs", rows.schema, log, f"{root}/checkpoint", first_sequence=5, files_per_batch=3)
    return log.elements().select("osm_id", "version", "changeset", "part")


@query(
    "apply_changes",
    "elements",
    f"""WITH snapshot AS (SELECT 'way' AS type, o_orderkey AS osm_id, 3 AS version, o_custkey AS changeset, 'modify' AS action, o_custkey AS part FROM orders),
        everything AS (SELECT type, osm_id, version, changeset, action, part FROM elements UNION ALL SELECT * FROM snapshot)
        SELECT osm_id, version, changeset, part FROM (SELECT *, row_number() OVER (PARTITION BY type, osm_id ORDER BY version DESC, part, changeset, action) AS rn FROM everything) WHERE rn = 1 AND action <> 'delete'""",
)
def _(t):
    columns = ["type", "osm_id", "version", "changeset", "part"]
    snapshot = t.orders.select(
        F.lit("way").alias("type"), C("o_orderkey").alias("osm_id"), F.lit(3).alias("version"), C("o_custkey").alias("changeset"), C("o_custkey").alias("part")
    )
    latest = ops.apply_changes(snapshot, t.elements().select(*columns, "action"), ties=["part", "changeset", "action"])
    return latest.select("osm_id", "version", "changeset", "part")


@query(
    "trigger_derived_columns",
    "features",
    f"SELECT id, round({sql_decimal('start_date', 'start')}, 6) AS start_decdate, round({sql_decimal('end_date', 'end')}, 6) AS end_decdate FROM features",
)
def _(t):
    rows = ops.with_decimal_dates(t.features())
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("start_decdate", "end_decdate")])


@query(
    "augmented_diff",
    "elements",
    """SELECT e.osm_id, e.action, e.version, e.changeset, CASE WHEN action <> 'create' THEN o_totalprice END AS old_price, CASE WHEN action <> 'delete' THEN price END AS new_price
       FROM elements e LEFT JOIN orders ON o_orderkey = e.osm_id""",
)
def _(t):
    prior = t.orders.select(
        F.lit("way").alias("type"), C("o_orderkey").alias("osm_id"), C("o_totalprice").alias("price"), C("o_custkey").alias("part")
    )
    diff = ops.augmented_diff(t.elements(), prior, ["price", "part"])
    return diff.select("osm_id", "action", "version", "changeset", C("old.price").alias("old_price"), C("new.price").alias("new_price"))


@query("bad_record_quarantine", "", """SELECT o_orderkey, o_custkey, o_orderkey % 7 <> 0 AS readable FROM orders""")
def _(t):
    root = work_path(t.spark, "quarantine")
    line = F.to_json(F.struct("o_orderkey", "o_custkey"))
    broken = F.concat(C("o_orderkey").cast("string"), F.lit("|"), C("o_custkey").cast("string"))
    t.orders.select(F.when(C("o_orderkey") % 7 == 0, broken).otherwise(line).alias("value")).write.text(f"{root}/in")
    ingest.split_bad_records(
        t.spark, f"{root}/in", "o_orderkey long, o_custkey long", f"{root}/good", f"{root}/bad", f"{root}/checkpoint"
    )
    good = t.spark.read.parquet(f"{root}/good").select("o_orderkey", "o_custkey", F.lit(True).alias("readable"))
    parts = F.split(ingest.CORRUPT, r"\|")
    bad = t.spark.read.parquet(f"{root}/bad").select(
        parts[0].cast("long").alias("o_orderkey"), parts[1].cast("long").alias("o_custkey"), F.lit(False).alias("readable")
    )
    return good.unionByName(bad)


_COUNTS = "count(*) AS n, count(*) FILTER (action = 'create') AS n_create, count(*) FILTER (action = 'modify') AS n_modify, count(*) FILTER (action = 'delete') AS n_delete"


@query("split_by_changeset", "elements", f"SELECT changeset, {_SEQUENCE} AS sequence, {_COUNTS} FROM elements GROUP BY 1, 2")
def _(t):
    return ops.split_by_changeset(sequenced(t))


@query(
    "merge_by_changeset",
    "elements",
    f"""WITH s AS (SELECT *, {_SEQUENCE} AS sequence FROM elements), n AS (SELECT *, row_number() OVER (PARTITION BY changeset ORDER BY sequence, osm_id, version, {_TIES}) AS rn FROM s WHERE changeset IN (SELECT changeset FROM s WHERE sequence >= 10))
        SELECT changeset, CAST((rn - 1) // 10000 AS INTEGER) AS page, string_agg(sequence || ':' || osm_id || ':' || version, ',' ORDER BY rn) AS changes FROM n GROUP BY 1, 2""",
)
def _(t):
    rows = sequenced(t)
    piece = F.concat_ws(":", *[C(c).cast("string") for c in ("sequence", "osm_id", "version")])
    merged = ops.merge_by_changeset(rows, rows.filter("sequence >= 10"), ["osm_id", "version", *TIES], piece)
    return merged.withColumn("changes", F.array_join("changes", ","))


@query(
    "sequence_range_reprocess",
    "elements",
    f"SELECT DISTINCT {_SEQUENCE} AS sequence FROM elements WHERE {_SEQUENCE} BETWEEN 3 AND 400",
)
def _(t):
    return ops.sequences_to_process(sequenced(t), 3, 400)


@query(
    "dedupe_by_hash",
    "",
    "SELECT DISTINCT event_type || '-' || user_id AS name, md5(CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) AS digest FROM events",
)
def _(t):
    root = work_path(t.spark, "uploads")
    uploads = t.events.select(
        F.concat_ws("-", "event_type", C("user_id").cast("string")).alias("name"),
        F.md5(F.floor(C("value") / 10).cast("string")).alias("digest"),
        C("ts").cast("timestamp").alias("ts"),
    )
    uploads.repartition(4).write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(uploads.schema).parquet(f"{root}/in")
    fresh = ingest.first_uploads(stream, ["name", "digest"], "ts", "3650 days")
    run = (
        fresh.writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/out")
    )
    run.awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("name", "digest")


@query(
    "delayed_reprocess",
    "",
    """WITH now AS (SELECT max(ts) - INTERVAL 3 HOUR AS moment FROM events), e AS (SELECT event_id AS expiry_id, ts AS received_at, unnest([0, 900, 7200, 10800]) AS delay FROM events)
       SELECT expiry_id, delay, strftime(date_trunc('second', received_at + to_seconds(delay)), '%Y-%m-%d %H:%M:%S') AS due FROM e, now
       WHERE received_at + to_seconds(delay) <= moment AND NOT (delay = 0 OR (delay = 900 AND expiry_id % 2 = 0))""",
)
def _(t):
    now = t.events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=3)
    expiries = t.events.select(C("event_id").alias("expiry_id"), C("ts").alias("received_at"))
    at_once = expiries.select("expiry_id", F.lit(0).alias("delay"))
    second = expiries.filter("expiry_id % 2 = 0").select("expiry_id", F.lit(900).alias("delay"))
    due = ops.due_reprocessing(expiries, at_once.unionByName(second), F.lit(str(now)).cast("timestamp_ntz"))
    return due.select("expiry_id", "delay", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query(
    "delayed_reprocess_stream",
    "",
    """WITH e AS (SELECT event_id AS expiry_id, epoch_us(ts) AS us, CAST(unnest([0, 900, 7200, 10800]) AS BIGINT) AS delay FROM events), last AS (SELECT max(epoch_us(ts)) // 1000 AS ms FROM events)
       SELECT expiry_id, CAST(delay AS INTEGER) AS delay, us + delay * 1000000 AS due_us FROM e, last WHERE delay = 0 OR (us + delay * 1000000) // 1000 <= ms""",
)
def _(t):
    """All runs that fall due while the stream of expiries lasts, by timers."""
    root = work_path(t.spark, "timers")
    rows = t.events.select(C("event_id").alias("expiry_id"), C("ts").cast("timestamp").alias("received_at"))
    rows.write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    runs = stream_reprocessing(stream).writeStream.outputMode("append").format("parquet")
    runs.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("expiry_id", "delay", F.unix_micros("due_at").alias("due_us"))


@query(
    "expire_tiles_stream",
    "features",
    f"""WITH {_BOXES}, halves AS (SELECT CASE WHEN min_lon > max_lon THEN -180 ELSE min_lon END AS w, max_lon AS e, min_lat, max_lat FROM boxes
          UNION ALL SELECT min_lon, 180, min_lat, max_lat FROM boxes WHERE min_lon > max_lon),
        c AS (SELECT greatest(-180.0, w) AS w, least(180.0, e) AS e, greatest(-85.051129, min_lat) AS s, least(85.051129, max_lat) AS n FROM halves),
        rg AS (SELECT {sql_tx('w', '9')} AS x0, {sql_tx('(e - 1e-11)', '9')} AS x1, {sql_ty('n', '9')} AS y0, {sql_ty('(s + 1e-11)', '9')} AS y1 FROM c),
        ex AS (SELECT DISTINCT 9 AS z, unnest(generate_series(x0, x1)) AS x FROM rg WHERE x0 <= x1 AND y0 <= y1), tz AS (SELECT *, unnest({_EXPAND_ZOOMS}) AS tz FROM ex),
        lim AS (SELECT tz, CASE WHEN tz <= z THEN x >> (z - tz) ELSE x << (tz - z) END AS lo, CASE WHEN tz <= z THEN x >> (z - tz) ELSE ((x + 1) << (tz - z)) - 1 END AS hi FROM tz),
        al AS (SELECT tz, unnest(generate_series(lo, hi)) AS x FROM lim) SELECT DISTINCT tz || '/' || {_SHORT} AS prefix FROM al""",
)
def _(t):
    root = work_path(t.spark, "expiry")
    changed = boxes(t)
    changed.repartition(4).write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(changed.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    ingest.append_batches(
        stream,
        lambda rows: tile_ops.expand_prefixes(tile_ops.ranges_of_box(rows, [9]), _EXPAND_ZOOMS),
        f"{root}/out",
        f"{root}/checkpoint",
    )
    return t.spark.read.parquet(f"{root}/out").select("prefix").distinct()


_CHANGED = "CASE WHEN status = 'P' THEN start_decdate - 2 ELSE start_decdate END"


@query(
    "incremental_view_refresh",
    "members",
    f"""WITH edited AS (SELECT * REPLACE ({_CHANGED} AS start_decdate) FROM members), {_LAG.replace('FROM members', 'FROM edited')}, {_ISLANDS}
        SELECT status, member, group_id, merged_row_count, round(s, 6) AS min_start_decdate, round(e, 6) AS max_end_decdate, {sql_iso('s')} AS min_start_date_iso, {sql_iso('e')} AS max_end_date_iso FROM m""",
)
def _(t):
    keys = ["status", "member"]
    before = t.members()
    edited = before.withColumn(
        "start_decdate", F.when(C("status") == "P", C("start_decdate") - 2).otherwise(C("start_decdate"))
    )

    def build(rows):
        return intervals.merge_intervals(rows, keys, tie="osm_id")

    view = GroupedView(t.spark, work_path(t.spark, "grouped"), keys, parts=16)
    view.create(build(before))
    view.refresh(edited, edited.filter("status = 'P'"), build)
    return view.read().withColumns({c: F.round(c, 6) for c in ("min_start_decdate", "max_end_decdate")})


@query(
    "stateful_retry",
    "elements",
    """WITH st AS (SELECT o_custkey AS changeset, 'way' AS type, o_orderkey AS osm_id, CAST(o_orderkey % 3 AS INTEGER) AS retry_count, 3 AS max_retries,
          CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'pending' END AS status FROM orders),
        fresh AS (SELECT DISTINCT changeset, type, osm_id, 0 AS retry_count, 3 AS max_retries, 'pending' AS status FROM elements e WHERE action = 'modify' AND NOT EXISTS (SELECT 1 FROM st WHERE st.changeset = e.changeset AND st.type = e.type AND st.osm_id = e.osm_id)),
        al AS (SELECT * FROM st UNION ALL SELECT * FROM fresh), share AS (SELECT c_custkey AS changeset, c_acctbal / 100 AS pct FROM customer)
        SELECT al.changeset, al.osm_id, CAST(retry_count + CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
          CASE WHEN status = 'pending' AND retry_count + 1 >= max_retries THEN CASE WHEN COALESCE(pct, 100) >= 10 THEN 'failed' ELSE 'warning' END ELSE status END AS status
        FROM al LEFT JOIN share ON share.changeset = al.changeset WHERE al.osm_id NOT IN (SELECT osm_id FROM elements WHERE action = 'delete')""",
)
def _(t):
    n = C("o_orderkey")
    state = t.orders.select(
        C("o_custkey").alias("changeset"), F.lit("way").alias("type"), n.alias("osm_id"), (n % 3).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"),
        F.when(C("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"),
    )
    e = t.elements()
    shares = t.customer.select(C("c_custkey").alias("changeset"), (C("c_acctbal") / 100).alias("missing_pct"))
    after = ops.advance_retries(state, e.filter("action = 'modify'"), e.filter("action = 'delete'"), shares)
    return after.select("changeset", "osm_id", "retry_count", "status")
