"""Reconciliation: what was edited against what was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.operators.skew import OrderedGroups, first_per_key


def at_moment(value) -> Column:
    """A point in time as a literal without a zone; all times are UTC."""
    return F.lit(str(value)).cast("timestamp_ntz")


def closed_in_window(
    changesets: DataFrame, now, min_age: int, max_age: int, limit: int | None = None, tie: str = "id"
) -> DataFrame:
    """Changesets closed between ``now - max_age`` and ``now - min_age`` seconds, newest first.

    ``limit`` is the size of one checking run.
    """
    moment = at_moment(now)
    oldest = moment - F.make_dt_interval(secs=F.lit(max_age))
    newest = moment - F.make_dt_interval(secs=F.lit(min_age))
    rows = changesets.filter(F.col("closed_at").between(oldest, newest))
    rows = rows.orderBy(F.col("closed_at").desc(), F.col(tie).desc())
    return rows if limit is None else rows.limit(limit)


def replication_lag(arrived: Column, stamp: Column, threshold: float) -> dict[str, Column]:
    """Seconds between the data and its arrival, and a status."""
    seconds = F.timestamp_diff("SECOND", stamp, arrived)
    status = (
        F.when(stamp.isNull(), "warning").when(seconds > threshold, "critical").otherwise("ok")
    )
    return {"lag_seconds": seconds, "status": status}


def replication_covers(changesets: DataFrame, state: DataFrame) -> DataFrame:
    """Is each changeset inside the replicated data, up to the newest time in ``state``?"""
    # An aggregate without keys is one row, however many states there are.
    one = F.broadcast(state.agg(F.max("timestamp").alias("_at")))
    behind = F.round(F.timestamp_diff("SECOND", "_at", "closed_at") / 60, 1)
    joined = changesets.crossJoin(one)
    status = (
        F.when(F.col("_at").isNull(), "warning")
        .when(F.col("_at") >= F.col("closed_at"), "ok")
        .otherwise("critical")
    )
    return joined.withColumns(
        {"status": status, "minutes_behind": F.when(status == "critical", behind)}
    ).drop("_at")


def missing_shares(checked: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Share of missing elements per changeset and its severity."""
    share = F.when(F.col("total") > 0, F.col("missing") / F.col("total") * 100).otherwise(100.0)
    counts = checked.groupBy("changeset").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_missing").alias("missing")
    )
    return counts.withColumn("missing_pct", share).withColumn(
        "severity", F.when(F.col("missing_pct") >= threshold, "failed").otherwise("warning")
    )


def element_presence(elements: DataFrame, tables: DataFrame, views: DataFrame, deleted: DataFrame) -> DataFrame:
    """Where each changed element was found, and what that means.

    ``tables`` and ``views`` have (name, osm_id), with relations negative;
    ``deleted`` lists elements gone in a later changeset.
    """
    key = F.when(F.col("type") == "relation", -F.col("osm_id")).otherwise(F.col("osm_id"))

    def hits(found: DataFrame, name: str) -> DataFrame:
        # At most one row per table name and id, so the set is bounded by the number of tables.
        return found.groupBy(F.col("osm_id").alias("_key")).agg(
            F.array_sort(F.collect_set("name")).alias(name)
        )

    gone = deleted.select("type", "osm_id").distinct().withColumn("_gone", F.lit(True))
    rows = elements.withColumn("_key", key)
    rows = rows.join(hits(tables, "found_in_tables"), "_key", "left")
    rows = rows.join(hits(views, "found_in_views"), "_key", "left").join(gone, ["type", "osm_id"], "left")
    present = F.col("found_in_tables").isNotNull()
    outcome = (
        F.when((F.col("action") == "delete") & present, "not_deleted")
        .when(F.col("action") == "delete", "ok")
        .when(present, "ok")
        .when(F.col("_gone"), "skipped")
        .otherwise("missing")
    )
    shown = F.when((F.col("action") != "delete") & present, F.col("found_in_views"))
    return rows.withColumns({"found_in_views": shown, "outcome": outcome}).drop("_key", "_gone")


def changeset_status(presence: DataFrame, stale: DataFrame) -> DataFrame:
    """One status per changeset from its elements and its stale tiles."""
    per_changeset = presence.groupBy("changeset").agg(
        F.bool_or(F.col("outcome") == "not_deleted").alias("_kept"),
        F.bool_or(F.col("outcome") == "missing").alias("_missing"),
        F.count(F.lit(1)).alias("checked"),
    )
    old = stale.select("changeset").distinct().withColumn("_stale", F.lit(True))
    status = (
        F.when(F.col("_kept"), "warning")
        .when(F.col("_missing"), "retry_pending")
        .when(F.col("_stale"), "warning")
        .otherwise("ok")
    )
    return per_changeset.join(old, "changeset", "left").select("changeset", "checked", status.alias("status"))


def not_yet_passed(changesets: DataFrame, history: DataFrame, key: str = "changeset") -> DataFrame:
    """Changesets without an earlier ok."""
    return changesets.join(history.filter("status = 'ok'").select(key), key, "left_anti")


SEVERITY = ["ok", "warning", "critical"]


def severity(status: Column) -> Column:
    return F.when(status == "critical", 2).when(status == "warning", 1).otherwise(0)


def worst(status: str) -> Column:
    """Aggregate: the worst status of a group."""
    return F.get(F.array(*[F.lit(s) for s in SEVERITY]), F.max(severity(F.col(status))))


def view_freshness(expected: DataFrame, stats: DataFrame, now) -> DataFrame:
    """Status of every expected view against scanned row counts and newest changes.

    ``expected`` has group, view and max_age (seconds); ``stats`` has view, rows
    and newest.
    """
    joined = expected.join(stats, "view", "left")
    age = F.timestamp_diff("SECOND", F.col("newest"), at_moment(now))
    status = (
        F.when(F.col("rows").isNull(), "critical")
        .when((F.col("rows") == 0) | F.coalesce(age > F.col("max_age"), F.lit(False)), "warning")
        .otherwise("ok")
    )
    return joined.select("group", "view", "rows", age.alias("age_seconds"), status.alias("status"))


def stale_tiles(touched: DataFrame, cache: DataFrame) -> DataFrame:
    """Touched tiles whose cached copy is older than the changeset; no copy is fine.

    ``touched`` has changeset, closed_at, z, x and y; ``cache`` has prefix, z,
    x, y and last_modified.
    """
    joined = touched.join(cache, ["z", "x", "y"])
    return joined.filter(F.col("last_modified") < F.col("closed_at"))


def comment_lines(elements: DataFrame) -> DataFrame:
    """One draft per changeset and element that can be commented on."""
    keys = ["changeset", "type", "osm_id"]
    rows = first_per_key(elements.filter("commentable"), keys, [F.col("skip_reason").asc_nulls_last()])
    line = F.concat(
        F.lit("- "), "type", F.lit(" "), F.col("osm_id").cast("string"), F.lit(": "), "skip_reason"
    )
    return rows.select("changeset", "type", "osm_id", line.alias("line"))


def alert_transitions(runs: DataFrame, hot=None) -> DataFrame:
    """Alerts along the runs of each check: new failures, first warnings, recoveries.

    ``runs`` has check, run_at, run_id, status and newly_failed.
    """
    rows = OrderedGroups(runs, ["check"], [F.col("run_at"), F.col("run_id")], hot)
    rows = rows.lag("status", "_previous").frame()
    before, status = F.col("_previous"), F.col("status")
    event = (
        F.when(F.col("newly_failed") > 0, "failed")
        .when((status == "warning") & (before.isNull() | (before == "ok")), "warning")
        .when((status == "ok") & before.isin("critical", "warning"), "recovered")
    )
    return rows.withColumn("event", event).filter("event IS NOT NULL").drop("_previous")
