"""Changes over snapshots, per changeset and per sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions.dates import to_decimal
from terrachron.operators.skew import first_per_key, paged_lists

ELEMENT = ["type", "osm_id"]


def newest_changes(changes: DataFrame, order: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """The last change of each element by the order columns."""
    ranking = [F.col(c).desc_nulls_last() for c in order] + [F.col(c).asc_nulls_last() for c in ties]
    return first_per_key(changes, ELEMENT, ranking)


def apply_changes(
    snapshot: DataFrame | None, changes: DataFrame, order: Sequence[str] = ("version",), ties: Sequence[str] = ()
) -> DataFrame:
    """Next snapshot: the highest version of each element, without the deleted ones.

    Applying the same changes again gives the same result. ``snapshot`` has one row
    for each element.
    """
    columns = [c for c in changes.columns if c != "action"]
    latest = newest_changes(changes, order, ties)
    if snapshot is not None:
        latest = overlay(snapshot.select(*columns).withColumn("action", F.lit("modify")), latest, order, ties)
    return latest.filter(F.col("action") != "delete").select(*columns)


def overlay(
    base: DataFrame, newest: DataFrame, order: Sequence[str] = ("version",), ties: Sequence[str] = ()
) -> DataFrame:
    """``base`` with the newer of both rows where ``newest`` has the element too.

    Both have one row for each element. Only elements that ``newest`` touches are ranked; the
    others pass an anti join, which moves no row of ``base`` while the keys are few.
    """
    keys = newest.select(*ELEMENT)
    untouched = base.join(keys, ELEMENT, "left_anti")
    touched = base.join(keys, ELEMENT, "left_semi")
    return untouched.unionByName(newest_changes(touched.unionByName(newest), order, ties))


def with_decimal_dates(df: DataFrame) -> DataFrame:
    """Derived date columns, filled in as rows arrive."""
    return df.withColumns(
        {
            "start_decdate": to_decimal(F.col("start_date"), "start"),
            "end_decdate": to_decimal(F.col("end_date"), "end"),
        }
    )


def augmented_diff(changes: DataFrame, prior: DataFrame, state: Sequence[str]) -> DataFrame:
    """Each change with the old and the new state of its element.

    A created element has no old state, a deleted one no new state.
    """
    old = prior.select(*ELEMENT, F.struct(*state).alias("old"))
    new = F.when(F.col("action") != "delete", F.struct(*state)).alias("new")
    kept = [*ELEMENT, "action", "version", "changeset"]
    with_new = changes.select(*kept, *[c for c in changes.columns if c == "sequence"], new)
    return with_new.join(old, ELEMENT, "left").withColumn(
        "old", F.when(F.col("action") != "create", F.col("old"))
    )


def split_by_changeset(changes: DataFrame) -> DataFrame:
    """Size of each piece: the changes of one changeset in one sequence."""
    def of(action: str) -> Column:
        return F.count_if(F.col("action") == action).alias(f"n_{action}")

    return changes.groupBy("changeset", "sequence").agg(
        F.count(F.lit(1)).alias("n"), of("create"), of("modify"), of("delete")
    )


def merge_by_changeset(
    changes: DataFrame, touched: DataFrame, order: Sequence[str], value: Column, page_rows: int = 10_000
) -> DataFrame:
    """All changes of the touched changesets in sequence order, in pages of bounded size."""
    ids = touched.select("changeset").distinct()
    wanted = changes.join(ids, "changeset", "left_semi")
    ranking = [F.col("sequence"), *[F.col(c) for c in order]]
    return paged_lists(wanted, ["changeset"], ranking, value, "changes", page_rows)


def sequences_to_process(available: DataFrame, first: int, last: int) -> DataFrame:
    """Sequences of the range that exist; missing ones are skipped."""
    return available.filter(F.col("sequence").between(first, last)).select("sequence").distinct()


def due_reprocessing(
    expiries: DataFrame, done: DataFrame, now: Column, delays: Sequence[int] = (0, 900, 7_200, 10_800)
) -> DataFrame:
    """Runs that are due: each expiry at once and again after each delay, minus those done.

    ``expiries`` has expiry_id and received_at; ``done`` has expiry_id and delay.
    """
    rows = expiries.withColumn("delay", F.explode(F.array(*[F.lit(d) for d in delays])))
    due_at = F.col("received_at") + F.make_dt_interval(secs=F.col("delay"))
    due = rows.withColumn("due_at", due_at).filter(F.col("due_at") <= now)
    return due.join(done.select("expiry_id", "delay").distinct(), ["expiry_id", "delay"], "left_anti")


RETRY_KEY = ["changeset", "type", "osm_id"]


def advance_retries(
    state: DataFrame,
    missing: DataFrame,
    settled: DataFrame,
    missing_share: DataFrame,
    max_retries: int = 3,
    threshold: float = 10.0,
) -> DataFrame:
    """One run over the retry table.

    New missing elements join as pending. Elements in ``settled`` (found,
    deleted or no longer wanted) leave. Pending ones count up and become failed
    or warning at the maximum, by the share of missing elements in their
    changeset; an unknown share counts as 100 %. Failed and warning rows stay.
    """
    columns = [*RETRY_KEY, "retry_count", "max_retries", "status"]
    fresh = (
        missing.select(*RETRY_KEY)
        .distinct()
        .join(state, RETRY_KEY, "left_anti")
        .select(
            *RETRY_KEY,
            F.lit(0).alias("retry_count"),
            F.lit(max_retries).alias("max_retries"),
            F.lit("pending").alias("status"),
        )
    )
    rows = state.select(*columns).unionByName(fresh)
    left = rows.join(settled.select(*ELEMENT).distinct(), ELEMENT, "left_anti")
    shares = missing_share.select("changeset", "missing_pct")
    tried = left.join(shares, "changeset", "left")
    pending = F.col("status") == "pending"
    count = F.col("retry_count") + F.when(pending, 1).otherwise(0)
    final = F.when(F.coalesce("missing_pct", F.lit(100.0)) >= threshold, "failed").otherwise("warning")
    status = F.when(pending & (count >= F.col("max_retries")), final).otherwise(F.col("status"))
    return tried.select(
        *RETRY_KEY, count.alias("retry_count"), "max_retries", status.alias("status")
    )
