"""The retry table as a stream with state for each element."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "changeset array<long>, retry_count array<int>, status array<string>"
RESULT = "run long, changeset long, type string, osm_id long, retry_count int, max_retries int, status string"


def advance(
    rows: dict[int, tuple[int, str]], events: pd.DataFrame, max_retries: int, threshold: float
) -> dict[int, tuple[int, str]]:
    """One run over the rows of an element, by changeset: (retry count, status)."""
    if (events["kind"] == "settled").any():
        return {}
    after = dict(rows)
    for changeset in events.loc[events["kind"] == "missing", "changeset"]:
        after.setdefault(int(changeset), (0, "pending"))
    shares = {int(c): p for c, p in zip(events["changeset"], events["missing_pct"]) if c == c}
    for changeset, share in shares.items():
        count, status = after.get(changeset, (0, ""))
        if status == "pending":
            final = "warning" if share is not None and share < threshold else "failed"
            after[changeset] = (count + 1, final if count + 1 >= max_retries else status)
    return after


def stream_retries(events: DataFrame, max_retries: int = 3, threshold: float = 10.0) -> DataFrame:
    """Retry rows from a stream of events; the same outcome as ``advance_retries`` run by run.

    ``events`` has run, kind, changeset, type, osm_id and missing_pct. ``missing`` adds an element
    of a changeset, ``settled`` (without a changeset) takes the element out, ``run`` counts one that
    is pending; ``missing`` counts too. A run sends a row for each pending element it tried,
    with the share of missing elements of the changeset, null if unknown. State is a few numbers
    for each element that is not settled. Output is for mode ``update``: the rows of each
    element after its last run; status ``settled`` says that its rows are gone.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, osm_id = key
        rows: dict[int, tuple[int, str]] = {}
        if state.exists:
            changesets, counts, statuses = state.get
            rows = {c: (n, s) for c, n, s in zip(changesets, counts, statuses)}
        found = pd.concat(list(batches))
        last = int(found["run"].max())
        gone: set[int] = set()
        for _, events_ in found.groupby("run", sort=True):
            after = advance(rows, events_, max_retries, threshold)
            gone = (gone | set(rows)) - set(after)
            rows = after
        if rows:
            state.update((list(rows), [n for n, _ in rows.values()], [s for _, s in rows.values()]))
        elif state.exists:
            state.remove()
        out = [(last, c, kind, osm_id, n, max_retries, s) for c, (n, s) in rows.items()]
        out += [(last, c, kind, osm_id, 0, max_retries, "settled") for c in gone]
        yield pd.DataFrame(out, columns=["run", "changeset", "type", "osm_id", "retry_count", "max_retries", "status"])

    return events.groupBy("type", "osm_id").applyInPandasWithState(
        step, RESULT, STATE, "update", GroupStateTimeout.NoTimeout
    )
