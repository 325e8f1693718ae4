"""Delayed runs as a stream: timers in keyed state, dropped after the last of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "expiry_id array<long>, received_us array<long>, next array<int>"
RESULT = "expiry_id long, delay int, due_us long"
DELAYS = (0, 900, 7_200, 10_800)
#: Keys of the state, a prime number. A call from Spark costs about the same for one expiry and for a thousand.
BUCKETS = 4_093


def first_arrivals(ids: np.ndarray, received: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each id: that furthest on, or else the earliest."""
    order = np.lexsort((received, -at, ids))
    ids, received, at = ids[order], received[order], at[order]
    first = np.append(True, ids[1:] != ids[:-1])
    return ids[first], received[first], at[first]


def stream_reprocessing(
    expiries: DataFrame, delays: Sequence[int] = DELAYS, lateness: str = "0 seconds", buckets: int = BUCKETS
) -> DataFrame:
    """Runs as they fall due by event time: each expiry at once, and again after each delay in seconds.

    ``expiries`` has expiry_id and received_at; one that is sent again counts from its first arrival, as
    long as its last run is not over. Output (mode ``append``): ``expiry_id``, ``delay``, ``due_at``. A run is
    due when the watermark, which trails the latest ``received_at`` by ``lateness``, has reached it.
    Expiries share state and timer by the remainder of their id, in a fixed number of ``buckets``. State is
    three numbers for each expiry with runs to come, and none after its last run.
    """
    delays = sorted(delays)
    waits = np.array(delays, np.int64) * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = []
        if state.exists:  # held expiries are past their run at once, if there is one
            ids, received, at = state.get
            parts.append((np.array(ids, np.int64), np.array(received, np.int64), np.array(at, np.int64)))
        if not state.hasTimedOut:
            for b in batches:
                parts.append((b["expiry_id"].to_numpy(np.int64), b["received_us"].to_numpy(np.int64), np.full(len(b), -1, np.int64)))
        ids, received, at = first_arrivals(*[np.concatenate(x) for x in zip(*parts)])
        at = np.maximum(at, 0)
        reached = state.getCurrentWatermarkMs()
        due = received[:, None] + waits
        runs = (due // 1000 <= reached) | (waits == 0)
        # runs go in order, so those that are over stand first
        after = np.maximum(at, runs.sum(axis=1))
        rows, columns = np.nonzero((np.arange(len(waits)) >= at[:, None]) & (np.arange(len(waits)) < after[:, None]))
        left = np.nonzero(after < len(waits))[0]
        if len(left):
            state.update((ids[left].tolist(), received[left].tolist(), after[left].tolist()))
            # a timer fires once the watermark is beyond it, so it is set a millisecond before
            following = int(due[left, after[left]].min()) // 1000 - 1
            state.setTimeoutTimestamp(max(following, reached + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"expiry_id": ids[rows], "delay": (waits // 1_000_000)[columns].astype(np.int32), "due_us": due[rows, columns]})

    rows = expiries.select(F.col("expiry_id").cast("long").alias("expiry_id"), F.col("received_at").cast("timestamp").alias("received_at"))
    rows = rows.filter("expiry_id IS NOT NULL AND received_at IS NOT NULL").withWatermark("received_at", lateness)
    rows = rows.withColumns({"received_us": F.unix_micros("received_at"), "bucket": F.pmod("expiry_id", F.lit(buckets))})
    runs = rows.groupBy("bucket").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return runs.select("expiry_id", "delay", F.timestamp_micros("due_us").alias("due_at"))
