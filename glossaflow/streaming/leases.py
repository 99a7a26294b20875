"""Leases as a stream: each item's events go through its state, and every event comes out accepted or with a reason.

events (item, seq, at, worker, action, target): actions are claim, submit, release and renew; at is in seconds. A lease that ends
at or before an event's time no longer holds. Events of one item are taken in the order of at, then seq, within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.leasing import LEASE_SECONDS

OUTPUT = "item STRING, seq BIGINT, at DOUBLE, worker STRING, action STRING, outcome STRING, expires DOUBLE, target STRING"
STATE = "worker STRING, expires DOUBLE, target STRING"


def _step(state: tuple, event) -> tuple[tuple, str]:
    """The next state (worker, expires, target) and the outcome of one event."""
    worker, expires, target = state
    if worker is not None and target is None and expires <= event.at:
        worker, expires = None, 0.0
    now = (worker, expires, target)
    if target is not None:
        return now, "translated"
    if event.action == "claim":
        if worker not in (None, event.worker):
            return now, "taken"
        return (event.worker, event.at + LEASE_SECONDS, None), "accepted"
    if worker != event.worker:
        return now, "not leased"
    if event.action == "release":
        return (None, 0.0, None), "accepted"
    if event.action == "renew":
        return (worker, event.at + LEASE_SECONDS, None), "accepted"
    if event.action == "submit":
        if not isinstance(event.target, str) or not event.target.strip():
            return now, "empty"
        if "\0" in event.target:
            return now, "nul"
        return (worker, expires, event.target), "accepted"
    return now, "unknown action"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current = state.get if state.exists else (None, 0.0, None)
    rows = []
    for event in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples():
        current, outcome = _step(current, event)
        rows.append((key[0], event.seq, event.at, event.worker, event.action, outcome, current[1], current[2]))
    if current[0] is None and current[2] is None:
        if state.exists:
            state.remove()  # a free item is as good as one that was never seen
    else:
        state.update(current)
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def lease_stream(events: DataFrame) -> DataFrame:
    """The outcome of every event of a stream (or, for a batch, of all its events at once)."""
    if events.isStreaming:
        return events.groupBy("item").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        current, rows = (None, 0.0, None), []
        for event in pdf.sort_values(["at", "seq"]).itertuples():
            current, outcome = _step(current, event)
            rows.append((key[0], event.seq, event.at, event.worker, event.action, outcome, current[1], current[2]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("item").applyInPandas(whole, OUTPUT)
