"""Workers as streams of their own: leases on batches of items, and the loop of runs with pauses, back-off and blocking.

Two machines go through the events of one key in the order of time, then seq. Leases goes by worker: its open items and when
they end. Pool goes by pool: the state of each worker and the cooldown that all share. What time alone brings (a lease that ends, a wait
that is over) is told by a row of its own at its own time, without a further event: in a stream by timers of transformWithState, in a batch
by the time that the events have reached. Both give the same rows. `at` is in seconds since the epoch; a stream's timers and
watermark count whole milliseconds, so a moment is due when the millisecond at or after it is reached.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.leasing import LEASE_SECONDS, MOST_ITEMS

RETRY_FIRST, RETRY_MOST = 30, 300
EMPTY_RUNS, EMPTY_WAIT = 3, 10

LEASE_EVENTS = "worker STRING, seq BIGINT, at DOUBLE, action STRING, items ARRAY<STRING>"
LEASE_ROWS = "worker STRING, seq BIGINT, at DOUBLE, action STRING, outcome STRING, items STRING, n_open INT, expires DOUBLE"
POOL_EVENTS = "pool STRING, worker STRING, seq BIGINT, at DOUBLE, action STRING, accepted INT"
POOL_ROWS = "pool STRING, worker STRING, seq BIGINT, at DOUBLE, state STRING, failures INT, streak INT, until DOUBLE"
#: Seconds that a stream adds to all times, as it takes nothing at or before its first watermark, which is the epoch.
SHIFT = 86_400
#: Rows that a batch's task gathers before it gives them on; ties make several of one event.
ROWS_AT_ONCE = 20_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def millis(at: float) -> int:
    """The first whole millisecond at or after a time."""
    return math.ceil(round(at * 1e6) / 1000)


class Leases:
    """The open items of one worker and the time at which all of them end.

    claim: the items offered are leased, `granted`, if the worker has none open; else its own stay and get a new end, `kept`. Offers of
    no items or of more than MOST_ITEMS are `rejected`. submit: all items must be open, else `rejected`; they leave, and the others get a
    new end. release: all leave. Anything else is `ignored`. A row's items are those that it grants, keeps or frees, sorted.
    """

    keys = ("worker",)
    rows = LEASE_ROWS

    def __init__(self, seconds: float = LEASE_SECONDS):
        self.seconds, self.open, self.expires = seconds, set(), None

    def saved(self) -> tuple[list[tuple[str]], tuple | None]:
        return [(i,) for i in sorted(self.open)], None if self.expires is None else (self.expires,)

    def load(self, items: list[tuple], rest: tuple | None) -> None:
        self.open, self.expires = {i for (i,) in items}, rest and rest[0]

    def next_due(self) -> float | None:
        return self.expires

    def _row(self, seq, at, action, outcome, items) -> tuple:
        return seq, at, action, outcome, ",".join(sorted(items)), len(self.open), self.expires

    def due(self, reached: int) -> Iterator[tuple]:
        """Rows of what has ended by a millisecond."""
        if self.expires is not None and millis(self.expires) <= reached:
            at, freed = self.expires, self.open
            self.open, self.expires = set(), None
            yield self._row(None, at, "expire", "expired", freed)

    def step(self, event) -> Iterator[tuple]:
        seq, at, action, items = event["seq"], event["at"], event["action"], list(event["items"] if event["items"] is not None else [])
        if self.expires is not None and self.expires <= at:
            yield from self.due(millis(self.expires))
        if action == "claim" and self.open:
            self.expires = at + self.seconds
            yield self._row(seq, at, action, "kept", self.open)
        elif action == "claim" and 1 <= len(set(items)) <= MOST_ITEMS:
            self.open, self.expires = set(items), at + self.seconds
            yield self._row(seq, at, action, "granted", items)
        elif action == "submit" and items and len(set(items)) == len(items) and self.open.issuperset(items):
            self.open = self.open.difference(items)
            self.expires = at + self.seconds if self.open else None
            yield self._row(seq, at, action, "accepted", items)
        elif action == "release":
            freed, self.open, self.expires = self.open, set(), None
            yield self._row(seq, at, action, "released", freed)
        else:
            yield self._row(seq, at, action, "rejected" if action in ("claim", "submit") else "ignored", [])


def retry_delay(streak: int) -> int:
    """Seconds of the cooldown after so many runs in a row that met a rate limit: doubling, up to RETRY_MOST."""
    return min(RETRY_MOST, RETRY_FIRST * 2 ** min(max(streak - 1, 0), 4))


class Pool:
    """The workers of one pool: their states and empty runs in a row, and the cooldown that a rate limit brings for all.

    start: `paused`, `global_cooldown`, `waiting` (after an empty run) or `running`. finish: `batch_finished`; without accepted items
    the worker waits EMPTY_WAIT seconds, and after EMPTY_RUNS such runs in a row it is `blocked`. A finish after the cooldown ends the streak.
    limited: `rate_limited`; the streak and the cooldown grow, empty runs do not count. drained: the worker is `complete`.
    pause and resume hold for the pool; stop cancels every worker that is not done, and what the pool remembers goes. Events of a blocked or
    complete worker give its state once more and change nothing. Waits that end give `ready`, the end of a cooldown `cooldown_over`.
    A further finish ends a wait after its own moment: what the worker starts or finishes at that same moment still falls into the wait, and
    is told once for each wait that it falls into, a start with the end of that wait.
    """

    keys = ("pool",)
    rows = POOL_ROWS
    DONE = ("blocked", "complete")

    def __init__(self):
        self.workers: dict[str, list] = {}  # state, failures, end of the wait, moment of the last finish, ends of waits that it met
        self.paused, self.streak, self.cooldown, self.told = False, 0, 0.0, True
        self.ends: list[tuple[float, str]] = []  # a heap of what may end, the cooldown with no name; what has changed since is passed over

    def saved(self) -> tuple[list[tuple], tuple | None]:
        rest = (self.paused, self.streak, self.cooldown, self.told)
        return [(w, *x) for w, x in sorted(self.workers.items())], None if rest == (False, 0, 0.0, True) and not self.workers else rest

    def load(self, workers: list[tuple], rest: tuple | None) -> None:
        self.workers = {w: list(x) for w, *x in workers}
        if rest:
            self.paused, self.streak, self.cooldown, self.told = rest
        self.ends = [(x[2], w) for w, x in self.workers.items() if x[2] is not None] + ([] if self.told else [(self.cooldown, "")])
        heapify(self.ends)

    def next_due(self) -> float | None:
        while self.ends:
            at, w = self.ends[0]
            if (self.workers[w][2] == at) if w else (not self.told and self.cooldown == at):
                return at
            heappop(self.ends)
        return None

    def due(self, reached: int, before: float = math.inf) -> Iterator[tuple]:
        """Rows of what has ended by a millisecond, or in it by the time of an event that stands in the same one."""
        while (at := self.next_due()) is not None and millis(at) <= reached and at <= before:
            _, w = heappop(self.ends)
            if w:
                self.workers[w][2] = None
                yield w, None, at, "ready", self.workers[w][1], self.streak, None
            else:
                self.told = True
                yield None, None, at, "cooldown_over", None, self.streak, None

    def _over(self, at: float) -> Iterator[tuple]:
        while (end := self.next_due()) is not None and end <= at:
            yield from self.due(millis(end), at)

    def step(self, event) -> Iterator[tuple]:
        w, seq, at, action = event["worker"], event["seq"], event["at"], event["action"]
        yield from self._over(at)
        if action in ("pause", "resume"):
            self.paused = action == "pause"
            yield w, seq, at, "paused" if self.paused else "resumed", None, self.streak, None
        elif action == "stop":
            for name, x in sorted(self.workers.items()):
                if x[0] not in self.DONE:
                    yield name, seq, at, "cancelled", x[1], self.streak, None
            self.__init__()
            yield None, seq, at, "stopped", None, 0, None
        elif w is None:
            yield w, seq, at, "ignored", None, self.streak, None
        else:
            x = self.workers.setdefault(w, ["idle", 0, None, None, []])
            until, waits = x[2], []
            if x[0] in self.DONE:
                pass
            elif action == "start":
                waits = self._waits(x, at)
                if self.paused:
                    x[0], until = "paused", None
                elif self.cooldown > at:
                    x[0], until = "global_cooldown", self.cooldown
                else:
                    x[0] = "waiting" if waits else "running"
            elif action == "limited":
                self.streak += 1
                self.cooldown, self.told = max(self.cooldown, at + retry_delay(self.streak)), False
                heappush(self.ends, (self.cooldown, ""))
                x[0], until = "rate_limited", self.cooldown
            elif action == "finish":
                waits = self._waits(x, at)
                if at >= self.cooldown:
                    self.streak = 0
                x[1] = 0 if (event["accepted"] or 0) > 0 else x[1] + 1
                x[0] = "blocked" if x[1] >= EMPTY_RUNS else "batch_finished"
                x[2] = until = at + EMPTY_WAIT if 0 < x[1] < EMPTY_RUNS else None
                x[3], x[4] = at, [] if x[0] in self.DONE else waits
                if until is not None:
                    heappush(self.ends, (until, w))
            elif action == "drained":
                x[0], x[2], x[4], until = "complete", None, [], None
            for end in waits or [until]:
                yield w, seq, at, x[0], x[1], self.streak, end if x[0] == "waiting" else until

    @staticmethod
    def _waits(x: list, at: float) -> list[float]:
        """The ends of the waits that a worker is in."""
        return [*(x[4] if x[3] == at else []), *([] if x[2] is None else [x[2]])]


class _Processor(StatefulProcessor):
    """A machine whose state is kept in two places: a map by item or worker, and one value; one timer is set for what comes next."""

    def __init__(self, machine: Callable, items: str, rest: str):
        self.machine, self.items, self.rest = machine, items, rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.map = handle.getMapState("items", "name STRING", self.items)
        self.value = handle.getValueState("rest", self.rest)

    def _loaded(self):
        m = self.machine()
        self.before = {k[0]: tuple(v) for k, v in self.map.iterator()}
        m.load([(k, *v) if v != (True,) else (k,) for k, v in self.before.items()], tuple(self.value.get()) if self.value.exists() else None)
        return m

    def _kept(self, m) -> None:
        """Only what has changed is written; what is over leaves the state."""
        items, rest = m.saved()
        after = {k: tuple(v) or (True,) for k, *v in items}
        for k in self.before.keys() - after.keys():
            self.map.removeKey((k,))
        for k, v in after.items():
            if self.before.get(k) != v:
                self.map.updateValue((k,), v)
        if rest is None:
            self.value.clear()
        else:
            self.value.update(rest)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        end = m.next_due()
        if end is not None:
            self.handle.registerTimer(millis(end) + 1000 * SHIFT)

    def _told(self, key, rows) -> Iterator[Row]:
        names = _names(self.machine().rows)
        for r in rows:
            yield Row(**dict(zip(names, (key[0], *r), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        m = self._loaded()
        out = [r for event in sorted(rows, key=lambda e: (e["at"], e["seq"])) for r in m.step(event)]
        self._kept(m)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        m = self._loaded()
        out, reached = [], max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - 1000 * SHIFT
        while (end := m.next_due()) is not None and millis(end) <= reached:
            out += m.due(millis(end))
        self._kept(m)
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def _replayed(events: DataFrame, machine: Callable, late: float) -> DataFrame:
    """The rows of a batch: partitions sorted by key and time go through one machine after another."""
    key, rows = machine().keys[0], machine().rows
    last = events.agg(F.max("at")).first()[0]
    reached = math.floor((round((last or 0.0) * 1e6) - round(late * 1e6)) / 1000)
    names = _names(rows)

    def run(batches) -> Iterator[pd.DataFrame]:
        m, now = None, None

        def end():
            while m is not None and (at := m.next_due()) is not None and millis(at) <= reached:
                yield from ((now, *r) for r in m.due(millis(at)))

        for batch in batches:
            out = []
            for event in batch.to_pylist():
                if m is None or event[key] != now:
                    out += end()
                    m, now = machine(), event[key]
                out += [(now, *r) for r in m.step(event)]
                if len(out) >= ROWS_AT_ONCE:
                    yield _table(out, names, rows)
                    out = []
            yield _table(out, names, rows)
        yield _table(list(end()), names, rows)

    ordered = events.where(F.col(key).isNotNull() & F.col("at").isNotNull()).repartition(key).sortWithinPartitions(key, "at", "seq")
    return ordered.mapInArrow(run, rows)


_KINDS = {"STRING": pa.string(), "BIGINT": pa.int64(), "DOUBLE": pa.float64(), "INT": pa.int32()}


def _table(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [_KINDS[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def run(events: DataFrame, machine: Callable, late: float, items: str, rest: str) -> DataFrame:
    if not events.isStreaming:
        return _replayed(events, machine, late)
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    key = machine().keys[0]
    # the watermark takes the millisecond below an event's time
    timed = events.where(F.col(key).isNotNull() & F.col("at").isNotNull()).withColumn("_time", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("bigint") + 1_000_000 * SHIFT))
    timed = timed.withWatermark("_time", f"{round(late * 1000)} milliseconds")
    return timed.groupBy(key).transformWithState(_Processor(machine, items, rest), machine().rows, "append", "eventTime")


def worker_leases(events: DataFrame, seconds: float = LEASE_SECONDS, late: float = 60.0) -> DataFrame:
    """The outcome of every lease event (LEASE_EVENTS) and a row for each lease that ends; see Leases.

    Works on a batch or a stream. Events may come up to `late` seconds out of order; ends are told once the events have got that far beyond
    them. Rows without a worker or a time are left out. One worker's events are taken by one task, in bounded memory.
    """
    return run(events, lambda: Leases(seconds), late, "open BOOLEAN", "expires DOUBLE")


def worker_pools(events: DataFrame, late: float = 60.0) -> DataFrame:
    """The state of a worker after every event (POOL_EVENTS), and rows for waits and cooldowns that are over; see Pool."""
    return run(events, Pool, late, "state STRING, failures INT, until DOUBLE, finished DOUBLE, met ARRAY<DOUBLE>", "paused BOOLEAN, streak INT, cooldown DOUBLE, told BOOLEAN")
