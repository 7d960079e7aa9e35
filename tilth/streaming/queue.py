"""A job queue as keyed state: jobs wait in order, workers claim the oldest, and what runs too long fails.

A pool's events come in order of time within a batch. State is the line of waiting jobs, by their places in it, the list of
running ones, and for a day the numbers of closed ones, so that a job handed in again within a day is not run again. A batch
keeps what it adds in memory and writes what is left of it at its end, so it costs no more than its events and what it takes
from the state. One event-time timer fails all running jobs whose time is up; one an hour forgets closed ones, so a pool
without open jobs leaves no state. A pool is one key by nature, since claims are in order; pools are independent.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMEOUT, KEEP, HOUR = timedelta(minutes=45), timedelta(days=1), 3_600_000
#: Rows that are handed on at once.
TOGETHER = 100_000
JOB = "job long, created timestamp, started timestamp"
ROW = "pool long, job long, status string, created timestamp, started timestamp, closed timestamp, error string, change long"
#: The state store that keeps lists and timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EPOCH = datetime(1970, 1, 1)


def _ms(at: datetime) -> int:
    return (at - EPOCH) // timedelta(milliseconds=1)


class Queue(StatefulProcessor):
    """Events (pool, at, event, job): queued puts a job in line, claimed starts the oldest in line, done and failed close
    the one that has run longest; a row for every change of a job."""

    def __init__(self, late: timedelta) -> None:
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "place long", "job long, created timestamp")
        self.places = handle.getMapState("places", "job long", "place long")
        self.running = handle.getListState("running", JOB)
        self.closed = handle.getMapState("closed", "job long", "closed timestamp")
        self.counts = handle.getValueState("counts", "changes long, head long, tail long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "number"])
        yield from self._through(key[0], zip(pd.DatetimeIndex(events["at"]).to_pydatetime(), events["event"], events["job"]), events["at"].iloc[-1].to_pydatetime() - self.late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = EPOCH + timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())
        if expiredTimerInfo.getExpiryTimeInMs() % HOUR == 0 and self.closed.exists():
            for (job,) in [k for k, (closed,) in self.closed.iterator() if closed + KEEP <= now]:
                self.closed.removeKey((job,))
        yield from self._through(key[0], [(now, "time", None)], now)

    def _through(self, pool: int, events, seen: datetime) -> Iterator[pd.DataFrame]:
        """The pool's events in order. `seen`: later batches hold no event up to it."""
        running = deque(tuple(x) for x in self.running.get()) if self.running.exists() else deque()
        had, changed = bool(running), False
        # a job is known by its number in the order of its own changes
        n, head, tail = self.counts.get() if self.counts.exists() else (0, 0, 0)
        line: deque[tuple] = deque()  # places from `tail` on, not yet in the state
        opened, shut = {j for j, *_ in running}, {}
        held_line, held_closed, before = head < tail, self.closed.exists(), (n, head, tail)
        out: list[tuple] = []

        def told(job: tuple, status: str, closed: datetime | None = None, error: str | None = None) -> None:
            nonlocal n
            n += 1
            out.append((pool, job[0], status, job[1], job[2], closed, error, n))
            if closed is not None:
                opened.discard(job[0])
                shut[job[0]] = closed

        def known(job: int, at: datetime) -> bool:
            if job in opened or (held_line and self.places.containsKey((job,))):
                return True
            closed = shut.get(job) or ((self.closed.getValue((job,)) or (None,))[0] if held_closed else None)
            return closed is not None and closed + KEEP > at

        def table() -> pd.DataFrame:
            return pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

        for at, event, job in events:
            while running and running[0][2] + TIMEOUT < at:
                late = running.popleft()
                changed = True
                told(late, "FAILED", late[2] + TIMEOUT, "timed out")
            if event == "queued" and not known(int(job), at):
                opened.add(int(job))
                line.append((int(job), at, None))
                told(line[-1], "QUEUED")
            elif event == "claimed" and (head < tail or line):
                if head < tail:
                    job, created = self.waiting.getValue((head,))
                    self.waiting.removeKey((head,))
                    self.places.removeKey((job,))
                    opened.add(job)
                    head += 1
                else:
                    job, created, _ = line.popleft()
                running.append((job, created, at))
                changed = True
                told(running[-1], "RUNNING")
            elif event in ("done", "failed") and running:
                changed = True
                told(running.popleft(), event.upper(), at, "worker error" if event == "failed" else None)
            if len(out) >= TOGETHER:
                yield table()
                out.clear()
        for job, created, _ in line:
            self.waiting.updateValue((tail,), (job, created))
            self.places.updateValue((job,), (tail,))
            tail += 1
        if changed and running:
            self.running.put(list(running))
        elif changed and had:
            self.running.clear()
        if running:
            self.handle.registerTimer(_ms(running[0][2] + TIMEOUT) + 1)
        hours = set()
        for job, closed in shut.items():
            if closed + KEEP > seen:
                self.closed.updateValue((job,), (closed,))
                hours.add(-(-(_ms(closed + KEEP) + 1) // HOUR) * HOUR)
            elif held_closed and self.closed.containsKey((job,)):
                self.closed.removeKey((job,))
        for hour in hours:
            self.handle.registerTimer(hour)
        # the count goes when nothing is left that it could be compared with
        if head < tail or running or self.closed.exists():
            if (n, head, tail) != before:
                self.counts.update((n, head, tail))
        elif self.counts.exists():
            self.counts.clear()
        if out:
            yield table()


def job_rows(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A row a change of a job. events: a stream of pool, at, number (order among equal times), event and job."""
    timed = events.withWatermark("at", late)
    return timed.groupBy("pool").transformWithStateInPandas(Queue(pd.Timedelta(late).to_pytimedelta()), ROW, "Update", "EventTime")


def with_lists(start):
    """start(), a function that begins a stream, with the state store that lists and timers need; the session's own is put
    back once the stream has it."""

    def begin(stream: DataFrame, *args, **kwargs):
        conf = stream.sparkSession.conf
        before = conf.get(STORE[0], None)
        conf.set(*STORE)
        try:
            return start(stream, *args, **kwargs)
        finally:
            conf.set(STORE[0], before) if before is not None else conf.unset(STORE[0])

    return begin
