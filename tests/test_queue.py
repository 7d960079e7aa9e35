"""The job queue as a stream: the same jobs however the log is cut into batches, and no state once all is closed."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilth.streaming import jobs, queue

START = datetime(2024, 1, 1)
EVENTS = [
    # (pool, minute, event, job)
    (1, 0, "queued", 10), (1, 1, "queued", 11), (1, 2, "queued", 10), (1, 5, "claimed", None), (1, 6, "claimed", None), (1, 7, "claimed", None), (1, 20, "done", None),
    (1, 30, "queued", 12), (1, 60, "claimed", None), (1, 70, "failed", None), (1, 80, "queued", 11), (1, 90, "queued", 13), (1, 91, "claimed", None),
    (2, 3, "done", None), (2, 4, "claimed", None), (2, 10, "queued", 20), (2, 11, "claimed", None), (2, 56, "done", None),
    (3, 0, "queued", 30), (3, 1, "claimed", None), (3, 47, "done", None),
    (4, 3000, "queued", 40),
]
SCHEMA = "pool long, at timestamp, number long, event string, job long"
WANTED = {
    10: ("DONE", 5, 20, None), 11: ("FAILED", 6, 51, "timed out"), 12: ("FAILED", 60, 70, "worker error"), 13: ("FAILED", 91, 136, "timed out"),
    20: ("DONE", 11, 56, None), 30: ("FAILED", 1, 46, "timed out"), 40: ("QUEUED", None, None, None),
}


def ran(spark, folder, parts):
    rows = [(p, START + timedelta(minutes=m), k, e, j) for k, (p, m, e, j) in enumerate(EVENTS)]
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    before = spark.conf.get(queue.STORE[0], None)
    out = queue.with_lists(lambda s: jobs.to_the_end(s, ["pool", "job"], "change"))(queue.job_rows(stream, "1 minute"))
    assert spark.conf.get(queue.STORE[0], None) == before
    minute = lambda at: None if at is None else int((at - START).total_seconds() // 60)
    return {r.job: (r.status, minute(r.started), minute(r.closed), r.error) for r in out.collect()}


@pytest.mark.parametrize("parts", [1, 4])
def test_jobs_however_the_log_is_cut(spark, tmp_path, parts):
    assert ran(spark, tmp_path / "log", parts) == WANTED


def test_closed_jobs_leave_the_state(spark, tmp_path):
    """Two days on nothing is held but what still waits."""
    rows = [(p, START + timedelta(minutes=m), k, e, j) for k, (p, m, e, j) in enumerate(EVENTS)]
    later = [(4, START + timedelta(days=9, minutes=k), 100 + k, "queued", 41 + k) for k in range(2)]
    for part in (rows, later[:1], later[1:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    start = queue.with_lists(lambda s: s.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).format("noop").start())
    start(queue.job_rows(stream, "1 minute")).awaitTermination()
    held = {}
    for name in ("waiting", "running", "closed"):
        reader = spark.read.format("statestore").option("stateVarName", name)
        held[name] = reader.load(str(tmp_path / "progress")).select(F.col("key.pool").alias("pool")).collect()
    assert {r.pool for r in held["waiting"]} == {4} and held["running"] == [] and held["closed"] == []


class Held:
    """A state in memory that counts the entries that are read or written."""

    def __init__(self):
        self.rows, self.cost = {}, 0

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = {}

    def get(self):
        self.cost += len(self.rows)
        return self.rows[0] if isinstance(self.rows.get(0), tuple) else iter(self.rows.get(0, []))

    def put(self, rows):
        self.cost += len(rows)
        self.rows = {0: list(rows)}

    def update(self, row):
        self.rows = {0: tuple(row)}

    def containsKey(self, key):
        self.cost += 1
        return key in self.rows

    def getValue(self, key):
        self.cost += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.cost += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.cost += 1
        self.rows.pop(key, None)

    def iterator(self):
        self.cost += len(self.rows)
        return iter(list(self.rows.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def state(self, name, *_):
        return self.states.setdefault(name, Held())

    getListState = getMapState = getValueState = state

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_batch_costs_its_events_not_the_state():
    """2000 jobs run over a week and time out, 1000 wait: what is read and written keeps to the number of events."""
    rows = []
    for k in range(2000):
        rows += [(START + timedelta(minutes=5 * k), 2 * k, "queued", k), (START + timedelta(minutes=5 * k, seconds=1), 2 * k + 1, "claimed", None)]
    rows += [(START + timedelta(minutes=10000, seconds=k), 9000 + k, "queued", 9000 + k) for k in range(1000)]
    q, handle = queue.Queue(timedelta(minutes=1)), Handle()
    q.init(handle)
    out = pd.concat(q.handleInputRows((1,), [pd.DataFrame(rows, columns=["at", "number", "event", "job"])], None))
    for mark in (START + timedelta(minutes=10016), START + timedelta(days=30)):
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda self, at=mark: queue._ms(at)})()
        while due := sorted(t for t in handle.timers if t <= queue._ms(mark)):
            handle.timers.discard(due[0])
            out = pd.concat([out, *q.handleExpiredTimer((1,), now, type("Due", (), {"getExpiryTimeInMs": lambda self, at=due[0]: at})())])
    last = out.groupby("job").last()
    assert last.status.value_counts().to_dict() == {"FAILED": 2000, "QUEUED": 1000} and last.error.eq("timed out").sum() == 2000
    assert not handle.states["running"].rows and not handle.states["closed"].rows and len(handle.states["waiting"].rows) == 1000
    assert sum(s.cost for s in handle.states.values()) < 6 * len(rows)
