"""A queue's waiting jobs are read once a batch and have one timer, however many they are."""

from __future__ import annotations

import pandas as pd

from strataspan.streaming.queue import Worker


class Held:
    """A value or a list of state that counts its reads and writes."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return self.rows[0] if self.rows and len(self.rows[0]) == 1 else iter(list(self.rows))

    def update(self, row):
        self.rows = [row]

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):  # noqa: N802
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def clear(self):
        self.rows = []


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def never(job):
    if job["args"]["id"] % 2 or job["attempt"] < 2:
        raise ValueError("no")
    return {"id": job["args"]["id"]}


def test_one_timer():
    worker, timers = Worker({"t": never}, 3, 1000, 10**9), []
    worker.handle = type("Handle", (), {"registerTimer": lambda _, at: timers.append(at)})()
    worker.count, worker.waiting = Held(), Held()
    n = 200
    jobs = pd.DataFrame({"job_id": range(n), "ts": pd.to_datetime([i * 10 for i in range(n)], unit="ms"), "task": "t", "args": [f'{{"id": {i}}}' for i in range(n)]})
    first = pd.concat(worker.handleInputRows(("q",), iter([jobs]), Clock(0)))
    assert set(first.status) == {"queued"} and timers == [1000] and worker.waiting.calls == 1
    half = pd.concat(worker.handleExpiredTimer(("q",), Clock(2000), Clock(1000)))
    assert list(half.no[:100]) == list(range(100)) and timers[-1] == min(j[6] for j in worker.waiting.rows) > 2000
    rest = pd.concat(worker.handleExpiredTimer(("q",), Clock(10**6), Clock(timers[-1])))
    last = pd.concat([half, rest]).sort_values("attempt", kind="stable").groupby("no").last()
    assert list(last.status) == ["error" if i % 2 else "done" for i in range(n)] and list(last.attempt) == [3 if i % 2 else 2 for i in range(n)]
    assert not worker.waiting.exists() and worker.waiting.calls <= 5 and len(timers) == 2
    assert list(worker.handleExpiredTimer(("q",), Clock(10**6), Clock(10**6))) == []
