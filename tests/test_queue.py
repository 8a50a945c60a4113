"""The queue of jobs against a plain loop, and restarted from its checkpoint."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from strataspan.streaming import queue

SCHEMA = "queue string, job_id long, ts timestamp, task string, args string, extra int"


def add(job):
    return {"sum": job["args"]["a"] + job["args"].get("b", 0)}


def flaky(job):
    if job["attempt"] < job["args"]["good"]:
        raise RuntimeError(f"try {job['attempt']}")
    return {"attempt": job["attempt"]}


EXECUTORS = {"add": add, "flaky": flaky}
T0 = datetime(2024, 1, 1)


def rows(first: int, n: int) -> list[tuple]:
    """Jobs a second apart in three queues: sums, jobs that fail once or always, unknown tasks, broken arguments."""
    out = []
    for i in range(first, first + n):
        task, args = [("add", {"a": i, "b": 1}), ("flaky", {"good": 2}), ("flaky", {"good": 9}), ("other", {}), ("add", {"a": None})][i % 5]
        out.append((["x", "y", None][i % 3], i, T0 + timedelta(seconds=i), task, json.dumps(args), 0))
    return out


def plain(jobs: list[tuple], tries: int) -> dict:
    """What becomes of each job if all timers fire."""
    out, counts = {}, {}
    for q, job_id, _, task, args, _ in jobs:
        q = q or ""
        no = counts.setdefault(q, 0)
        counts[q] += 1
        if task not in EXECUTORS:
            out[job_id] = (q, no, "error", 1, None)
            continue
        for attempt in range(1, tries + 1):
            try:
                done = EXECUTORS[task]({"args": json.loads(args), "attempt": attempt})
                out[job_id] = (q, no, "done", attempt, json.dumps(done))
                break
            except Exception:
                out[job_id] = (q, no, "error", attempt, None)
    return out


def submit(spark, folder, jobs):
    frame = spark.createDataFrame(jobs, SCHEMA).coalesce(1)
    frame.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).parquet(str(folder))


# a job that moves event time past all timers
LAST = ("z", 9999, T0 + timedelta(days=3), "add", '{"a": 1}', 0)


def test_restarted(spark, tmp_path):
    """Stopped and started again, the jobs' rows are those of a plain loop."""
    first, second = rows(0, 40), rows(40, 25)
    folder = str(tmp_path / "out")
    for part in (first, second, [LAST], [("z", 10000, T0 + timedelta(days=6), "add", '{"a": 1}', 0)]):
        got = queue.drain(queue.run_jobs(submit(spark, tmp_path / "in", part), EXECUTORS, delay="10 seconds"), "q", folder)
    got = {r.job_id: (r.queue, r.no, r.status, r.attempt, r.result) for r in queue.final(got).collect() if r.job_id < 9999}
    want = plain(first + second, 3)
    assert got == want
    assert {v[2] for v in want.values()} == {"done", "error"}


def test_expired(spark, tmp_path):
    """A job whose next try comes after its patience is given up, with the tries it had."""
    for part in ([("x", 1, T0, "flaky", '{"good": 2}', 0)], [LAST]):
        out = queue.drain(queue.run_jobs(submit(spark, tmp_path / "in", part), EXECUTORS, delay="1 hour", patience="1 minute"), "q", str(tmp_path / "out"))
    r = queue.final(out).filter("job_id = 1").first()
    assert (r.status, r.attempt, r.error) == ("error", 1, "expired")


@pytest.mark.parametrize("jobs", [[], [(None, None, T0, "add", "{}", 0), ("x", 5, None, "add", "{}", 0)], [("x", 5, T0, None, None, 0)]])
def test_odd_rows(spark, tmp_path, jobs):
    """No rows, rows that are no jobs, and a job without a task."""
    out = queue.drain(queue.run_jobs(submit(spark, tmp_path / "in", jobs), EXECUTORS), "q", str(tmp_path / "out"))
    assert [(r.job_id, r.status) for r in out.collect()] == [(5, "error")] * sum(j[1] is not None and j[2] is not None for j in jobs)
