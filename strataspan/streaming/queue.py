"""A queue of jobs on Spark's arbitrary state: one worker per queue, first in, first out."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import shared_folder

Executor = Callable[[dict], dict]

# What a submission has, what a waiting job keeps, what comes out.
SUBMITTED = ["queue", "job_id", "ts", "task", "args"]
WAITING = "no long, job_id long, submitted long, task string, args string, attempt int, due long"
OUT = "queue string, job_id long, no long, status string, attempt int, result string, error string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Worker(StatefulProcessor):
    """Runs the jobs of its queue in the order in which they came, one after the other.

    A failed job is tried again ``delay`` ms of event time later, in its old place before later
    ones that are due, until it has been tried ``tries`` times. A job that is still waiting
    ``patience`` ms after its submission is given up as expired. State holds waiting jobs only.
    A queue has one timer for the jobs of a batch, the earliest; when it fires, all tries up to
    the watermark are made in the order of their times, so a batch reads and writes the waiting
    jobs of a queue once, however many there are."""

    def __init__(self, executors: dict[str, Executor], tries: int, delay: int, patience: int) -> None:
        self.executors, self.tries, self.delay, self.patience = executors, tries, delay, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.waiting = handle.getListState("waiting", WAITING)

    def _run(self, no: int, job: tuple, queue: str) -> tuple:
        """The row that tells what became of a job."""
        job_id, _, task, args, attempt, _ = job
        head = queue, job_id, no
        if task not in self.executors:
            return *head, "error", attempt, None, f"no executor for {task}"
        try:
            result = self.executors[task]({"job_id": job_id, "task": task, "args": json.loads(args or "{}"), "attempt": attempt})
            return *head, "done", attempt, json.dumps(result, ensure_ascii=False), None
        except Exception as e:  # what went wrong is the job's answer
            return *head, "queued" if attempt < self.tries else "error", attempt, None, f"{type(e).__name__}: {e}"

    def _next(self, no: int, job: tuple, now: int) -> tuple:
        """A job that waits for its next try."""
        return (no, *job[:4], job[4] + 1, max(job[1], now) + self.delay)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, now = self.count.get()[0] if self.count.exists() else 0, timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            out, kept = [], []
            for r in frame.sort_values(["ts", "job_id"], kind="stable").itertuples():
                job = (int(r.job_id), r.ts.value // 10**6, r.task, r.args, 1, 0)
                row = self._run(n, job, key[0])
                if row[3] == "queued":
                    kept.append(self._next(n, job, now))
                out.append(row)
                n += 1
            if kept:
                self.waiting.appendList(kept)
                first = min([first or kept[0][6], *(j[6] for j in kept)])
            yield _frame(out)
        self.count.update((n,))
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, later = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), [], []
        due = []  # (time, number, job) of the tries to make
        for no, *job in map(tuple, self.waiting.get()) if self.waiting.exists() else ():
            due.append((job[5], no, tuple(job))) if job[5] <= now else later.append((no, *job))
        if not due:  # another batch's timer made these tries
            return
        heapq.heapify(due)
        while due:
            at, no, job = heapq.heappop(due)
            if at > job[1] + self.patience:
                out.append((key[0], job[0], no, "error", job[4] - 1, None, "expired"))
                continue
            row = self._run(no, job, key[0])
            if row[3] == "queued":
                again = self._next(no, job, at)
                heapq.heappush(due, (again[6], no, again[1:])) if again[6] <= now else later.append(again)
            out.append(row)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(j[6] for j in later))
        else:
            self.waiting.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in OUT.split(", ")]
    return pd.DataFrame(rows, columns=names)


def run_jobs(submitted: DataFrame, executors: dict[str, Executor], tries: int = 3, delay: str = "1 minute", patience: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """queue, job_id, no, status, attempt, result, error: a row for every try of every job.

    ``submitted`` is a stream of queue, job_id, ts, task and args (a JSON object); columns
    besides are left out. ``executors`` map a task to a function of a job (job_id, task, args,
    attempt) whose dictionary is the result; they run in the tasks. A job whose task has no
    executor ends as an error at once. Rows without a queue belong to
    the queue ''; rows without an id or a time are no jobs and are left out; a job that is
    submitted twice runs twice. ``no`` counts a queue's jobs from 0 in order of arrival; those
    of one Arrow batch are taken by time and id.

    Queues are spread over tasks by key. One queue is one worker and so one task at a time,
    which is what its order means; it holds a batch of rows and the jobs that wait for another
    try, never the whole queue. The session needs ``STORE`` as its state store."""
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    jobs = submitted.select(F.coalesce("queue", F.lit("")).alias("queue"), "job_id", F.col("ts").cast("timestamp").alias("ts"), "task", "args").dropna(subset=["job_id", "ts"])
    worker = Worker(executors, tries, ms(delay), ms(patience))
    return jobs.withWatermark("ts", late).groupBy("queue").transformWithStateInPandas(worker, outputStructType=OUT, outputMode="append", timeMode="EventTime")


def drain(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a queue's stream over what there is and read what it wrote; with the same folder a
    later call goes on where this one stopped."""
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/{name}-{pd.Timestamp.now().value}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def final(rows: DataFrame) -> DataFrame:
    """The last row of every job."""
    last = F.max_by(F.struct("status", "attempt", "result", "error"), "attempt")
    return rows.groupBy("queue", "no", "job_id").agg(last.alias("x")).select("queue", "no", "job_id", "x.*")
