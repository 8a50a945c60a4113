"""Queries that run streams over given tables to their end, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from ..streaming import queue


def _half(job: dict) -> dict:
    return {"id": job["args"]["id"], "half": job["args"]["value"] / 2}


def _second_try(job: dict) -> dict:
    if job["attempt"] < 2:
        raise ConnectionError("not yet")
    return {"id": job["args"]["id"]}


def y1_job_queue(spark, d):
    """Events as jobs, a queue for each user: views are halved, purchases succeed at their
    second try a minute of event time later, other kinds have no executor."""
    events = load(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")  # a file or a folder
    args = F.to_json(F.struct(F.col("event_id").alias("id"), F.coalesce("value", F.lit(0.0)).alias("value")))
    jobs = stream.select(F.col("user_id").cast("string").alias("queue"), F.col("event_id").alias("job_id"), "ts", F.col("event_type").alias("task"), args.alias("args"))
    rows = queue.drain(queue.run_jobs(jobs, {"view": _half, "purchase": _second_try}), "jobs")
    return queue.final(rows).select("job_id", "status", "attempt", F.round(F.get_json_object("result", "$.half").cast("double"), 6).alias("half"))


QUERIES = {
    "y1_job_queue": (y1_job_queue, """SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'done' WHEN 'purchase' THEN CASE WHEN again THEN 'done' ELSE 'queued' END ELSE 'error' END AS status,
  (CASE WHEN event_type = 'purchase' AND again THEN 2 ELSE 1 END)::INT AS attempt, CASE event_type WHEN 'view' THEN round(coalesce(value, 0) / 2, 6) END AS half
FROM (SELECT *, date_trunc('millisecond', ts) + INTERVAL 1 MINUTE <= (SELECT max(date_trunc('millisecond', ts)) FROM events) AS again FROM events)"""),
}
