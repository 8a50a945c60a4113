"""Streams of job events and of server-sent events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: where a job may go from each state.
MOVES = {"": ("queued",), "queued": ("running", "error"), "running": ("running", "done", "error"), "done": (), "error": ()}


def latest_state(events: DataFrame) -> DataFrame:
    """job_id, status, at, progress of the last event by time; for batches and streams (update mode)."""
    last = F.max_by(F.struct("status", "done", "total"), "ts")
    return events.groupBy("job_id").agg(last.alias("x"), F.max("ts").alias("at")).select(
        "job_id", F.col("x.status").alias("status"), "at", F.coalesce(F.try_divide("x.done", "x.total"), F.lit(0.0)).alias("progress")
    )


def lifecycle(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """job_id, status, steps, refused: each job's state after each batch of a stream, where
    moves that its state doesn't allow are counted and change nothing. A job's state is
    dropped once event time has passed its last event by ``idle``."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, steps, refused = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for to in rows["status"]:
            if to in MOVES[status]:
                status, steps = to, steps + 1
            else:
                refused += 1
        state.update((status, steps, refused))
        last = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "steps": [steps], "refused": [refused]})

    out = "job_id long, status string, steps long, refused long"
    return events.select("job_id", "ts", "status").withWatermark("ts", idle).groupBy("job_id").applyInPandasWithState(
        step, out, "status string, steps long, refused long", "update", GroupStateTimeout.EventTimeTimeout
    )


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; windows close when the watermark passes them."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of runs of events at most ``gap`` apart."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sse_frames(transcripts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, no, event, data of server-sent frames; lines that are neither are skipped, data
    lines of a frame are joined by line breaks, frames without data are dropped."""
    frames = transcripts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n")).alias("no", "frame"))
    lines = F.split("frame", "\n")
    events = F.filter(lines, lambda x: x.startswith("event:"))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", ""))
    out = frames.select(key, "no", F.coalesce(F.trim(F.regexp_replace(F.get(events, F.lit(0)), "^event:", "")), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data"), F.size(data).alias("n"))
    return out.filter("n > 0").drop("n")


def sse_text(events: DataFrame) -> DataFrame:
    """value: one frame per row (event, data), for a text sink."""
    return events.select(F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), F.replace("data", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n")).alias("value"))
