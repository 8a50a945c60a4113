"""List ranking: the order of linked rows, in a logarithmic number of joins.

Rows that name their successor form rings. Each round a row looks twice as far ahead, so a
ring of n rows is ordered after log2(n) rounds, and no task holds a ring. Rows whose chain
ends somewhere are in no ring and fall out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise


def rank_rings(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, ring, pos for links (keys, id, next), in which no two rows of a key have the
    same id or the same next: ring is the smallest id of the row's ring, where pos is 0."""
    links = materialise(links.select(*keys, "id", "next"), "rank-links")
    now = materialise(links.select(*keys, "id", F.col("next").alias("jump"), F.least("id", "next").alias("ring")), "rank-least")
    while True:
        ahead = now.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("further"), F.col("ring").alias("other"))
        met = now.join(ahead, [*keys, "jump"])
        new = materialise(met.select(*keys, "id", F.col("further").alias("jump"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved")), "rank-least")
        # Chains with an end lose rows until none is left of them.
        done = new.filter("moved").isEmpty() and new.count() == now.count()
        discard(now)
        now = new
        if done:
            break
    start = F.col("id") == F.col("ring")
    steps = links.join(now.select(*keys, "id", "ring"), [*keys, "id"])
    steps = materialise(steps.select(*keys, "id", "ring", F.when(start, F.col("id")).otherwise(F.col("next")).alias("to"), F.when(start, 0).otherwise(1).cast("long").alias("left")), "rank-steps")
    discard(links, now)
    while not steps.filter("to <> ring").isEmpty():
        ahead = steps.select(*keys, F.col("id").alias("to"), F.col("to").alias("further"), F.col("left").alias("more"))
        new = materialise(steps.join(ahead, [*keys, "to"]).select(*keys, "id", "ring", F.col("further").alias("to"), (F.col("left") + F.col("more")).alias("left")), "rank-steps")
        discard(steps)
        steps = new
    sizes = steps.groupBy(*keys, "ring").agg((F.max("left") + 1).alias("size"))
    return steps.join(sizes, [*keys, "ring"]).select(*keys, "id", "ring", F.when(F.col("left") == 0, 0).otherwise(F.col("size") - F.col("left")).alias("pos"))


def link_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring, pos, x, y of directed pieces (x1, y1, x2, y2; the inside on the left, each
    once) linked end to end; where several go on from a corner, the first one clockwise from
    where the piece came from, so that rings don't cross."""
    ends = ["x1", "y1", "x2", "y2"]
    rows = materialise(pieces.select(*keys, *[F.col(c).cast("double").alias(c) for c in ends]).withColumn("id", F.struct(*ends)), "rank-pieces")
    onward = rows.select(*keys, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("out"))
    turn = F.pmod(F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")) - F.col("out"), F.lit(2 * math.pi))
    clockwise = F.when(turn == 0, 7.0).otherwise(turn)  # straight back is the last choice
    links = rows.join(onward, [*keys, "x2", "y2"]).groupBy(*keys, "id").agg(F.min_by("next", clockwise).alias("next"))
    ranked = rank_rings(links, keys).select(*keys, F.to_json("ring").alias("ring"), "pos", F.col("id.x1").alias("x"), F.col("id.y1").alias("y"))
    out = materialise(ranked, "rank-points")
    discard(rows)
    return out


def corners(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring, pos, x, y without points in the middle of a straight run. points: keys, ring, pos, x, y."""

    def beside(step: int) -> DataFrame:
        at = F.pmod(F.col("pos") + step, F.col("size"))
        name = "b" if step < 0 else "f"
        return sized.select(*keys, "ring", at.alias("pos"), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"))

    sized = points.join(points.groupBy(*keys, "ring").agg(F.count("*").alias("size")), [*keys, "ring"])
    turned = sized.join(beside(1).withColumnsRenamed({"fx": "px", "fy": "py"}), [*keys, "ring", "pos"]).join(beside(-1), [*keys, "ring", "pos"])
    bend = (F.col("x") - F.col("px")) * (F.col("by") - F.col("y")) - (F.col("y") - F.col("py")) * (F.col("bx") - F.col("x"))
    return turned.filter(bend != 0).select(*keys, "ring", "pos", "x", "y")


def closed_rings(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, ring: rings (ring, pos, x, y) as arrays that end where they start."""
    at = F.sort_array(F.collect_list(F.struct("pos", "x", "y")))
    rings = points.groupBy(*keys, F.col("ring").alias("id")).agg(F.transform(at, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("p"))
    return rings.select(*keys, "id", F.concat("p", F.slice("p", 1, 1)).alias("ring"))
