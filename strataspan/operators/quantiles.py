"""Exact quantiles of groups of any size.

A percentile aggregate holds all distinct values of a group in one buffer. Here sketches,
which merge in partial aggregation, name a range of values around each wanted rank; the rows
below it and in it are counted exactly, and the next round sketches the rows in the range
only, until few are left or all are equal. A task holds a sketch or ``SMALL`` values.

Nulls don't count; NaN is the greatest value; groups without values have no row. Quantiles
between two values are interpolated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise

SMALL = 10_000
STEPS, ACCURACY = 200, 20_000


def quantiles(df: DataFrame, value: str, keys: list[str], probabilities: list[float]) -> DataFrame:
    """keys, p, q: the quantiles of ``value`` by keys (null is a key too)."""
    rows = df.select(F.struct(F.lit(0), *keys).alias("key_"), F.col(value).cast("double").alias("v")).filter("v is not null")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    at = F.col("p") * (F.col("n") - 1)
    ends = rows.groupBy("key_").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("key_", "n", "lo", "hi", wanted)
    ends = materialise(ends.withColumns({"rank": F.floor(at), "part": at - F.floor(at)}), "quantile-wanted")
    ranks = ends.select("key_", "n", "lo", "hi", F.explode(F.array("rank", F.least(F.col("rank") + 1, F.col("n") - 1))).alias("r")).distinct()
    found = _ranks(rows, ranks.select("key_", "r", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), F.lit(0).alias("missed")))
    low = ends.join(found, (ends.key_ == found.key_) & (F.col("rank") == F.col("r"))).select(ends.key_, "p", "n", "rank", "part", F.col("v").alias("a"))
    high = found.select(F.col("key_").alias("other"), F.col("r").alias("next"), F.col("v").alias("b"))
    both = low.join(high, (F.col("key_") == F.col("other")) & (F.least(F.col("rank") + 1, F.col("n") - 1) == F.col("next")))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return both.select(*[F.col("key_")[k].alias(k) for k in keys], "p", q.alias("q"))


def _ranks(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """key_, r, v: the value of each rank (from 0); ranks lie among the ``m`` rows from lo to hi, ``below`` lie before them."""
    done, now = [], materialise(ranks, "quantile-ranges")
    in_range = F.col("v").between(F.col("lo"), F.col("hi"))
    while True:
        ready = (F.col("m") <= SMALL) | (F.col("lo") == F.col("hi"))
        few = now.filter(ready)
        values = rows.join(few.filter("lo <> hi"), "key_").filter(in_range).groupBy("key_", "r", "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        done.append(materialise(values.select("key_", "r", F.get("vs", F.col("r") - F.col("below")).alias("v")).unionByName(few.filter("lo = hi").select("key_", "r", F.col("lo").alias("v"))), "quantile-found"))
        now = now.filter(~ready)
        if now.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        steps = F.percentile_approx("v", F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)]), F.lit(ACCURACY))
        cut = rows.join(now, "key_").filter(in_range).groupBy("key_", "r", "lo", "hi", "below", "m", "missed").agg(steps.alias("steps"))
        # A sketch that missed its rank gets a wider range next time.
        share, slack = (F.col("r") - F.col("below")) / F.col("m"), 2 / ACCURACY * F.pow(F.lit(2.0), "missed")
        first, last = (F.least(F.greatest(x, F.lit(0)), F.lit(STEPS)).cast("int") for x in (F.floor((share - slack) * STEPS), F.ceil((share + 1 / F.col("m") + slack) * STEPS)))
        narrow = materialise(cut.select(
            "key_", "r", "m", "below", "missed", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"),
            F.when(first <= 0, F.col("lo")).otherwise(F.get("steps", first)).alias("lo"), F.when(last >= STEPS, F.col("hi")).otherwise(F.get("steps", last)).alias("hi"),
        ), "quantile-narrow")
        now = materialise(_narrowed(rows, narrow), "quantile-ranges")
        discard(narrow)


def _narrowed(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Ranges after exact counts. A rank among the equals of an end is found (lo = hi); else both
    ends are left out of the range, so that it shrinks even where most values are equal."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    within = (v > lo) & (v < hi)
    counted = rows.join(narrow, "key_").filter(v.between(F.col("old_lo"), F.col("old_hi"))).groupBy("key_", "r", "m", "below", "missed", "old_lo", "old_hi", "lo", "hi").agg(
        F.count_if(v < lo).alias("less"), F.count_if(v == lo).alias("lows"), F.count_if(within).alias("inner"), F.count_if((v == hi) & (hi != lo)).alias("highs"),
        F.min(F.when(within, v)).alias("least"), F.max(F.when(within, v)).alias("most"),
    )
    at = F.col("r") - F.col("below") - F.col("less")
    holds = (at >= 0) & (at < F.col("lows") + F.col("inner") + F.col("highs"))
    low, high = at < F.col("lows"), at >= F.col("lows") + F.col("inner")
    pick = lambda a, b, c, old: F.when(~holds, old).when(low, a).when(high, b).otherwise(c)
    return counted.select(
        "key_", "r", pick(lo, hi, F.col("least"), F.col("old_lo")).alias("lo"), pick(lo, hi, F.col("most"), F.col("old_hi")).alias("hi"),
        pick(F.col("below"), F.col("below"), F.col("below") + F.col("less") + F.col("lows"), F.col("below")).alias("below"),
        pick(F.col("m"), F.col("m"), F.col("inner"), F.col("m")).alias("m"), F.when(holds, 0).otherwise(F.col("missed") + 1).alias("missed"),
    )
