"""Quantiles by selection against sorted values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strataspan.operators import change, quantiles


def plain(values, p):
    s = sorted(values, key=lambda v: (math.isnan(v), v))
    h = p * (len(s) - 1)
    a, b = s[math.floor(h)], s[min(math.floor(h) + 1, len(s) - 1)]
    return a if a == b else a + (b - a) * (h - math.floor(h))


@pytest.mark.parametrize("small", [10_000, 7])
def test_groups(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = random.Random(6)
    groups = {
        "even": [rng.random() for _ in range(3001)], "steep": [10 ** rng.uniform(-200, 200) * rng.choice((-1, 1)) for _ in range(1500)], "same": [2.5] * 900,
        "two": [0.0] * 700 + [1.0] * 701, "one": [4.0], "pair": [1.0, 3.0], None: [float(i) for i in range(50)], "nan": [1.0, float("nan"), 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    ps = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]
    got = quantiles.quantiles(spark.createDataFrame(rows, "key_name string, v double"), "v", ["key_name"], ps).collect()
    assert len(got) == len(groups) * len(ps)
    for r in got:
        want = plain(groups[r.key_name], r.p)
        assert r.q == pytest.approx(want, rel=1e-12) or math.isnan(want) and math.isnan(r.q), r
    assert quantiles.quantiles(spark.createDataFrame([], "v double"), "v", [], [0.5]).count() == 0


def test_no_task_holds_a_group(spark, monkeypatch):
    """One group; the largest list that is collected stays small."""
    monkeypatch.setattr(quantiles, "SMALL", 50)
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = {r.p: r.q for r in quantiles.quantiles(df, "v", [], [0.25, 0.5]).collect()}
    exact = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]
    assert [got[0.25], got[0.5]] == exact


def test_users(spark):
    df = spark.createDataFrame([("a", float(v * v)) for v in range(101)] + [("b", 1.0)] * 3, "k string, v double")
    z = {(r.k, r.v): r.z for r in change.robust_z(df, "v", ["k"], F.lit(True)).collect()}
    med = plain([float(v * v) for v in range(101)], 0.5)
    mad = plain([abs(v * v - med) for v in range(101)], 0.5)
    assert z["a", 0.0] == pytest.approx((0 - med) / (1.4826 * mad)) and z["b", 1.0] == 0
    byte = {r.v: r.byte for r in change.stretch(df.filter("k = 'a'"), "v").collect()}
    assert byte[0.0] == 0 and byte[10000.0] == 255 and byte[2500.0] == math.floor((2500 - plain([float(v * v) for v in range(1, 101)], 0.02)) / (plain([float(v * v) for v in range(1, 101)], 0.98) - plain([float(v * v) for v in range(1, 101)], 0.02)) * 255)
