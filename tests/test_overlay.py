"""Overlay and repair against slabs in rational arithmetic; rings by list ranking."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strataspan.operators import cartography, overlay, patches, polygons, ranking
from strataspan.schemas import RING

GEOMETRY = f"array<{RING}>"


def edges(rings):
    return [(*a, *b) for r in rings or [] for a, b in zip(r, r[1:], strict=False) if a != b]


def spans(es, y):
    xs = sorted(x1 + (x2 - x1) * (y - y1) / (y2 - y1) for x1, y1, x2, y2 in es if (y1 > y) != (y2 > y))
    return list(zip(xs[::2], xs[1::2], strict=True))


def plain_area(a, b, how):
    """Lengths of the spans at half height of slabs between all corners and crossings, which is exact."""
    ea, eb = ([tuple(Fraction(round(v, 9)).limit_denominator(10**9) for v in e) for e in edges(r)] for r in (a, b))
    ys = {e[k] for e in ea + eb for k in (1, 3)}
    both = ea + eb
    for i, p in enumerate(both):
        for q in both[i + 1 :]:
            d = (p[2] - p[0]) * (q[3] - q[1]) - (p[3] - p[1]) * (q[2] - q[0])
            if d:
                t = ((q[0] - p[0]) * (q[3] - q[1]) - (q[1] - p[1]) * (q[2] - q[0])) / d
                ys.add(p[1] + t * (p[3] - p[1]))
    total, ys = Fraction(0), sorted(ys)
    for lo, hi in zip(ys, ys[1:], strict=False):
        sa, sb = spans(ea, (lo + hi) / 2), spans(eb, (lo + hi) / 2)
        length = lambda s: sum(r - q for q, r in s)
        inter = sum(max(Fraction(0), min(p[1], q[1]) - max(p[0], q[0])) for p in sa for q in sb)
        total += (hi - lo) * {"intersection": inter, "union": length(sa) + length(sb) - inter, "difference": length(sa) - inter}[how]
    return float(total)


def star(rng, cx, cy, n, r):
    at = [(cx + k * math.cos(2 * math.pi * i / n), cy + k * math.sin(2 * math.pi * i / n)) for i in range(n) for k in [r * rng.uniform(0.3, 1)]]
    return [*at, at[0]]


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def frame(spark, rows, *names):
    points = lambda g: g and [[{"x": float(x), "y": float(y)} for x, y in r] for r in g]
    return spark.createDataFrame([(k, *[points(g) for g in gs]) for k, *gs in rows], "k int, " + ", ".join(f"{n} {GEOMETRY}" for n in names))


def cases():
    rng, out = random.Random(11), []
    for _ in range(12):
        out.append(([star(rng, 0, 0, rng.randrange(3, 30), 2)], [star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.randrange(3, 30), 2)]))
    comb = [(0, 0), (9, 0), (9, 3), *[(8 - i + d, 1 if d == 0.5 else 3) for i in range(8) for d in (0.5, 0)], (0, 3), (0, 0)]
    ring = [box(0, 0, 6, 6), box(2, 2, 4, 4)]
    out += [
        ([comb], [[(x, 4 - y) for x, y in comb]]), (ring, [box(3, 3, 9, 9)]), (ring, [box(2, 2, 4, 4)]), (ring, [box(2.5, 2.5, 3.5, 3.5)]), (ring, ring), (ring, [box(6, 0, 9, 6)]),
        ([box(0, 0, 2, 2)], [box(2, 2, 3, 3)]), ([box(0, 0, 1, 1)], [box(5, 5, 6, 6)]), ([box(0, 0, 4, 4)], [box(0, 0, 4, 2)]), ([box(0, 0, 4, 4)], [list(reversed(box(1, -1, 2, 5)))]),
        ([[(0, 0), (4, 0), (2, 3), (0, 0)]], [[(0, 3), (2, 0), (4, 3), (0, 3)]]), ([box(113.7, 22.4, 113.82, 22.48)], [[(113.75, 22.43), (113.87, 22.43), (113.87, 22.51), (113.81, 22.462), (113.75, 22.51), (113.75, 22.43)]]),
    ]
    return out


@pytest.mark.parametrize("how", ["intersection", "union", "difference"])
def test_areas(spark, how):
    rows = [(i, a, b) for i, (a, b) in enumerate(cases())]
    df = frame(spark, rows, "a", "b")
    got = {r.k: r.area for r in overlay.overlay_areas(df, ["k"], "a", "b", how).collect()}
    for k, a, b in rows:
        assert abs(got.get(k, 0.0) - plain_area(a, b, how)) < 1e-6, (k, how)
    # The polygons add up to the same areas.
    parts = overlay.overlay(df, ["k"], "a", "b", how)
    sums = parts.select("k", polygons.area_with_holes(F.col("ring"), F.col("holes")).alias("m")).groupBy("k").agg(F.sum("m").alias("m"))
    assert {r.k for r in sums.collect() if abs(r.m - got[r.k]) > 1e-9} == set() and sums.count() == len(got)


def test_odd_geometries(spark):
    df = frame(spark, [(1, None, [box(0, 0, 1, 1)]), (2, [], [box(0, 0, 1, 1)]), (3, [[(0, 0), (1, 1), (0, 0)]], None), (4, [box(0, 0, 1, 1) + [(0, 0)]], [box(0, 0, 1, 1)])], "a", "b")
    areas = {how: {r.k: r.area for r in overlay.overlay_areas(df, ["k"], "a", "b", how).collect()} for how in overlay.RULES}
    assert areas == {"intersection": {4: 1.0}, "union": {1: 1.0, 2: 1.0, 4: 1.0}, "difference": {}}
    clash = df.filter("k = 4").selectExpr("k as id", "k as side", "k as x1", "a", "b")
    assert overlay.overlay(clash, ["id", "side", "x1"], "a", "b", "union").columns == ["id", "side", "x1", "ring", "holes"]
    assert overlay.overlay(df.limit(0), ["k"], "a", "b", "union").count() == 0


def test_repair(spark):
    rng = random.Random(3)
    loose = [[(rng.randrange(9), rng.randrange(9)) for _ in range(n)] for n in (4, 6, 9, 14) for _ in range(3)]
    shapes = [[[*r, r[0]]] for r in loose] + [[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]], [box(0, 0, 4, 4), box(1, 1, 5, 5)], [box(0, 0, 2, 2), box(2, 2, 4, 4)], [box(0, 0, 2, 2), box(2, 0, 4, 2)]]
    df = frame(spark, list(enumerate(shapes)), "g")
    got = {r.k: r.area for r in overlay.repaired_areas(df, ["k"], "g").collect()}
    for k, g in enumerate(shapes):
        es = [tuple(map(Fraction, e)) for e in edges(g)]
        ys = {e[i] for e in es for i in (1, 3)}
        for i, p in enumerate(es):
            for q in es[i + 1 :]:
                d = (p[2] - p[0]) * (q[3] - q[1]) - (p[3] - p[1]) * (q[2] - q[0])
                if d:
                    ys.add(p[1] + ((q[0] - p[0]) * (q[3] - q[1]) - (q[1] - p[1]) * (q[2] - q[0])) / d * (p[3] - p[1]))
        ys = sorted(ys)
        want = sum((hi - lo) * sum(r - q for q, r in spans(es, (lo + hi) / 2)) for lo, hi in zip(ys, ys[1:], strict=False))
        assert abs(got.get(k, 0) - float(want)) < 1e-6, (k, g, got.get(k), float(want))
    fixed = {r.k: (len(r.ring), r.holes) for r in overlay.repair(df.filter("k >= 12"), ["k"], "g").filter("k = 15").collect()}
    assert fixed == {15: (5, [])}  # two boxes with a common side are one


def test_ranking(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for key, size in ((1, 1), (1, 2), (1, 700), (2, 9), (2, 64)):
        ids = rng.sample(range(10**6 * size, 10**6 * size + 10**5), size)
        start = ids.index(min(ids))
        for i, v in enumerate(ids):
            rows.append((key, v, ids[(i + 1) % size]))
            want[key, v] = (min(ids), (i - start) % size)
    rows += [(3, 5, 6), (3, 6, 7), (3, 7, 99)]  # an open chain
    got = ranking.rank_rings(spark.createDataFrame(rows, "k int, id long, next long"), ["k"]).collect()
    assert {(r.k, r.id): (r.ring, r.pos) for r in got} == want
    assert ranking.rank_rings(spark.createDataFrame([], "k int, id long, next long"), ["k"]).count() == 0


def test_assembled_rings(spark):
    rng = random.Random(2)
    rows, want = [], []
    for key, size in ((1, 40), (1, 3), (2, 200)):
        ring = star(rng, 10 * size, key, size, 3)
        want.append((key, round(abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:], strict=False))) / 2, 6)))
        cuts = sorted({0, size, *rng.sample(range(1, size), min(size // 3, 50))})
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = ring[i : j + 1]
            rows.append((key, part if rng.random() < 0.5 else part[::-1]))
    rows += [(1, [(0, 0), (1, 1)]), (3, [(0, 0), (1, 1), (2, 0)]), (2, None), (4, box(0, 0, 1, 1)), (4, [(5, 5), (6, 6), (5, 5)])]
    want.append((4, 1.0))
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, p and [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in rows], f"k int, line {RING}")
    got = cartography.assemble_rings(df, "k").select("k", F.round(overlay.geo.area(F.col("ring")), 6).alias("a"), F.size("ring").alias("n")).collect()
    assert sorted((r.k, r.a) for r in got) == sorted(want) and {r.n for r in got if r.k == 2} == {201}


def test_outlines_of_random_patches(spark):
    """Areas of rings are the patches' pixels; corners turn at right angles."""
    rng = random.Random(8)
    mask = spark.createDataFrame([(1, r, c) for r in range(30) for c in range(30) if rng.random() < 0.6], "k int, row int, col int")
    out = patches.outlines(patches.keep_large(mask, ["k"], 1, 8), ["k"]).collect()
    area = lambda r: sum(a.x * b.y - a.y * b.x for a, b in zip(r, r[1:], strict=False)) / 2
    for r in out:
        assert sum(map(area, r.rings)) == r.px and area(r.rings[0]) > 0 and all(area(h) < 0 for h in r.rings[1:])
        assert all((a.x == b.x) != (a.y == b.y) for ring in r.rings for a, b in zip(ring, ring[1:], strict=False))
    assert sum(r.px for r in out) == mask.count()
