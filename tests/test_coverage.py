"""A coverage with wriggly common borders keeps them common when it is simplified."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from strataspan.operators import coverage
from strataspan.schemas import RING

GEOMETRY = f"array<{RING}>"


def wriggle(rng, a, b, n, amount):
    """A path between two corners, the same whichever way it is walked."""
    (x1, y1), (x2, y2) = sorted((a, b))
    d = math.hypot(x2 - x1, y2 - y1)
    path = [(x1, y1)] + [(x1 + (x2 - x1) * i / n - (y2 - y1) / d * o, y1 + (y2 - y1) * i / n + (x2 - x1) / d * o) for i in range(1, n) for o in [rng.uniform(-amount, amount)]] + [(x2, y2)]
    return path if a <= b else path[::-1]


def grid(size, amount=0.06):
    """Cells of a grid with wriggly sides; the hull is straight."""
    sides, cells = {}, []
    for r in range(size):
        for c in range(size):
            ring = []
            for a, b in (((c, r), (c + 1, r)), ((c + 1, r), (c + 1, r + 1)), ((c + 1, r + 1), (c, r + 1)), ((c, r + 1), (c, r))):
                key = (min(a, b), max(a, b))
                edge = a[0] == b[0] in (0, size) or a[1] == b[1] in (0, size)
                if key not in sides:
                    rng = random.Random(str(key))
                    sides[key] = [tuple(round(v, 9) for v in p) for p in wriggle(rng, *key, 14, 0 if edge else amount)]
                ring += (sides[key] if a <= b else sides[key][::-1])[:-1]
            cells.append((r * size + c, [[*ring, ring[0]]]))
    return cells


def frame(spark, cells):
    return spark.createDataFrame([(k, g and [[{"x": float(x), "y": float(y)} for x, y in r] for r in g]) for k, g in cells], f"id long, g {GEOMETRY}")


def segments(rings):
    return [((a.x, a.y), (b.x, b.y)) for r in rings for a, b in zip(r, r[1:], strict=False)]


def test_borders_stay_common(spark):
    cells = grid(4)
    island = [(1.4, 1.4), (1.5, 1.4), (1.6, 1.4), (1.6, 1.6), (1.4, 1.6), (1.4, 1.4)]
    cells[5][1].append(island)  # an island, once a hole and once a polygon of its own
    cells += [(99, [island[::-1]]), (100, None), (101, [])]
    out = coverage.simplify_coverage(frame(spark, cells), "id", "g", 0.05).collect()
    assert sorted(r.id for r in out) == [*range(16), 99]
    area = lambda r: abs(sum(a.x * b.y - a.y * b.x for a, b in zip(r, r[1:], strict=False))) / 2
    assert abs(sum(area(r.ring) - sum(map(area, r.holes)) for r in out) - 16) < 1e-9
    used = Counter(frozenset(s) for r in out for s in segments([r.ring, *r.holes]))
    hull = lambda s: any(all(p[k] == v for p in s) for k in (0, 1) for v in (0, 4))
    assert all(n == (1 if hull(s) else 2) for s, n in used.items())
    assert len(used) < 0.7 * sum(len(r) - 1 for _, g in cells if g for r in g) / 2
    corner = [r for r in out if r.id == 99][0]
    assert len(corner.ring) == 5 and len([r for r in out if r.id == 5][0].holes) == 1


def test_tolerances_are_halved(spark):
    """Narrow strips: with the whole tolerance their borders would cross or fall together."""
    up = [(x, (x % 2) * 0.4) for x in range(11)]
    strips = [(k, [[*[(x, y + 0.5 * k) for x, y in up], *[(x, y + 0.5 * (k + 1)) for x, y in reversed(up)], (0, 0.5 * k)]]) for k in range(4)]
    got = coverage.simplified_areas(frame(spark, strips), "id", "g", 0.6).collect()
    assert len(got) == 4 and all(r.area > 0 for r in got)
    want = sum(5.0 for _ in strips)
    bent = coverage.simplified_borders(frame(spark, strips), "id", "g", 0.6).collect()
    lines = sorted({min((r.x1, r.y1, r.x2, r.y2), (r.x2, r.y2, r.x1, r.y1)) for r in bent})
    side = lambda e, x, y: (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])
    assert not [(e, f) for e in lines for f in lines if e < f and side(e, *f[:2]) * side(e, *f[2:]) < 0 and side(f, *e[:2]) * side(f, *e[2:]) < 0]
    assert len(lines) < 5 * 10 + 8
    assert abs(sum(r.area for r in got) - want) < 3


def test_corners_on_a_neighbours_side(spark):
    """A neighbour's corner in the middle of a side is a corner of both."""
    cells = [(1, [[(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]]), (2, [[(0, 2), (2, 2), (2, 4), (0, 4), (0, 2)]]), (3, [[(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]])]
    out = {r.id: r for r in coverage.simplify_coverage(frame(spark, cells), "id", "g", 0.1).collect()}
    assert [len(out[k].ring) for k in (1, 2, 3)] == [5, 5, 5]
    assert coverage.simplified_areas(frame(spark, cells), "id", "g", 0.1).agg(F.sum("area")).first()[0] == 16
    lone = coverage.simplify_coverage(frame(spark, cells[:1]), "id", "g", 0.1).first()
    assert len(lone.ring) == 5 and lone.holes == []
    assert coverage.simplify_coverage(frame(spark, cells[:0]), "id", "g", 0.1).count() == 0
