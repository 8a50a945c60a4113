"""Geometry and coordinate functions as column expressions.

Points are two double columns, a ring is an array of structs ``x``, ``y`` that ends where
it starts, boxes are four doubles (west, south, east, north).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The WGS84 ellipsoid, the mercator sphere and the ground size of a
# zoom-0 pixel, the length of short ways, degrees in metres at the equator.
A, INVERSE_F = 6378137.0, 298.257223563
R_MERCATOR = 6378137.0
METRES_PER_PIXEL_Z0 = 156543.03392
SHORT_M = 20_000.0  # up to here a chord tells the way along the ellipsoid
DEGREE_X, DEGREE_Y = 111320.0, 110540.0

FLAT, ROUNDS = 1 / INVERSE_F, 12
B = A * (1 - FLAT)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# --- polygons -------------------------------------------------------------------------


def edges(ring: Column) -> Column:
    """Array of structs x1, y1, x2, y2."""
    return F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(
            F.get(ring, i - 1).x.alias("x1"), F.get(ring, i - 1).y.alias("y1"), F.get(ring, i).x.alias("x2"), F.get(ring, i).y.alias("y2")
        ),
    )


def crossings(x: Column, y: Column, ring: Column) -> Column:
    """How many edges a ray to the east crosses."""

    def crosses(e: Column) -> Column:
        straddles = (e.y1 > y) != (e.y2 > y)
        return F.when(straddles, x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1).otherwise(F.lit(False))

    return F.size(F.filter(edges(ring), crosses))


def on_boundary(x: Column, y: Column, ring: Column) -> Column:
    def on(e: Column) -> Column:
        straight = (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1) == 0
        return straight & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))

    return F.exists(edges(ring), on)


def within(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside: points of the boundary aren't."""
    return (crossings(x, y, ring) % 2 == 1) & ~on_boundary(x, y, ring)


def intersects(x: Column, y: Column, ring: Column) -> Column:
    """Inside or on the boundary."""
    return (crossings(x, y, ring) % 2 == 1) | on_boundary(x, y, ring)


def signed_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda a, e: a + (e.x1 * e.y2 - e.x2 * e.y1)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Struct x, y; null for a ring without area. Taken around the first vertex, so that
    small rings far from the origin keep their digits."""
    x0, y0 = F.get(ring, F.lit(0)).x, F.get(ring, F.lit(0)).y
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "x", "y")])

    def step(s: Column, e: Column) -> Column:
        c = (e.x1 - x0) * (e.y2 - y0) - (e.x2 - x0) * (e.y1 - y0)
        return F.struct(
            (s.a + c).alias("a"), (s.x + (e.x1 + e.x2 - 2 * x0) * c).alias("x"), (s.y + (e.y1 + e.y2 - 2 * y0) * c).alias("y")
        )

    return F.aggregate(edges(ring), zero, step, lambda s: F.when(s.a != 0, point(x0 + s.x / (3 * s.a), y0 + s.y / (3 * s.a))))


def clip_convex(ring: Column, clip: Column) -> Column:
    """Ring of the part inside a convex, counter-clockwise ring (edge by edge); empty if none."""

    def side(e: Column, p: Column) -> Column:
        return (e.x2 - e.x1) * (p.y - e.y1) - (e.y2 - e.y1) * (p.x - e.x1)

    def cut(points: Column, e: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            q = F.get(points, (i + F.size(points) - 1) % F.size(points))
            return let(
                F.struct(side(e, p).alias("p"), side(e, q).alias("q")),
                lambda s: let(
                    F.try_divide(s.q, s.q - s.p),
                    lambda t: F.concat(
                        F.when((s.p >= 0) != (s.q >= 0), F.array(point(q.x + t * (p.x - q.x), q.y + t * (p.y - q.y)))).otherwise(F.array().cast("array<struct<x:double,y:double>>")),
                        F.when(s.p >= 0, F.array(point(p.x, p.y))).otherwise(F.array().cast("array<struct<x:double,y:double>>")),
                    ),
                ),
            )

        return F.flatten(F.transform(points, piece))

    open_ring = F.slice(ring, F.lit(1), F.size(ring) - 1)
    cutters = F.filter(edges(clip), lambda e: (e.x1 != e.x2) | (e.y1 != e.y2))
    out = F.aggregate(cutters, open_ring, cut)
    return let(out, lambda o: F.when(F.size(o) >= 3, F.concat(o, F.slice(o, 1, 1))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))


def box_ring(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))


def hausdorff(a: Column, b: Column) -> Column:
    """Largest distance from a vertex of one array of points to the nearest vertex of the other."""

    def one_way(p: Column, q: Column) -> Column:
        return F.array_max(F.transform(p, lambda u: F.array_min(F.transform(q, lambda v: F.hypot(u.x - v.x, u.y - v.y)))))

    return F.greatest(one_way(a, b), one_way(b, a))


# --- boxes ----------------------------------------------------------------------------


def boxes_touch(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    """Closed boxes: touching counts."""
    return ~((e1 < w2) | (w1 > e2) | (n1 < s2) | (s1 > n2))


def boxes_overlap(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    """Open boxes: touching doesn't count."""
    return (w1 < e2) & (w2 < e1) & (s1 < n2) & (s2 < n1)


def box_intersection(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(e1, e2) - F.greatest(w1, w2)) * F.greatest(zero, F.least(n1, n2) - F.greatest(s1, s2))


def box_ratio(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    """The share of the first box that the second covers."""
    return box_intersection(w1, s1, e1, n1, w2, s2, e2, n2) / F.greatest((e1 - w1) * (n1 - s1), F.lit(1e-12))


# --- projections and tiles ------------------------------------------------------------


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * R_MERCATOR


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * R_MERCATOR


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / R_MERCATOR)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / R_MERCATOR)) - math.pi / 2)


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return METRES_PER_PIXEL_Z0 * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    """Clamped to the tiles that exist."""
    n = 1 << zoom
    raw = F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * float(n)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), raw))


def pixel_area_km2(w: Column, s: Column, e: Column, n: Column, width: Column, height: Column) -> Column:
    across = (e - w) * DEGREE_X * F.cos(F.radians((s + n) / 2)) / width
    return across * ((n - s) * DEGREE_Y / height) / 1e6


def utm_zone(lon: Column) -> Column:
    """Zone number; 61 at 180 degrees east, as the formula gives it."""
    return F.floor((lon + 180.0) / 6.0).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


# Transverse mercator by series in the third flattening (sixth order is below a millimetre
# within a zone); coefficients follow from the ellipsoid.
_N = FLAT / (2 - FLAT)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4,
    61 / 240 * _N**3 - 103 / 140 * _N**4,
    49561 / 161280 * _N**4,
]
_BETA = [
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4,
    1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4,
    17 / 480 * _N**3 - 37 / 840 * _N**4,
    4397 / 161280 * _N**4,
]
_DELTA = [
    2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4,
    7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4,
    56 / 15 * _N**3 - 136 / 35 * _N**4,
    4279 / 630 * _N**4,
]


def transverse_mercator(lon: Column, lat: Column, meridian: Column, scale: float = 0.9996, east: float = 500_000.0, north: Column | float = 0.0) -> Column:
    """Struct x, y in metres around a central meridian."""
    k = 2 * math.sqrt(_N) / (1 + _N)
    north = north if isinstance(north, Column) else F.lit(north)

    def from_xi(s: Column) -> Column:
        xi, eta = s.xi, s.eta
        y, x = xi, eta
        for j, c in enumerate(_ALPHA, 1):
            y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return point(east + scale * _RECTIFYING * x, north + scale * _RECTIFYING * y)

    def from_t(s: Column) -> Column:
        return let(F.struct(F.atan2(s.t, F.cos(s.l)).alias("xi"), F.atanh(F.sin(s.l) / F.sqrt(1 + s.t * s.t)).alias("eta")), from_xi)

    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - k * F.atanh(k * sine))
    return let(F.struct(t.alias("t"), F.radians(lon - meridian).alias("l")), from_t)


def inverse_transverse_mercator(x: Column, y: Column, meridian: Column, scale: float = 0.9996, east: float = 500_000.0, north: Column | float = 0.0) -> Column:
    """Struct x (longitude), y (latitude)."""
    north = north if isinstance(north, Column) else F.lit(north)

    def from_xi(s: Column) -> Column:
        xi, eta = s.xi, s.eta
        u, v = xi, eta
        for j, c in enumerate(_BETA, 1):
            u = u - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            v = v - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return let(F.struct(u.alias("u"), v.alias("v")), from_uv)

    def from_uv(s: Column) -> Column:
        return let(F.struct(F.asin(F.sin(s.u) / F.cosh(s.v)).alias("chi"), s.u.alias("u"), s.v.alias("v")), from_chi)

    def from_chi(s: Column) -> Column:
        lat = s.chi
        for j, c in enumerate(_DELTA, 1):
            lat = lat + c * F.sin(2 * j * s.chi)
        return point(meridian + F.degrees(F.atan2(F.sinh(s.v), F.cos(s.u))), F.degrees(lat))

    return let(F.struct(((y - north) / (scale * _RECTIFYING)).alias("xi"), ((x - east) / (scale * _RECTIFYING)).alias("eta")), from_xi)


def utm(lon: Column, lat: Column) -> Column:
    """Struct x, y in the point's own UTM zone."""
    meridian = (utm_zone(lon) - 1).cast("double") * 6.0 - 177.0
    return transverse_mercator(lon, lat, meridian, north=F.when(lat >= 0, 0.0).otherwise(10_000_000.0))


def metric_buffer(lon: Column, lat: Column, radius_m: Column, quadrant_segments: int = 64) -> Column:
    """Ring of a polygon around a point, with corners on the circle in the point's UTM zone."""
    n = 4 * quadrant_segments
    meridian = (utm_zone(lon) - 1).cast("double") * 6.0 - 177.0
    return let(
        F.struct(transverse_mercator(lon, lat, meridian).alias("c"), meridian.alias("m"), radius_m.alias("r")),
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(n)),
            lambda i: inverse_transverse_mercator(s.c.x + s.r * F.cos(i % n * (2 * math.pi / n)), s.c.y + s.r * F.sin(i % n * (2 * math.pi / n)), s.m),
        ),
    )


def buffer_area_km2(radius_m: Column, quadrant_segments: int = 64) -> Column:
    """Area of the polygon, not of the circle."""
    n = 4 * quadrant_segments
    return n / 2 * math.sin(2 * math.pi / n) * radius_m * radius_m / 1e6


# --- geodesic distance ----------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def _inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Vincenty's inverse for whole batches, until no row moves any more."""
    x1, y1, x2, y2 = (np.radians(c.to_numpy(float)) for c in (lon1, lat1, lon2, lat2))
    r1, r2 = np.arctan((1 - FLAT) * np.tan(y1)), np.arctan((1 - FLAT) * np.tan(y2))
    s1, c1, s2, c2, start = np.sin(r1), np.cos(r1), np.sin(r2), np.cos(r2), x2 - x1
    lam = start
    with np.errstate(invalid="ignore"):
        for _ in range(ROUNDS):
            ss = np.maximum(np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)), 1e-300)
            cs = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma, sa = np.arctan2(ss, cs), c1 * c2 * np.sin(lam) / ss
            c2a = 1 - sa * sa
            cm = np.where(c2a > 1e-15, cs - 2 * s1 * s2 / np.where(c2a > 1e-15, c2a, 1.0), 0.0)
            k = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
            last, lam = lam, start + (1 - k) * FLAT * sa * (sigma + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
            if not (np.abs(lam - last) > 1e-13).any():
                break
        u = c2a * (A * A - B * B) / (B * B)
        scale = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        bend = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        less = bend * ss * (cm + bend / 4 * (cs * (2 * cm * cm - 1) - bend / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        out = B * scale * (sigma - less)
    return pd.Series(np.where((x1 == x2) & (y1 == y2), 0.0, out)).where(~np.isnan(x1 + x2 + y1 + y2))


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the ellipsoid (Vincenty's inverse, a fixed number of rounds at most), in
    Arrow batches. Nearly antipodal points don't converge; equal points give 0, nulls null."""
    return _inverse(*[c.cast("double") for c in (lon1, lat1, lon2, lat2)])


def spot(lon: Column, lat: Column) -> Column:
    """A point's place on the ellipsoid (x, y, z in metres), its latitude (radians) and two
    terms of the curvature there (a across the meridian, b for ways along it): what
    ``chord_of`` and ``short_way`` take, so that pairs need no trigonometry."""
    e2, phi = FLAT * (2 - FLAT), F.radians(lat)
    root = F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    along, across = A * (1 - e2) / (root * root * root), A / root  # radii
    return F.struct(
        (across * F.cos(phi) * F.cos(F.radians(lon))).alias("x"), (across * F.cos(phi) * F.sin(F.radians(lon))).alias("y"), (across * (1 - e2) * F.sin(phi)).alias("z"),
        phi.alias("lat"), (1 / (48 * across * across)).alias("a"), ((1 - along * along / (across * across)) / 48).alias("b"),
    )


Spot = Column | dict[str, Column]  # a struct of ``spot``, or its columns by name
SPOT = ("x", "y", "z", "lat", "a", "b")


def chord_of(p: Spot, q: Spot) -> Column:
    """The square of the straight distance of two spots."""
    return sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz"), F.lit(0.0))


def short_way(p: Spot, q: Spot) -> Column:
    """Metres along the ellipsoid between two spots at most ``SHORT_M`` apart: the arc over
    their chord with the curvature that the ellipsoid has in their direction (the series of
    the arc's sine). It differs from Vincenty's series by less than 2e-7 m. Kept short: as a
    condition of a join it is code for every pair."""
    north = (p["lat"] - q["lat"]) * (p["lat"] - q["lat"])
    return F.sqrt(chord_of(p, q)) * (1 + chord_of(p, q) * (p["a"] + q["a"]) + north * (p["b"] + q["b"]))


def chord_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Straight distance of two points of the ellipsoid, never longer than the way along it."""

    def place(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
        sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
        e2 = FLAT * (2 - FLAT)
        n = A / F.sqrt(1 - e2 * sin * sin)
        return n * cos * F.cos(F.radians(lon)), n * cos * F.sin(F.radians(lon)), n * (1 - e2) * sin

    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(place(lon1, lat1), place(lon2, lat2), strict=True)), F.lit(0.0)))
