"""Spatial functions for SQL: temporary functions of a session over a geometry value.

A geometry is an array of rings, a ring an array of points: a point is one ring of one
point, a polygon its shell and its holes, each ending where it starts. Coordinates are
degrees; distances and radii are metres along the ellipsoid, whatever cast a statement
names. The bodies are SQL, so they become expressions of the plan. A short way along the
ellipsoid follows from the chord of two points; only longer ones are iterated.

Null arguments give null. The empty geometry contains and meets nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import geo

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
GEOMETRY = f"ARRAY<ARRAY<{POINT}>>"
SPOT = "STRUCT<lon: DOUBLE, lat: DOUBLE, x: DOUBLE, y: DOUBLE, z: DOUBLE, a: DOUBLE, b: DOUBLE>"  # see geo.spot


# A function can't be called on a lambda's variable, so these are pasted into bodies.
def _edges(g: str) -> str:
    return f"flatten(transform(filter({g}, r -> size(r) > 1), r -> transform(sequence(1, size(r) - 1), i -> named_struct('x1', r[i - 1].x, 'y1', r[i - 1].y, 'x2', r[i].x, 'y2', r[i].y))))"


def _odd(g: str, x: str, y: str) -> str:
    return f"size(filter({_edges(g)}, e -> (e.y1 > {y}) <> (e.y2 > {y}) AND {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1)) % 2 = 1"


def _on(g: str, x: str, y: str) -> str:
    return f"""exists({_edges(g)}, e -> (e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1) = 0
  AND {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"""


_SIDE = "sign((e.x2 - e.x1) * (f.y{k} - e.y1) - (e.y2 - e.y1) * (f.x{k} - e.x1))"
_BACK = "sign((f.x2 - f.x1) * (e.y{k} - f.y1) - (f.y2 - f.y1) * (e.x{k} - f.x1))"
_CROSS = f"{_SIDE.format(k=1)} * {_SIDE.format(k=2)} < 0 AND {_BACK.format(k=1)} * {_BACK.format(k=2)} < 0"
# The point of an edge that is nearest to (px, py), in a plane that is true to
# the ellipsoid around that point (k: a degree of longitude in degrees of latitude).
_E2 = geo.FLAT * (2 - geo.FLAT)
_SHARE = "((px - e.x1) * (e.x2 - e.x1) * k * k + (py - e.y1) * (e.y2 - e.y1)) / nullif((e.x2 - e.x1) * (e.x2 - e.x1) * k * k + (e.y2 - e.y1) * (e.y2 - e.y1), 0)"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _spot(lon: str, lat: str, root: str = "r") -> str:
    return f"""named_struct('lon', {lon}, 'lat', {lat}, 'x', {geo.A}D / {root} * cos(radians({lat})) * cos(radians({lon})), 'y', {geo.A}D / {root} * cos(radians({lat})) * sin(radians({lon})),
      'z', {geo.A * (1 - _E2)}D / {root} * sin(radians({lat})), 'a', {root} * {root} / {48 * geo.A**2}D, 'b', (1 - pow({1 - _E2}D / ({root} * {root}), 2)) / 48)"""


def _root(lat: str) -> str:
    return f"sqrt(1 - {_E2}D * sin(radians({lat})) * sin(radians({lat})))"


def chord(p: str, q: str) -> str:
    """The square of the straight distance of two spots."""
    return " + ".join(f"({p}.{c} - {q}.{c}) * ({p}.{c} - {q}.{c})" for c in "xyz")


def _geodesic() -> str:
    """Vincenty's inverse of two spots in a fixed number of rounds; the state is the angle and the terms of its round."""
    f, b = f"{geo.FLAT}D", f"{geo.B}D"
    fixed = f"""named_struct('u', atan({1 - geo.FLAT}D * tan(radians(p.lat))), 'v', atan({1 - geo.FLAT}D * tan(radians(q.lat))), 'l', radians(q.lon - p.lon))"""
    sines = "named_struct('s1', sin(w.u), 'c1', cos(w.u), 's2', sin(w.v), 'c2', cos(w.v), 'l', w.l)"
    start = "named_struct('lam', w.l, 'ss', 0D, 'cs', 1D, 'sigma', 0D, 'cm', 0D, 'c2a', 0D)"
    lam = f"w.l + (1 - k) * {f} * o.sa * (o.sigma + k * a.ss * (c.cm + k * a.cs * (2 * c.cm * c.cm - 1)))"
    step = _let("a", "named_struct('ss', greatest(sqrt(pow(w.c2 * sin(s.lam), 2) + pow(w.c1 * w.s2 - w.s1 * w.c2 * cos(s.lam), 2)), 1e-300), 'cs', w.s1 * w.s2 + w.c1 * w.c2 * cos(s.lam))",
        _let("o", "named_struct('sigma', atan2(a.ss, a.cs), 'sa', w.c1 * w.c2 * sin(s.lam) / a.ss)",
            _let("c", "named_struct('c2a', 1 - o.sa * o.sa, 'cm', if(1 - o.sa * o.sa > 1e-15, a.cs - 2 * w.s1 * w.s2 / (1 - o.sa * o.sa), 0D))",
                _let("k", f"{f} / 16 * c.c2a * (4 + {f} * (4 - 3 * c.c2a))", f"named_struct('lam', {lam}, 'ss', a.ss, 'cs', a.cs, 'sigma', o.sigma, 'cm', c.cm, 'c2a', c.c2a)"))))
    less = "z * s.ss * (s.cm + z / 4 * (s.cs * (2 * s.cm * s.cm - 1) - z / 6 * s.cm * (4 * s.ss * s.ss - 3) * (4 * s.cm * s.cm - 3)))"
    end = _let("t", f"s.c2a * {(geo.A**2 - geo.B**2) / geo.B**2}D", _let("z", "t / 1024 * (256 + t * (-128 + t * (74 - 47 * t)))", f"{b} * (1 + t / 16384 * (4096 + t * (-768 + t * (320 - 175 * t)))) * (s.sigma - {less})"))
    return _let("w", fixed, _let("w", sines, f"aggregate(sequence(1, {geo.ROUNDS}), {start}, (s, i) -> {step}, s -> {end})"))


def _way() -> str:
    """Metres between the spots p and q, whose chord has this square; the arc over a short one as in geo.short_way."""
    short = "sqrt(square) * (1 + square * (p.a + q.a) + pow(radians(p.lat - q.lat), 2) * (p.b + q.b))"
    return f"CASE WHEN p.lon = q.lon AND p.lat = q.lat THEN 0D WHEN square <= {geo.SHORT_M**2}D THEN {short} ELSE {_geodesic()} END"


# name: (parameters, type, body), each after those that it calls.
FUNCTIONS = {
    "st_point": ("x DOUBLE, y DOUBLE", GEOMETRY, "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN array(array(named_struct('x', x, 'y', y))) END"),
    "st_makepoint": ("x DOUBLE, y DOUBLE", GEOMETRY, "st_point(x, y)"),
    "st_with_srid": (f"g {GEOMETRY}, srid INT", GEOMETRY, "CASE WHEN srid = 4326 THEN g ELSE raise_error('only 4326') END"),
    "st_makeenvelope": (
        "w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE, srid INT DEFAULT 4326", GEOMETRY,
        "CASE WHEN srid <> 4326 THEN raise_error('only 4326') ELSE array(transform(array(array(w, s), array(e, s), array(e, n), array(w, n), array(w, s)), p -> named_struct('x', p[0], 'y', p[1]))) END",
    ),
    "st_geomfromtext": (
        "t STRING, srid INT DEFAULT 4326", GEOMETRY,
        r"""transform(split(regexp_replace(t, '^\\s*[A-Za-z]+\\s*\\(+|\\)+\\s*$', ''), '\\)\\s*,\\s*\\('),
            r -> transform(split(r, ','), p -> named_struct('x', double(split(trim(p), '\\s+')[0]), 'y', double(split(trim(p), '\\s+')[1]))))""",
    ),
    "st_is_point": (f"g {GEOMETRY}", "BOOLEAN", "size(g) = 1 AND size(g[0]) = 1"),
    "st_x": (f"g {GEOMETRY}", "DOUBLE", "CASE WHEN st_is_point(g) THEN g[0][0].x END"),
    "st_y": (f"g {GEOMETRY}", "DOUBLE", "CASE WHEN st_is_point(g) THEN g[0][0].y END"),
    "st_npoints": (f"g {GEOMETRY}", "INT", "size(flatten(g))"),
    "st_xmin": (f"g {GEOMETRY}", "DOUBLE", "array_min(transform(flatten(g), p -> p.x))"),
    "st_xmax": (f"g {GEOMETRY}", "DOUBLE", "array_max(transform(flatten(g), p -> p.x))"),
    "st_ymin": (f"g {GEOMETRY}", "DOUBLE", "array_min(transform(flatten(g), p -> p.y))"),
    "st_ymax": (f"g {GEOMETRY}", "DOUBLE", "array_max(transform(flatten(g), p -> p.y))"),
    "st_envelope": (f"g {GEOMETRY}", GEOMETRY, "st_makeenvelope(st_xmin(g), st_ymin(g), st_xmax(g), st_ymax(g))"),
    "st_area": (f"g {GEOMETRY}", "DOUBLE", f"aggregate(sequence(0, size(g) - 1), DOUBLE(0), (a, k) -> a + if(k = 0, 1, -1) * abs(aggregate({_edges('array(g[k])')}, DOUBLE(0), (b, e) -> b + e.x1 * e.y2 - e.x2 * e.y1)) / 2)"),
    "st_astext": (
        f"g {GEOMETRY}", "STRING",
        "CASE WHEN st_is_point(g) THEN concat('POINT(', g[0][0].x, ' ', g[0][0].y, ')') ELSE concat('POLYGON(', array_join(transform(g, r -> concat('(', array_join(transform(r, p -> concat(p.x, ' ', p.y)), ', '), ')')), ', '), ')') END",
    ),
    "st_asgeojson": (
        f"g {GEOMETRY}", "STRING",
        """CASE WHEN st_is_point(g) THEN to_json(named_struct('type', 'Point', 'coordinates', array(g[0][0].x, g[0][0].y)))
            ELSE to_json(named_struct('type', 'Polygon', 'coordinates', transform(g, r -> transform(r, p -> array(p.x, p.y))))) END""",
    ),
    "st_covers_point": (f"g {GEOMETRY}, x DOUBLE, y DOUBLE", "BOOLEAN", f"{_odd('g', 'x', 'y')} OR {_on('g', 'x', 'y')}"),
    "st_holds_point": (f"g {GEOMETRY}, x DOUBLE, y DOUBLE", "BOOLEAN", f"{_odd('g', 'x', 'y')} AND NOT {_on('g', 'x', 'y')}"),
    "st_within": (f"a {GEOMETRY}, b {GEOMETRY}", "BOOLEAN", "CASE WHEN st_is_point(a) THEN st_holds_point(b, a[0][0].x, a[0][0].y) WHEN a IS NULL THEN NULL ELSE raise_error('ST_Within takes a point and a polygon') END"),
    "st_contains": (f"a {GEOMETRY}, b {GEOMETRY}", "BOOLEAN", "st_within(b, a)"),
    "st_intersects": (
        f"a {GEOMETRY}, b {GEOMETRY}", "BOOLEAN",
        f"""CASE WHEN st_is_point(a) AND st_is_point(b) THEN a[0][0] = b[0][0]
            WHEN st_is_point(a) THEN st_covers_point(b, a[0][0].x, a[0][0].y) WHEN st_is_point(b) THEN st_covers_point(a, b[0][0].x, b[0][0].y)
            ELSE exists(flatten(a), p -> {_odd('b', 'p.x', 'p.y')} OR {_on('b', 'p.x', 'p.y')}) OR exists(flatten(b), p -> {_odd('a', 'p.x', 'p.y')} OR {_on('a', 'p.x', 'p.y')})
              OR exists({_edges('a')}, e -> exists({_edges('b')}, f -> {_CROSS})) END""",
    ),
    # The point of b that is nearest to the point (px, py).
    "st_nearest": (
        f"px DOUBLE, py DOUBLE, b {GEOMETRY}", POINT,
        f"""CASE WHEN st_is_point(b) THEN b[0][0] WHEN st_covers_point(b, px, py) THEN named_struct('x', px, 'y', py)
            ELSE array_min(transform(array(cos(radians(py)) * (1 - {_E2}D * sin(radians(py)) * sin(radians(py))) / {1 - _E2}D), k -> array_min(transform({_edges('b')}, e -> transform(array(coalesce(least(greatest({_SHARE}, 0), 1), 0)), s -> named_struct(
              'd', pow((e.x1 + s * (e.x2 - e.x1) - px) * k, 2) + pow(e.y1 + s * (e.y2 - e.y1) - py, 2), 'p', named_struct('x', e.x1 + s * (e.x2 - e.x1), 'y', e.y1 + s * (e.y2 - e.y1))))[0])))).p END""",
    ),
    "st_near_ends": (
        f"a {GEOMETRY}, b {GEOMETRY}", f"STRUCT<a: {POINT}, b: {POINT}>",
        """CASE WHEN st_is_point(a) THEN named_struct('a', a[0][0], 'b', st_nearest(a[0][0].x, a[0][0].y, b)) WHEN st_is_point(b) THEN named_struct('a', b[0][0], 'b', st_nearest(b[0][0].x, b[0][0].y, a))
            WHEN a IS NULL OR b IS NULL THEN NULL ELSE raise_error('distances take a point at least on one side') END""",
    ),
    "st_spot": ("lon DOUBLE, lat DOUBLE", SPOT, _spot("lon", "lat", _root("lat"))),
    "st_arc_m": (f"p {SPOT}, q {SPOT}, square DOUBLE", "DOUBLE", _way()),
    "st_way_m": (f"p {SPOT}, q {SPOT}", "DOUBLE", f"st_arc_m(p, q, {chord('p', 'q')})"),
    # The ends of other geometries are long expressions, which a name holds in conditions too; null for two points.
    "st_far_m": (
        f"a {GEOMETRY}, b {GEOMETRY}", "DOUBLE",
        f"CASE WHEN NOT (st_is_point(a) AND st_is_point(b)) THEN {_let('s', 'st_near_ends(a, b)', _let('p', _let('r', _root('s.a.y'), _spot('s.a.x', 's.a.y')), _let('q', _let('r', _root('s.b.y'), _spot('s.b.x', 's.b.y')), _let('square', chord('p', 'q'), _way()))))} END",
    ),
    "st_either_m": (f"far DOUBLE, p {SPOT}, q {SPOT}", "DOUBLE", "coalesce(far, st_way_m(p, q))"),
    "st_distance": (f"a {GEOMETRY}, b {GEOMETRY}", "DOUBLE", "st_either_m(st_far_m(a, b), st_spot(get(get(a, 0), 0).x, get(get(a, 0), 0).y), st_spot(get(get(b, 0), 0).x, get(get(b, 0), 0).y))"),
    "st_dwithin": (f"a {GEOMETRY}, b {GEOMETRY}, metres DOUBLE", "BOOLEAN", "st_distance(a, b) <= metres"),
    # Cells of a grid that a geometry's box touches, grown by metres; columns go round the globe. lx, ly: the box's own first cell.
    "st_cells": (
        f"g {GEOMETRY}, columns INT, metres DOUBLE", "ARRAY<STRUCT<x: BIGINT, y: BIGINT, lx: BIGINT, ly: BIGINT>>",
        f"""array_distinct(flatten(transform(array(named_struct('w', st_xmin(g), 's', st_ymin(g), 'e', st_xmax(g), 'n', st_ymax(g), 'size', DOUBLE(360) / columns,
              'dy', metres / {110_000.0}, 'dx', least(DOUBLE(180), metres / ({110_000.0} * greatest(cos(radians(least(DOUBLE(90), greatest(abs(st_ymin(g)), abs(st_ymax(g))) + metres / {110_000.0}))), DOUBLE(1e-9)))))),
            b -> flatten(transform(sequence(floor((b.s - b.dy) / b.size), floor((b.n + b.dy) / b.size)), cy -> transform(sequence(floor((b.w - b.dx + 180) / b.size), floor((b.e + b.dx + 180) / b.size)),
              cx -> named_struct('x', pmod(cx, columns), 'y', cy, 'lx', floor((b.w - b.dx + 180) / b.size), 'ly', floor((b.s - b.dy) / b.size))))))))""",
    ),
}
# What a statement may call; the others serve these.
PUBLIC = [k for k in FUNCTIONS if k not in ("st_is_point", "st_covers_point", "st_holds_point", "st_nearest", "st_near_ends", "st_spot", "st_arc_m", "st_way_m", "st_far_m", "st_either_m", "st_cells")]


def register(spark: SparkSession) -> None:
    """All functions of this module as temporary functions of the session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
