"""Intersection, union and difference of polygons with holes, and repair of rings.

Edges are rows. Edges of the two polygons that share a grid cell are tested for crossings
and split there; a piece is kept when it lies on the right side of the other polygon, which
a count of the crossed edges in its band of latitude tells; coincident pieces are decided by
their directions. The area of the result is a sum over kept pieces, its rings are the
pieces linked end to end. Everything is joins and sums by key, so a polygon of any number of
edges is spread over tasks.

Coordinates are snapped to ``DIGITS`` decimal places first, and so are the crossings.

Defined cases: null and empty geometries have no edges (an intersection with one is empty, a
union is the other); rings are turned so that the inside is on the left, the first of a
geometry is its shell; edges without length are dropped; a key without kept pieces has no
row. Self-crossing rings are to be repaired first; repeated keys aren't allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import discard, materialise
from .polygons import assign_holes
from .ranking import closed_rings, corners, link_pieces

DIGITS = 9
_EDGE = ["x1", "y1", "x2", "y2"]


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def edges_of(geometries: DataFrame, keys: list[str], rings: str, side: str) -> DataFrame:
    """keys, side, edge, x1, y1, x2, y2: edges of snapped rings with the inside on the left."""
    flat = geometries.select(*keys, F.posexplode(rings).alias("r", "ring")).filter(F.size("ring") >= 4)
    snapped = F.transform("ring", lambda p: F.struct(F.round(p.x, DIGITS).alias("x"), F.round(p.y, DIGITS).alias("y")))
    turned = F.when((geo.signed_area(F.col("ring")) > 0) == (F.col("r") == 0), F.col("ring")).otherwise(F.reverse("ring"))
    flat = flat.withColumn("ring", snapped).withColumn("ring", turned)
    rows = flat.select(*keys, "r", F.posexplode(geo.edges(F.col("ring"))).alias("i", "e"))
    rows = rows.select(*keys, F.lit(side).alias("side"), (F.shiftleft(F.col("r").cast("long"), 32) + F.col("i")).alias("edge"), *[F.col(f"e.{c}").alias(c) for c in _EDGE])
    return rows.filter("x1 <> x2 or y1 <> y2")


def _grid(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ox, oy, size: a key's corner and cells so large that there are about as many as edges."""
    low = lambda c: F.min(F.least(f"{c}1", f"{c}2"))
    high = lambda c: F.max(F.greatest(f"{c}1", f"{c}2"))
    box = edges.groupBy(*keys).agg(low("x").alias("ox"), low("y").alias("oy"), F.greatest(high("x") - low("x"), high("y") - low("y")).alias("wide"), F.count("*").alias("n"))
    return box.select(*keys, "ox", "oy", F.greatest(F.col("wide") / F.ceil(F.sqrt("n")), F.lit(1e-9)).alias("size"))


def _cell(c: Column, origin: str) -> Column:
    return F.floor((c - F.col(origin)) / F.col("size"))


def _celled(edges: DataFrame) -> DataFrame:
    """Edges of a frame with its grid, once for each cell of their box; lx, ly: the first."""
    lx, ly = _cell(F.least("x1", "x2"), "ox"), _cell(F.least("y1", "y2"), "oy")
    hx, hy = _cell(F.greatest("x1", "x2"), "ox"), _cell(F.greatest("y1", "y2"), "oy")
    return edges.withColumns({"lx": lx, "ly": ly}).withColumn("cx", F.explode(F.sequence("lx", hx))).withColumn("cy", F.explode(F.sequence("ly", hy)))


def _cuts(a: DataFrame, b: DataFrame, keys: list[str], alone: bool) -> DataFrame:
    """keys, side, edge, x, y: where edges of two sides (or of one, with itself) meet."""
    other = b.select(*keys, F.col("side").alias("side_"), F.col("edge").alias("edge_"), *[F.col(c).alias(f"{c}_") for c in _EDGE], F.col("lx").alias("lx_"), F.col("ly").alias("ly_"), "cx", "cy")
    met = a.join(other, [*keys, "cx", "cy"]).filter("cx = greatest(lx, lx_) and cy = greatest(ly, ly_)" + (" and edge < edge_" if alone else ""))
    x1, y1, x2, y2, u1, v1, u2, v2 = (F.col(c) for c in (*_EDGE, *[f"{c}_" for c in _EDGE]))
    d = {
        "d1": _cross(x2 - x1, y2 - y1, u1 - x1, v1 - y1), "d2": _cross(x2 - x1, y2 - y1, u2 - x1, v2 - y1),
        "d3": _cross(u2 - u1, v2 - v1, x1 - u1, y1 - v1), "d4": _cross(u2 - u1, v2 - v1, x2 - u1, y2 - v1),
    }
    met = met.withColumns(d)
    t = F.col("d3") / (F.col("d3") - F.col("d4"))
    proper = (F.col("d1") * F.col("d2") < 0) & (F.col("d3") * F.col("d4") < 0)
    spot = lambda x, y: F.struct(F.round(x, DIGITS).alias("x"), F.round(y, DIGITS).alias("y"))

    def on(which: str, px: Column, py: Column, ends: tuple[Column, ...]) -> Column:
        ax, ay, bx, by = ends
        return F.when((F.col(which) == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by)), F.struct(px.alias("x"), py.alias("y")))

    crossing = F.when(proper, spot(x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
    mine = F.array(crossing, on("d1", u1, v1, (x1, y1, x2, y2)), on("d2", u2, v2, (x1, y1, x2, y2)))
    theirs = F.array(crossing, on("d3", x1, y1, (u1, v1, u2, v2)), on("d4", x2, y2, (u1, v1, u2, v2)))
    both = F.explode(F.array(F.struct("side", "edge", mine.alias("at")), F.struct(F.col("side_").alias("side"), F.col("edge_").alias("edge"), theirs.alias("at")))).alias("c")
    return met.select(*keys, both).select(*keys, "c.side", "c.edge", F.explode("c.at").alias("p")).filter("p is not null").select(*keys, "side", "edge", "p.x", "p.y").distinct()


def _pieces(edges: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side, x1, y1, x2, y2: edges split at their cuts, without pieces of no length."""
    by = [*keys, "side", "edge"]
    ends = edges.select(*by, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(*by, "p.x", "p.y")
    along = (F.col("x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    placed = cuts.unionByName(ends).distinct().join(edges.select(*by, *_EDGE), by).withColumn("along", along)
    w = Window.partitionBy(*by).orderBy("along", "x", "y")
    cut = placed.select(*keys, "side", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return cut.filter("x2 is not null and (x1 <> x2 or y1 <> y2)")


def _crossed(pieces: DataFrame, edges: DataFrame, grid: DataFrame, keys: list[str], beside: bool = False) -> DataFrame:
    """Pieces with n: how many edges of the other side a ray to the east of their middle
    crosses. ``beside``: among all pieces but itself, and to the north for level pieces."""
    level = (F.col("y1") == F.col("y2")) if beside else F.lit(False)
    mid = pieces.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2, "level": level})
    mid = mid.join(grid, keys).withColumn("band", F.when(F.col("level"), _cell(F.col("mx"), "ox")).otherwise(_cell(F.col("my"), "oy"))).drop("ox", "oy", "size")
    ways = [(False, "y", "oy"), (True, "x", "ox")][: 2 if beside else 1]
    spread = [edges.join(grid, keys).withColumn("band", F.explode(F.sequence(_cell(F.least(f"{c}1", f"{c}2"), o), _cell(F.greatest(f"{c}1", f"{c}2"), o)))).withColumn("level", F.lit(v)) for v, c, o in ways]
    posted = spread[0] if len(spread) == 1 else spread[0].unionByName(spread[1])
    posted = posted.select(*keys, "level", "band", *([F.col("side").alias("side_")] if not beside else []), *[F.col(c).alias(f"{c}_") for c in _EDGE])
    # level pieces look north: there x and y change places
    swap = lambda a, b: F.when(F.col("level"), F.col(b)).otherwise(F.col(a))
    px, py, ax, ay, bx, by_ = swap("mx", "my"), swap("my", "mx"), swap("x1_", "y1_"), swap("y1_", "x1_"), swap("x2_", "y2_"), swap("y2_", "x2_")
    hit = ((ay > py) != (by_ > py)) & (px < (bx - ax) * (py - ay) / (by_ - ay) + ax)
    if beside:
        hit &= ~((F.col("x1") == F.col("x1_")) & (F.col("y1") == F.col("y1_")) & (F.col("x2") == F.col("x2_")) & (F.col("y2") == F.col("y2_")))
    else:
        hit &= F.col("side") != F.col("side_")
    joined = mid.join(posted, [*keys, "level", "band"], "left")
    return joined.groupBy(*keys, *([] if beside else ["side"]), *_EDGE, "level").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("n"))


# Pieces of the first and of the second polygon that are kept: inside or outside of the other,
# coincident in the same or the opposite direction; whether the second's are turned round.
RULES = {
    "intersection": (True, "same", True, False),
    "union": (False, "same", False, False),
    "difference": (False, "opposite", True, True),
}


def overlay_pieces(pairs: DataFrame, keys: list[str], first: str, second: str, how: str) -> DataFrame:
    """keys, x1, y1, x2, y2: directed pieces of the result's border, each once."""
    inside_a, coincident, inside_b, turn = RULES[how]
    edges = materialise(edges_of(pairs, keys, first, "a").unionByName(edges_of(pairs, keys, second, "b")), "overlay-edges")
    grid = materialise(_grid(edges, keys), "overlay-grid")
    celled = _celled(edges.join(grid, keys))
    pieces = materialise(_pieces(edges, _cuts(celled.filter("side = 'a'"), celled.filter("side = 'b'"), keys, False), keys), "overlay-pieces")
    swapped = pieces.select(*keys, "side", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    other = lambda df, name: df.filter("side = 'b'").select(*keys, *_EDGE, F.lit("a").alias("side"), F.lit(name).alias("met")).unionByName(df.filter("side = 'a'").select(*keys, *_EDGE, F.lit("b").alias("side"), F.lit(name).alias("met")))
    met = other(pieces, "same").unionByName(other(swapped, "opposite")).groupBy(*keys, "side", *_EDGE).agg(F.min("met").alias("met"))
    marked = pieces.join(met, [*keys, "side", *_EDGE], "left")
    counted = _crossed(marked.filter("met is null"), edges, grid, keys)
    inside = F.col("n") % 2 == 1
    kept = counted.filter(F.when(F.col("side") == "a", inside == inside_a).otherwise(inside == inside_b)).select(*keys, "side", *_EDGE)
    kept = kept.unionByName(marked.filter((F.col("side") == "a") & (F.col("met") == coincident)).select(*keys, "side", *_EDGE))
    back = (F.col("side") == "b") & F.lit(turn)
    flip = {c: F.when(back, F.col(o)).otherwise(F.col(c)) for c, o in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    out = materialise(kept.select(*keys, *[v.alias(c) for c, v in flip.items()]).distinct(), "overlay-border")
    discard(edges, grid, pieces)
    return out


def _packed(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Keys as one struct ``key_``, so that their names can't clash; rows without a key are left out."""
    return df.dropna(subset=keys).select(F.struct(*keys).alias("key_"), *[F.col(c).alias(f"rings_{i}") for i, c in enumerate(columns)])


def overlay_areas(pairs: DataFrame, keys: list[str], first: str, second: str, how: str) -> DataFrame:
    """keys, area of each pair's intersection, union or difference; keys with none have no row."""
    return _areas(overlay_pieces(_packed(pairs, keys, first, second), ["key_"], "rings_0", "rings_1", how))


def _areas(border: DataFrame) -> DataFrame:
    near = border.join(border.groupBy("key_").agg(F.min("x1").alias("ox"), F.min("y1").alias("oy")), "key_")
    part = _cross(F.col("x1") - F.col("ox"), F.col("y1") - F.col("oy"), F.col("x2") - F.col("ox"), F.col("y2") - F.col("oy"))
    return near.groupBy("key_").agg((F.sum(part) / 2).alias("area")).select("key_.*", "area")


def _polygons(border: DataFrame) -> DataFrame:
    rings = closed_rings(corners(link_pieces(border, ["key_"]), ["key_"]), ["key_"])
    rings = materialise(rings.withColumn("outer", geo.signed_area(F.col("ring")) > 0), "overlay-rings")
    shells = rings.filter("outer").select("key_", F.col("id").alias("shell"), "ring")
    holes = rings.filter("not outer").select("key_", F.col("id").alias("hole"), "ring")
    return assign_holes(shells, holes, "key_").select("key_.*", "ring", "holes")


def overlay(pairs: DataFrame, keys: list[str], first: str, second: str, how: str) -> DataFrame:
    """keys, ring, holes: the polygons of each pair's intersection, union or difference."""
    return _polygons(overlay_pieces(_packed(pairs, keys, first, second), ["key_"], "rings_0", "rings_1", how))


def repair_pieces(rings: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, x1, y1, x2, y2: the border of what rings enclose an odd number of times, the inside on the left."""
    edges = materialise(edges_of(rings, keys, column, "a"), "repair-edges")
    grid = materialise(_grid(edges, keys), "repair-grid")
    celled = _celled(edges.join(grid, keys))
    pieces = _pieces(edges, _cuts(celled, celled, keys, True), keys)
    low = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")) <= F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    one_way = pieces.select(*keys, *[F.when(low, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])
    once = materialise(one_way.groupBy(*keys, *_EDGE).agg(F.count("*").alias("times")).filter("times % 2 = 1").drop("times"), "repair-pieces")
    counted = _crossed(once, once, grid, keys, beside=True)
    # An even number of crossings: outside lies on the ray's side. Upright pieces look east, level ones north.
    outside_ahead = F.col("n") % 2 == 0
    up = F.when(F.col("level"), F.col("x2") < F.col("x1")).otherwise(F.col("y2") > F.col("y1"))
    keep = outside_ahead == up
    out = materialise(counted.select(*keys, *[F.when(keep, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]), "repair-border")
    discard(edges, grid, once)
    return out


def repair(rings: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, ring, holes: valid polygons from rings that cross or touch themselves or each other (``column``: array of rings)."""
    return _polygons(repair_pieces(_packed(rings, keys, column), ["key_"], "rings_0"))


def repaired_areas(rings: DataFrame, keys: list[str], column: str) -> DataFrame:
    return _areas(repair_pieces(_packed(rings, keys, column), ["key_"], "rings_0"))
