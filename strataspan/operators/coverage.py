"""Simplification of a coverage: polygons that share borders keep sharing them.

Borders are split at every corner that any polygon has there, so that a shared stretch is the
same segments on both sides. Segments between two junctions (corners where other than two
segments meet, or where the owners change) are an arc; every arc is simplified once and each
owner's border is put together from its arcs. Segments are ordered by list ranking: a chain
with ends is walked there and back, which makes it a ring.

A simplified arc that crosses or covers another gets half the tolerance, until none does.

Defined cases: null and empty geometries have no border and give no row; a polygon that
falls apart or vanishes isn't possible, as arcs keep their ends and loops four points;
owners must have distinct, orderable ids. Polygons that overlap keep their overlaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise
from .cartography import simplify
from .overlay import _areas, _celled, _cuts, _grid, _pieces, _polygons, edges_of
from .ranking import rank_rings

_ENDS = ["x1", "y1", "x2", "y2"]
_BACK = ["x2", "y2", "x1", "y1"]


def borders(polygons: DataFrame, owner: str, rings: str) -> DataFrame:
    """owner, x1, y1, x2, y2: directed border segments, split at all corners that lie on them."""
    edges = edges_of(polygons.select(F.lit(0).alias("key_"), F.col(owner).alias("owner"), rings), ["key_", "owner"], rings, "")
    edges = materialise(edges.select("key_", F.col("owner").alias("side"), F.struct("owner", "edge").alias("edge"), *_ENDS), "coverage-edges")
    celled = _celled(edges.join(_grid(edges, ["key_"]), "key_"))
    out = materialise(_pieces(edges, _cuts(celled, celled, ["key_"], True), ["key_"]).select(F.col("side").alias("owner"), *_ENDS).distinct(), "coverage-borders")
    discard(edges)
    return out


def arcs_of(segments: DataFrame) -> DataFrame:
    """arc, pos, x1, y1, x2, y2, of directed border segments (owner, x1, y1, x2, y2): each
    undirected segment once, in the order and direction of its arc."""
    forward = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")) < F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    flat = segments.select("owner", *[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_ENDS, _BACK, strict=True)])
    once = flat.groupBy(*_ENDS).agg(F.sort_array(F.collect_set("owner")).alias("owners"))
    half = once.select(*_ENDS, "owners").unionByName(once.select(*[F.col(b).alias(a) for a, b in zip(_ENDS, _BACK, strict=True)], "owners"))
    half = materialise(half.select(F.struct(*_ENDS).alias("id"), F.struct(*[F.col(b).alias(a) for a, b in zip(_ENDS, _BACK, strict=True)]).alias("twin"), *_ENDS, "owners"), "coverage-halves")
    corner = half.groupBy("x1", "y1").agg(((F.count("*") != 2) | (F.count_distinct("owners") > 1)).alias("junction"))
    corner = materialise(corner, "coverage-corners")
    onward = half.select(F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("on"))
    ends = half.select("id", "twin", "x2", "y2").join(corner.select(F.col("x1").alias("x2"), F.col("y1").alias("y2"), "junction"), ["x2", "y2"])
    links = ends.filter("junction").select("id", F.col("twin").alias("next"))
    links = links.unionByName(ends.filter("not junction").join(onward, ["x2", "y2"]).filter("on <> twin").select("id", F.col("on").alias("next")))
    ranked = materialise(rank_rings(links, []).select("id", "ring", "pos", F.least("id", F.struct(*[F.col(f"id.{b}").alias(a) for a, b in zip(_ENDS, _BACK, strict=True)])).alias("flat")), "coverage-ranked")
    started = ranked.join(corner.select(F.struct("x1", "y1").alias("at"), "junction"), F.struct("id.x1", "id.y1") == F.col("at"))
    whole = started.groupBy("ring").agg(F.count("*").alias("n"), F.max("junction").alias("open"), F.min(F.when(F.col("junction"), F.struct("id", "pos"))).alias("start"), F.min("flat").alias("least"))
    placed = ranked.join(whole, "ring").withColumn("p", F.when(F.col("open"), F.pmod(F.col("pos") - F.col("start.pos"), F.col("n"))).otherwise(F.col("pos")))
    # Of a chain its way there, of a loop the direction that walks its least segment forward.
    kept = placed.filter("open and p < n / 2 or not open and ring = least")
    out = materialise(kept.select(F.to_json(F.coalesce("start.id", "ring")).alias("arc"), F.col("p").alias("pos"), *[F.col(f"id.{c}").alias(c) for c in _ENDS]), "coverage-arcs")
    discard(half, corner, ranked)
    return out


def _segments(lines: DataFrame) -> DataFrame:
    """key_, side, edge, x1, y1, x2, y2 of the arcs' lines (arc, line)."""
    each = lines.select("arc", "line", F.explode(F.sequence(F.lit(1), F.size("line") - 1)).alias("i"))
    at = lambda k, c: F.get("line", F.col("i") - k)[c]
    return each.select(F.lit(0).alias("key_"), F.col("arc").alias("side"), F.struct("arc", "i").alias("edge"), at(1, "x").alias("x1"), at(1, "y").alias("y1"), at(0, "x").alias("x2"), at(0, "y").alias("y2"))


def _tangled(lines: DataFrame) -> DataFrame:
    """Arcs with segments that meet another segment inside, or that cover one."""
    segments = materialise(_segments(lines), "coverage-check")
    celled = _celled(segments.join(_grid(segments, ["key_"]), "key_"))
    cuts = _cuts(celled, celled, ["key_"], True).join(segments, ["key_", "side", "edge"])
    inside = cuts.filter("not (x = x1 and y = y1) and not (x = x2 and y = y2)").select(F.col("side").alias("arc"))
    low = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    high = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    twice = segments.withColumn("both", F.struct(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")))
    doubled = twice.join(twice.groupBy("both").agg(F.count("*").alias("n")).filter("n > 1").select("both"), "both").select(F.col("side").alias("arc"))
    out = materialise(inside.unionByName(doubled).distinct(), "coverage-tangled")
    discard(segments)
    return out


def simplify_arcs(arcs: DataFrame, tolerance: float) -> DataFrame:
    """arc, line: every arc simplified; none meets another but at its ends."""
    step = F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("a"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("b"))))
    line = arcs.groupBy("arc").agg(step.alias("s")).select("arc", F.concat(F.transform("s", lambda s: s.a), F.array(F.element_at("s", -1).b)).alias("whole"), F.lit(float(tolerance)).alias("tolerance"))
    whole = materialise(line, "coverage-lines")
    now = whole
    while True:
        thin = materialise(simplify(now.withColumn("line", F.col("whole")), "line", "tolerance"), "coverage-thin")
        bad = _tangled(thin.select("arc", "line"))
        if bad.isEmpty() or thin.join(bad, "arc").filter("tolerance > 0").isEmpty():
            return thin.select("arc", "line")
        half = F.when(F.col("tolerance") > 1e-9, F.col("tolerance") / 2).otherwise(0.0)
        now = materialise(thin.join(bad.withColumn("bad", F.lit(True)), "arc", "left").select("arc", "whole", F.when(F.col("bad"), half).otherwise(F.col("tolerance")).alias("tolerance")), "coverage-lines")


def simplified_borders(polygons: DataFrame, owner: str, rings: str, tolerance: float) -> DataFrame:
    """owner, x1, y1, x2, y2: directed border segments after simplification, the owner on the left."""
    own = borders(polygons, owner, rings)
    arcs = arcs_of(own)
    thin = simplify_arcs(arcs, tolerance)
    # The owners of an arc and whether they walk it in its own direction, by its first segment.
    first = arcs.filter("pos = 0").select("arc", *_ENDS)
    same = own.join(first, _ENDS).select("owner", "arc", F.lit(True).alias("along"))
    against = own.join(first.select("arc", *[F.col(b).alias(a) for a, b in zip(_ENDS, _BACK, strict=True)]), _ENDS).select("owner", "arc", F.lit(False).alias("along"))
    walked = same.unionByName(against).join(_segments(thin).select(F.col("side").alias("arc"), *_ENDS), "arc")
    out = materialise(walked.select("owner", *[F.when(F.col("along"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_ENDS, _BACK, strict=True)]), "coverage-simplified")
    discard(own, arcs)
    return out


def simplify_coverage(polygons: DataFrame, owner: str, rings: str, tolerance: float) -> DataFrame:
    """owner, ring, holes of all polygons (``rings``: arrays of rings) with their borders simplified together."""
    border = simplified_borders(polygons, owner, rings, tolerance)
    return _polygons(border.select(F.struct(F.col("owner").alias(owner)).alias("key_"), *_ENDS))


def simplified_areas(polygons: DataFrame, owner: str, rings: str, tolerance: float) -> DataFrame:
    """owner, area, segments after simplification."""
    border = simplified_borders(polygons, owner, rings, tolerance).select(F.struct(F.col("owner").alias(owner)).alias("key_"), *_ENDS)
    counts = border.groupBy("key_").agg(F.count("*").alias("segments")).select("key_.*", "segments")
    return _areas(border).join(counts, owner)
