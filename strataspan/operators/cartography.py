"""Map output: simplified shapes and labels that don't collide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import materialise
from .ranking import rank_rings

# A label's font in pixels, width and height of a character in fonts, gap to the
# point and half a marker in pixels; sides in order with the direction of the label.
FONT = 11
CHAR_W, LINE_H, GAP, MARKER = FONT * 1.05, FONT * 1.2, 3.0, 2.0
SIDES = [("top-right", 1, 1), ("left", 1, 0), ("bottom-right", 1, -1), ("top", 0, 1), ("top-left", -1, 1), ("right", -1, 0), ("bottom-left", -1, -1), ("bottom", 0, -1)]


def thin_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Positions kept by Douglas-Peucker, with a stack instead of recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q, m = points[a], points[b], points[a + 1 : b]
        d = q - p
        length = np.hypot(*d)
        far = np.abs(d[0] * (m[:, 1] - p[1]) - d[1] * (m[:, 0] - p[0])) / length if length else np.hypot(*(m - p).T)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep)


def thin_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring is cut at its two ends farthest apart from the start; it keeps four points at least."""
    far = int(np.hypot(*(points - points[0]).T).argmax())
    if far in (0, len(points) - 1):
        return np.arange(len(points))
    kept = np.concatenate([thin_line(points[: far + 1], tolerance), far + thin_line(points[far:], tolerance)[1:]])
    return kept if len(kept) >= 4 else np.arange(len(points))


def crosses_itself(points: np.ndarray) -> bool:
    """Whether two sides of a line or ring that aren't neighbours meet."""
    a, b = points[:-1], points[1:]
    closed = (points[0] == points[-1]).all()

    def side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    for i in range(len(a) - 2):
        far = slice(i + 2, len(a) - 1 if closed and i == 0 else len(a))
        c, d = a[far], b[far]
        near = (np.maximum(a[i], b[i]) >= np.minimum(c, d)).all(1) & (np.minimum(a[i], b[i]) <= np.maximum(c, d)).all(1)
        if (near & (side(a[i], b[i], c) * side(a[i], b[i], d) <= 0) & (side(c, d, a[i]) * side(c, d, b[i]) <= 0)).any():
            return True
    return False


def thin_safely(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Like thin_ring and thin_line, but the result doesn't cross itself where the original
    doesn't: the tolerance is halved until it holds, at last all points stay."""
    thin = thin_ring if (points[0] == points[-1]).all() else thin_line
    while tolerance > 0:
        kept = thin(points, tolerance)
        if len(kept) == len(points) or not crosses_itself(points[kept]):
            return kept
        tolerance = tolerance / 2 if tolerance > 1e-12 else 0.0
    return np.arange(len(points))


def simplify(shapes: DataFrame, column: str, tolerance: str) -> DataFrame:
    """Rings (or open lines) with points closer than the row's tolerance dropped; none crosses
    itself for that."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for ring, tol in zip(f[column], f[tolerance], strict=True):
                if ring is None or len(ring) < 3:
                    out.append(ring)
                    continue
                xy = np.array([(p["x"], p["y"]) for p in ring])
                kept = thin_safely(xy, tol)
                out.append([ring[i] for i in kept])
            yield f.assign(**{column: out})

    return shapes.mapInPandas(run, shapes.schema)


def generalise(polygons: DataFrame, zoom: float, latitude: float, pixels: float = 1.0, least_pixels: float = 3.0) -> DataFrame:
    """Polygons (ring in metres) that are visible at a zoom, simplified to a pixel."""
    mpp = geo.METRES_PER_PIXEL_Z0 * float(np.cos(np.radians(latitude))) / 2**zoom
    shown = polygons.filter(geo.area(F.col("ring")) >= (least_pixels * mpp) ** 2)
    return simplify(shown.withColumn("tolerance", F.lit(pixels * mpp)), "ring", "tolerance").drop("tolerance")


def _cells(boxes: DataFrame, view: list[str], *keep: str) -> DataFrame:
    """A row for each grid cell that a box (x0, y0, x1, y1) reaches."""
    w, h = F.col("mpp") * CHAR_W * 4, F.col("mpp") * LINE_H
    span = lambda lo, hi, size: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    wide = boxes.select(*view, *keep, "y0", "y1", "mpp", F.explode(span("x0", "x1", w)).alias("cx"))
    return wide.select(*view, *keep, "cx", F.explode(span("y0", "y1", h)).alias("cy"))


def _candidates(features: DataFrame) -> DataFrame:
    """Each feature with the boxes of its label on all sides."""
    w, h, g = F.length("name") * CHAR_W * F.col("mpp"), F.col("mpp") * LINE_H, F.col("mpp") * GAP

    def low(at: str, direction: int, size: Column) -> Column:
        return F.col(at) + {1: g, -1: -g - size, 0: -size / 2}[direction]

    boxes = [F.struct(F.lit(i).alias("turn"), F.lit(side).alias("side"), low("x", dx, w).alias("x0"), low("y", dy, h).alias("y0")) for i, (side, dx, dy) in enumerate(SIDES)]
    out = features.withColumn("box", F.explode(F.array(*boxes))).select(*features.columns, "box.*")
    return out.withColumns({"x1": F.col("x0") + w, "y1": F.col("y0") + h})


def place_labels(features: DataFrame, view: list[str], mpp: Column | float) -> DataFrame:
    """view, name, x, y, side and box of the labels that fit: in each view by priority, area
    (large first) and name, each on the first of eight sides where its box meets no marker
    and no label before it; boxes that only touch don't meet.

    Features have view columns, name, x, y, priority, area. Boxes are posted to grid cells.
    In every round a label settles on its first free side if it comes first in all cells of
    that side's box; sides that a settled box covers are lost to later labels. So far-away
    labels settle at once, a view needs no single task, and a cell holds few settled boxes.
    Rows without a name only mark their point; equal rows are one; rows without a view are left out."""
    own = mpp if isinstance(mpp, Column) else F.lit(mpp)
    slim = features.dropna(subset=view).select(*view, "name", "x", "y", "priority", F.coalesce(F.col("area").cast("double"), F.lit(0.0)).alias("area"), own.cast("double").alias("mpp")).distinct()
    r = F.col("mpp") * MARKER
    points = slim.select(*view, "mpp", "x", "y").distinct().select(*view, "mpp", (F.col("x") - r).alias("x0"), (F.col("y") - r).alias("y0"), (F.col("x") + r).alias("x1"), (F.col("y") + r).alias("y1"))
    named = slim.filter("name <> ''").withColumn("place", F.struct("priority", (-F.col("area")).alias("less"), "name", "x", "y"))
    box = ["x0", "y0", "x1", "y1"]
    key = [*view, "place", "turn"]
    cell = [*view, "cx", "cy"]

    def without_hits(free: DataFrame, taken: DataFrame, later: bool) -> DataFrame:
        """The candidates that meet none of the taken boxes."""
        other = _cells(taken, view, *(["place"] if later else []), *box).select(*cell, F.struct(*(["place"] if later else []), *box).alias("t"))
        here = _cells(free, view, "place", "turn", *box)
        hit = here.join(other, cell).filter("x0 < t.x1 and t.x0 < x1 and y0 < t.y1 and t.y0 < y1" + (" and place > t.place" if later else ""))
        return free.join(hit.select(*key).distinct(), key, "left_anti")

    free = materialise(without_hits(_candidates(named), points, False), "label-free")
    placed = materialise(free.limit(0), "labels")
    while not free.isEmpty():
        tried = free.groupBy(*view, "place").agg(F.min("turn").alias("turn"))
        tried = free.join(tried, [*view, "place", "turn"])
        firsts = _cells(free, view, "place").groupBy(*cell).agg(F.min("place").alias("first"))
        blocked = _cells(tried, view, "place").join(firsts, cell).filter("first <> place").select(*view, "place").distinct()
        settled = materialise(tried.join(blocked, [*view, "place"], "left_anti"), "labels")
        placed = placed.unionByName(settled)
        rest = free.join(settled.select(*view, "place"), [*view, "place"], "left_anti")
        free = materialise(without_hits(rest, settled, True), "label-free")
    return placed.select(*view, "name", "x", "y", "side", *box)


def assemble_rings(parts: DataFrame, key: str) -> DataFrame:
    """key, ring: closed rings of lines (key, line) that meet at their ends; open chains and
    rings without area are dropped. Where more than two lines end, they are taken in pairs.

    A line can be walked both ways, so it is two arcs; arcs are ordered by list ranking and
    of each ring's two directions the one is kept that walks its first line forward."""
    own, key = key, "key_"  # its name can't clash then
    lines = parts.filter(F.size("line") > 1).select(F.col(own).alias(key), "line", F.monotonically_increasing_id().alias("no"), F.get("line", F.lit(0)).alias("a"), F.element_at("line", -1).alias("b"))
    lines = materialise(lines, "ring-lines")
    ends = lines.filter("a <> b").select(key, "no", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at")), F.struct(F.lit(1).alias("side"), F.col("b").alias("at")))).alias("e")).select(key, "no", "e.*")
    ranked = ends.withColumn("rn", F.row_number().over(Window.partitionBy(key, "at").orderBy("no", "side")) - 1)
    partner = ranked.select(key, "at", F.col("rn").bitwiseXOR(F.lit(1)).alias("rn"), (F.col("no") * 2 + F.col("side")).alias("next"))
    # arriving at the end (side 1) walks forward, at the start backward; the next line starts where its end lies
    links = ranked.join(partner, [key, "at", "rn"]).select(key, (F.col("no") * 2 + 1 - F.col("side")).alias("id"), "next")
    arcs = rank_rings(links, [key])
    first = arcs.groupBy(key, "ring").agg(F.min(F.shiftright("id", 1)).alias("first")).filter("ring = 2 * first").select(key, "ring")
    walked = arcs.join(first, [key, "ring"]).withColumn("no", F.shiftright("id", 1)).join(lines.select(key, "no", "line"), [key, "no"])
    way = F.when(F.col("id") % 2 == 0, F.col("line")).otherwise(F.reverse("line"))
    step = F.struct("pos", F.slice(way, F.lit(1), F.size("line") - 1).alias("p"))
    joined = walked.groupBy(key, "ring").agg(F.flatten(F.transform(F.sort_array(F.collect_list(step)), lambda s: s.p)).alias("r"))
    rings = joined.select(key, F.concat("r", F.slice("r", 1, 1)).alias("ring")).unionByName(lines.filter("a = b").select(key, F.col("line").alias("ring")))
    return rings.filter((F.size("ring") > 3) & (geo.area(F.col("ring")) > 1e-6)).withColumnRenamed(key, own)
