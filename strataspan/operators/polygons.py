"""Polygons with holes, the ring that stands for a name, and raster bounds in degrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def inner_point(ring: Column) -> Column:
    """A point inside a ring: the middle of the widest stretch on the line at half height."""
    ys = F.transform(ring, lambda p: p.y)
    y = (F.array_min(ys) + F.array_max(ys)) / 2

    def widest(mid: Column) -> Column:
        cut = F.filter(geo.edges(ring), lambda e: (e.y1 > mid) != (e.y2 > mid))
        xs = F.sort_array(F.transform(cut, lambda e: e.x1 + (mid - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("width"), (F.get(xs, 2 * i) + F.get(xs, 2 * i + 1)).alias("sum")))
        return geo.let(F.array_max(pairs), lambda p: F.when(p["sum"].isNotNull(), geo.point(p["sum"] / 2, mid)))

    return geo.let(y, widest)


def assign_holes(shells: DataFrame, holes: DataFrame, key: str) -> DataFrame:
    """key, shell, ring, holes: each hole (key, hole, ring) goes to the smallest shell
    (key, shell, ring) of its key that contains a point inside it. Shells without holes have
    an empty array; holes in no shell, null rings and null keys of holes are left out."""
    inner = holes.select(key, "hole", F.col("ring").alias("hole_ring"), inner_point(F.col("ring")).alias("at")).filter("at is not null")
    place = shells.select(key, "shell", "ring", geo.area(F.col("ring")).alias("size"))
    hits = inner.join(place, key).filter(geo.within(F.col("at.x"), F.col("at.y"), F.col("ring")))
    owner = hits.groupBy(key, "hole").agg(F.min_by(F.struct("shell", "hole_ring"), F.struct("size", "shell")).alias("own"))
    owned = owner.groupBy(key, F.col("own.shell").alias("shell")).agg(F.sort_array(F.collect_list(F.struct("hole", F.col("own.hole_ring").alias("ring")))).alias("holes"))
    out = shells.select(key, "shell", "ring").join(owned, [key, "shell"], "left")
    return out.select(key, "shell", "ring", F.coalesce(F.transform("holes", lambda h: h.ring), F.slice(F.array("ring"), 1, 0)).alias("holes"))


def area_with_holes(ring: Column, holes: Column) -> Column:
    return geo.area(ring) - F.aggregate(holes, F.lit(0.0), lambda sum_, hole: sum_ + geo.area(hole))


def choose_ring(rings: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Per key the ring that contains its label point (columns ``x``, ``y``), else the largest;
    of several the largest, then the smallest id."""
    inside = F.coalesce(geo.within(F.col(x), F.col(y), F.col("ring")), F.lit(False))
    best = F.max_by(F.struct("id", "ring"), F.struct(inside.cast("int"), geo.area(F.col("ring")), -F.col("id")))
    return rings.groupBy(*key).agg(best.alias("best"), F.max(inside).alias("contains")).select(*key, "best.*", "contains")


def bounds_in_degrees(w: Column, s: Column, e: Column, n: Column, inverse: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The box of the four corners of projected bounds."""
    corners = [inverse(x, y) for x in (w, e) for y in (s, n)]
    lons, lats = ([c[i] for c in corners] for i in (0, 1))
    return F.struct(F.least(*lons).alias("w"), F.least(*lats).alias("s"), F.greatest(*lons).alias("e"), F.greatest(*lats).alias("n"))


def best_scenes(covered: DataFrame, least: float = 0.1, k: int = 5) -> DataFrame:
    """query_id, id, ratio, place: the k scenes of each query that cover most of it, and at
    least a tenth; equal ones by id. Spark keeps k rows per task before it shuffles."""
    by = Window.partitionBy("query_id").orderBy(F.desc("ratio"), "id")
    return covered.filter(F.col("ratio") >= least).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def extents(scenes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Per collection its dates, clouds, number of distinct boxes and sorted union of bands;
    and the distinct boxes as rows, since their number grows with the scenes."""
    boxes = scenes.select(key, "w", "s", "e", "n").distinct()
    bands = scenes.select(key, "bands").distinct().select(key, F.explode("bands").alias("band")).groupBy(key).agg(F.sort_array(F.collect_set("band")).alias("bands"))
    range_ = scenes.groupBy(key).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min("cloud").alias("cloud_min"), F.max("cloud").alias("cloud_max"))
    return range_.join(boxes.groupBy(key).agg(F.count("*").alias("n_boxes")), key).join(bands, key, "left"), boxes


def region_titles(regions: DataFrame, known: DataFrame) -> DataFrame:
    """region, title, description; a region that isn't known gets generated ones."""
    out = regions.join(known.dropDuplicates(["region"]), "region", "left")
    return out.select("region", F.coalesce("title", F.initcap("region")).alias("title"), F.coalesce("description", F.concat(F.lit("Scenes of "), "region")).alias("description"))
