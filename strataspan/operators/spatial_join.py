"""Joins by place: cells of a grid make them equi-joins, an exact test follows.

A polygon is posted to every cell its box touches, a point to its own cell, so no side
is broadcast and a hot cell is split by adaptive execution like any hot join key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

METRES_PER_DEGREE = 110_000.0  # a degree of latitude is longer anywhere


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _posted(boxes: DataFrame, size: float, w: Column, s: Column, e: Column, n: Column) -> DataFrame:
    return boxes.withColumn("cx", F.explode(F.sequence(_cell(w, size), _cell(e, size)))).withColumn("cy", F.explode(F.sequence(_cell(s, size), _cell(n, size))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell_degrees: float = 0.02, boundary: bool = False) -> DataFrame:
    """point_id, polygon_id, polygon_name for points (id, lon, lat) strictly inside rings
    (id, name, ring, minx..maxy); with ``boundary`` also on them."""
    left = points.select(F.col("id").alias("point_id"), "lon", "lat", _cell(F.col("lon"), cell_degrees).alias("cx"), _cell(F.col("lat"), cell_degrees).alias("cy"))
    right = polygons.select(F.col("id").alias("polygon_id"), F.col("name").alias("polygon_name"), "ring", "minx", "miny", "maxx", "maxy")
    right = _posted(right, cell_degrees, F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    lon, lat, ring = F.col("lon"), F.col("lat"), F.col("ring")
    test = geo.intersects(lon, lat, ring) if boundary else geo.within(lon, lat, ring)
    box = lon.between(F.col("minx"), F.col("maxx")) & lat.between(F.col("miny"), F.col("maxy"))
    return left.join(right, ["cx", "cy"]).filter(box & test).select("point_id", "polygon_id", "polygon_name")


def count_per_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """name, cnt of points strictly inside; polygons without points have no row."""
    return points_in_polygons(points, polygons).groupBy(F.col("polygon_name").alias("name")).agg(F.count("*").alias("cnt"))


def _columns(lat_cell: Column, high: float, metres: float) -> Column:
    """Into how many columns a band of latitude is divided, so that two are as wide as the
    radius even where points in reach are nearest to a pole; a band around a pole has one."""
    top = F.greatest(F.abs(lat_cell * high), F.abs((lat_cell + 1) * high)) + metres / METRES_PER_DEGREE
    width = metres / (2 * METRES_PER_DEGREE * F.cos(F.radians(F.least(top, F.lit(90.0)))))
    return F.when(top >= 90.0, F.lit(1)).otherwise(F.greatest(F.floor(360.0 / width), F.lit(1))).cast("long")


def _column(lon: Column, columns: Column) -> Column:
    """The column of a longitude, counted from the antimeridian."""
    return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * columns / 360.0).cast("long"), columns - 1)


def within_distance(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """left_id, right_id, distance_m for points (id, lon, lat) at most ``metres`` apart
    along the ellipsoid. Cells are half as high as the radius; a left point looks into its own
    and two cells around, across the antimeridian and the poles too. Pairs are told by their
    chord, from places that every point brings along; radii beyond ``geo.SHORT_M`` ask the
    ellipsoid for pairs whose chord isn't too long already. Cells are few bytes and much work,
    so tasks that read little aren't put together."""
    high, short, tasks = metres / METRES_PER_DEGREE / 2, metres <= geo.SHORT_M, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = [F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    places = [{c: F.col(f"{side}_{c}") for c in geo.SPOT} for side in "pq"]  # plain columns are read faster than structs
    carried = [[F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in geo.SPOT] for side in "pq"] if short else [ends[:2], ends[2:]]
    rows = left.select(F.col("id").alias("left_id"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    near = F.sequence(_cell(F.col("lat1"), high) - 2, _cell(F.col("lat1"), high) + 2)
    rows = rows.withColumn("p", geo.spot(*ends[:2])).withColumn("cy", F.explode(near)).withColumn("columns", _columns(F.col("cy"), high, metres))
    own = _column(F.col("lon1"), F.col("columns"))
    around = F.array_distinct(F.array(*[F.pmod(own + k, F.col("columns")) for k in range(-2, 3)]))
    rows = rows.withColumn("cx", F.explode(around)).select("left_id", *carried[0], "cx", "cy").repartition(tasks, "cx", "cy")
    other = right.select(F.col("id").alias("right_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).withColumn("cy", _cell(F.col("lat2"), high))
    other = other.withColumns({"cx": _column(F.col("lon2"), _columns(F.col("cy"), high, metres)), "q": geo.spot(*ends[2:])}).select("right_id", *carried[1], "cx", "cy").repartition(tasks, "cx", "cy")
    pairs = rows.join(other, ["cx", "cy"])
    if short:
        pairs, way = pairs.filter(geo.chord_of(*places) <= metres * metres), geo.short_way(*places)
    else:
        pairs, way = pairs.filter(geo.chord_m(*ends) <= metres), geo.geodesic_m(*ends)
    return pairs.select("left_id", "right_id", way.alias("distance_m")).filter(F.col("distance_m") <= metres)


def nearby(points: DataFrame, lon: float, lat: float, metres: float, kind: str = "", limit: int = 500) -> DataFrame:
    """The nearest points (id, name, type, lon, lat) of a kind ('' for any) within a radius."""
    dy = metres / METRES_PER_DEGREE
    top = abs(lat) + dy
    dx = 180.0 if top >= 90.0 else metres / (METRES_PER_DEGREE * math.cos(math.radians(top)))
    box = (F.abs(F.pmod(F.col("lon") - lon + 180.0, F.lit(360.0)) - 180.0) <= dx) & F.col("lat").between(lat - dy, lat + dy)
    ends = F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")
    wanted = points.filter(box & (geo.chord_m(*ends) <= metres) & (F.lit(kind == "") | (F.col("type") == kind)))
    return wanted.withColumn("distance_m", geo.geodesic_m(*ends)).filter(F.col("distance_m") <= metres).orderBy("distance_m", "id").limit(limit)


def covering_boxes(query: DataFrame, boxes: DataFrame, cell_degrees: float = 1.0) -> DataFrame:
    """All pairs of query boxes (query_id, qw, qs, qe, qn) and boxes (w, s, e, n, ...) that
    overlap, with the share of the query that is covered."""
    left = _posted(query, cell_degrees, F.col("qw"), F.col("qs"), F.col("qe"), F.col("qn"))
    right = _posted(boxes, cell_degrees, F.col("w"), F.col("s"), F.col("e"), F.col("n"))
    # a pair meets in several cells; it counts in the first that both have
    own = (F.col("cx") == F.greatest(_cell(F.col("qw"), cell_degrees), _cell(F.col("w"), cell_degrees))) & (
        F.col("cy") == F.greatest(_cell(F.col("qs"), cell_degrees), _cell(F.col("s"), cell_degrees))
    )
    ratio = geo.box_ratio(*(F.col(c) for c in ("qw", "qs", "qe", "qn", "w", "s", "e", "n")))
    return left.join(right, ["cx", "cy"]).filter(own).withColumn("ratio", ratio).filter("ratio > 0").drop("cx", "cy")
