"""Map layers as GeoJSON rows: changes, labels, points, polygons and grids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.files import feature, point_geometry, write_features
from ..storage import discard, materialise
from .patches import outlines
from .polygons import assign_holes

# Colours of the kinds of change, digits of coordinates.
CHANGE_COLORS = {"gain": "#E6323C", "loss": "#3C78EB"}
DIGITS = 6


def _rounded(x: Column, y: Column) -> Column:
    return F.array(F.round(x, DIGITS), F.round(y, DIGITS))


def change_patches(kept: DataFrame, keys: list[str], west: float, north: float, degrees: float) -> DataFrame:
    """keys, patch, px, no, ring, holes in degrees of patches of pixels (keys, patch, px, row,
    col). Pixels that meet in corners only make several outer rings, each a row with its own holes."""
    degree = lambda p: geo.point(F.lit(west) + p.x * degrees, F.lit(north) - p.y * degrees)
    kept = materialise(kept.select(*keys, "patch", "px", "row", "col"), "change-kept")
    rings = outlines(kept, keys).select(F.struct(*keys, "patch", "px").alias("owner"), "rings", F.posexplode("rings").alias("no", "ring"))
    same_turn = F.signum(geo.signed_area(F.col("ring"))) == F.signum(geo.signed_area(F.col("rings")[0]))  # the first is the largest
    rings = materialise(rings.select("owner", "no", "ring", same_turn.alias("is_shell")), "change-rings")
    discard(kept)
    shells = rings.filter("is_shell").select("owner", F.col("no").alias("shell"), "ring")
    holes = rings.filter("not is_shell").select("owner", F.col("no").alias("hole"), "ring")
    out = assign_holes(shells, holes, "owner")
    return out.select("owner.*", F.col("shell").alias("no"), F.transform("ring", degree).alias("ring"), F.transform("holes", lambda h: F.transform(h, degree)).alias("holes"))


def change_features(patches: DataFrame, pixel_m2: float, theme: str, period: str) -> DataFrame:
    """patch, kind, area_m2, feature: ``patches`` of a kind (gain or loss) as GeoJSON. A patch is
    one feature, a polygon or several; its area is that of its pixels, so that areas add up
    to the counted change."""
    loop = lambda r: F.transform(r, lambda p: _rounded(p.x, p.y))
    part = F.concat(F.array(loop(F.col("ring"))), F.transform("holes", loop))
    parts = patches.groupBy("kind", "patch", "px").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", part.alias("p")))), lambda s: s.p).alias("parts"))
    area = F.round(F.col("px") * pixel_m2, 2)
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts").alias("coordinates"))
    kind = F.create_map(*[F.lit(v) for pair in CHANGE_COLORS.items() for v in pair])
    return parts.select("patch", "kind", area.alias("area_m2"), feature(shape, kind=F.col("kind"), theme=F.lit(theme), period=F.lit(period), area_m2=area, color=kind[F.col("kind")]).alias("feature"))


def write_overlay(features: DataFrame, root: str, theme: str, at: str) -> str:
    """Write features below ``root`` under a name of time (eight and six digits) and theme;
    an overlay of that name isn't overwritten. Returns the name."""
    if not re.fullmatch(r"\d{8}_\d{6}", at) or not re.fullmatch(r"\w+", theme):
        raise ValueError(f"not a time and a theme: {at!r}, {theme!r}")
    name = f"overlay_{at}_{theme}.geojson"
    write_features(features, f"{root.rstrip('/')}/{name}")
    return name


def label_features(placed: DataFrame, view: list[str]) -> DataFrame:
    """view, name, feature of placed labels (x, y in Mercator metres, side, class, priority)."""
    lon, lat = geo.mercator_lon(F.col("x")), geo.mercator_lat(F.col("y"))
    at = F.struct(F.lit("Point").alias("type"), _rounded(lon, lat).alias("coordinates"))
    props = {"name": F.col("name"), "class": F.col("class"), "priority": F.col("priority"), "anchor": F.col("side")}
    return placed.select(*view, "name", feature(at, **props).alias("feature"))


def grid_features(cells: DataFrame, value: str) -> DataFrame:
    """feature: boxes (w, s, e, n) with a value of four digits; cells without one are left out."""
    ring = geo.box_ring(*[F.col(c) for c in "wsen"])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: _rounded(p.x, p.y))).alias("coordinates"))
    return cells.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(feature(shape, **{value: F.round(value, 4)}).alias("feature"))


def point_features(points: DataFrame) -> DataFrame:
    """class, feature of points (name, class, lon, lat)."""
    at = point_geometry(F.round("lon", DIGITS), F.round("lat", DIGITS))
    return points.dropna(subset=["lon", "lat"]).select("class", feature(at, name=F.col("name"), **{"class": F.col("class")}).alias("feature"))


def polygon_features(polygons: DataFrame) -> DataFrame:
    """class, feature of polygons (name, class, ring); those without a ring are left out."""
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: _rounded(p.x, p.y))).alias("coordinates"))
    return polygons.filter("ring is not null").select("class", feature(shape, name=F.col("name"), **{"class": F.col("class")}).alias("feature"))
