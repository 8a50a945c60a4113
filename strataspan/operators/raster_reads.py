"""Parts of a pixel table: by box, by map tile, smoothed, and by object."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


class Grid(NamedTuple):
    """Where a raster lies: its north-west corner and the size of a pixel in degrees."""

    west: float
    north: float
    step: float

    def centre(self) -> tuple[Column, Column]:
        return F.lit(self.west) + (F.col("col") + 0.5) * self.step, F.lit(self.north) - (F.col("row") + 0.5) * self.step


def scaled(pixels: DataFrame, columns: list[str], scale: float = 1e-4) -> DataFrame:
    """Stored integers as reflectances."""
    return pixels.withColumns({c: F.col(c).cast("double") * scale for c in columns})


def default_bands(columns: list[str]) -> list[str]:
    return columns[:3] if len(columns) >= 3 else columns[:1]


def info(pixels: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    """scene_id, height, width, number of bands and bounds."""
    size = pixels.groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.lit(len(columns)).alias("n_bands"))
    return size.withColumns({"w": F.lit(grid.west), "s": F.lit(grid.north) - F.col("height") * grid.step, "e": F.lit(grid.west) + F.col("width") * grid.step, "n": F.lit(grid.north)})


def read_box(pixels: DataFrame, grid: Grid, box: tuple[float, float, float, float], width: int, height: int, columns: list[str] | None = None) -> DataFrame:
    """scene_id, y, x and means of the bands: pixels with their centre in the box (west and
    north edge included) in width x height cells. The box becomes ranges of rows and columns
    first, which reach the scan; a box beside the raster gives no rows."""
    w, s, e, n = box
    bands = columns or default_bands([c for c in pixels.columns if c not in ("scene_id", "row", "col")])
    first_col, first_row = (math.ceil(v / grid.step - 0.5) for v in (w - grid.west, grid.north - n))
    end_col, end_row = (math.ceil(v / grid.step - 0.5) for v in (e - grid.west, grid.north - s))
    part = pixels.filter((F.col("col") >= first_col) & (F.col("col") < end_col) & (F.col("row") >= first_row) & (F.col("row") < end_row))
    x = F.floor((F.col("col") - first_col) * width / max(end_col - first_col, 1)).cast("int")
    y = F.floor((F.col("row") - first_row) * height / max(end_row - first_row, 1)).cast("int")
    return part.groupBy("scene_id", y.alias("y"), x.alias("x")).agg(*[F.avg(c).alias(c) for c in bands])


def read_tile(pixels: DataFrame, grid: Grid, z: int, tx: int, ty: int, columns: list[str], size: int = 256) -> DataFrame:
    """scene_id, y, x and means of the bands in the cells of a map tile. Its edges become ranges
    of rows and columns, which reach the scan, before cells are computed."""
    west, east = (x / 2**z * 360 - 180 for x in (tx, tx + 1))
    top, bottom = (math.degrees(2 * math.atan(math.exp(math.pi * (1 - 2 * y / 2**z))) - math.pi / 2) for y in (ty, ty + 1))
    cols, rows = [(v - grid.west) / grid.step for v in (west, east)], [(grid.north - v) / grid.step for v in (top, bottom)]
    pixels = pixels.filter(F.col("col").between(math.floor(cols[0]) - 1, math.ceil(cols[1]) + 1) & F.col("row").between(math.floor(rows[0]) - 1, math.ceil(rows[1]) + 1))
    lon, lat = grid.centre()
    wx = (lon + 180.0) / 360.0 * float(2**z * size)
    wy = (F.lit(0.5) - geo.mercator_y(lat) / F.lit(2 * math.pi * 6378137.0)) * float(2**z * size)
    placed = pixels.withColumns({"wx": F.floor(wx), "wy": F.floor(wy)}).filter(f"wx >= {tx * size} and wx < {(tx + 1) * size} and wy >= {ty * size} and wy < {(ty + 1) * size}")
    return placed.groupBy("scene_id", (F.col("wy") - ty * size).cast("int").alias("y"), (F.col("wx") - tx * size).cast("int").alias("x")).agg(*[F.avg(c).alias(c) for c in columns])


def smooth(pixels: DataFrame, column: str, height: int, width: int, sigma: float = 2.0) -> DataFrame:
    """A Gaussian over a raster, rows first, then columns; edges are mirrored. A pixel sends
    its share to the pixels around it (and its mirror image's), so each direction is one sum
    with partial aggregation."""
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-reach, reach + 1)]
    share = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / sum(weights)).alias("w")) for o, w in zip(range(-reach, reach + 1), weights, strict=True)])
    out = pixels.select("scene_id", "row", "col", F.col(column).cast("double").alias("v"))
    for at, size in (("row", height), ("col", width)):
        other = "col" if at == "row" else "row"
        seen = F.explode(F.array(F.col(at), -1 - F.col(at), 2 * size - 1 - F.col(at))).alias("seen")
        sent = out.select("scene_id", other, "v", seen).filter(f"seen >= {-reach} and seen < {size + reach}").withColumn("s", F.explode(share))
        sent = sent.select("scene_id", other, (F.col("seen") + F.col("s.o")).alias(at), (F.col("v") * F.col("s.w")).alias("v")).filter(f"{at} >= 0 and {at} < {size}")
        out = sent.groupBy("scene_id", "row", "col").agg(F.sum("v").alias("v"))
    return out.withColumnRenamed("v", column)


def overwrite_masks(masks: DataFrame, least: int = 150) -> DataFrame:
    """scene_id, row, col, mask: masks are painted large first, so that small ones stay on
    top; of equal ones the later id; those under ``least`` pixels are left out."""
    rows = masks.select("scene_id", "mask", "row", "col").distinct()
    sizes = rows.groupBy("scene_id", "mask").agg(F.count("*").alias("px")).filter(F.col("px") >= least)
    return rows.join(sizes, ["scene_id", "mask"]).groupBy("scene_id", "row", "col").agg(F.min_by("mask", F.struct("px", -F.col("mask"))).alias("mask"))


def label_objects(pixels: DataFrame, objects: DataFrame, value: Column, classify: Column, background: Column) -> DataFrame:
    """scene_id, row, col, mask, label: an object's pixels get the class of its mean ``value``
    (``classify`` reads column ``mean``), pixels outside of objects that of ``background``."""
    at = ["scene_id", "row", "col"]
    joined = pixels.select(*at, value.alias("value"), background.alias("own")).join(objects.select(*at, "mask"), at, "left")
    means = joined.filter("mask is not null").groupBy("scene_id", "mask").agg(F.avg("value").alias("mean")).select("scene_id", "mask", classify.alias("class"))
    # pixels outside of objects have no part in the join, where they would be one key
    inside = joined.filter("mask is not null").join(means, ["scene_id", "mask"]).select(*at, "mask", F.coalesce("class", "own").alias("label"))
    return inside.unionByName(joined.filter("mask is null").select(*at, "mask", F.col("own").alias("label")))
