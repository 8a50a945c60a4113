"""Scenes as blocks of pixels in Parquet, read by box, map tile, band and scene.

A folder holds the blocks of ``block`` x ``block`` pixels that have one place (block row, block
column) in the scenes of one of ``BUCKETS`` buckets, so many small scenes are few files, and
bands are columns: a read opens the folders and bands that it needs. Which
blocks those are is worked out on the headers, a row per scene with its place and size, and
reaches the scan as a run-time filter on folders; scenes lie one after the other in them. Headers are written after the blocks: a
writer lost in between leaves blocks that no header names. Of a scene that is written again
the last version counts.

Defined cases: pixels without a scene, row or column are left out; scenes without a place
(west, north, step) are left out; a box beside all scenes gives no rows; repeated pixels stay.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import materialise

HEADER = "scene_id string, west double, north double, step double, height int, width int, bands array<string>, version string"
BUCKETS = 64


def _bucket(scene: Column) -> Column:
    return F.pmod(F.xxhash64(scene), F.lit(BUCKETS)).cast("int")


class RasterStore:
    """Blocks and headers under one folder."""

    def __init__(self, spark: SparkSession, root: str, block: int = 256) -> None:
        self.spark, self.root, self.block = spark, root.rstrip("/"), block
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def write(self, pixels: DataFrame, places: DataFrame, bands: list[str]) -> None:
        """Scenes of pixels (scene_id, row, col, bands) at places (scene_id, west, north, step)."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        known = pixels.dropna(subset=["scene_id", "row", "col"]).join(places.dropna().select("scene_id"), "scene_id", "left_semi")
        cells = known.select("scene_id", F.col("row").cast("int"), F.col("col").cast("int"), *[F.col(b).cast("double") for b in bands])
        cells = cells.withColumns({"bucket": _bucket(F.col("scene_id")), "br": F.floor(F.col("row") / self.block).cast("int"), "bc": F.floor(F.col("col") / self.block).cast("int"), "version": F.lit(version)})
        placed = cells.repartition("bucket", "br", "bc").sortWithinPartitions("bucket", "br", "bc", "scene_id", "row", "col")
        placed.write.mode("append").partitionBy("version", "bucket", "br", "bc").parquet(f"{self.root}/blocks")
        size = self._blocks(bands).filter(F.col("version") == version).groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
        header = places.dropna().join(size, "scene_id").select("scene_id", "west", "north", "step", "height", "width", F.array(*map(F.lit, bands)).alias("bands"), F.lit(version).alias("version"))
        header.coalesce(1).write.mode("append").parquet(f"{self.root}/headers")

    def _blocks(self, bands: list[str]) -> DataFrame:
        schema = "scene_id string, row int, col int, " + ", ".join(f"{b} double" for b in bands) + ", version string, bucket int, br int, bc int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/blocks")

    def headers(self) -> DataFrame:
        """The last header of every scene: place, height, width, bands, and bounds w, s, e, n. No pixel is read."""
        if not self._fs.exists(self._path(f"{self.root}/headers")):
            rows = self.spark.createDataFrame([], HEADER)
        else:
            rows = self.spark.read.schema(HEADER).parquet(f"{self.root}/headers")
        names = [f.split()[0] for f in HEADER.split(", ")][1:]
        last = rows.groupBy("scene_id").agg(F.max_by(F.struct(*names), "version").alias("h")).select("scene_id", "h.*")
        return last.withColumns({"w": F.col("west"), "n": F.col("north"), "e": F.col("west") + F.col("width") * F.col("step"), "s": F.col("north") - F.col("height") * F.col("step")})

    def pixels(self, bands: list[str], scenes: DataFrame | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
        """scene_id, row, col, bands, west, north, step of pixels with their centre in the box
        (west and north edge included), of all scenes or of those in ``scenes`` (scene_id)."""
        at = self.headers() if scenes is None else self.headers().join(scenes.select("scene_id").distinct(), "scene_id", "left_semi")
        ranges = {"r0": F.lit(0), "r1": F.col("height"), "c0": F.lit(0), "c1": F.col("width")}
        if box is not None:
            w, s, e, n = box
            first = lambda far, size: F.least(F.greatest(F.ceil(far / F.col("step") - 0.5), F.lit(0)), F.col(size))
            ranges = {"r0": first(F.col("north") - n, "height"), "r1": first(F.col("north") - s, "height"), "c0": first(w - F.col("west"), "width"), "c1": first(e - F.col("west"), "width")}
        at = at.withColumns(ranges).filter("r0 < r1 and c0 < c1")
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / self.block).cast("int"), F.floor((F.col(b) - 1) / self.block).cast("int")))
        wanted = at.select("version", _bucket(F.col("scene_id")).alias("bucket"), "scene_id", "west", "north", "step", "r0", "r1", "c0", "c1", span("r0", "r1").alias("br")).withColumn("bc", span("c0", "c1"))
        wanted = materialise(wanted, "raster-wanted").filter("r0 < r1")  # a few rows per scene; their folders prune the scan
        met = self._blocks(bands).join(wanted, ["version", "bucket", "br", "bc", "scene_id"])
        return met.filter("row >= r0 and row < r1 and col >= c0 and col < c1").select("scene_id", "row", "col", *bands, "west", "north", "step", "r0", "r1", "c0", "c1")

    def read_box(self, box: tuple[float, float, float, float], width: int, height: int, bands: list[str], scenes: DataFrame | None = None) -> DataFrame:
        """scene_id, y, x and means of the bands in width x height cells of the box's part of each scene."""
        part = self.pixels(bands, scenes, box)
        y = F.floor((F.col("row") - F.col("r0")) * height / (F.col("r1") - F.col("r0"))).cast("int")
        x = F.floor((F.col("col") - F.col("c0")) * width / (F.col("c1") - F.col("c0"))).cast("int")
        return part.groupBy("scene_id", y.alias("y"), x.alias("x")).agg(*[F.avg(b).alias(b) for b in bands])

    def read_tile(self, z: int, tx: int, ty: int, bands: list[str], size: int = 256, scenes: DataFrame | None = None) -> DataFrame:
        """scene_id, y, x and means of the bands in the cells of a map tile; the tile becomes a box first."""
        lon = lambda x: x / 2**z * 360 - 180
        lat = lambda y: math.degrees(2 * math.atan(math.exp(math.pi * (1 - 2 * y / 2**z))) - math.pi / 2)
        slack = 1e-9  # the box is a little larger; cells decide
        part = self.pixels(bands, scenes, (lon(tx) - slack, lat(ty + 1) - slack, lon(tx + 1) + slack, lat(ty) + slack))
        at_lon, at_lat = F.col("west") + (F.col("col") + 0.5) * F.col("step"), F.col("north") - (F.col("row") + 0.5) * F.col("step")
        wx: Column = F.floor((at_lon + 180.0) / 360.0 * float(2**z * size))
        wy: Column = F.floor((F.lit(0.5) - geo.mercator_y(at_lat) / F.lit(2 * math.pi * geo.R_MERCATOR)) * float(2**z * size))
        placed = part.withColumns({"x": (wx - tx * size).cast("int"), "y": (wy - ty * size).cast("int")}).filter(f"x between 0 and {size - 1} and y between 0 and {size - 1}")
        return placed.groupBy("scene_id", "y", "x").agg(*[F.avg(b).alias(b) for b in bands])
