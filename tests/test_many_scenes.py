"""Many small scenes of a raster store are few files."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspan.sources import raster_store


def test_files_of_small_scenes(spark, tmp_path):
    store = raster_store.RasterStore(spark, f"file://{tmp_path}/store", 8)
    px = spark.range(600 * 4).select(F.concat(F.lit("s"), F.floor(F.col("id") / 4).cast("string")).alias("scene_id"), (F.col("id") % 4).cast("int").alias("row"), F.lit(0).alias("col"), F.col("id").cast("double").alias("b4"))
    places = px.select("scene_id", F.lit(1.0).alias("west"), F.lit(2.0).alias("north"), F.lit(0.1).alias("step")).distinct()
    store.write(px, places, ["b4"])
    assert 1 < len(list(tmp_path.glob("store/blocks/**/*.parquet"))) <= raster_store.BUCKETS
    asked = spark.createDataFrame([("s7",), ("s599",), ("none",)], "scene_id string")
    got = {(r.scene_id, r.row, r.b4) for r in store.pixels(["b4"], asked, (0.0, 1.8, 9.0, 2.0)).collect()}
    assert got == {("s7", 0, 28.0), ("s7", 1, 29.0), ("s599", 0, 2396.0), ("s599", 1, 2397.0)}
