"""Blocks are written and read by box, tile and scene; others aren't opened."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataspan.operators import raster_reads
from strataspan.queries import catalogs
from strataspan.sources.raster_store import RasterStore

GRID = raster_reads.Grid(113.9, 22.62, 0.001)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("rasters")
    s = RasterStore(spark, f"file://{root}/store", 16)
    px = spark.range(40 * 50).select(F.lit("s/1 é").alias("scene_id"), (F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), (F.col("id") * 7 % 100 / 100).alias("b4"), (F.col("id") * 3 % 100 / 100).alias("b8"))
    other = px.withColumn("scene_id", F.lit("s2")).filter("row < 20")
    lost = px.withColumn("scene_id", F.lit("nowhere"))
    places = spark.createDataFrame([("s/1 é", 113.9, 22.62, 0.001), ("s2", 113.92, 22.61, 0.001), ("nowhere", None, 1.0, 1.0)], "scene_id string, west double, north double, step double")
    s.write(px.union(other).union(lost).union(px.withColumn("row", F.lit(None).cast("int"))), places, ["b4", "b8"])
    return s, px, other, places


def files_read(df) -> int:
    """What the scan of blocks says it has read."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "FileSourceScanExec" and "/blocks" in node.simpleString(10_000):
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_box_and_tile(spark, store):
    s, px, other, _ = store
    assert {(r.scene_id, r.height, r.width) for r in s.headers().collect()} == {("s/1 é", 40, 50), ("s2", 20, 50)}
    box = (113.905, 22.59, 113.93, 22.61)
    got = sorted(map(tuple, s.read_box(box, 5, 4, ["b8"], spark.createDataFrame([("s/1 é",)], "scene_id string")).collect()))
    want = sorted(map(tuple, raster_reads.read_box(px, GRID, box, 5, 4, ["b8"]).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))
    tile = (12, int((113.92 + 180) / 360 * 4096), 1783)
    for ty in range(1780, 1790):
        a = sorted(map(tuple, s.read_tile(tile[0], tile[1], ty, ["b4"]).filter("scene_id <> 's2'").collect()))
        b = sorted(map(tuple, raster_reads.read_tile(px, GRID, tile[0], tile[1], ty, ["b4"]).collect()))
        assert [x[:3] for x in a] == [x[:3] for x in b] and all(abs(x[3] - y[3]) < 1e-12 for x, y in zip(a, b, strict=True))
    assert s.pixels(["b4"], box=(0.0, 0.0, 1.0, 1.0)).count() == 0
    assert s.pixels(["b4"]).count() == 40 * 50 + 20 * 50


def test_other_blocks_stay_closed(store):
    s, *_ = store
    part = s.pixels(["b8"], box=(113.9, 22.601, 113.915, 22.62))
    assert files_read(part) == 2  # two of twenty blocks
    plan = part._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "b4:double" not in plan


def test_written_again(spark, store):
    s, px, _, places = store
    again = RasterStore(spark, s.root, 16)
    again.write(px.withColumn("scene_id", F.lit("s2")).filter("row < 5").withColumn("b8", F.lit(9.0)), places, ["b4", "b8"])
    assert {(r.scene_id, r.height) for r in again.headers().collect()} == {("s/1 é", 40), ("s2", 5)}
    rows = again.pixels(["b8"], spark.createDataFrame([("s2",)], "scene_id string"))
    assert rows.count() == 250 and rows.filter("b8 <> 9").count() == 0
    assert RasterStore(spark, s.root + "-none").headers().count() == 0


def test_statistics_prune_scenes(spark, sf_dir):
    df = catalogs.c9_scene_statistics(spark, sf_dir)
    assert df.count() > 0 and "dynamicpruning" in df._jdf.queryExecution().toString()
