"""Overlays, labels and styles; loading with derivation; boundaries named in texts."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from strataspan.operators import layers
from strataspan.plans.intents import MapIntent
from strataspan.plans.map_style import assemble, legend
from strataspan.queries.layers import m6_label_features
from strataspan.queries.texts import m5_labels
from strataspan.sources.spatial_load import SpatialTables, named_boundaries

KEPT = "kind string, patch long, px long, row int, col int"


def _shape(rows: list[str], kind: str, patch: int) -> list[tuple]:
    at = [(r, c) for r, line in enumerate(rows) for c, v in enumerate(line) if v == "#"]
    return [(kind, patch, len(at), r, c) for r, c in at]


def _area(loop) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:], strict=False))) / 2


def test_change_features(spark, tmp_path):
    """A ring with a hole, and two squares that meet in a corner, gained and lost: areas of what
    is drawn are those of the pixels; nothing is written over."""
    ring, corner = ["####", "#..#", "####"], ["##..", "##..", "..##", "..##"]
    kept = spark.createDataFrame(_shape(ring, "gain", 7) + _shape(corner, "loss", 7), KEPT)
    f = layers.change_features(layers.change_patches(kept, ["kind"], 100.0, 20.0, 0.5), 25.0, "green", "p")
    root = str(tmp_path / "o")
    assert layers.write_overlay(f, root, "green", "20240102_030405") == "overlay_20240102_030405_green.geojson"
    with pytest.raises(Exception, match="(?i)exist"):
        layers.write_overlay(f, root, "green", "20240102_030405")
    with pytest.raises(ValueError):
        layers.write_overlay(f, root, "../x", "20240102_030405")
    got = {}
    for line in spark.read.text(f"{root}/overlay_20240102_030405_green.geojson").collect():
        x = json.loads(line.value)
        parts = x["geometry"]["coordinates"]
        assert all(100 <= p[0] <= 102 and 18 <= p[1] <= 20 and loop[0] == loop[-1] for part in parts for loop in part for p in loop)
        drawn = sum(_area(part[0]) - sum(map(_area, part[1:])) for part in parts) / 0.25
        got[x["properties"]["kind"]] = (sum(len(part) - 1 for part in parts), drawn, x["properties"]["area_m2"], x["properties"]["color"])
    assert got == {"gain": (1, 10.0, 250.0, "#E6323C"), "loss": (0, 8.0, 200.0, "#3C78EB")}
    empty = layers.change_features(layers.change_patches(kept.limit(0), ["kind"], 0.0, 0.0, 1.0), 1.0, "green", "p")
    assert empty.count() == 0
    assert [x["key"] for x in legend("绿化")] == ["gain", "loss"]


def test_labels_are_features(spark, sf_dir):
    got = [json.loads(r.feature) for r in m6_label_features(spark, sf_dir).collect()]
    want = {(r.name, r.side) for r in m5_labels(spark, sf_dir).collect()}
    assert {(x["properties"]["name"], x["properties"]["anchor"]) for x in got} == want and len(got) == len(want)
    assert all(113.7 <= x["geometry"]["coordinates"][0] <= 114.3 for x in got)


def test_points_grid_polygons(spark):
    p = spark.createDataFrame([("a\"b", "park", 1.123456789, 2.0), (None, None, 3.0, 4.0), ("c", "park", None, 4.0)], "name string, class string, lon double, lat double")
    got = [json.loads(r.feature) for r in layers.point_features(p).orderBy("feature").collect()]
    assert sorted(x["geometry"]["coordinates"] for x in got) == [[1.123457, 2.0], [3.0, 4.0]]
    cells = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0.123456), (0.0, 0.0, 1.0, 1.0, None), (0.0, 0.0, 1.0, 1.0, float("nan"))], "w double, s double, e double, n double, v double")
    assert [json.loads(r.feature)["properties"]["v"] for r in layers.grid_features(cells, "v").collect()] == [0.1235]


def test_styles():
    data = {"points": "p", "polygons": "g", "labels": "l", "grid": "x", "tiles": "t/{z}"}
    poi = assemble(MapIntent("poi", "r", ["park", "school"], ["park"]), (1, 2, 3, 4), data, '{"fill-color":["match",["get","class"],"park","#0f0","#888"]}')
    assert poi["layer_ids"] == ["t2m-poi-poly-src", "t2m-poi-poly-fill", "t2m-poi-pts-src", "t2m-poi-points", "t2m-poi-labels-src", "t2m-poi-labels"]
    assert poi["layers"][0]["paint"]["fill-color"] == poi["layers"][1]["paint"]["circle-color"] and poi["fit_bounds"] == [1, 2, 3, 4]
    assert all(x["source"] in poi["sources"] for x in poi["layers"])
    assert [x["type"] for x in assemble(MapIntent("poi", "r", [], []), (1, 2, 3, 4), {"points": "p"})["layers"]] == ["circle"]
    cog = assemble(MapIntent("cog", "r", [], [], 0.4), (1, 2, 3, 4), data)
    assert cog["layers"][0]["paint"] == {"raster-opacity": 0.4} and list(cog["sources"]) == ["t2m-cog-src"]
    assert assemble(MapIntent("ndvi", "r", [], []), (1, 2, 3, 4), data)["layers"][0]["id"] == "t2m-ndvi-fill"
    with pytest.raises(ValueError):
        assemble(MapIntent("roads", "r", [], []), (1, 2, 3, 4), data)


def test_spatial_tables(spark, tmp_path):
    """Loaded twice, rows are there once; odd rows; names and parameters can't carry statements."""
    ring = "array<struct<x:double,y:double>>"
    b = spark.createDataFrame([(1, "d", "district", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], 9), (2, None, None, None, 9)], f"id long, name string, level string, ring {ring}, extra int")
    p = spark.createDataFrame([(1, "a", "学校", 1.0, 2.0), (2, "b'; DROP TABLE poi", "x'y", 1.0, 2.0), (3, "c", None, 1.0, 2.0), (4, "d", "学校", None, 2.0), (1, "a", "学校", 1.0, 2.0)], "id long, name string, type string, lon double, lat double")
    t = SpatialTables(spark, f"load_{uuid.uuid4().hex}", str(tmp_path / "db"))
    for types in (["学校"], ["学校", "x'y"]):
        t.load(b, p, types)
    count = lambda name: spark.table(t.name(name)).count()
    assert (count("admin_boundary"), count("poi"), count("schools")) == (1, 4, 3)
    assert spark.table(t.name("schools")).filter("id = 1").select(F.col("geom")[0][0]["y"].alias("y")).first().y == 2.0
    t.load(b.limit(0), p.limit(0), [])
    assert (count("admin_boundary"), count("poi"), count("schools")) == (0, 0, 0)
    with pytest.raises(ValueError):
        SpatialTables(spark, "a; DROP", "x")
    with pytest.raises(ValueError):
        t.name("orders")
    t.drop()


def test_named_boundaries(spark):
    """Against every text and name: inside of words, of other names, repeated, null and empty."""
    names = ["南山区", "山区", "New York", "York", "York", "", None]
    b = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    texts = ["南山区和南山区", "New Yorkers", "york", "", None, "x" * 5000 + "York", "山"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = {(k, i) for k, x in enumerate(texts) for i, n in enumerate(names) if x and n and n in x}
    got = [(r.k, r.id) for r in named_boundaries(t, b, "k").collect()]
    assert set(got) == want and len(got) == len(want)
    assert named_boundaries(t, b.limit(0), "k").count() == 0
