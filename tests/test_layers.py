"""Shapes, stores and tools beyond what the registered queries show."""

from __future__ import annotations

import json
import tempfile

import numpy as np
from pyspark.sql import functions as F

from strataspan.functions import geo, wkt
from strataspan.operators import cartography, polygons, raster_reads
from strataspan.plans.tools import Tool, Tools, run_steps
from strataspan.sources.vector_store import VectorStore


def _meets(p, q, r, s) -> bool:
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    return side(p, q, r) != side(p, q, s) and side(r, s, p) != side(r, s, q)


def _simple(xy) -> bool:
    sides = list(zip(xy[:-1], xy[1:], strict=True))
    return not any(_meets(*sides[i], *sides[j]) for i in range(len(sides)) for j in range(i + 2, len(sides)) if not (i == 0 and j == len(sides) - 1))


def test_simplified_rings_stay_simple(spark):
    rng = np.random.default_rng(3)
    rings = []
    for k in range(40):  # combs and stars
        n = 60
        t = np.sort(rng.uniform(0, 2 * np.pi, n))
        r = rng.uniform(0.05, 1.0, n) if k % 2 else 1 + 0.9 * np.sign(np.sin(15 * t))
        xy = np.c_[r * np.cos(t), r * np.sin(t)]
        rings.append(np.vstack([xy, xy[:1]]))
    # a bump that is thinner than the tolerance, with the tip of a deep notch in it
    rings.append(np.array([(0, 0), (4.9, 0), (5, 10.2), (5.1, 0), (10, 0), (10, 10), (6, 10.3), (4, 10.3), (0, 10), (0, 0)], float))
    assert all(_simple(r) for r in rings)
    rows = [(i, [(float(x), float(y)) for x, y in r], 0.4) for i, r in enumerate(rings)]
    out = cartography.simplify(spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>, tol double"), "ring", "tol").collect()
    got = {r.id: np.array([(p.x, p.y) for p in r.ring]) for r in out}
    assert all(_simple(got[i]) for i in range(41))
    assert any(not _simple(r[cartography.thin_ring(r, 0.4)]) for r in rings)  # plain thinning would cross
    assert all(4 <= len(got[i]) <= 61 for i in range(41)) and sum(map(len, got.values())) < 40 * 61


def test_wkt_of_odd_text(spark):
    rows = [("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))",), ("polygon((-1e-3 2,3 4.5,5 6,-1e-3 2))",), ("POLYGON EMPTY",), ("POINT (1 2)",), ("",), (None,), ("POLYGON ((a b))",)]
    out = spark.createDataFrame(rows, "t string").select(F.transform(wkt.rings_of(F.col("t")), F.size).alias("n"), wkt.point_of(F.col("t")).alias("p"))
    assert [r.n for r in out.collect()] == [[4, 4], [4], [], None, None, None, None]
    assert [r.p and tuple(r.p) for r in out.collect()] == [None, None, None, (1.0, 2.0), None, None, None]


def test_holes_go_to_the_smallest_shell(spark):
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    kind = "array<struct<x:double,y:double>>"
    shells = spark.createDataFrame([(1, 1, box(0.0, 0.0, 10.0, 10.0)), (1, 2, box(1.0, 1.0, 5.0, 5.0)), (2, 3, box(0.0, 0.0, 1.0, 1.0))], f"rel int, shell int, ring {kind}")
    holes = spark.createDataFrame([(1, 7, box(2.0, 2.0, 3.0, 3.0)), (1, 8, box(7.0, 7.0, 8.0, 8.0)), (1, 9, box(20.0, 20.0, 21.0, 21.0)), (2, 10, None), (None, 11, box(0.0, 0.0, 1.0, 1.0))], f"rel int, hole int, ring {kind}")
    out = polygons.assign_holes(shells, holes, "rel").select("shell", F.size("holes").alias("n"), polygons.area_with_holes(F.col("ring"), F.col("holes")).alias("area"))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 99.0), (2, 1, 15.0), (3, 0, 1.0)]
    assert polygons.assign_holes(shells, holes.limit(0), "rel").filter("size(holes) = 0").count() == 3


def test_inner_points_lie_inside(spark, sf_dir):
    from strataspan.sources.tables import districts

    at = districts(spark, sf_dir).select("ring", polygons.inner_point(F.col("ring")).alias("at"))
    assert at.filter(geo.within(F.col("at.x"), F.col("at.y"), F.col("ring"))).count() == at.count() == 25


def test_reads_beside_the_raster_are_empty(spark):
    px = spark.createDataFrame([("a", 0, 0, 1.0)], "scene_id string, row int, col int, b2 double")
    grid = raster_reads.Grid(0.0, 1.0, 0.5)
    assert raster_reads.read_box(px, grid, (5.0, 5.0, 6.0, 6.0), 4, 4).count() == 0
    assert raster_reads.read_box(px, grid, (0.0, 0.5, 0.5, 1.0), 4, 4).count() == 1
    assert raster_reads.overwrite_masks(px.withColumn("mask", F.lit(1))).count() == 0
    assert raster_reads.default_bands(["b2", "b3"]) == ["b2"] and raster_reads.default_bands(["a", "b", "c", "d"]) == ["a", "b", "c"]


def test_stores_add_and_migrate(spark):
    chunks = lambda *rows: spark.createDataFrame([(i, t, {"k": "v"}, [1.0, 0.0]) for i, t in rows], "id string, text string, metadata map<string,string>, embedding array<float>")
    one, two = (VectorStore(spark, tempfile.mkdtemp(prefix="spark-") + "/store") for _ in range(2))
    one.upsert("a", chunks(("1", "x"), ("2", "y")))
    one.add("a", chunks(("2", "other"), ("3", "z")))
    one.upsert("b", chunks(("1", "w")))
    assert sorted(map(tuple, one.migrate(two).collect())) == [("a", 3), ("b", 1)]
    assert [r.text for r in two.documents("a").collect()] == ["x", "y", "z"]


def test_tools_answer_errors_as_data(spark):
    tools = Tools(most=3)
    tools.add(Tool("count_to", "Numbers below n.", lambda n, start=0: spark.range(start, n), {"n": int, "start": int}, ("start",)))
    tools.add(Tool("broken", "Fails.", lambda: 1 / 0, {}))
    assert json.loads(tools.call("count_to", '{"n": 2}')) == {"rows": [{"id": 0}, {"id": 1}], "more": False}
    assert json.loads(tools.call("count_to", {"n": 9, "start": 1}))["more"] is True
    for name, given in (("none", "{}"), ("count_to", "{}"), ("count_to", '{"n": "2"}'), ("count_to", '{"n": true}'), ("count_to", '{"n": 1, "m": 2}'), ("count_to", "[1]"), ("count_to", "{"), ("broken", "{}")):
        assert list(json.loads(tools.call(name, given))) == ["error"], (name, given)
    assert tools.schemas()[0]["parameters"]["required"] == ["n"]


def test_steps_stop_at_an_error():
    steps = [("plan", lambda s: {"year": 2020}), ("data", lambda s: {"rows": s["missing"]}), ("report", lambda s: {"text": "x"})]
    out = run_steps({"ask": "q"}, steps)
    assert out["done"] == ["plan", "data"] and out["error"].startswith("data: KeyError") and "text" not in out
    assert run_steps({}, steps[:1]) == {"done": ["plan"], "year": 2020}
