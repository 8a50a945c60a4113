"""Spatial SQL through the door: functions, joins as cell joins, and their plans."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strataspan.functions import geo, spatial_sql
from strataspan.plans import safe_sql
from strataspan.queries import spatial
from strataspan.sources.tables import districts, points, register_spatial

SQUARE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_functions(spark):
    spatial_sql.register(spark)
    g = f"ST_GeomFromText('{SQUARE}')"
    one = lambda e: spark.sql(f"SELECT {e}").first()[0]
    assert one(f"ST_Area({g})") == 15 and one(f"ST_NPoints({g})") == 10
    assert [one(f"ST_Within(ST_Point({x}, {y}), {g})") for x, y in ((3, 3), (1.5, 1.5), (0, 2), (1, 1.5), (5, 5))] == [True, False, False, False, False]
    assert [one(f"ST_Intersects({g}, ST_MakePoint({x}, {y}))") for x, y in ((3, 3), (1.5, 1.5), (0, 2), (1, 1.5), (5, 5))] == [True, False, True, True, False]
    boxes = {(-1, -1, 5, 5): True, (1.2, 1.2, 1.8, 1.8): False, (3, 3, 9, 9): True, (5, 5, 6, 6): False, (-1, 2.5, 9, 2.6): True}
    assert {b: one(f"ST_Intersects({g}, ST_MakeEnvelope{b})") for b in boxes} == boxes
    assert one("ST_AsText(ST_GeomFromText('POINT(1 2)'))") == "POINT(1.0 2.0)" and one(f"ST_AsText(ST_GeomFromText(ST_AsText({g}))) = ST_AsText({g})")
    assert one("ST_AsGeoJSON(ST_Point(1, 2))") == '{"type":"Point","coordinates":[1.0,2.0]}'
    assert one("ST_X(ST_Point(1, 2)) + ST_Y(ST_Point(1, 2))") == 3 and one(f"ST_X({g})") is None
    assert one("ST_Within(NULL, NULL)") is None and one("ST_X(NULL)") is None
    assert one(f"ST_Distance(ST_Point(3, 3), {g})") == 0
    hole = one(f"ST_Distance(ST_Point(1.5, 1.5), {g})")
    assert abs(hole - one("ST_Distance(ST_Point(1.5, 1.5), ST_Point(1.5, 2))")) < 60  # to the hole's side
    with pytest.raises(Exception, match="takes a point"):
        one(f"ST_Within({g}, {g})")


def test_joins_are_cell_joins(spark, sf_dir):
    tables = register_spatial(spark, sf_dir)
    for sql in (spatial.DISTRICT_COUNTS, spatial.SCHOOL_PAIRS, spatial.SCHOOLS_AROUND):
        text = plan_of(safe_sql.run(spark, sql, tables))
        assert "NestedLoop" not in text and "Cartesian" not in text, text
    rows = {(r.name, r.n) for r in safe_sql.run(spark, spatial.DISTRICT_COUNTS, tables).collect()}
    assert rows == {(r.name, r.cnt) for r in spatial.j1_points_per_district(spark, sf_dir).collect()}
    star = safe_sql.run(spark, "SELECT * FROM poi p JOIN admin_boundary d ON ST_Contains(d.geom, p.geom) AND p.type = 'BUILDING'", tables)
    assert star.columns == ["id", "name", "type", "lon", "lat", "geom", "id", "name", "level", "geom"] and star.count() > 0


def test_around_a_district(spark, sf_dir):
    """The nearest point of the border by small steps along it."""
    tables = register_spatial(spark, sf_dir)
    got = {r.name for r in safe_sql.run(spark, spatial.SCHOOLS_AROUND, tables).collect()}
    ring = districts(spark, sf_dir).filter("name = 'NATION_7'").first().ring
    dense = [(a.x + (b.x - a.x) * k / 2000, a.y + (b.y - a.y) * k / 2000) for a, b in zip(ring, ring[1:], strict=False) for k in range(2000)]
    far = {}
    for p in points(spark, sf_dir).filter("type = 'BUILDING'").collect():
        inside = sum((a.y > p.lat) != (b.y > p.lat) and p.lon < (b.x - a.x) * (p.lat - a.y) / (b.y - a.y) + a.x for a, b in zip(ring, ring[1:], strict=False)) % 2
        k = math.cos(math.radians(p.lat))
        far[p.name] = 0 if inside else min(math.hypot((x - p.lon) * k * 111_320, (y - p.lat) * 110_750) for x, y in dense)
    sure = {n for n, m in far.items() if m < 2950}
    assert sure <= got <= {n for n, m in far.items() if m < 3050} and sure


def test_polygon_joins_and_seams(spark):
    """Polygons of many sizes meet once; radii reach across the antimeridian and at high latitudes."""
    spatial_sql.register(spark)
    rng = random.Random(4)
    boxes = [(i, x, y, x + rng.choice((0.01, 0.3, 7)), y + rng.choice((0.02, 0.5, 4))) for i in range(60) for x, y in [(rng.uniform(-20, 20), rng.uniform(-20, 20))]]
    spark.createDataFrame(boxes, "id int, w double, s double, e double, n double").selectExpr("id", "st_makeenvelope(w, s, e, n) as geom").createOrReplaceTempView("shapes")
    df = safe_sql.run(spark, "SELECT a.id AS x, b.id AS y FROM shapes a, shapes b WHERE ST_Intersects(a.geom, b.geom) AND a.id < b.id", ["shapes"])
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert sorted(map(tuple, df.collect())) == want and "NestedLoop" not in plan_of(df)
    spots = [(i, rng.choice((-1, 1)) * rng.uniform(179.6, 180), rng.choice((0.0, 70.0, 84.0)) + rng.random()) for i in range(80)]
    spark.createDataFrame(spots, "id int, lon double, lat double").selectExpr("id", "st_point(lon, lat) as geom").createOrReplaceTempView("spots")
    got = {tuple(r) for r in safe_sql.run(spark, "SELECT a.id AS x, b.id AS y FROM spots a JOIN spots b ON ST_DWithin(a.geom, b.geom, 30000) AND a.id < b.id", ["spots"]).collect()}
    flat = spark.createDataFrame([(*a, *b) for a in spots for b in spots if a[0] < b[0]], "x int, lon1 double, lat1 double, y int, lon2 double, lat2 double")
    assert got == {tuple(r) for r in flat.filter(geo.geodesic_m(*[F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]) <= 30000).select("x", "y").collect()} and got


def test_outer_joins_and_empty_tables(spark, sf_dir):
    tables = register_spatial(spark, sf_dir)
    left = safe_sql.run(spark, "SELECT d.name, count(p.id) AS n FROM admin_boundary d LEFT JOIN poi p ON ST_Within(p.geom, d.geom) GROUP BY d.name", tables)
    assert left.count() == districts(spark, sf_dir).count()
    none = safe_sql.run(spark, "SELECT d.name FROM (SELECT * FROM poi WHERE id < 0) p JOIN admin_boundary d ON ST_Within(p.geom, d.geom)", tables)
    assert none.count() == 0
    three = safe_sql.run(spark, "SELECT count(*) AS n FROM poi p, admin_boundary d, admin_boundary e WHERE ST_Within(p.geom, d.geom) AND d.id = e.id", tables)
    assert three.first().n == spatial.j1_points_per_district(spark, sf_dir).agg(F.sum("cnt")).first()[0] and "NestedLoop" not in plan_of(three)
    assert safe_sql.answer(spark, "SELECT 'a::geography' AS t, /* ::geometry */ name FROM poi LIMIT 1", tables)["rows"][0][0] == "a::geography"
    assert safe_sql.answer(spark, "SELECT ST_AsText(ST_SetSRID(ST_MakePoint(1, 2), 4326)) AS t", tables)["rows"] == [("POINT(1.0 2.0)",)]
    assert safe_sql.answer(spark, "SELECT st_cells(geom, 4, 1) FROM poi", tables)["error"]
