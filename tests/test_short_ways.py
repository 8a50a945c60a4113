"""Short ways along the ellipsoid by their chords: against Vincenty's series, in joins and in statements."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from strataspan.functions import geo, spatial_sql
from strataspan.operators.spatial_join import within_distance
from strataspan.plans import safe_sql
from strataspan.queries import spatial
from strataspan.sources.tables import register_spatial

from .test_spatial_sql import plan_of


def _near(n: int = 400) -> list[tuple]:
    """Points and others up to 19 km away, from the equator to the poles and across the antimeridian."""
    rng, out = random.Random(5), [(0, 12.0, 40.0, 12.0, 40.0), (1, 7.0, 90.0, 99.0, 89.95)]
    for i in range(2, n):
        lat, far, turn = rng.choice((0, 22.5, 45, -60, 84, 89)) + rng.random() / 2, rng.choice((1, 100, 4000, 19_000)), rng.uniform(0, 2 * math.pi)
        lon = rng.choice((114.0, 179.99, -179.99))
        out.append((i, lon, lat, lon + far * math.sin(turn) / 111_400 / math.cos(math.radians(lat)), lat + far * math.cos(turn) / 111_700))
    return out


def test_short_way(spark):
    ends = ["lon1", "lat1", "lon2", "lat2"]
    rows = spark.createDataFrame(_near(), "id int, lon1 double, lat1 double, lon2 double, lat2 double")
    way = geo.short_way(geo.spot(F.col("lon1"), F.col("lat1")), geo.spot(F.col("lon2"), F.col("lat2")))
    spatial_sql.register(spark)
    rows = rows.select("id", *ends, way.alias("way"), geo.geodesic_m(*map(F.col, ends)).alias("m"))
    rows = rows.selectExpr("*", "st_distance(st_point(lon1, lat1), st_point(lon2, lat2)) AS s").collect()
    assert len(rows) == 400 and all(abs(r.way - r.m) < 2e-6 and abs(r.s - r.m) < 2e-6 for r in rows), max(abs(r.way - r.m) for r in rows)
    assert rows[0].way == 0 and rows[0].s == 0


def test_join_is_short_and_exact(spark):
    """Beside and beyond the radius from which chords are enough the same pairs are found."""
    rng = random.Random(8)
    at = spark.createDataFrame([(i, rng.choice((-179.95, 179.95)) + rng.uniform(-0.1, 0.1), 60 + rng.random() / 2) for i in range(120)], "id int, lon double, lat double")
    all_ = at.toDF("left_id", "lon1", "lat1").crossJoin(at.toDF("right_id", "lon2", "lat2")).withColumn("m", geo.geodesic_m(*map(F.col, ("lon1", "lat1", "lon2", "lat2"))))
    for metres in (6000.0, geo.SHORT_M, 25_000.0):
        found = within_distance(at, at, metres)
        assert ("ArrowEvalPython" in plan_of(found)) == (metres > geo.SHORT_M)
        want = {(r.left_id, r.right_id): r.m for r in all_.filter(F.col("m") <= metres).collect()}
        got = {(r.left_id, r.right_id): r.distance_m for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 120


def test_statement_decides_points_by_place(spark, sf_dir):
    """The predicate isn't left to be computed for each pair; what else the statement asks stays."""
    tables = register_spatial(spark, sf_dir)
    text = safe_sql.run(spark, spatial.SCHOOL_PAIRS, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, text.split("\n"))) < 100_000
    ids = "SELECT a.id AS x, b.id AS y FROM schools a {} b {} ST_DWithin(a.geom, b.geom, 3000)"
    comma = {tuple(r) for r in safe_sql.run(spark, ids.format(", poi", "WHERE a.id < b.id AND b.type <> 'BUILDING' AND"), tables, 1000).collect()}
    joined = {tuple(r) for r in safe_sql.run(spark, ids.format("JOIN poi", "ON") + " AND a.id < b.id WHERE b.type <> 'BUILDING'", tables, 1000).collect()}
    alone = safe_sql.run(spark, "SELECT count(*) AS n FROM schools a, poi b WHERE ST_DWithin(a.geom, b.geom, 3000)", tables).first().n
    p = spark.table("poi")
    pairs = within_distance(p.filter("type = 'BUILDING'"), p, 3000.0)
    other = p.filter("type <> 'BUILDING'").select(F.col("id").alias("right_id"))
    assert comma == joined == {(r.left_id, r.right_id) for r in pairs.join(other, "right_id").filter("left_id < right_id").collect()} and comma
    assert alone == pairs.count()
