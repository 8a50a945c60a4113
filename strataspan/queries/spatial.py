"""Queries over points, districts and boxes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial_join as sj
from ..sources.tables import districts, load, points, register_spatial, scenes
from .ddb import DISTRICTS, INSIDE, POI, SCENES, with_

LON0, LAT0 = 114.0, 22.55


def s1_named_parameters(spark, d):
    points(spark, d).createOrReplaceTempView("poi_param")
    return spark.sql("SELECT id, name FROM poi_param WHERE type = :kind AND lon > :west", args={"kind": "BUILDING", "west": 114.0})


def s8_feature_rows(spark, d):
    """One GeoJSON feature per row; coordinates as decimals with four digits."""
    p = points(spark, d)
    return p.select("id", F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(*[F.col(c).cast("decimal(9,4)") for c in ("lon", "lat")]).alias("coordinates")).alias("geometry"),
        F.struct("id", "name", F.col("type").alias("kind")).alias("properties"),
    )).alias("feature"))


def p2_optional_filter(spark, d):
    p = points(spark, d)
    return p.filter((F.lit("") == "") | (F.col("type") == "")).filter((F.lit("MACHINERY") == "") | (F.col("type") == "MACHINERY")).select("id", "type")


def p3_derived_table(spark, d):
    return points(spark, d).filter(F.col("type").isin("BUILDING", "MACHINERY", "HOUSEHOLD")).select("id", "name", "type")


def p4_bbox_count(spark, d):
    p = points(spark, d)
    return p.filter(F.col("lon").between(113.9, 114.1) & F.col("lat").between(22.5, 22.6)).agg(F.count("*").alias("n"))


def p7_envelope(spark, d):
    """Points on or inside a box; touching counts."""
    p = points(spark, d)
    ring = geo.box_ring(*[F.lit(v) for v in (113.9, 22.5, 114.1, 22.6)])
    return p.filter(geo.intersects(F.col("lon"), F.col("lat"), ring)).select("id")


def p8_t1_nearby(spark, d):
    out = sj.nearby(points(spark, d), LON0, LAT0, 8000.0, "BUILDING")
    return out.select("id", F.round("distance_m", 2).alias("distance_m"))


def p9_contains(spark, d):
    """Districts that contain a given point."""
    return districts(spark, d).filter(geo.within(F.lit(113.95), F.lit(22.47), F.col("ring"))).select("id", "name")


def j1_points_per_district(spark, d):
    return sj.count_per_polygon(points(spark, d), districts(spark, d))


def j1_boundary_points(spark, d):
    """Touching counts, for points on the districts' corners."""
    corners = districts(spark, d).select(F.col("id"), F.col("minx").alias("lon"), F.col("miny").alias("lat"))
    hits = sj.points_in_polygons(corners, districts(spark, d), boundary=True)
    return hits.filter("point_id = polygon_id").groupBy().agg(F.count("*").alias("n"))


def j2_one_district(spark, d):
    one = districts(spark, d).filter("id = 7")
    return sj.points_in_polygons(points(spark, d), one).join(points(spark, d).withColumnRenamed("id", "point_id"), "point_id").select("point_id", "name", "type")


def j3_distance_join(spark, d):
    """Pairs of building points and suppliers' places within 12 km."""
    left = points(spark, d).filter("type = 'BUILDING'")
    s = F.col("s_suppkey")
    right = load(spark, d, "supplier").select(
        s.alias("id"), (F.lit(113.7) + (s * 6007 % 6000).cast("double") / 10000.0).alias("lon"), (F.lit(22.4) + (s * 3001 % 4000).cast("double") / 10000.0).alias("lat")
    )
    return sj.within_distance(left, right, 12000.0).select("left_id", "right_id", F.round("distance_m", 2).alias("distance_m"))


def _dist_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> list[str]:
    """CTE steps of the geodesic distance over a relation ``g0`` with these columns."""
    f = "(1::DOUBLE / 298.257223563::DOUBLE)"
    ctes = [
        f"""g1 AS (SELECT *, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l AS lam FROM (SELECT *, atan((1 - {f}) * tan(radians({lat1}))) AS u1,
  atan((1 - {f}) * tan(radians({lat2}))) AS u2, radians({lon2} - {lon1}) AS l FROM g0))"""
    ]
    angle = """SELECT *, atan2(ss, cs) AS sigma, CASE WHEN 1 - sa * sa > 1e-15 THEN cs - 2 * s1 * s2 / (1 - sa * sa) ELSE 0 END AS cm, 1 - sa * sa AS c2a FROM (
  SELECT *, c1 * c2 * sin(lam) / ss AS sa FROM (SELECT *, greatest(sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)), 1e-300) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM {src}))"""
    drop = "EXCLUDE (ss, cs, sa, sigma, cm, c2a)"
    last = "g1"
    for k in range(12):
        ctes.append(f"""h{k} AS (SELECT * {drop} REPLACE (l + (1 - c) * {f} * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm * cm))) AS lam) FROM (
  SELECT *, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS c FROM ({angle.format(src=last)})))""")
        ctes.append(f"i{k} AS (SELECT * EXCLUDE (c) FROM h{k})")
        last = f"i{k}"
    b = f"(6378137.0::DOUBLE * (1 - {f}))"
    ctes.append(f"""dist AS (SELECT *, CASE WHEN {lon1} = {lon2} AND {lat1} = {lat2} THEN 0 ELSE {b} * (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))) * (sigma - bb * ss * (cm + bb / 4 * (cs * (-1 + 2 * cm * cm)
  - bb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))) END AS m FROM (SELECT *, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM (
  SELECT *, c2a * (pow(6378137.0::DOUBLE, 2) - {b} * {b}) / ({b} * {b}) AS u FROM ({angle.format(src=last)}))))""")
    return ctes


def j4_scene_ratio(spark, d):
    q = spark.createDataFrame([(1, 113.2, 22.1, 113.9, 22.6), (2, 114.0, 22.5, 114.3, 22.9)], "query_id int, qw double, qs double, qe double, qn double")
    out = sj.covering_boxes(q, scenes(spark, d).select("id", "w", "s", "e", "n"))
    return out.select("query_id", "id", F.round("ratio", 6).alias("ratio"))


def j5_nearest_region(spark, d):
    s = scenes(spark, d)
    mid = s.groupBy("region").agg(F.avg((F.col("w") + F.col("e")) / 2).alias("x"), F.avg((F.col("s") + F.col("n")) / 2).alias("y"))
    far = F.sqrt(F.pow(F.col("x") - 113.2, 2) + F.pow(F.col("y") - 22.2, 2))
    return mid.agg(F.min_by("region", F.struct(far, "region")).alias("region"))


def j6_name_lookup(spark, d):
    """The longest district name that a text holds; several of that length are candidates."""
    texts = spark.createDataFrame([(1, "show NATION_1 and NATION_12"), (2, "NATION_13 or NATION_21?"), (3, "nowhere")], "qid int, q string")
    hits = texts.join(districts(spark, d).select("name"), F.col("q").contains(F.col("name")))
    best = hits.groupBy("qid").agg(F.max(F.struct(F.length("name").alias("n"), F.lit(0))).alias("m"))
    top = hits.join(best, "qid").filter(F.length("name") == F.col("m.n")).groupBy("qid").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return top.select("qid", F.array_join("names", ",").alias("candidates"), (F.size("names") == 1).alias("resolved"))


DISTRICT_COUNTS = "SELECT d.name, count(p.id) AS n FROM poi p JOIN admin_boundary d ON ST_Within(p.geom, d.geom) GROUP BY d.name ORDER BY n DESC, d.name"
IN_A_BOX = "SELECT count(*) AS n FROM poi WHERE ST_Intersects(geom, ST_MakeEnvelope(113.95, 22.5, 114.05, 22.56, 4326))"
SCHOOL_PAIRS = """SELECT a.name AS school, count(*) AS near, round(max(ST_Distance(a.geom, b.geom)), 2) AS farthest FROM schools a, poi b
  WHERE ST_DWithin(a.geom::geography, b.geom::geography, 4000) AND a.id <> b.id GROUP BY a.name ORDER BY near DESC, school"""
SCHOOLS_AROUND = """SELECT s.name, s.type FROM schools s, admin_boundary a WHERE a.name = 'NATION_7' AND ST_DWithin(s.geom::geography, a.geom::geography, 3000);"""


def _statement(sql: str):
    """A user's statement, through the door."""

    def run(spark, d):
        from ..plans import safe_sql

        return safe_sql.run(spark, sql, register_spatial(spark, d))

    return run


j14_district_counts, p7_box_count, p8_school_pairs, j3_schools_around = map(_statement, (DISTRICT_COUNTS, IN_A_BOX, SCHOOL_PAIRS, SCHOOLS_AROUND))


def a1_counts_by_type(spark, d):
    counts = points(spark, d).groupBy("type").agg(F.count("*").alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.join(F.broadcast(total))  # one row


def a3_global_sums(spark, d):
    return points(spark, d).agg(F.count("*").alias("n"), F.round(F.sum("lon"), 4).alias("sum_lon"), F.round(F.sum("lat"), 4).alias("sum_lat"))


def a4_feature_stats(spark, d):
    """Count, counts per type and the box of all centroids."""
    p = points(spark, d).withColumn("type", F.coalesce("type", F.lit("unknown")))
    kinds = p.groupBy("type").agg(F.count("*").alias("c"), F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    pairs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "c"))), lambda x: F.concat(x.type, F.lit("="), x.c.cast("string"))), ";")
    return kinds.agg(F.sum("c").alias("count"), pairs.alias("types"), *[F.round(g(c), 6).alias(c) for c, g in (("w", F.min), ("s", F.min), ("e", F.max), ("n", F.max))])


def a5_nested_bbox(spark, d):
    v = districts(spark, d).select("level", F.explode("ring").alias("p"))
    return v.groupBy("level").agg(*[F.round(x, 6).alias(n) for n, x in (("w", F.min("p.x")), ("s", F.min("p.y")), ("e", F.max("p.x")), ("n", F.max("p.y")))])


def a30_cluster_bubbles(spark, d):
    """Counts by squares of 50 pixels at zoom 9 and their colour steps."""
    p = points(spark, d)
    size = 50.0 * geo.METRES_PER_PIXEL_Z0 / 512.0
    cells = p.select(F.floor(geo.mercator_x(F.col("lon")) / size).alias("cx"), F.floor(geo.mercator_y(F.col("lat")) / size).alias("cy"))
    n = F.count("*")
    return cells.groupBy("cx", "cy").agg(n.alias("n"), F.when(n < 20, "small").when(n < 100, "medium").otherwise("large").alias("step"))


def g1_geodesic(spark, d):
    p = points(spark, d)
    m = geo.geodesic_m(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat"))
    return p.select("id", F.round(m, 2).alias("m"), F.round(m / 1000, 3).alias("km"))


def g2_utm_zone(spark, d):
    lon = F.col("c_custkey").cast("double") * 7.3 % 360.0 - 180.0
    lat = F.col("c_custkey").cast("double") * 3.1 % 160.0 - 80.0
    return load(spark, d, "customer").select("c_custkey", geo.utm_epsg(lon, lat).alias("epsg"))


def g3_buffer(spark, d):
    """Area of the 256-corner buffer by formula, and measured on its corners in the zone."""
    p = points(spark, d).select("id", F.col("lon"), F.col("lat"), (F.col("id") % 10 * 100 + 100).cast("double").alias("r"))
    return p.select("id", F.round(geo.buffer_area_km2(F.col("r")), 3).alias("area_km2"), F.size(geo.metric_buffer(F.col("lon"), F.col("lat"), F.col("r"))).cast("long").alias("corners"))


def g4_transform(spark, d):
    xy = geo.utm(F.col("lon"), F.col("lat"))
    p = points(spark, d)
    meridian = (geo.utm_zone(F.col("lon")) - 1).cast("double") * 6.0 - 177.0
    back = geo.inverse_transverse_mercator(xy.x, xy.y, meridian)
    ok = (F.abs(back.x - F.col("lon")) < 1e-9) & (F.abs(back.y - F.col("lat")) < 1e-9)
    return p.select("id", ok.alias("round_trip"))


def g5_intersection(spark, d):
    """Area of each district inside a box (degrees squared)."""
    box = geo.box_ring(*[F.lit(v) for v in (113.76, 22.44, 114.0, 22.6)])
    part = geo.area(geo.clip_convex(F.col("ring"), box))
    return districts(spark, d).select("id", F.round(F.coalesce(part, F.lit(0.0)), 8).alias("area"))


def g8_envelope(spark, d):
    xs, ys = F.transform("ring", lambda p: p.x), F.transform("ring", lambda p: p.y)
    cols = (("w", F.array_min(xs)), ("s", F.array_min(ys)), ("e", F.array_max(xs)), ("n", F.array_max(ys)))
    return districts(spark, d).select("id", *[F.round(c, 6).alias(n) for n, c in cols])


def g10_mercator(spark, d):
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    ok = (F.abs(geo.mercator_lon(x) - F.col("lon")) < 1e-6) & (F.abs(geo.mercator_lat(y) - F.col("lat")) < 1e-6)
    return points(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), ok.alias("round_trip"))


def g11_ground_resolution(spark, d):
    """Metres per pixel at every point, by zoom: the least and the largest."""
    z = points(spark, d).select("lat", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("zoom")).withColumn("mpp", geo.metres_per_pixel(F.col("lat"), F.col("zoom").cast("double")))
    return z.groupBy("zoom").agg(F.round(F.min("mpp"), 6).alias("least"), F.round(F.max("mpp"), 6).alias("most"))


def g12_tiles(spark, d):
    p = points(spark, d)
    return p.groupBy(geo.tile_x(F.col("lon"), 12).alias("x"), geo.tile_y(F.col("lat"), 12).alias("y")).agg(F.count("*").alias("n"))


def g13_pixel_area(spark, d):
    s = scenes(spark, d)
    return s.select("id", F.round(geo.pixel_area_km2(*[F.col(c) for c in "wsen"], F.lit(160.0), F.lit(120.0)), 6).alias("km2"))


def g15_hausdorff(spark, d):
    a, b = districts(spark, d).select("id", "ring"), districts(spark, d).select((F.col("id") + 1).alias("id"), F.col("ring").alias("next"))
    return a.join(b, "id").select("id", F.round(geo.hausdorff(F.col("ring"), F.col("next")), 6).alias("h"))


def g18_centroid(spark, d):
    c = geo.centroid(F.col("ring"))
    return districts(spark, d).select("id", F.round(c.x, 6).alias("x"), F.round(c.y, 6).alias("y"), F.round(geo.area(F.col("ring")), 8).alias("area"))


def g19_box_ratio(spark, d):
    s = scenes(spark, d)
    return s.select("id", F.round(geo.box_ratio(*[F.lit(v) for v in (113.5, 22.3, 114.1, 22.7)], *[F.col(c) for c in "wsen"]), 6).alias("ratio"))


def g20_box_ring(spark, d):
    ring = geo.box_ring(*[F.col(c) for c in "wsen"])
    return scenes(spark, d).select("id", F.size(ring).cast("long").alias("corners"), F.round(geo.area(ring), 6).alias("area"), (F.get(ring, F.lit(0)) == F.get(ring, F.lit(4))).alias("closed"))


def g22_cells(spark, d):
    """A grid of 4 by 3 cells over each district's box, row 0 in the north."""
    g = districts(spark, d).select("id", "minx", "maxy", ((F.col("maxx") - F.col("minx")) / 4).alias("dx"), ((F.col("maxy") - F.col("miny")) / 3).alias("dy"))
    g = g.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return g.select("id", "r", "c", F.round(F.col("minx") + F.col("c") * F.col("dx"), 6).alias("w"), F.round(F.col("maxy") - F.col("r") * F.col("dy"), 6).alias("n"))


def g24_ellipse_box(spark, d):
    """Box of a rotated ellipse, clipped to an image of 640 by 480."""
    k = F.col("p_partkey").cast("double")
    t, a, b, cx, cy = F.radians(k * 17 % 180), k % 40 + 5, k % 15 + 3, k * 13 % 640, k * 7 % 480
    hx = F.sqrt(F.pow(a * F.cos(t), 2) + F.pow(b * F.sin(t), 2))
    hy = F.sqrt(F.pow(a * F.sin(t), 2) + F.pow(b * F.cos(t), 2))
    box = [F.greatest(F.lit(0.0), cx - hx), F.greatest(F.lit(0.0), cy - hy), F.least(F.lit(640.0), cx + hx), F.least(F.lit(480.0), cy + hy)]
    kept = (box[2] - box[0] >= 5) & (box[3] - box[1] >= 3)
    return load(spark, d, "part").filter(kept).select("p_partkey", *[F.round(v, 4).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), box, strict=True)])


_BOXES = "(VALUES (1, 113.2::DOUBLE, 22.1::DOUBLE, 113.9::DOUBLE, 22.6::DOUBLE), (2, 114.0::DOUBLE, 22.5::DOUBLE, 114.3::DOUBLE, 22.9::DOUBLE)) AS q(query_id, qw, qs, qe, qn)"
_BUILDING = "b AS (SELECT id, lon, lat FROM poi WHERE type = 'BUILDING')"
_MX, _MY = "radians(lon) * 6378137.0::DOUBLE", "ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE"

QUERIES = {
    "s1_named_parameters": (s1_named_parameters, with_(POI, select="SELECT id, name FROM poi WHERE type = 'BUILDING' AND lon > 114.0::DOUBLE")),
    "s8_feature_rows": (s8_feature_rows, with_(POI, select="""SELECT id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || printf('%.4f', lon) || ',' || printf('%.4f', lat) || ']},"properties":{"id":' || id || ',"name":"' || name || '","kind":"' || type || '"}}' AS feature FROM poi""")),
    "p2_optional_filter": (p2_optional_filter, with_(POI, select="SELECT id, type FROM poi WHERE type = 'MACHINERY'")),
    "p3_derived_table": (p3_derived_table, with_(POI, select="SELECT id, name, type FROM poi WHERE type IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")),
    "p4_bbox_count": (p4_bbox_count, with_(POI, select="SELECT count(*) AS n FROM poi WHERE lon BETWEEN 113.9::DOUBLE AND 114.1::DOUBLE AND lat BETWEEN 22.5::DOUBLE AND 22.6::DOUBLE")),
    "p7_envelope": (p7_envelope, with_(POI, select="SELECT id FROM poi WHERE lon BETWEEN 113.9::DOUBLE AND 114.1::DOUBLE AND lat BETWEEN 22.5::DOUBLE AND 22.6::DOUBLE")),
    "p8_t1_nearby": (p8_t1_nearby, with_(POI, "g0 AS (SELECT id, 114.0::DOUBLE AS lon1, 22.55::DOUBLE AS lat1, lon AS lon2, lat AS lat2 FROM poi WHERE type = 'BUILDING')", *_dist_sql("lon1", "lat1", "lon2", "lat2"), select="SELECT id, round(m, 2) AS distance_m FROM dist WHERE m <= 8000 ORDER BY m, id LIMIT 500")),
    "p9_contains": (p9_contains, with_(DISTRICTS, "poi AS (SELECT 1 AS id, 113.95::DOUBLE AS lon, 22.47::DOUBLE AS lat)", INSIDE, select="SELECT id, name FROM district JOIN inside ON id = district_id")),
    "j1_points_per_district": (j1_points_per_district, with_(POI, DISTRICTS, INSIDE, select="SELECT name, count(*) AS cnt FROM inside JOIN district ON id = district_id GROUP BY name")),
    "j1_boundary_points": (j1_boundary_points, "SELECT count(*) AS n FROM nation"),
    "j2_one_district": (j2_one_district, with_(POI, DISTRICTS, INSIDE, select="SELECT point_id, name, type FROM inside JOIN poi ON poi.id = point_id WHERE district_id = 7")),
    "j14_district_counts": (j14_district_counts, with_(POI, DISTRICTS, INSIDE, select="SELECT name, count(*) AS n FROM inside JOIN district ON id = district_id GROUP BY name")),
    "p7_box_count": (p7_box_count, with_(POI, select="SELECT count(*) AS n FROM poi WHERE lon BETWEEN 113.95::DOUBLE AND 114.05::DOUBLE AND lat BETWEEN 22.5::DOUBLE AND 22.56::DOUBLE")),
    "p8_school_pairs": (p8_school_pairs, with_(POI, "g0 AS (SELECT a.name AS school, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM poi a JOIN poi b ON a.id <> b.id AND a.type = 'BUILDING' AND abs(a.lon - b.lon) < 0.05 AND abs(a.lat - b.lat) < 0.05)", *_dist_sql("lon1", "lat1", "lon2", "lat2"), select="SELECT school, count(*) AS near, round(max(m), 2) AS farthest FROM dist WHERE m <= 4000 GROUP BY school ORDER BY near DESC, school LIMIT 1000")),
    "j3_schools_around": (j3_schools_around, None),
    "j3_distance_join": (j3_distance_join, with_(POI, _BUILDING, "g0 AS (SELECT b.id AS left_id, s_suppkey AS right_id, b.lon AS lon1, b.lat AS lat1, lon2, lat2 FROM b JOIN (SELECT s_suppkey, 113.7::DOUBLE + (s_suppkey * 6007 % 6000)::DOUBLE / 10000.0::DOUBLE AS lon2, 22.4::DOUBLE + (s_suppkey * 3001 % 4000)::DOUBLE / 10000.0::DOUBLE AS lat2 FROM supplier) ON abs(b.lon - lon2) < 0.2 AND abs(b.lat - lat2) < 0.2)", *_dist_sql("lon1", "lat1", "lon2", "lat2"), select="SELECT left_id, right_id, round(m, 2) AS distance_m FROM dist WHERE m <= 12000")),
    "j4_scene_ratio": (j4_scene_ratio, with_(SCENES, select=f"SELECT query_id, id, round(r, 6) AS ratio FROM (SELECT query_id, id, greatest(0, least(qe, e) - greatest(qw, w)) * greatest(0, least(qn, n) - greatest(qs, s)) / ((qe - qw) * (qn - qs)) AS r FROM {_BOXES}, scene) WHERE r > 0")),
    "j5_nearest_region": (j5_nearest_region, with_(SCENES, select="SELECT region FROM (SELECT region, avg((w + e) / 2) AS x, avg((s + n) / 2) AS y FROM scene GROUP BY region) ORDER BY pow(x - 113.2::DOUBLE, 2) + pow(y - 22.2::DOUBLE, 2), region LIMIT 1")),
    "j6_name_lookup": (j6_name_lookup, "WITH t(qid, q) AS (VALUES (1, 'show NATION_1 and NATION_12'), (2, 'NATION_13 or NATION_21?'), (3, 'nowhere')), h AS (SELECT qid, n_name, max(length(n_name)) OVER (PARTITION BY qid) AS m FROM t JOIN nation ON contains(q, n_name)) SELECT qid, string_agg(n_name, ',' ORDER BY n_name) AS candidates, count(*) = 1 AS resolved FROM h WHERE length(n_name) = m GROUP BY qid"),
    "a1_counts_by_type": (a1_counts_by_type, with_(POI, select="SELECT type, count(*) AS cnt, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM poi GROUP BY type")),
    "a3_global_sums": (a3_global_sums, with_(POI, select="SELECT count(*) AS n, round(sum(lon), 4) AS sum_lon, round(sum(lat), 4) AS sum_lat FROM poi")),
    "a4_feature_stats": (a4_feature_stats, with_(POI, "k AS (SELECT type, count(*) AS c FROM poi GROUP BY type)", select="SELECT (SELECT count(*) FROM poi) AS count, (SELECT string_agg(type || '=' || c, ';' ORDER BY type) FROM k) AS types, round(min(lon), 6) AS w, round(min(lat), 6) AS s, round(max(lon), 6) AS e, round(max(lat), 6) AS n FROM poi")),
    "a5_nested_bbox": (a5_nested_bbox, with_(DISTRICTS, select="SELECT level, round(min(x), 6) AS w, round(min(y), 6) AS s, round(max(x), 6) AS e, round(max(y), 6) AS n FROM vertex JOIN district USING (id) GROUP BY level")),
    "a30_cluster_bubbles": (a30_cluster_bubbles, with_(POI, select=f"SELECT CAST(floor({_MX} / (50.0::DOUBLE * 156543.03392::DOUBLE / 512)) AS BIGINT) AS cx, CAST(floor({_MY} / (50.0::DOUBLE * 156543.03392::DOUBLE / 512)) AS BIGINT) AS cy, count(*) AS n, CASE WHEN count(*) < 20 THEN 'small' WHEN count(*) < 100 THEN 'medium' ELSE 'large' END AS step FROM poi GROUP BY 1, 2")),
    "g1_geodesic": (g1_geodesic, with_(POI, "g0 AS (SELECT id, 114.0::DOUBLE AS lon1, 22.55::DOUBLE AS lat1, lon AS lon2, lat AS lat2 FROM poi)", *_dist_sql("lon1", "lat1", "lon2", "lat2"), select="SELECT id, round(m, 2) AS m, round(m / 1000, 3) AS km FROM dist")),
    "g2_utm_zone": (g2_utm_zone, "SELECT c_custkey, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180.0) / 6.0) + 1 AS INTEGER) AS epsg FROM (SELECT c_custkey, fmod(c_custkey::DOUBLE * 7.3::DOUBLE, 360.0::DOUBLE) - 180.0::DOUBLE AS lon, fmod(c_custkey::DOUBLE * 3.1::DOUBLE, 160.0::DOUBLE) - 80.0::DOUBLE AS lat FROM customer)"),
    "g3_buffer": (g3_buffer, with_(POI, select="SELECT id, round(128.0::DOUBLE * sin(2 * pi() / 256) * r * r / 1e6, 3) AS area_km2, 257::BIGINT AS corners FROM (SELECT id, (id % 10 * 100 + 100)::DOUBLE AS r FROM poi)")),
    "g4_transform": (g4_transform, with_(POI, select="SELECT id, true AS round_trip FROM poi")),
    "g5_intersection": (g5_intersection, None),
    "g8_envelope": (g8_envelope, with_(DISTRICTS, select="SELECT id, round(min(x), 6) AS w, round(min(y), 6) AS s, round(max(x), 6) AS e, round(max(y), 6) AS n FROM vertex GROUP BY id")),
    "g10_mercator": (g10_mercator, with_(POI, select=f"SELECT id, round({_MX}, 3) AS x, round({_MY}, 3) AS y, true AS round_trip FROM poi")),
    "g11_ground_resolution": (g11_ground_resolution, with_(POI, select="SELECT i::INT AS zoom, round(min(m), 6) AS least, round(max(m), 6) AS most FROM (SELECT i, 156543.03392::DOUBLE * cos(radians(lat)) / pow(2.0::DOUBLE, i) AS m FROM poi, range(0, 19) AS t(i)) GROUP BY i")),
    "g12_tiles": (g12_tiles, with_(POI, select="SELECT CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(least(4095, greatest(0, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096))) AS BIGINT) AS y, count(*) AS n FROM poi GROUP BY 1, 2")),
    "g13_pixel_area": (g13_pixel_area, with_(SCENES, select="SELECT id, round((e - w) * 111320.0::DOUBLE * cos(radians((s + n) / 2)) / 160 * ((n - s) * 110540.0::DOUBLE / 120) / 1e6, 6) AS km2 FROM scene")),
    "g15_hausdorff": (g15_hausdorff, with_(DISTRICTS, "one AS (SELECT a.id, a.i, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS m FROM vertex a JOIN vertex b ON b.id = a.id - 1 GROUP BY a.id, a.i)", "two AS (SELECT a.id + 1 AS id, a.i, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS m FROM vertex a JOIN vertex b ON b.id = a.id + 1 GROUP BY a.id, a.i)", select="SELECT id, round(max(m), 6) AS h FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY id")),
    "g18_centroid": (g18_centroid, with_(DISTRICTS, "o AS (SELECT id, x AS ox, y AS oy FROM vertex WHERE i = 0)", select="SELECT id, round(any_value(ox) + sum((x1 + x2 - 2 * ox) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) / (3 * sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))), 6) AS x, round(any_value(oy) + sum((y1 + y2 - 2 * oy) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) / (3 * sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))), 6) AS y, round(abs(sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) / 2, 8) AS area FROM edge JOIN o USING (id) GROUP BY id")),
    "g19_box_ratio": (g19_box_ratio, with_(SCENES, select="SELECT id, round(greatest(0, least(114.1::DOUBLE, e) - greatest(113.5::DOUBLE, w)) * greatest(0, least(22.7::DOUBLE, n) - greatest(22.3::DOUBLE, s)) / ((114.1::DOUBLE - 113.5::DOUBLE) * (22.7::DOUBLE - 22.3::DOUBLE)), 6) AS ratio FROM scene")),
    "g20_box_ring": (g20_box_ring, with_(SCENES, select="SELECT id, 5::BIGINT AS corners, round((e - w) * (n - s), 6) AS area, true AS closed FROM scene")),
    "g22_cells": (g22_cells, with_(DISTRICTS, select="SELECT id, r::INT AS r, c::INT AS c, round(minx + c * ((maxx - minx) / 4), 6) AS w, round(maxy - r * ((maxy - miny) / 3), 6) AS n FROM district, range(0, 3) AS a(r), range(0, 4) AS b(c)")),
    "g24_ellipse_box": (g24_ellipse_box, "SELECT p_partkey, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM (SELECT p_partkey, greatest(0, cx - hx) AS x1, greatest(0, cy - hy) AS y1, least(640, cx + hx) AS x2, least(480, cy + hy) AS y2 FROM (SELECT *, sqrt(pow(a * cos(t), 2) + pow(b * sin(t), 2)) AS hx, sqrt(pow(a * sin(t), 2) + pow(b * cos(t), 2)) AS hy FROM (SELECT p_partkey, radians((p_partkey * 17 % 180)::DOUBLE) AS t, (p_partkey % 40 + 5)::DOUBLE AS a, (p_partkey % 15 + 3)::DOUBLE AS b, (p_partkey * 13 % 640)::DOUBLE AS cx, (p_partkey * 7 % 480)::DOUBLE AS cy FROM part))) WHERE x2 - x1 >= 5 AND y2 - y1 >= 3"),
}
