"""Queries over the derived scene catalog, relational ones and windows, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, raster
from ..operators import catalog
from ..sources.raster_store import RasterStore
from ..sources.tables import load, points, scenes
from ..storage import shared_folder
from .ddb import POI, SCENES, with_

WHEN, BOX = "1996-01-01T00:00:00Z/1998-12-31T23:59:59Z", (113.5, 22.3, 114.1, 22.7)
_QUERIES = "query_id int, qw double, qs double, qe double, qn double"


def c1_search(spark, d):
    return catalog.search(scenes(spark, d), WHEN, BOX, 50).select("id", "ordinal")


def scene_pixels(spark, d):
    """Small rasters of the catalog's first scenes: each vector is a picture of eight by eight pixels, and their places."""
    shown = load(spark, d, "embeddings").join(scenes(spark, d).select("id", F.col("ordinal").alias("vec_id"), "w", "n"), "vec_id")
    at = shown.select(F.col("id").alias("scene_id"), "w", "n", F.posexplode("embedding").alias("p", "v"))
    v = F.col("v").cast("double")
    px = at.select("scene_id", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).alias("col"), (F.lit(0.1) + F.abs(v)).alias("b4"), (F.lit(0.2) + v * v).alias("b8"))
    places = shown.select(F.col("id").alias("scene_id"), F.col("w").alias("west"), F.col("n").alias("north"), F.lit(0.01).alias("step"))
    return px, places


def c9_scene_statistics(spark, d):
    """Statistics of all scenes that a search finds and that have pixels, inside the searched box."""
    px, places = scene_pixels(spark, d)
    store = RasterStore(spark, f"{shared_folder(spark)}/rasters-{uuid.uuid4().hex}", 8)
    store.write(px, places, ["b4", "b8"])
    found = catalog.search(scenes(spark, d), None, BOX, 1000).select(F.col("id").alias("scene_id"))
    ndvi = raster.index_or_zero("ndvi")
    out = store.pixels(["b4", "b8"], found, BOX).groupBy("scene_id").agg(F.count("*").alias("px"), F.round(F.avg(ndvi), 6).alias("ndvi"), F.round(F.avg((ndvi > 0.3).cast("int")), 6).alias("green"))
    return out


def c2_collection_items(spark, d):
    return catalog.search(scenes(spark, d), None, None, 20, "region1").select("id", "ordinal")


def c4_collections(spark, d):
    cols = [F.round(c, 6).alias(c) for c in ("w", "s", "e", "n", "cloud_min", "cloud_max")]
    return catalog.collections(scenes(spark, d)).select("region", "n_items", "first", "last", "n_bands", *cols)


def c6_coverage(spark, d):
    q = spark.createDataFrame([(1, 113.2, 22.1, 113.9, 22.6), (2, 114.0, 22.5, 114.05, 22.55), (3, 10.0, 10.0, 11.0, 11.0)], _QUERIES)
    return catalog.coverage(q, scenes(spark, d).select("id", "w", "s", "e", "n")).select("query_id", F.round("best", 6).alias("best"), "n_scenes", "tier")


def c10_date_pairs(spark, d):
    return catalog.date_pair(scenes(spark, d))


def p10_touching_boxes(spark, d):
    return scenes(spark, d).filter(geo.boxes_touch(*(F.col(c) for c in "wsen"), *(F.lit(v) for v in BOX))).select("id")


def p11_overlapping_boxes(spark, d):
    return scenes(spark, d).filter(geo.boxes_overlap(*(F.col(c) for c in "wsen"), *(F.lit(v) for v in BOX))).select("id")


def p12_open_range(spark, d):
    return catalog.search(scenes(spark, d), "2000-01-01T00:00:00Z/..", None, 1000).groupBy().agg(F.count("*").alias("n"), F.min("date").alias("first"))


def p13_p14_cloud(spark, d):
    s = scenes(spark, d)
    return s.agg(F.count_if(F.coalesce("cloud", F.lit(0.0)) <= 20.0).alias("at_most"), F.count_if(F.col("cloud") < 20.0).alias("below"))


def p15_tile_id(spark, d):
    return scenes(spark, d).groupBy(F.split("id", "_")[1].alias("tile"), F.split("id", "_")[2].rlike(r"^\d{8}$").alias("dated")).agg(F.count("*").alias("n"))


def w3_largest_per_name(spark, d):
    """The scene with the largest box per region; the first by order on ties."""
    size = (F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))
    return scenes(spark, d).groupBy("region").agg(F.max_by("id", F.struct(F.round(size, 9), -F.col("ordinal"))).alias("id"))


def w5_keep_first(spark, d):
    """One point per type and rounded place, the first by id."""
    p = points(spark, d)
    place = [F.round("lon", 1).alias("x"), F.round("lat", 1).alias("y")]
    return p.groupBy("type", *place).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def w8_rescan(spark, d):
    """Each year's scenes against the first year's."""
    per = scenes(spark, d).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"))
    w = Window.orderBy("year")  # one row per year
    return per.select("year", "n", (F.col("n") - F.first("n").over(w)).alias("since_first"), (F.col("n") - F.lag("n").over(w)).alias("since_last"))


def w10_latest_state(spark, d):
    """Last event per user, and how many there were."""
    e = load(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("*").alias("n"))


def t6_ordered_scenes(spark, d):
    """The ten scenes that cover a box best, the earlier first on ties."""
    ratio = F.round(geo.box_ratio(*[F.lit(v) for v in BOX], *[F.col(c) for c in "wsen"]), 6)
    return scenes(spark, d).select("id", ratio.alias("ratio"), "date").orderBy(F.desc("ratio"), "date", "id").limit(10).select("id", "ratio")


def t8_label_order(spark, d):
    p = load(spark, d, "part")
    priority = F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1)
    w = Window.partitionBy("p_brand").orderBy(priority, F.desc("p_retailprice"), "p_partkey")
    return p.select("p_brand", "p_partkey", F.row_number().over(w).alias("rank")).filter("rank <= 3")


def t11_evict_oldest(spark, d):
    """Events beyond the newest 16 of a user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("r")).filter("r > 16").select("user_id", "event_id")


def s12_replace_scenes(spark, d):
    s = scenes(spark, d).select("id", "cloud", "ordinal")
    new = s.filter("ordinal % 4 = 0").withColumn("cloud", F.lit(0.0))
    return catalog.replace_scenes(s, new.unionByName(new.withColumn("cloud", F.lit(1.0)).withColumn("ordinal", F.col("ordinal") + 1)))


def s15_hierarchy(spark, d):
    """Regions, nations and customers per branch, by a recursive walk over parent codes."""
    for t in ("region", "nation"):
        load(spark, d, t).createOrReplaceTempView(f"tree_{t}")
    return spark.sql("""
        WITH RECURSIVE node AS (
          SELECT 'r' || r_regionkey AS code, CAST(NULL AS STRING) AS parent FROM tree_region
          UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM tree_nation),
        walk AS (SELECT code, code AS root, 0 AS depth FROM node WHERE parent IS NULL
          UNION ALL SELECT n.code, w.root, w.depth + 1 FROM node n JOIN walk w ON n.parent = w.code)
        SELECT root, depth, count(*) AS n FROM walk GROUP BY root, depth""")


def s16_boundary_import(spark, d):
    """Upsert by (name, level): incoming rows drop the same name of the other level."""
    n = load(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "district").otherwise("city").alias("level"), F.lit("old").alias("v"))
    new = load(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.lit("district").alias("level"), F.lit("new").alias("v"))
    return n.join(new.select("name"), "name", "left_anti").unionByName(new)


def setops(spark, d):
    p = points(spark, d)
    a, b = p.filter("lon > 114").select("type", "id"), p.filter("lat > 22.6").select("type", "id")
    count = lambda df, k: df.groupBy("type").agg(F.count("*").alias("n")).withColumn("k", F.lit(k))
    return count(a.intersect(b), "both").unionByName(count(a.exceptAll(b), "only_a")).unionByName(count(a.union(b).distinct(), "any"))


def f5_dates(spark, d):
    """Dates in four formats and ranges."""
    o = load(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    day = F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("~2030-01-01"))).otherwise(F.date_format(day, "yyyy-MM"))
    return o.select("o_orderkey", catalog.parse_date(text).cast("timestamp_ntz").alias("at"))


def y_windows(spark, d):
    """Events per hour and type."""
    e = load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "v")


def y2_progress(spark, d):
    """Running share of a user's events done, in order."""
    e = load(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    all_ = F.count("*").over(Window.partitionBy("user_id"))
    return e.select("user_id", "event_id", F.round(F.row_number().over(w) / all_, 6).alias("progress"))


def y3_validation(spark, d):
    """Submitted jobs checked by type and size."""
    k = F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in ("segment", "big_image", "cyanobacteria", "other")]), (k % 4).cast("int"))
    size, tile = k * 37 % 10000, F.get(F.array(F.lit(256), F.lit(512), F.lit(1024), F.lit(300)), (k % 7 % 4).cast("int"))
    bad = F.when(~kind.isin("segment", "big_image", "cyanobacteria"), "type").when(size > 8192, "size").when(~tile.isin(256, 512, 1024), "tile").otherwise("ok")
    return load(spark, d, "events").groupBy(bad.alias("verdict")).agg(F.count("*").alias("n"))


def y4_poll(spark, d):
    """What a poll shows: the value only once a user's last event is a purchase."""
    last = load(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", F.col("x.event_type").alias("status"), F.when(F.col("x.event_type").isin("purchase", "error"), F.col("x.value")).alias("result"))


def y6_event_projection(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(F.col("event_type") == "click", F.substring("props", 1, 6)).alias("summary"))


def p5_json_filter(spark, d):
    e = load(spark, d, "events")
    return e.filter((F.get_json_object("props", "$.k") == "7") & (F.col("event_type") == "click")).select("event_id")


def a2_top_group(spark, d):
    o = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return o.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))


def a13_percentiles(spark, d):
    q = load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(*[F.lit(x) for x in (0.02, 0.1, 0.5, 0.9, 0.98)])).alias("q"))
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(f"q{i}") for i in range(5)])


def a14_median_mad(spark, d):
    from ..operators.change import robust_z

    z = robust_z(load(spark, d, "customer"), "c_acctbal", ["c_mktsegment"], F.lit(True))
    return z.groupBy("c_mktsegment").agg(F.round(F.max("med"), 4).alias("med"), F.round(F.max("mad"), 4).alias("mad"), F.count_if(F.abs("z") > 1.2).alias("far"))


def a27_distinct(spark, d):
    p = load(spark, d, "part")
    return p.agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_size").alias("sizes"), F.min("p_retailprice").alias("mn"), F.max("p_retailprice").alias("mx"))


_Q6 = "(VALUES (1, 113.2::DOUBLE, 22.1::DOUBLE, 113.9::DOUBLE, 22.6::DOUBLE), (2, 114.0::DOUBLE, 22.5::DOUBLE, 114.05::DOUBLE, 22.55::DOUBLE), (3, 10.0::DOUBLE, 10.0::DOUBLE, 11.0::DOUBLE, 11.0::DOUBLE)) AS q(query_id, qw, qs, qe, qn)"
_TOUCH = "NOT (e < 113.5::DOUBLE OR w > 114.1::DOUBLE OR n < 22.3::DOUBLE OR s > 22.7::DOUBLE)"
_RATIO = "greatest(0, least(114.1::DOUBLE, e) - greatest(113.5::DOUBLE, w)) * greatest(0, least(22.7::DOUBLE, n) - greatest(22.3::DOUBLE, s)) / ((114.1::DOUBLE - 113.5::DOUBLE) * (22.7::DOUBLE - 22.3::DOUBLE))"

QUERIES = {
    "c1_search": (c1_search, with_(SCENES, select=f"SELECT id, ordinal FROM scene WHERE date BETWEEN '1996-01-01' AND '1998-12-31 23:59:59' AND {_TOUCH} ORDER BY ordinal LIMIT 50")),
    "c2_collection_items": (c2_collection_items, with_(SCENES, select="SELECT id, ordinal FROM scene WHERE region = 'region1' ORDER BY ordinal LIMIT 20")),
    "c9_scene_statistics": (c9_scene_statistics, with_(SCENES, f"found AS (SELECT * FROM scene WHERE {_TOUCH} ORDER BY ordinal LIMIT 1000)",
        "px AS (SELECT id, w + ((p % 8) + 0.5::DOUBLE) * 0.01::DOUBLE AS x, n - ((p // 8) + 0.5::DOUBLE) * 0.01::DOUBLE AS y, 0.1::DOUBLE + abs(v) AS b4, 0.2::DOUBLE + v * v AS b8 FROM (SELECT found.*, p, embedding[p + 1]::DOUBLE AS v FROM found JOIN embeddings ON vec_id = ordinal, unnest(range(0, len(embedding))) AS u(p)))",
        "part AS (SELECT id, (b8 - b4) / (b8 + b4) AS ndvi FROM px WHERE x >= 113.5 - 1e-9 AND x < 114.1 - 1e-9 AND y <= 22.7 + 1e-9 AND y > 22.3 + 1e-9)",
        select="SELECT id AS scene_id, count(*) AS px, round(avg(ndvi), 6) AS ndvi, round(avg((ndvi > 0.3::DOUBLE)::INT), 6) AS green FROM part GROUP BY id")),
    "c4_collections": (c4_collections, with_(SCENES, select="SELECT region, count(*) AS n_items, min(date) AS first, max(date) AS last, max(n_bands) AS n_bands, round(min(w), 6) AS w, round(min(s), 6) AS s, round(max(e), 6) AS e, round(max(n), 6) AS n, round(min(cloud), 6) AS cloud_min, round(max(cloud), 6) AS cloud_max FROM scene GROUP BY region")),
    "c6_coverage": (c6_coverage, with_(SCENES, "hit AS (SELECT query_id, greatest(0, least(qe, e) - greatest(qw, w)) * greatest(0, least(qn, n) - greatest(qs, s)) / ((qe - qw) * (qn - qs)) AS r FROM scene, " + _Q6 + ")", select="SELECT query_id, round(max(r), 6) AS best, count(*) FILTER (WHERE r > 0) AS n_scenes, CASE WHEN max(r) >= 0.95 THEN 'full' WHEN max(r) > 0 THEN 'partial' ELSE 'none' END AS tier FROM hit GROUP BY 1")),
    "c10_date_pairs": (c10_date_pairs, with_(SCENES, "y AS (SELECT * FROM scene)", "span AS (SELECT region, min(year(date)) AS a, max(year(date)) AS b FROM y GROUP BY 1)", "miss AS (SELECT region, coalesce(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FILTER (WHERE t NOT IN (SELECT year(date) FROM y WHERE y.region = span.region)), '') AS missing_years FROM span, range(1990, 2010) AS r(t) WHERE t BETWEEN a AND b GROUP BY region)", select="SELECT region, arg_min(id, (date, id)) AS first, arg_max(id, (date, id)) AS last, any_value(missing_years) AS missing_years FROM y JOIN miss USING (region) GROUP BY region")),
    "p10_touching_boxes": (p10_touching_boxes, with_(SCENES, select=f"SELECT id FROM scene WHERE {_TOUCH}")),
    "p11_overlapping_boxes": (p11_overlapping_boxes, with_(SCENES, select="SELECT id FROM scene WHERE w < 114.1::DOUBLE AND e > 113.5::DOUBLE AND s < 22.7::DOUBLE AND n > 22.3::DOUBLE")),
    "p12_open_range": (p12_open_range, with_(SCENES, select="SELECT count(*) AS n, min(date) AS first FROM (SELECT * FROM scene WHERE date >= '2000-01-01' ORDER BY ordinal LIMIT 1000)")),
    "p13_p14_cloud": (p13_p14_cloud, with_(SCENES, select="SELECT count(*) FILTER (WHERE cloud <= 20) AS at_most, count(*) FILTER (WHERE cloud < 20) AS below FROM scene")),
    "p15_tile_id": (p15_tile_id, with_(SCENES, select="SELECT 'T' || (ordinal % 7) AS tile, true AS dated, count(*) AS n FROM scene GROUP BY 1")),
    "w3_largest_per_name": (w3_largest_per_name, with_(SCENES, select="SELECT region, arg_max(id, (round((e - w) * (n - s), 9), -ordinal)) AS id FROM scene GROUP BY 1")),
    "w5_keep_first": (w5_keep_first, with_(POI, select="SELECT type, round(lon, 1) AS x, round(lat, 1) AS y, min(id) AS id, count(*) AS n FROM poi GROUP BY 1, 2, 3")),
    "w8_rescan": (w8_rescan, with_(SCENES, "p AS (SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM scene GROUP BY 1)", select="SELECT year, n, n - first(n) OVER w AS since_first, n - lag(n) OVER w AS since_last FROM p WINDOW w AS (ORDER BY year)")),
    "w10_latest_state": (w10_latest_state, "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at, count(*) AS n FROM events GROUP BY 1"),
    "t6_ordered_scenes": (t6_ordered_scenes, with_(SCENES, select=f"SELECT id, ratio FROM (SELECT id, date, round({_RATIO}, 6) AS ratio FROM scene) ORDER BY ratio DESC, date, id LIMIT 10")),
    "t8_label_order": (t8_label_order, "SELECT * FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 3"),
    "t11_evict_oldest": (t11_evict_oldest, "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 16"),
    "s12_replace_scenes": (s12_replace_scenes, with_(SCENES, select="SELECT id, CASE WHEN ordinal % 4 = 0 THEN 0 ELSE cloud END AS cloud, ordinal FROM scene")),
    "s15_hierarchy": (s15_hierarchy, "SELECT 'r' || r_regionkey AS root, 0 AS depth, 1::BIGINT AS n FROM region UNION ALL SELECT 'r' || n_regionkey, 1, count(*) FROM nation GROUP BY n_regionkey"),
    "s16_boundary_import": (s16_boundary_import, "SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 2 = 0 THEN 'district' ELSE 'city' END AS level, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM nation"),
    "setops": (setops, with_(POI, select=" UNION ALL ".join(f"SELECT type, count(*) AS n, '{k}' AS k FROM poi WHERE {c} GROUP BY type" for k, c in (("both", "lon > 114 AND lat > 22.6::DOUBLE"), ("only_a", "lon > 114 AND NOT lat > 22.6::DOUBLE"), ("any", "lon > 114 OR lat > 22.6::DOUBLE"))))),
    "f5_dates": (f5_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END::TIMESTAMP AS at FROM orders"),
    "y_windows": (y_windows, "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2"),
    "y2_progress": (y2_progress, "SELECT user_id, event_id, round(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id), 6) AS progress FROM events"),
    "y3_validation": (y3_validation, "SELECT CASE WHEN event_id % 4 = 3 THEN 'type' WHEN event_id * 37 % 10000 > 8192 THEN 'size' WHEN event_id % 7 % 4 = 3 THEN 'tile' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY 1"),
    "y4_poll": (y4_poll, "SELECT user_id, status, CASE WHEN status IN ('purchase', 'error') THEN v END AS result FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1)"),
    "y6_event_projection": (y6_event_projection, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type = 'click' THEN substr(props, 1, 6) END AS summary FROM events"),
    "p5_json_filter": (p5_json_filter, "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7' AND event_type = 'click'"),
    "a2_top_group": (a2_top_group, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2"),
    "a13_percentiles": (a13_percentiles, "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS q{i}" for i, q in enumerate((0.02, 0.1, 0.5, 0.9, 0.98))) + " FROM lineitem GROUP BY 1"),
    "a14_median_mad": (a14_median_mad, "SELECT c_mktsegment, round(max(med), 4) AS med, round(max(mad), 4) AS mad, count(*) FILTER (WHERE abs((c_acctbal - med) / greatest(1.4826::DOUBLE * mad, 1e-6)) > 1.2) AS far FROM (SELECT *, median(abs(c_acctbal - med)) OVER (PARTITION BY c_mktsegment) AS mad FROM (SELECT *, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS med FROM customer)) GROUP BY 1"),
    "a27_distinct": (a27_distinct, "SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_size) AS sizes, min(p_retailprice) AS mn, max(p_retailprice) AS mx FROM part"),
}
