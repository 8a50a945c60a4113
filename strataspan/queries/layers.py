"""Queries over polygons with holes, scene footprints, raster parts and features, with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import geo, raster, wkt
from ..operators import cartography, change, coverage, layers, overlay, polygons, raster_reads
from ..operators import spatial_join as sj
from ..plans.intents import MapIntent
from ..plans.map_style import assemble
from ..schemas import BANDS
from ..sources.spatial_load import SpatialTables, named_boundaries
from ..sources.tables import OUTLINES, districts, load, points, scenes
from ..sources import files
from ..storage import materialise, shared_folder
from .ddb import DISTRICTS, POI, SCENES, with_
from .rasters import _USABLE, PATCHES, PERIOD, SPOT, WIDTH, _sql, height, scene, sql_value

GRID = raster_reads.Grid(113.9, 22.62, 0.001)
LABEL = (113.95, 22.47)


def m11_s39_overlay(spark, d):
    """Built-up land gained and lost (a block with holes), written as an overlay and read back: areas told and drawn."""
    marked = change.gain_loss(change.pixel_join(scene(spark, d, "c"), scene(spark, d, "d")), "builtup")
    kept = change.kept_patches(marked, "builtup")
    out = layers.change_features(layers.change_patches(kept, ["kind"], GRID.west, GRID.north, GRID.step), 100.0, "builtup", "c-d")
    root = f"{shared_folder(spark)}/overlays-{uuid.uuid4().hex}"
    name = layers.write_overlay(out, root, "builtup", "20240101_000000")
    shape = "struct<properties:struct<kind:string,area_m2:double>,geometry:struct<coordinates:array<array<array<array<double>>>>>>"
    f = spark.read.text(f"{root}/{name}").select(F.from_json("value", shape).alias("f")).select("f.*")
    loop = lambda r: geo.area(F.transform(r, lambda p: geo.point(p[0], p[1])))
    drawn = F.aggregate("geometry.coordinates", F.lit(0.0), lambda s, p: s + loop(p[0]) - F.aggregate(F.slice(p, 2, F.size(p)), F.lit(0.0), lambda t, h: t + loop(h)))
    return f.groupBy("properties.kind").agg(F.count("*").alias("n"), F.sum("properties.area_m2").alias("area_m2"), F.round(F.sum(drawn) / GRID.step**2, 2).alias("drawn_px"))


def m6_label_features(spark, d):
    """The labels of map tiles of zoom 11 as GeoJSON."""
    p = points(spark, d)
    f = p.select(geo.tile_x(F.col("lon"), 11).alias("tx"), geo.tile_y(F.col("lat"), 11).alias("ty"), "name", geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"),
                 F.when(F.col("type") == "BUILDING", 0).otherwise(1).alias("priority"), F.lit(0.0).alias("area"))
    placed = cartography.place_labels(f, ["tx", "ty"], geo.METRES_PER_PIXEL_Z0 / 2**11)
    kinds = p.select("name", F.col("type").alias("class"), F.when(F.col("type") == "BUILDING", 0).otherwise(1).alias("priority"))
    return layers.label_features(placed.join(kinds, "name"), ["tx", "ty"])


def m7_map_layers(spark, d):
    """Maps of points and of a vegetation index: their layers in drawing order, and how many
    features each draws out of the folder that its source names."""
    root = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
    files.write_features(layers.point_features(points(spark, d).withColumnRenamed("type", "class")), f"{root}/points")
    files.write_features(layers.polygon_features(districts(spark, d).withColumnRenamed("level", "class")), f"{root}/polygons")
    cells = scene(spark, d, "c").groupBy(F.floor(F.col("row") / 16).alias("r"), F.floor(F.col("col") / 16).alias("c")).agg(F.avg(raster.index_or_zero("ndvi")).alias("ndvi"))
    w, n, size = GRID.west + F.col("c") * 16 * GRID.step, GRID.north - F.col("r") * 16 * GRID.step, 16 * GRID.step
    files.write_features(layers.grid_features(cells.select("ndvi", w.alias("w"), (n - size).alias("s"), (w + size).alias("e"), n.alias("n")), "ndvi"), f"{root}/grid")
    box, out = (113.7, 22.4, 114.3, 22.8), []
    for theme in ("poi", "ndvi"):
        style = assemble(MapIntent(theme, "all", ["school"] if theme == "poi" else [], []), box, {k: f"{root}/{k}" for k in ("points", "polygons", "grid")})
        for i, layer in enumerate(style["layers"]):
            drawn = spark.read.text(style["sources"][layer["source"]]["data"]).filter(F.get_json_object("value", "$.geometry.coordinates").isNotNull())
            out.append(drawn.agg(F.count("*").alias("n")).select(F.lit(theme).alias("theme"), F.lit(i).alias("place"), F.lit(layer["id"]).alias("layer"), F.lit(layer["type"]).alias("kind"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def s18_spatial_load(spark, d):
    """Boundaries and points loaded, two types of points derived into schools, then a batch and
    one more row, with parameters; rows by table and type."""
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    t = SpatialTables(spark, f"load_{uuid.uuid4().hex}", folder)
    t.load(districts(spark, d), points(spark, d), ["BUILDING", "HOUSEHOLD"])
    t.insert("schools", load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("added").alias("type")))
    t.execute(f"INSERT INTO {t.name('schools')} SELECT :id, :name, :type, null", {"id": -1, "name": "it's one", "type": "single"})
    rows = spark.table(t.name("admin_boundary")).select(F.lit("admin_boundary").alias("place"), F.col("level").alias("type"), "id")
    for name in ("poi", "schools"):
        rows = rows.unionByName(spark.table(t.name(name)).select(F.lit(name).alias("place"), "type", "id"))
    return rows.groupBy("place", "type").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def m12_named_boundaries(spark, d):
    """Boundaries that the suppliers' questions name."""
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("How many schools are in "), F.lower(F.substring("n_name", 1, 1)), F.lit(" or "), "n_name", F.lit("s and NATION_3?"))
    hits = named_boundaries(s.select("s_suppkey", text.alias("text")), districts(spark, d), "s_suppkey")
    return hits.select("s_suppkey", "id", "name", "level", F.size("ring").alias("corners"))


def s6_s7_generated(spark, d):
    """Generated rows, up to seven for each order, written as Parquet and read back."""
    grown = load(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.col("o_orderkey") % 7)).alias("k")).select((F.col("o_orderkey") * 7 + F.col("k")).alias("id"))
    at = grown.select("id", (F.lit(113.7) + (F.col("id") * 7919 % 6000).cast("double") / 10000.0).alias("lon"), (F.col("id") % 7).alias("kind"))
    return materialise(at, "generated").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("lon"))


def s19_scaled(spark, d):
    px = scene(spark, d, "c").withColumns({c: F.round(F.col(c) * 10000).cast("int") for c in ("b2", "b8")})
    return raster_reads.scaled(px, ["b2", "b8"]).agg(F.round(F.sum("b2"), 4).alias("b2"), F.round(F.sum("b8"), 4).alias("b8"))


def s21_box_read(spark, d):
    """A box in 8 x 6 cells, with the default bands."""
    out = raster_reads.read_box(scene(spark, d, "c"), GRID, (113.94, 22.522, 114.021, 22.602), 8, 6)
    return out.select("y", "x", *[F.round(c, 6).alias(c) for c in ("b2", "b3", "b4")])


def s22_tile_read(spark, d):
    """A map tile of zoom 12 in 256 x 256 cells."""
    tx, ty = (int(v) for v in ((113.98 + 180) / 360 * 4096, (0.5 - math.log(math.tan(math.pi / 4 + math.radians(22.55) / 2)) / (2 * math.pi)) * 4096))
    return raster_reads.read_tile(scene(spark, d, "c"), GRID, 12, tx, ty, ["b4"]).select("y", "x", F.round("b4", 6).alias("b4"))


def s23_raster_info(spark, d):
    out = raster_reads.info(scene(spark, d, "c"), GRID, list(raster.BAND_COLUMNS))
    return out.select("scene_id", "height", "width", "n_bands", *[F.round(c, 6).alias(c) for c in "wsen"])


def r11_water_agreement(spark, d):
    """Water by theme against a positive water index."""
    a, b = raster.theme("water"), raster.index_or_zero("ndwi") > 0
    return scene(spark, d, "d").agg(F.count_if(a).alias("theme"), F.count_if(b).alias("by_index"), F.round(F.avg((a == b).cast("int")), 6).alias("agreement"))


def r17_smoothed(spark, d):
    return raster_reads.smooth(scene(spark, d, "c"), "b8", height(spark, d), WIDTH).select("row", "col", F.round("b8", 6).alias("b8"))


def r22_objects(spark, d):
    """Blocks with bright or dark near infrared as objects, classed by their mean, the rest by pixel."""
    px = scene(spark, d, "d")
    masks = px.filter("(row div 24 + col div 32) % 2 = 0").select("scene_id", "row", "col", (F.floor(F.col("row") / 24) * 100 + F.floor(F.col("col") / 32)).alias("mask"))
    out = raster_reads.label_objects(px, masks, F.col("b8"), F.when(F.col("mean") > 0.2, "green").otherwise("other"), F.when(F.col("b8") < 0.1, "water").otherwise("land"))
    return out.groupBy("label", F.col("mask").isNotNull().alias("object")).agg(F.count("*").alias("n"))


def t12_masks(spark, d):
    """Nested squares and a speck every 120 rows; small masks stay on top."""
    px = scene(spark, d, "a").select("scene_id", "row", "col")
    masks = [px.filter(where).withColumn("mask", F.expr(f"row div {PERIOD} * 4 + {i}")) for i, where in enumerate(_MASKS)]
    union = masks[0].unionByName(masks[1]).unionByName(masks[2]).unionByName(masks[3])
    return raster_reads.overwrite_masks(union).groupBy("mask").agg(F.count("*").alias("n"))


_MASKS = [f"row % {PERIOD} {rows} AND {cols}" for rows, cols in (("< 60", "col < 60"), ("BETWEEN 20 AND 39", "col BETWEEN 20 AND 39"), ("BETWEEN 25 AND 29", "col < 90"), ("BETWEEN 30 AND 33", "col BETWEEN 30 AND 33"))]


def j12_class_names(spark, d):
    names = spark.createDataFrame([(0, "water"), (1, "other"), (2, "vegetation")], "label int, name string")
    px = scene(spark, d, "c").groupBy(raster.pseudo_label().alias("label")).agg(F.count("*").alias("n"))
    return px.join(names, "label", "left").select("label", F.coalesce("name", F.lit("unknown")).alias("name"), "n")


def g7_wkt(spark, d):
    """Rings to WKT and GeoJSON and back."""
    t = districts(spark, d).select("id", "ring", wkt.ring_text(F.col("ring")).alias("text"), wkt.geojson_of(F.col("ring")).alias("json"))
    t = t.withColumns({"a": wkt.rings_of(F.col("text")), "b": wkt.rings_of_geojson(F.col("json"))})
    return t.select("id", F.size(F.col("a")[0]).alias("n_points"), F.round(geo.area(F.col("a")[0]) * 1e6, 3).alias("area"), (F.col("a")[0] == F.col("ring")).alias("same_text"), (F.col("b")[0] == F.col("ring")).alias("same_json"))


def g14_simplified(spark, d):
    """Middles of sides go, corners stay."""
    dense = districts(spark, d).select("id", F.flatten(F.transform(geo.edges(F.col("ring")), lambda e: F.array(geo.point(e.x1, e.y1), geo.point((e.x1 + e.x2) / 2, (e.y1 + e.y2) / 2)))).alias("most"), F.col("ring")[0].alias("first"))
    dense = dense.select("id", F.concat("most", F.array("first")).alias("ring"), F.lit(1e-6).alias("tolerance")).withColumn("before", F.size("ring"))
    out = cartography.simplify(dense, "ring", "tolerance")
    return out.select("id", "before", F.size("ring").alias("after"), F.round(geo.area(F.col("ring")) * 1e6, 3).alias("area"))


def g14_coverage(spark, d):
    """Districts with more corners on their sides than they need, simplified together."""
    def between(e, k):
        return geo.point(e.x1 + (e.x2 - e.x1) * k / 4, e.y1 + (e.y2 - e.y1) * k / 4)

    dense = F.flatten(F.transform(geo.edges(F.col("ring")), lambda e: F.array(geo.point(e.x1, e.y1), between(e, 1), between(e, 2), between(e, 3))))
    b = districts(spark, d).select("id", F.array(F.concat(dense, F.slice("ring", 1, 1))).alias("rings"))
    out = coverage.simplified_areas(b, "id", "rings", 1e-6)
    return out.select("id", F.round(F.col("area") * 1e6, 3).alias("area"))


def j10_holes(spark, d):
    """Every district with a small box in its lower half as a hole."""
    b = districts(spark, d).withColumn("level", F.lit("all"))
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    hole = geo.box_ring(F.col("minx") + w * 0.45, F.col("miny") + h * 0.1, F.col("minx") + w * 0.55, F.col("miny") + h * 0.2)
    out = polygons.assign_holes(b.select("level", F.col("id").alias("shell"), "ring"), b.select("level", F.col("id").alias("hole"), hole.alias("ring")), "level")
    return out.select("shell", F.size("holes").alias("holes"), F.round(polygons.area_with_holes(F.col("ring"), F.col("holes")) * 1e6, 3).alias("area"))


def g17_ring_choice(spark, d):
    b = districts(spark, d).withColumns({"x": F.lit(LABEL[0]), "y": F.lit(LABEL[1])})
    return polygons.choose_ring(b, ["level"], "x", "y").select("level", "id", "contains")


def _arrows(spark, d):
    """Districts, each with a concave arrow that lies across its borders."""
    b = districts(spark, d)
    arrow = F.array(*[geo.point(F.col("minx") + (0.5 + u) * 0.12, F.col("miny") + (0.4 + v) * 0.08) for u, v in OUTLINES[2]])
    return b.select("id", F.array("ring").alias("a"), F.array(arrow).alias("b"))


def g5_overlay(spark, d):
    """Areas of intersection, union and difference of concave polygons."""
    out = districts(spark, d).select("id")
    for how in ("intersection", "union", "difference"):
        areas = overlay.overlay_areas(_arrows(spark, d), ["id"], "a", "b", how).select("id", F.round(F.col("area") * 1e6, 3).alias(how))
        out = out.join(areas, "id", "left").withColumn(how, F.coalesce(how, F.lit(0.0)))
    return out


def g5_parts(spark, d):
    """The polygons of the differences: their number and that of holes."""
    out = overlay.overlay(_arrows(spark, d), ["id"], "a", "b", "difference")
    return out.groupBy("id").agg(F.count("*").alias("parts"), F.sum(F.size("holes")).alias("holes"), F.round(F.sum(polygons.area_with_holes(F.col("ring"), F.col("holes"))) * 1e6, 3).alias("area"))


def g16_repaired(spark, d):
    """A ring through the corners of each scene's box in the wrong order becomes two triangles."""
    corners = [geo.point(F.col(x), F.col(y)) for x, y in ("ws", "en", "es", "wn", "ws")]
    out = overlay.repaired_areas(scenes(spark, d).select("id", F.array(F.array(*corners)).alias("rings")), ["id"], "rings")
    return out.select("id", F.round("area", 6).alias("area"))


def g16_assembled(spark, d):
    """Districts put together from their sides, every second one of which is turned round."""
    side = lambda e, i: F.when(i % 2 == 0, F.array(geo.point(e.x1, e.y1), geo.point(e.x2, e.y2))).otherwise(F.array(geo.point(e.x2, e.y2), geo.point(e.x1, e.y1)))
    lines = districts(spark, d).select("id", F.explode(F.transform(geo.edges(F.col("ring")), side)).alias("line"))
    out = cartography.assemble_rings(lines, "id")
    return out.select("id", F.size("ring").alias("corners"), F.round(geo.area(F.col("ring")) * 1e6, 3).alias("area"))


def g21_bounds(spark, d):
    """Mercator bounds of scenes back in degrees."""
    s = scenes(spark, d)
    at = [geo.mercator_x(F.col("w")), geo.mercator_y(F.col("s")), geo.mercator_x(F.col("e")), geo.mercator_y(F.col("n"))]
    box = polygons.bounds_in_degrees(*at, lambda x, y: (geo.mercator_lon(x), geo.mercator_lat(y)))
    return s.select("id", *[F.round(box[c], 6).alias(c) for c in "wsen"])


def _covered(spark, d):
    q = districts(spark, d).select(F.col("id").alias("query_id"), F.col("minx").alias("qw"), F.col("miny").alias("qs"), F.col("maxx").alias("qe"), F.col("maxy").alias("qn"))
    return sj.covering_boxes(q, scenes(spark, d).select("id", "w", "s", "e", "n"))


def g25_t7_coverage(spark, d):
    """Scenes that cover a tenth of a district or more."""
    return _covered(spark, d).filter("ratio >= 0.1").groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("ratio"), 6).alias("best"))


def w9_best_scenes(spark, d):
    """The five scenes that cover most of each district."""
    out = _covered(spark, d).withColumn("ratio", F.round("ratio", 6))
    return polygons.best_scenes(out).select("query_id", "id", "ratio", "place")


def p16_dated_scenes(spark, d):
    """Scenes with a date of eight digits in their name, by month of that date."""
    day = F.regexp_extract("id", r"(?<!\d)(\d{8})(?!\d)", 1)
    return scenes(spark, d).filter(day != "").groupBy(F.substring(day, 1, 6).alias("month")).agg(F.count("*").alias("n"))


def _banded(spark, d):
    return scenes(spark, d).withColumn("bands", F.slice(F.array(*map(F.lit, BANDS)), 1, F.col("n_bands")))


def a18_extents(spark, d):
    out, _ = polygons.extents(_banded(spark, d), "region")
    return out.select("region", "first", "last", F.round("cloud_min", 6).alias("cloud_min"), F.round("cloud_max", 6).alias("cloud_max"), "n_boxes", F.array_join("bands", ",").alias("bands"))


def a18_boxes(spark, d):
    _, boxes = polygons.extents(_banded(spark, d), "region")
    return boxes.select("region", *[F.round(c, 6).alias(c) for c in "wsen"])


def c5_region_titles(spark, d):
    known = spark.createDataFrame([("region0", "Bay", "Scenes of the bay")], "region string, title string, description string")
    return polygons.region_titles(scenes(spark, d).select("region").distinct(), known)


def t10_listing(spark, d):
    return points(spark, d).select("id", "name", "type").orderBy("type", "name")


def a28_event_values(spark, d):
    """Mean, least and median of the values by kind of event."""
    e = load(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("middle"))


def p27_geometry_kinds(spark, d):
    """Features parted into points and others."""
    all_ = points(spark, d).select("id", wkt.point_text(F.col("lon"), F.col("lat")).alias("geometry")).unionByName(districts(spark, d).select("id", wkt.ring_text(F.col("ring")).alias("geometry")))
    return all_.groupBy(F.col("geometry").rlike("^POINT").alias("is_point")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _detections(spark, d):
    return load(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("image"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_quantity") % 12).alias("w"), (F.col("l_partkey") % 9).cast("double").alias("h"), "l_returnflag")


def p30_a26_detections(spark, d):
    """Sure boxes that aren't tiny, summed up by image."""
    kept = _detections(spark, d).filter("confidence >= 0.25 and w >= 5 and h >= 3")
    aspect = F.greatest("w", "h") / F.least("w", "h")
    return kept.groupBy("image").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("on_water"), F.round(F.percentile(aspect, F.lit(0.5)), 6).alias("aspect"), F.count_if(aspect >= 2).alias("slim"))


def j8_ranked_documents(spark, d):
    """Ranked ids, each with its document, in order of rank; ids without one stay."""
    ranked = load(spark, d, "embeddings").filter("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("rank"), F.col("vec_id").alias("doc_id"))
    found = ranked.join(load(spark, d, "documents").select("doc_id", F.length("text").alias("chars")), "doc_id", "left")
    return found.select("rank", "doc_id", "chars").orderBy("rank")


def f10_f13_numbers(spark, d):
    """Eighths rounded half to even; missing and outlying values put right."""
    eighths = F.col("l_quantity") / 8.0
    odd = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount") * 20)
    return load(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(F.bround(eighths, 2)), 2).alias("rounded"), F.round(F.sum(F.least(F.greatest(F.nanvl(odd, F.lit(0.0)), F.lit(0.3)), F.lit(1.0))), 4).alias("clipped"))


def f17_fingerprints(spark, d):
    return load(spark, d, "documents").select("doc_id", F.substring(F.md5(F.col("text").cast("binary")), 1, 16).alias("etag"))


def f21_type_map(spark, d):
    """Counts by type as one map per row of longitude, and one of its entries."""
    n = points(spark, d).groupBy(F.floor("lon").alias("column"), "type").agg(F.count("*").alias("n"))
    out = n.groupBy("column").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("counts"))
    return out.select("column", F.size("counts").alias("types"), F.array_join(F.map_keys("counts"), ",").alias("names"), F.coalesce(F.try_element_at("counts", F.lit("BUILDING")), F.lit(0)).alias("buildings"))


def _pixels(date: str) -> str:
    cols = ", ".join(f"{sql_value(date, i)} AS {c}" for i, c in enumerate(raster.BAND_COLUMNS))
    return f"{SPOT}, px AS MATERIALIZED (SELECT y AS row, x AS col, {cols} FROM spot)"


_SHAPE = "shoelace AS (SELECT id, count(*) AS sides, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM (SELECT e.id, x1 - x0 AS x1, y1 - y0 AS y1, x2 - x0 AS x2, y2 - y0 AS y2 FROM edge e JOIN base USING (id)) GROUP BY id)"
_WEIGHTS = "weight AS (SELECT o, exp(-0.5 * pow(o / 2.0::DOUBLE, 2)) / (SELECT sum(exp(-0.5 * pow(p / 2.0::DOUBLE, 2))) FROM range(-8, 9) s(p)) AS w FROM range(-8, 9) t(o))"


_ARROW = ", ".join(f"({i}, {0.5 + u}::DOUBLE, {0.4 + v}::DOUBLE)" for i, (u, v) in enumerate(OUTLINES[2]))
# Lengths of the spans at half height of slabs between all corners and crossings.
_SLABS = f"""tip(i, u, v) AS (VALUES {_ARROW}),
both_ AS (SELECT id, 'a' AS side, x1, y1, x2, y2 FROM edge UNION ALL SELECT * FROM (SELECT id, 'b' AS side, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM (SELECT id, i, x0 + u * 0.12::DOUBLE AS x, y0 + v * 0.08::DOUBLE AS y FROM base, tip) WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE x2 IS NOT NULL),
level AS (SELECT DISTINCT id, y FROM (SELECT id, y1 AS y FROM both_ UNION ALL SELECT p.id, p.y1 + ((q.x1 - p.x1) * (q.y2 - q.y1) - (q.y1 - p.y1) * (q.x2 - q.x1)) / d * (p.y2 - p.y1)
  FROM (SELECT p, q, (p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1) AS d FROM both_ p JOIN both_ q ON p.id = q.id AND p.side < q.side) WHERE d <> 0)),
slab AS (SELECT id, y AS lo, lead(y) OVER (PARTITION BY id ORDER BY y) AS hi FROM level),
hit AS (SELECT s.id, side, lo, hi, x1 + (x2 - x1) * ((lo + hi) / 2 - y1) / (y2 - y1) AS x FROM slab s JOIN both_ b ON s.id = b.id AND (y1 > (lo + hi) / 2) <> (y2 > (lo + hi) / 2)),
span AS (SELECT * FROM (SELECT id, side, lo, hi, x AS l, lead(x) OVER w AS r, row_number() OVER w AS k FROM hit WINDOW w AS (PARTITION BY id, side, lo ORDER BY x)) WHERE k % 2 = 1),
own AS (SELECT id, sum((r - l) * (hi - lo)) FILTER (side = 'a') AS a, sum((r - l) * (hi - lo)) FILTER (side = 'b') AS b FROM span GROUP BY id),
shared AS (SELECT p.id, sum(greatest(0, least(p.r, q.r) - greatest(p.l, q.l)) * (p.hi - p.lo)) AS m FROM span p JOIN span q ON p.id = q.id AND p.lo = q.lo AND p.side = 'a' AND q.side = 'b' GROUP BY p.id),
sums AS (SELECT id, coalesce(m, 0) AS m, a, b FROM own LEFT JOIN shared USING (id))"""


def _mirror(at: str, size: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -1 - {at} WHEN {at} >= {size} THEN 2 * {size} - 1 - {at} ELSE {at} END"


_RATIO = """covered AS (SELECT d.id AS query_id, s.id, (least(d.maxx, s.e) - greatest(d.minx, s.w)) * (least(d.maxy, s.n) - greatest(d.miny, s.s)) / ((d.maxx - d.minx) * (d.maxy - d.miny)) AS ratio
  FROM district d JOIN scene s ON s.w < d.maxx AND d.minx < s.e AND s.s < d.maxy AND d.miny < s.n)"""

QUERIES = {
    "s18_spatial_load": (s18_spatial_load, with_(DISTRICTS, POI, select="""SELECT place, type, count(*) AS n, sum(id)::BIGINT AS ids FROM (
SELECT 'admin_boundary' AS place, level AS type, id FROM district UNION ALL SELECT 'poi', type, id FROM poi UNION ALL SELECT 'schools', type, id FROM poi WHERE type IN ('BUILDING', 'HOUSEHOLD')
UNION ALL SELECT 'schools', 'added', s_suppkey FROM supplier UNION ALL SELECT 'schools', 'single', -1) GROUP BY 1, 2""")),
    "m12_named_boundaries": (m12_named_boundaries, with_(DISTRICTS, select="""SELECT s_suppkey, d.id, d.name, d.level, (SELECT count(*) FROM vertex v WHERE v.id = d.id)::INT AS corners
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN district d ON contains('How many schools are in ' || lower(n_name[1]) || ' or ' || n_name || 's and NATION_3?', d.name)""")),
    "m11_s39_overlay": (m11_s39_overlay, _sql("c", "d", more=f""",
mask AS (SELECT 'gain' AS kind, y, x FROM rule WHERE {_USABLE} AND builtup_b AND NOT builtup_a UNION ALL SELECT 'loss', y, x FROM rule WHERE {_USABLE} AND builtup_a AND NOT builtup_b){PATCHES},
kept AS (SELECT kind, count(*) AS px FROM cc GROUP BY kind, label HAVING count(*) >= 5)""",
        select="SELECT kind, count(*) AS n, sum(px)::DOUBLE * 100 AS area_m2, sum(px)::DOUBLE AS drawn_px FROM kept GROUP BY kind")),
    "m6_label_features": (m6_label_features, None),
    "m7_map_layers": (m7_map_layers, with_(_pixels("c"), select="""SELECT 'poi' AS theme, 0 AS place, 't2m-poi-poly-fill' AS layer, 'fill' AS kind, count(*) AS n FROM nation
UNION ALL SELECT 'poi', 1, 't2m-poi-points', 'circle', count(*) FROM customer
UNION ALL SELECT 'ndvi', 0, 't2m-ndvi-fill', 'fill', count(DISTINCT (row // 16, col // 16)) FROM px""")),
    "s6_s7_generated": (s6_s7_generated, "SELECT i % 7 AS kind, count(*) AS n, round(avg(113.7::DOUBLE + (i * 7919 % 6000)::DOUBLE / 10000.0::DOUBLE), 6) AS lon FROM (SELECT o_orderkey * 7 + unnest(range(0, o_orderkey % 7 + 1)) AS i FROM orders) GROUP BY 1"),
    "s19_scaled": (s19_scaled, with_(_pixels("c"), select="SELECT round(sum(round(b2 * 10000) * 0.0001::DOUBLE), 4) AS b2, round(sum(round(b8 * 10000) * 0.0001::DOUBLE), 4) AS b8 FROM px")),
    # centres at 113.9005 + 0.001 col and 22.6195 - 0.001 row: columns 40 to 120, rows 18 to 97
    "s21_box_read": (s21_box_read, with_(_pixels("c"), select="SELECT ((row - 18) * 6) // 80 AS y, ((col - 40) * 8) // 81 AS x, round(avg(b2), 6) AS b2, round(avg(b3), 6) AS b3, round(avg(b4), 6) AS b4 FROM px WHERE col BETWEEN 40 AND 120 AND row BETWEEN 18 AND 97 GROUP BY 1, 2")),
    "s22_tile_read": (s22_tile_read, with_(_pixels("c"), select="""SELECT (wy % 256)::INT AS y, (wx % 256)::INT AS x, round(avg(b4), 6) AS b4 FROM (SELECT b4, floor((lon + 180) / 360 * 1048576)::BIGINT AS wx, floor((0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * 1048576)::BIGINT AS wy
  FROM (SELECT b4, 113.9::DOUBLE + (col + 0.5::DOUBLE) * 0.001::DOUBLE AS lon, 22.62::DOUBLE - (row + 0.5::DOUBLE) * 0.001::DOUBLE AS lat FROM px))
  WHERE wx // 256 = floor((113.98::DOUBLE + 180) / 360 * 4096) AND wy // 256 = floor((0.5 - ln(tan(pi() / 4 + radians(22.55::DOUBLE) / 2)) / (2 * pi())) * 4096) GROUP BY 1, 2""")),
    "s23_raster_info": (s23_raster_info, with_(_pixels("c"), select="SELECT 'c' AS scene_id, h AS height, wd AS width, 6 AS n_bands, 113.9::DOUBLE AS w, round(22.62::DOUBLE - h * 0.001::DOUBLE, 6) AS s, round(113.9::DOUBLE + wd * 0.001::DOUBLE, 6) AS e, 22.62::DOUBLE AS n FROM (SELECT max(row) + 1 AS h, max(col) + 1 AS wd FROM px)")),
    "r11_water_agreement": (r11_water_agreement, _sql("d", select="SELECT count(*) FILTER (water_a) AS theme, count(*) FILTER (ndwi_a > 0) AS by_index, round(avg((water_a = (ndwi_a > 0))::INT), 6) AS agreement FROM rule")),
    "r17_smoothed": (r17_smoothed, with_(_pixels("c"), _WEIGHTS,
        "tall AS (SELECT unnest(range(h)) AS r, h FROM (SELECT max(row) + 1 AS h FROM px))",
        f"cell AS (SELECT r AS row, c AS col, w, {_mirror('(r + o)', 'h')} AS src FROM tall, range({WIDTH}) b(c), weight)",
        "half AS (SELECT cell.row, cell.col, sum(b8 * w) AS v FROM cell JOIN px ON px.row = src AND px.col = cell.col GROUP BY ALL)",
        f"cell2 AS (SELECT r AS row, c AS col, w, {_mirror('(c + o)', str(WIDTH))} AS src FROM tall, range({WIDTH}) b(c), weight)",
        select="SELECT cell2.row, cell2.col, round(sum(v * w), 6) AS b8 FROM cell2 JOIN half ON half.row = cell2.row AND half.col = src GROUP BY ALL")),
    "r22_objects": (r22_objects, with_(_pixels("d"), "cut AS (SELECT *, CASE WHEN (row // 24 + col // 32) % 2 = 0 THEN row // 24 * 100 + col // 32 END AS mask FROM px)",
        select="SELECT label, object, count(*) AS n FROM (SELECT mask IS NOT NULL AS object, CASE WHEN mask IS NOT NULL THEN CASE WHEN avg(b8) OVER (PARTITION BY mask) > 0.2 THEN 'green' ELSE 'other' END WHEN b8 < 0.1 THEN 'water' ELSE 'land' END AS label FROM cut) GROUP BY ALL")),
    "t12_masks": (t12_masks, with_(_pixels("a"), "mask AS (" + " UNION ALL ".join(f"SELECT row, col, row::BIGINT // {PERIOD} * 4 + {i} AS mask FROM px WHERE {m}" for i, m in enumerate(_MASKS)) + ")",
        "size AS (SELECT mask, count(*) AS px FROM mask GROUP BY mask HAVING count(*) >= 150)",
        select="SELECT mask, count(*) AS n FROM (SELECT row, col, arg_min(mask, (px, -mask)) AS mask FROM mask JOIN size USING (mask) GROUP BY row, col) GROUP BY mask")),
    "j12_class_names": (j12_class_names, _sql("c", select="SELECT label_a AS label, CASE label_a WHEN 0 THEN 'water' WHEN 1 THEN 'other' WHEN 2 THEN 'vegetation' ELSE 'unknown' END AS name, count(*) AS n FROM rule GROUP BY 1, 2")),
    "g7_wkt": (g7_wkt, with_(DISTRICTS, _SHAPE, select="SELECT id, (sides + 1)::INT AS n_points, round(area * 1e6, 3) AS area, true AS same_text, true AS same_json FROM shoelace")),
    "g14_simplified": (g14_simplified, with_(DISTRICTS, _SHAPE, select="SELECT id, (2 * sides + 1)::INT AS before, (sides + 1)::INT AS after, round(area * 1e6, 3) AS area FROM shoelace")),
    "g14_coverage": (g14_coverage, with_(DISTRICTS, _SHAPE, select="SELECT id, round(area * 1e6, 3) AS area FROM shoelace")),
    "j10_holes": (j10_holes, with_(DISTRICTS, _SHAPE, select="SELECT id AS shell, 1 AS holes, round((area - 0.012::DOUBLE * 0.008::DOUBLE) * 1e6, 3) AS area FROM shoelace")),
    "g5_overlay": (g5_overlay, with_(DISTRICTS, _SLABS, select='SELECT id, round(m * 1e6, 3) AS "intersection", round((a + b - m) * 1e6, 3) AS "union", round((a - m) * 1e6, 3) AS "difference" FROM sums')),
    "g5_parts": (g5_parts, None),
    "g16_repaired": (g16_repaired, with_(SCENES, select="SELECT id, round((e - w) * (n - s) / 2, 6) AS area FROM scene")),
    "g16_assembled": (g16_assembled, with_(DISTRICTS, _SHAPE, select="SELECT id, (sides + 1)::INT AS corners, round(area * 1e6, 3) AS area FROM shoelace")),
    "g17_ring_choice": (g17_ring_choice, with_(DISTRICTS, _SHAPE,
        f"""hit AS (SELECT id, sum(CASE WHEN (y1 > {LABEL[1]}::DOUBLE) <> (y2 > {LABEL[1]}::DOUBLE) AND {LABEL[0]}::DOUBLE < (x2 - x1) * ({LABEL[1]}::DOUBLE - y1) / (CASE WHEN y1 = y2 THEN 1 ELSE y2 - y1 END) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM edge GROUP BY id)""",
        select="SELECT level, id, inside AS contains FROM (SELECT level, id, inside, row_number() OVER (PARTITION BY level ORDER BY inside DESC, round(area, 12) DESC, id) AS k FROM base JOIN shoelace USING (id) JOIN hit USING (id)) WHERE k = 1")),
    "g21_bounds": (g21_bounds, with_(SCENES, select="SELECT id, round(w, 6) AS w, round(s, 6) AS s, round(e, 6) AS e, round(n, 6) AS n FROM scene")),
    "g25_t7_coverage": (g25_t7_coverage, with_(DISTRICTS, SCENES, _RATIO, select="SELECT query_id, count(*) AS n, round(max(ratio), 6) AS best FROM covered WHERE ratio >= 0.1 GROUP BY query_id")),
    "w9_best_scenes": (w9_best_scenes, with_(DISTRICTS, SCENES, _RATIO, select="""SELECT query_id, id, ratio, place::INT AS place FROM (SELECT query_id, id, round(ratio, 6) AS ratio, row_number() OVER (PARTITION BY query_id ORDER BY round(ratio, 6) DESC, id) AS place FROM covered WHERE round(ratio, 6) >= 0.1) WHERE place <= 5""")),
    "p16_dated_scenes": (p16_dated_scenes, "SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY 1"),
    "a18_extents": (a18_extents, with_(SCENES, select="""SELECT region, min(date) AS first, max(date) AS last, round(min(cloud), 6) AS cloud_min, round(max(cloud), 6) AS cloud_max, count(DISTINCT (w, s, e, n)) AS n_boxes,
  CASE WHEN max(n_bands) = 6 THEN 'B11,B12,B2,B3,B4,B8' ELSE 'B2,B3,B4,B8' END AS bands FROM scene GROUP BY region""")),
    "a18_boxes": (a18_boxes, with_(SCENES, select="SELECT region, round(w, 6) AS w, round(s, 6) AS s, round(e, 6) AS e, round(n, 6) AS n FROM (SELECT DISTINCT region, w, s, e, n FROM scene)")),
    "c5_region_titles": (c5_region_titles, "SELECT DISTINCT 'region' || (o_custkey % 3) AS region, CASE WHEN o_custkey % 3 = 0 THEN 'Bay' ELSE 'Region' || (o_custkey % 3) END AS title, CASE WHEN o_custkey % 3 = 0 THEN 'Scenes of the bay' ELSE 'Scenes of region' || (o_custkey % 3) END AS description FROM orders"),
    "t10_listing": (t10_listing, with_(POI, select="SELECT id, name, type FROM poi ORDER BY type, name")),
    "a28_event_values": (a28_event_values, "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, round(median(value), 6) AS middle FROM events GROUP BY event_type"),
    "p27_geometry_kinds": (p27_geometry_kinds, "SELECT is_point, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT true AS is_point, c_custkey AS id FROM customer UNION ALL SELECT false, n_nationkey FROM nation) GROUP BY is_point"),
    "p30_a26_detections": (p30_a26_detections, """SELECT image, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS on_water, round(median(greatest(w, h) / least(w, h)), 6) AS aspect, count(*) FILTER (greatest(w, h) / least(w, h) >= 2) AS slim
  FROM (SELECT l_orderkey % 50 AS image, l_discount * 10 AS confidence, l_quantity % 12 AS w, (l_partkey % 9)::DOUBLE AS h, l_returnflag FROM lineitem) WHERE confidence >= 0.25 AND w >= 5 AND h >= 3 GROUP BY image"""),
    "j8_ranked_documents": (j8_ranked_documents, "SELECT vec_id // 50 AS rank, vec_id AS doc_id, length(text)::INT AS chars FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0 ORDER BY rank"),
    "f10_f13_numbers": (f10_f13_numbers, "SELECT l_linestatus, round(sum(round_even(l_quantity / 8, 2)), 2) AS rounded, round(sum(CASE WHEN l_discount = 0 THEN 0.3::DOUBLE ELSE least(greatest(l_discount * 20, 0.3::DOUBLE), 1.0::DOUBLE) END), 4) AS clipped FROM lineitem GROUP BY l_linestatus"),
    "f17_fingerprints": (f17_fingerprints, "SELECT doc_id, substr(md5(text), 1, 16) AS etag FROM documents"),
    "f21_type_map": (f21_type_map, with_(POI, select="SELECT floor(lon)::BIGINT AS \"column\", count(DISTINCT type)::INT AS types, string_agg(DISTINCT type, ',' ORDER BY type) AS names, count(*) FILTER (type = 'BUILDING') AS buildings FROM poi GROUP BY 1")),
}
