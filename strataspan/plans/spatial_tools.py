"""The tools of a spatial assistant over given tables: each is a Spark query behind a name."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, raster
from ..operators import catalog, change, layers, overlay, polygons
from ..operators import spatial_join as sj
from ..sources.files import feature, polygon_geometry, write_features
from . import intents, report, safe_sql
from .map_style import assemble
from .tools import Tool, Tools

RING = "struct<type:string,coordinates:array<array<array<double>>>>"
COLLECTION = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<type:string>>>>"


@dataclass(frozen=True)
class Sources:
    """What the tools read: points (id, name, type, lon, lat), boundaries (id, name, level,
    ring, box), scenes of a catalog, pixels by scene name, tables that SQL may read, a folder
    that all executors share for maps and reports."""

    spark: SparkSession
    points: DataFrame
    boundaries: DataFrame
    scenes: DataFrame
    pixels: Callable[[str], DataFrame]
    tables: list[str]
    folder: str
    pixel_km2: float = 1e-4


def _one(spark: SparkSession, **values: float) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def _projected(lon: F.Column, lat: F.Column, epsg: int) -> tuple:
    """East and north in a known system: degrees, Mercator, UTM north or south, Gauss-Krueger by meridian."""
    if epsg in (4326, 4490):
        return lon, lat
    if epsg == 3857:
        return geo.mercator_x(lon), geo.mercator_y(lat)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        north = 0.0 if epsg < 32700 else 10_000_000.0
        at = geo.transverse_mercator(lon, lat, F.lit(epsg % 100 * 6.0 - 183.0), north=north)
    elif 4534 <= epsg <= 4554:
        at = geo.transverse_mercator(lon, lat, F.lit(75.0 + 3.0 * (epsg - 4534)), 1.0)
    else:
        raise ValueError(f"unknown system: {epsg}")
    return at["x"], at["y"]


def _named(title: str) -> str:
    """A title as a plain name of a folder, with the time."""
    return re.sub(r"\W+", "_", title)[:60] + datetime.now(timezone.utc).strftime("_%Y%m%d_%H%M%S_%f")


def build(s: Sources, most: int = 100) -> Tools:
    """All tools in one registry; answers are JSON with ``most`` rows at most, errors are data."""
    spark, tools = s.spark, Tools(most)

    def distance(lon1, lat1, lon2, lat2):
        return _one(spark, a=lon1, b=lat1, c=lon2, d=lat2).select(F.round(geo.geodesic_m(*map(F.col, "abcd")), 2).alias("distance_m"))

    def buffer(lon, lat, radius_m):
        if radius_m <= 0:
            raise ValueError("a radius is above 0")
        ring = geo.metric_buffer(F.lit(lon), F.lit(lat), F.lit(radius_m))
        return spark.range(1).select(F.round(geo.buffer_area_km2(F.lit(radius_m)), 6).alias("area_km2"), F.to_json(polygon_geometry(ring)).alias("geojson"))

    def transform(lon, lat, to_epsg, from_epsg=4326):
        if from_epsg not in (4326, 4490):
            raise ValueError(f"from degrees only, not from {from_epsg}")
        x, y = _projected(F.lit(lon), F.lit(lat), to_epsg)
        return spark.range(1).select(F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))

    def retrieval(dataset_name="poi"):
        if dataset_name not in ("poi", "boundaries", "scenes"):
            raise ValueError(f"unknown dataset: {dataset_name}")
        frame, kind = {"poi": (s.points, "type"), "boundaries": (s.boundaries, "level"), "scenes": (s.scenes, "region")}[dataset_name]
        return frame.groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("n")).orderBy("type")

    def query(lon, lat, radius_m, poi_type=""):
        return sj.nearby(s.points, lon, lat, radius_m, poi_type).select("id", "name", "type", F.round("distance_m", 2).alias("distance_m"))

    def overlaid(geojson_a, geojson_b):
        text = spark.range(1).select(F.lit(1).alias("id"), *[F.from_json(F.lit(g), RING).alias(c) for c, g in (("a", geojson_a), ("b", geojson_b))])
        rings = lambda c: F.transform(F.col(f"{c}.coordinates"), lambda r: F.transform(r, lambda p: geo.point(p[0], p[1])))
        pair = text.select("id", rings("a").alias("a"), rings("b").alias("b"))
        if pair.filter("size(a) > 0 and size(b) > 0").isEmpty():
            raise ValueError("two polygons are wanted")
        out = overlay.overlay(pair, ["id"], "a", "b", "intersection")
        return out.select(F.to_json(polygon_geometry(F.col("ring"))).alias("geojson"), F.size("holes").alias("holes"), F.round(polygons.area_with_holes(F.col("ring"), F.col("holes")), 12).alias("area"))

    def features(geojson):
        return spark.range(1).select(F.explode(F.from_json(F.lit(geojson), COLLECTION)["features"]).alias("f")).select("f.*")

    def statistics(geojson):
        f = features(geojson)
        pairs = F.regexp_extract_all("geometry.coordinates", F.lit(r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)"), F.lit(1)), F.regexp_extract_all("geometry.coordinates", F.lit(r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)"), F.lit(2))
        lon, lat = (F.transform(p, lambda v: v.cast("double")) for p in pairs)
        return f.groupBy(F.col("geometry.type").alias("type")).agg(
            F.count("*").alias("n"), F.min(F.array_min(lon)).alias("west"), F.min(F.array_min(lat)).alias("south"), F.max(F.array_max(lon)).alias("east"), F.max(F.array_max(lat)).alias("north")
        ).orderBy("type")

    def generated(geojson, title="analysis_result"):
        f = spark.range(1).select(F.explode(F.from_json(F.lit(geojson), "struct<features:array<string>>")["features"]).alias("feature"))
        path = f"{s.folder}/maps/{_named(title)}"
        write_features(f, path)
        return {"path": path, "features": spark.read.text(path).count()}

    def sql(statement):
        return safe_sql.run(spark, statement, s.tables)

    def changed(scene_a, scene_b, theme="builtup"):
        if theme not in raster.THEMES:
            raise ValueError(f"unknown theme: {theme}")
        return change.theme_change(change.pixel_join(s.pixels(scene_a), s.pixels(scene_b)), theme, s.pixel_km2)

    def map_of(theme, region, types=""):
        wanted = [t for t in types.split(",") if t]
        named = s.boundaries.filter(F.col("name") == region).agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
        if named[0] is None:
            raise ValueError(f"no boundary named {region}")
        w, south, e, n = named
        if theme != "poi":
            raise ValueError("points are what these tables can draw")
        inside = s.points.filter(F.col("lon").between(w, e) & F.col("lat").between(south, n))
        rows = layers.point_features((inside.filter(F.col("type").isin(wanted)) if wanted else inside).withColumnRenamed("type", "class"))
        path = f"{s.folder}/maps/{_named(region)}"
        write_features(rows, path)
        return assemble(intents.MapIntent(theme, region, [], []), (w, south, e, n), {"points": path})

    def reported(title, scene_a, scene_b, theme="builtup"):
        found = changed(scene_a, scene_b, theme)
        markdown, page = report.change_report(title, found)
        path = f"{s.folder}/reports/{_named(title)}"
        spark.createDataFrame([("md", markdown), ("html", page)], "kind string, text string").coalesce(1).write.json(path)
        return {"title": title, "report_path": path, "markdown": markdown}

    def inventory(region="", bbox=""):
        place = catalog.resolve_place(region, s.boundaries) if not bbox else {"bbox": catalog.parse_box(bbox), "candidates": []}
        if not place["bbox"]:
            return {"coverage": "none", "candidates": place["candidates"], "recommendation": "no place of that name; give a bbox"}
        return catalog.inventory(s.scenes, place["bbox"])

    def boundary(name):
        return s.boundaries.filter(F.col("name") == name).select(feature(polygon_geometry(F.col("ring")), name=F.col("name"), level=F.col("level")).alias("feature"))

    at, text = {"lon": float, "lat": float}, str
    for name, about, run, arguments, optional in (
        ("calc_distance", "Metres along the ellipsoid between two places in degrees.", distance, {"lon1": float, "lat1": float, "lon2": float, "lat2": float}, ()),
        ("create_buffer", "Area of a circle around a place.", lambda **a: buffer(**a).select("area_km2"), at | {"radius_m": float}, ()),
        ("transform_coord", "Degrees to a projected system by EPSG number.", transform, at | {"to_epsg": int, "from_epsg": int}, ("from_epsg",)),
        ("data_retrieval", "Which kinds of rows a dataset has: poi, boundaries or scenes.", retrieval, {"dataset_name": text}, ("dataset_name",)),
        ("spatial_query", "Points near a place, nearest first, of one type if given.", query, at | {"radius_m": float, "poi_type": text}, ("poi_type",)),
        ("buffer_analysis", "A circle around a place as GeoJSON, with its area.", buffer, at | {"radius_m": float}, ()),
        ("overlay_analysis", "What two GeoJSON polygons have in common.", overlaid, {"geojson_a": text, "geojson_b": text}, ()),
        ("coordinate_transform", "Degrees to a projected system by EPSG number.", transform, at | {"to_epsg": int, "from_epsg": int}, ("from_epsg",)),
        ("statistics_calc", "Features of a GeoJSON collection by type, with their extent.", statistics, {"geojson": text}, ()),
        ("map_generation", "Write a GeoJSON collection as a map layer.", generated, {"geojson": text, "title": text}, ("title",)),
        ("spatial_sql", "One read-only SQL query over the known tables.", sql, {"statement": text}, ()),
        ("temporal_change", "Gain and loss of a theme between two scenes.", changed, {"scene_a": text, "scene_b": text, "theme": text}, ("theme",)),
        ("text_to_map", "A map style of the points in a named boundary.", map_of, {"theme": text, "region": text, "types": text}, ("types",)),
        ("report", "A written report of the change between two scenes.", reported, {"title": text, "scene_a": text, "scene_b": text, "theme": text}, ("theme",)),
        ("data_inventory", "Which scenes cover a named region or a box, and what to do if none does.", inventory, {"region": text, "bbox": text}, ("region", "bbox")),
        ("boundary", "A boundary by its name as GeoJSON.", boundary, {"name": text}, ()),
    ):
        tools.add(Tool(name, about, run, arguments, optional))
    return tools


def answers(tools: Tools, calls: list[tuple[str, dict]]) -> list[dict]:
    """The answers of calls in order, as dictionaries."""
    return [json.loads(tools.call(name, arguments)) for name, arguments in calls]
