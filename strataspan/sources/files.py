"""Files in and out: manifests, GeoJSON, catalogs of scenes, map elements, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import catalog
from ..schemas import OSM_ELEMENT, SCENE


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of JSON arrays; entries without a region belong to the first one."""
    rows = spark.read.schema(SCENE).json(path, multiLine=True)
    return rows.withColumn("region", F.coalesce(F.nullif("region", F.lit("")), F.lit("szbay"))).withColumn("cloud", F.coalesce("cloud", F.lit(0.0)))


def read_boundaries(spark: SparkSession, path: str, level: str) -> DataFrame:
    """name, level, ring and box of GeoJSON features; features without a name or shape are
    skipped, of several polygons the largest outer ring stands."""
    geometry = "struct<type:string,coordinates:string>"
    schema = f"features array<struct<properties:struct<name:string>,geometry:{geometry}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    pair = "array<array<double>>"
    one = F.from_json("f.geometry.coordinates", f"array<{pair}>")
    many = F.from_json("f.geometry.coordinates", f"array<array<{pair}>>")
    shells = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.get(one, F.lit(0)))).when(F.col("f.geometry.type") == "MultiPolygon", F.transform(many, lambda p: F.get(p, F.lit(0))))
    rings = F.transform(shells, lambda s: F.transform(s, lambda p: geo.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    sized = F.transform(F.filter(rings, lambda r: F.size(r) >= 4), lambda r: F.struct(geo.area(r).alias("a"), r.alias("r")))
    out = rows.filter("f.properties.name is not null").select(F.col("f.properties.name").alias("name"), F.lit(level).alias("level"), F.array_max(sized)["r"].alias("ring"))
    return with_box(out.filter("ring is not null"))


def with_box(rows: DataFrame) -> DataFrame:
    xs, ys = F.transform("ring", lambda p: p.x), F.transform("ring", lambda p: p.y)
    return rows.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def feature(geometry: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties")))


def point_geometry(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def polygon_geometry(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p.x, p.y))).alias("coordinates"))


def write_features(features: DataFrame, path: str) -> None:
    """A text folder with one feature per line (column ``feature``), which readers of
    GeoJSON sequences take; every task writes its own part."""
    features.select("feature").write.text(path)


def collection(features: DataFrame, limit: int = 1000) -> str:
    """A feature collection of at most ``limit`` features as one string; more raise."""
    rows = features.select("feature").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} features: write them with write_features")
    return '{"type":"FeatureCollection","features":[' + ",".join(r.feature for r in rows) + "]}"


def write_catalog(manifest: DataFrame, path: str) -> int:
    """Items as JSON by collection; raises unless as many are read back as the manifest has."""
    items = catalog.items(manifest)
    items.write.partitionBy("collection").json(path)
    n, m = items.sparkSession.read.json(path).count(), manifest.count()
    if n != m:
        raise ValueError(f"{n} items of {m} scenes")
    return n


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of JSON files with an ``elements`` array."""
    return spark.read.schema(f"elements array<struct<{_as_struct(OSM_ELEMENT)}>>").json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")


def _as_struct(fields: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (f.split(" ", 1) for f in fields.split(", ")))


def typed_elements(elements: DataFrame) -> DataFrame:
    """id, name, kind (point, polygon, line), lon, lat, ring: nodes are points, closed ways
    polygons, open ways lines, others their centre."""
    ring = F.transform("geometry", lambda p: geo.point(p.lon, p.lat))
    n = F.size("geometry")
    closed = (n >= 4) & (F.get("geometry", F.lit(0)) == F.get("geometry", n - 1))
    kind = F.when(F.col("type") == "node", "point").when((F.col("type") == "way") & closed, "polygon").when((F.col("type") == "way") & (n >= 2), "line").when(F.col("center").isNotNull(), "point")
    tags = F.col("tags")
    sort = F.when(tags["railway"].isNotNull() | (tags["station"] == "subway"), "subway").when(tags["leisure"] == "park", "park").otherwise(tags["amenity"])
    return elements.select(
        "id", tags["name"].alias("name"), sort.alias("class"), kind.alias("kind"), F.coalesce("lon", "center.lon").alias("lon"), F.coalesce("lat", "center.lat").alias("lat"),
        F.when(kind.isin("polygon", "line"), ring).alias("ring"),
    ).filter("kind is not null and name is not null")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, title, text of Markdown, text and HTML files, each read whole."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    web = F.lower("path").rlike(r"\.html?$")
    rows = rows.filter(F.lower("path").rlike(r"\.(md|markdown|txt|html?)$")).select("path", F.when(web, text.html_text(F.col("value"))).otherwise(F.col("value")).alias("text"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.select("path", text.first_heading(F.col("text"), stem).alias("title"), "text")
