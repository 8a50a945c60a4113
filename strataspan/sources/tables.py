"""Loading tables, and reference inputs that are derived from them by arithmetic."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """All tables of a folder as temporary views."""
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    return TABLES


def safe_path(root: str, name: str, suffixes: tuple[str, ...] = (".parquet", ".json", ".geojson", ".tif")) -> str:
    """``name`` below ``root``; raises for paths that leave it and for other kinds of files."""
    if not re.fullmatch(r"[\w.\-/]+", name) or name.startswith("/"):
        raise ValueError(f"not a plain relative path: {name!r}")
    path = posixpath.normpath(posixpath.join(root, name))
    if not path.startswith(root.rstrip("/") + "/") or not path.endswith(suffixes):
        raise ValueError(f"outside of {root} or of another kind: {name!r}")
    return path


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, lon, lat of points of interest: customers spread over a window."""
    c = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        c.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"),
        (F.lit(113.7) + (c * 7919 % 6000).cast("double") / 10000.0).alias("lon"),
        (F.lit(22.4) + (c * 104729 % 4000).cast("double") / 10000.0).alias("lat"),
    )


def register_spatial(spark: SparkSession, sf_dir: str) -> list[str]:
    """Views poi, schools (the points of one type) and admin_boundary with a column geom."""
    at = F.array(F.array(geo.point(F.col("lon"), F.col("lat"))))
    poi = points(spark, sf_dir).withColumn("geom", at)
    poi.createOrReplaceTempView("poi")
    poi.filter("type = 'BUILDING'").createOrReplaceTempView("schools")
    districts(spark, sf_dir).select("id", "name", "level", F.array("ring").alias("geom")).createOrReplaceTempView("admin_boundary")
    return ["poi", "schools", "admin_boundary"]


# Unit outlines of the derived districts: box, triangle, concave.
OUTLINES = [
    [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)],
    [(0.0, 0.0), (1.0, 0.0), (0.5, 1.0), (0.0, 0.0)],
    [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.4), (0.0, 1.0), (0.0, 0.0)],
]


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries: one per nation in a grid of five by five, of three shapes."""
    n = F.col("n_nationkey").cast("long")
    x0 = F.lit(113.7) + (n % 5).cast("double") * 0.12
    y0 = F.lit(22.4) + F.floor(n / 5).cast("double") * 0.08
    ring = F.when(n % 3 == 0, _placed(OUTLINES[0], x0, y0)).when(n % 3 == 1, _placed(OUTLINES[1], x0, y0)).otherwise(_placed(OUTLINES[2], x0, y0))
    return load(spark, sf_dir, "nation").select(
        n.alias("id"), F.col("n_name").alias("name"), F.when(n % 2 == 0, "district").otherwise("city").alias("level"), ring.alias("ring"),
        x0.alias("minx"), y0.alias("miny"), (x0 + 1.0 * 0.12).alias("maxx"), (y0 + 1.0 * 0.08).alias("maxy"),
    )


def _placed(outline: list[tuple[float, float]], x0, y0):
    return F.array(*[geo.point(x0 + u * 0.12, y0 + v * 0.08) for u, v in outline])


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene catalog from orders: id, region, date, cloud, box, number of bands, ordinal."""
    k = F.col("o_orderkey")
    w = F.lit(113.0) + (k * 37 % 200).cast("double") / 100.0
    s = F.lit(22.0) + (k * 53 % 100).cast("double") / 100.0
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("S2_T"), (k % 7).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), k.cast("string")).alias("id"),
        F.concat(F.lit("region"), (F.col("o_custkey") % 3).cast("string")).alias("region"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"), ((k * 37 % 1000).cast("double") / 10.0).alias("cloud"),
        w.alias("w"), s.alias("s"), (w + 0.1 + (k * 11 % 30).cast("double") / 100.0).alias("e"), (s + 0.1 + (k * 17 % 20).cast("double") / 100.0).alias("n"),
        F.when(k % 2 == 0, 6).otherwise(4).alias("n_bands"), k.alias("ordinal"),
    )
