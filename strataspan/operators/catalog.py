"""Scene catalog: items, collections, search, inventory of a region."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .spatial_join import covering_boxes

# Share of a query from which a scene covers it, formats of dates, names of regions.
FULL_COVER = 0.95
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyyMMdd", "yyyy-MM")
REGION_NAMES = {"szbay": "深圳湾", "zhengzhou_hightech": "郑州高新区"}
PLACES = {"深圳湾": (113.80, 22.40, 114.00, 22.65)}


def parse_date(text: Column) -> Column:
    """Timestamp of an ISO day, month or instant; of a range ``A~B`` its start; else null."""
    start = F.trim(F.split(text, "~")[0])
    return F.coalesce(*[F.try_to_timestamp(start, F.lit(f)) for f in DATE_FORMATS])


def time_bounds(text: str | None) -> tuple[datetime | None, datetime | None]:
    """Bounds of ``start/end``; ``..`` and empty sides are open, a single instant is a start."""
    if not text:
        return None, None
    first, _, last = text.partition("/")
    read = lambda s: None if s in ("", "..") else datetime.strptime(s, "%Y-%m-%dT%H:%M:%SZ")
    return read(first), read(last)


def parse_box(text: str) -> tuple[float, float, float, float]:
    """Four comma-separated numbers; anything else raises."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError(f"a box has four numbers: {text!r}")
    w, s, e, n = map(float, parts)
    return w, s, e, n


def search(items: DataFrame, when: str | None = None, box: tuple | None = None, limit: int = 100, collection: str | None = None) -> DataFrame:
    """The first items in catalog order that meet all conditions; touching boxes meet."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    start, end = time_bounds(when)
    out = items
    if collection is not None:
        out = out.filter(F.col("region") == collection)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("timestamp_ntz"))
    if box is not None:
        out = out.filter(geo.boxes_touch(*(F.col(c) for c in "wsen"), *(F.lit(float(v)) for v in box)))
    return out.orderBy("ordinal").limit(limit)


def items(manifest: DataFrame) -> DataFrame:
    """Catalog items of a manifest (see schemas.SCENE): geometry, properties, assets."""
    w, s, e, n = (F.get("bbox", F.lit(i)) for i in range(4))
    return manifest.select(
        "id", F.coalesce(F.nullif("region", F.lit("")), F.lit("szbay")).alias("collection"), parse_date(F.col("date")).alias("datetime"), "bbox",
        F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(geo.box_ring(w, s, e, n), lambda p: F.array(p.x, p.y))).alias("coordinates")).alias("geometry"),
        F.struct(F.coalesce("cloud", F.lit(0.0)).alias("cloud_cover"), F.col("turbidity"), F.col("bands")).alias("properties"),
        F.create_map(F.lit("data"), F.col("path"), F.lit("thumbnail"), F.col("preview")).alias("assets"),
    )


def collections(scenes: DataFrame) -> DataFrame:
    """Per region its scenes, boxes, dates, cloud range and union of bands."""
    return scenes.groupBy("region").agg(
        F.count("*").alias("n_items"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"),
        F.min("date").alias("first"), F.max("date").alias("last"), F.min("cloud").alias("cloud_min"), F.max("cloud").alias("cloud_max"), F.max("n_bands").alias("n_bands"),
    )


def replace_scenes(manifest: DataFrame, new: DataFrame, order: str = "ordinal") -> DataFrame:
    """The manifest with new scenes in place of those of one id; of several new ones the first stays."""
    first = new.groupBy("id").agg(F.min_by(F.struct(*new.columns), order).alias("x")).select("x.*")
    return manifest.join(first.select("id"), "id", "left_anti").unionByName(first)


def coverage(queries: DataFrame, scenes: DataFrame) -> DataFrame:
    """query_id, best, tier (full, partial, none) and number of scenes for query boxes."""
    hits = covering_boxes(queries, scenes)
    best = hits.groupBy("query_id").agg(F.max("ratio").alias("best"), F.count("*").alias("n_scenes"))
    out = queries.select("query_id").join(best, "query_id", "left")
    tier = F.when(F.col("best") >= FULL_COVER, "full").when(F.col("best") > 0, "partial").otherwise("none")
    return out.select("query_id", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("n_scenes", F.lit(0)).alias("n_scenes"), tier.alias("tier"))


def resolve_place(text: str, boundaries: DataFrame) -> dict:
    """A place's box by the longest boundary name in the text; several of that length are
    candidates and don't resolve. Then the list of known places."""
    text = (text or "").strip()
    named = boundaries.filter((F.length("name") > 0) & F.lit(text).contains(F.col("name")))
    longest = named.agg(F.max(F.length("name")).alias("m"))
    top = named.join(F.broadcast(longest)).filter(F.length("name") == F.col("m"))  # one row
    rows = top.select("name", "level", "minx", "miny", "maxx", "maxy").orderBy("level", "minx", "miny").limit(100).collect()
    if len(rows) == 1:
        r = rows[0]
        return {"resolved": True, "name": r.name, "level": r.level, "bbox": (r.minx, r.miny, r.maxx, r.maxy), "candidates": [], "source": "boundary"}
    if rows:
        return {"resolved": False, "name": "", "level": "", "bbox": None, "candidates": [tuple(r) for r in rows], "source": ""}
    for name, box in PLACES.items():
        if name in text:
            return {"resolved": True, "name": name, "level": "custom", "bbox": box, "candidates": [], "source": "places"}
    return {"resolved": False, "name": "", "level": "", "bbox": None, "candidates": [], "source": ""}


def nearest_region(box: tuple, scenes: DataFrame) -> DataFrame:
    """region, n, distance (degrees between centres) of the region nearest to a box."""
    x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    mid = scenes.groupBy("region").agg(F.avg((F.col("w") + F.col("e")) / 2).alias("x"), F.avg((F.col("s") + F.col("n")) / 2).alias("y"), F.count("*").alias("n"))
    return mid.select("region", "n", F.hypot(F.col("x") - x, F.col("y") - y).alias("distance")).orderBy("distance", "region").limit(1)


def inventory(scenes: DataFrame, box: tuple, own_region: str = "") -> dict:
    """Scenes that cover a box, its tier and what to do with it."""
    query = scenes.sparkSession.createDataFrame([(1, *map(float, box))], "query_id int, qw double, qs double, qe double, qn double")
    hits = covering_boxes(query, scenes).orderBy(F.desc("ratio"), "date", "id").limit(1000).collect()
    best = max((r.ratio for r in hits), default=0.0)
    tier = "full" if best >= FULL_COVER else "partial" if hits else "none"
    if tier == "full" or (own_region and hits):
        advice = "use: " + "; ".join(f"{r.id} ({r.date:%Y-%m-%d}, cloud {r.cloud}%)" for r in hits)
    else:
        near = nearest_region(box, scenes).first()
        where = f"nearest region: {near.region} ({near.n} scenes)" if near else "there are no scenes"
        advice = (f"covered by {best:.0%} only; " if hits else "not covered; ") + where
    return {"coverage": tier, "scenes": [(r.id, round(r.ratio, 4)) for r in hits], "recommendation": advice}


def date_pair(scenes: DataFrame) -> DataFrame:
    """Per region the first and the last scene by date, and the years between that have none."""
    years = F.sequence(F.min(F.year("date")), F.max(F.year("date")))
    return scenes.groupBy("region").agg(
        F.min_by("id", F.struct("date", "id")).alias("first"), F.max_by("id", F.struct("date", "id")).alias("last"),
        F.array_join(F.array_except(years, F.collect_set(F.year("date"))), ",").alias("missing_years"),
    )
