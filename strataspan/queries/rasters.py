"""Queries over pixel tables of several dates, with their SQL.

The elements of the vectors, in order of id and place, are laid out in rows of 160 pixels.
Each band is the reflectance of what lies there (a pattern that returns every 120 rows)
times one plus an element of the pixel's vector, so scenes grow with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, raster
from ..operators import change, patches
from ..operators.quantiles import quantiles
from ..sources.tables import load

PERIOD, WIDTH = 120, 160
# Reflectances of the synthetic scene.
VEGETATION = (0.05, 0.08, 0.06, 0.25, 0.18, 0.09)
URBAN = (0.12, 0.14, 0.16, 0.14, 0.24, 0.22)
WATER = (0.07, 0.05, 0.03, 0.02, 0.01, 0.005)
CLOUD, NOTHING = (0.6,) * 6, (0.0,) * 6

# In rows of a period (v) and columns (x).
_BLOCK = "v >= 30 AND v < 70 AND x >= 50 AND x < 110"
_SPECK = "v >= 10 AND v < 12 AND x >= 10 AND x < 12"
_POND = "v >= 100 AND x < 30"
PLACES = {
    "a": [(_POND, WATER)],
    "b": [(_POND, WATER), (_BLOCK, URBAN), (_SPECK, URBAN)],
    # with clouds, missing pixels and a pond that shrinks
    "c": [("v < 6 AND x < 8", NOTHING), ("v < 20 AND x >= 140", CLOUD), ("v >= 90 AND x < 40", WATER), ("(v * 7 + x * 3) % 11 = 0", URBAN)],
    "d": [("v < 3 AND x < 9", NOTHING), ("v < 9 AND x >= 120", CLOUD), ("v >= 95 AND x < 40", WATER), ("(v * 7 + x * 3) % 13 = 0", URBAN), (_BLOCK, URBAN)],
}


def _value(date: str, band: int) -> str:
    """Reflectance in terms of v, x, the pixel's vector e and its place p there (the same text in both dialects but for ``item``)."""
    steps = " ".join(f"WHEN {where} THEN CAST({v[band]} AS DOUBLE)" for where, v in PLACES[date])
    return f"(CASE {steps} ELSE CAST({VEGETATION[band]} AS DOUBLE) END) * (CAST(1 AS DOUBLE) + CAST(item(p + {7 * band + 3 * 'abcd'.index(date)}) AS DOUBLE))"


def _spark_value(date: str, band: int) -> str:
    return re.sub(r"item\((.*?)\)", r"element_at(e, cast((\1) % size(e) + 1 as int))", _value(date, band))


def sql_value(date: str, band: int) -> str:
    return re.sub(r"item\((.*?)\)", r"e[(\1) % len(e) + 1]", _value(date, band))


def scene(spark, d: str, date: str):
    """scene_id, row, col and band columns."""
    at = load(spark, d, "embeddings").selectExpr("vec_id", "embedding as e", "posexplode(embedding) as (p, _)").selectExpr("vec_id * size(e) + p as f", "e", "p")
    at = at.selectExpr(f"cast(f div {WIDTH} as int) as y", f"cast(f % {WIDTH} as int) as x", f"cast(f div {WIDTH} % {PERIOD} as int) as v", "e", "p")
    return at.selectExpr(f"'{date}' as scene_id", "y as row", "x as col", *[f"{_spark_value(date, i)} as {c}" for i, c in enumerate(raster.BAND_COLUMNS)])


def height(spark, d: str) -> int:
    """Rows of the scenes, one number."""
    return scene(spark, d, "a").agg(F.max("row")).first()[0] + 1


SPOT = f"""spot AS (SELECT CAST(f // {WIDTH} AS INTEGER) AS y, CAST(f % {WIDTH} AS INTEGER) AS x, CAST(f // {WIDTH} % {PERIOD} AS INTEGER) AS v, e, p
  FROM (SELECT vec_id * len(embedding) + p AS f, embedding AS e, p FROM embeddings, unnest(range(0, len(embedding))) AS u(p)))"""


def _sql(*dates: str, select: str, more: str = "") -> str:
    cols = ", ".join(f"{sql_value(dt, i)} AS {c}_{s}" for dt, s in zip(dates, "ab", strict=False) for i, c in enumerate(raster.BAND_COLUMNS))
    idx = []
    for s in "ab"[: len(dates)]:
        for name, (p, n) in raster.INDICES.items():
            idx.append(f"({p}_{s} - {n}_{s}) / ({p}_{s} + {n}_{s} + 1e-6::DOUBLE) AS {name}_{s}")
        all_ = [f"{c}_{s}" for c in raster.BAND_COLUMNS]
        idx += [f"least({', '.join(all_)}) > 0 AS valid_{s}", f"({' + '.join(all_)}) / 6 > 0.3::DOUBLE AS bright_{s}", f"least({', '.join(all_)}) > 0.25::DOUBLE AS cloudy_{s}", f"{' + '.join(all_)} > 0.02::DOUBLE AS lit_{s}"]
    return f"""WITH {'RECURSIVE ' if more else ''}{SPOT},
band AS MATERIALIZED (SELECT y, x, {cols} FROM spot), px AS (SELECT *, {', '.join(idx)} FROM band),
rule AS MATERIALIZED (SELECT *, {', '.join(f"ndbi_{s} > 0 AND ndvi_{s} < ndbi_{s} AS builtup_{s}, ndwi_{s} > 0.1::DOUBLE AS water_{s}, CASE WHEN cloudy_{s} THEN -1 WHEN ndwi_{s} > 0.05::DOUBLE THEN 0 WHEN ndvi_{s} > 0.3::DOUBLE THEN 2 ELSE 1 END AS label_{s}" for s in "ab"[: len(dates)])} FROM px){more}
{select}"""


# Components of mask(kind, y, x): labels fall to the least of their neighbours' until none falls any more.
PATCHES = f""",
cc(kind, y, x, label) USING KEY (kind, y, x) AS (
  SELECT kind, y, x, (y::BIGINT << 32) | x FROM mask
  UNION SELECT m.kind, m.y, m.x, min(n.label) FROM cc n JOIN recurring.cc m ON m.kind = n.kind AND abs(m.y - n.y) + abs(m.x - n.x) = 1 AND m.y BETWEEN n.y - 1 AND n.y + 1
    WHERE n.label < m.label GROUP BY m.kind, m.y, m.x)"""


_USABLE = "valid_a AND valid_b AND NOT bright_a AND NOT bright_b"


def r1_indices(spark, d):
    px = scene(spark, d, "c").withColumns({k: F.round(raster.index(k), 6) + 0.0 for k in raster.INDICES})
    return px.select("row", "col", *raster.INDICES)


def r2_scene_stats(spark, d):
    """Mean index and share above a threshold, 0 where bands sum to 0."""
    px = scene(spark, d, "c")
    v, w = raster.index_or_zero("ndvi"), raster.index_or_zero("ndwi")
    return px.agg(*[F.round(e, 6).alias(n) for n, e in (("ndvi", F.avg(v)), ("green", F.avg((v > 0.3).cast("int"))), ("ndwi", F.avg(w)), ("water", F.avg((w > 0).cast("int"))))])


def r4_themes(spark, d):
    px = scene(spark, d, "d")
    return px.agg(*[F.count_if(raster.theme(k)).alias(k) for k in raster.THEMES])


def p17_p21_masks(spark, d):
    px = scene(spark, d, "c")
    return px.agg(F.count_if(raster.valid_all()).alias("valid_all"), F.count_if(raster.valid_sum()).alias("valid_sum"), F.count_if(~raster.valid_sum(least=0.01)).alias("dark"), F.count_if(raster.cloud_mean()).alias("cloud_mean"), F.count_if(raster.cloud_min()).alias("cloud_min"))


def p28_tile_quality(spark, d):
    """Tiles of 16 by 16 pixels with at least half valid pixels."""
    px = scene(spark, d, "c").groupBy(F.floor(F.col("row") / 16).alias("tr"), F.floor(F.col("col") / 16).alias("tc"))
    return px.agg(F.round(F.avg(raster.cloud_min().cast("int")), 6).alias("cloud"), F.avg(raster.valid_all().cast("int")).alias("ok")).filter("ok >= 0.5").select("tr", "tc", "cloud")


def _pair(spark, d, a="c", b="d"):
    return change.pixel_join(scene(spark, d, a), scene(spark, d, b))


def r5_spectral_change(spark, d):
    px = change.usable(_pair(spark, d))
    moved = raster.spectral_change("_a", "_b")
    n = F.count_if("usable")
    return px.agg(n.alias("usable"), F.count_if(F.col("usable") & moved).alias("changed"), F.round(F.count_if(F.col("usable") & moved) / F.greatest(n, F.lit(1)), 4).alias("ratio"))


def r6_class_ratio(spark, d):
    """Pixels per pseudo-label and their share of all pixels."""
    px = scene(spark, d, "c").groupBy(raster.pseudo_label().alias("label")).agg(F.count("*").alias("n"))
    return px.select("label", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("ratio"))  # a row per label


def _labels(spark, d):
    return _pair(spark, d).select("row", "col", raster.pseudo_label("_a").alias("la"), raster.pseudo_label("_b").alias("lb"))


def r7_class_change(spark, d):
    px = _labels(spark, d)
    known = (F.col("la") >= 0) & (F.col("lb") >= 0)
    return px.agg(F.count_if(known).alias("known"), F.count_if(known & (F.col("la") != F.col("lb"))).alias("changed"), F.round(F.avg(F.when(known, (F.col("la") == F.col("lb")).cast("int"))), 6).alias("agreement"))


def a8_transition(spark, d):
    return change.transition(_labels(spark, d), "la", "lb", [0, 1, 2])


def a9_confusion(spark, d):
    out = change.confusion(_labels(spark, d).filter("la >= 0 and lb >= 0"), F.col("la") == 0, F.col("lb") == 0)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("iou", "precision", "recall", "f1")])


def a9_confusion_labels(spark, d):
    """Quality label against toxicity label."""
    from ..sources.tables import load

    out = change.confusion(load(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return out.select("tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


def a10_mean_iou(spark, d):
    return change.mean_iou(_labels(spark, d), "la", "lb", [0, 1, 2]).select("class", F.round("iou", 6).alias("iou"))


def a12_deep_water_flips(spark, d):
    px = change.usable(_pair(spark, d))
    deep = F.col("usable") & (raster.index("ndwi", "_a") > 0.15)
    return px.agg(F.count_if(deep).alias("deep"), F.round(F.count_if(deep & (raster.index("ndwi", "_b") <= 0.15)) / F.greatest(F.count_if(deep), F.lit(1)), 6).alias("flip"))


def r9_theme_change(spark, d):
    """Built-up land gained and lost between the dates, before and after small patches go."""
    out = change.theme_change(_pair(spark, d, "a", "b"), "builtup", 0.0001)
    return out.select("theme", "valid_px", "gain_px", "loss_px", "raw_gain_px", "raw_loss_px", F.round("patch_keep_ratio", 6).alias("keep"), F.round("net_km2", 4).alias("net_km2"))


def _built(spark, d):
    return scene(spark, d, "b").filter(raster.theme("builtup")).select(F.lit(1).alias("scene"), "row", "col")


def r12_patches(spark, d):
    """Patches of built-up pixels of the second date by size."""
    return patches.label_patches(_built(spark, d), ["scene"], 32).groupBy("scene", "patch").agg(F.count("*").alias("px"))


def g23_outlines(spark, d):
    """Outlines of kept patches: their rings, corners, length and area, which is that of the pixels."""
    out = patches.outlines(patches.keep_large(_built(spark, d), ["scene"], 5, 32), ["scene"])
    ring = lambda f: F.aggregate(F.transform("rings", f), F.lit(0.0), lambda a, v: a + v)
    length = ring(lambda r: F.aggregate(geo.edges(r), F.lit(0.0), lambda a, e: a + F.abs(e.x2 - e.x1) + F.abs(e.y2 - e.y1)))
    corners = ring(lambda r: (F.size(r) - 1).cast("double"))
    return out.select("patch", "px", F.size("rings").alias("rings"), corners.cast("long").alias("corners"), length.cast("long").alias("length"), F.abs(ring(geo.signed_area)).cast("long").alias("area"))


def r13_anomaly(spark, d):
    """Anomalous near infrared over water: more than 2.5 robust deviations."""
    px = scene(spark, d, "d").withColumn("v", F.col("b8") + (F.col("row") * F.col("col") % 17).cast("double") / 100.0)
    z = change.robust_z(px, "v", ["scene_id"], raster.theme("water"))
    hot = raster.theme("water") & (F.col("z") > 1.2)
    return z.agg(F.count_if(hot).alias("level1"), F.count_if(hot & (raster.index("ndvi") > -0.5)).alias("level2"), F.round(F.max("med"), 6).alias("med"), F.round(F.max("mad"), 6).alias("mad"))


def r14_bloom_sets(spark, d):
    """Pixels that enter, leave and stay in water between two dates, over jointly valid ones."""
    px = _pair(spark, d)
    ok = raster.valid_sum("_a") & raster.valid_sum("_b")
    a, b = raster.theme("water", "_a"), raster.theme("water", "_b")
    return px.filter(ok).agg(F.count_if(b & ~a).alias("added"), F.count_if(a & ~b).alias("gone"), F.count_if(a & b).alias("kept"), (F.count_if(b & ~a) - F.count_if(a & ~b)).alias("net"))


def r15_stretch(spark, d):
    px = scene(spark, d, "c").select("row", "col", (F.col("b8") * 10000).alias("dn"))
    return change.stretch(px, "dn").groupBy("byte").agg(F.count("*").alias("n"))


def r16_joint_percentiles(spark, d):
    v = scene(spark, d, "c").select(F.explode(F.array("b2", "b3", "b4")).alias("v"))
    q = quantiles(v, "v", [], [0.02, 0.98])
    return q.agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 6).alias(n) for n, p in (("p2", 0.02), ("p98", 0.98))])


def r18_resample(spark, d):
    px = scene(spark, d, "c").withColumn("ndvi", raster.index("ndvi"))
    return change.resample(px, 8, height(spark, d), WIDTH, ["ndvi"]).select("cell_row", "cell_col", F.round("ndvi", 6).alias("ndvi"))


def s20_window(spark, d):
    """A window of 32 by 32 pixels with a margin of 8."""
    px = scene(spark, d, "c").filter(F.col("row").between(32 - 8, 63 + 8) & F.col("col").between(64 - 8, 95 + 8))
    return px.agg(F.count("*").alias("n"), F.round(F.avg("b4"), 6).alias("b4"))


def s25_pyramid(spark, d):
    out = change.pyramid(scene(spark, d, "c"), ["scene_id"], ["b4"], 3)
    return out.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("b4"), 6).alias("mean"))


def s28_mosaic(spark, d):
    both = scene(spark, d, "c").withColumn("rank", F.lit(1)).unionByName(scene(spark, d, "d").withColumn("rank", F.lit(2)))
    return change.first_valid_mosaic(both, "rank").groupBy("scene_id").agg(F.count("*").alias("n"), F.round(F.sum("b8"), 4).alias("b8"))


def r23_halo_tiles(spark, d):
    """Pixels dealt to tiles of 64 with a margin of 8, and each tile's own pixels."""
    px = scene(spark, d, "c").select("row", "col")
    near = [F.sequence(F.floor((F.col(c) - 8) / 64), F.floor((F.col(c) + 8) / 64)) for c in ("row", "col")]
    halo = px.withColumn("tr", F.explode(near[0])).withColumn("tc", F.explode(near[1]))
    halo = halo.filter(f"tr >= 0 and tc >= 0 and tr * 64 < {height(spark, d)} and tc * 64 < {WIDTH}")
    own = (F.floor(F.col("row") / 64) == F.col("tr")) & (F.floor(F.col("col") / 64) == F.col("tc"))
    return halo.groupBy("tr", "tc").agg(F.count("*").alias("n"), F.count_if(own).alias("own"))


def r24_sliding_mean(spark, d):
    """Mean over all overlapping windows of 32 (step 16) that hold a pixel, of their means."""
    px = scene(spark, d, "c").select("row", "col", "b8")
    last = [(height(spark, d) - 32) // 16, (WIDTH - 32) // 16]
    at = [F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - 31) / 16).cast("int")), F.least(F.lit(m), F.floor(F.col(c) / 16).cast("int"))) for c, m in zip(("row", "col"), last, strict=True)]
    inside = px.filter(f"row < {last[0] * 16 + 32} and col < {last[1] * 16 + 32}")
    dealt = inside.withColumn("wr", F.explode(at[0])).withColumn("wc", F.explode(at[1]))
    means = dealt.groupBy("wr", "wc").agg(F.avg("b8").alias("m"))
    return dealt.join(means, ["wr", "wc"]).groupBy("row", "col").agg(F.avg("m").alias("m")).groupBy(F.floor(F.col("row") / 16).alias("r")).agg(F.round(F.avg("m"), 6).alias("m"))


_LABELS = "FROM rule WHERE label_a >= 0 AND label_b >= 0"
_C = lambda cond: f"count(*) FILTER (WHERE {cond})"

QUERIES = {
    "r1_indices": (r1_indices, _sql("c", select="SELECT y AS row, x AS col, round(ndbi_a, 6) + 0.0 AS ndbi, round(ndvi_a, 6) + 0.0 AS ndvi, round(ndwi_a, 6) + 0.0 AS ndwi FROM px").replace("y AS row", 'y AS "row"')),
    "r2_scene_stats": (r2_scene_stats, _sql("c", select="SELECT round(avg(v), 6) AS ndvi, round(avg((v > 0.3::DOUBLE)::INT), 6) AS green, round(avg(w), 6) AS ndwi, round(avg((w > 0)::INT), 6) AS water FROM (SELECT coalesce((b8_a - b4_a) / nullif(b8_a + b4_a, 0), 0) AS v, coalesce((b3_a - b8_a) / nullif(b3_a + b8_a, 0), 0) AS w FROM px)")),
    "r4_themes": (r4_themes, _sql("d", select=f"SELECT {_C('builtup_a')} AS builtup, {_C('ndvi_a > 0.35::DOUBLE AND NOT builtup_a AND NOT water_a')} AS green, {_C('water_a')} AS water FROM rule")),
    "p17_p21_masks": (p17_p21_masks, _sql("c", select=f"SELECT {_C('valid_a')} AS valid_all, {_C('lit_a')} AS valid_sum, {_C('NOT b2_a + b3_a + b4_a + b8_a + b11_a + b12_a > 0.01::DOUBLE')} AS dark, {_C('bright_a')} AS cloud_mean, {_C('cloudy_a')} AS cloud_min FROM px")),
    "p28_tile_quality": (p28_tile_quality, _sql("c", select="SELECT y // 16 AS tr, x // 16 AS tc, round(avg(cloudy_a::INT), 6) AS cloud FROM px GROUP BY 1, 2 HAVING avg(valid_a::INT) >= 0.5")),
    "r5_spectral_change": (r5_spectral_change, _sql("c", "d", select=f"SELECT {_C(_USABLE)} AS usable, {_C(_USABLE + ' AND m > 0.08::DOUBLE')} AS changed, round({_C(_USABLE + ' AND m > 0.08::DOUBLE')} / {_C(_USABLE)}, 4) AS ratio FROM (SELECT *, abs(ndvi_b - ndvi_a) + abs(ndwi_b - ndwi_a) AS m FROM px)")),
    "r6_class_ratio": (r6_class_ratio, _sql("c", select=f"SELECT label_a AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM rule), 4) AS ratio FROM rule GROUP BY 1")),
    "r7_class_change": (r7_class_change, _sql("c", "d", select=f"SELECT count(*) AS known, {_C('label_a <> label_b')} AS changed, round(avg((label_a = label_b)::INT), 6) AS agreement {_LABELS}")),
    "a8_transition": (a8_transition, _sql("c", "d", select=f"SELECT label_a AS from_class, {', '.join(_C(f'label_b = {k}') + f' AS to_{k}' for k in range(3))} FROM rule WHERE label_a >= 0 GROUP BY 1")),
    "a9_confusion": (a9_confusion, _sql("c", "d", select=f"SELECT tp, fp, fn, tn, round(tp / (tp + fp + fn), 6) AS iou, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT {_C('label_a = 0 AND label_b = 0')} AS tp, {_C('label_a <> 0 AND label_b = 0')} AS fp, {_C('label_a = 0 AND label_b <> 0')} AS fn, {_C('label_a <> 0 AND label_b <> 0')} AS tn {_LABELS})")),
    "a9_confusion_labels": (a9_confusion_labels, f"SELECT tp, fp, fn, tn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT {_C('quality = 1 AND toxic = 0')} AS tp, {_C('quality <> 1 AND toxic = 0')} AS fp, {_C('quality = 1 AND toxic <> 0')} AS fn, {_C('quality <> 1 AND toxic <> 0')} AS tn FROM labels)"),
    "a10_mean_iou": (a10_mean_iou, _sql("c", "d", select=" UNION ALL ".join(f"SELECT {k} AS class, round({_C(f'label_a = {k} AND label_b = {k}')} / {_C(f'label_a = {k} OR label_b = {k}')}, 6) AS iou FROM rule WHERE label_a <> -1" for k in range(3)))),
    "a12_deep_water_flips": (a12_deep_water_flips, _sql("c", "d", select=f"SELECT count(*) AS deep, round({_C('ndwi_b <= 0.15::DOUBLE')} / greatest(count(*), 1), 6) AS flip FROM px WHERE ndwi_a > 0.15::DOUBLE AND {_USABLE}")),
    "r9_theme_change": (r9_theme_change, _sql("a", "b", more=f""",
mask AS (SELECT 'gain' AS kind, y, x FROM rule WHERE {_USABLE} AND builtup_b AND NOT builtup_a UNION ALL SELECT 'loss', y, x FROM rule WHERE {_USABLE} AND builtup_a AND NOT builtup_b){PATCHES},
kept AS (SELECT kind, count(*) AS n FROM cc GROUP BY kind, label HAVING count(*) >= 5),
sums AS (SELECT coalesce(sum(n) FILTER (kind = 'gain'), 0) AS gain, coalesce(sum(n) FILTER (kind = 'loss'), 0) AS loss FROM kept),
raw AS (SELECT count(*) FILTER (kind = 'gain') AS gain, count(*) FILTER (kind = 'loss') AS loss FROM mask)""",
        select=f"""SELECT 'builtup' AS theme, (SELECT count(*) FROM rule WHERE {_USABLE}) AS valid_px, s.gain::BIGINT AS gain_px, s.loss::BIGINT AS loss_px, r.gain AS raw_gain_px, r.loss AS raw_loss_px,
  round((s.gain + s.loss) / greatest(r.gain + r.loss, 1), 6) AS keep, round((s.gain - s.loss) * 0.0001::DOUBLE, 4) AS net_km2 FROM sums s, raw r""")),
    "r12_patches": (r12_patches, _sql("b", more=f", mask AS (SELECT 1 AS kind, y, x FROM rule WHERE builtup_a){PATCHES}", select="SELECT 1 AS scene, label AS patch, count(*) AS px FROM cc GROUP BY label")),
    "g23_outlines": (g23_outlines, _sql("b", more=f""", mask AS (SELECT 1 AS kind, y, x FROM rule WHERE builtup_a){PATCHES},
big AS (SELECT label, count(*) AS px FROM cc GROUP BY label HAVING count(*) >= 5),
-- pixels around each corner of the grid, as bits
spot4 AS (SELECT label, y + dy AS cy, x + dx AS cx, sum(bit)::INT AS bits, count(*) AS n FROM cc SEMI JOIN big USING (label), (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) AS o(dy, dx, bit) GROUP BY ALL),
turn AS (SELECT label, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 3) AS n3, count(*) FILTER (bits IN (6, 9)) AS nd FROM spot4 GROUP BY label),
side AS (SELECT a.label, count(*) AS inner_ FROM cc a JOIN cc b ON a.label = b.label AND (b.y = a.y AND b.x = a.x + 1 OR b.y = a.y + 1 AND b.x = a.x) GROUP BY a.label)""",
        select="SELECT label AS patch, px, (2 - (n1 - n3 + 2 * nd) // 4)::INT AS rings, n1 + n3 + 2 * nd AS corners, 4 * px - 2 * inner_ AS length, px AS area FROM big JOIN turn USING (label) JOIN side USING (label)")),
    "r13_anomaly": (r13_anomaly, _sql("d", select=f"SELECT {_C('z > 1.2::DOUBLE')} AS level1, {_C('z > 1.2::DOUBLE AND ndvi_a > -0.5::DOUBLE')} AS level2, round(max(med), 6) AS med, round(max(mad), 6) AS mad FROM (SELECT *, (v - med) / greatest(1.4826::DOUBLE * mad, 1e-6::DOUBLE) AS z FROM (SELECT *, median(abs(v - med)) OVER () AS mad FROM (SELECT *, median(v) OVER () AS med FROM (SELECT *, b8_a + (y * x % 17)::DOUBLE / 100.0::DOUBLE AS v FROM rule WHERE water_a))))")),
    "r14_bloom_sets": (r14_bloom_sets, _sql("c", "d", select=f"SELECT {_C('water_b AND NOT water_a')} AS added, {_C('water_a AND NOT water_b')} AS gone, {_C('water_a AND water_b')} AS kept, {_C('water_b AND NOT water_a')} - {_C('water_a AND NOT water_b')} AS net FROM rule WHERE lit_a AND lit_b")),
    "r15_stretch": (r15_stretch, _sql("c", select="SELECT CAST(floor(least(greatest((dn - lo) / (hi - lo), 0), 1) * 255) AS INTEGER) AS byte, count(*) AS n FROM (SELECT b8_a * 10000 AS dn FROM px), (SELECT quantile_cont(dn, 0.02) AS lo, quantile_cont(dn, 0.98) AS hi FROM (SELECT b8_a * 10000 AS dn FROM px) WHERE dn <> 0) GROUP BY 1")),
    "r16_joint_percentiles": (r16_joint_percentiles, _sql("c", select="SELECT round(quantile_cont(v, 0.02), 6) AS p2, round(quantile_cont(v, 0.98), 6) AS p98 FROM (SELECT unnest([b2_a, b3_a, b4_a]) AS v FROM px)")),
    "r18_resample": (r18_resample, _sql("c", select=f"SELECT y * 8 // (SELECT max(y) + 1 FROM px) AS cell_row, x * 8 // {WIDTH} AS cell_col, round(avg(ndvi_a), 6) AS ndvi FROM px GROUP BY 1, 2")),
    "s20_window": (s20_window, _sql("c", select="SELECT count(*) AS n, round(avg(b4_a), 6) AS b4 FROM px WHERE y BETWEEN 24 AND 71 AND x BETWEEN 56 AND 103")),
    "s25_pyramid": (s25_pyramid, _sql("c", select=" UNION ALL ".join(f"SELECT {k} AS level, count(*) AS n, round(avg(m), 6) AS mean FROM (SELECT avg(b4_a) AS m FROM px GROUP BY y // {2**k}, x // {2**k})" for k in (1, 2, 3)))),
    "s28_mosaic": (s28_mosaic, _sql("c", "d", select="SELECT CASE WHEN valid_a THEN 'c' ELSE 'd' END AS scene_id, count(*) AS n, round(sum(CASE WHEN valid_a THEN b8_a ELSE b8_b END), 4) AS b8 FROM px WHERE valid_a OR valid_b GROUP BY 1")),
    "r23_halo_tiles": (r23_halo_tiles, _sql("c", select="SELECT tr, tc, count(*) AS n, count(*) FILTER (WHERE y // 64 = tr AND x // 64 = tc) AS own FROM px, (SELECT unnest(range(0, (max(y) + 64) // 64)) AS tr FROM px) AS a, range(0, 3) AS b(tc) WHERE y BETWEEN tr * 64 - 8 AND tr * 64 + 71 AND x BETWEEN tc * 64 - 8 AND tc * 64 + 71 GROUP BY 1, 2")),
    "r24_sliding_mean": (r24_sliding_mean, _sql("c", select="SELECT r, round(avg(m), 6) AS m FROM (SELECT y // 16 AS r, y, x, avg(m) AS m FROM px JOIN (SELECT wr, wc, avg(b8_a) AS m FROM px, (SELECT unnest(range(0, (max(y) - 31) // 16 + 1)) AS wr FROM px) AS a, range(0, 9) AS b(wc) WHERE y BETWEEN wr * 16 AND wr * 16 + 31 AND x BETWEEN wc * 16 AND wc * 16 + 31 GROUP BY 1, 2) ON y BETWEEN wr * 16 AND wr * 16 + 31 AND x BETWEEN wc * 16 AND wc * 16 + 31 GROUP BY y, x) GROUP BY r")),
}
