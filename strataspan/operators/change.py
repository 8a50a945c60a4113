"""Two-date change: pixel join, thematic gain and loss, accounting, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from .patches import keep_large
from .quantiles import quantiles


def pixel_join(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both dates' bands (suffixes _a, _b) of pixels that both scenes have."""
    named = [
        df.select("row", "col", *[F.col(c).alias(c + s) for c in raster.BAND_COLUMNS]) for df, s in ((first, "_a"), (second, "_b"))
    ]
    return named[0].join(named[1], ["row", "col"])


def usable(pixels: DataFrame) -> DataFrame:
    """With a flag for pixels that are valid and cloudless at both dates."""
    ok = raster.valid_all("_a") & raster.valid_all("_b") & ~raster.cloud_mean("_a") & ~raster.cloud_mean("_b")
    return pixels.withColumn("usable", ok)


def gain_loss(pixels: DataFrame, theme: str) -> DataFrame:
    """With flags for pixels that enter and leave a theme."""
    a, b = raster.theme(theme, "_a"), raster.theme(theme, "_b")
    return usable(pixels).withColumns({"gain": F.col("usable") & b & ~a, "loss": F.col("usable") & a & ~b})


def theme_change(pixels: DataFrame, theme: str, pixel_km2: Column | float, cached: bool = True) -> DataFrame:
    """One row: pixels and km2 gained, lost and net, after and before small patches go."""
    marked = gain_loss(pixels, theme)
    totals = marked.agg(F.count("*").alias("all_px"), F.count_if("usable").alias("valid_px"), F.count_if("gain").alias("raw_gain_px"), F.count_if("loss").alias("raw_loss_px"))
    kept = kept_patches(marked, theme)
    after = kept.agg(F.count_if(F.col("kind") == "gain").alias("gain_px"), F.count_if(F.col("kind") == "loss").alias("loss_px"))
    km2 = pixel_km2 if isinstance(pixel_km2, Column) else F.lit(pixel_km2)
    one = totals.join(F.broadcast(after))  # one row each
    changed = F.col("gain_px") + F.col("loss_px")
    raw = F.col("raw_gain_px") + F.col("raw_loss_px")
    return one.select(
        F.lit(theme).alias("theme"), F.lit(raster.THEMES[theme]["min_patch_px"]).alias("min_patch_px"), "valid_px", "gain_px", "loss_px", "raw_gain_px", "raw_loss_px",
        (changed / F.greatest("valid_px", F.lit(1))).alias("change_ratio"), (F.col("valid_px") / F.greatest("all_px", F.lit(1))).alias("valid_pct"),
        (F.col("gain_px") * km2).alias("gain_km2"), (F.col("loss_px") * km2).alias("loss_km2"), ((F.col("gain_px") - F.col("loss_px")) * km2).alias("net_km2"),
        ((F.col("raw_gain_px") - F.col("raw_loss_px")) * km2).alias("raw_net_km2"), (changed / F.greatest(raw, F.lit(1))).alias("patch_keep_ratio"),
    )


def kept_patches(marked: DataFrame, theme: str) -> DataFrame:
    """kind, row, col, patch, px of gained and lost pixels in patches that are large enough."""
    kinds = F.filter(F.array(F.when(F.col("gain"), "gain"), F.when(F.col("loss"), "loss")), lambda k: k.isNotNull())
    flat = marked.select(F.explode(kinds).alias("kind"), "row", "col")
    return keep_large(flat, ["kind"], raster.THEMES[theme]["min_patch_px"])


def transition(pairs: DataFrame, a: str, b: str, classes: list[int]) -> DataFrame:
    """Counts of class pairs: a row per first class, a column per second one."""
    wide = pairs.filter(F.col(a).isin(classes)).groupBy(F.col(a).alias("from_class")).pivot(b, classes).agg(F.count(F.lit(1))).fillna(0)
    return wide.select("from_class", *[F.col(str(c)).alias(f"to_{c}") for c in classes])


def confusion(pairs: DataFrame, truth: Column, found: Column) -> DataFrame:
    """tp, fp, fn, tn and IoU, precision, recall, F1; empty denominators count as 1."""
    n = pairs.agg(F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"), F.count_if(truth & ~found).alias("fn"), F.count_if(~truth & ~found).alias("tn"))
    one = F.lit(1)
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    return n.select("*", (F.col("tp") / F.greatest(F.col("tp") + F.col("fp") + F.col("fn"), one)).alias("iou"), p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"))


def mean_iou(pairs: DataFrame, truth: str, found: str, classes: list[int], ignore: int = -1) -> DataFrame:
    """class, iou (0 for an empty union) of pixels whose truth isn't ignored."""
    known = pairs.filter(F.col(truth) != ignore)
    rows = known.agg(*[F.struct(F.count_if((F.col(truth) == c) & (F.col(found) == c)).alias("i"), F.count_if((F.col(truth) == c) | (F.col(found) == c)).alias("u")).alias(f"c{c}") for c in classes])
    flat = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.coalesce(F.try_divide(f"c{c}.i", f"c{c}.u"), F.lit(0.0)).alias("iou")) for c in classes])).alias("x"))
    return flat.select("x.*")


def robust_z(df: DataFrame, value: str, keys: list[str], where: Column) -> DataFrame:
    """With z: distance from the group's median in units of 1.4826 times its median
    absolute deviation; both medians are exact and taken over rows that meet ``where``."""
    middle = lambda rows, of, name: quantiles(rows.filter(where), of, keys, [0.5]).select(*keys, F.col("q").alias(name))
    joined = df.join(middle(df, value, "med"), keys, "left").withColumn("off_", F.abs(F.col(value) - F.col("med")))
    scale = F.greatest(1.4826 * F.col("mad"), F.lit(1e-6))
    return joined.join(middle(joined, "off_", "mad"), keys, "left").withColumn("z", (F.col(value) - F.col("med")) / scale).drop("off_")


def stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """With ``byte``: 0..255 between two exact percentiles of the values that aren't 0; the
    minimum and maximum where the percentiles are less than 1 apart."""
    seen = df.filter(F.col(value) != 0)
    ends = quantiles(seen, value, [], [low, high]).agg(F.min(F.when(F.col("p") == low, F.col("q"))).alias("a"), F.max(F.when(F.col("p") == high, F.col("q"))).alias("b"))
    q = ends.join(F.broadcast(seen.agg(F.min(value).alias("mn"), F.max(value).alias("mx"))))  # one row each
    narrow = F.col("b") - F.col("a") < 1
    ends = q.select(F.when(narrow, F.col("mn")).otherwise(F.col("a")).alias("lo"), F.when(narrow, F.col("mx")).otherwise(F.col("b")).alias("hi"))
    part = (F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    return df.join(F.broadcast(ends)).withColumn("byte", F.floor(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")).drop("lo", "hi")  # one row


def resample(pixels: DataFrame, n: int, height: int, width: int, columns: list[str]) -> DataFrame:
    """Block averages on a grid of n by n cells."""
    cell = [F.floor(F.col("row") * n / height).alias("cell_row"), F.floor(F.col("col") * n / width).alias("cell_col")]
    return pixels.groupBy(*cell).agg(*[F.avg(c).alias(c) for c in columns])


def pyramid(pixels: DataFrame, keys: list[str], columns: list[str], levels: int = 5) -> DataFrame:
    """Overview levels 1..n: averages of 2, 4, 8, ... pixels a side, each from the one before."""
    level = pixels.select(*keys, F.col("row"), F.col("col"), *columns, F.lit(1).alias("n"))
    out = None
    for k in range(1, levels + 1):
        cell = [F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")]
        level = level.groupBy(*keys, *cell).agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in columns], F.sum("n").alias("n"))
        tagged = level.withColumn("level", F.lit(k))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def first_valid_mosaic(pixels: DataFrame, order: str) -> DataFrame:
    """row, col, scene: of the scenes that have a valid pixel there, the first by order."""
    return pixels.filter(raster.valid_all()).groupBy("row", "col").agg(F.min_by(F.struct("scene_id", *raster.BAND_COLUMNS), order).alias("p")).select("row", "col", "p.*")
