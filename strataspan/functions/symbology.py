"""Symbology as tables: profiles of columns, decisions joined to palettes, style expressions,
bands of words. Every step is a DataFrame with one row for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Colour tables, colours by meaning, steps of words.
PALETTES = {
    "Set2": ["#66C2A5", "#FC8D62", "#8DA0CB", "#E78AC3", "#A6D854", "#FFD92F", "#E5C494", "#B3B3B3"],
    "YlGnBu": ["#FFFFD9", "#EDF8B1", "#C7E9B4", "#7FCDBB", "#41B6C4", "#1D91C0", "#225EA8", "#0C2A84"],
    "Greens": ["#F7FCF5", "#E5F5E0", "#C7E9C0", "#A1D99B", "#74C476", "#41AB5D", "#238B45", "#006D2C"],
    "OrRd": ["#FFF7EC", "#FEE8C8", "#FDD49E", "#FDBB84", "#FC8D59", "#EF6548", "#D7301F", "#B30000"],
    "RdBu": ["#67001F", "#B2182B", "#D6604D", "#F4A582", "#F7F7F7", "#92C5DE", "#4393C3", "#2166AC", "#053061"],
}
MEANINGS = {
    "水": "#3787C0", "水体": "#3787C0", "植被": "#4C9F38", "绿植": "#4C9F38", "城市": "#8C8C8C", "建成区": "#8C8C8C",
    "新增": "#E24B4A", "变化": "#E24B4A", "消退": "#3787C0", "持续": "#E6B93C",
}
RATIO_BANDS = [(0.02, "轻微"), (0.08, "中等"), (None, "显著")]
AREA_BANDS = [(0.5, "轻微"), (2.0, "中等"), (None, "显著")]
NOISE_BANDS = [(0.5, "低"), (0.8, "中"), (None, "高")]
CATEGORIES, OTHER, CLEAR, STOPS = 10, "#CCCCCC", "#00000000", 5
# Palette by kind and by a hint among the labels, the first match counts.
DECISIONS = [
    ("binary", "", "semantic(binary)", False),
    ("categorical", "", "Set2", False),
    ("diverging", "", "RdBu", True),
    ("sequential", "植被", "Greens", True),
    ("sequential", "风险|密度|热度", "OrRd", True),
    ("sequential", "", "YlGnBu", True),
]
_TYPES = {T.BooleanType: "flag", T.ByteType: "whole", T.ShortType: "whole", T.IntegerType: "whole", T.LongType: "whole"}


def profiles(df: DataFrame, columns: list[str], labels: dict[str, list[str]] | None = None) -> DataFrame:
    """col, kind (binary, categorical, diverging, sequential), lo, hi, classes (of categorical
    columns, in order) and labels, from one pass over the columns' distinct values. NaN and
    nulls are left out."""
    cells = [
        F.struct(F.lit(c).alias("col"), F.lit(_TYPES.get(type(df.schema[c].dataType), "real")).alias("type"), F.col(c).cast("double").alias("v")) for c in columns
    ]
    values = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").distinct().filter("v is not null and not isnan(v)")
    some = values.withColumn("no", F.row_number().over(Window.partitionBy("col").orderBy("v"))).filter(F.col("no") <= CATEGORIES)
    classes = some.groupBy("col").agg(F.array_sort(F.collect_list("v")).alias("classes"))
    spans = values.groupBy("col", "type").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    few = (F.col("type") == "whole") & (F.col("n") <= CATEGORIES)
    kind = F.when(F.col("type") == "flag", "binary").when(few, "categorical").when((F.col("lo") < 0) & (F.col("hi") > 0), "diverging").otherwise("sequential")
    named = [x for c, ls in (labels or {}).items() for x in (F.lit(c), F.array(*map(F.lit, ls)).cast("array<string>"))]
    given = F.coalesce(F.create_map(*named)[F.col("col")] if named else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    kept = F.when(F.col("kind") == "categorical", F.transform("classes", lambda v: v.cast("long").cast("string"))).otherwise(F.array().cast("array<string>"))
    out = spans.withColumn("kind", kind).join(classes, "col")
    return out.select("col", "kind", "lo", "hi", kept.alias("classes"), given.alias("labels"))


def palettes(spark: SparkSession) -> DataFrame:
    """palette, step, color."""
    return spark.createDataFrame([(k, i, c) for k, cs in PALETTES.items() for i, c in enumerate(cs)], "palette string, step int, color string")


def plans(profiled: DataFrame) -> DataFrame:
    """The profiles with palette, safe (for the colour-blind) and colors. Classes whose label
    has a colour by meaning take it; the others take Set2 in turn, from its start again
    where it ends."""
    spark = profiled.sparkSession
    rules = spark.createDataFrame([(i, *d) for i, d in enumerate(DECISIONS)], "turn int, kind string, hint string, palette string, safe boolean")
    met = profiled.join(rules, "kind").filter(F.rlike(F.array_join("labels", ""), F.col("hint")))
    met = met.groupBy(*profiled.columns).agg(F.min_by(F.struct("palette", "safe"), "turn").alias("d")).select(*profiled.columns, "d.*")

    colors = palettes(spark)
    ramps = colors.groupBy("palette").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "color"))), lambda x: x.color).alias("ramp"))
    meanings = spark.createDataFrame(list(MEANINGS.items()), "label string, own string")
    each = profiled.select("col", F.posexplode("classes").alias("no", "class"), "labels").select("col", "no", F.get("labels", F.col("no")).alias("label"))
    each = each.join(meanings, "label", "left")
    turn = F.row_number().over(Window.partitionBy("col", F.col("own").isNull()).orderBy("no")) - 1
    plain = colors.filter("palette = 'Set2'").select("step", "color")
    each = each.withColumn("step", F.pmod(turn, F.lit(len(PALETTES["Set2"])))).join(plain, "step")
    painted = each.groupBy("col").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("no", F.coalesce("own", "color").alias("c")))), lambda x: x.c).alias("painted"),
        F.count("own").alias("hits"),
        F.count("*").alias("n"),
    )
    out = met.join(ramps, "palette", "left").join(painted, "col", "left")
    name = F.when((F.col("kind") != "categorical") | (F.coalesce("hits", F.lit(0)) == 0), F.col("palette")).when(F.col("hits") == F.col("n"), "semantic").otherwise("Set2+semantic")
    shades = F.when(F.col("kind") == "binary", F.array(F.lit(CLEAR), F.lit(MEANINGS["变化"]))).when(F.col("kind") == "categorical", F.col("painted")).otherwise(F.col("ramp"))
    return out.select(*profiled.columns, name.alias("palette"), "safe", shades.alias("colors"))


def css(color: Column) -> Column:
    """``#RRGGBBAA`` as rgba(), other colours as they are."""
    alpha = F.conv(F.substring(color, 8, 2), 16, 10).cast("double") / 255
    return F.when(F.length(color) == 9, F.format_string("rgba(%d,%d,%d,%.3f)", *[channel(color, k) for k in range(3)], alpha)).otherwise(color)


def blend(colors: Column, at: Column) -> Column:
    """The colour at 0..1 along an array of colours, in 256 steps."""
    place = F.least(F.floor(at * 256), F.lit(255)) / 255 * (F.size(colors) - 1)
    i = F.least(F.floor(place), F.size(colors) - 2).cast("int")
    mixed = [F.round(channel(F.get(colors, i), k) + (channel(F.get(colors, i + 1), k) - channel(F.get(colors, i), k)) * (place - i)).cast("int") for k in range(3)]
    return F.format_string("#%02x%02x%02x", *mixed)


def styles(planned: DataFrame, stops: int = STOPS) -> DataFrame:
    """col, style: a fill expression as JSON, matches for classes and interpolation for ranges."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    keys = F.when(F.col("kind") == "binary", F.array(F.lit("false"), F.lit("true"))).otherwise(F.col("classes"))
    matches = F.transform(F.arrays_zip(keys.alias("k"), F.col("colors").alias("c")), lambda x: F.concat(x.k, F.lit(","), quoted(css(x.c))))
    part = lambda k: k.cast("double") / (stops - 1)
    value = lambda k: F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * part(k), 4).cast("string")
    ramp = F.transform(F.sequence(F.lit(0), F.lit(stops - 1)), lambda k: F.concat(value(k), F.lit(","), quoted(blend(F.col("colors"), part(k)))))
    get = F.concat(F.lit('["get","'), "col", F.lit('"]'))
    by_class = F.concat_ws(",", F.lit('["match"'), get, F.array_join(matches, ","), F.lit(f'"{OTHER}"]'))
    by_value = F.concat(F.concat_ws(",", F.lit('["interpolate",["linear"]'), get, F.array_join(ramp, ",")), F.lit("]"))
    fill = F.when(F.col("kind").isin("binary", "categorical"), by_class).otherwise(by_value)
    return planned.select("col", F.concat(F.lit('{"fill-color":'), fill, F.lit("}")).alias("style"))


def band(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    """The word of the first step that is above a value."""
    out = None
    for limit, word in bands[:-1]:
        out = F.when(value < limit, word) if out is None else out.when(value < limit, word)
    return out.otherwise(bands[-1][1])


def channel(color: Column, k: int) -> Column:
    """Red, green or blue (k = 0, 1, 2) of ``#RRGGBB``."""
    return F.conv(F.substring(color, 2 + 2 * k, 2), 16, 10).cast("int")
