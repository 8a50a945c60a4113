"""From a change result to words and a report: numbers go only into the template."""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbology import AREA_BANDS, NOISE_BANDS, RATIO_BANDS, band


def in_words(results: DataFrame) -> DataFrame:
    """direction, magnitude, coverage, area, noise of results; no column holds a number of
    the input. Results without a net area count as growing."""
    has = set(results.columns)
    net = F.col("net_km2") if "net_km2" in has else F.lit(None).cast("double")
    keep = F.col("patch_keep_ratio") if "patch_keep_ratio" in has else F.lit(None).cast("double")
    return results.select(
        F.when(F.coalesce(net, F.lit(0.0)) >= 0, "增加").otherwise("减少").alias("direction"),
        band(F.coalesce("change_ratio", F.lit(0.0)), RATIO_BANDS).alias("magnitude"),
        F.when(F.coalesce("valid_pct", F.lit(0.0)) > 0.5, "较高").otherwise("有限").alias("coverage"),
        F.when(net.isNotNull(), band(F.abs(net), AREA_BANDS)).alias("area"), F.when(keep.isNotNull(), band(1 - keep, NOISE_BANDS)).alias("noise"),
    )


MARKDOWN = Template("# $title\n\n$story\n\n| measure | value |\n|-|-|\n$rows\n")
HTML = Template("<!doctype html><title>$title</title><h1>$title</h1><p>$story</p><table>$rows</table>\n")


def percent(value: float) -> str:
    return f"{round(value * 100, 2)}%"


def render(title: str, story: str, numbers: dict[str, object]) -> tuple[str, str]:
    """Markdown and HTML of one context."""
    import html

    shown = {k: percent(v) if k.endswith(("ratio", "pct")) and isinstance(v, float) else v for k, v in numbers.items()}
    md = MARKDOWN.substitute(title=title, story=story, rows="\n".join(f"| {k} | {v} |" for k, v in shown.items()))
    cells = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(str(v))}</td></tr>" for k, v in shown.items())
    return md, HTML.substitute(title=html.escape(title), story=html.escape(story), rows=cells)


def change_report(title: str, result: DataFrame) -> tuple[str, str]:
    """A report of one result row."""
    row = result.limit(1).collect()[0].asDict()
    words = in_words(result).first()
    story = f"{words.direction}, {words.magnitude}" + (f", {words.area}" if words.area else "") + f"; {words.coverage}"
    return render(title, story, row)
