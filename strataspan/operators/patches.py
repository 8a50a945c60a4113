"""Patches: 4-connected components of a pixel mask, their sizes and outlines.

The mask is cut into square blocks. Each block is labelled in one task (its size is
fixed), then labels that touch across a block's edge are linked by joins and resolved by
repeated minima over the few labels at edges. No task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import geo
from ..storage import materialise
from .ranking import closed_rings, corners, link_pieces

BLOCK = 256


def _label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest linear position of each pixel's component inside its block."""
    r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
    r0, c0 = r.min(), c.min()
    width = int(c.max() - c0) + 2
    grid = np.full((int(r.max() - r0) + 2, width), np.iinfo(np.int64).max)
    at = (r - r0, c - c0)
    grid[at] = (r << 32) | c
    on = np.zeros(grid.shape, bool)
    on[at] = True
    while True:  # sweeps of running minima along rows and columns
        before = grid[at].copy()
        for axis in (0, 1):
            for step in (1, -1):
                g, m = (np.moveaxis(x, axis, 0)[::step] for x in (grid, on))
                for i in range(1, len(g)):
                    np.minimum(g[i], g[i - 1], out=g[i], where=m[i] & m[i - 1])
        if (grid[at] == before).all():
            break
    return pdf.assign(label=grid[at])


def label_patches(mask: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, row, col, patch (smallest position in it) for mask pixels (keys, row, col)."""
    cells = mask.select(*keys, F.col("row").cast("long"), F.col("col").cast("long")).distinct()
    cells = cells.withColumns({"br": F.floor(F.col("row") / block), "bc": F.floor(F.col("col") / block)})
    schema = StructType([*cells.schema.fields, StructField("label", LongType())])
    local = cells.groupBy(*keys, "br", "bc").applyInPandas(_label_block, schema)
    local = materialise(local, "patches")

    # pixels at the low edges of a block meet their neighbours in the block before
    low_row = local.filter(F.col("row") % block == 0).select(*keys, (F.col("row") - 1).alias("row"), "col", F.col("label").alias("x"))
    low_col = local.filter(F.col("col") % block == 0).select(*keys, "row", (F.col("col") - 1).alias("col"), F.col("label").alias("x"))
    edge = local.filter((F.col("row") % block == block - 1) | (F.col("col") % block == block - 1))
    links = low_row.unionByName(low_col).join(edge.select(*keys, "row", "col", F.col("label").alias("y")), [*keys, "row", "col"])
    names = _resolve(links.select(*keys, "x", "y").distinct(), keys)
    out = local.join(names, [*keys, "label"], "left")
    return out.select(*keys, "row", "col", F.coalesce("least", "label").alias("patch"))


def _resolve(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, least: smallest label that each linked label is connected to. Labels
    take the minimum of their neighbours and then that of their minimum's, until nothing
    moves."""
    both = links.select(*keys, F.col("x").alias("a"), F.col("y").alias("b")).unionByName(links.select(*keys, F.col("y").alias("a"), F.col("x").alias("b")))
    both = materialise(both, "patch-links")
    now = materialise(both.select(*keys, F.col("a").alias("label"), F.col("a").alias("least")).distinct(), "patch-names")
    while True:
        near = both.join(now.select(*keys, F.col("label").alias("b"), "least"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("label")).agg(F.min("least").alias("m"))
        new = now.join(near, [*keys, "label"]).select(*keys, "label", F.least("least", "m").alias("least"))
        jump = new.select(*keys, F.col("label").alias("least"), F.col("least").alias("m"))
        new = new.join(jump, [*keys, "least"], "left").select(*keys, "label", F.least("least", F.coalesce("m", "least")).alias("least"))
        new = materialise(new, "patch-names")
        moved = new.exceptAll(now).limit(1).count()
        now = new
        if not moved:
            return now


def keep_large(mask: DataFrame, keys: list[str], min_px: int, block: int = BLOCK) -> DataFrame:
    """keys, row, col, patch, px of pixels whose patch has ``min_px`` pixels or more."""
    labelled = label_patches(mask, keys, block)
    sizes = labelled.groupBy(*keys, "patch").agg(F.count("*").alias("px")).filter(F.col("px") >= max(min_px, 1))
    return labelled.join(sizes, [*keys, "patch"])


def _border(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Sides of pixels that have no pixel of their patch beyond, directed with the patch on the left."""
    here = patches.select(*keys, "patch", "px", "row", "col")
    sides = here.select(
        *keys, "patch", "px",
        F.explode(F.array(*[
            F.struct(
                F.lit(n).alias("side"), (F.col("row") + dr).alias("nr"), (F.col("col") + dc).alias("nc"),
                (F.col("col") + x1).alias("x1"), (F.col("row") + y1).alias("y1"), (F.col("col") + x2).alias("x2"), (F.col("row") + y2).alias("y2"),
            )
            for n, dr, dc, x1, y1, x2, y2 in ((0, -1, 0, 0, 0, 1, 0), (1, 0, 1, 1, 0, 1, 1), (2, 1, 0, 1, 1, 0, 1), (3, 0, -1, 0, 1, 0, 0))
        ])).alias("s"),
    ).select(*keys, "patch", "px", "s.*")
    inner = here.select(*keys, F.col("patch"), F.col("row").alias("nr"), F.col("col").alias("nc"))
    return sides.join(inner, [*keys, "patch", "nr", "nc"], "left_anti").select(*keys, "patch", "px", "x1", "y1", "x2", "y2")


def outline_points(patches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, patch, px, ring, pos, x, y: corners of the outlines in pixel corners (x = column,
    y = row), the patch on the left. Sides are ordered by list ranking, so a patch may be
    spread over any number of tasks."""
    return _outline_points(patches, keys).select("key_.*", "ring", "pos", "x", "y")


def _outline_points(patches: DataFrame, keys: list[str]) -> DataFrame:
    packed = _border(patches, keys).select(F.struct(*keys, "patch", "px").alias("key_"), "x1", "y1", "x2", "y2")
    return corners(link_pieces(packed, ["key_"]), ["key_"])


def outlines(patches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, patch, px, rings: each patch's outlines as arrays, the outer one first."""
    rings = closed_rings(_outline_points(patches, keys), ["key_"])
    sized = F.struct((-F.abs(geo.signed_area(F.col("ring")))).alias("less"), "id", "ring")
    return rings.groupBy("key_").agg(F.transform(F.sort_array(F.collect_list(sized)), lambda r: r.ring).alias("rings")).select("key_.*", "rings")
