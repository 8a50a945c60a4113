"""Band algebra over pixel rows: indices, masks, theme rules and pseudo-labels.

A pixel row has band columns b2, b3, b4, b8, b11, b12 as reflectance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BAND_COLUMNS = ("b2", "b3", "b4", "b8", "b11", "b12")
EPS = 1e-6

# Band pairs of the indices, theme rules, area steps.
INDICES = {"ndbi": ("b11", "b8"), "ndvi": ("b8", "b4"), "ndwi": ("b3", "b8")}
THEMES = {
    "builtup": {"label": "建筑用地", "main": "ndbi", "op": "gt", "threshold": 0.0, "assist": ("ndvi", "lt_main"), "exclude": [], "color": "#5F5E5A", "min_patch_px": 5},
    "green": {"label": "绿化用地", "main": "ndvi", "op": "gt", "threshold": 0.35, "assist": None, "exclude": ["builtup", "water"], "color": "#3B6D11", "min_patch_px": 5},
    "water": {"label": "水域", "main": "ndwi", "op": "gt", "threshold": 0.1, "assist": None, "exclude": [], "color": "#185FA5", "min_patch_px": 1},
}


def index(name: str, suffix: str = "") -> Column:
    """A normalised difference, guarded by a small number below."""
    pos, neg = (F.col(c + suffix) for c in INDICES[name])
    return (pos - neg) / (pos + neg + EPS)


def index_or_zero(name: str, suffix: str = "") -> Column:
    """The same, 0 where the sum is 0."""
    pos, neg = (F.col(c + suffix) for c in INDICES[name])
    return F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0))


def bands(suffix: str = "") -> list[Column]:
    return [F.col(c + suffix) for c in BAND_COLUMNS]


def total(suffix: str = "") -> Column:
    return reduce(lambda a, b: a + b, bands(suffix))


def valid_all(suffix: str = "") -> Column:
    """No band is 0."""
    return F.coalesce(F.least(*bands(suffix)) > 0, F.lit(False))


def valid_sum(suffix: str = "", least: float = 0.02) -> Column:
    return F.coalesce(total(suffix) > least, F.lit(False))


def cloud_mean(suffix: str = "", brightness: float = 0.30) -> Column:
    return F.coalesce(total(suffix) / len(BAND_COLUMNS) > brightness, F.lit(False))


def cloud_min(suffix: str = "", brightness: float = 0.25) -> Column:
    return F.coalesce(F.least(*bands(suffix)) > brightness, F.lit(False))


def check_themes(themes: dict = THEMES) -> None:
    """Raises if themes exclude each other in a circle or name unknown ones."""
    done: set[str] = set()

    def visit(key: str, path: tuple[str, ...]) -> None:
        if key in path:
            raise ValueError(f"themes exclude each other: {' -> '.join((*path, key))}")
        if key not in themes:
            raise ValueError(f"unknown theme: {key}")
        if key not in done:
            for other in themes[key]["exclude"]:
                visit(other, (*path, key))
            done.add(key)

    for key in themes:
        visit(key, ())


def theme(key: str, suffix: str = "", themes: dict = THEMES) -> Column:
    """A theme's rule as one expression: threshold, assisting index, exclusions."""
    if key not in themes:
        raise ValueError(f"unknown theme: {key}")
    rule = themes[key]
    main = index(rule["main"], suffix)
    mask = main > rule["threshold"] if rule["op"] == "gt" else main < rule["threshold"]
    if rule["assist"]:
        name, op = rule["assist"][:2]
        mask &= index(name, suffix) < main if op == "lt_main" else index(name, suffix) > rule["assist"][2]
    for other in rule["exclude"]:
        mask &= ~theme(other, suffix, themes)
    return F.coalesce(mask, F.lit(False))


def pseudo_label(suffix: str = "") -> Column:
    """0 water, 2 vegetation, 1 the rest, -1 cloud (which wins)."""
    water, green = index("ndwi", suffix) > 0.05, index("ndvi", suffix) > 0.3
    return F.when(cloud_min(suffix), -1).when(water, 0).when(green, 2).otherwise(1)


def spectral_change(a: str, b: str, threshold: float = 0.08) -> Column:
    moved = F.abs(index("ndvi", b) - index("ndvi", a)) + F.abs(index("ndwi", b) - index("ndwi", a))
    return moved > threshold


def pad_bands(present: int) -> dict[str, Column]:
    """Missing bands of older scenes as nulls: they have the first ``present``."""
    return {c: F.lit(None).cast("double") for c in BAND_COLUMNS[present:]}
