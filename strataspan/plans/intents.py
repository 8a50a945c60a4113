"""Typed intents: what a request asks for, and the query that answers it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.raster import THEMES

# Words that name a theme, classes of a map intent.
THEME_WORDS = {"builtup": ("建筑", "城市", "建成", "built"), "green": ("绿化", "植被", "green"), "water": ("水", "water")}
MAP_THEMES = ("poi", "ndvi", "cog")
CLASSES = ("subway", "park", "school", "district")


@dataclass
class Intent:
    kind: str  # change, buffer, query, error
    theme: str = "builtup"
    years: list[int] = field(default_factory=list)
    lon: float = 0.0
    lat: float = 0.0
    metres: float = 0.0
    message: str = ""


def parse(text: str) -> Intent:
    """By rule: two years ask for change, a place and a radius for what is near."""
    years = sorted({int(y) for y in re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", text)})
    theme = next((k for k, words in THEME_WORDS.items() if any(w in text for w in words)), "builtup")
    if len(years) >= 2:
        return Intent("change", theme, [years[0], years[-1]])
    place = re.search(r"(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)", text)
    radius = re.search(r"(\d+(?:\.\d+)?)\s*(km|m|公里|米)", text)
    if place and radius:
        scale = 1000.0 if radius[2] in ("km", "公里") else 1.0
        return Intent("buffer", theme, years, float(place[1]), float(place[2]), float(radius[1]) * scale)
    return Intent("query", theme, years) if text.strip() else Intent("error", message="empty request")


def route(intent: Intent, handlers: dict) -> DataFrame:
    """The frame of the handler for an intent's kind; raises for kinds without one."""
    if intent.kind not in handlers:
        raise ValueError(intent.message or f"no handler for {intent.kind}")
    return handlers[intent.kind](intent)


@dataclass
class MapIntent:
    """An enumerated map request."""

    theme: str
    region: str
    visible_classes: list[str]
    label_classes: list[str]
    opacity: float = 1.0

    def check(self) -> None:
        """Raises for anything outside the lists."""
        if self.theme not in MAP_THEMES:
            raise ValueError(f"unknown theme: {self.theme}")
        if not self.region:
            raise ValueError("no region")
        for name in (*self.visible_classes, *self.label_classes):
            if name not in CLASSES:
                raise ValueError(f"unknown class: {name}")
        if not set(self.label_classes) <= set(self.visible_classes):
            raise ValueError("labels for classes that aren't shown")
        if not 0 <= self.opacity <= 1:
            raise ValueError("opacity is 0 to 1")


def check_themes() -> None:
    """Raises if a word list names no theme."""
    if set(THEME_WORDS) != set(THEMES):
        raise ValueError("themes and their words differ")
