"""Map styles: small JSON that names the folders (or tiles) it draws, whatever their size."""

from __future__ import annotations

import json

from ..operators.cartography import FONT
from ..operators.layers import CHANGE_COLORS
from .intents import MapIntent

# Words of the kinds of change, paints of layers, prefix of ids.
CHANGE_WORDS = {"gain": "新增", "loss": "消失"}
LABEL_PAINT = {"text-color": "#f5f5f5", "text-halo-color": "#1a1a1a", "text-halo-width": 1.5}
CIRCLE = {"circle-radius": 5, "circle-stroke-color": "#ffffff", "circle-stroke-width": 1}
PREFIX = "t2m-"


def legend(label: str) -> list[dict]:
    """What the colours of an overlay mean."""
    return [{"key": k, "color": c, "label": f"{CHANGE_WORDS[k]}{label}（疑似）"} for k, c in CHANGE_COLORS.items()]


def label_layer(source: str) -> dict:
    """The symbol layer that draws label features; the drawing engine may still drop labels,
    those of low priority first."""
    layout = {"text-field": ["get", "name"], "text-size": FONT, "text-anchor": ["get", "anchor"], "symbol-sort-key": ["get", "priority"], "text-allow-overlap": False}
    return {"id": f"{PREFIX}poi-labels", "type": "symbol", "source": source, "layout": layout, "paint": LABEL_PAINT}


def assemble(intent: MapIntent, bounds: tuple[float, float, float, float], data: dict[str, str], fill: str | None = None) -> dict:
    """A map style for an intent: sources, layers, ids of both in drawing order, bounds to fit.

    ``data`` names the folder (or tile address) of each source the theme draws: points, polygons
    and labels of ``poi``, grid of ``ndvi``, tiles of ``cog``; sources without one aren't drawn.
    ``fill`` is a style expression as JSON (``symbology.styles``)."""
    intent.check()
    color = json.loads(fill)["fill-color"] if fill else "#888888"
    fills = {"polygons": ("poi-poly", {"fill-color": color, "fill-opacity": 0.35}), "grid": ("ndvi", {"fill-color": color, "fill-opacity": 0.8})}
    wanted = {"poi": ("polygons", "points", "labels"), "ndvi": ("grid",), "cog": ("tiles",)}[intent.theme]
    sources, layers, ids = {}, [], []
    for part in (p for p in wanted if p in data):
        if part == "tiles":
            source, kind, name = f"{PREFIX}cog-src", "raster", f"{PREFIX}cog-layer"
            sources[source] = {"type": "raster", "tiles": [data[part]], "tileSize": 256, "minzoom": 0, "maxzoom": 16}
            layers.append({"id": name, "type": kind, "source": source, "paint": {"raster-opacity": float(intent.opacity)}})
        else:
            stem = {"points": "poi-pts", "labels": "poi-labels"}.get(part) or fills[part][0]
            source = f"{PREFIX}{stem}-src"
            sources[source] = {"type": "geojson", "data": data[part]}
            if part == "labels":
                layers.append(label_layer(source))
            elif part == "points":
                layers.append({"id": f"{PREFIX}poi-points", "type": "circle", "source": source, "paint": {"circle-color": color, **CIRCLE}})
            else:
                layers.append({"id": f"{PREFIX}{stem}-fill", "type": "fill", "source": source, "paint": fills[part][1]})
        ids += [source, layers[-1]["id"]]
    return {"theme": intent.theme, "region": intent.region, "fit_bounds": list(bounds), "sources": sources, "layers": layers, "layer_ids": ids}
