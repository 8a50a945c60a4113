"""Rings as WKT and GeoJSON text and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def point_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def ring_text(ring: Column) -> Column:
    """POLYGON of one ring; null stays null, a ring without points is POLYGON EMPTY."""
    pairs = F.transform(ring, lambda p: F.concat(p.x.cast("string"), F.lit(" "), p.y.cast("string")))
    return F.when(F.size(ring) == 0, "POLYGON EMPTY").otherwise(F.concat(F.lit("POLYGON (("), F.array_join(pairs, ", "), F.lit("))")))


def _point(pair: Column) -> Column:
    x, y = (F.regexp_extract_all(pair, F.lit(_NUMBER), F.lit(0))[i].cast("double") for i in (0, 1))
    return geo.point(x, y)


def point_of(text: Column) -> Column:
    """The point of ``POINT (x y)``; null for other text."""
    return F.when(text.rlike(rf"(?i)^\s*POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)\s*$"), _point(text))


def rings_of(text: Column) -> Column:
    """The rings of ``POLYGON ((x y, ...), ...)``, none for an empty one; null for other text."""
    polygon = text.rlike(rf"(?i)^\s*POLYGON\s*\(\s*\(\s*{_NUMBER}[-+0-9.eE\s,()]*\)\s*\)\s*$")
    bodies = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    rings = F.transform(bodies, lambda body: F.transform(F.split(body, ","), _point))
    return F.when(polygon, rings).when(text.rlike(r"(?i)^\s*POLYGON\s+EMPTY\s*$"), F.slice(rings, 1, 0))


def geojson_of(ring: Column) -> Column:
    """A GeoJSON polygon of one ring."""
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p.x, p.y))).alias("coordinates")))


def rings_of_geojson(text: Column) -> Column:
    """The rings of a GeoJSON polygon; null for other geometries and text."""
    shape = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    rings = F.transform(shape.coordinates, lambda ring: F.transform(ring, lambda p: geo.point(p[0], p[1])))
    return F.when(shape.type == "Polygon", rings)
