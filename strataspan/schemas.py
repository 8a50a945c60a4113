"""Schemas of the tables that the library reads, builds and writes."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"

POI = "id long, name string, type string, lon double, lat double"
BOUNDARY = f"id long, name string, level string, ring {RING}, minx double, miny double, maxx double, maxy double"
SCENE = (
    "id string, region string, date string, cloud double, turbidity double, source string, bands array<string>, "
    "bbox array<double>, path string, preview string"
)
CHUNK = "collection string, id string, text string, metadata map<string,string>, embedding array<float>"
PIXEL = "scene_id string, row int, col int, b2 double, b3 double, b4 double, b8 double, b11 double, b12 double"
JOB_EVENT = "job_id long, ts timestamp, status string, done long, total long"
OSM_ELEMENT = (
    "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>, "
    "geometry array<struct<lat:double,lon:double>>, "
    "members array<struct<type:string,ref:long,role:string,geometry:array<struct<lat:double,lon:double>>>>"
)

# Fixed value: band order of a scene; older scenes have the first four.
BANDS = ("B2", "B3", "B4", "B8", "B11", "B12")
