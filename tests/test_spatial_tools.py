"""The assistant's tools against plain Python over the same tables; wrong calls are answers."""

from __future__ import annotations

import json
import math

import pytest

from strataspan.plans.spatial_tools import Sources, answers, build
from strataspan.queries.rasters import scene
from strataspan.sources.tables import districts, points, register_spatial, scenes


@pytest.fixture(scope="module")
def tools(spark, sf_dir, tmp_path_factory):
    views = register_spatial(spark, sf_dir)

    def pixels(name: str):
        if name not in ("a", "b"):
            raise LookupError(f"no scene {name}")
        return scene(spark, sf_dir, name)

    return build(Sources(spark, points(spark, sf_dir), districts(spark, sf_dir), scenes(spark, sf_dir), pixels, views, str(tmp_path_factory.mktemp("tools"))), most=1000)


def _rows(tools, name, /, **arguments):
    (out,) = answers(tools, [(name, arguments)])
    assert "error" not in out, out
    return out["rows"]


def test_all_have_schemas(tools):
    names = [x["name"] for x in tools.schemas()]
    assert len(names) == 16 and len(set(names)) == 16
    assert all(set(x["parameters"]["required"]) <= set(x["parameters"]["properties"]) for x in tools.schemas())


def test_places(tools):
    assert abs(_rows(tools, "calc_distance", lon1=0, lat1=0, lon2=1, lat2=0)[0]["distance_m"] - 111319.49) < 0.01
    assert abs(_rows(tools, "create_buffer", lon=114, lat=22.5, radius_m=1000)[0]["area_km2"] - math.pi) < 0.01
    assert json.loads(_rows(tools, "buffer_analysis", lon=114, lat=22.5, radius_m=1000)[0]["geojson"])["type"] == "Polygon"
    assert abs(_rows(tools, "transform_coord", lon=180, lat=0, to_epsg=3857)[0]["x"] - 20037508.342789) < 1e-3
    for epsg, east in ((32650, 500000.0), (4548, 500000.0)):
        assert abs(_rows(tools, "coordinate_transform", lon=117, lat=22.5, to_epsg=epsg)[0]["x"] - east) < 1e-3


def test_points_and_tables(tools, spark, sf_dir):
    poi = points(spark, sf_dir).collect()
    kinds = {r["type"]: r["n"] for r in _rows(tools, "data_retrieval")}
    assert sum(kinds.values()) == len(poi) and set(kinds) == {p.type for p in poi}
    near = _rows(tools, "spatial_query", lon=114.0, lat=22.55, radius_m=20000, poi_type="BUILDING")
    assert near == sorted(near, key=lambda r: r["distance_m"]) and {r["type"] for r in near} == {"BUILDING"}
    everywhere = _rows(tools, "spatial_query", lon=114.0, lat=22.55, radius_m=1e6)
    assert len(everywhere) == min(len(poi), 500)
    n = _rows(tools, "spatial_sql", statement="SELECT count(*) AS n FROM poi WHERE type = 'BUILDING'")[0]["n"]
    assert n == kinds["BUILDING"]
    assert json.loads(_rows(tools, "boundary", name="NATION_8")[0]["feature"])["properties"]["name"] == "NATION_8"


def test_geojson(tools, spark):
    box = lambda w, s, e, n: json.dumps({"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]})
    (common,) = _rows(tools, "overlay_analysis", geojson_a=box(0, 0, 2, 2), geojson_b=box(1, 1, 3, 3))
    assert common["area"] == 1.0 and common["holes"] == 0
    assert _rows(tools, "overlay_analysis", geojson_a=box(0, 0, 1, 1), geojson_b=box(2, 2, 3, 3)) == []
    f = lambda g: {"type": "Feature", "geometry": g, "properties": {"type": "x"}}
    many = json.dumps({"features": [f({"type": "Point", "coordinates": [1.5, -2]}), f({"type": "Point", "coordinates": [3, 4e0]}), f(json.loads(box(0, 0, 2, 2)))]})
    got = {r["type"]: (r["n"], r["west"], r["south"], r["east"], r["north"]) for r in _rows(tools, "statistics_calc", geojson=many)}
    assert got == {"Point": (2, 1.5, -2.0, 3.0, 4.0), "Polygon": (1, 0.0, 0.0, 2.0, 2.0)}
    (made,) = answers(tools, [("map_generation", {"geojson": many, "title": "../a b"})])
    assert made["features"] == 3 and ".." not in made["path"]


def test_scenes(tools, spark):
    (row,) = _rows(tools, "temporal_change", scene_a="a", scene_b="b")
    assert row["gain_px"] > 0 and row["loss_px"] == 0 and row["theme"] == "builtup"
    (made,) = answers(tools, [("report", {"title": "Growth", "scene_a": "a", "scene_b": "b"})])
    assert {r.kind for r in spark.read.json(made["report_path"]).collect()} == {"md", "html"} and str(row["gain_px"]) in made["markdown"]
    (style,) = answers(tools, [("text_to_map", {"theme": "poi", "region": "NATION_8", "types": "BUILDING"})])
    drawn = [json.loads(r.value)["properties"]["class"] for r in spark.read.text(style["sources"]["t2m-poi-pts-src"]["data"]).collect()]
    assert set(drawn) <= {"BUILDING"} and style["layer_ids"][-1] == "t2m-poi-points"
    by_name, by_box, nowhere = answers(tools, [("data_inventory", {"region": "NATION_8"}), ("data_inventory", {"bbox": "113.5,22.5,113.6,22.6"}), ("data_inventory", {"region": "?"})])
    assert by_name["coverage"] in ("full", "partial", "none") and by_box["scenes"] and nowhere["coverage"] == "none"


WRONG = [
    ("nothing", {}), ("calc_distance", {"lon1": 0}), ("create_buffer", {"lon": 0, "lat": 0, "radius_m": -1}), ("transform_coord", {"lon": 0, "lat": 0, "to_epsg": 1}),
    ("data_retrieval", {"dataset_name": "x"}), ("overlay_analysis", {"geojson_a": "{", "geojson_b": "{}"}), ("spatial_sql", {"statement": "DROP TABLE poi"}),
    ("temporal_change", {"scene_a": "a", "scene_b": "zz"}), ("temporal_change", {"scene_a": "a", "scene_b": "b", "theme": "x"}), ("text_to_map", {"theme": "poi", "region": "nowhere"}), ("data_inventory", {"bbox": "1,2"}),
]


@pytest.mark.parametrize(("name", "arguments"), WRONG)
def test_wrong_calls_are_answers(tools, name, arguments):
    assert "error" in answers(tools, [(name, arguments)])[0]
