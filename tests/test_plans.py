"""The SQL door, intents, reports, streams, files, stores and shapes."""

from __future__ import annotations

import hashlib
import json
import random
import tempfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspan.functions import geo, raster, symbology, text
from strataspan.operators import cartography, patches, retrieval, spatial_join
from strataspan.plans import intents, report, safe_sql
from strataspan.queries.spatial import QUERIES as QUERIES_SPATIAL
from strataspan.queries.texts import QUERIES
from strataspan.sources import files
from strataspan.sources.tables import districts, load, points, register, safe_path
from strataspan.sources.vector_store import VectorStore
from strataspan.streaming import jobs

TABLES = ["nation", "region", "customer"]
BAD = [
    "DROP TABLE nation", "SELECT * FROM nation; DELETE FROM nation", "INSERT INTO nation SELECT * FROM nation", "SELECT * FROM secret", "UPDATE nation SET n_name = 'x'",
    "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('java.lang.Runtime', 'getRuntime') FROM nation", "CREATE VIEW v AS SELECT 1",
    'SELECT * FROM nation, `secret`', "SELECT * FROM nation n, secret s", "SELECT * FROM other.nation", "SELECT (SELECT max(x) FROM secret) FROM nation",
    "WITH nation2 AS (SELECT * FROM secret) SELECT * FROM nation2", "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM secret)", "SELECT * FROM parquet.`/etc`", "SET x = 1",
    "SELECT * FROM range(10)", "", "SHOW TABLES",
]


@pytest.mark.parametrize("sql", BAD)
def test_door_rejects(spark, sql):
    with pytest.raises(safe_sql.Rejected):
        safe_sql.check(spark, sql, TABLES)


def test_door_opens(spark, sf_dir):
    register(spark, sf_dir)
    good = [
        "SELECT n_name FROM nation -- LIMIT 5", "select count(*) as n from NATION n join region r on n.n_regionkey = r.r_regionkey;",
        "WITH a AS (SELECT * FROM nation) SELECT extract(YEAR FROM date '2024-01-01') AS y, n_name FROM a ORDER BY n_name LIMIT 3",
        "SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation UNION ALL SELECT r_name, 0 FROM region",
    ]
    for sql in good:
        assert safe_sql.run(spark, sql, TABLES).count() > 0
    assert safe_sql.run(spark, "SELECT * FROM customer LIMIT 1000000", TABLES, 7).count() == 7
    assert safe_sql.answer(spark, "SELECT * FROM secret", TABLES)["error"]


def test_intents():
    assert intents.parse("compare water of 2019 and 2023") == intents.Intent("change", "water", [2019, 2023])
    assert intents.parse("what is within 2 km of 114.05,22.54").metres == 2000
    assert intents.parse(" ").kind == "error" and intents.parse("list all").kind == "query"
    intents.check_themes()
    intents.MapIntent("poi", "here", ["park"], ["park"]).check()
    for bad in (("x", "here", [], []), ("poi", "", [], []), ("poi", "h", ["x"], []), ("poi", "h", [], ["park"])):
        with pytest.raises(ValueError):
            intents.MapIntent(*bad).check()


def test_report(spark):
    row = spark.createDataFrame([(0.119, 0.8, -0.66, 0.4)], "change_ratio double, valid_pct double, net_km2 double, patch_keep_ratio double")
    assert tuple(report.in_words(row).first()) == ("减少", "显著", "较高", "中等", "中")
    md, html = report.change_report("T", row)
    assert "11.9%" in md and "11.9%" in html
    assert report.in_words(row.drop("net_km2", "patch_keep_ratio")).first().area is None


def test_themes():
    raster.check_themes()
    with pytest.raises(ValueError):
        raster.check_themes({"a": {"exclude": ["b"]}, "b": {"exclude": ["a"]}})
    with pytest.raises(ValueError):
        raster.theme("unknown")


def test_symbology(spark):
    rows = [(i % 10, float(i) / 99, i % 2 == 0, float(i - 50), None if i else float("nan")) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v double, b boolean, d double, none double")
    found = symbology.profiles(df, ["k", "v", "b", "d", "none"], {"k": ["水", "城市"], "v": ["植被"]})
    plans = {r.col: r for r in symbology.plans(found).collect()}
    assert {c: r.palette for c, r in plans.items()} == {"k": "Set2+semantic", "v": "Greens", "b": "semantic(binary)", "d": "RdBu"}
    assert len(plans["k"].colors) == 10 and plans["k"].colors[:3] == ["#3787C0", "#8C8C8C", "#66C2A5"]
    said = {r.col: json.loads(r.style)["fill-color"] for r in symbology.styles(symbology.plans(found)).collect()}
    assert said["k"][:4] == ["match", ["get", "k"], 0, "#3787C0"] and said["k"][-1] == "#CCCCCC"
    assert said["b"] == ["match", ["get", "b"], False, "rgba(0,0,0,0.000)", True, "#E24B4A", "#CCCCCC"]
    assert said["v"][:3] == ["interpolate", ["linear"], ["get", "v"]] and said["v"][-2:] == [1.0, "#006d2c"]
    half = spark.range(1).select(symbology.blend(F.array(F.lit("#000000"), F.lit("#ffffff")), F.lit(0.5)).alias("c")).first().c
    assert half == "#808080"


def test_geodesic_and_projection(spark):
    # published test line of the inverse problem, and a published transverse mercator point
    d = geo.geodesic_m(F.lit(144.42486788), F.lit(-37.95103342), F.lit(143.92649552), F.lit(-37.65282114))
    row = spark.range(1).select(d.alias("d"), geo.geodesic_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("zero"), geo.utm(F.lit(3.0), F.lit(45.0)).alias("u")).first()
    assert abs(row.d - 54972.271) < 1e-3 and row.zero == 0
    assert abs(row.u.x - 500000) < 1e-6 and abs(row.u.y - 4982950.400) < 1e-2


def test_clip_and_buffer(spark):
    tri = F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0))])
    box = geo.box_ring(*[F.lit(v) for v in (1.0, 1.0, 5.0, 5.0)])
    far = geo.box_ring(*[F.lit(v) for v in (9.0, 9.0, 10.0, 10.0)])
    row = spark.range(1).select(geo.area(geo.clip_convex(tri, box)).alias("a"), F.size(geo.clip_convex(tri, far)).alias("none"), geo.metric_buffer(F.lit(114.0), F.lit(22.5), F.lit(1000.0)).alias("b")).first()
    assert abs(row.a - 2.0) < 1e-12 and row.none == 0 and len(row.b) == 257 and abs(row.b[0]["x"] - row.b[256]["x"]) < 1e-12
    assert abs((max(p["y"] for p in row.b) - min(p["y"] for p in row.b)) * 110.7 - 2.0) < 0.02


def test_join_equals_cross_product(spark, sf_dir):
    p, d = points(spark, sf_dir), districts(spark, sf_dir)
    plain = p.crossJoin(d.select(F.col("id").alias("polygon_id"), "ring")).filter(geo.within(F.col("lon"), F.col("lat"), F.col("ring"))).select(F.col("id").alias("point_id"), "polygon_id")
    for size in (0.02, 0.5):
        cells = spatial_join.points_in_polygons(p, d, size).select("point_id", "polygon_id")
        assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, plain.collect()))


def test_distance_join_across_antimeridian_and_poles(spark):
    rng = random.Random(9)
    spots = [(179.99, 10.0), (-179.995, 10.01), (0.0, 89.95), (180.0, 89.96), (90.0, 90.0), (-60.0, -89.99), (120.0, -89.98), (12.0, 89.5), (14.0, 89.5)]
    spots += [(rng.uniform(179.8, 180.2), rng.uniform(60, 61)) for _ in range(60)]
    p = spark.createDataFrame([(i, (x + 180) % 360 - 180, y) for i, (x, y) in enumerate(spots)], "id long, lon double, lat double")
    q = p.select(F.col("id").alias("right_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    m = geo.geodesic_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    every = {(r[0], r[1]): r[2] for r in p.crossJoin(q).select("id", "right_id", m).collect()}
    for radius in (5_000.0, 20_000.0):
        got = {(r.left_id, r.right_id): r.distance_m for r in spatial_join.within_distance(p, p, radius).collect()}
        assert got == {k: v for k, v in every.items() if v <= radius} and len(got) > len(spots)
        near = {r.id for r in spatial_join.nearby(p.withColumns({"name": F.lit("n"), "type": F.lit("t")}), 179.999, 10.0, radius).collect()}
        assert near == {0, 1}


def test_clipped_districts(spark, sf_dir):
    """g5 against cutting each ring by the box's four sides."""
    west, south, east, north = 113.76, 22.44, 114.0, 22.6
    sides = [(1, 0, west), (-1, 0, -east), (0, 1, south), (0, -1, -north)]
    for r in QUERIES_SPATIAL["g5_intersection"][0](spark, sf_dir).join(districts(spark, sf_dir), "id").collect():
        ring = [(p.x, p.y) for p in r.ring[:-1]]
        for a, b, c in sides:
            cut = []
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                d1, d2 = a * x1 + b * y1 - c, a * x2 + b * y2 - c
                cut += [(x1, y1)] if d1 >= 0 else []
                cut += [(x1 + (x2 - x1) * d1 / (d1 - d2), y1 + (y2 - y1) * d1 / (d1 - d2))] if d1 * d2 < 0 else []
            ring = cut
        area = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        assert abs(r.area - area) < 2e-8, r.id


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n。，", max_size=900))
def test_chunks(t):
    parts = text.pieces(t.strip(), 300)
    assert all(0 < len(p) <= 300 for p in parts)
    made = text.chunk_texts(t)
    assert all(len(c) <= 360 for _, c in made)
    assert "".join(c for c in t if c in "ab") == "".join(c for p in parts for c in p if c in "ab")


def plain_chunks(t, size=300, overlap=60):
    """The stated behaviour by recursion over strings."""

    def cut(part, level):
        if len(part) <= size:
            return [part] if part else []
        if level == len(text.SEPARATORS):
            return [part[:size], *cut(part[size:], level)]
        sep, rows = text.SEPARATORS[level], []
        if sep not in part:
            return cut(part, level + 1)
        for small in (q for p in part.split(sep) for q in cut(p, level + 1)):
            if rows and len(rows[-1] + sep + small) <= size:
                rows[-1] += sep + small
            else:
                rows.append(small)
        return rows

    out = []
    for p in cut((t or "").strip(), 0):
        out.append((out[-1] if out else "")[-overlap:] + p)
    return [(i, c) for i, c in enumerate(out) if c.strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a \n。，", max_size=120), st.integers(3, 12), st.integers(1, 5))
def test_chunks_like_recursion(t, size, overlap):
    assert text.chunk_texts(t, size, overlap) == plain_chunks(t, size, overlap)


def test_chunk_queries(spark, sf_dir):
    """The queries without SQL over whole tables against the plain version."""
    docs = load(spark, sf_dir, "documents").collect()
    want = sorted((r.doc_id, i, c) for r in docs for i, c in plain_chunks(r.text))
    assert sorted(map(tuple, QUERIES["x8_chunks"][0](spark, sf_dir).collect())) == want
    index = {(r.id, r.n, r.md5) for r in QUERIES["x9_chunk_index"][0](spark, sf_dir).collect()}
    assert index == {(f"{d}_{i}", len(c), hashlib.md5(c.encode()).hexdigest()) for d, i, c in want}


def test_chunk_edges():
    assert text.chunk_texts("x" * 300) == [(0, "x" * 300)]
    assert [len(c) for _, c in text.chunk_texts("x" * 301)] == [300, 61]
    assert text.chunk_texts(None) == [] and text.chunk_texts(" \n ") == []
    two = text.chunk_texts("a" * 200 + "。" + "b" * 200)
    assert two[1][1] == "a" * 60 + "b" * 200


def test_patches_across_blocks(spark):
    snake = [(r, c) for r in range(0, 40, 2) for c in range(20)] + [(r, 19 if r % 4 == 1 else 0) for r in range(1, 39, 2)]
    lone = [(100, 100), (101, 101), (50, 5)]
    mask = spark.createDataFrame([(1, r, c) for r, c in snake + lone], "k int, row int, col int")
    for block in (4, 7, 256):
        got = patches.label_patches(mask, ["k"], block)
        sizes = sorted(got.groupBy("patch").count().select("count").toPandas()["count"])
        assert sizes == [1, 1, 1, len(set(snake))]
    assert patches.keep_large(mask, ["k"], 2, 8).count() == len(set(snake))
    hole = spark.createDataFrame([(1, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "k int, row int, col int")
    out = patches.outlines(patches.keep_large(hole, ["k"], 1, 8), ["k"]).first()
    assert out.px == 8 and sorted(len(r) for r in out.rings) == [5, 5]


def test_labels_dont_collide(spark):
    rows = [("v", f"n{i}", 0.0, 0.0, i, 0.0) for i in range(9)] + [("v", "far", 1e6, 0.0, 1, 0.0), ("v", "", 5e5, 0.0, 0, 0.0)]
    f = spark.createDataFrame(rows, "view string, name string, x double, y double, priority int, area double")
    got = cartography.place_labels(f, ["view"], 10.0).collect()
    assert 2 <= len(got) < 10 and "far" in {r.name for r in got}
    for i, a in enumerate(got):
        for b in got[:i]:
            assert not _meet(a[5:], b[5:])


def _meet(a, b):
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def test_labels_like_one_after_the_other(spark):
    """Random points of two views against placing labels in order, one by one."""
    rng = random.Random(2)
    rows = [(v, "n" * rng.randrange(8), rng.randrange(900) / 3, rng.randrange(300) / 3, rng.randrange(3), float(rng.randrange(3))) for v in "ab" for _ in range(60)]
    got = cartography.place_labels(spark.createDataFrame(rows, "view string, name string, x double, y double, priority int, area double"), ["view"], 1.0)
    want, c = [], cartography
    for v in "ab":
        mine = {r[1:] for r in rows if r[0] == v}
        taken = [(x - c.MARKER, y - c.MARKER, x + c.MARKER, y + c.MARKER) for _, x, y, _, _ in mine]
        for name, x, y, _, _ in sorted(mine, key=lambda r: (r[3], -r[4], r[0], r[1], r[2])):
            w, h = len(name) * c.CHAR_W, c.LINE_H
            for side, dx, dy in c.SIDES if name else []:
                x0, y0 = x + {1: c.GAP, -1: -c.GAP - w, 0: -w / 2}[dx], y + {1: c.GAP, -1: -c.GAP - h, 0: -h / 2}[dy]
                if not any(_meet((x0, y0, x0 + w, y0 + h), t) for t in taken):
                    taken.append((x0, y0, x0 + w, y0 + h))
                    want.append((v, name, x, y, side))
                    break
    assert sorted(tuple(r[:5]) for r in got.collect()) == sorted(want) and len(want) > 30


def test_simplify_and_rings(spark):
    circle = [(float(x), float(y)) for x, y in [(i, (i % 2) * 0.01) for i in range(50)]]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in circle], 0.1), (2, None, 0.1)], f"id int, ring {geo_ring()}, tol double")
    sizes = {r.id: r.ring and len(r.ring) for r in cartography.simplify(df, "ring", "tol").collect()}
    assert sizes == {1: 2, 2: None}
    parts = [[(0, 0), (4, 0)], [(4, 4), (4, 0)], [(4, 4), (0, 4), (0, 0)], [(9, 9), (8, 8)]]
    lines = spark.createDataFrame([(7, [{"x": float(x), "y": float(y)} for x, y in p]) for p in parts], f"k int, line {geo_ring()}")
    out = cartography.assemble_rings(lines, "k").select(geo.area(F.col("ring")).alias("a")).collect()
    assert [r.a for r in out] == [16.0]


def geo_ring():
    from strataspan.schemas import RING

    return RING


def test_vector_store(spark):
    store = VectorStore(spark, tempfile.mkdtemp(prefix="spark-") + "/store")
    schema = "id string, text string, metadata map<string,string>, embedding array<float>"
    store.upsert("c", spark.createDataFrame([("a", "one", {"k": "1"}, [1.0, 0.0]), ("b", "two", {"k": "2"}, [0.0, 1.0])], schema))
    store.upsert("c", spark.createDataFrame([("a", "new", {"k": "1"}, [0.6, 0.8])], schema))
    store.upsert("d", spark.createDataFrame([("a", "other", {"k": "1"}, [1.0, 0.0])], schema))
    assert store.count("c") == 2 and store.documents("c").first().text == "new"
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, embedding array<float>")
    assert [r.id for r in store.search("c", q, 5).orderBy("rank").collect()] == ["b", "a"]
    assert [r.id for r in store.search("c", q, 5, {"k": "1"}).collect()] == ["a"]
    folded = store.compact(tempfile.mkdtemp(prefix="spark-") + "/folded")
    store.reset("c")
    assert store.count("c") == 0 and store.count("d") == 1 and folded.count("c") == 2


def test_fusion_ignores_list_order(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)]
    df = spark.createDataFrame(rows, "query_id int, list_no int, id string, rank int")
    got = [r.id for r in retrieval.fuse(df, 3).orderBy("rank").collect()]
    assert got == ["b", "a", "c"]
    swapped = df.withColumn("list_no", 1 - F.col("list_no"))
    assert [r.id for r in retrieval.fuse(swapped, 3).orderBy("rank").collect()][0] == "b"
    truth = spark.createDataFrame([(1, ["a"]), (2, [])], "query_id int, relevant array<string>")
    m = retrieval.evaluate(retrieval.fuse(df, 3), truth, 1).first()
    assert (m.hit_rate, m.recall, m.mrr) == (0.0, 0.0, 0.25)


def test_files(spark, tmp_path):
    manifest = [{"id": "s1", "date": "2023-07-08", "cloud": 1.5, "bbox": [1, 2, 3, 4], "bands": ["B2"], "path": "p"}, {"id": "s2", "date": "20250727", "region": "r", "bbox": [1, 2, 3, 4]}]
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    rows = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert {r.id: (r.region, r.cloud) for r in rows.collect()} == {"s1": ("szbay", 1.5), "s2": ("r", 0.0)}
    assert files.write_catalog(rows, str(tmp_path / "catalog")) == 2
    poly = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}
    multi = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[0, 0], [3, 0], [3, 3], [0, 0]]]]}
    fs = [{"properties": {"name": "p"}, "geometry": poly}, {"properties": {"name": "m"}, "geometry": multi}, {"properties": {}, "geometry": poly}]
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    b = files.read_boundaries(spark, str(tmp_path / "b.json"), "city")
    assert {r.name: r.maxx for r in b.collect()} == {"p": 2.0, "m": 3.0}
    shown = b.select(files.feature(files.polygon_geometry(F.col("ring")), name=F.col("name")).alias("feature"))
    assert len(json.loads(files.collection(shown))["features"]) == 2
    with pytest.raises(ValueError):
        files.collection(shown, 1)
    ways = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "n", "amenity": "school"}}, {"type": "way", "id": 2, "tags": {"name": "w", "leisure": "park"}, "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]}]}
    (tmp_path / "o.json").write_text(json.dumps(ways))
    got = {r.id: (r.kind, r["class"]) for r in files.typed_elements(files.read_elements(spark, str(tmp_path / "o.json"))).collect()}
    assert got == {1: ("point", "school"), 2: ("polygon", "park")}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("intro\n## Title\nbody")
    (tmp_path / "docs" / "b.html").write_text("<p>x</p><script>no()</script><b>y &amp; z</b>")
    docs = {r.title: r.text for r in files.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert docs["b"] == "x\ny & z" and "Title" in docs
    with pytest.raises(ValueError):
        safe_path("/data", "../etc/x.json")
    assert safe_path("/data", "a/b.json") == "/data/a/b.json"


def test_streams(spark, sf_dir, tmp_path):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:03"])
    rows = pd.DataFrame({"job_id": [1, 1, 1, 2], "ts": ts, "status": ["queued", "running", "done", "done"], "done": [0, 1, 4, 0], "total": [4, 4, 4, 0]})
    frame = spark.createDataFrame(rows)
    frame.write.parquet(str(tmp_path / "jobs"))
    assert {r.job_id: (r.status, r.progress) for r in jobs.latest_state(frame).collect()} == {1: ("done", 1.0), 2: ("done", 0.0)}
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "jobs"))
    for name, df, mode in (("latest", jobs.latest_state(stream), "update"), ("life", jobs.lifecycle(stream), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {r.job_id: r.status for r in spark.table("latest").collect()} == {1: "done", 2: "done"}
    assert {r.job_id: (r.status, r.steps, r.refused) for r in spark.table("life").collect()} == {1: ("done", 3, 0), 2: ("", 0, 1)}

    load(spark, sf_dir, "events").repartition(1).write.parquet(str(tmp_path / "events"))
    live = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(str(tmp_path / "events"))
    for name, df in (("hours", jobs.windowed(live, "1 hour")), ("visits", jobs.sessions(live, "30 minutes"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert 0 < spark.table(name).agg(F.sum("n")).first()[0] <= load(spark, sf_dir, "events").count()


def test_server_sent_events(spark):
    said = "event: status\ndata: {\"a\":1}\n\ndata: x\ndata: y\n\nbroken\n\nevent: done\r\ndata:z\r\n\r\n"
    t = spark.createDataFrame([(1, said)], "k int, text string")
    got = [(r.event, r.data) for r in jobs.sse_frames(t, "k").orderBy("no").collect()]
    assert got == [("status", '{"a":1}'), ("message", "x\ny"), ("done", "z")]
    back = jobs.sse_text(jobs.sse_frames(t, "k").orderBy("no")).collect()
    assert back[1].value == "event: message\ndata: x\ndata: y\n\n"
