"""The derived inputs in SQL for DuckDB, as common table expressions."""

from __future__ import annotations

from ..sources.tables import OUTLINES

POI = """poi AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type,
  113.7::DOUBLE + (c_custkey * 7919 % 6000)::DOUBLE / 10000.0::DOUBLE AS lon, 22.4::DOUBLE + (c_custkey * 104729 % 4000)::DOUBLE / 10000.0::DOUBLE AS lat FROM customer)"""

_VERTICES = ", ".join(f"({k}, {i}, {u}::DOUBLE, {v}::DOUBLE)" for k, o in enumerate(OUTLINES) for i, (u, v) in enumerate(o))
DISTRICTS = f"""base AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'district' ELSE 'city' END AS level,
  113.7::DOUBLE + (n_nationkey % 5)::DOUBLE * 0.12::DOUBLE AS x0, 22.4::DOUBLE + (n_nationkey // 5)::DOUBLE * 0.08::DOUBLE AS y0, n_nationkey % 3 AS shape FROM nation),
outline(shape, i, u, v) AS (VALUES {_VERTICES}),
vertex AS (SELECT id, name, i, x0 + u * 0.12::DOUBLE AS x, y0 + v * 0.08::DOUBLE AS y FROM base JOIN outline USING (shape)),
edge AS (SELECT * FROM (SELECT id, name, i, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertex WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE x2 IS NOT NULL),
district AS (SELECT id, name, level, x0 AS minx, y0 AS miny, x0 + 1.0::DOUBLE * 0.12::DOUBLE AS maxx, y0 + 1.0::DOUBLE * 0.08::DOUBLE AS maxy FROM base)"""

INSIDE = """inside AS (SELECT p.id AS point_id, e.id AS district_id FROM poi p JOIN edge e ON true GROUP BY p.id, e.id
  HAVING sum(CASE WHEN (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (CASE WHEN e.y1 = e.y2 THEN 1 ELSE e.y2 - e.y1 END) + e.x1 THEN 1 ELSE 0 END) % 2 = 1
  AND NOT bool_or((e.x2 - e.x1) * (p.lat - e.y1) - (e.y2 - e.y1) * (p.lon - e.x1) = 0
    AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)))"""

SCENES = """scene AS (SELECT 'S2_T' || (o_orderkey % 7) || '_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey AS id, 'region' || (o_custkey % 3) AS region,
  o_orderdate AS date, (o_orderkey * 37 % 1000)::DOUBLE / 10.0::DOUBLE AS cloud, w0 AS w, s0 AS s,
  w0 + 0.1::DOUBLE + (o_orderkey * 11 % 30)::DOUBLE / 100.0::DOUBLE AS e, s0 + 0.1::DOUBLE + (o_orderkey * 17 % 20)::DOUBLE / 100.0::DOUBLE AS n,
  CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 4 END AS n_bands, o_orderkey AS ordinal
  FROM (SELECT *, 113.0::DOUBLE + (o_orderkey * 37 % 200)::DOUBLE / 100.0::DOUBLE AS w0, 22.0::DOUBLE + (o_orderkey * 53 % 100)::DOUBLE / 100.0::DOUBLE AS s0 FROM orders))"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
