"""Queries of retrieval, text, symbology and cartography, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, sql_functions, symbology, text
from ..operators import cartography, retrieval
from ..sources.tables import districts, load, points, scenes
from ..sources.text_index import TextIndex
from ..sources.vector_index import VectorIndex
from ..storage import materialise, shared_folder
from .ddb import POI, SCENES, with_


ASKED = "{} % 50 = 0"  # the rows that are asked for, against all rows


def _asked(spark, d):
    return load(spark, d, "benchmark").filter(ASKED.format("item_id")).select(F.col("item_id").alias("query_id"), "text")


def x5_bm25(spark, d):
    out = retrieval.bm25(load(spark, d, "documents").select("doc_id", "text"), _asked(spark, d), 5)
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def x5_indexed(spark, d):
    """The same from a stored index: every second document is added with another text first and then replaced, every fifth is deleted and added again."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}")
    index.add(docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text")))
    index.delete(docs.filter("doc_id % 5 = 0"))
    index.add(docs.filter("doc_id % 2 = 0 or doc_id % 5 = 0"))
    return index.search(_asked(spark, d), 5).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def x9_chunk_search(spark, d):
    """Documents to chunks, chunks to an index, and its five best chunks for each asked text."""
    index = TextIndex(spark, f"{shared_folder(spark)}/chunk-index-{uuid.uuid4().hex}", "string")
    index.add(text.chunks(load(spark, d, "documents"), "doc_id").select(F.concat_ws("_", "doc_id", "index").alias("doc_id"), F.col("chunk").alias("text")))
    return index.search(_asked(spark, d), 5).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def _vectors(spark, d):
    e = load(spark, d, "embeddings")
    return e, e.filter(ASKED.format("vec_id")).select(F.col("vec_id").alias("query_id"), "embedding")


def x2_vector_top(spark, d):
    e, q = _vectors(spark, d)
    return retrieval.vector_search(e, q, 5).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


def x4_approximate(spark, d):
    """How many of the five exact neighbours of every query the index finds (at least 0.9)."""
    e, q = _vectors(spark, d)
    index = VectorIndex(spark, f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}")
    index.build(e)
    exact = retrieval.vector_search(e, q, 5).select("query_id", "vec_id")
    found = index.search(q, 5).select("query_id", "vec_id", F.lit(1).alias("hit"))
    share = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("n"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("share"))
    return share.select("n", (F.col("share") >= 0.9).alias("enough"))


def x4_all_cells(spark, d):
    """With all cells the index is exact."""
    e, q = _vectors(spark, d)
    index = VectorIndex(spark, f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}")
    index.build(e)
    return index.search(q, 5, 1_000_000).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


def x3_filtered_search(spark, d):
    e, q = _vectors(spark, d)
    return retrieval.vector_search(e, q, 3, F.col("label") == 3).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


def _two_lists(spark, d):
    e, q = _vectors(spark, d)
    a = retrieval.vector_search(e, q, 10).select("query_id", F.lit(0).alias("list_no"), F.col("vec_id").alias("id"), "rank")
    b = retrieval.vector_search(e, q, 10, F.col("label") % 2 == 0).select("query_id", F.lit(1).alias("list_no"), F.col("vec_id").alias("id"), "rank")
    return a, b


def x6_x7_fusion(spark, d):
    a, b = _two_lists(spark, d)
    return retrieval.fuse(a.unionByName(b), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def x10_evaluate(spark, d):
    """Neighbours of a vector against the vectors of its label, at three depths."""
    e, q = _vectors(spark, d)
    found = materialise(retrieval.vector_search(e, q, 8).select("query_id", "vec_id", "rank"), "evaluate-found")
    labels = e.select("vec_id", "label")
    asked = q.select(F.col("query_id").alias("vec_id")).join(labels, "vec_id").select(F.col("vec_id").alias("query_id"), "label")
    sizes = asked.join(labels.groupBy("label").agg(F.count_distinct("vec_id").cast("int").alias("n")), "label")
    hits = found.join(labels, "vec_id").join(asked, ["query_id", "label"])
    out = None
    for k in (1, 3, 8):
        row = retrieval.measures(hits, sizes, k).select(F.lit(k).alias("k"), *[F.round(c, 6).alias(c) for c in ("hit_rate", "recall", "mrr")])
        out = row if out is None else out.unionByName(row)
    return out


def x11_shared_characters(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", retrieval.shared_characters(F.col("p_name"), F.lit("red widget")).alias("n"))


def x12_pca(spark, d):
    """Two principal components; their signs are free, so their squares are given."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = load(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e)
    return out.select("vec_id", *[F.round(F.pow(vector_to_array("p")[i], 2), 6).alias(f"p{i}") for i in range(2)])


def x13_context(spark, d):
    rows = load(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.context(rows)


def x15_agreement(spark, d):
    a, b = _two_lists(spark, d)
    return retrieval.agreement(a, b).select("query_id", F.round("common", 6).alias("common"))


def a21_document_frequency(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("t"))
    return docs.groupBy("t").agg(F.count("*").alias("df"))


def a22_lengths(spark, d):
    n = F.size(text.tokens(F.col("text")))
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("words"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean"))


def f1_tokens(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


def f3_embedded_json(spark, d):
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("answer "), "props", F.lit(" end"))).alias("said"))
    return e.select("event_id", text.embedded_json(F.col("said")).alias("json"))


def f2_clean_sql(spark, d):
    e = load(spark, d, "part").select("p_partkey", F.concat(F.lit("```sql\nSELECT "), F.col("p_partkey").cast("string"), F.lit(";\n```")).alias("said"))
    return e.select("p_partkey", text.clean_sql(F.col("said")).alias("statement"))


def f4_name_date(spark, d):
    return scenes(spark, d).select("id", text.name_date(F.col("id")).alias("day"))


def f6_years(spark, d):
    s = scenes(spark, d).select("id", F.concat(F.lit("compare 2019 with "), F.year("date").cast("string"), F.lit(", 12345 and 2019")).alias("q"))
    return s.select("id", F.array_join(text.years(F.col("q")), ",").alias("years"))


def f7_heading(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("x\n## "), F.coalesce("text", F.lit("")), F.lit(" \ny")).alias("md"))
    return c.select("conv_id", "turn", text.first_heading(F.col("md"), F.lit("none")).alias("title"))


def s31_html_text(spark, d):
    t = text.html_text(F.col("html"))
    return load(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("md5"))


def x8_chunks(spark, d):
    return text.chunks(load(spark, d, "documents"), "doc_id")


def u8_chunks_in_sql(spark, d):
    """Chunks in a FROM clause: how many each document has, and how long they are."""
    sql_functions.register(spark)
    load(spark, d, "documents").createOrReplaceTempView("chunked_documents")
    return spark.sql("SELECT d.doc_id, count(*) AS n, sum(length(c.chunk)) AS chars FROM chunked_documents d, LATERAL chunks_of(d.text) c GROUP BY d.doc_id")


def u7_fusion_in_sql(spark, d):
    """Rank fusion as a sum in SQL."""
    sql_functions.register(spark)
    a, b = _two_lists(spark, d)
    a.unionByName(b).createOrReplaceTempView("ranked_lists")
    return spark.sql("SELECT query_id, id, round(sum(fusion_weight(rank)), 6) AS score FROM ranked_lists GROUP BY query_id, id")


def x9_chunk_index(spark, d):
    """Chunks of all documents as a collection's rows."""
    c = text.chunks(load(spark, d, "documents"), "doc_id")
    return c.select(F.concat_ws("_", "doc_id", "index").alias("id"), F.length("chunk").alias("n"), F.md5("chunk").alias("md5"))


def f14_bands(spark, d):
    p = load(spark, d, "lineitem")
    ratio = F.col("l_discount")
    return p.groupBy(symbology.band(ratio, symbology.RATIO_BANDS).alias("size")).agg(F.count("*").alias("n"))


def f15_colors(spark, d):
    """Every customer's colour (each palette by nation, in turn) as channels, counted."""
    c = spark.createDataFrame([(k, i, len(v), x) for k, v in symbology.PALETTES.items() for i, x in enumerate(v)], "palette string, i int, size int, color string")
    painted = load(spark, d, "customer").join(F.broadcast(c), F.col("c_nationkey") % F.col("size") == F.col("i"))  # a fixed list of colours
    return painted.groupBy("palette", *[symbology.channel(F.col("color"), k).alias(n) for k, n in enumerate("rgb")]).agg(F.count("*").alias("n"))


PROFILED = [("part", "p_size"), ("labels", "quality"), ("customer", "c_acctbal"), ("lineitem", "l_tax"), ("nation", "n_regionkey")]


def _plans(spark, d):
    each = [symbology.profiles(load(spark, d, t), [c], {"quality": ["水", "城市"], "n_regionkey": ["水"], "l_tax": ["植被"]}) for t, c in PROFILED]
    return symbology.plans(reduce(DataFrame.unionByName, each))


def m1_profiles(spark, d):
    """Kind and palette of some columns, decided from their values."""
    return _plans(spark, d).select("col", "kind", "palette", F.size("classes").alias("n_classes"))


def m3_styles(spark, d):
    """Their style expressions."""
    return symbology.styles(_plans(spark, d))


def m4_generalise(spark, d):
    ring = F.transform("ring", lambda p: geo.point(geo.mercator_x(p.x), geo.mercator_y(p.y)))
    shapes = districts(spark, d).select("id", ring.alias("ring"))
    return cartography.generalise(shapes, 8.0, 22.5).select("id", F.size("ring").alias("n"))


def m5_labels(spark, d):
    """Labels of points in map tiles of zoom 11."""
    p = points(spark, d)
    f = p.select(
        geo.tile_x(F.col("lon"), 11).alias("tx"), geo.tile_y(F.col("lat"), 11).alias("ty"), "name",
        geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"), F.when(F.col("type") == "BUILDING", 0).otherwise(1).alias("priority"), F.lit(0.0).alias("area"),
    )
    return cartography.place_labels(f, ["tx", "ty"], geo.METRES_PER_PIXEL_Z0 / 2**11).select("tx", "ty", "name", "side")


def m9_projection(spark, d):
    """Words instead of numbers for a change report."""
    o = load(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100).cast("double") / 1000.0).alias("ratio"), ((F.col("o_orderkey") % 70).cast("double") / 10.0 - 3.0).alias("net"))
    word = F.when(F.col("net") >= 0, "增加").otherwise("减少")
    return o.groupBy(word.alias("direction"), symbology.band(F.col("ratio"), symbology.RATIO_BANDS).alias("magnitude"), symbology.band(F.abs("net"), symbology.AREA_BANDS).alias("area")).agg(F.count("*").alias("n"))


_TOKENS = "list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), regexp_extract_all(coalesce(text, ''), '[一-鿿]'))"
_BM25 = f"""w AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), dl AS (SELECT doc_id, len(ts) AS l FROM w), tot AS (SELECT count(*) AS n, avg(l) AS al FROM dl),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM w) GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS t FROM benchmark WHERE item_id % 50 = 0) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))) AS s FROM q JOIN df USING (t) JOIN tf USING (t) JOIN dl USING (doc_id), tot GROUP BY 1, 2)"""
_DOT = "(SELECT a.vec_id AS query_id, b.vec_id, b.label, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"


def _top(k: int, where: str = "true") -> str:
    return f"SELECT query_id, vec_id, s, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM {_DOT} WHERE {where}) WHERE rank <= {k}"


_LISTS = f"a AS ({_top(10)}), b AS ({_top(10, 'label % 2 = 0')}), l AS (SELECT query_id, 0 AS no, vec_id AS id, rank FROM a UNION ALL SELECT query_id, 1, vec_id, rank FROM b)"
_HTML = r"""regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->|<![^>]*>|<[^>]*>', chr(1), 'g')"""
_UNESCAPED = "replace(replace(replace(replace(replace(replace(p, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"

_COLORS = ", ".join(f"('{k}', {i}, {len(cs)}, '{c}')" for k, cs in symbology.PALETTES.items() for i, c in enumerate(cs))
_CHANNELS = ", ".join(f"CAST(('0x' || substr(color, {2 + 2 * k}, 2)) AS INTEGER) AS {n}" for k, n in enumerate("rgb"))
_KIND = "CASE WHEN n <= 10 AND whole THEN 'categorical' WHEN lo < 0 AND hi > 0 THEN 'diverging' ELSE 'sequential' END"
_RANGES = " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n, min({c}) AS lo, max({c}) AS hi, bool_and(typeof({c}) IN ('INTEGER', 'BIGINT', 'SMALLINT', 'TINYINT')) AS whole FROM {t}" for t, c in PROFILED
)
_PROFILES = f"""SELECT col, kind, CASE kind WHEN 'diverging' THEN 'RdBu' WHEN 'sequential' THEN CASE col WHEN 'l_tax' THEN 'Greens' ELSE 'YlGnBu' END ELSE CASE col WHEN 'quality' THEN 'semantic' WHEN 'n_regionkey' THEN 'Set2+semantic' ELSE 'Set2' END END AS palette,
CAST(CASE kind WHEN 'categorical' THEN n ELSE 0 END AS INTEGER) AS n_classes FROM (SELECT *, {_KIND} AS kind FROM ({_RANGES}))"""

QUERIES = {
    "x5_bm25": (x5_bm25, f"WITH {_BM25} SELECT query_id, doc_id, round(s, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM sc WHERE s > 0) WHERE rank <= 5"),
    "x5_indexed": (x5_indexed, f"WITH {_BM25} SELECT query_id, doc_id, round(s, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM sc WHERE s > 0) WHERE rank <= 5"),
    "x2_vector_top": (x2_vector_top, f"SELECT query_id, vec_id, round(s, 4) AS score, rank FROM ({_top(5)})"),
    "x4_all_cells": (x4_all_cells, f"SELECT query_id, vec_id, round(s, 4) AS score, rank FROM ({_top(5)})"),
    "x4_approximate": (x4_approximate, "SELECT 5 * count(*) AS n, true AS enough FROM embeddings WHERE vec_id % 50 = 0"),
    "x3_filtered_search": (x3_filtered_search, f"SELECT query_id, vec_id, round(s, 4) AS score, rank FROM ({_top(3, 'label = 3')})"),
    "x6_x7_fusion": (x6_x7_fusion, f"WITH {_LISTS}, f AS (SELECT query_id, id, sum(1 / (60 + rank)::DOUBLE) AS s, min((no, rank)) AS seen FROM l GROUP BY 1, 2) SELECT query_id, id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, seen) AS rank FROM f) WHERE rank <= 5"),
    "x10_evaluate": (x10_evaluate, f"WITH r AS ({_top(8)}), t AS (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0), n AS (SELECT query_id, count(vec_id) AS n FROM t GROUP BY 1), h AS (SELECT query_id, rank FROM r JOIN t USING (query_id, vec_id)) SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN c > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(c / nullif(n, 0), 0)), 6) AS recall, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM (SELECT k, n.query_id, n, count(rank) FILTER (WHERE rank <= k) AS c, min(rank) AS f FROM n CROSS JOIN (VALUES (1), (3), (8)) AS v(k) LEFT JOIN h USING (query_id) GROUP BY 1, 2, 3) GROUP BY k"),
    "x11_shared_characters": (x11_shared_characters, "SELECT p_partkey, CAST(len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split('red widget', '')))) AS INTEGER) AS n FROM part"),
    "x12_pca": (x12_pca, None),
    "x13_context": (x13_context, "SELECT conv_id AS query_id, string_agg('[' || (turn + 1) || '] ' || coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, '')) AS context FROM conversations GROUP BY 1"),
    "x15_agreement": (x15_agreement, f"WITH {_LISTS} SELECT query_id, round(count(b.vec_id) / count(*), 6) AS common FROM a LEFT JOIN b USING (query_id, vec_id) GROUP BY 1"),
    "a21_document_frequency": (a21_document_frequency, f"SELECT t, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS t FROM documents) GROUP BY 1"),
    "a22_lengths": (a22_lengths, f"SELECT lang, count(*) AS n, CAST(sum(l) AS BIGINT) AS words, CAST(max(l) AS INTEGER) AS longest, round(avg(l), 4) AS mean FROM (SELECT lang, len({_TOKENS}) AS l FROM documents) GROUP BY 1"),
    "f1_tokens": (f1_tokens, f"SELECT conv_id, turn, array_to_string({_TOKENS}, ' ') AS tokens FROM conversations"),
    "f3_embedded_json": (f3_embedded_json, "SELECT event_id, props AS json FROM events"),
    "f2_clean_sql": (f2_clean_sql, "SELECT p_partkey, 'SELECT ' || p_partkey AS statement FROM part"),
    "f4_name_date": (f4_name_date, with_(SCENES, select="SELECT id, strftime(date, '%Y-%m-%d') AS day FROM scene")),
    "f6_years": (f6_years, with_(SCENES, select="SELECT id, CASE WHEN year(date) < 2019 THEN year(date) || ',2019' ELSE '2019,' || year(date) END AS years FROM scene")),
    "f7_heading": (f7_heading, "SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'none' ELSE trim(t) END AS title FROM (SELECT conv_id, turn, regexp_extract('x' || chr(10) || '## ' || coalesce(text, '') || ' ' || chr(10) || 'y', '(?m)^#{1,3}\\s+(.+)$', 1) AS t FROM conversations)"),
    "s31_html_text": (s31_html_text, f"SELECT page_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS md5 FROM (SELECT page_id, coalesce(string_agg(q, chr(10) ORDER BY i) FILTER (WHERE q <> ''), '') AS t FROM (SELECT page_id, i, regexp_replace({_UNESCAPED}, '^\\s+|\\s+$', '', 'g') AS q FROM (SELECT page_id, ps[i] AS p, i FROM (SELECT page_id, string_split({_HTML}, chr(1)) AS ps FROM pages), unnest(range(1, len(ps) + 1)) AS u(i))) GROUP BY 1)"),
    "x8_chunks": (x8_chunks, None),
    "u8_chunks_in_sql": (u8_chunks_in_sql, None),
    "u7_fusion_in_sql": (u7_fusion_in_sql, f"WITH {_LISTS} SELECT query_id, id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM l GROUP BY 1, 2"),
    "x9_chunk_index": (x9_chunk_index, None),
    "x9_chunk_search": (x9_chunk_search, None),
    "f14_bands": (f14_bands, "SELECT CASE WHEN l_discount < 0.02::DOUBLE THEN '轻微' WHEN l_discount < 0.08::DOUBLE THEN '中等' ELSE '显著' END AS size, count(*) AS n FROM lineitem GROUP BY 1"),
    "f15_colors": (f15_colors, f"SELECT palette, {_CHANNELS}, count(*) AS n FROM (VALUES {_COLORS}) AS t(palette, i, size, color) JOIN customer ON c_nationkey % size = i GROUP BY ALL"),
    "m1_profiles": (m1_profiles, _PROFILES),
    "m3_styles": (m3_styles, None),
    "m4_generalise": (m4_generalise, None),
    "m5_labels": (m5_labels, None),
    "m9_projection": (m9_projection, "SELECT CASE WHEN net >= 0 THEN '增加' ELSE '减少' END AS direction, CASE WHEN ratio < 0.02::DOUBLE THEN '轻微' WHEN ratio < 0.08::DOUBLE THEN '中等' ELSE '显著' END AS magnitude, CASE WHEN abs(net) < 0.5::DOUBLE THEN '轻微' WHEN abs(net) < 2 THEN '中等' ELSE '显著' END AS area, count(*) AS n FROM (SELECT (o_orderkey % 100)::DOUBLE / 1000 AS ratio, (o_orderkey % 70)::DOUBLE / 10 - 3 AS net FROM orders) GROUP BY 1, 2, 3"),
}
