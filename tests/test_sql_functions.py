"""Functions that the library registers for SQL, against its operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspan.functions import sql_functions, text
from strataspan.operators import retrieval
from strataspan.queries import texts
from strataspan.sources.tables import load


def test_chunks_in_from(spark, sf_dir):
    sql_functions.register(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "  \n")], "doc_id long, text string"))
    docs.createOrReplaceTempView("some_documents")
    got = spark.sql("SELECT d.doc_id, c.index, c.chunk FROM some_documents d, LATERAL chunks_of(d.text) c")
    want = text.chunks(docs, "doc_id").select("doc_id", "index", "chunk")
    assert got.count() == want.count() > 0 and got.exceptAll(want.select("doc_id", F.col("index").cast("int"), "chunk")).isEmpty()
    assert spark.sql("SELECT * FROM chunks_of('one text')").collect() == [(0, "one text")]


def test_scores(spark, sf_dir):
    """BM25 and fusion written in SQL over the functions give the operators' rows."""
    sql_functions.register(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", text.token_count(F.col("text")).alias("len"), F.explode(text.tokens(F.col("text"))).alias("t"))
    words.createOrReplaceTempView("words")
    docs.select("doc_id", text.token_count(F.col("text")).alias("len")).createOrReplaceTempView("lengths")
    texts._asked(spark, sf_dir).select("query_id", F.explode(text.tokens(F.col("text"))).alias("t")).createOrReplaceTempView("asked")
    got = spark.sql("""
        WITH tf AS (SELECT doc_id, len, t, count(*) AS tf FROM words GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
        n AS (SELECT count(*) AS n, avg(len) AS m FROM lengths)
        SELECT query_id, doc_id, sum(bm25_weight(tf, len, m, n, df)) AS score FROM asked JOIN df USING (t) JOIN tf USING (t) CROSS JOIN n GROUP BY ALL""")
    best = retrieval.rank_by(got, 5, F.round("score", 9).desc(), F.asc("doc_id"))
    rows = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect())
    assert rows(best) == rows(retrieval.bm25(docs, texts._asked(spark, sf_dir), 5))
    row = spark.sql("SELECT fusion_weight(1) AS f, iou(3, 1, 2) AS i, iou(0, 0, 0) AS e, keep_ratio(3, 0) AS k, robust_score(5, 2, 0) AS r, iou(NULL, 1, 1) AS x").first()
    assert (row.f, row.i, row.e, row.k, row.r, row.x) == (1 / 61, 0.5, 0.0, 3.0, 3e6, None)
