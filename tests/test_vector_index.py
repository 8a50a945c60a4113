"""Approximate search: recall over all asked rows, exact with all cells, hot cells in parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspan.operators import retrieval
from strataspan.sources import vector_index
from strataspan.sources.tables import load
from strataspan.sources.vector_index import VectorIndex, recall


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, tmp_path, folder):
    e = load(spark, folder, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    index.build(e)
    exact = retrieval.vector_search(e, q, 10)
    assert recall(index.search(q, 10), exact) >= 0.9
    centres, probes = index.centres()
    assert len(centres) == round(e.count() ** 0.5) > probes
    assert spark.read.parquet(f"{index.root}/vectors").count() == e.count()  # every row is indexed
    pairs = lambda df: sorted((r.query_id, r.vec_id, r["rank"]) for r in df.collect())
    assert pairs(index.search(q, 10, 10**6)) == pairs(exact)


def test_hot_cells_and_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 40)
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([rng.normal([5, 0, 0, 0], 0.1, (300, 4)), rng.normal(0, 1, (60, 4))]))]
    rows += [(400, None), (401, [0.0] * 4), (7, [1.0, 2.0, 3.0, 4.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    index.build(df, sample=50)
    q = df.select(F.col("vec_id").alias("query_id"), "embedding").filter("query_id % 5 = 0")
    unit = df.select("vec_id", retrieval.normalised(F.col("embedding")).alias("embedding")).dropna()
    exact = retrieval.vector_search(unit, q.select("query_id", retrieval.normalised(F.col("embedding")).alias("embedding")).dropna(), 3)
    got = index.search(q, 3, 10**6)
    assert sorted((r.query_id, round(r.score, 9), r["rank"]) for r in got.collect()) == sorted((r.query_id, round(r.score, 9), r["rank"]) for r in exact.collect())
    index.build(df.limit(0))
    assert index.search(q, 3).count() == 0


def test_blocks_of_queries(spark, sf_dir, monkeypatch):
    """Several blocks give the rows of one."""
    e = load(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in retrieval.vector_search(e, q, 4).collect())
    one = rows()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    assert rows() == one
