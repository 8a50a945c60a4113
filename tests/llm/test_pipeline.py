"""The pipeline's rows against a brute-force version of its stages, and op10 against windows."""

from __future__ import annotations

import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from strataspan.llm import decontam, jaccard, queries, sql

from ..compare import assert_same
from .cases import documents, odd_texts
from .test_jaccard import plain_classes
from .test_lines import plain_dedup
from .test_simple import plain_quality

ASCII = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_kept(text):
    n, chars, symbols, dup, rep = plain_quality(text)
    n_lines = sum(bool(x.strip(" \t\r\x0b\x0c")) for x in (text or "").split("\n"))
    capitals = sum("A" <= c <= "Z" for c in text or "")
    return not (
        n < 50 or 100 * rep > 50 * n or 100 * symbols > 20 * chars or 100 * dup > 50 * n_lines or chars < 2 * n or chars > 15 * n or 100 * capitals > 50 * chars
    )


def windows(text):
    w = ASCII.findall((text or "").translate(FOLD))
    m = min(10, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()


def dirty(text, passages):
    w = ASCII.findall((text or "").translate(FOLD))
    return any(tuple(w[i : i + m]) in passages for m in {len(p) for p in passages} for i in range(len(w) - m + 1))


def longest(text, items):
    """The longest run of words that a text has in common with an item, if a window is in it."""
    w, best = ASCII.findall((text or "").translate(FOLD)), 0
    for item in items:
        v = ASCII.findall((item or "").translate(FOLD))
        for shift in range(-len(v), len(w)):
            run = 0
            for j in range(len(v)):
                run = run + 1 if 0 <= shift + j < len(w) and w[shift + j] == v[j] else 0
                best = max(best, run if run >= min(10, len(v)) else 0)
    return best


def test_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    texts = {d: t for d, t in texts.items() if plain_kept(t)}
    texts, _ = plain_dedup(texts)
    groups = plain_classes(texts)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    passages = set().union(*map(windows, spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas().text))
    texts = {d: t for d, t in texts.items() if not dirty(t, passages)}
    rest = docs[docs.doc_id.isin(texts)].assign(text=lambda x: x.doc_id.map(texts))
    con = duckdb.connect()
    con.register("rest", rest)
    assert assert_same(corpus_pipeline.run(spark, sf_dir), sql.mixing(queries.MIX_WEIGHTS, "rest"), con) > 0


def test_stages_take_odd_rows(spark, sf_dir):
    docs = documents(spark, odd_texts()).union(spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mix_sources":
            assert out.columns == docs.columns
        assert out.count() <= docs.count() * 2
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Null ids, repeated rows and rows that share an id only."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(None, x), (None, y), (None, y + " end"), (4, z), (4, z), (4, z + " end"), (5, z), (6, "one"), (6, "two"), (None, None), (None, ""), (7, ""), (7, "")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_chars long")
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sum(t in (y, y + " end") for _, t in got) == 1 and sum((t or "").startswith("z") for _, t in got) == 1
    assert [d for d, t in got if (t or "").startswith("z")] == [4]
    rest = [(d, t) for d, t in got if not (t or "").startswith(("y", "z"))]
    assert sorted(map(str, rest)) == sorted(map(str, [rows[0], *rows[7:]]))


def test_decontamination_odd(spark):
    docs = documents(spark, [*odd_texts(), "x one two three four y", "alpha0 béta0", "b c"])
    bench = spark.createDataFrame(pd.DataFrame({"item_id": [1, 2, 3, 4, 4], "text": ["", "One two three four", " ".join(f"alpha{i} béta{i}" for i in range(3, 20)), "b", "b"]}))
    passages = set().union(*map(windows, bench.toPandas().text))
    rows = decontam.hits(docs, bench, block_bytes=8).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    assert {r.doc_id: r.contaminated for r in rows} == {d: dirty(t, passages) for d, t in texts.items()}
    assert sum(r.n_items == 2 for r in rows) == 0 and [r.n_items for r in rows if texts[r.doc_id] == "b c"] == [1]
    whole = {r.doc_id: tuple(r) for r in decontam.hits(docs, bench).collect()}
    assert {r.doc_id: tuple(r) for r in rows} == whole  # passes by block find the same
    assert {d: r[-1] for d, r in whole.items()} == {d: longest(t, bench.toPandas().text) for d, t in texts.items()}
    unnamed = bench.withColumn("item_id", F.when(F.col("item_id") != 4, F.col("item_id")))
    assert {r.doc_id: r.n_items for r in decontam.hits(docs, unnamed).collect()} == {d: r[3] for d, r in whole.items()}
    assert decontam.remove_contaminated(docs, bench, block_bytes=8).count() == sum(not dirty(t, passages) for t in texts.values())
    assert decontam.remove_contaminated(docs, bench).count() == sum(not dirty(t, passages) for t in texts.values())
    assert decontam.hits(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.hits(docs.limit(0), bench).count() == 0
    assert decontam.longest_matches(docs, bench, 10).filter("length >= 10").count() > 0
