"""op2 against all pairs, and its components."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from strataspan.llm import jaccard, queries
from strataspan.llm.components import components

from .cases import documents, odd_texts

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(texts):
    sets = {d: plain_set(t) for d, t in texts.items()}
    by, root = {}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), min(e for e in texts if find(e) == find(d))) for d in texts}


def check(df, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == plain_classes(texts)


def test_query(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    check(queries.op2_ngram_jaccard(spark, sf_dir), texts)


def test_planted(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    texts = [*odd_texts()]
    for k in range(60):  # a chain of near copies that drifts away from its start
        base = base[:]
        base[rng.randrange(80)] = f"n{k}"
        texts.append(" ".join(base))
    for k in range(30):  # copies, copies but for case, and short ones
        texts += [texts[13 + k], texts[13 + k].upper(), " ".join(base[: k % 7])]
    docs = documents(spark, texts).withColumn("class_id", F.lit("clash"))
    check(jaccard.classes_of(docs), dict(enumerate(texts)))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in plain_classes(dict(enumerate(texts))).values()}
    assert jaccard.classes_of(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    docs = documents(spark, ["a b c d e f"]).union(documents(spark, ["a b c d e f"]))
    assert [tuple(r)[:3] for r in jaccard.classes_of(docs).collect()] == [(0, 2, 0)] * 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + rng.randrange(1, 40)) for _ in range(50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {v for k, v in got.items() if k >= 100} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
