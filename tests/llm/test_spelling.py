"""op12 against deletions of every word, and its chains of forms."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strataspan.llm import queries, spelling

from .cases import documents, odd_texts

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(texts):
    out = Counter()
    for d, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_rows(n):
    gaps, near = defaultdict(set), defaultdict(set)
    for w in n:
        gaps[w].add(w)
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1 :]].add(w)
    for ws in gaps.values():
        for a in ws:
            near[a] |= {b for b in ws if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], form[w], n[form[w]] if form[w] else None, len(near[w]), root)
    return out


def rows_of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in rows}


def test_query(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_rows(plain_words(texts))
    assert rows_of(queries.op12_spelling_variants(spark, sf_dir)) == want
    assert any(r[1] for r in want.values())


def test_planted(spark):
    """Random edits at every place of words of 6 to 13 letters, chains of forms, ties, letters beyond ASCII."""
    rng = random.Random(7)
    texts = [*odd_texts()]
    for k in range(60):
        word = "".join(rng.choice("abcdefghijéß") for _ in range(6 + k % 8))
        chain = [word]
        for _ in range(3):
            w, i = chain[-1], rng.randrange(len(chain[-1]) + 1)
            chain.append(rng.choice([w[:i] + "x" + w[i:], w[: i - 1] + w[i:] if i else w + "y", w[:i] + "z" + w[i + 1 :]]))
        texts += [" ".join([w] * n).title() for w, n in zip(chain, (700, 140, 28, 5), strict=True)]
    texts += ["tiewordx " * 50 + "tiewordy " * 50 + "tieword " * 10, "aaaaaa " * 6 + "aaaaaaa " * 30 + "aaaaaaaa " * 150 + "ÄÄaaaa " * 9]
    docs = documents(spark, texts).withColumns({"word": F.lit("clash"), "size": F.lit(1)})
    got = rows_of(spelling.variants(docs))
    assert got == plain_rows(plain_words(enumerate(texts)))
    assert got["tieword"][1] == "tiewordx" and got["aaaaaa"][4] == "aaaaaaaa"


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["cartesian cartesian", None]).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.union(docs).union(docs)
    assert rows_of(spelling.variants(docs)) == plain_rows(plain_words([(None, "cartesian cartesian")] * 3))
    assert spelling.variants(docs.limit(0)).count() == 0


def test_short_words(spark):
    """The general operator takes words of any length."""
    words = ["a", "b", "ab", "ba", "abc", "abd", "bc", "é", "éa", "abcd", "acd"]
    got = {(r.word, r.other) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
