"""op7 and op9 against brute force, and the suffix array against sorting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataspan.llm import phrases, queries, suffixes
from strataspan.llm.repeats import Fragments

from .cases import documents, odd_texts

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def plain_bytes(rows):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def plain_words(rows):
    raw = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    times = Counter(hash(tuple(w[i : i + 35])) for _, w in raw for i in range(len(w) - 34))
    out = []
    for d, w in raw:
        gone = set()
        for i in range(len(w) - 34):
            if times[hash(tuple(w[i : i + 35]))] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_byte_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op7_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == plain_bytes(rows)


def test_word_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op9_substring_dedup(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == plain_words(rows)


def planted():
    rng = random.Random(9)
    words = [f"{rng.choice('abcé')}{rng.randrange(30)}" for _ in range(4000)]
    texts = odd_texts()
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(3800)
            parts += words[a : a + rng.randrange(3, 150)] if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(50))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [" ".join(words[:60]) + " ab" * n for n in range(40)] + ["ab" * 400, "ab" * 300, "a" * 49, "a" * 50, "a" * 51]
    return texts


def test_bytes_planted(spark):
    texts = planted()
    docs = documents(spark, texts).union(documents(spark, texts[5:8])).withColumnRenamed("lang", "row")
    rows = docs.select("doc_id", "text").collect()
    out = suffixes.remove_earlier(docs)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect())
    assert got == plain_bytes(rows)
    split = suffixes.remove_earlier(docs, hot=2)  # nearly all keys are hot
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in split.collect()) == got
    assert suffixes.remove_earlier(docs.limit(0)).count() == 0


def test_words_planted(spark):
    texts = planted()
    docs = documents(spark, texts).union(documents(spark, texts[5:8])).withColumnRenamed("lang", "doc")
    rows = docs.select("doc_id", "text").collect()
    out = phrases.remove_recurring(docs)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in out.collect())
    assert got == plain_words(rows)
    split = phrases.remove_recurring(docs, hot=2)  # nearly all keys are hot
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in split.collect()) == got
    assert phrases.remove_recurring(docs.limit(0)).count() == 0


def test_automaton_decides():
    """What the automaton finds counts: without hits nothing recurs, though hashes do."""
    text = " ".join(f"w{i}" for i in range(40)).encode()
    f = Fragments(np.full(2, 3, np.uint64), np.arange(2), np.arange(2), np.zeros(2, int), np.full(2, 6), np.ones(2, np.uint8), np.full(2, len(text)), np.frombuffer(text + text, np.uint8))
    assert [len(x) for x in phrases.recurring()(f)] == [2, 2, 2]
    real, phrases.compile_passages = phrases.compile_passages, lambda sequences: real([(0,)])
    try:
        assert [len(x) for x in phrases.recurring()(f)] == [0, 0, 0]
    finally:
        phrases.compile_passages = real


def test_one_anchor_with_megabytes():
    """A common run of 20 bytes with distinct surroundings: one key, over 4 MB of fragments."""
    rng, anchor = random.Random(3), b"licensed under terms"
    sides = [bytes(rng.choices(range(97, 123), k=30)) for _ in range(30_000)]
    contents = {rng.choice(sides) + anchor + rng.choice(sides) for _ in range(56_000)}
    texts = [(d, t) for d, t in enumerate(sorted(contents, key=lambda t: (hash_of(t), t)))]
    assert sum(len(t) for _, t in texts) > 4 << 20
    count = len(texts)
    numbers = [np.full(count, 7, np.uint64), np.arange(count), np.arange(count), np.zeros(count, int), np.full(count, 31), np.ones(count, np.uint8), np.full(count, 80)]
    i, a, b = suffixes.earlier()(Fragments(*numbers, np.frombuffer(b"".join(t for _, t in texts), np.uint8)))
    got = {}
    for f, x, y in zip(i.tolist(), a.tolist(), b.tolist(), strict=True):
        got.setdefault(f, set()).update(range(x, y))
    least = {}
    for d, t in texts:
        for x in range(31):
            least.setdefault(t[x : x + 50], d)
    want = {d: {y for x in range(31) if least[t[x : x + 50]] < d for y in range(x, x + 50)} for d, t in texts}
    assert got == {d: w for d, w in want.items() if w}


def hash_of(text):
    return hashlib.md5(text).digest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=120))
def test_suffix_array(values):
    order = suffixes.suffix_array(np.array(values, np.int64), 10**6)
    assert order.tolist() == sorted(range(len(values)), key=lambda i: values[i:])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 2), min_size=200, max_size=700), st.integers(1, 60))
def test_suffix_array_to_a_depth(values, depth):
    order = suffixes.suffix_array(np.array(values * 2, np.int64), depth)
    heads = [(values * 2)[i : i + depth] for i in order.tolist()]
    assert heads == sorted(heads) and len(set(order.tolist())) == 2 * len(values)
