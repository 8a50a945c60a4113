"""op11 against links found byte by byte, with the vocabulary's own runtime."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspan.llm import align, queries

from .cases import documents, odd_texts

FOLDER = align.TOKENIZERS


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{FOLDER}/{align.BYTE_LEVEL}")
    a.encode_special_tokens = True
    with open(f"{FOLDER}/{align.BYTE_LEVEL}", encoding="utf-8") as f:
        vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{align.PIECES}")
    table, extra = {}, 0
    for code in range(256):
        if 33 <= code < 127 or 161 <= code < 173 or code >= 174:
            table[chr(code)] = code
        else:
            table[chr(256 + extra)] = code
            extra += 1

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(table[c] for c in vocab[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        whole = (" " + text).encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if text and b"".join(bytes_a) == b"".join(bytes_b) == whole else None

    return encode


def owners(parts):
    return [i for i, p in enumerate(parts) for _ in p]


def plain_rows(encode, texts):
    links, rows, total = {}, {}, Counter()
    for d, text in texts.items():
        got = encode(text or "")
        if got is None:
            rows[d] = (0, 0, 0, 0, "")
            continue
        ids_a, bytes_a, ids_b, bytes_b = got
        of_a, of_b = owners(bytes_a), owners(bytes_b)
        links[d] = [(ids_a[i], ids_b[j]) for i, j in sorted(set(zip(of_a, of_b, strict=True)))]
        total.update(links[d])
        groups, start = [], 0
        for end in range(1, len(of_a) + 1):
            if end == len(of_a) or of_a[end] != of_a[end - 1] and of_b[end] != of_b[end - 1]:
                side = lambda of, ids: ",".join(str(ids[k]) for k in sorted(set(of[start:end])))  # noqa: B023, E731
                groups.append(f"{side(of_a, ids_a)}|{side(of_b, ids_b)}")
                start = end
        rows[d] = (len(ids_a), len(ids_b), len(groups), len(links[d]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    highest = {}
    for (_, b), n in total.items():
        highest[b] = max(n, highest.get(b, 0))
    return {d: (*r[:4], sum(total[p] == highest[p[1]] for p in links.get(d, ())), sum(total[p] for p in links.get(d, ())), r[4]) for d, r in rows.items()}, total


def rows_of(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_query(spark, sf_dir, plain):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert rows_of(queries.op11_token_alignment(spark, sf_dir)) == plain_rows(plain, texts)[0]


ODD = ["<|endoftext|> <s> <unk> <0x41>", "a▁b", "  two  spaces\t\ttabs\r\n\n", "naïve café 東京 ünïcödé 🙂🙂", "\u0000nul", "ſ ﬁ Å", "1234567 12.5%", "x" * 3000, "'s 'S don't"]


@pytest.mark.parametrize("shard", [None, 40])
def test_odd_texts(spark, plain, monkeypatch, shard):
    if shard:  # many ranges of ids, and a task's sums sent in many parts
        monkeypatch.setattr(align, "SHARD", shard)
        monkeypatch.setattr(align, "BUFFER", 10)
    texts = [*odd_texts(), *ODD]
    docs = documents(spark, texts).withColumns({"row": F.lit("clash"), "pairs": F.lit(1)})
    want, total = plain_rows(plain, dict(enumerate(texts)))
    assert rows_of(align.align(docs)) == want
    assert {(r.a, r.b): r.n for r in align.alignment(docs).collect()} == dict(total)


def test_repeated_and_null_ids(spark):
    docs = documents(spark, ["some words here", "some words here"]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = align.align(docs).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_links > 0
    assert align.align(docs.limit(0)).count() == 0 and align.alignment(docs.limit(0)).count() == 0


def test_link_tokens():
    at_a, at_b = align.link_tokens(np.array([2, 3, 7]), np.array([1, 4, 7]))
    assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)]


def test_same_splits():
    """The pattern splits every code point as the vocabulary's own runtime does, in several surroundings."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{FOLDER}/{align.BYTE_LEVEL}")
    fast = align.Tokenizers(f"{FOLDER}/{align.BYTE_LEVEL}", f"{FOLDER}/{align.PIECES}").a
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3400 or c % 7 == 0)]
    for at in range(0, len(points), 20_000):
        texts = [f" a{chr(c)}1{chr(c)}  {chr(c)}.{chr(c)}" for c in points[at : at + 20_000]]
        for text, e in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True):
            assert e.ids == fast.encode_ordinary(text), ascii(text)
