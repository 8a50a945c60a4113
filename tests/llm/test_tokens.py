"""op4 against totals that are counted in plain Python."""

from __future__ import annotations

import base64
import random
from collections import defaultdict

import pytest
import tiktoken
from pyspark.sql import functions as F

from strataspan.llm import queries, tokens
from strataspan.llm.common import scratch_path

SCHEMA = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long, seq int, present string"


def changes(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def apply(state, rows):
    """The stated rules on a dictionary by document and tokenizer."""
    best = {}
    for doc, tok, op, source, lang, n in rows:
        have = [op != "delete", source is not None, source or "", lang is not None, lang or "", n is not None, n or 0, op]
        if (doc, tok) not in best or have > best[doc, tok][0]:
            best[doc, tok] = (have, op, source, lang, n or 0)
    for at, (_, op, source, lang, n) in best.items():
        if op == "insert" or at in state:
            state[at] = (source, lang, n)
        if op == "delete":
            state.pop(at, None)


def summed(state):
    out = defaultdict(lambda: [0, 0])
    for (_, tok), (source, lang, n) in state.items():
        out[source, lang, tok][0] += 1
        out[source, lang, tok][1] += n
    return {(*k, *v) for k, v in out.items()}


def batches(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        yield [
            (rng.choice([None, *range(6)]), rng.choice("ab"), rng.choice(["insert", "insert", "delete", "revise"]), rng.choice([None, "s", "t"]), rng.choice([None, "en"]), rng.choice([None, 0, 5, 9]))
            for _ in range(rng.randrange(0, 9))
        ]


def test_totals_replays_and_snapshots(spark):
    store = tokens.TokenTotals(spark, scratch_path(spark, "totals"), compact=2)
    assert store.totals().count() == 0 and store.batches() == []
    state = {}
    for i, rows in enumerate(batches(1, 5)):
        assert store.commit(f"b{i}", changes(spark, rows))
        apply(state, rows)
        assert not store.commit(f"b{i}", changes(spark, [(1, "a", "insert", "s", "en", 77)]))
        again = tokens.TokenTotals(spark, store.root)  # another driver, later
        assert set(map(tuple, again.totals().collect())) == summed(state)
        assert {((r.doc_id, r.tokenizer), (r.source, r.lang, r.n_tokens)) for r in again.counts().collect()} == set(state.items())
    assert store.batches() == [f"b{i}" for i in range(5)]


def test_two_drivers(spark):
    """Another driver commits between staging and commit: the same name counts once, another
    name goes first and the deltas are computed again."""
    root = scratch_path(spark, "totals")
    one, two = tokens.TokenTotals(spark, root), tokens.TokenTotals(spark, root)
    first, second = [(1, "a", "insert", "s", "en", 5)], [(1, "a", "revise", "t", "en", 8), (2, "a", "insert", "t", None, None)]
    stage = one._stage

    def interrupted(name, rows):
        def run(*args):
            one._stage = stage
            two.commit(name, changes(spark, rows))
            stage(*args)

        return run

    one._stage = interrupted("x", first)
    assert one.commit("y", changes(spark, second))
    assert set(map(tuple, two.totals().collect())) == {("t", "en", "a", 1, 8), ("t", None, "a", 1, 0)} and two.batches() == ["x", "y"]
    one._stage = interrupted("z", first)
    assert not one.commit("z", changes(spark, first))
    assert two.batches() == ["x", "y", "z"] and set(map(tuple, two.totals().collect())) == {("s", "en", "a", 1, 5), ("t", None, "a", 1, 0)}


def test_lost_driver(spark):
    """A driver that dies before the commit changes nothing; the batch can be sent again."""
    store = tokens.TokenTotals(spark, scratch_path(spark, "totals"))
    real, store._create = store._create, lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.commit("b", changes(spark, [(1, "a", "insert", "s", "en", 5)]))
    assert store.totals().count() == 0
    store._create = real
    assert store.commit("b", changes(spark, [(1, "a", "insert", "s", "en", 5)])) and store.totals().count() == 1


def test_lost_between_the_steps_of_a_commit(spark):
    """A driver that dies with its entry written but not in place, and a reader in between."""
    store = tokens.TokenTotals(spark, scratch_path(spark, "totals"))
    assert store.commit("a", changes(spark, [(1, "a", "insert", "s", "en", 5)]))
    out = store._fs.create(store._path(f"{store.root}/log/_half"), False)
    out.write(b'{"name": "b", "da')
    out.close()
    assert store.batches() == ["a"] and store.totals().count() == 1
    assert store.commit("b", changes(spark, [(2, "a", "insert", "s", "en", 7)])) and not store.commit("b", changes(spark, []))
    assert set(map(tuple, tokens.TokenTotals(spark, store.root).totals().collect())) == {("s", "en", "a", 2, 12)}
    number = len(store.batches())
    assert store._create("log", number, {"name": "c", "data": store._entries("log")[0]["data"]})
    assert not store._create("log", number, {"name": "d", "data": "elsewhere"}) and store.batches() == ["a", "b", "c"]


def test_commits_read_few_entries(spark, monkeypatch):
    """Entries before a snapshot aren't opened; parts that two snapshots have summed up are gone."""
    store = tokens.TokenTotals(spark, scratch_path(spark, "totals"), compact=2)
    for i in range(6):
        assert store.commit(f"b{i}", changes(spark, [(i, "a", "insert", "s", "en", 1)]))
    opened, real = [], store._entry
    monkeypatch.setattr(store, "_entry", lambda name: opened.append(name) or real(name))
    assert not store.commit("b0", changes(spark, [])) and store.commit("b6", changes(spark, [(9, "a", "insert", "s", "en", 1)]))
    assert all(name in ("snapshots/00000006", "log/00000006") for name in opened)
    assert set(map(tuple, store.totals().collect())) == {("s", "en", "a", 7, 7)}
    folders = [s.getPath().getName() for s in store._fs.listStatus(store._path(f"{store.root}/data"))]
    assert len(folders) == 5  # two snapshots, the batches after the first of them


def plain_encoding():
    with open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query(spark, sf_dir):
    encode = plain_encoding().encode_ordinary
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    state = {(r.doc_id, "byte_bpe_50k"): (r.source, r.lang, len(encode(r.text or ""))) for r in docs if r.doc_id not in toxic}
    assert set(map(tuple, queries.op4_token_counts(spark, sf_dir).collect())) == summed(state)


def test_odd_texts(spark):
    from .cases import documents, odd_texts

    docs = documents(spark, odd_texts()).withColumn("tokenizer", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}
    encode = plain_encoding().encode_ordinary
    assert got == {i: len(encode(t or "")) for i, t in enumerate(odd_texts())}
    assert tokens.count_tokens(docs.limit(0)).count() == 0
