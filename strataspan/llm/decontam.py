"""Benchmark decontamination by suffix arrays of the training data.

Each slice of documents becomes a shard: its words, numbered by the benchmark's
vocabulary, and the sorted array of its suffixes. A suffix that doesn't begin with
two words that stand next to each other in the benchmark (or one, where an item has
a single word) can't be found by any search and is left out of the array. Every
suffix of every test item is then binary-searched in every shard, word by word; the
range that is left after a window's length holds all its occurrences, the last
range before none is left the longest verbatim match.

Distinct items go to the tasks in blocks of about ``BLOCK_BYTES`` of text. A benchmark of
one block, whose size is measured, is broadcast and documents aren't shuffled. A larger one
takes a pass for each block: only one block is on the driver and in the workers at a time,
a pass writes what it found, and the finds of a document are merged by its id and text.

Defined cases: null texts have no words; items without words match nothing; items
with fewer words than a window are one window; repeated item ids count once;
items without an id count as one with an empty id;
repeated documents are judged each; empty tables give no hits. Other columns are
kept by ``remove_contaminated`` and ignored by ``hits``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise
from .kernel import slices

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20

_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and everything beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split(b" ")


def solid(words: list[bytes]) -> list[bytes]:
    return [w for w in words if w]


class TestBlock:
    """Test items as one array of word numbers, with all their suffixes."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        ids, self.names, numbers, lengths = [], [], [], []
        for name, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in solid(words_of(text))]
            if own:
                self.names.append(name)
                ids += [*own, 0]
                numbers += [len(self.names) - 1] * len(own)
                lengths += range(len(own), 0, -1)
        self.words = np.array([*ids, 0], np.int64)
        self.starts = np.flatnonzero(self.words)
        self.item, self.left = np.array(numbers, np.int64), np.array(lengths, np.int64)
        whole = np.maximum.reduceat(self.left, np.flatnonzero(np.diff(self.item, prepend=-1))) if len(self.item) else np.zeros(0, np.int64)
        size = np.minimum(whole, window)[self.item] if len(self.item) else self.left
        self.window = np.where(self.left >= size, size, 0)  # 0: no window starts here
        pairs = self.words[:-1] * (len(self.vocabulary) + 1) + self.words[1:]
        self.pairs, self.lead = np.unique(pairs[self.words[:-1] > 0]), 1 if (whole == 1).any() else 2
        self.longest = int(self.left.max(initial=0))


class Shard:
    """Word numbers of a slice of documents, a 0 after each, and their suffix array."""

    def __init__(self, texts: list[str | None], block: TestBlock) -> None:
        number, parts, counts = block.vocabulary.get, [], []
        for t in texts:
            words = solid(words_of(t))
            counts.append(len(words))
            parts.append(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        self.counts = np.array(counts, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts + 1)])
        self.words = np.concatenate([*parts, np.zeros(block.longest + 64, np.int64)])
        s, n = self.words, int(self.first[-1])
        if block.lead == 1:
            at = np.flatnonzero(s[:n] > 0)
        else:
            codes = s[:n] * (len(block.vocabulary) + 1) + s[1 : n + 1]
            known = (s[:n] > 0) & (s[1 : n + 1] > 0)
            at = np.flatnonzero(known)
            at = at[np.isin(codes[at], block.pairs)]
        self.array = self._sorted(at, block)

    def _sorted(self, at: np.ndarray, block: TestBlock) -> np.ndarray:
        """Positions in the order of the words from them on, as far as a test suffix can reach."""
        bits = max(1, int(len(block.vocabulary)).bit_length())
        per = 62 // bits
        s = self.words

        def key(p: np.ndarray, depth: int) -> np.ndarray:
            k = np.zeros(len(p), np.int64)
            for j in range(per):
                k = (k << bits) | s[np.minimum(p + depth + j, len(s) - 1)]
            return k

        k = key(at, 0)
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        group = np.cumsum(np.diff(k, prepend=k[:1]) != 0)
        depth = per
        while depth < block.longest:
            sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
            tied = np.flatnonzero(sizes[group] > 1) if len(group) else group
            if not len(tied):
                break
            k = key(at[tied], depth)
            order = np.lexsort((k, group[tied]))
            at[tied], k, g = at[tied][order], k[order], group[tied][order]
            new = np.zeros(len(group), bool)
            new[tied[1:]] = (np.diff(k) != 0) & (np.diff(g) == 0)
            group = group + np.cumsum(new)
            depth += per
        return at

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            have = self.words[self.array[mid] + depth]
            below = have <= want[open_] if after else have < want[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return lo

    def search(self, block: TestBlock) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """((test suffixes, positions) per found window), and for each test suffix
        the length of its longest match here and a position of it."""
        found = []
        q = np.arange(len(block.starts))
        best, where = np.zeros(len(q), np.int64), np.full(len(q), -1, np.int64)
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(self.array), np.int64)
        depth = 0
        while len(q):
            live = block.left[q] > depth
            q, lo, hi = q[live], lo[live], hi[live]
            want = block.words[block.starts[q] + depth]
            lo, hi = self._bound(lo, hi, depth, want, False), self._bound(lo, hi, depth, want, True)
            live = lo < hi
            q, lo, hi = q[live], lo[live], hi[live]
            depth += 1
            best[q], where[q] = depth, self.array[lo]
            ended = np.flatnonzero(block.window[q] == depth)
            if len(ended):
                sizes = hi[ended] - lo[ended]
                ranks = np.repeat(lo[ended], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found.append((np.repeat(q[ended], sizes), self.array[ranks]))
        return found, best, where


def _items(benchmark: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Distinct items (i, t, block), and how many blocks of about ``limit`` bytes they make."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // limit))
    return items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), blocks


def _sent(items: DataFrame, block: int, window: int) -> Broadcast:
    rows = items.filter(F.col("block") == block).orderBy("i", "t").collect()
    return items.sparkSession.sparkContext.broadcast(TestBlock([(r.i, r.t) for r in rows], window))


@dataclass
class Finds:
    """What a block's items have in common with some texts."""

    counts: np.ndarray  # words of each text
    hit: list[list[tuple[int, int]]]  # runs of words hit
    items: list[list[str]]
    longest: np.ndarray  # words of the longest verbatim match, 0 without a window

    @classmethod
    def of(cls, texts: list[str | None], block: TestBlock) -> Finds:
        shard = Shard(texts, block)
        found = shard.search(block)[0]
        tests, at = (np.concatenate([f[k] for f in found] + [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
        docs = np.searchsorted(shard.first, at, "right") - 1
        items: list[set[str]] = [set() for _ in texts]
        for d, i in set(zip(docs.tolist(), block.item[tests].tolist(), strict=True)):
            items[d].add(block.names[i])
        cover = np.zeros(int(shard.first[-1]) + 2, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + block.window[tests], -1)
        edges = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False))
        hit: list[list[tuple[int, int]]] = [[] for _ in texts]
        for a, b, d in zip(edges[::2].tolist(), edges[1::2].tolist(), (np.searchsorted(shard.first, edges[::2], "right") - 1).tolist(), strict=True):
            hit[d].append((a - int(shard.first[d]), b - int(shard.first[d])))
        # windows that follow each other in an item and in a text are one match
        longest = np.zeros(len(texts), np.int64)
        shift = at - block.starts[tests]
        order = np.lexsort((at, shift))
        ends = np.flatnonzero(np.append((np.diff(shift[order]) != 0) | (np.diff(at[order]) != 1), True)) if len(at) else np.zeros(0, np.int64)
        heads = np.append(0, ends + 1)[: len(ends)]
        np.maximum.at(longest, docs[order[heads]], ends - heads + block.window[tests[order[heads]]])
        return cls(shard.counts, hit, [sorted(i) for i in items], longest)


_COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and
    longest (words of the longest verbatim match with an item, where a window occurs)."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    items, blocks = _items(benchmark, block_bytes)
    if blocks == 1:
        return source.mapInArrow(partial(_hit_rows, held=_sent(items, 0, window)), f"doc_id {kind}, {_COLUMNS}")
    passes = _passes(source, items, blocks, window)
    sha = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    keyed = source.withColumn("row", _row_key()).mapInArrow(_word_counts, f"doc_id {kind}, row long, n_words long")
    out = keyed.join(passes, "row", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("items", F.coalesce("items", none)).select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("longest", F.lit(0)).alias("longest"),
    )


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _passes(keyed: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """row, n_hit, items, longest of the texts in which an item of any block occurs."""
    rows = keyed.select(_row_key().alias("row"), F.col("text").cast("string").alias("text"))
    parts = []
    for block in range(blocks):
        held = _sent(items, block, window)
        parts.append(materialise(rows.mapInArrow(partial(_found_rows, held=held), "row long, a long, b long, item string, longest long"), "hits"))
        held.destroy()
    every = reduce(DataFrame.unionByName, parts).distinct()
    runs = F.array_sort(F.collect_set(F.when(F.col("item").isNull(), F.struct("a", "b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda s, r: F.struct((s.n + F.greatest(r.b - F.greatest(r.a, s.end), F.lit(0))).alias("n"), F.greatest(s.end, r.b).alias("end"))
    return every.groupBy("row").agg(F.aggregate(runs, start, add, lambda s: s.n).alias("n_hit"), F.collect_set("item").alias("items"), F.max("longest").alias("longest"))


def _hit_rows(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            f = Finds.of(part.column(1).to_pylist(), held.value)
            n_hit = [sum(b - a for a, b in runs) for runs in f.hit]
            digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in f.items]
            columns = [pa.array(f.counts), pa.array(n_hit, pa.int64()), pa.array(map(len, f.items), pa.int64()), pa.array(digests), pa.array([n > 0 for n in n_hit]), pa.array(f.longest)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))])


def _found_rows(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """A row for each run of words hit (without item) and for each item of a text."""
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            f = Finds.of(part.column(1).to_pylist(), held.value)
            rows = [(d, a, b, None) for d, runs in enumerate(f.hit) for a, b in runs] + [(d, None, None, i) for d, names in enumerate(f.items) for i in names]
            if rows:
                d, a, b, item = zip(*rows, strict=True)
                columns = [part.column(0).take(pa.array(d)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(item, pa.string()), pa.array(f.longest[list(d)])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "a", "b", "item", "longest"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [len(solid(words_of(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64())], ["doc_id", "row", "n_words"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their own columns."""
    items, blocks = _items(benchmark, block_bytes)
    if blocks > 1:
        (key,) = fresh(docs, "own_row")
        found = _passes(docs.select("doc_id", "text"), items, blocks, window).select(F.col("row").alias(key))
        return docs.withColumn(key, _row_key()).join(found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    held, at = _sent(items, 0, window), docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SHARD_BYTES):
                f = Finds.of(part.column(at).to_pylist(), held.value)
                yield part.filter(pa.array([not runs for runs in f.hit], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """For each test suffix with a match of ``least`` words or more: item_id, offset
    (words), length, doc_id and position of a longest one, the smallest of equals.
    Each shard reports its best, so hot passages cost a row per shard."""
    items, blocks = _items(benchmark, BLOCK_BYTES)

    def task(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                shard = Shard(part.column(1).to_pylist(), block)
                _, best, where = shard.search(block)
                q = np.flatnonzero(best >= least)
                d = np.searchsorted(shard.first, where[q], "right") - 1
                begins = np.flatnonzero(np.diff(block.item, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.names[i] for i in block.item[q]], pa.string()), pa.array(q - begins[block.item[q]], pa.int64()),
                     pa.array(best[q], pa.int64()), part.column(0).take(pa.array(d)), pa.array(where[q] - shard.first[d], pa.int64())],
                    ["item_id", "offset", "length", "doc_id", "position"],
                )

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"item_id string, offset long, length long, doc_id {kind}, position long"
    if blocks == 1:
        found = source.mapInArrow(partial(task, held=_sent(items, 0, least)), schema)
    else:  # one block at a time
        parts = []
        for block in range(blocks):
            held = _sent(items, block, least)
            parts.append(materialise(source.mapInArrow(partial(task, held=held), schema), "matches"))
            held.destroy()
        found = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "position")).alias("b")
    return found.groupBy("item_id", "offset").agg(best).select("item_id", "offset", (-F.col("b.l")).alias("length"), "b.doc_id", "b.position")
