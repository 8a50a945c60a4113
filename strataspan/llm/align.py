"""Alignment of two tokenizers over the same texts.

Both tokenizers encode each text; running sums of their tokens' bytes give the ends of
tokens, common ends cut the text into groups, and every pair of tokens whose bytes
overlap is a link. Links are counted by pair of ids over the whole corpus.

- ``link`` encodes a text once and keeps, per row, its counts and its distinct pairs with
  how often each occurs. Ends are cumulated, ``intersect1d`` finds the common ones,
  ``searchsorted`` the group of each token, and links come from repeating each A token
  over the B tokens that it meets.
- ``pair_counts`` sums them up inside each task, then by (pair, salt), then by pair, so
  that a pair that every task holds doesn't meet in one reducer at once.
- ``score`` brings counts back to the rows: B ids are cut into ranges of at most
  ``SHARD`` pairs, each range's counts are sent to several salts, and the rows' pairs are
  streamed past them in sorted order. A task holds one range and one batch of rows.

Defined cases: null and empty texts, and texts that either tokenizer doesn't give back
byte by byte (white space that it folds, its own space mark inside a text), have no
tokens: all counts 0 and an empty digest. Rows that repeat an id, and rows without one,
stay rows of their own. Ties at a B id's highest count are all best. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shuffle_partitions
from .tokens import PATTERN, TOKENIZERS

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Most pairs whose counts one task holds (24 bytes each).
SHARD = 2_000_000
# Entries that a task sums up before it sends them.
BUFFER = 4_000_000
SALTS = 8

_LINKS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_SIDE = "shard int, salt int, kind int, row long, pairs binary, times binary"
_loaded: dict[tuple[str, str], Tokenizers] = {}


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand
    for themselves, the others take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both encoders with the byte length of every id, loaded once per worker."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # Ids are in the order of merges, so they serve as ranks; the JSON's own runtime is three times slower.
        self.a = tiktoken.Encoding(byte_level, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.size_a, self.size_b = max(spec["model"]["vocab"].values()) + 1, self.b.vocab_size()
        self.len_a = np.zeros(self.size_a, np.int64)
        self.len_a[list(ranks.values())] = [len(t) for t in ranks]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(self.size_b)]
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.kind = np.int32 if self.size_a * self.size_b < 2**31 else np.int64
        self.written = _written(max(self.size_a, self.size_b))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """Ids and ends of A, ids and ends of B; None for texts that don't come back."""
        for text, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = b" " + text.encode()
            if not text or b"".join([self.bytes_b[i] for i in ids]) != whole:
                yield None
                continue
            a, b = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), np.array(ids, np.int64)
            ends = np.cumsum(self.len_a[a])
            # A's tokens are pieces of the text in order: if none is missing, they are the text.
            yield (a, ends, b, np.cumsum(self.len_b[b])) if ends[-1] == len(whole) else None


def _written(size: int) -> np.ndarray:
    """Each id in decimal with a comma, a bar or a semicolon behind, as eight bytes."""
    if size > 10_000_000:
        raise ValueError("ids of more than seven digits")
    return np.array([f"{i}{s}" for s in ",|;" for i in range(size)], "S8").view(np.uint64)


def groups_text(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, written: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of tokens with their group numbers."""
    size, out = len(written) // 3, np.empty(len(a) + len(b), np.uint64)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = written[a + size * last_a]
    out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = written[b + 2 * size * last_b]
    flat = out.view(np.uint8)
    return flat[flat != 0].tobytes()[:-1]


def link_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and the B token of every link, in order."""
    starts = np.concatenate(([0], ends_a[:-1]))
    first, last = np.searchsorted(ends_b, starts, "right"), np.searchsorted(ends_b, ends_a)
    n = last - first + 1
    before = np.cumsum(n) - n
    return np.repeat(np.arange(len(ends_a)), n), np.arange(n.sum()) + np.repeat(first - before, n)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their numbers."""
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[at], np.diff(np.append(at, len(codes)))


def _load(byte_level: str, pieces: str) -> Tokenizers:
    from pyspark import SparkFiles

    if (byte_level, pieces) not in _loaded:
        _loaded[byte_level, pieces] = Tokenizers(SparkFiles.get(byte_level), SparkFiles.get(pieces))
    return _loaded[byte_level, pieces]


def _aligned(tokenizers: Tokenizers, texts: list[str]) -> Iterator[tuple]:
    """What ``link`` keeps of each text, from n_a on."""
    for got in tokenizers.encode(texts):
        if got is None:
            yield 0, 0, 0, 0, "", b"", b""
            continue
        a, ends_a, b, ends_b = got
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        written = groups_text(a, b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), tokenizers.written)
        at_a, at_b = link_tokens(ends_a, ends_b)
        pairs, times = _runs(np.sort((b[at_b] * tokenizers.size_a + a[at_a]).astype(tokenizers.kind)))
        yield len(a), len(b), len(cuts), len(at_a), hashlib.sha256(written).hexdigest(), pairs.tobytes(), times.astype(np.int32).tobytes()


def link(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, folder: str = TOKENIZERS) -> DataFrame:
    """row (its number), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the row's
    distinct pairs (b * size of A + a, sorted) with their occurrences as packed integers."""
    spark = docs.sparkSession
    for name in (byte_level, pieces):
        spark.sparkContext.addFile(f"file://{folder}/{name}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _load(byte_level, pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = list(zip(*_aligned(tokenizers, [t or "" for t in part.column(2).to_pylist()]), strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols, kinds)], [f.split()[0] for f in _LINKS.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(task, _LINKS)


def _sizes(byte_level: str, pieces: str, folder: str) -> tuple[int, type]:
    """The number of A's ids and the width of pairs."""
    import sentencepiece

    with open(f"{folder}/{byte_level}", encoding="utf-8") as f:
        size_a = max(json.load(f)["model"]["vocab"].values()) + 1
    size_b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{pieces}").vocab_size()
    return size_a, np.int32 if size_a * size_b < 2**31 else np.int64


def pair_counts(links: DataFrame, size_a: int, kind: type) -> DataFrame:
    """a, b, n (links corpus-wide) and best (n is the B id's highest) for every linked pair."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]], salt: int) -> pa.RecordBatch:
        pairs, n = np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts]).astype(np.int64)
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        pairs, n = pairs[at].astype(np.int64), np.add.reduceat(n, at)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n), pa.array(np.full(len(n), salt, np.int32))], ["pair", "n", "salt"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, salt = [], 0, TaskContext.get().partitionId() % SALTS
        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1), strict=True):
                if len(p.as_buffer() or b""):
                    held.append((np.frombuffer(p.as_buffer(), kind), np.frombuffer(t.as_buffer(), np.int32)))
                    size += len(held[-1][0])
            if size >= BUFFER:
                yield summed(held, salt)
                held, size = [], 0
        if held:
            yield summed(held, salt)

    sent = links.select("pairs", "times").mapInArrow(task, "pair long, n long, salt int")
    total = sent.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    total = total.select((F.col("pair") % size_a).cast("int").alias("a"), F.expr(f"cast(pair div {size_a} as int)").alias("b"), "n")
    # A window holds one B id's partners, of which there are no more than A has ids.
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _ranges(counts: DataFrame) -> list[int]:
    """First B ids of ranges that hold about SHARD pairs at most; what reaches the driver is a number per B id."""
    starts, held = [0], 0
    for b, n in sorted((r.b, r.n) for r in counts.groupBy("b").agg(F.count("*").alias("n")).collect()):
        if held and held + n > SHARD:
            starts.append(b)
            held = 0
        held += n
    return starts


def score(links: DataFrame, counts: DataFrame, size_a: int, kind: type) -> DataFrame:
    """row, n_best (links whose pair is best), count_sum (their pairs' counts added up) for rows with links."""
    spark = links.sparkSession
    starts = _ranges(counts)
    salts = max(1, -(-shuffle_partitions(spark) // len(starts)))
    names = [f.split()[0] for f in _SIDE.split(", ")]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts as packed rows, once for each salt; the sign of a count says whether it is best."""
        for batch in batches:
            a, b, n, best = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            shard = np.searchsorted(starts, b, "right") - 1
            for s in np.unique(shard).tolist():
                mine = shard == s
                pairs = (b[mine].astype(np.int64) * size_a + a[mine]).tobytes()
                times = np.where(best[mine], n[mine], -n[mine]).astype(np.int64).tobytes()
                yield pa.RecordBatch.from_pylist([{"shard": s, "salt": k, "kind": 0, "row": None, "pairs": pairs, "times": times} for k in range(salts)], _SCHEMA)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's pairs by range."""
        bounds = np.array([s * size_a for s in starts[1:]], np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row, p, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                pairs, times = np.frombuffer(p.as_buffer(), kind), np.frombuffer(t.as_buffer(), np.int32)
                for s, (i, j) in enumerate(pairwise([0, *np.searchsorted(pairs, bounds).tolist(), len(pairs)])):
                    if i < j:
                        for column, x in zip(out, (s, row % salts, 1, row, pairs[i:j].tobytes(), times[i:j].tobytes()), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by range and salt, each range's counts before the rows that ask for them."""
        now, held, known, counted = None, [], None, None
        for batch in batches:
            rows, best, total = [], [], []
            for s, k, what, row, p, t in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), batch.column(5), strict=True):
                if (s, k) != now:
                    now, held, known = (s, k), [], None
                if what == 0:
                    held.append((np.frombuffer(p.as_py(), np.int64), np.frombuffer(t.as_py(), np.int64)))
                    continue
                if known is None:
                    known, counted = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    order = np.argsort(known)
                    known, counted, held = known[order].astype(kind), counted[order], []
                n = counted[np.searchsorted(known, np.frombuffer(p.as_buffer(), kind))]
                times = np.frombuffer(t.as_buffer(), np.int32).astype(np.int64)
                rows.append(row)
                best.append(int(times[n > 0].sum()))
                total.append(int(times @ np.abs(n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rows, best, total)], ["row", "n_best", "count_sum"])

    both = counts.select("a", "b", "n", "best").mapInArrow(tables, _SIDE).unionByName(links.filter("n_links > 0").select("row", "pairs", "times").mapInArrow(pieces, _SIDE))
    ordered = both.repartition(salts * len(starts), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return ordered.mapInArrow(stream, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


_SCHEMA = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("row", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary())])


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    size_a, kind = _sizes(byte_level, pieces, folder)
    links = materialise(link(docs, byte_level, pieces, folder), "token-links")
    counts = materialise(pair_counts(links, size_a, kind), "pair-counts")
    scores = materialise(score(links, counts, size_a, kind), "pair-scores")
    discard(counts)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kept = links.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return kept.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def alignment(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, folder: str = TOKENIZERS) -> DataFrame:
    """a, b, n, best of every pair of ids that is linked anywhere in the corpus."""
    size_a, kind = _sizes(byte_level, pieces, folder)
    links = materialise(link(docs, byte_level, pieces, folder), "token-links")
    counts = materialise(pair_counts(links, size_a, kind), "pair-counts")
    discard(links)
    return counts
