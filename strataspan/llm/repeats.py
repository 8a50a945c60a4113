"""Finding repeated windows: anchors, candidates and fragments by anchor.

A window is W consecutive units (bytes or words) of a text. Its anchor is the run of
K units inside it whose hash is smallest, so equal windows have equal anchors at equal
distances, and neighbouring windows mostly share one. The windows of a text that share
an anchor form a fragment. The stages are

1. every fragment's key (the anchor's hash) goes to a bucket; keys that occur once
   can't hold a repeated window and end there;
2. the fragments of repeated keys, with their content, go to the bucket of their key,
   where all equal windows therefore meet, and an engine decides which windows count;
3. the spans of those windows go back to their texts.

A key with more than ``HOT`` fragments, such as the anchor of a passage in a third of all
texts with ever new surroundings, isn't left to one bucket: every task is told of it and
deals each of the key's windows by the hash of the whole window instead.

Numbers travel in packed columns, one row per task and bucket. What a task has seen
twice it sends once, so that a passage in a third of all texts costs its bucket a
record per task, not one per text.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release, shuffle_partitions
from .kernel import _BYTE_VALUES, _BYTES, Words, column_bytes, mix, rolling, slices, sliding_min_positions

SCAN_BYTES, SEND_BYTES = 8 << 20, 3 << 20  # what a task holds before it sends
HOT = 20_000  # fragments of a key from which on its windows are dealt one by one
LAST_ID = (1 << 63) - 1
_U = np.uint64


def pack(*columns: np.ndarray) -> bytes:
    """Equally long columns as one compressed string, byte plane by byte plane."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T).tobytes() for c in columns) if n else b""
    return struct.pack("<q", n) + zstandard.ZstdCompressor(1).compress(planes)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def byte_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of byte strings inside ``data``."""
    up, down = _BYTES.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.multiply(_BYTE_VALUES[data], up[: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(_U))


@dataclass
class Unit:
    """What a window is made of: bytes, or words as runs without white space."""

    words: bool
    window: int
    gram: int

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, first unit of each text (one more than texts), starts and ends of units, and gram hashes."""
        if self.words:
            w = Words(texts)
            return w.data, w.first, w.starts, w.ends, w.windows(self.gram)
        data, offsets = column_bytes(texts)
        at = np.arange(len(data) + 1)
        n = len(data) - self.gram + 1
        grams = byte_hashes(data, at[:n], np.full(n, self.gram)) if n > 0 else np.zeros(0, _U)
        return data, offsets, at[:-1], at[1:], grams

    def window_hashes(self, texts: pa.Array) -> np.ndarray:
        """Hash of the window from each unit on; only meaningful where it ends within the text."""
        if self.words:
            return Words(texts).windows(self.window)
        data, _ = column_bytes(texts)
        n = max(0, len(data) - self.window + 1)
        return byte_hashes(data, np.arange(n), np.full(n, self.window))

    def fragments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, text, first window and number of windows of each fragment."""
        _, first, _, _, grams = self.of(texts)
        at = sliding_min_positions(grams, self.window - self.gram + 1)
        counts = np.maximum(np.diff(first) - self.window + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        start = ragged(first[:-1], counts)
        at = at[start]
        new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        sizes = np.diff(np.append(new, len(at)))
        return grams[at[new]] >> _U(16), row[new], start[new] - first[row[new]], sizes


@dataclass
class Fragments:
    """Fragments of one bucket: numbers, and contents one after the other."""

    key: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    lo: np.ndarray  # first window, in units of the text
    n: np.ndarray  # windows
    times: np.ndarray  # 2 if its task has seen the content more than once
    size: np.ndarray  # bytes
    data: np.ndarray
    start: np.ndarray = field(init=False)

    KINDS = (np.uint64, np.int64, np.int64, np.uint32, np.uint16, np.uint8, np.uint32)

    def __post_init__(self) -> None:
        self.size = self.size.astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def take(self, which: np.ndarray) -> Fragments:
        data = self.data[ragged(self.start[which], self.size[which])]
        return Fragments(*(c[which] for c in (self.key, self.doc, self.row, self.lo, self.n, self.times, self.size)), data)

    def pack(self) -> bytes:
        head = pack(*(c.astype(k) for c, k in zip((self.key, self.doc, self.row, self.lo, self.n, self.times, self.size), self.KINDS, strict=True)))
        return struct.pack("<q", len(head)) + head + pack(self.data)

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Fragments:
        """Takes the blobs off the list."""
        parts = []
        while blobs:
            b = blobs.pop()
            (size,) = struct.unpack_from("<q", b)
            parts.append([*unpack(b[8 : 8 + size], *cls.KINDS), *unpack(b[8 + size :], np.uint8)])
        columns = [list(c) for c in zip(*parts, strict=True)]
        parts.clear()
        return cls(*(np.concatenate(columns.pop(0)) for _ in range(len(columns))))

    def same(self) -> tuple[np.ndarray, np.ndarray]:
        """A fragment of each content, and for each fragment the number of its content.
        Fragments of one hash are compared byte by byte; one that differs is a content of its own."""
        code = mix(byte_hashes(self.data, self.start, self.size) ^ (self.key * _U(0x9E3779B97F4A7C15)) ^ self.n.astype(_U))
        _, first, number = np.unique(code, return_index=True, return_inverse=True)
        other = first[number]
        alone = (self.size != self.size[other]) | (self.key != self.key[other]) | (self.n != self.n[other])
        sizes = np.where(alone, 0, self.size)
        unequal = np.append(0, np.cumsum(self.data[ragged(self.start, sizes)] != self.data[ragged(self.start[other], sizes)]))
        ends = np.cumsum(sizes)
        alone |= unequal[ends] > unequal[ends - sizes]
        which = np.flatnonzero(alone)
        number[which] = len(first) + np.arange(len(which))
        return np.append(first, which), number


Engine = Callable[[Fragments], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _rows(kind: int, number: np.ndarray, blob_of: Callable[[np.ndarray], bytes]) -> pa.RecordBatch:
    """A row for each partition: what is dealt to it."""
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order], prepend=-1))
    groups = np.split(order, cuts[1:]) if len(order) else []
    dealt = [int(number[g[0]]) for g in groups]
    return pa.RecordBatch.from_arrays(
        [pa.array(dealt, pa.int32()), pa.array([kind] * len(groups), pa.int32()), pa.array([blob_of(g) for g in groups], pa.binary())], ["to", "kind", "blob"]
    )


_ROWS = "to int, kind int, blob binary"
_CANDIDATE = (np.int64, np.uint64, np.uint32, np.uint16)  # row, key, first window, windows


def _candidate_rows(to: int, row: np.ndarray, key: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return _rows(1, np.mod(row, to), lambda g: pack(*(c[g].astype(k) for c, k in zip((row, key, lo, n), _CANDIDATE, strict=True))))


def _keyed(docs: DataFrame) -> DataFrame:
    """row (a key of id and text), doc (null ids come last), text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc, text).alias("row"), F.coalesce(doc, F.lit(LAST_ID)).alias("doc"), text.cast("binary").alias("text"))


def _candidates(docs: DataFrame, unit: Unit, to: int, across: bool, hot: int) -> DataFrame:
    """Fragments whose key occurs again (in another row, with ``across``), by the partition of their row,
    and to all partitions the keys with more than ``hot`` fragments."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, row, lo, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((row, key))
            key, row, lo, n = key[order], row[order], lo[order], n[order]
            first = np.diff(key, prepend=key[:1] + _U(1)) != 0
            group = np.cumsum(first) - 1
            many = np.bincount(group) > 1
            if across:
                new_row = first | (np.diff(row, prepend=row[:1]) != 0)
                many &= np.bincount(group, new_row) > 1
            local = many[group]
            if local.any():
                yield _candidate_rows(to, row[local], key[local], lo[local], n[local])
            # of keys that are repeated here one record goes on, of others all (of one row)
            sent = ~local | first
            kinds = (np.uint64, np.int64, np.uint32, np.uint16, np.uint32)
            known = np.where(local, np.bincount(group)[group], 0)
            cols = [c[sent] for c in (key, row, lo, n, known)]
            yield _rows(0, cols[0] % _U(to), lambda g: pack(*(c[g].astype(k) for c, k in zip(cols, kinds, strict=True))))

        for batch in batches:
            for part in slices(batch, 1):
                key, r, lo, n = unit.fragments(part.column(1))
                if len(key):
                    held.append((key, part.column(0).to_numpy(zero_copy_only=False)[r], lo, n))
                size += part.column(1).nbytes
                if size >= SCAN_BYTES and held:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for at, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], ["to", "kind", "blob"])
                else:
                    parts.append(unpack(blob, np.uint64, np.int64, np.uint32, np.uint16, np.uint32))
        if not parts:
            return
        key, row, lo, n, known = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((row, key))
        key, row, lo, n, known = key[order], row[order], lo[order], n[order], known[order]
        first = np.diff(key, prepend=key[:1] + _U(1)) != 0
        group = np.cumsum(first) - 1
        many = np.bincount(group) > 1
        if across:
            many &= (np.bincount(group, first | (np.diff(row, prepend=row[:1]) != 0)) > 1) | (np.bincount(group, known) > 0)
        take = many[group] & (known == 0)
        if take.any():
            yield _candidate_rows(to, row[take], key[take], lo[take], n[take])
        crowd = np.bincount(group, np.maximum(known, 1)) > hot
        if crowd.any():
            news = pack(key[first][crowd])
            yield pa.RecordBatch.from_arrays([pa.array(range(to), pa.int32()), pa.nulls(to, pa.int32()).fill_null(3), pa.array([news] * to, pa.binary())], ["to", "kind", "blob"])

    sent = docs.select("row", "text").mapInArrow(send, _ROWS)
    return sent.repartitionById(to, "to").mapInArrow(repeated, _ROWS)


def _dealt(docs: DataFrame, marks: DataFrame, to: int) -> DataFrame:
    """Marks and texts by partition, marks first."""
    texts = docs.select(F.pmod("row", F.lit(to)).cast("int").alias("to"), F.lit(4).alias("kind"), F.col("text").alias("blob"), "row", "doc")
    marks = marks.withColumns({"row": F.lit(None).cast("long"), "doc": F.lit(None).cast("long")})
    return marks.unionByName(texts).repartitionById(to, "to").sortWithinPartitions("kind")


def _with_marks(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Slices of texts (columns to, kind, blob, row, doc) with all marks by row, and the range of each
    text's marks. News of hot keys follow the marks as one more array."""
    held, news, marks = [], [], None
    for batch in batches:
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(kind < 4):
            blob = batch.column(2)[int(i)].as_py()
            if kind[i] == 3:
                news += unpack(blob, np.uint64)
            else:
                held.append(unpack(blob, *kinds))
        texts = batch.slice(int((kind < 4).sum()))
        if not texts.num_rows:
            continue
        if marks is None:
            marks = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, k) for k in kinds]
            order = np.argsort(marks[0], kind="stable")
            marks = [*(m[order] for m in marks), np.concatenate([*news, np.zeros(0, _U)])]
            held.clear()
        for part in slices(texts, 2):
            row = part.column(3).to_numpy(zero_copy_only=False)
            yield part, marks, np.searchsorted(marks[0], row), np.searchsorted(marks[0], row, "right")


def _spans(docs: DataFrame, found: DataFrame, unit: Unit, to: int, engine: Engine, smaller: bool) -> DataFrame:
    """Spans (row, start, end in units) of the windows that an engine picks, by the partition of their row."""
    span_rows = lambda row, a, b: _rows(1, np.mod(row, to), lambda g: pack(row[g], a[g].astype(np.uint32), b[g].astype(np.uint32)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            f = Fragments(*(np.concatenate(c) for c in zip(*held, strict=True)))
            order = np.lexsort((f.row, f.doc))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            _, number = f.same()
            least = np.full(int(number.max()) + 1, len(order))
            np.minimum.at(least, number, rank)
            keeper = order[least][number]  # the fragment of this content in the first text
            again = keeper != np.arange(len(keeper))
            decided = again & (f.doc[keeper] < f.doc) if smaller else again
            if not smaller:
                f.times[keeper[again]] = 2
            if decided.any():
                yield span_rows(f.row[decided], f.lo[decided], f.lo[decided] + f.n[decided] - 1 + unit.window)
            kept = np.flatnonzero(~decided)
            bucket = f.key[kept] % _U(to)
            yield _rows(0, bucket, lambda g: f.take(kept[g]).pack())

        for part, marks, a, b in _with_marks(batches, *_CANDIDATE):
            mine = ragged(a, b - a)
            if len(mine):
                r = np.repeat(np.arange(len(a)), b - a)
                data, first, starts, ends, _ = unit.of(part.column(2)) if unit.words else (*column_bytes(part.column(2)), None, None, None)
                key, lo, n = marks[1][mine], marks[2][mine].astype(np.int64), marks[3][mine].astype(np.int64)
                hot = np.isin(key, marks[4])
                if hot.any():  # a fragment of one window each, dealt by the window
                    times = np.where(hot, n, 1)
                    r, key, n, hot = (np.repeat(c, times) for c in (r, key, np.where(hot, 1, n), hot))
                    lo = ragged(lo, times)
                    key[hot] = unit.window_hashes(part.column(2))[(first[r] + lo)[hot]] >> _U(16)
                u, v = first[r] + lo, first[r] + lo + n - 1 + unit.window
                begin, end = (starts[u], ends[v - 1]) if unit.words else (u, v)
                row, doc = (part.column(c).to_numpy(zero_copy_only=False)[r] for c in (3, 4))
                held.append((key, doc, row, lo, n, np.ones(len(r), np.uint8), end - begin, data[ragged(begin, end - begin)]))
                size += int((end - begin).sum()) + 40 * len(r)
            if size >= SEND_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            for at, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], ["to", "kind", "blob"])
                else:
                    blobs.append(blob)
        if not blobs:
            return
        f = Fragments.unpack(blobs)
        order = np.argsort(f.key, kind="stable")
        # parts of about a megabyte; fragments of one key stay together
        edge = np.flatnonzero(np.diff(f.key[order], prepend=f.key[order[:1]] + _U(1)) != 0)
        volume = (np.cumsum(f.size[order]) >> 20)[edge]
        cuts = edge[np.flatnonzero(np.diff(volume, prepend=-1))]
        for which in np.split(order, cuts[1:]):
            part = f.take(which)
            i, a, b = engine(part)
            if len(i):
                yield span_rows(part.row[i], part.lo[i] + a, part.lo[i] + b)

    sent = _dealt(docs, found, to).mapInArrow(send, _ROWS)
    return sent.repartitionById(to, "to").mapInArrow(decide, _ROWS)


def runs(fragment: np.ndarray, mask: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragment, start and end (units from its first window) of runs of picked windows,
    where ``mask`` holds ``sizes`` windows for each fragment."""
    edge = np.cumsum(sizes) - sizes
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    opens[edge] |= mask[edge]
    last = edge + sizes - 1
    closes[last] |= mask[last]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[a]
    return fragment[owner], a - edge[owner], b - edge[owner] + window


def covered(marks: list[np.ndarray], a: int, b: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs of units inside the spans marks[a:b] of a text of n units."""
    if a == b:
        return []
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, marks[1][a:b], 1)
    np.add.at(change, marks[2][a:b], -1)
    inside = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_spans(docs: DataFrame, unit: Unit, engine: Engine, across: bool, finish: Callable[[bytes, np.ndarray | None, list], tuple], schema: str, hot: int = HOT) -> DataFrame:
    """``finish`` of each text's bytes and its spans that an engine picked.

    docs has doc_id and text; ``across`` says that only windows of texts with smaller ids
    count. The result has doc_id and the columns of ``schema``."""
    spark = docs.sparkSession
    to = shuffle_partitions(spark)
    keyed = _keyed(docs)
    found = materialise(_candidates(keyed, unit, to, across, hot), "candidates")
    release(spark)
    spans = materialise(_spans(keyed, found, unit, to, engine, across), "spans")
    discard(found)
    release(spark)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.uint32, np.uint32)
        for part, marks, a, b in _with_marks(batches, *kinds):
            texts = part.column(2).to_pylist()
            rows = [finish(t, marks, range(x, y)) for t, x, y in zip(texts, a.tolist(), b.tolist(), strict=True)]
            names = [c.split()[0] for c in schema.split(", ")]
            types = {"long": pa.int64(), "binary": pa.binary()}
            cols = [pa.array(c, types[k.split()[1]]) for c, k in zip(zip(*rows, strict=True), schema.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(4), *cols], ["doc", *names])

    out = _dealt(keyed, spans, to).mapInArrow(end, "doc long, " + schema)
    return out.withColumn("doc_id", F.when(F.col("doc") != LAST_ID, F.col("doc"))).drop("doc")
