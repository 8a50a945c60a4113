"""Vectorised word hashing over Arrow string columns.

A batch of texts is looked at as one byte array. Words are found by a byte
table, and hashes of words and of runs of words come from prefix sums of
``value * odd_power`` modulo 2**64, so no Python object is made per word.
Slices of a batch keep the working arrays small, whatever a batch holds; a
single text is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def byte_table(letters_only: bool, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is part of a word, byte after lower-casing A-Z), by byte. Words are runs
    without white space, or with ``letters_only`` runs of ASCII letters, digits
    and everything beyond ASCII."""
    b = np.arange(256)
    if letters_only:
        inside = ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    else:
        inside = ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    folded = b.astype(np.uint8)
    if lower:
        folded[0x41:0x5B] += 0x20
    return inside, folded


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, or one longer text."""
    _, offsets = column_bytes(batch.column(text))
    first, n = 0, batch.num_rows
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, end - first)
        first = end


class Words:
    """Words of a slice of texts: ``starts``/``ends`` (bytes), ``first`` (index of
    each text's first word, one more than texts) and ``hashes``."""

    def __init__(self, texts: pa.Array, letters_only: bool = False, lower: bool = False) -> None:
        inside, folded = byte_table(letters_only, lower)
        self.data, self.offsets = column_bytes(texts)
        n = len(self.data)
        flags = np.zeros(n + 1, bool)
        flags[:n] = inside[self.data]
        opens, closes = flags[:n].copy(), flags[:n].copy()
        opens[1:] &= ~flags[: n - 1] if n else False
        closes &= ~flags[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        opens[cuts] = flags[cuts]
        closes[cuts - 1] = flags[cuts - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        up, down = _BYTES.of(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTE_VALUES[folded[self.data] if lower else self.data] * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(_U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only meaningful where they end within the text."""
        return rolling(self.hashes, k)

    def whole(self, row: int, k: int) -> np.ndarray:
        """Valid window starts of a text, as positions in ``windows(k)``."""
        return np.arange(self.first[row], max(self.first[row], self.first[row + 1] - k + 1))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of values[i:i+k] for each i with i + k <= len(values)."""
    n = len(values)
    if n < k:
        return np.zeros(0, _U)
    up, down = _WORDS.of(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1] + _U(k))


def sliding_min_positions(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the position of its smallest value, the last of equal ones."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = values.copy(), np.arange(len(values)), 1
    # doubling: after each step best[i] covers values[i : i + have]
    while have < w:
        step = min(have, w - have)
        m = len(values) - (have + step) + 1
        left, right = best[:m], best[step : step + m]
        take = right <= left
        at = np.where(take, at[step : step + m], at[:m])
        best = np.where(take, right, left)
        have += step
    return at[:n]
