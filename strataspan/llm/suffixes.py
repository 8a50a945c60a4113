"""Suffix-array dedup: removing byte strings that an earlier document has.

Every byte that lies in a string of ``WINDOW`` bytes which also starts in a document
with a smaller id is removed. Strings are judged on the input.

The suffix array is split by anchors (see ``repeats``): a shard holds the fragments of
all documents whose windows have an anchor of the shard, so equal windows meet in one
shard whatever documents they stand in. A shard's suffixes are sorted by the
difference-cover algorithm: sampled triples (positions that aren't multiples of three)
are sorted and named, the names are sorted the same way until they reach over a
window, the remaining suffixes are sorted by a byte and the rank that follows, and both
are merged. Neighbours in the merged order whose first ``WINDOW`` bytes agree are one
string, and its smallest document keeps it.

Sampling two thirds of all bytes of the corpus would move some 20 bytes per byte of
text; fragments whose anchor occurs once can't hold a repeated string and are left out
before anything is sorted.

Defined cases: null texts are empty; texts shorter than a window keep all; rows without
an id come after all others; rows of one id are judged against smaller ids only; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import HOT, Fragments, Unit, covered, ragged, repeated_spans, runs

WINDOW, GRAM = 50, 20


def _ranks(names: np.ndarray) -> np.ndarray:
    return np.unique(names, return_inverse=True)[1] + 1


def _joined(*columns: np.ndarray) -> np.ndarray:
    """Numbers in the order of the tuples of non-negative ``columns``, equal for equal
    tuples. The fields are as wide as the largest values need; where they don't fit,
    what is joined so far is replaced by its ranks."""
    out = columns[0]
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if int(out.max(initial=0)).bit_length() + bits > 63:
            out = _ranks(out)
        if int(out.max(initial=0)).bit_length() + bits > 63:
            raise ValueError("two numbers of a tuple need more than 63 bits")
        out = (out << bits) | c
    return out


def suffix_array(s: np.ndarray, depth: int, reach: int = 1) -> np.ndarray:
    """Suffixes of ``s`` (numbers from 1) in the order of their first ``depth``
    characters at least; ``reach`` is how many a number stands for."""
    n = len(s)
    if n < 6:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names = _ranks(_joined(t[sample], t[sample + 1], t[sample + 2]))
    if 3 * reach < depth and names.max() < len(names):
        order = suffix_array(names, depth, 3 * reach)
        names = np.empty(len(names), np.int64)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sampled = sample[np.argsort(names, kind="stable")]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_joined(t[rest], rank[rest + 1]), kind="stable")]

    # how many sampled suffixes come before each remaining one: of positions 1 modulo 3 by
    # a character and a rank, of positions 2 by two characters and a rank
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    lo = np.zeros(len(rest), np.int64)
    for p in (one, two):
        both = np.append(p, rest)  # joined at once, so that the numbers can be compared
        key = _joined(t[both], rank[both + 1]) if p is one else _joined(t[both], t[both + 1], rank[both + 2])
        lo += np.searchsorted(np.sort(key[: len(p)]), key[len(p) :])
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(lo) + np.arange(len(rest))  # ties reach beyond the depth in any order
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = rest, sampled
    return out


def string_numbers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows inside byte strings, in suffix order, and for each
    whether it differs from the one before it."""
    text = np.zeros(len(data) + len(starts), np.int64)  # 0 ends each string
    shifted = ragged(starts + np.arange(len(starts)), sizes)
    text[shifted] = data[ragged(starts, sizes)].astype(np.int64) + 1
    own = np.zeros(len(text), bool)
    own[ragged(starts + np.arange(len(starts)), sizes - window + 1)] = True
    order = suffix_array(text + 1, window)
    order = order[own[order]]
    rows = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), window)
    new = np.ones(len(order), bool)
    step = 1 << 15
    for a in range(1, len(order), step):
        b = min(len(order), a + step)
        block = rows[order[a - 1 : b]]
        new[a:b] = (block[1:] != block[:-1]).any(axis=1)
    return order, new


def earlier(window: int = WINDOW):
    """The engine: windows that a fragment of a smaller document holds too."""

    def engine(f: Fragments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, number = f.same()
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, number, f.doc)
        # where a key has one content only, an equal window elsewhere is an equal fragment
        _, key_no, contents = np.unique(f.key[first], return_inverse=True, return_counts=True)
        lone = contents[key_no] == 1
        least_in = least[number]
        sorted_no = np.cumsum(~lone) - 1
        f_lone = lone[number]
        i = np.flatnonzero(f.doc > least_in)  # an earlier document has the whole fragment
        whole = (i, np.zeros(len(i), np.int64), f.n[i].astype(np.int64) - 1 + window)
        if lone.all():
            return whole
        only = f.take(first[~lone])
        least = least[~lone]
        first = first[~lone]
        sizes = only.n.astype(np.int64)
        order, new = string_numbers(only.data, only.start, only.size, window)
        group = np.cumsum(new) - 1
        owner = np.repeat(np.arange(len(first)), sizes)
        where = np.full(len(only.data) + len(first), -1)
        where[ragged(only.start + np.arange(len(first)), sizes)] = np.arange(int(sizes.sum()))
        window_no = where[order]
        best = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, group, least[owner[window_no]])
        smallest = np.empty(len(window_no), np.int64)
        smallest[window_no] = best[group]

        begin = np.cumsum(sizes) - sizes
        part = np.flatnonzero((f.doc <= least_in) & ~f_lone)
        at = sorted_no[number[part]]
        n = sizes[at]
        mask = smallest[ragged(begin[at], n)] < np.repeat(f.doc[part], n)
        return tuple(np.append(x, y) for x, y in zip(whole, runs(part, mask, n, window), strict=True))

    return engine


def remove_earlier(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (``kept``) of each row."""

    def finish(text: bytes, marks: list, mine: range) -> tuple:
        cuts = covered(marks, mine.start, mine.stop, len(text))
        out, at = [], 0
        for a, b in cuts:
            out.append(text[at:a])
            at = b
        out.append(text[at:])
        kept = b"".join(out)
        return len(text), len(text) - len(kept), len(cuts), kept

    schema = "n_bytes long, n_removed long, n_spans long, kept binary"
    return repeated_spans(docs, Unit(False, window, gram), earlier(window), True, finish, schema, hot)
