"""Substring dedup: removing passages that recur, found by automata.

Every word that lies in a window of ``WINDOW`` consecutive words whose sequence also
starts anywhere else, in the same document or another, is removed. Windows are judged
on the input.

Fragments of documents whose anchor recurs meet in the shard of the anchor (see
``repeats``). A shard numbers the words of its fragments and proposes the windows whose
hash it meets twice. They are compiled into an Aho-Corasick automaton over word numbers,
and all fragments are streamed through it. Its hits, which are equal word by word, are
counted: a window with two hits or more is confirmed, and the places of its hits are the
words that go. An automaton is built for about a megabyte of text at a time and dropped
again. Fragments that are equal byte by byte are streamed once and share the result.

Defined cases: null texts have no words; texts with fewer words than a window keep all;
repeated rows recur; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .kernel import byte_table, rolling
from .repeats import HOT, Fragments, Unit, covered, repeated_spans, runs

WINDOW, GRAM = 35, 8
_SPACES = bytes(i for i in range(256) if not byte_table(False, False)[0][i])
_BLANK = bytes(0x20 if i in _SPACES else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_BLANK).split(b" ") if w]


def compile_passages(sequences: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    """An automaton over word numbers; a hit's value is the passage's place in the list."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for i, s in enumerate(sequences):
        automaton.add_word(s, i)
    automaton.make_automaton()
    return automaton


def recurring(window: int = WINDOW):
    """The engine: windows that occur twice or more."""

    def engine(f: Fragments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, number = f.same()
        times = np.bincount(number, f.times)
        only = f.take(first)
        vocabulary: dict[bytes, int] = {}
        raw, texts = only.data.tobytes(), []
        for a, b in zip(only.start.tolist(), (only.start + only.size).tolist(), strict=True):
            texts.append(tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(raw[a:b])))
        sizes = only.n.astype(np.int64)
        lengths = sizes + window - 1
        flat = np.fromiter((w for t in texts for w in t), np.uint64, int(lengths.sum()))
        base = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), sizes)
        offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = rolling(flat * np.uint64(0x9E3779B97F4A7C15), window)[base[owner] + offset]
        _, at, group = np.unique(codes, return_index=True, return_inverse=True)
        proposed = at[np.bincount(group, times[owner]) > 1]
        mask = np.zeros(int(sizes.sum()), bool)
        if len(proposed):
            automaton = compile_passages([texts[o][k : k + window] for o, k in zip(owner[proposed].tolist(), offset[proposed].tolist(), strict=True)])
            edge = (np.cumsum(sizes) - sizes).tolist()
            hits = [(e + end - window + 1, passage) for e, t in zip(edge, texts, strict=True) for end, passage in automaton.iter(t)]
            place, passage = np.array(hits, np.int64).reshape(-1, 2).T
            confirmed = np.bincount(passage, times[owner[place]], len(proposed)) > 1
            mask[place[confirmed[passage]]] = True
        i, a, b = runs(np.arange(len(texts)), mask, sizes, window)
        # from contents to all fragments that have them
        order = np.argsort(number, kind="stable")
        counts = np.bincount(number, minlength=len(texts))
        begin = np.cumsum(counts) - counts
        n = counts[i]
        ends = np.cumsum(n)
        pick = np.repeat(begin[i] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)
        return order[pick], np.repeat(a, n), np.repeat(b, n)

    return engine


def remove_recurring(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and the remaining words joined by a space (``kept``, UTF-8) of each row."""

    def finish(text: bytes, marks: list, mine: range) -> tuple:
        words = words_of(text)
        kept, at = [], 0
        for a, b in covered(marks, mine.start, mine.stop, len(words)):
            kept += words[at:a]
            at = b
        kept += words[at:]
        return len(words), len(words) - len(kept), b" ".join(kept)

    return repeated_spans(docs, Unit(True, window, gram), recurring(window), False, finish, "n_words long, n_removed long, kept binary", hot)
