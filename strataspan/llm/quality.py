"""Rule bitmask ledger (native).

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; policies are versioned bit masks applied to it later,
and ablations are sums over the few bit patterns that occur.

Defined cases: a null text counts as empty (no words, so the word-count rule
fails); repeated rows stay separate rows; an empty table gives an empty ledger;
other columns of the input are ignored by ``ledger`` and kept by ``keep``.
Texts of any length are measured whole. Windows inside one document are compared
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Each rule: name -> condition over the measurements that means failure.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m.n_words < 50,
    "repeated_windows": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: 100 * m.n_symbols > 20 * m.word_chars,
    "duplicate_lines": lambda m: 100 * m.n_dup_lines > 50 * m.n_lines,
    "word_length": lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words),
    "shouting": lambda m: 100 * m.n_capitals > 50 * m.word_chars,
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BITS["symbols"] | BITS["duplicate_lines"],
    "v2": sum(BITS.values()),
}


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, j: F.coalesce(x.h == F.get(s, j - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, j + 1).h, F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x.i))

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda at, k: F.least(F.lit(3), F.get(p, k + 1) - at))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(ordered, starts), spread))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, 0).otherwise(let(hashes, covered)).cast("long")


def measures(text: Column) -> Column:
    """All measurements of a text as one struct."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        solid = F.translate(t, WHITE, "")
        words = F.array_remove(F.split(F.translate(t, WHITE[1:], " " * 5), " "), "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")

        def rest(w: Column) -> Column:
            return let(
                lines,
                lambda rows: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(solid).cast("long").alias("word_chars"),
                    (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                    _repeat_words(w).alias("n_repeat_words"),
                    F.size(rows).cast("long").alias("n_lines"),
                    (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
                ),
            )

        return let(words, rest)

    return let(text, of)


def failure_bits(m: Column) -> Column:
    """One bit per rule that the measurements fail."""
    flags = [F.when(rule(m), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), flags).cast("long")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, measurements and ``fail_bits``, one row per row of ``docs``."""
    (m,) = fresh(docs, "measured")
    out = docs.select(F.col(key), measures(F.col(f"`{text}`")).alias(m))
    return out.select(key, f"{m}.*", failure_bits(F.col(m)).alias("fail_bits"))


def verdicts(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    mask = POLICIES[policy]
    return ledger.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0,
    })


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that fail it
    alone and would be kept without it. The ledger is first summed by pattern,
    of which there are at most two to the number of rules."""
    mask = POLICIES[policy]
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("p")).count()
    rules = [name for name in RULES if BITS[name] & mask]
    sums = patterns.agg(*[
        F.struct(
            F.coalesce(F.sum(F.when(F.col("p").bitwiseAND(F.lit(BITS[r])) != 0, F.col("count"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("p") == BITS[r], F.col("count"))), F.lit(0)).alias("n_only"),
        ).alias(r)
        for r in rules
    ])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}.n_failed"), F.col(f"{r}.n_only")) for r in rules])).alias("x")).select("x.*")


def keep(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their own columns."""
    mask = F.lit(POLICIES[policy])
    return docs.filter(let(measures(F.col(f"`{text}`")), lambda m: failure_bits(m).bitwiseAND(mask) == 0))
