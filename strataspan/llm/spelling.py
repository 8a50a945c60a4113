"""Spelling variants: words that one edit separates, grouped under the frequent form.

Every word is cut in two halves whose lengths depend on its own length alone. One
inserted, deleted or replaced code point leaves one half of the shorter word whole; in
a word of equal length it stands at the same place, in one that is longer by one the
second half is shifted by one. Halves of short words are shared by very many words, so
the half with the edit is cut in two again, and one of its parts is whole by the same
argument. A key is thus a prefix and a suffix that hold three quarters of the word; each
word is indexed under its four keys and probes its own length and the next shorter one.
No bucket is left out, and a bucket holds only words that differ inside one quarter.

Candidates are made distinct and verified by one edit of code points. A word's form is
its most frequent near word, if that is frequent enough; forms are followed to the last
one by pointer doubling, in rounds that are written to the shared folder.

Defined cases: null texts have no words; a null id enters the hash as an empty string;
repeated rows count as often as they occur; ties go to the smallest form in code-point
order; other columns are ignored; an empty table gives no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A near word is a form from this many times the word's own number on.
RATIO = 5


def words_of(docs: DataFrame, least_length: int = 6, every: int = 199) -> DataFrame:
    """word: every occurrence, A-Z lower-cased, of runs of Latin letters; where ``every``
    divides the hash of id and run, one code point is left out (planted misspellings).
    Runs below the least length can't become long enough and aren't taken up."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    raw = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    raw = raw.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = raw.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199) -> DataFrame:
    """word, n of all words with at least so many occurrences."""
    return words_of(docs, least_length, every).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _keys() -> Column:
    """The four keys of ``word`` for the indexed length ``size``: a prefix and a suffix each."""
    size, whole = F.col("size"), lambda e: F.expr(e).cast("int")
    half, q1, q3 = whole("size div 2"), whole("size div 2 div 2"), whole("(size - size div 2) div 2")
    ends = [(half + q3, F.lit(0)), (half, size - half - q3), (q1, size - half), (F.lit(0), size - q1)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.concat(_left(x), F.lit("\u0000"), _right(y)).alias("key")) for i, (x, y) in enumerate(ends)]))


def _left(n: Column) -> Column:
    return F.substring(F.col("word"), F.lit(1), n)


def _right(n: Column) -> Column:
    return F.when(n > 0, F.substring(F.col("word"), -n, n)).otherwise("")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, other: both directions of every pair of distinct words (column ``word``, one
    row each) that differ by exactly one code point inserted, deleted or replaced."""
    length = F.length("word").cast("int")
    keyed = lambda size, name: words.select("word", size.alias("size")).withColumn("k", _keys()).select(F.col("word").alias(name), "size", "k.part", "k.key")
    index = keyed(length, "short")
    probes = index.withColumnRenamed("short", "long").withColumn("shifted", F.lit(False)).unionByName(keyed(length - 1, "long").withColumn("shifted", F.lit(True)))
    met = index.join(probes, ["size", "part", "key"]).filter("shifted or short < long").select("short", "long")
    near = met.distinct().filter(F.levenshtein("short", "long", 1) == 1)
    return near.select(F.explode(F.array(F.struct(F.col("short").alias("word"), F.col("long").alias("other")), F.struct(F.col("long").alias("word"), F.col("short").alias("other")))).alias("p")).select("p.*")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, n_near of a vocabulary (word, n)."""
    near = near_pairs(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("b"))
    out = words.join(best, "word", "left")
    fits = -F.col("b.m") >= ratio * F.col("n")
    return out.select(
        "word", "n", F.when(fits, F.col("b.other")).alias("form"), F.when(fits, -F.col("b.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    )


def roots(formed: DataFrame) -> DataFrame:
    """word, root for the words that have a form. A form is more frequent than its word, so
    chains end; each round doubles the steps that a pointer takes."""
    now = materialise(formed.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        now = new


def variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, n_near, root over all documents."""
    words = materialise(vocabulary(docs, least_length, least_n, every), "spelling-words")
    formed = materialise(forms(words, ratio), "spelling-forms")
    discard(words)
    return formed.join(roots(formed), "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
