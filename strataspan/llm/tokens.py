"""Token counts kept by signed deltas.

A batch inserts, deletes or revises counts. Each change becomes a signed delta, the
deltas of a batch are summed by source, language and tokenizer version, and totals
are the sum over committed batches. A batch is staged in a folder of its own and
committed by the log's next entry, which holds the batch's name and folder. An entry is
written whole under another name and then given its number in one step, which fails where
the number is taken: of two drivers one is told that the log has moved on, looks whether its
batch's name is there by now and else computes its deltas again. So readers never see half
an entry, a name is committed once, whoever replays it and when, and a driver lost at any
point leaves only files that no reader looks at.

The store also keeps the last count of each document and tokenizer, from which
deletes and revisions take the amount to withdraw. Every ``compact`` batches both are
summed into a snapshot, which also holds the names so far, so that a commit reads one
snapshot and few entries and batches, however long the log is. A snapshot's parts stay until
the next one but one, for readers that are at work on them, and then go.

Defined cases: null texts have 0 tokens; null sources and languages form groups of
their own; rows without a doc_id are one document; inserting a document that is present
revises it; deleting or revising an absent one changes nothing; of repeated rows of one
document in a batch the largest by (not delete, source, lang, n_tokens) counts; null
counts are 0; empty batches commit an empty delta. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
GROUP = ["source", "lang", "tokenizer"]
_COUNTS = "doc_id long, tokenizer string, source string, lang string, n_tokens long, present boolean, seq long"
_DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

_loaded: dict[str, object] = {}


def load(spark_file: str, pattern: str):
    """A tiktoken encoding from a rank file that was sent with addFile, once per worker."""
    from pyspark import SparkFiles

    if spark_file not in _loaded:
        import tiktoken

        with open(SparkFiles.get(spark_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[spark_file] = tiktoken.Encoding(spark_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[spark_file]


# The pattern by which the public byte-level vocabularies split texts (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens for each row; whole texts."""
    spark = docs.sparkSession
    name = f"{tokenizer}.tiktoken"
    spark.sparkContext.addFile(f"file://{folder}/{name}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(name, PATTERN).encode_ordinary
        for batch in batches:
            counts = [len(encode(t.as_py() or "")) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = rows.mapInArrow(task, "doc_id long, source string, lang string, n_tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_tokens")


class TokenTotals:
    """A store of counts and totals under one folder."""

    def __init__(self, spark: SparkSession, root: str, compact: int = 16) -> None:
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _entries(self, log: str, since: int = 0) -> list[dict]:
        """The entries of a log from a number on, in order."""
        at = self._path(f"{self.root}/{log}")
        if not self._fs.exists(at):
            return []
        names = sorted(n for s in self._fs.listStatus(at) if (n := s.getPath().getName()).isdigit() and int(n) >= since)
        return [self._entry(f"{log}/{n}") for n in names]

    def _entry(self, name: str) -> dict:
        opened = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def _create(self, log: str, number: int, entry: dict) -> bool:
        """Whether this call made the entry, which nobody can make twice or see in part."""
        jvm = self.spark._jvm
        whole, place = self._path(f"{self.root}/{log}/_{uuid.uuid4().hex}"), self._path(f"{self.root}/{log}/{number:08d}")
        out = self._fs.create(whole, False)
        out.write(json.dumps(entry).encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # renaming replaces files there, linking doesn't
                local = [jvm.java.io.File(self._fs.makeQualified(p).toUri().getPath()).toPath() for p in (place, whole)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(self._fs.makeQualified(whole), self._fs.makeQualified(place), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self._fs.delete(whole, False)

    def _state(self) -> tuple[dict | None, list[dict]]:
        """The last snapshot, and the entries after it."""
        at = self._path(f"{self.root}/snapshots")
        numbers = [int(n) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).isdigit()] if self._fs.exists(at) else []
        snapshot = self._entry(f"snapshots/{max(numbers):08d}") if numbers else None
        return snapshot, self._entries("log", snapshot["upto"] if snapshot else 0)

    def batches(self) -> list[str]:
        """Names of the committed batches, in order of commit."""
        snapshot, entries = self._state()
        return (snapshot["names"] if snapshot else []) + [e["name"] for e in entries]

    def _parts(self, kind: str, schema: str, state: tuple[dict | None, list[dict]]) -> DataFrame:
        """The rows of the last snapshot and of the batches after it."""
        snapshot, entries = state
        paths = [f"{e['data']}/{kind}" for e in ([snapshot] if snapshot else []) + entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _last(self, state: tuple[dict | None, list[dict]]) -> DataFrame:
        last = F.max(F.struct("seq", "present", "source", "lang", "n_tokens")).alias("x")
        return self._parts("counts", _COUNTS, state).groupBy("doc_id", "tokenizer").agg(last).filter("x.present")

    def _sums(self, state: tuple[dict | None, list[dict]]) -> DataFrame:
        sums = self._parts("deltas", _DELTAS, state).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 or n_tokens != 0")

    def counts(self) -> DataFrame:
        """The last known count of each document and tokenizer."""
        return self._last(self._state()).select("doc_id", "tokenizer", "x.source", "x.lang", "x.n_tokens")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._sums(self._state())

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Apply changes (doc_id, tokenizer, op in insert/delete/revise; source, lang and
        n_tokens but for deletes). False if a batch of this name is committed."""
        while True:
            state = self._state()
            names = (state[0]["names"] if state[0] else []) + [e["name"] for e in state[1]]
            if name in names:
                return False
            stage = f"{self.root}/data/{uuid.uuid4().hex}"
            self._stage(stage, changes, state, len(names))
            if self._create("log", len(names), {"name": name, "data": stage}):
                break
            self._fs.delete(self._path(stage), True)
        if (len(names) + 1) % self.compact == 0:
            self._snapshot()
        return True

    def _stage(self, stage: str, changes: DataFrame, state: tuple[dict | None, list[dict]], number: int) -> None:
        """Write the new counts and the deltas of the batch with this number."""
        best = F.max(F.struct(F.col("op") != "delete", F.col("source"), F.col("lang"), F.col("n_tokens"), F.col("op"))).alias("n")
        new = changes.groupBy("doc_id", "tokenizer").agg(best)
        old = self._last(state).select(F.col("doc_id").alias("old_id"), F.col("tokenizer").alias("old_tokenizer"), "x")
        both = new.join(old, F.col("doc_id").eqNullSafe(F.col("old_id")) & (F.col("tokenizer") == F.col("old_tokenizer")), "left")
        both = both.filter("n.op = 'insert' or x is not null")
        keeps = F.col("n.op") != "delete"
        either = lambda c: F.when(keeps, F.col(f"n.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
        both.select(
            "doc_id", "tokenizer", either("source"), either("lang"), F.coalesce(either("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"), keeps.alias("present"),
            F.lit(number).cast("long").alias("seq"), F.col("x.source").alias("old_source"), F.col("x.lang").alias("old_lang"), F.col("x.n_tokens").alias("old_tokens"),
        ).write.parquet(f"{stage}/counts")
        written = self.spark.read.schema(_COUNTS + ", old_source string, old_lang string, old_tokens long").parquet(f"{stage}/counts")
        plus = F.struct("source", "lang", F.lit(1).alias("d"), F.col("n_tokens").alias("n"))
        minus = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).alias("d"), (-F.col("old_tokens")).alias("n"))
        signed = F.filter(F.array(F.when(F.col("present"), plus), F.when(F.col("old_tokens").isNotNull(), minus)), lambda x: x.isNotNull())
        rows = written.select("tokenizer", F.explode(signed).alias("s")).select("s.source", "s.lang", "tokenizer", "s.d", "s.n")
        sums = rows.groupBy(*GROUP).agg(F.sum("d").alias("n_docs"), F.sum("n").alias("n_tokens"))
        sums.filter("n_docs != 0 or n_tokens != 0").coalesce(1).write.parquet(f"{stage}/deltas")

    def _snapshot(self) -> None:
        """Sum up all batches so far; one that another driver has made already is left alone."""
        state = self._state()
        before, entries = state
        names = (before["names"] if before else []) + [e["name"] for e in entries]
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        counts = self._last(state).select("doc_id", "tokenizer", "x.source", "x.lang", "x.n_tokens", "x.present", "x.seq")
        counts.write.parquet(f"{at}/counts")
        self._sums(state).write.parquet(f"{at}/deltas")
        parts = [e["data"] for e in ([before] if before else []) + entries]
        if not self._create("snapshots", len(names), {"upto": len(names), "data": at, "names": names, "parts": parts}):
            self._fs.delete(self._path(at), True)
            return
        for old in before["parts"] if before else []:
            self._fs.delete(self._path(old), True)
