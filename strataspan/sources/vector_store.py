"""Collections of chunks with vectors in one Parquet folder (see schemas.CHUNK)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import vector_search
from ..schemas import CHUNK


class VectorStore:
    """Upserts append a batch with a number; readers see the last batch of each
    (collection, id), so no file is rewritten. ``compact`` folds batches into one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _all(self) -> DataFrame:
        schema = CHUNK + ", batch long, gone boolean"
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.root)

    def rows(self, collection: str | None = None) -> DataFrame:
        all_ = self._all() if collection is None else self._all().filter(F.col("collection") == collection)
        last = all_.groupBy("collection", "id").agg(F.max_by(F.struct("text", "metadata", "embedding", "gone"), "batch").alias("x"))
        return last.filter("not x.gone").select("collection", "id", "x.text", "x.metadata", "x.embedding")

    def upsert(self, collection: str, chunks: DataFrame, gone: bool = False) -> None:
        """id, text, metadata, embedding; of repeated ids in a batch the largest row counts."""
        number = (self._all().agg(F.max("batch")).first()[0] or 0) + 1
        one = chunks.groupBy("id").agg(F.max_by(F.struct("text", "metadata", "embedding"), F.struct(F.coalesce("text", F.lit("")))).alias("x"))
        one.select(F.lit(collection).alias("collection"), "id", "x.*", F.lit(number).cast("long").alias("batch"), F.lit(gone).alias("gone")).write.mode("append").parquet(self.root)

    def delete(self, collection: str, ids: DataFrame) -> None:
        none = ids.select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"))
        self.upsert(collection, none, gone=True)

    def count(self, collection: str) -> int:
        return self.rows(collection).count()

    def documents(self, collection: str) -> DataFrame:
        return self.rows(collection).select("id", "text", "metadata").orderBy("id")

    def reset(self, collection: str) -> None:
        self.delete(collection, self.rows(collection).select("id"))

    def search(self, collection: str, queries: DataFrame, k: int, metadata: dict[str, str] | None = None) -> DataFrame:
        """query_id, id, score, rank; metadata values must all be equal."""
        where: Column | None = None
        for key, value in (metadata or {}).items():
            test = F.col("metadata")[F.lit(key)] == value
            where = test if where is None else where & test
        rows = self.rows(collection).withColumnRenamed("id", "vec_id")
        return vector_search(rows, queries, k, where).withColumnRenamed("vec_id", "id")

    def compact(self, to: str) -> VectorStore:
        """A store at another root with one batch."""
        self.rows().select("*", F.lit(1).cast("long").alias("batch"), F.lit(False).alias("gone")).write.parquet(to)
        return VectorStore(self.spark, to)

    def add(self, collection: str, chunks: DataFrame) -> None:
        """Chunks whose ids are new; ids that the collection has keep their rows."""
        self.upsert(collection, chunks.join(self.rows(collection).select("id"), "id", "left_anti"))

    def migrate(self, to: VectorStore) -> DataFrame:
        """collection, n of all collections copied into another store; raises where the counts differ."""
        for (name,) in self.rows().select("collection").distinct().toLocalIterator():
            to.upsert(name, self.rows(name).drop("collection"))
        here, there = (s.rows().groupBy("collection").agg(F.count("*").alias(n)) for s, n in ((self, "n"), (to, "arrived")))
        both = here.join(there, "collection", "left")
        lost = both.filter("arrived is null or arrived <> n").first()
        if lost is not None:
            raise ValueError(f"{lost['n']} rows of {lost['collection']} gave {lost['arrived']}")
        return both.select("collection", "n")
