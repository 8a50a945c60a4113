"""An approximate vector index: every vector is stored under the centre it is nearest to.

Centres are fitted on a sample of at most ``sample`` vectors (those with the smallest hash of
their id, so the sample is the same each time), which is all that reaches the driver. There
are as many as the square root of the number of vectors, ``MOST_CENTRES`` at most. A search
looks into the cells nearest to a query; how many is measured on the sample when the index
is built, so that ``RECALL`` of the true neighbours lie in them. A cell's vectors and its queries are
dealt to parts of bounded size that meet each other in blocks, so a hot cell is many tasks.

Defined cases: null vectors and zero vectors aren't indexed and find nothing; rows that
repeat an id stay rows; with ``probes`` as large as the number of centres the search is exact;
an empty index finds nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import matrix, rank_by
from ..storage import materialise

MOST_CENTRES, ROUNDS, RECALL = 4096, 12, 0.96
PART, QUERIES = 20_000, 5_000  # vectors and queries that meet in one task at most, about


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_centres(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Centres by repeated assignment and averaging of unit vectors; empty ones start again at the worst served vector."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        scores = x @ centres.T
        own = scores.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        sums[empty] = x[np.argsort(scores.max(1))[: len(empty)]]
        centres = _unit(sums)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, share: float = RECALL, k: int = 10, asked: int = 1000) -> int:
    """How many of the nearest cells hold this share of the sample's neighbours in the sample."""
    x = _unit(sample)
    q = x[:asked]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    needed = np.sort(np.take_along_axis(place, (x @ centres.T).argmax(1)[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))))]) + 1


class VectorIndex:
    """Cells and centres under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, sample: int = 20_000) -> None:
        """Indexes vectors (vec_id, embedding), all of the same length."""
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropna()
        rows = rows.filter(F.exists("embedding", lambda v: v != 0))
        n = rows.count()
        seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
        k = max(1, min(MOST_CENTRES, round(n**0.5), len(seen)))
        centres = fit_centres(matrix(seen), k) if n else np.zeros((0, 0))
        probes = probes_for(matrix(seen), centres) if n else 1
        self.spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")
        placed = rows.withColumn("cell", F.element_at(self._nearest(centres, 1)(F.col("embedding")), 1))
        placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors")

    def centres(self) -> tuple[np.ndarray, int]:
        """The centres, and the number of cells to look into."""
        rows = self.spark.read.schema("cell int, centre array<double>, probes int").parquet(f"{self.root}/centres").orderBy("cell").collect()  # MOST_CENTRES rows at most
        return np.array([r.centre for r in rows]), rows[0].probes if rows else 1

    @staticmethod
    def _nearest(centres: np.ndarray, probes: int):
        """A function of vectors that gives the cells of their nearest centres."""

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            scores = np.stack(v.to_numpy()) @ centres.T
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        return nearest

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, vec_id, score, rank: by cosine, for queries (query_id, embedding), among
        the vectors of the ``probes`` nearest cells (as many as the index has measured where not given)."""
        centres, measured = self.centres()
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id long, score double"
        if not len(centres):
            return rank_by(self.spark.createDataFrame([], kinds), k, F.desc("score"))
        probes = min(len(centres), probes or measured)
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).dropna().filter(F.exists("embedding", lambda v: v != 0))
        asked = materialise(asked.select("query_id", "embedding", F.explode(self._nearest(centres, probes)(F.col("embedding"))).alias("cell")), "vector-asked")
        stored = self.spark.read.parquet(f"{self.root}/vectors")
        parts = stored.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("turns")), "cell")
        parts = materialise(parts, "vector-parts")
        mine = stored.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
        theirs = asked.join(parts, "cell").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

        def meet(vectors: pa.Table, asked_here: pa.Table) -> pa.Table:
            x, q = (_unit(matrix(t.column("embedding").combine_chunks())) if t.num_rows else np.zeros((0, 1)) for t in (vectors, asked_here))
            scores = q @ x.T if len(x) and len(q) else np.zeros((len(q), len(x)))
            ids = vectors.column("vec_id").to_numpy()
            # of equal scores the smallest ids, as the last ranking wants them
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores.round(9)), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(q)), order.shape[1])
            names = asked_here.column("query_id").combine_chunks().take(pa.array(rows))
            return pa.table({"query_id": names, "vec_id": pa.array(ids[order.ravel()], pa.int64()), "score": pa.array(np.take_along_axis(scores, order, 1).ravel())})

        at = ["cell", "part", "turn"]
        found = mine.select(*at, "vec_id", "embedding").groupBy(*at).cogroup(theirs.select(*at, "query_id", "embedding").groupBy(*at)).applyInArrow(meet, kinds)
        return rank_by(found, k, F.round("score", 9).desc(), F.asc("vec_id"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows (query_id, vec_id) that a search found."""
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / max(1, exact.count())
