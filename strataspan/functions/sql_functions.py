"""The library's own functions for SQL: chunks as a table function, and scores.

``register`` adds to a session:

- ``chunks_of(text)``, a table function for FROM and LATERAL: index and chunk, as ``text.chunks`` cuts them;
- ``bm25_weight(tf, length, mean_length, n_docs, df)`` and ``fusion_weight(rank)``, the summands of BM25 and of rank fusion;
- ``iou(hits, only_first, only_second)`` of counts (0 for an empty union) and ``keep_ratio(kept, all)``;
- ``robust_score(value, median, deviation)``, the distance from a median in units of 1.4826 deviations.

Null arguments give null; a null or blank text has no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.retrieval import FUSION_K, K1, B
from .text import chunk_texts


@udtf(returnType="index int, chunk string")
class ChunksOf:
    """A row per chunk of its argument."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from chunk_texts(text)


SCALARS = {
    "bm25_weight": (
        "tf DOUBLE, length DOUBLE, mean_length DOUBLE, n_docs DOUBLE, df DOUBLE",
        f"ln((n_docs - df + 0.5D) / (df + 0.5D) + 1) * tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * length / mean_length))",
    ),
    "fusion_weight": ("rank DOUBLE", f"1D / ({FUSION_K} + rank)"),
    "iou": ("hits DOUBLE, only_first DOUBLE, only_second DOUBLE", "CASE WHEN hits + only_first + only_second = 0 THEN 0D ELSE hits / (hits + only_first + only_second) END"),
    "keep_ratio": ("kept DOUBLE, whole DOUBLE", "kept / greatest(whole, 1D)"),
    "robust_score": ("v DOUBLE, middle DOUBLE, deviation DOUBLE", "(v - middle) / greatest(1.4826D * deviation, 1e-6D)"),
}


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunks_of", ChunksOf)
    for name, (parameters, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")
