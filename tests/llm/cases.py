"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list[str | None], extra: str = "") -> DataFrame:
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts() -> list[str | None]:
    """Null, empty, white space only, short, repeated rows, long, beyond ASCII."""
    words = [f"w{i % 97}x{i % 89}" for i in range(3000)]
    long = " ".join(words)
    para = " ".join(f"alpha{i} béta{i}" for i in range(40))
    return [None, "", " \n\t ", "one", "one two three four", para, para, para.upper(), para + " tail words here", long, long + " x", "é" * 5000, "a " * 300]
