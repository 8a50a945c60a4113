"""Loading of spatial tables into a database: rebuild, insert, derive; single and batch statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

# The tables' columns; geom is an array of rings, a point one ring of one corner.
GEOM = "ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
TABLES = {
    "admin_boundary": f"id BIGINT, name STRING, level STRING, geom {GEOM}",
    "poi": f"id BIGINT, name STRING, type STRING, geom {GEOM}",
    "schools": f"id BIGINT, name STRING, type STRING, geom {GEOM}",
}


class SpatialTables:
    """The three tables in ``database``, whose files lie below ``folder``."""

    def __init__(self, spark: SparkSession, database: str, folder: str) -> None:
        if not re.fullmatch(r"[A-Za-z_]\w*", database):
            raise ValueError(f"not a plain name: {database!r}")
        self.spark, self.database, self.folder = spark, database, folder.rstrip("/")

    def name(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"unknown table: {table!r}")
        return f"{self.database}.{table}"

    def rebuild(self) -> None:
        """All tables anew and empty; rows of a former load are gone, those of files too."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.folder}'")
        for table, columns in TABLES.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
            self.spark.sql(f"CREATE TABLE {self.name(table)} ({columns}) USING parquet")

    def execute(self, statement: str, args: dict | None = None) -> DataFrame:
        """One statement with named parameters, which are never spliced into its text; it is
        committed when it returns."""
        return self.spark.sql(statement, args=args or {})

    def insert(self, table: str, rows: DataFrame) -> None:
        """A batch of rows by column name; all of them appear, or none if a task fails for good.
        Columns besides the table's are left out, missing ones are null."""
        wanted = self.spark.table(self.name(table)).schema
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]).write.insertInto(self.name(table))

    def derive(self, table: str, source: str, types: list[str]) -> None:
        """Rows of ``source`` whose type is one of ``types``, by a statement inside the database."""
        marks = ", ".join(f":t{i}" for i in range(len(types)))
        columns = ", ".join(c.split(" ")[0] for c in re.split(r", (?=\w+ [A-Z])", TABLES[table]))
        if types:
            self.execute(f"INSERT INTO {self.name(table)} SELECT {columns} FROM {self.name(source)} WHERE type IN ({marks})", {f"t{i}": t for i, t in enumerate(types)})

    def load(self, boundaries: DataFrame, points: DataFrame, school_types: list[str]) -> None:
        """Rebuild from boundaries (id, name, level, ring) and points (id, name, type, lon,
        lat). Boundaries without a ring and points without a place are left out; schools are
        derived from the loaded points."""
        self.rebuild()
        self.insert("admin_boundary", boundaries.filter("ring is not null").withColumn("geom", F.array("ring")))
        at = F.array(F.array(geo.point(F.col("lon"), F.col("lat"))))
        self.insert("poi", points.filter("lon is not null and lat is not null").withColumn("geom", at))
        self.derive("schools", "poi", school_types)

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")


def named_boundaries(texts: DataFrame, boundaries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and the columns of every boundary whose whole name occurs in the text, each once;
    several boundaries of one name all come. Null texts and empty names name nothing.

    A text is cut into its substrings of the lengths that names have (there are few), which
    meet the names in a join on equality: names needn't be words, and no text is held
    against all names. Meant for short texts (questions): a text makes a row for each of its
    places and lengths."""
    named = boundaries.filter("name <> ''")
    lengths = sorted(r[0] for r in named.select(F.length("name")).distinct().collect())  # as many as names have lengths
    if not lengths:
        return texts.select(key).limit(0).join(boundaries.limit(0))
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n))))
    found = F.flatten(F.array_compact(F.array(*[cut(n) for n in lengths])))
    terms = texts.select(key, F.explode(F.array_distinct(found)).alias("name_"))
    return terms.join(named, F.col("name_") == F.col("name")).drop("name_")
