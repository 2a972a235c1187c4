"""Seeded random vectors, and datasets by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import normalize
from tessera.sources.vector_files import load_vectors


def random_vectors(spark: SparkSession, n: int, dim: int, unit: bool = True, seed: int = 42) -> DataFrame:
    """``n`` vectors of uniform [0, 1) components, of norm 1 if ``unit``; a vector depends only on the seed and its id."""
    component = lambda d: (F.pmod(F.xxhash64("vec_id", F.lit(seed), F.lit(d)), F.lit(1 << 53)) / F.lit(float(1 << 53)))
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[component(d) for d in range(dim)]).alias("embedding"))
    return rows.withColumn("embedding", normalize("embedding") if unit else F.col("embedding")).select("vec_id", F.col("embedding").cast("array<float>"))


@dataclass(frozen=True)
class Dataset:
    """A named file: where it lies is configuration, not code."""

    path: str
    fmt: str
    dim: int | None = None

    def load(self, spark: SparkSession, max_vectors: int | None = None) -> DataFrame:
        return load_vectors(spark, self.path, self.fmt, max_vectors, self.dim)
