"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete_path, new_path, saved


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round.  ``edges`` holds each pair once as (u, v) with u > v.

    Each node's smallest neighbour comes from a map-side combined ``min``; the
    join back may be skewed at a hub, which adaptive execution splits.
    """
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of comparable ids -> ``(node, root)``, root the smallest id reachable.

    Self loops, repeated edges and nulls are allowed and add nothing; nodes
    without an edge are not returned.  Rounds grow with the logarithm of the
    longest path.  Every round is written to the shared folder, and nothing
    but one count and one checksum reaches the driver.
    """
    spark = edges.sparkSession
    paths = [new_path(spark, "cc")]
    now = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
        paths[-1],
    )
    before = _signature(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        paths.append(new_path(spark, "cc"))
        now = saved(_star(_star(now, True), False), "cc", paths[-1])
        delete_path(spark, paths[-2])
        after = _signature(now)
        if after == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
        before = after
    raise RuntimeError("components did not settle")
