"""Degrees, recall, distance statistics and counters of join results (a_idx, b_idx, dist)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["a_idx", "b_idx"]


def neighbor_counts(result: DataFrame, ids: DataFrame, self_join: bool) -> DataFrame:
    """(vec_id, degree) of every id, zeros included: a self-join counts both ends of a pair, a cross-join the b end."""
    ends = result.select(F.col("b_idx").alias("vec_id"))
    ends = ends.unionAll(result.select("a_idx")) if self_join else ends
    found = ends.groupBy("vec_id").agg(F.count(F.lit(1)).alias("degree"))
    return ids.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_stats(result: DataFrame, ids: DataFrame, self_join: bool) -> DataFrame:
    """One row: points, min, max, mean and population standard deviation of the degrees."""
    return neighbor_counts(result, ids, self_join).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
        F.avg("degree").alias("mean_degree"),
        F.stddev_pop("degree").alias("std_degree"),
    )


def distance_stats(result: DataFrame) -> DataFrame:
    return result.agg(F.count(F.lit(1)).alias("n_pairs"), F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"), F.avg("dist").alias("mean_dist"))


def deduplicated(result: DataFrame) -> DataFrame:
    """Each pair once, at its least distance."""
    return result.groupBy(*PAIR).agg(F.min("dist").alias("dist"))


def recall(result: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_truth, n_found, recall, over distinct ordered pairs; an empty truth has recall 0."""
    t = truth.select(*PAIR).distinct()
    r = result.select(*PAIR).distinct().withColumn("_hit", F.lit(1))
    return share_found(t.join(r, PAIR, "left").agg(F.count(F.lit(1)).alias("n_truth"), F.coalesce(F.sum("_hit"), F.lit(0)).cast("long").alias("n_found")))


def share_found(counts: DataFrame) -> DataFrame:
    """``counts`` (n_truth, n_found) with recall; an empty truth has recall 0."""
    return counts.select("n_truth", "n_found", F.when(F.col("n_truth") == 0, 0.0).otherwise(F.col("n_found") / F.col("n_truth")).alias("recall"))


def topk_recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: n_truth, n_found, recall of a global top ``k``: the share of the true ``k`` closest pairs, in either direction, that the result's ``k`` closest hold."""
    best = lambda df: df.orderBy("dist", "b_idx", "a_idx").limit(k).select(F.greatest(*PAIR).alias("a_idx"), F.least(*PAIR).alias("b_idx"))
    return recall(best(result), best(truth))


def shared_pairs(result: DataFrame, truth: DataFrame) -> DataFrame:
    """The distinct pairs that both have."""
    return result.select(*PAIR).intersect(truth.select(*PAIR))


def top_pairs(result: DataFrame, n: int = 5) -> DataFrame:
    return result.orderBy("dist", "b_idx", "a_idx").limit(n)


def pairs_compared_by_tile(ids: DataFrame, tile_rows: int, other: DataFrame | None = None) -> DataFrame:
    """(a_tile, b_tile, pairs) of a tiled nested loop: n (n - 1) / 2 on a self-join's diagonal, else na * nb.

    Tiles are ranges of ``tile_rows`` ids; a self-join visits a_tile >= b_tile.
    """
    count = lambda df, name: df.groupBy(F.floor(F.col("vec_id") / tile_rows).alias(f"{name}_tile")).agg(F.count(F.lit(1)).alias(f"n{name}"))
    a, b = count(ids, "a"), count(ids if other is None else other, "b")
    if other is not None:
        return a.crossJoin(b).select("a_tile", "b_tile", (F.col("na") * F.col("nb")).alias("pairs"))
    diagonal = F.col("a_tile") == F.col("b_tile")
    half = F.floor(F.col("na") * (F.col("na") - 1) / 2)
    return a.join(b, F.col("a_tile") >= F.col("b_tile")).select("a_tile", "b_tile", F.when(diagonal, half).otherwise(F.col("na") * F.col("nb")).cast("long").alias("pairs"))


def pairs_compared(n: int, m: int | None = None) -> int:
    """All pairs that an exact join compares, in closed form: n (n - 1) / 2 of a self-join, else n * m."""
    return n * (n - 1) // 2 if m is None else n * m


def pairs_compared_clusters(scheduled: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """One row: pairs compared on the scheduled cluster pairs; a self-join (right None) compares n (n - 1) / 2 within a cluster."""
    a = left.groupBy(F.col("cluster").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    b = (left if right is None else right).groupBy(F.col("cluster").alias("j")).agg(F.count(F.lit(1)).alias("m"))
    own = F.floor(F.col("n") * (F.col("n") - 1) / 2)
    each = F.col("n") * F.col("m") if right is not None else F.when(F.col("i") == F.col("j"), own).otherwise(F.col("n") * F.col("m"))
    return scheduled.select("i", "j").join(a, "i").join(b, "j").agg(F.coalesce(F.sum(each), F.lit(0)).cast("long").alias("pairs_compared"))


def pairs_compared_knn(n_queries: int, k: int) -> int:
    return n_queries * k


def pairs_compared_centroid(members: DataFrame, near: DataFrame) -> DataFrame:
    """One row: the sum over centroids of members times candidates."""
    m = members.groupBy("centroid_id").agg(F.count(F.lit(1)).alias("m"))
    c = near.groupBy("centroid_id").agg(F.count(F.lit(1)).alias("c"))
    return m.join(c, "centroid_id").agg(F.coalesce(F.sum(F.col("m") * F.col("c")), F.lit(0)).cast("long").alias("pairs_compared"))
