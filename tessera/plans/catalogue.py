"""The engine's queries over ``embeddings``, each with DuckDB SQL for the same rows where SQL can express it.

Fixed centroids are the vectors whose id is divisible by 50 (a definition, so that both engines have the same).  A
cross-join's sides are the even and the odd ids.  Distances are rounded to 6 decimals.  What approximate joins look at grows with the
table (``SHARE`` of its rows, of its centroids), so their recall does not fall with its size; it is reported by queries of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import blocks, clustering, graph, joins, metrics
from tessera.params import Params
from tessera.plans import sweep
from tessera.plans.methods import run_method, vector_join
from tessera.sources.results import ResultStore, read_metadata, read_sweep, read_triplets, write_triplets
from tessera.sources.synthetic import random_vectors
from tessera.sources.vector_files import load_vectors, save_vectors
from tessera.storage import new_path, saved

#: A threshold with no pair's distance near it, on any of the test tables.
T = 1.2
WIDE = 1.4
#: Of the rows a centroid's candidates, and of the lists those probed, in per cent.
SHARE = 80


def _share(n: int) -> int:
    return -(-n * SHARE // 100)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, d)
    return v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("int").alias("centroid_id"), F.col("embedding").cast("array<double>").alias("centroid"))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in (cols or ("dist",))})


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


_ALL = f"pairs AS (SELECT a.vec_id AS a_idx, b.vec_id AS b_idx, {_dist('a.embedding', 'b.embedding')} AS dist FROM embeddings a JOIN embeddings b ON true)"
_SELF = f"{_ALL}, self AS (SELECT * FROM pairs WHERE a_idx > b_idx AND dist <= {T})"
_CENTROIDS = "c AS (SELECT (vec_id // 50)::INTEGER AS centroid_id, embedding AS centroid FROM embeddings WHERE vec_id % 50 = 0)"
_NEAR = (
    f"{_CENTROIDS}, near AS (SELECT vec_id, centroid_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, centroid_id) AS probe "
    f"FROM (SELECT v.vec_id, c.centroid_id, {_dist('v.embedding', 'c.centroid')} AS d FROM embeddings v JOIN c ON true))"
)
_CANDIDATES = f"{_NEAR}, cand AS (SELECT centroid_id, vec_id AS a_idx, d, row_number() OVER (PARTITION BY centroid_id ORDER BY d, vec_id) AS rank FROM near)"


@query(f"WITH {_SELF} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM self")
def threshold_self_join(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.threshold_join(_vectors(spark, d), None, T))


@query(f"WITH {_ALL} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM pairs WHERE a_idx % 2 = 0 AND b_idx % 2 = 1 AND dist <= {T}")
def threshold_cross_join(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.threshold_join(*_sides(spark, d), T))


@query(f"WITH {_SELF} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM self")
def threshold_self_join_native(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.threshold_join_native(_vectors(spark, d), None, T))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2 FROM embeddings")
def squared_norms(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_vectors(spark, d).select("vec_id", V.norm2("embedding").alias("norm2")), "norm2")


@query(
    "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) "
    "SELECT vec_id, d::INTEGER AS d, round(embedding[d + 1]::DOUBLE / n, 6) AS x FROM (SELECT *, unnest(range(len(embedding))) AS d FROM n)"
)
def normalize_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_vectors(spark, d).select("vec_id", F.posexplode(V.normalize("embedding")).alias("d", "x")), "x")


@query(f"WITH {_CENTROIDS} SELECT vec_id, centroid_id, round(list_sum(list_transform(list_zip(embedding, centroid), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS dot FROM embeddings JOIN c ON true")
def centroid_dots(spark: SparkSession, d: str) -> DataFrame:
    ranked = clustering.rank_centroids(_vectors(spark, d), _centroids(spark, d), 1 << 30)  # all of them, in blocks beyond a broadcast's size
    both = ranked.select("vec_id", "embedding", F.explode("ranked.centroid_id").alias("centroid_id")).join(_centroids(spark, d), "centroid_id")
    return _rounded(both.select("vec_id", "centroid_id", V.dot("embedding", "centroid").alias("dot")), "dot")


@query(f"WITH {_ALL} SELECT b_idx, rank::INTEGER AS rank, a_idx, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY b_idx ORDER BY dist, a_idx) AS rank FROM pairs WHERE a_idx <> b_idx) WHERE rank <= 10")
def knn_join_k10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.knn_join(_vectors(spark, d), None, 10))


@query(
    f"WITH {_ALL} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY b_idx, a_idx // 200 ORDER BY dist, a_idx) AS rank "
    f"FROM pairs WHERE a_idx // 200 >= b_idx // 200) WHERE rank <= 5 AND dist <= {WIDE} AND a_idx > b_idx"
)
def tile_knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.tile_knn_threshold(_vectors(spark, d), None, 5, WIDE, tile_rows=200))


@query(f"WITH {_ALL} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM pairs WHERE a_idx > b_idx ORDER BY pairs.dist, b_idx, a_idx LIMIT 10")
def topk_closest_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.closest_pairs(_vectors(spark, d), None, 10))


@query(f"WITH {_ALL} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM pairs WHERE a_idx <> b_idx AND dist > 1e-4 ORDER BY pairs.dist, b_idx, a_idx LIMIT 10")
def topk_ordered_exclude_near_zero(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.closest_pairs(_vectors(spark, d), None, 10, ordered=True, least=1e-4))


@query(
    f"WITH {_ALL}, {_NEAR} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM pairs p WHERE a_idx <> b_idx AND dist > 1e-4 AND EXISTS (SELECT 1 FROM near x JOIN near y ON x.centroid_id = y.centroid_id "
    "WHERE x.vec_id = p.a_idx AND x.probe = 1 AND y.vec_id = p.b_idx AND y.probe <= 3) ORDER BY p.dist, b_idx, a_idx LIMIT 10"
)
def topk_ivf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.closest_pairs_ivf(_vectors(spark, d), None, _centroids(spark, d), 10, n_probes=3))


@query(
    f"WITH {_ALL}, {_CANDIDATES} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM pairs p WHERE a_idx <> b_idx AND dist > 1e-4 AND EXISTS (SELECT 1 FROM cand x JOIN near y ON x.centroid_id = y.centroid_id "
    "WHERE x.a_idx = p.a_idx AND x.rank <= 60 AND y.vec_id = p.b_idx AND y.probe <= 2) ORDER BY p.dist, b_idx, a_idx LIMIT 10"
)
def topk_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.closest_pairs_centroid(_vectors(spark, d), None, _centroids(spark, d), 10, n_probes=2, k_db=60))


_DEGREES = f"{_SELF}, deg AS (SELECT v.vec_id, count(e.vec_id) AS degree FROM embeddings v LEFT JOIN (SELECT a_idx AS vec_id FROM self UNION ALL SELECT b_idx FROM self) e ON v.vec_id = e.vec_id GROUP BY v.vec_id)"


@query(f"WITH {_DEGREES} SELECT vec_id, degree FROM deg")
def neighbor_counts(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return metrics.neighbor_counts(joins.threshold_join(v, None, T), v, True)


@query(f"WITH {_DEGREES} SELECT count(*) AS n_points, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS std_degree FROM deg")
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _rounded(metrics.degree_stats(joins.threshold_join(v, None, T), v, True), "mean_degree", "std_degree")


@query(f"WITH {_SELF} SELECT count(*) AS n_pairs, round(min(dist), 6) AS min_dist, round(max(dist), 6) AS max_dist, round(avg(dist), 6) AS mean_dist FROM self")
def distance_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.distance_stats(joins.threshold_join(_vectors(spark, d), None, T)), "min_dist", "max_dist", "mean_dist")


@query(f"WITH {_SELF} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM self ORDER BY self.dist, b_idx, a_idx LIMIT 5")
def result_top5(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.top_pairs(joins.threshold_join(_vectors(spark, d), None, T), 5))


@query("SELECT label, d::INTEGER AS d, round(avg(embedding[d + 1]::DOUBLE), 6) AS x FROM (SELECT label, embedding, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY label, d")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode("embedding").alias("d", "x"))
    return _rounded(rows.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x")), "x")


@query(f"WITH {_NEAR} SELECT vec_id, centroid_id, round(d, 6) AS centroid_dist FROM near WHERE probe = 1")
def nearest_centroid_assign(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clustering.assign(_vectors(spark, d), _centroids(spark, d)).select("vec_id", "centroid_id", "centroid_dist"), "centroid_dist")


@query(f"WITH {_NEAR} SELECT vec_id, centroid_id, probe::INTEGER AS probe FROM near WHERE probe <= 3")
def multiprobe_assign(spark: SparkSession, d: str) -> DataFrame:
    return clustering.probes(_vectors(spark, d), _centroids(spark, d), 3).select("vec_id", "centroid_id", "probe")


@query(f"WITH {_CANDIDATES} SELECT centroid_id, rank::INTEGER AS rank, a_idx FROM cand WHERE rank <= 40")
def centroid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return clustering.candidates(_vectors(spark, d), _centroids(spark, d), 40).select("centroid_id", "rank", "a_idx")


_KDB_ALL = f"((SELECT count(*) FROM embeddings) * {SHARE} + 99) // 100"
_PROBED = f"((SELECT count(*) FROM c) * {SHARE} + 99) // 100"
_FOUND_CENTROID = f"{_CANDIDATES}, fc AS (SELECT p.* FROM pairs p JOIN near m ON m.vec_id = p.b_idx AND m.probe = 1 JOIN cand x ON x.centroid_id = m.centroid_id AND x.a_idx = p.a_idx AND x.rank <= {_KDB_ALL} WHERE p.a_idx > p.b_idx AND p.dist <= {T})"
_FOUND_IVF = (
    f"{_NEAR}, fi AS (SELECT a_idx, b_idx, dist FROM (SELECT p.*, row_number() OVER (PARTITION BY p.b_idx ORDER BY p.dist, p.a_idx) AS rank FROM pairs p JOIN near l ON l.vec_id = p.a_idx AND l.probe = 1 "
    f"JOIN near q ON q.vec_id = p.b_idx AND q.centroid_id = l.centroid_id AND q.probe <= {_PROBED}) WHERE rank <= 16 AND dist <= {T} AND a_idx > b_idx)"
)


def _centroid_join(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return joins.centroid_join(v, None, _centroids(spark, d), _share(v.count()), T)


def _ivf_join(spark: SparkSession, d: str) -> DataFrame:
    c = _centroids(spark, d)
    return joins.ivf_join(_vectors(spark, d), None, c, 16, _share(c.count()), T)


@query(f"WITH {_ALL}, {_FOUND_CENTROID} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM fc")
def centroid_join_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_centroid_join(spark, d))


@query(
    f"WITH {_ALL}, {_CENTROIDS}, near AS (SELECT vec_id, centroid_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, centroid_id) AS probe FROM (SELECT v.vec_id, c.centroid_id, {_dist('v.embedding', 'c.centroid')} AS d FROM embeddings v JOIN c ON true)), "
    "cand AS (SELECT centroid_id, vec_id AS a_idx, row_number() OVER (PARTITION BY centroid_id ORDER BY d, vec_id) AS rank FROM near WHERE vec_id % 2 = 0) "
    f"SELECT p.a_idx, p.b_idx, round(p.dist, 6) AS dist FROM pairs p JOIN near m ON m.vec_id = p.b_idx AND m.probe = 1 JOIN cand x ON x.centroid_id = m.centroid_id AND x.a_idx = p.a_idx AND x.rank <= ((SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) * {SHARE} + 99) // 100 WHERE p.b_idx % 2 = 1 AND p.dist <= {T}"
)
def centroid_cross_join_fixed(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _rounded(joins.centroid_join(a, b, _centroids(spark, d), _share(a.count()), T))


@query(f"WITH {_ALL}, {_FOUND_IVF} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM fi")
def ivf_join_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ivf_join(spark, d))


_SCHEDULE = f"s AS (SELECT * FROM (SELECT x.centroid_id AS i, y.centroid_id AS j, {_dist('x.centroid', 'y.centroid')} AS centroid_dist FROM c x JOIN c y ON y.centroid_id >= x.centroid_id) WHERE centroid_dist <= 1.9)"


@query(f"WITH {_CENTROIDS}, {_SCHEDULE} SELECT i, j, round(centroid_dist, 6) AS centroid_dist FROM s")
def centroid_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clustering.schedule(_centroids(spark, d), 1.9, True), "centroid_dist")


@query(f"WITH {_CENTROIDS}, {_SCHEDULE}, k AS (SELECT count(*) AS k FROM c) SELECT (SELECT count(*) FROM s) AS scheduled, k * (k + 1) // 2 AS possible, round(1 - (SELECT count(*) FROM s) / (k * (k + 1) / 2), 6) AS prune_ratio FROM k")
def prune_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = _centroids(spark, d)
    return _rounded(clustering.prune_ratio(clustering.schedule(c, 1.9, True), c.count(), True), "prune_ratio")


def _unbalanced(spark: SparkSession, d: str) -> DataFrame:
    return clustering.assign(_vectors(spark, d), _centroids(spark, d)).select("vec_id", "embedding", F.col("centroid_id").alias("cluster"))


@query(
    f"WITH {_ALL}, {_NEAR}, {_SCHEDULE} SELECT p.a_idx, p.b_idx, round(p.dist, 6) AS dist FROM pairs p JOIN near x ON x.vec_id = p.a_idx AND x.probe = 1 JOIN near y ON y.vec_id = p.b_idx AND y.probe = 1 "
    f"JOIN s ON s.i = least(x.centroid_id, y.centroid_id) AND s.j = greatest(x.centroid_id, y.centroid_id) WHERE p.a_idx > p.b_idx AND p.dist <= {T}"
)
def centroid_batch_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clustering.cluster_join(_unbalanced(spark, d), None, clustering.schedule(_centroids(spark, d), 1.9, True), blocks.within(T)))


@query(f"WITH {_SELF} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM self")
def centroid_batch_bound(spark: SparkSession, d: str) -> DataFrame:
    """Pruning by radii loses no pair."""
    a, c = saved(_unbalanced(spark, d), "clustered"), _centroids(spark, d)
    return _rounded(clustering.cluster_join(a, None, clustering.schedule(c, T, True, clustering.radii(a, c)), blocks.within(T)))


@query(f"WITH {_NEAR}, n AS (SELECT centroid_id, count(*) AS n FROM near WHERE probe = 1 GROUP BY centroid_id) SELECT count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size FROM n")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clustering.cluster_sizes(_unbalanced(spark, d)), "mean_size")


@query(f"WITH {_SELF}, {_FOUND_CENTROID} SELECT count(*) AS n_truth, (SELECT count(*) FROM fc) AS n_found, round((SELECT count(*) FROM fc) / count(*), 6) AS recall FROM self")
def recall_centroid_vs_exact(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _rounded(metrics.recall(_centroid_join(spark, d), joins.threshold_join(v, None, T)), "recall")


@query(f"WITH {_SELF}, {_FOUND_IVF} SELECT count(*) AS n_truth, (SELECT count(*) FROM fi) AS n_found, round((SELECT count(*) FROM fi) / count(*), 6) AS recall FROM self")
def recall_ivf_vs_exact(spark: SparkSession, d: str) -> DataFrame:
    c = _centroids(spark, d)
    return _rounded(metrics.share_found(joins.ivf_hits(_vectors(spark, d), c, 16, _share(c.count()), T)), "recall")


@query(f"WITH {_SELF}, {_FOUND_IVF} SELECT a_idx, b_idx FROM fi INTERSECT SELECT a_idx, b_idx FROM self")
def shared_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return metrics.shared_pairs(_ivf_join(spark, d), joins.threshold_join(v, None, T))


@query(
    "WITH n AS (SELECT vec_id // 128 AS t, count(*) AS n FROM embeddings GROUP BY 1) SELECT a.t AS a_tile, b.t AS b_tile, CASE WHEN a.t = b.t THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS pairs FROM n a JOIN n b ON a.t >= b.t"
)
def pairs_compared_by_tile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pairs_compared_by_tile(_vectors(spark, d), 128)


@query(f"WITH {_CANDIDATES} SELECT sum(m.n * x.n)::BIGINT AS pairs_compared FROM (SELECT centroid_id, count(*) AS n FROM near WHERE probe = 1 GROUP BY 1) m JOIN (SELECT centroid_id, count(*) AS n FROM cand WHERE rank <= 40 GROUP BY 1) x USING (centroid_id)")
def pairs_compared_centroid(spark: SparkSession, d: str) -> DataFrame:
    v, c = _vectors(spark, d), _centroids(spark, d)
    return metrics.pairs_compared_centroid(clustering.assign(v, c), clustering.candidates(v, c, 40))


_KDB = (20, 50, 100, 200, 400)


@query(
    f"WITH {_SELF}, {_CANDIDATES}, k AS (SELECT unnest([{', '.join(map(str, _KDB))}]) AS k), hit AS (SELECT x.rank FROM self p JOIN near m ON m.vec_id = p.b_idx AND m.probe = 1 JOIN cand x ON x.centroid_id = m.centroid_id AND x.a_idx = p.a_idx), "
    "points AS (SELECT 'kdb' || k AS method_name, 'centroid_join' AS base_method, (SELECT count(*) FROM hit WHERE rank <= k) / (SELECT count(*) FROM self) AS recall, (k * (SELECT count(*) FROM embeddings))::DOUBLE AS time_s FROM k), "
    "w AS (SELECT *, min(time_s) OVER (ORDER BY recall DESC, time_s, method_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM points) "
    "SELECT method_name, base_method, round(recall, 6) AS recall, time_s FROM w WHERE before IS NULL OR time_s < before"
)
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Recall against cost (pairs compared) of growing candidate lists; frontier points only."""
    v, c = _vectors(spark, d), _centroids(spark, d)
    truth = joins.threshold_join(v, None, T)
    member = clustering.assign(v, c).select(F.col("vec_id").alias("b_idx"), "centroid_id")
    near = clustering.candidates(v, c, max(_KDB)).select("centroid_id", "rank", "a_idx")
    hit = truth.join(member, "b_idx").join(near, ["centroid_id", "a_idx"], "left")
    row = hit.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum((F.col("rank") <= k).cast("int")), F.lit(0)).alias(f"h{k}") for k in _KDB])
    n = v.agg(F.count(F.lit(1)).alias("rows"))
    points = row.crossJoin(n).select(F.explode(F.array(*[F.struct(F.lit(f"kdb{k}").alias("method_name"), (F.col(f"h{k}") / F.col("n")).alias("recall"), (F.lit(k) * F.col("rows")).cast("double").alias("time_s")) for k in _KDB])).alias("p"))
    return _rounded(sweep.pareto(points.select("p.method_name", F.lit("centroid_join").alias("base_method"), "p.recall", "p.time_s")), "recall")


@query(f"WITH {_CENTROIDS}, n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT count(*) AS k FROM c) SELECT n AS n_rows, n AS n_ids, k AS n_clusters, true AS none_above_capacity FROM n, k")
def balanced_assignment_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every row has one cluster, and no cluster more than ceil(rows / clusters)."""
    got, c = balanced_assignment(spark, d), _centroids(spark, d).count()
    sizes = got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"))
    row = sizes.agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"), F.max("n").alias("most"))
    return row.select("n_rows", "n_ids", F.lit(c).cast("long").alias("n_clusters"), (F.col("most") <= F.ceil(F.col("n_rows") / c)).alias("none_above_capacity"))


@query()
def balanced_assignment(spark: SparkSession, d: str) -> DataFrame:
    return clustering.balanced_assign(_vectors(spark, d), _centroids(spark, d)).select("vec_id", "cluster")


def _kmeans_params(spark: SparkSession, d: str) -> Params:
    n = _vectors(spark, d).count()
    return Params(threshold=T).replace(centroid_join={"n_clusters": 10, "k_db_candidates": _share(n), "sample_fraction": 1.0})


@query()
def kmeans_centroid_join(spark: SparkSession, d: str) -> DataFrame:
    return vector_join(_vectors(spark, d), None, "centroid_join", _kmeans_params(spark, d))


@query(f"WITH {_SELF} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM self")
def centroid_batch_join(spark: SparkSession, d: str) -> DataFrame:
    """Pruned by radii, so no pair is lost, whatever clusters k-means finds."""
    p = Params(threshold=T).replace(tile_rows={"centroid_batch": 100}, centroid_batch={"centroid_threshold": None, "mode": "bound"})
    return _rounded(vector_join(_vectors(spark, d), None, "centroid_batch", p))


@query()
def centroid_centroid_join(spark: SparkSession, d: str) -> DataFrame:
    p = _kmeans_params(spark, d).replace(tile_rows={"centroid_centroid": 250}, centroid_batch={"centroid_threshold": 4.0}, centroid_join={"n_clusters": 8})
    return vector_join(_vectors(spark, d), None, "centroid_centroid", p)


@query()
def graph_knn_join(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_join(_vectors(spark, d), None, 64, 128, T)


_CONTRACT = f"WITH {_SELF} SELECT count(*) AS n_truth, true AS only_true_pairs, true AS recall_at_least_0_9 FROM self"


def _contract(found: DataFrame, truth: DataFrame) -> DataFrame:
    """What holds for an approximate join whatever a fit finds: no wrong pair, and recall of 0.9 at least."""
    t = truth.select(*metrics.PAIR).distinct().withColumn("_true", F.lit(1))
    f = found.select(*metrics.PAIR).distinct().withColumn("_found", F.lit(1))
    both = t.join(f, metrics.PAIR, "full")  # each of the two joins runs once
    row = both.agg(F.count("_true").alias("n_truth"), F.count("_found").alias("n"), F.count(F.col("_true") + F.col("_found")).alias("hits"))
    recall = F.when(F.col("n_truth") == 0, 0.0).otherwise(F.col("hits") / F.col("n_truth"))
    return row.select("n_truth", (F.col("n") == F.col("hits")).alias("only_true_pairs"), (recall >= 0.9).alias("recall_at_least_0_9"))


@query(_CONTRACT)
def recall_kmeans_centroid_join(spark: SparkSession, d: str) -> DataFrame:
    return _contract(kmeans_centroid_join(spark, d), joins.threshold_join(_vectors(spark, d), None, T))


@query(_CONTRACT)
def recall_centroid_centroid_join(spark: SparkSession, d: str) -> DataFrame:
    return _contract(centroid_centroid_join(spark, d), joins.threshold_join(_vectors(spark, d), None, T))


@query(_CONTRACT)
def recall_graph_knn_join(spark: SparkSession, d: str) -> DataFrame:
    return _contract(graph_knn_join(spark, d), joins.threshold_join(_vectors(spark, d), None, T))


@query(f"WITH {_ALL} SELECT 10 AS n_truth, 10 AS n_found, 1.0::DOUBLE AS recall")
def recall_topk(spark: SparkSession, d: str) -> DataFrame:
    """The closest pairs by inverted lists, all of them probed, against the closest of all."""
    v, c = _vectors(spark, d), _centroids(spark, d)
    found = joins.closest_pairs_ivf(v, None, c, 20, n_probes=c.count(), least=None)
    return metrics.topk_recall(found.where("a_idx > b_idx"), joins.closest_pairs(v, None, 10), 10).select(F.col("n_truth").cast("int").alias("n_truth"), F.col("n_found").cast("int").alias("n_found"), "recall")


def _grid_sql() -> str:
    parts = []
    for method, axes in sweep.GRIDS.items():
        froms = ", ".join(f"(SELECT unnest([{', '.join(map(str, values))}]) AS {axis})" for axis, values in axes.items())
        name = " || '_' || ".join(f"'{sweep.SHORT[a]}' || {a}" for a in axes)
        cols = ", ".join(f"{a}::INTEGER AS {a}" if a in axes else f"-1::INTEGER AS {a}" for a in sweep.SHORT)
        keep = "itopk_size >= k" if "itopk_size" in axes else "n_probes <= n_lists" if "n_probes" in axes else "true"
        parts.append(f"SELECT '{method}_' || {name} AS method_name, '{method}' AS base_method, {cols} FROM {froms} WHERE {keep}")
    return " UNION ALL ".join(parts)


@query(_grid_sql())
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    return sweep.grid_frame(spark).fillna(-1)  # -1: not a parameter of the method


@query()
def random_unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return random_vectors(spark, 1000, 16)


@query("SELECT 1000::BIGINT AS n, 0::BIGINT AS least_id, 999::BIGINT AS last_id, 16 AS dim, 1.0::DOUBLE AS least_norm2, 1.0::DOUBLE AS greatest_norm2")
def random_unit_vectors_shape(spark: SparkSession, d: str) -> DataFrame:
    v = random_vectors(spark, 1000, 16).withColumn("n2", F.round(V.norm2("embedding"), 4))
    return v.agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"), F.max("vec_id").alias("last_id"), F.max(F.size("embedding")).alias("dim"), F.min("n2").alias("least_norm2"), F.max("n2").alias("greatest_norm2")
    )


@query("SELECT 100::BIGINT AS n, 100::BIGINT AS n_ids, true AS of_the_table")
def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    """Exactly as many rows as asked for, each once, all of them rows of the table."""
    v = _vectors(spark, d)
    drawn = clustering.sample_exact(v, 100)
    known = drawn.join(v.select(F.col("vec_id").alias("vec_id"), F.lit(1).alias("known")), "vec_id", "left")
    return known.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_ids"), (F.count("known") == F.count(F.lit(1))).alias("of_the_table"))


@query(f"WITH {_SELF} SELECT a_idx, b_idx, round(min(dist), 6) AS dist FROM (SELECT * FROM self UNION ALL SELECT a_idx, b_idx, dist + 1 FROM self) GROUP BY a_idx, b_idx")
def deduplicated_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = joins.threshold_join(_vectors(spark, d), None, T)
    return _rounded(metrics.deduplicated(found.unionAll(found.withColumn("dist", F.col("dist") + 1))))


def _store(spark: SparkSession) -> ResultStore:
    return ResultStore(spark, new_path(spark, "runs"))


@query(f"WITH {_SELF} SELECT a_idx, b_idx, round(dist, 6) AS dist FROM self")
def stored_run(spark: SparkSession, d: str) -> DataFrame:
    """A run that was stored, and read back by its name."""
    store = _store(spark)
    run_method(store, _vectors(spark, d), None, "brute_force", Params(threshold=T))
    return _rounded(store.load(store.runs()[0]).pairs)


@query(f"WITH {_SELF}, n AS (SELECT count(*) AS n FROM embeddings) SELECT 'brute_force' AS method, (SELECT count(*) FROM self) AS pair_count, n AS \"N\", n AS \"M\", 64::BIGINT AS \"D\", true AS self_join, n * (n - 1) // 2 AS total_pairs_compared, 1::BIGINT AS n_tiles FROM n")
def stored_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata files of a folder, found by a pattern."""
    store = _store(spark)
    run_method(store, _vectors(spark, d), None, "brute_force", Params(threshold=T))
    return read_metadata(spark, f"{store.folder}/*/metadata.json").select("method", "pair_count", "N", "M", "D", "self_join", "total_pairs_compared", "n_tiles")


@query(f"WITH {_SELF} SELECT a_idx, b_idx, round(dist, 4) AS dist FROM self")
def legacy_triplets(spark: SparkSession, d: str) -> DataFrame:
    """A result in the three legacy files (single precision) and back."""
    folder = new_path(spark, "triplets")
    write_triplets(joins.threshold_join(_vectors(spark, d), None, T), folder)
    return read_triplets(spark, folder).withColumn("dist", F.round("dist", 4))


@query("SELECT * FROM (VALUES ('brute_force', 'brute_force', true, true), ('cuvs_ivf_flat_k16_nl8_np8', 'cuvs_ivf_flat', true, true), ('centroid_join_nc4_kdb100000', 'centroid_join', true, true)) t(method_name, base_method, all_found, timed)")
def sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    """A small sweep with parameters that leave nothing out: run, summarised, written as CSV and read again."""
    store = _store(spark)
    grids = {"cuvs_ivf_flat": {"k": [16], "n_lists": [8], "n_probes": [8]}, "centroid_join": {"n_clusters": [4], "k_db_candidates": [100_000]}}
    sweep.run_sweep(store, _vectors(spark, d), None, Params(threshold=T), grids)
    back = read_sweep(spark, f"{store.folder}/sweep_summary.csv")
    return back.select("method_name", "base_method", (F.col("recall") == 1).alias("all_found"), (F.col("time_s") > 0).alias("timed"))


def _round_trip(spark: SparkSession, rows: DataFrame, fmt: str, most: int | None = None) -> DataFrame:
    folder = new_path(spark, fmt)
    save_vectors(rows, folder, fmt)
    back = load_vectors(spark, folder, fmt, most)
    return back.select("vec_id", F.size("embedding").alias("n"), F.round(V.norm2("embedding"), 4).alias("norm2"))


_TRIP = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, len(v)::INTEGER AS n, round(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2 FROM (SELECT vec_id, {} AS v FROM embeddings)"
_BYTES = "list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 100))"


@query(_TRIP.format("embedding"))
def fvecs_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, _vectors(spark, d), "fvecs")


@query(_TRIP.format("embedding") + " QUALIFY vec_id < 100")
def first_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred vectors of a file, and no more of it."""
    return _round_trip(spark, _vectors(spark, d).coalesce(1), "fvecs", 100)


@query(_TRIP.format("embedding"))
def fbin_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, _vectors(spark, d), "fbin")


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.transform(V.as_double("embedding"), lambda x: F.floor((x + 1) * 100).cast("double")).alias("embedding"))


@query(_TRIP.format(_BYTES))
def bvecs_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, _bytes(spark, d), "bvecs")


@query(_TRIP.format(_BYTES))
def u8bin_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, _bytes(spark, d), "u8bin")
