"""Methods by name: a join function and the way it is batched.

A join function maps (a, b or None, params) to (a_idx, b_idx, dist); ``register`` adds one.  ``run_method`` runs,
stores and measures; the timing covers planning, fitting, joining and writing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks, clustering, graph, joins, metrics
from tessera.params import Params
from tessera.sources.results import ResultSet, ResultStore
from tessera.storage import saved

JoinFunction = Callable[[DataFrame, DataFrame | None, Params, dict[str, Any]], DataFrame]


def _fitted(rows: DataFrame, n: int, fraction: float, seed: int, stats: dict[str, Any], key: str = "build_time_s") -> DataFrame:
    began = time.perf_counter()
    out = clustering.fit_kmeans(rows, n, fraction, seed)
    stats[key] = stats.get(key, 0.0) + time.perf_counter() - began
    return out


def brute_force(a, b, p, stats):
    return joins.threshold_join(a, b, p.threshold, p.tile_rows["brute_force"])


def exact_knn(a, b, p, stats):
    return joins.tile_knn_threshold(a, b, p.cuvs_brute_force.k, p.threshold, p.tile_rows["cuvs_brute_force"])


def ivf_flat(a, b, p, stats):
    q = p.cuvs_ivf_flat
    return joins.ivf_join(a, b, _fitted(a, q.n_lists, 1.0, p.seed, stats), q.k, q.n_probes, p.threshold, tile_rows=p.tile_rows["cuvs_ivf_flat"])


def graph_search(a, b, p, stats):
    return graph.graph_join(a, b, p.cuvs_cagra.k, p.cuvs_cagra.beam, p.threshold, tile_rows=p.tile_rows["cuvs_cagra"])


def centroid(a, b, p, stats):
    q = p.centroid_join
    c = _fitted(a if b is None else b, q.n_clusters, q.sample_fraction, p.seed, stats)
    n_probes, tile = p.cuvs_ivf_flat.n_probes if q.use_ivf else None, p.tile_rows["centroid_join"]
    near = clustering.candidates(a.withColumn("_tile", joins.tile_of("vec_id", tile)), c, q.k_db_candidates, n_probes, "_tile")
    stats["total_pairs_compared"] = metrics.pairs_compared_centroid(clustering.assign(a if b is None else b, c), near).first()["pairs_compared"]
    return joins.centroid_join(a, b, c, q.k_db_candidates, p.threshold, n_probes, tile_rows=tile)


def _clustered(a, b, p: Params, rows: int, stats: dict[str, Any], kernel_of) -> DataFrame:
    """Balanced clusters of about ``rows`` rows of a, b at a's centroids, surviving pairs by the schedule."""
    n = a.count()
    k = max(1, -(-n // rows))
    c = _fitted(a, k, p.centroid_batch.sample_fraction, p.seed, stats, "cluster_time_s")
    left = saved(clustering.balanced_assign(a, c).select("vec_id", "embedding", "cluster"), "clustered")
    right = None if b is None else clustering.assign(b, c).withColumn("cluster", F.col("centroid_id")).select(*b.columns, "cluster")
    bound = p.centroid_batch.mode == "bound"
    radius = clustering.radii(left, c) if bound else None
    radius_b = clustering.radii(right, c) if bound and right is not None else None
    limit = p.threshold if bound else p.centroid_batch.centroid_threshold
    plan = saved(clustering.schedule(c, limit, b is None, radius, radius_b), "schedule")
    m = c.count()
    row = clustering.prune_ratio(plan, m, b is None).first()
    sizes = clustering.cluster_sizes(left).first()
    compared = metrics.pairs_compared_clusters(plan, left, right).first()["pairs_compared"]
    stats |= {"n_clusters": m, "n_tiles": row["scheduled"], "scheduled_tiles": row["scheduled"], "total_possible_tiles": row["possible"], "prune_ratio": row["prune_ratio"]}
    stats |= {"total_pairs_compared": compared, **{f"chunk_{k}": sizes[f"{k}_size"] for k in ("min", "max", "mean")}}
    return kernel_of(left, right, plan)


def centroid_batch(a, b, p, stats):
    return _clustered(a, b, p, p.tile_rows["centroid_batch"], stats, lambda x, y, s: clustering.cluster_join(x, y, s, blocks.within(p.threshold)))


def centroid_centroid(a, b, p, stats):
    """Within each scheduled cluster pair, a centroid join: candidates are sought among the pair's own a rows."""
    q = p.centroid_join

    def run(x, y, plan):
        c = _fitted(a if b is None else b, q.n_clusters, q.sample_fraction, p.seed, stats)
        tiles = plan.select("i", "j")
        near = saved(clustering.candidates(x, c, q.k_db_candidates, within="cluster").select("cluster", "centroid_id", F.col("a_idx").alias("vec_id")), "near")
        members = saved(clustering.assign(x if y is None else y, c).select("vec_id", "embedding", "centroid_id", "cluster"), "members")
        per = near.groupBy("cluster", "centroid_id").agg(F.count(F.lit(1)).alias("n"))
        asked = members.groupBy(F.col("cluster").alias("j"), "centroid_id").agg(F.count(F.lit(1)).alias("m"))
        done = tiles.join(per, F.col("cluster") == F.col("i")).join(asked, ["j", "centroid_id"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("n")).first()["n"]
        stats["total_pairs_compared"] = done
        # rows meet at a centroid, in ranges of clusters; the schedule is a mask, so a row is not copied for each cluster that its own one meets
        n = near.count()
        rows = clustering.group_rows(a.sparkSession, n // max(1, c.count()), members.count() // max(1, c.count()))
        groups = clustering.grouped(x.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), rows)
        key = F.col("centroid_id").cast("long") * blocks.PAIR_KEY + F.col("grp")
        left = x.join(near.drop("cluster"), "vec_id").join(groups, "cluster").withColumn("key", key)
        right = members.join(saved(clustering.met_groups(plan, groups), "met"), "cluster").withColumn("key", key)
        found = blocks.block_join(blocks.side(left, "a", "key", more=("pos",)), blocks.side(right, "b", "key", more=("bits",)), blocks.within(p.threshold))
        if b is None:
            found = found.where("a_idx <> b_idx").select(F.greatest("a_idx", "b_idx").alias("a_idx"), F.least("a_idx", "b_idx").alias("b_idx"), "dist").dropDuplicates(["a_idx", "b_idx"])
        return found

    return _clustered(a, b, p, p.tile_rows["centroid_centroid"], stats, run)


@dataclass(frozen=True)
class Method:
    join: JoinFunction
    batching: str  # "tiles" or "clusters"


METHODS: dict[str, Method] = {
    "brute_force": Method(brute_force, "tiles"),
    "cuvs_brute_force": Method(exact_knn, "tiles"),
    "cuvs_ivf_flat": Method(ivf_flat, "tiles"),
    "cuvs_cagra": Method(graph_search, "tiles"),
    "centroid_join": Method(centroid, "tiles"),
    "centroid_batch": Method(centroid_batch, "clusters"),
    "centroid_centroid": Method(centroid_centroid, "clusters"),
}


def register(name: str, join: JoinFunction, batching: str = "tiles") -> None:
    METHODS[name] = Method(join, batching)


def vector_join(a: DataFrame, b: DataFrame | None = None, method: str = "brute_force", params: Params = Params(), stats: dict[str, Any] | None = None) -> DataFrame:
    """(a_idx, b_idx, dist) by a method of ``METHODS``; b None is a self-join."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return METHODS[method].join(a, b, params, {} if stats is None else stats)


def _tiles(a: DataFrame, b: DataFrame | None, method: str, rows: int, tiles: int, m: int | None) -> int:
    """Pairs of tiles that ran: blocks of an exact join; of methods by ranges of ids, each tile of a with the b rows (of a self-join: of a tile not after it)."""
    if method == "brute_force":
        return tiles * (tiles + 1) // 2 if b is None else tiles * -(-m // rows)
    held = a.select(joins.tile_of("vec_id", rows).alias("t")).distinct().count()
    if b is None:
        return held * (held + 1) // 2
    return held * b.select(joins.tile_of("vec_id", rows).alias("t")).distinct().count()


def run_method(store: ResultStore, a: DataFrame, b: DataFrame | None, method: str, params: Params = Params(), name: str | None = None) -> ResultSet:
    """Runs a method and stores pairs and metadata under ``name`` (default: the method's)."""
    stats: dict[str, Any] = {}
    a.sparkSession.sparkContext.setJobDescription(f"vector join: {name or method}")
    n, m = a.count(), None if b is None else b.count()
    began = time.perf_counter()
    pairs = vector_join(a, b, method, params, stats)
    rows = params.tile_rows.get(method, params.tile_rows["brute_force"])
    tiles = -(-n // rows)
    stats.setdefault("n_tiles", _tiles(a, b, method, rows, tiles, m))
    k = {"cuvs_brute_force": params.cuvs_brute_force.k, "cuvs_ivf_flat": params.cuvs_ivf_flat.k, "cuvs_cagra": params.cuvs_cagra.k}.get(method)
    full = n * (n - 1) // 2 if b is None else n * m
    first = a.select(F.size("embedding").alias("d")).first()
    found = store.save(
        name or method,
        pairs,
        {
            "base_method": method,
            "self_join": b is None,
            "N": n,
            "M": n if b is None else m,
            "D": first["d"] if first else 0,
            "total_pairs_compared": full if method == "brute_force" else metrics.pairs_compared_knn(n if b is None else m, k) if k else None,
            "params": params.as_dict(),
            **stats,
        },
    )
    a.sparkSession.sparkContext.setJobDescription(None)
    found.metadata["time_s"] = time.perf_counter() - began
    return store.annotate(name or method, found.metadata)


def compare_runs(store: ResultStore, ids: DataFrame, truth: str = "brute_force", other_ids: DataFrame | None = None) -> list[dict[str, Any]]:
    """Statistics of all stored runs, recall against ``truth`` where it is stored: one dict a run."""
    names = store.runs()
    base = store.load(truth).pairs if truth in names else None
    out = []
    for name in names:
        run = store.load(name)
        self_join = bool(run.metadata.get("self_join", True))
        degrees = metrics.degree_stats(run.pairs, ids if self_join or other_ids is None else other_ids, self_join).first().asDict()
        dist = metrics.distance_stats(run.pairs).first().asDict()
        params = run.metadata.get("params") or {}
        row = {"method": name, "time_s": run.metadata.get("time_s"), "n_tiles": run.metadata.get("n_tiles"), "total_pairs_compared": run.metadata.get("total_pairs_compared")}
        row |= {"build_time_s": run.metadata["build_time_s"]} if "build_time_s" in run.metadata else {}
        row |= {"threshold": params.get("threshold"), "batch_size": (params.get("tile_rows") or {}).get(run.metadata.get("base_method", name))}
        degrees = {f"n_neighbors_{k.removesuffix('_degree')}" if k.endswith("_degree") else k: v for k, v in degrees.items()}
        row |= {"pair_count": run.pair_count, **degrees, **{k: v for k, v in dist.items() if k != "n_pairs"}}
        if base is not None:
            row["recall"] = 1.0 if name == truth else metrics.recall(run.pairs, base).first()["recall"]
        out.append(row)
    return out


#: The parameters of the three methods of a quick comparison.
QUICK = {
    "centroid": ("centroid_join", {"centroid_join": {"n_clusters": 1024, "k_db_candidates": 8192, "sample_fraction": 1.0}}),
    "ivf": ("cuvs_ivf_flat", {"cuvs_ivf_flat": {"n_lists": 256, "n_probes": 64, "k": 1024}}),
    "brute_force": ("brute_force", {}),
}


def run_quick(store: ResultStore, a: DataFrame, b: DataFrame | None, threshold: float, methods: list[str] | None = None) -> list[dict[str, Any]]:
    """Runs the named methods of ``QUICK`` (all by default), stores them under their names and compares all stored runs."""
    for name in methods or QUICK:
        if name not in QUICK:
            raise ValueError(f"unknown method {name!r}")
        method, changes = QUICK[name]
        run_method(store, a, b, method, Params(threshold=threshold).replace(**changes), name)
    return compare_runs(store, a.select("vec_id"), other_ids=None if b is None else b.select("vec_id"))
