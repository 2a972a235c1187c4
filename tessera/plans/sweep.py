"""Parameter sweeps: grids, runs that resume, a tidy summary, and Pareto frontiers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.methods import compare_runs, run_method
from tessera.params import Params
from tessera.sources.results import ResultStore, read_statistics, write_statistics, write_sweep

#: The grids of a full sweep.
GRIDS: dict[str, dict[str, list[int]]] = {
    "cuvs_cagra": {"k": [32, 64], "itopk_size": [32, 64, 128, 256, 512]},
    "cuvs_ivf_flat": {"k": [64, 128, 256], "n_lists": [128, 256, 512, 1024], "n_probes": [2, 4, 8, 16, 20, 32]},
    "centroid_join": {"n_clusters": [128, 256, 512, 1024, 2048], "k_db_candidates": [1024, 2048, 4096, 8192, 16384, 32768]},
}
#: How a parameter is written in the name of a point.
SHORT = {"k": "k", "itopk_size": "itopk", "n_lists": "nl", "n_probes": "np", "n_clusters": "nc", "k_db_candidates": "kdb"}


def sensible(method: str, point: dict[str, int]) -> bool:
    """A beam is at least k wide, and no more lists are probed than there are."""
    return point.get("itopk_size", 1 << 30) >= point.get("k", 0) if method == "cuvs_cagra" else point.get("n_probes", 0) <= point.get("n_lists", 1 << 30)


def grid(grids: dict[str, dict[str, list[int]]] | None = None) -> Iterator[tuple[str, str, dict[str, int]]]:
    """(name, method, parameters) of every sensible point."""
    for method, axes in (grids or GRIDS).items():
        for values in product(*axes.values()):
            point = dict(zip(axes, values))
            if sensible(method, point):
                yield f"{method}_" + "_".join(f"{SHORT[k]}{v}" for k, v in point.items()), method, point


def grid_frame(spark: SparkSession, grids: dict[str, dict[str, list[int]]] | None = None) -> DataFrame:
    """The same as a table (method_name, base_method, and a column a parameter)."""
    rows = [(n, m, *[p.get(k) for k in SHORT]) for n, m, p in grid(grids)]
    return spark.createDataFrame(rows, "method_name string, base_method string, " + ", ".join(f"{k} int" for k in SHORT))


def run_sweep(store: ResultStore, a: DataFrame, b: DataFrame | None, params: Params, grids: dict[str, dict[str, list[int]]] | None = None) -> DataFrame:
    """Ground truth, then every point that is not stored yet; statistics.json and sweep_summary.csv; returns the summary."""
    if not store.exists("brute_force"):
        run_method(store, a, b, "brute_force", params)
    for name, method, point in grid(grids):
        if not store.exists(name):
            run_method(store, a, b, method, params.replace(**{method: point}), name)
    write_statistics(store.spark, f"{store.folder}/statistics.json", compare_runs(store, a.select("vec_id"), other_ids=None if b is None else b.select("vec_id")))
    out = summary(store)
    write_sweep(out, f"{store.folder}/sweep_summary.csv")
    return out


def summary(store: ResultStore) -> DataFrame:
    """A row a stored run: swept parameters of its own method, and recall where statistics.json has it."""
    columns = "method_name string, base_method string, time_s double, pair_count long, " + ", ".join(f"{k} int" for k in SHORT)
    rows = []
    for name in store.runs():
        m = store.load(name).metadata
        base = m.get("base_method", name)
        own = (m.get("params") or {}).get(base) or {} if base in GRIDS else {}
        rows.append((name, base, float(m.get("time_s") or 0), int(m.get("pair_count") or 0), *[own.get(k) if k in GRIDS.get(base, {}) else None for k in SHORT]))
    runs = store.spark.createDataFrame(rows, columns)
    try:
        known: list[dict[str, Any]] = read_statistics(store.spark, f"{store.folder}/statistics.json")
    except Exception as e:  # noqa: BLE001  an absent file is Spark's AnalysisException
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = []
    recall = store.spark.createDataFrame([(s["method"], s.get("recall")) for s in known], "method_name string, recall double")
    return runs.join(recall, "method_name", "left")


def pareto(points: DataFrame, by: str = "base_method") -> DataFrame:
    """From the highest recall down, the points whose time is strictly below all before them."""
    order = Window.partitionBy(by).orderBy(F.desc("recall"), F.asc("time_s"), F.asc("method_name"))
    before = F.min("time_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return points.where("recall is not null and time_s is not null").withColumn("_before", before).where(F.col("_before").isNull() | (F.col("time_s") < F.col("_before"))).drop("_before")


def centroid_points(summary_: DataFrame) -> DataFrame:
    """Points of the centroid sweep with both parameters known."""
    return summary_.where("base_method = 'centroid_join'").dropna(subset=["n_clusters", "k_db_candidates", "recall", "time_s"])


def by_value(points: DataFrame, column: str) -> DataFrame:
    """A row for each swept value: its points' mean and best time and recall."""
    return points.groupBy(column).agg(
        F.count(F.lit(1)).alias("points"), F.avg("time_s").alias("mean_time_s"), F.min("time_s").alias("min_time_s"), F.avg("recall").alias("mean_recall"), F.max("recall").alias("max_recall")
    ).orderBy(column)


def time_split(collected: DataFrame) -> DataFrame:
    """Share of clustering and of joining in each run's time."""
    share = lambda c: F.when(F.col("time_s") > 0, F.col(c) / F.col("time_s"))
    return collected.select("dataset", "method", share("cluster_time_s").alias("cluster_share"), share("join_time_s").alias("join_share"))
