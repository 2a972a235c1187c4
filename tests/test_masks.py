"""Joins of many small clusters: a row is copied for ranges of clusters, not for each cluster; the pairs are those of the definition."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import blocks, clustering, joins, metrics
from tessera.params import Params
from tessera.plans import catalogue
from tessera.plans.methods import vector_join


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def centers(spark, x):
    return spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "centroid_id int, centroid array<double>")


def found(df):
    rows = df.collect()
    out = {(r.a_idx, r.b_idx): r.dist for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(5).standard_normal((160, 6)).astype(np.float32)


@pytest.fixture(scope="module")
def d(x):
    return ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)


@pytest.fixture
def copies(monkeypatch):
    """Rows of both sides that the last join by blocks got."""
    seen = {}

    def watched(a, b, *args, f=blocks.block_join, **more):
        seen["rows"] = a.count() + b.count()
        return f(a, b, *args, **more)

    for module in (blocks, clustering, joins):
        monkeypatch.setattr(module, "block_join", watched)
    return seen


def test_centroids_within_cluster_pairs(spark, x, d, copies):
    f, n, t = frame(spark, x), len(x), 5.0
    p = Params(threshold=t).replace(tile_rows={"centroid_centroid": 10}, centroid_batch={"centroid_threshold": 9.0, "sample_fraction": 1.0}, centroid_join={"n_clusters": 3, "k_db_candidates": 4, "sample_fraction": 1.0})
    got = found(vector_join(f, None, "centroid_centroid", p))
    assert copies["rows"] <= 5 * n  # not once for each pair of clusters
    big, c = clustering.fit_kmeans(f, n // 10), clustering.fit_kmeans(f, 3)
    left = clustering.balanced_assign(f, big)
    cluster = {r.vec_id: r.cluster for r in left.collect()}
    near = clustering.candidates(left, c, 4, within="cluster").collect()
    own = {r.vec_id: r.centroid_id for r in clustering.assign(f, c).collect()}
    plan = {(r.i, r.j) for r in clustering.schedule(big, 9.0, True).collect()}
    want = {(max(r.a_idx, b), min(r.a_idx, b)) for r in near for b in range(n) if own[b] == r.centroid_id and b != r.a_idx and (cluster[r.a_idx], cluster[b]) in plan and d[r.a_idx, b] <= t}
    assert got.keys() == want and len(want) > 20


def test_balanced_assignment_is_one_pass(spark, x, monkeypatch):
    calls = []
    monkeypatch.setattr(clustering, "saved", lambda df, name, *path, f=clustering.saved: calls.append(name) or f(df, name, *path))
    c = x[::10] * 0.05  # rows want the same clusters, and most get one by its id
    got = {r.vec_id: r.cluster for r in clustering.balanced_assign(frame(spark, x), centers(spark, c), 2).collect()}
    near = ((x[:, None].astype(float) - c[None].astype(float)) ** 2).sum(-1)
    wish, room, want = np.argsort(near, axis=1, kind="stable")[:, :2].tolist(), [10] * 16, {}
    for i in sorted(range(len(x)), key=lambda i: (near[i, wish[i][0]], i)):
        want[i] = next(k for k in [*wish[i], *range(16)] if room[k])
        room[want[i]] -= 1
    assert got == want and len(calls) == 1  # not a table for each round


def test_cluster_pairs(spark, x, d, copies):
    f, c, t = frame(spark, x), centers(spark, x[::8]), 6.0
    own = ((x[:, None].astype(float) - x[None, ::8].astype(float)) ** 2).sum(-1).argmin(1)
    rows = clustering.assign(f, c).withColumnRenamed("centroid_id", "cluster")
    for limit in (9.0, 4.0):  # most pairs of clusters, and few
        got = found(clustering.cluster_join(rows, None, clustering.schedule(c, limit, True), blocks.within(t)))
        want = {(a, b): d[a, b] for a in range(len(x)) for b in range(a) if d[a, b] <= t and d[own[a] * 8, own[b] * 8] <= limit}
        assert got == pytest.approx(want) and len(want) > 20
        assert copies["rows"] <= 2 * len(x)  # not once for each cluster that a row's own one meets
    cross = found(clustering.cluster_join(rows.where("vec_id < 60"), rows.where("vec_id >= 60"), clustering.schedule(c, 9.0, False), blocks.within(t), 7))
    assert cross.keys() == {(a, b) for a in range(60) for b in range(60, len(x)) if d[a, b] <= t and d[own[a] * 8, own[b] * 8] <= 9.0}


@pytest.mark.parametrize("n_probes,tile,t,sent", [(16, None, 6.0, None), (2, None, 6.0, None), (16, 50, 1e9, None), (3, 50, 1e9, 10)])
def test_lists(spark, x, d, copies, monkeypatch, n_probes, tile, t, sent):
    """Each row's nearest in the lists it looks into: most lists and few, any distance and near ones only, centroids sent and joined."""
    if sent:
        monkeypatch.setattr(clustering, "MAX_SENT", sent)
    n, k, lists = len(x), 4, range(0, len(x), 8)
    order = np.argsort(d[:, lists], axis=1, kind="stable")
    want = set()
    for b in range(n):
        asked = set(order[b, :n_probes].tolist())
        for lo in range(0, n, tile or n):
            near = sorted((d[b, a], a) for a in range(lo, min(n, lo + (tile or n))) if order[a, 0] in asked)[:k]
            want |= {(a, b) for x2, a in near if x2 <= t and a > b}
    got = found(joins.ivf_join(frame(spark, x), None, centers(spark, x[lists]), k, n_probes, t, tile_rows=tile))
    assert got.keys() == want and len(want) > 20
    assert copies["rows"] <= 2 * n  # not once for each list


def test_cluster_pairs_by_radii_lose_nothing(spark, x, d, copies):
    f, c, t = frame(spark, x), centers(spark, x[::8]), 3.0
    rows = clustering.assign(f, c).withColumnRenamed("centroid_id", "cluster")
    got = found(clustering.cluster_join(rows, None, clustering.schedule(c, t, True, clustering.radii(rows, c)), blocks.within(t)))
    assert got.keys() == {(a, b) for a in range(len(x)) for b in range(a) if d[a, b] <= t}
    assert copies["rows"] <= 2 * len(x)


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit,t", [(9.0, 6.0), (2.0, 6.0)])
def test_cluster_pairs_shuffle_no_copies(spark, x, d, limit, t):
    """Many blocks: each is stored once and read by pairs; nothing is grouped by them."""
    c = centers(spark, x[::8])
    own = ((x[:, None].astype(float) - x[None, ::8].astype(float)) ** 2).sum(-1).argmin(1)
    rows = clustering.assign(frame(spark, x), c).withColumnRenamed("centroid_id", "cluster")
    df = clustering.cluster_join(rows, None, clustering.schedule(c, limit, True), blocks.within(t), 7)
    assert "CoGroup" not in plan_of(df)
    assert found(df) == pytest.approx({(a, b): d[a, b] for a in range(len(x)) for b in range(a) if d[a, b] <= t and d[own[a] * 8, own[b] * 8] <= limit})


def test_kmeans_is_lloyds(spark, x, monkeypatch):
    """Each center is the mean of the rows nearest to it, however they are split, with sums added up by tasks or by the driver; the fit needs no other library's."""
    f = frame(spark, x)
    fit = lambda df: np.array([r.centroid for r in clustering.fit_kmeans(df, 6, max_iter=100).orderBy("centroid_id").collect()])
    c = fit(f)
    own = ((x[:, None].astype(float) - c[None]) ** 2).sum(-1).argmin(1)
    assert c == pytest.approx(np.array([x[own == k].astype(float).mean(0) for k in range(6)]), abs=1e-3)
    assert fit(f.repartition(5)) == pytest.approx(c)
    monkeypatch.setattr(clustering, "SUMS_SENT", 0)
    monkeypatch.setattr("pyspark.ml.clustering.KMeans.fit", None)
    assert fit(f) == pytest.approx(c)
    same = clustering.fit_kmeans(frame(spark, np.ones((9, 3), np.float32)), 4).collect()
    assert [r.centroid for r in same] == [[1.0, 1.0, 1.0]]


@pytest.mark.parametrize("scale,single", [(1.0, True), (1e-3, True), (1e18, False)])
def test_products_in_single_precision(x, d, scale, single):
    """Where their error is far below the threshold; pairs at exactly the threshold, and exact distances, stay."""
    t = float(np.sort(d[d > 0])[500]) * scale * scale
    y = x.astype(float) * scale
    tile = blocks.Tile(np.arange(len(y)), y, np.arange(len(y)), y)
    rough, eps = tile.rough(t)
    exact = tile.exact(*(v.ravel() for v in np.indices((len(y), len(y)))[::-1])).reshape(len(y), len(y))
    assert (rough.dtype == np.float32) == single and np.abs(rough - exact).max() <= eps
    t = float(np.sort(exact[exact > 0])[500])
    i, j, dist = blocks.within(t)(tile)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(exact.T <= t))} and (dist == exact[j, i]).all()
    far = blocks.Tile(tile.a, y + 1e5 * scale, tile.b, y + 1e5 * scale)
    assert far.rough(t)[0].dtype == np.float64  # norms far above the distances


def brute_hits(x, d, lists, k, n_probes, t):
    order, n = np.argsort(d[:, lists], axis=1, kind="stable"), len(x)
    hits = 0
    for b in range(n):
        asked = set(order[b, :n_probes].tolist())
        near = sorted((d[b, a], a) for a in range(n) if order[a, 0] in asked and d[b, a] <= t)[:k]
        hits += sum(a > b for _, a in near)
    return int((np.tril(d <= t, -1)).sum()), hits


@pytest.mark.parametrize("n_probes,t,sent", [(16, 6.0, None), (2, 6.0, None), (3, 1e9, None), (3, 6.0, 10)])
def test_hits_of_lists(spark, x, d, monkeypatch, n_probes, t, sent):
    """True pairs and those found, in blocks, with centroids sent and joined."""
    if sent:
        monkeypatch.setattr(clustering, "MAX_SENT", sent)
    lists = range(0, len(x), 8)
    row = joins.ivf_hits(frame(spark, x), centers(spark, x[lists]), 4, n_probes, t, rows_per_block=30).first()
    assert (row.n_truth, row.n_found) == brute_hits(x, d, lists, 4, n_probes, t)
    assert 20 < row.n_found < row.n_truth


def test_hits_of_lists_on_odd_rows(spark, x, d):
    """Rows that are not finite are in no pair and take nothing from others; repeated ids and copies count as in the two joins."""
    lists = range(0, len(x), 8)
    bad = np.full((2, x.shape[1]), [[np.nan], [np.inf]], np.float32)
    row = joins.ivf_hits(frame(spark, np.concatenate([x, bad])), centers(spark, np.concatenate([x[lists], bad])), 4, 16, 6.0, rows_per_block=30).first()
    assert (row.n_truth, row.n_found) == brute_hits(x, d, lists, 4, 16, 6.0)
    same = frame(spark, x).unionByName(frame(spark, x[::-1][:50])).unionByName(frame(spark, x).where("vec_id < 20").selectExpr("vec_id + 1000 as vec_id", "embedding"))
    got = metrics.share_found(joins.ivf_hits(same, centers(spark, x[lists]), 4, 5, 6.0, rows_per_block=30)).collect()
    assert got == metrics.recall(joins.ivf_join(same, None, centers(spark, x[lists]), 4, 5, 6.0), joins.threshold_join(same, None, 6.0)).collect()
    assert [tuple(r) for r in metrics.share_found(joins.ivf_hits(frame(spark, x).limit(0), centers(spark, x[lists]), 4, 5, 6.0)).collect()] == [(0, 0, 0.0)]


def test_hits_hold_few_rows(x, monkeypatch):
    """Many copies: what a pair of blocks holds and gives is bounded by k, in strips too."""
    n, c = 60, x[:3].astype(float).T
    v = np.repeat(x[:2], 30, axis=0).astype(float)
    block = lambda lo: pa.table({"vec_id": np.arange(lo, lo + n), "v": v.tolist(), "own": pa.array([0] * n, pa.int32()), "reach": [1e9] * n, "last": pa.array([2] * n, pa.int32())})
    want = [joins._hits_of(block(0), block(y), not y, 3, 1e-9, c).to_pylist() for y in (0, n)]
    assert [len(w) for w in want] == [3 * n + 1, 6 * n + 1] and [w[-1]["n"] for w in want] == [2 * 30 * 29 // 2, 2 * 30 * 30]
    monkeypatch.setattr(joins, "HELD", 100)
    monkeypatch.setattr(blocks, "STRIP", 7 * n)
    assert [joins._hits_of(block(0), block(y), not y, 3, 1e-9, c).to_pylist() for y in (0, n)] == want


def test_recall_of_lists_is_one_pass(spark, data, monkeypatch):
    """The query measures pairs once, in no join beside another, and stores blocks of rows once."""
    want = metrics.recall(catalogue._ivf_join(spark, data), joins.threshold_join(catalogue._vectors(spark, data), None, catalogue.T)).first()
    tables = []
    monkeypatch.setattr(blocks, "saved", lambda df, name, *path, f=blocks.saved, **more: tables.append(name) or f(df, name, *path, **more))
    for name in ("threshold_join", "ivf_join", "block_join"):
        monkeypatch.setattr(joins, name, None)
    row = catalogue.recall_ivf_vs_exact(spark, data).first()
    assert (row.n_truth, row.n_found) == (want.n_truth, want.n_found) and tables == ["blocks"]


@pytest.mark.parametrize("shape", [(0, 5), (3, 5), (4, 16), (7, 13)])
def test_places_held(shape):
    held = np.random.default_rng(1).random(shape) < 0.2
    assert [v.tolist() for v in blocks._places(held)] == [v.tolist() for v in np.nonzero(held)]
