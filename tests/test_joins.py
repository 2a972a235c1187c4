import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions import vectors as V
from tessera.operators import blocks, clustering, graph, joins, metrics
from tessera.storage import saved

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def brute(x, y=None, t=1.0, first=0):
    out = {}
    for i, a in enumerate(x):
        for j, b in enumerate(x if y is None else y):
            if (y is None and i > j) or y is not None:
                d = float(((a.astype(np.float64) - b.astype(np.float64)) ** 2).sum())
                if d <= t:
                    out[i, j + first] = d
    return out


def pairs(df):
    rows = df.collect()
    out = {(r.a_idx, r.b_idx): r.dist for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).standard_normal((120, 8)).astype(np.float32)


@pytest.mark.parametrize("rows", [7, 50, 4096])
def test_self_join_for_any_block_size(spark, x, rows):
    got, want = pairs(joins.threshold_join(frame(spark, x), None, 6.0, rows)), brute(x, t=6.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_cross_join(spark, x):
    a, b = x[:70], x[40:]
    got = pairs(joins.threshold_join(frame(spark, a), frame(spark, b, 500), 5.0, 16))
    assert got.keys() == brute(a, b, 5.0, 500).keys()
    assert got == pairs(joins.threshold_join_native(frame(spark, a), frame(spark, b, 500), 5.0))


def test_native_and_kernel_have_one_distance(spark, x):
    assert pairs(joins.threshold_join(frame(spark, x), None, 6.0)) == pairs(joins.threshold_join_native(frame(spark, x), None, 6.0))


def test_cross_with_itself_is_self_mirror_and_diagonal(spark, x):
    f = frame(spark, x)
    both, one = pairs(joins.threshold_join(f, f, 6.0)), pairs(joins.threshold_join(f, None, 6.0))
    assert both.keys() == one.keys() | {(b, a) for a, b in one} | {(i, i) for i in range(len(x))}


def test_threshold_is_inclusive_and_copies_are_kept(spark):
    v = np.array([[0, 0], [3, 4], [0, 0], [1e4, 1e4], [1e4, 1e4 + 0.001]], np.float32)
    got = pairs(joins.threshold_join(frame(spark, v), None, 25.0))
    assert got[1, 0] == 25.0 and got[2, 0] == 0.0 and (2, 1) in got and (4, 3) in got
    assert pairs(joins.threshold_join(frame(spark, v), None, 24.999)).keys() == {(2, 0), (4, 3)}


def test_empty_and_null_inputs(spark, x):
    f, none = frame(spark, x), frame(spark, x).limit(0)
    for df in (joins.threshold_join(none, None, 1.0), joins.threshold_join(f, none, 1.0), joins.threshold_join(none, f, 1.0), joins.knn_join(none, None, 3), joins.closest_pairs(none, None, 3), joins.tile_knn_threshold(none, None, 3, 1.0, 10), graph.graph_join(none, None, 3, 8, 1.0)):
        assert df.count() == 0
    odd = f.unionByName(spark.createDataFrame([(None, [0.0] * 8), (999, None)], SCHEMA))
    assert pairs(joins.threshold_join(odd, None, 6.0)) == pairs(joins.threshold_join(f, None, 6.0))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 40), st.integers(1, 4), st.integers(1, 30), st.integers(0, 9))
def test_any_size(spark, n, dim, rows, seed):
    v = np.random.default_rng(seed).integers(-2, 3, (n, dim)).astype(np.float32)
    assert pairs(joins.threshold_join(frame(spark, v), None, 2.0, rows)) == brute(v, t=2.0)


def knn(x, k, pool=None):
    out = {}
    for b in range(len(x)):
        d = ((x.astype(np.float64) - x[b].astype(np.float64)) ** 2).sum(axis=1)
        own = [a for a in (range(len(x)) if pool is None else pool)]
        out[b] = sorted(own, key=lambda a: (d[a], a))[:k]
    return out


@pytest.mark.parametrize("rows", [13, 4096])
def test_knn(spark, rows):
    v = np.random.default_rng(4).integers(0, 4, (60, 3)).astype(np.float32)  # with ties
    got = {}
    for r in joins.knn_join(frame(spark, v), None, 5, rows).collect():
        got.setdefault(r.b_idx, {})[r["rank"]] = r.a_idx
    want = {b: [a for a in near if a != b][:5] for b, near in knn(v, 61).items()}
    assert {b: [r[k] for k in sorted(r)] for b, r in got.items()} == want


def test_tile_knn_truncates_before_it_filters(spark, x):
    tile, k, t = 25, 4, 7.0
    want = set()
    for lo in range(0, len(x), tile):
        near = knn(x, k, range(lo, min(len(x), lo + tile)))
        for b in range(len(x)):
            if lo // tile >= b // tile:
                want |= {(a, b) for a in near[b] if a > b and ((x[a].astype(float) - x[b]) ** 2).sum() <= t}
    assert pairs(joins.tile_knn_threshold(frame(spark, x), None, k, t, tile)).keys() == want


def centers(spark, x, every=10):
    return spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x[::every])], "centroid_id int, centroid array<double>")


def test_approximate_joins_are_exact_at_their_limits(spark, x):
    f, c = frame(spark, x), centers(spark, x)
    exact = pairs(joins.threshold_join(f, None, 6.0))
    assert pairs(joins.ivf_join(f, None, c, len(x), 12, 6.0)) == exact  # every list is probed
    assert pairs(joins.centroid_join(f, None, c, len(x), 6.0)) == exact  # every row is a candidate
    assert pairs(joins.centroid_join(f, None, c, len(x), 6.0, n_probes=12)) == exact
    for got in (joins.ivf_join(f, None, c, 6, 2, 6.0), joins.centroid_join(f, None, c, 20, 6.0), joins.ivf_join(f, None, c, 6, 2, 6.0, rows_per_block=5)):
        assert pairs(got).items() <= exact.items()
    assert pairs(joins.ivf_join(f, None, c, 6, 2, 6.0)) == pairs(joins.ivf_join(f, None, c, 6, 2, 6.0, rows_per_block=5))


def test_closest_pairs(spark, x):
    every = sorted((d, b, a) for (a, b), d in brute(x, t=1e9).items())
    got = [(r.b_idx, r.a_idx) for r in joins.closest_pairs(frame(spark, x), None, 12, rows_per_block=31).collect()]
    assert got == [(b, a) for _, b, a in every[:12]]
    both = [(r.b_idx, r.a_idx) for r in joins.closest_pairs(frame(spark, x), None, 6, ordered=True).collect()]
    assert both == [p for _, b, a in every[:3] for p in ((b, a), (a, b))]
    twin = np.concatenate((x[:20], x[:3]))
    near = joins.closest_pairs(frame(spark, twin), None, 3, least=1e-4).collect()
    assert all(r.dist > 1e-4 for r in near) and joins.closest_pairs(frame(spark, twin), None, 1).first().dist == 0


def test_graph_recall(spark):
    v = np.random.default_rng(1).standard_normal((1500, 8)).astype(np.float32)
    exact = pairs(joins.threshold_join(frame(spark, v), None, 1.5))
    got = pairs(graph.graph_join(frame(spark, v), None, 32, 64, 1.5))
    assert got.items() <= exact.items() and len(got) >= 0.9 * len(exact) > 20


def test_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], "1.5", "x")], "a array<float>, b array<float>, s string, bad string")
    got = row.select(V.norm2("a").alias("n"), V.dot("a", "a").alias("d"), V.sqdist("a", "b").alias("q"), V.normalize("a").alias("u"), V.normalize("b").alias("z"), V.numeric("s").alias("s"), V.numeric("bad").alias("bad"),
                     V.sqdist_expanded(V.norm2("a"), V.norm2("b"), V.dot("a", "b")).alias("e"), V.path_part("bad", "(x)").alias("p")).first()
    assert (got.n, got.d, got.q, got.u, got.z, got.s, got.bad, got.e, got.p) == (25.0, 25.0, 25.0, [0.6, 0.8], [0.0, 0.0], 1.5, None, 25.0, "x")


def greedy(x, c, choices):
    """Rows one by one in order of their first choice's distance."""
    d = ((x[:, None].astype(float) - c[None].astype(float)) ** 2).sum(-1)
    rank = np.argsort(d, axis=1, kind="stable")[:, :choices]
    room = [-(-len(x) // len(c))] * len(c)
    out = {}
    for i in sorted(range(len(x)), key=lambda i: (d[i, rank[i, 0]], i)):
        k = next((int(k) for k in [*rank[i], *range(len(c))] if room[int(k)]))
        room[k] -= 1
        out[i] = k
    return out


@pytest.mark.parametrize("seed,choices", [(0, 10), (1, 2)])
def test_balanced_assignment_is_the_greedy_one(spark, seed, choices):
    v = np.random.default_rng(seed).standard_normal((90, 4)).astype(np.float32)
    c = v[:7] * (0.2 if seed else 1)
    table = spark.createDataFrame([(i, u.astype(float).tolist()) for i, u in enumerate(c)], "centroid_id int, centroid array<double>")
    got = {r.vec_id: r.cluster for r in clustering.balanced_assign(frame(spark, v), table, choices).collect()}
    assert got == greedy(v, c, choices)


def test_a_cluster_that_all_ask_for_is_ranked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(clustering, "RANKED_AT_ONCE", 0)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((120, 4)).astype(np.float32)
    c = np.concatenate((np.zeros((1, 4)), rng.standard_normal((5, 4)) * 50)).astype(np.float32)
    table = spark.createDataFrame([(i, u.astype(float).tolist()) for i, u in enumerate(c)], "centroid_id int, centroid array<double>")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = {r.vec_id: r.cluster for r in clustering.balanced_assign(frame(spark, v), table, 2).collect()}
        rows = [(i % 3 // 2, float(i % 50), i) for i in range(400)]  # most in one cluster, with ties
        asked = saved(clustering._ranges(spark.createDataFrame(rows, "cluster int, first double, vec_id long").repartition(5)), "asked")
        for capacity in (1, 90, 200, 500):
            over = {r.vec_id for r in clustering._over(asked, clustering._beyond(asked, capacity), capacity).where("over").collect()}
            assert over == {r[2] for k in (0, 1) for r in sorted(x for x in rows if x[0] == k)[capacity:]}
        assert asked.where("cluster = 0").select("piece").distinct().count() > 2
    finally:
        spark.conf.set(key, was)
    assert got == greedy(v, c, 2)


def test_bound_schedule_loses_nothing_and_centroid_schedule_may(spark, x):
    f, c = frame(spark, x), centers(spark, x)
    a = clustering.balanced_assign(f, c)
    exact = pairs(joins.threshold_join(f, None, 3.0))
    plan = clustering.schedule(c, 3.0, True, clustering.radii(a, c))
    assert pairs(clustering.cluster_join(a, None, plan, blocks.within(3.0))) == exact
    assert pairs(clustering.cluster_join(a, None, clustering.schedule(c, None, True), blocks.within(3.0), 9)) == exact
    some = clustering.schedule(c, 6.0, True)
    assert pairs(clustering.cluster_join(a, None, some, blocks.within(3.0))).items() <= exact.items()
    row = clustering.prune_ratio(some, c.count(), True).first()
    assert row.possible == 78 and row.prune_ratio == pytest.approx(1 - row.scheduled / 78)


def test_large_centroid_tables_are_joined(spark, x, monkeypatch):
    f, c = frame(spark, x), centers(spark, x)
    sent = sorted((r.vec_id, r.centroid_id, r.probe) for r in clustering.probes(f, c, 3).collect())
    monkeypatch.setattr(clustering, "MAX_SENT", 10)
    assert sorted((r.vec_id, r.centroid_id, r.probe) for r in clustering.probes(f, c, 3).collect()) == sent


def test_samples_and_fits(spark, x):
    f = frame(spark, x)
    one = [r.vec_id for r in clustering.sample_exact(f, 30).collect()]
    assert len(set(one)) == 30 and one == [r.vec_id for r in clustering.sample_exact(f.repartition(5), 30).collect()]
    assert clustering.sample_exact(f, 500).count() == len(x)
    order = [r.vec_id for r in clustering.shuffled(f).collect()]
    assert sorted(order) == list(range(len(x))) != order == [r.vec_id for r in clustering.shuffled(f.repartition(7)).collect()]
    assert order != [r.vec_id for r in clustering.shuffled(f, 1).collect()]
    assert clustering.fit_kmeans(f, 5).count() == 5 and clustering.fit_kmeans(f, 1).count() == 1
    assert clustering.fit_kmeans(f.limit(0), 5).count() == 0 and clustering.fit_kmeans(f.limit(3), 10).count() <= 3


def test_metrics(spark, x):
    f = frame(spark, x)
    truth = joins.threshold_join(f, None, 6.0)
    want = np.zeros(len(x))
    for a, b in pairs(truth):
        want[a] += 1
        want[b] += 1
    r = metrics.degree_stats(truth, f, True).first()
    assert (r.n_points, r.min_degree, r.max_degree) == (len(x), want.min(), want.max())
    assert r.mean_degree == pytest.approx(want.mean()) and r.std_degree == pytest.approx(want.std())
    cross = metrics.neighbor_counts(joins.threshold_join(f, f, 0.0), f, False).collect()
    assert {r.degree for r in cross} == {1}
    assert metrics.recall(truth, truth).first()["recall"] == 1.0
    assert metrics.recall(truth.unionAll(truth), truth).first()["recall"] == 1.0
    assert metrics.recall(truth, truth.limit(0)).first()["recall"] == 0.0
    half = truth.where("a_idx % 2 = 0")
    assert metrics.recall(half, truth).first()["recall"] == pytest.approx(half.count() / truth.count())
    assert metrics.shared_pairs(half, truth).count() == half.count()
    assert metrics.deduplicated(truth.unionAll(truth)).count() == truth.count()
    tiles = metrics.pairs_compared_by_tile(f, 32).collect()
    assert sum(t.pairs for t in tiles) == len(x) * (len(x) - 1) // 2
    assert sum(t.pairs for t in metrics.pairs_compared_by_tile(f, 32, f).collect()) == len(x) ** 2
