import struct

import numpy as np
import pytest

from tessera.params import Params
from tessera.plans import methods, sweep
from tessera.sources import results
from tessera.sources.results import ResultStore
from tessera.sources.synthetic import Dataset, random_vectors
from tessera.sources.vector_files import FORMATS, load_vectors, save_vectors, shape
from tessera.streaming.incremental import degrees_of, join_stream


def raw(fmt, x):
    dtype, whole = FORMATS[fmt]
    x = x.astype(dtype)
    if whole:
        return struct.pack("<II", *x.shape) + x.tobytes()
    return b"".join(struct.pack("<i", x.shape[1]) + v.tobytes() for v in x)


@pytest.mark.parametrize("fmt", FORMATS)
def test_files(spark, tmp_path, fmt):
    x = np.random.default_rng(0).integers(0, 256, (57, 6)).astype(np.float32)
    path = tmp_path / f"x.{fmt}"
    path.write_bytes(raw(fmt, x))
    assert shape(str(path), fmt) == (57, 6)
    for where in (str(path), f"file://{path}"):
        df = load_vectors(spark, where, fmt)
        assert df.dtypes == [("vec_id", "bigint"), ("embedding", "array<float>")]
        assert [(r.vec_id, r.embedding) for r in df.orderBy("vec_id").collect()] == [(i, v.tolist()) for i, v in enumerate(x)]
    split = spark.read.format(fmt).option("rowsPerTask", "10").load(str(path))
    assert split.rdd.getNumPartitions() == 6 and split.count() == 57
    for most, n in ((0, 57), (None, 57), (20, 20), (500, 57)):
        got = load_vectors(spark, str(path), fmt, most)
        assert got.count() == n and got.agg({"vec_id": "max"}).first()[0] == n - 1
    with pytest.raises(Exception, match="6 dimensions"):
        load_vectors(spark, str(path), fmt, dim=7).count()
    assert Dataset(str(path), fmt, 6).load(spark, 3).count() == 3


@pytest.mark.parametrize("fmt", FORMATS)
def test_written_files_read_back(spark, tmp_path, fmt):
    x = np.random.default_rng(1).integers(0, 256, (40, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    save_vectors(df, str(tmp_path / fmt), fmt)
    save_vectors(df, str(tmp_path / fmt), fmt)  # replaces
    back = load_vectors(spark, str(tmp_path / fmt), fmt).orderBy("vec_id").collect()
    assert [r.embedding for r in back] == x.tolist()


def test_odd_files(spark, tmp_path):
    x = np.ones((3, 4), np.float32)
    cut = tmp_path / "cut.bvecs"
    cut.write_bytes(raw("bvecs", x) + b"\x04\x00\x00\x00\x01")  # a partial last row
    assert load_vectors(spark, str(cut), "bvecs").count() == 3
    empty = tmp_path / "empty.fvecs"
    empty.write_bytes(b"")
    assert load_vectors(spark, str(empty), "fvecs").count() == 0
    none = tmp_path / "none.u8bin"
    none.write_bytes(struct.pack("<II", 0, 8))
    assert load_vectors(spark, str(none), "u8bin").count() == 0
    mixed = tmp_path / "mixed.fvecs"
    mixed.write_bytes(raw("fvecs", x) + struct.pack("<i", 3) + bytes(16))
    with pytest.raises(Exception, match="differ"):
        load_vectors(spark, str(mixed), "fvecs").count()
    with pytest.raises(ValueError, match="unknown format"):
        load_vectors(spark, "x", "csv")
    with pytest.raises(Exception, match="nowhere"):
        load_vectors(spark, str(tmp_path / "nowhere.fbin"), "fbin").count()


def test_random_vectors(spark):
    a, b = (random_vectors(spark, 50, 6).orderBy("vec_id").collect() for _ in range(2))
    assert a == b and all(abs(sum(c * c for c in r.embedding) - 1) < 1e-5 for r in a)
    assert random_vectors(spark, 50, 6, seed=1).orderBy("vec_id").collect() != a
    assert all(0 <= c < 1 for r in random_vectors(spark, 20, 3, unit=False).collect() for c in r.embedding)


def test_params():
    p = Params()
    q = p.replace(threshold=2.0, cuvs_ivf_flat={"k": 7}, tile_rows={"brute_force": 9})
    assert (q.threshold, q.cuvs_ivf_flat.k, q.cuvs_ivf_flat.n_lists, q.tile_rows["brute_force"]) == (2.0, 7, 1024, 9)
    assert p == Params() and p.tile_rows["brute_force"] == 25_000
    with pytest.raises(Exception):
        p.threshold = 1.0
    assert q.as_dict()["cuvs_ivf_flat"] == {"k": 7, "n_lists": 1024, "n_probes": 20}
    assert Params().replace(cuvs_cagra={"k": 100, "itopk_size": 10}).cuvs_cagra.beam == 100


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).standard_normal((150, 6)).astype(np.float32))], "vec_id long, embedding array<float>").cache()


SMALL = Params(threshold=3.0).replace(
    tile_rows={"centroid_batch": 40, "centroid_centroid": 80}, centroid_join={"n_clusters": 6, "k_db_candidates": 150, "sample_fraction": 0.5}, centroid_batch={"centroid_threshold": 1e9}, cuvs_ivf_flat={"k": 150, "n_lists": 5, "n_probes": 5}, cuvs_brute_force={"k": 150}, cuvs_cagra={"k": 64, "itopk_size": 150}
)


@pytest.mark.parametrize("method", methods.METHODS)
def test_methods_find_everything_with_generous_parameters(spark, vectors, method):
    want = {(r.a_idx, r.b_idx) for r in methods.vector_join(vectors, None, "brute_force", SMALL).collect()}
    got = [(r.a_idx, r.b_idx) for r in methods.vector_join(vectors, None, method, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= (0.95 if "cagra" in method else 1) * len(want)
    a, b = vectors.where("vec_id < 90"), vectors.where("vec_id >= 60")
    want = {(r.a_idx, r.b_idx) for r in methods.vector_join(a, b, "brute_force", SMALL).collect()}
    got = {(r.a_idx, r.b_idx) for r in methods.vector_join(a, b, method, SMALL).collect()}
    assert got <= want and len(got) >= (0.95 if "cagra" in method else 1) * len(want)


def test_metadata_of_clusters_and_counters(spark, vectors, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/runs")
    m = methods.run_method(store, vectors, None, "centroid_batch", SMALL).metadata
    assert m["n_clusters"] == 4 and m["total_possible_tiles"] == 10 and m["scheduled_tiles"] == m["n_tiles"] <= 10 and 0 <= m["prune_ratio"] <= 1
    assert m["total_pairs_compared"] == 150 * 149 // 2 * (m["scheduled_tiles"] == 10) or m["total_pairs_compared"] < 150 * 149 // 2
    small = SMALL.replace(tile_rows={"brute_force": 40, "cuvs_ivf_flat": 50, "centroid_join": 50, "cuvs_cagra": 60})
    assert methods.run_method(store, vectors, None, "brute_force", small).metadata["n_tiles"] == 10  # 4 blocks
    ivf = methods.run_method(store, vectors, None, "cuvs_ivf_flat", small).metadata
    assert ivf["n_tiles"] == 6 and ivf["build_time_s"] > 0
    assert methods.run_method(store, vectors, None, "centroid_join", small).metadata["total_pairs_compared"] == 150 * 150  # every row is a candidate of each tile
    rows = {r["method"]: r for r in methods.compare_runs(store, vectors.select("vec_id"))}
    assert {r["recall"] for r in rows.values()} == {1.0} and rows["brute_force"]["n_tiles"] == 10
    known = results.read_metadata(spark, f"{store.folder}/*/metadata.json").where("method = 'centroid_batch'").first()
    assert known.n_clusters == 4 and known.total_possible_tiles == 10


def test_candidates_are_of_each_tile(spark, vectors):
    """k counts in each tile: two nearest of every range of 30 ids, by hand."""
    small = SMALL.replace(tile_rows={"cuvs_ivf_flat": 30, "cuvs_cagra": 30}, cuvs_ivf_flat={"k": 2}, cuvs_cagra={"k": 2, "itopk_size": 30})
    x = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()])
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)
    want = set()
    for b in range(150):
        for lo in range(b // 30 * 30, 150, 30):
            near = sorted(range(lo, lo + 30), key=lambda a: (d[a, b], a))[:2]
            want |= {(a, b) for a in near if a > b and d[a, b] <= 3.0}
    assert {(r.a_idx, r.b_idx) for r in methods.vector_join(vectors, None, "cuvs_ivf_flat", small).collect()} == want  # all lists are probed
    got = {(r.a_idx, r.b_idx) for r in methods.vector_join(vectors, None, "cuvs_cagra", small).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_own_methods(spark, vectors):
    with pytest.raises(ValueError):
        methods.vector_join(vectors, None, "mine")
    methods.register("mine", lambda a, b, p, stats: methods.brute_force(a, b, p.replace(threshold=p.threshold / 2), stats))
    try:
        assert methods.vector_join(vectors, None, "mine", SMALL).agg({"dist": "max"}).first()[0] <= 1.5
    finally:
        del methods.METHODS["mine"]


def test_store_and_sweep(spark, vectors, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/runs")
    assert store.runs() == []
    with pytest.raises(FileNotFoundError):
        store.load("brute_force")
    grids = {"cuvs_ivf_flat": {"k": [8, 150], "n_lists": [4], "n_probes": [1, 4, 9]}, "centroid_join": {"n_clusters": [4], "k_db_candidates": [20, 150]}, "cuvs_cagra": {"k": [32], "itopk_size": [16]}}
    out = sweep.run_sweep(store, vectors, None, SMALL, grids)
    rows = {r.method_name: r for r in out.collect()}
    assert sorted(rows) == ["brute_force", "centroid_join_nc4_kdb150", "centroid_join_nc4_kdb20", "cuvs_ivf_flat_k150_nl4_np1", "cuvs_ivf_flat_k150_nl4_np4", "cuvs_ivf_flat_k8_nl4_np1", "cuvs_ivf_flat_k8_nl4_np4"]
    assert rows["brute_force"].recall == 1.0 and rows["cuvs_ivf_flat_k150_nl4_np4"].recall == 1.0 == rows["centroid_join_nc4_kdb150"].recall
    assert rows["cuvs_ivf_flat_k8_nl4_np1"].n_probes == 1 and rows["centroid_join_nc4_kdb20"].k_db_candidates == 20 and rows["brute_force"].k is None
    before = store.load("centroid_join_nc4_kdb20").metadata["time_s"]
    sweep.run_sweep(store, vectors, None, SMALL, grids)  # nothing runs again
    assert store.load("centroid_join_nc4_kdb20").metadata["time_s"] == before
    back = results.read_sweep(spark, f"{store.folder}/sweep_summary.csv")
    assert back.count() == 7 and back.where("method_name = 'brute_force'").first().pair_count == len(store.load("brute_force"))
    run = store.load("brute_force")
    assert sum(map(len, run.chunks(100))) == run.pair_count == run.pairs.count()
    meta = results.read_metadata(spark, f"{store.folder}/*/metadata.json")
    assert meta.count() == 7 and meta.where("base_method = 'brute_force'").first().total_pairs_compared == 150 * 149 // 2
    got = results.collect_runs(spark, f"{store.folder}/*/metadata.json", layout=r"(tmp|runs)/([^/]+)/metadata\.json$")
    assert got.where("method = 'brute_force'").first()["recall"] == 1.0
    assert sweep.time_split(got).count() == 7 and sweep.centroid_points(back).count() == 2 and sweep.by_value(back, "n_probes").count() == 3


def test_runs_of_several_datasets(spark, tmp_path):
    for name in ("X", "Y"):
        for method, t in (("brute_force", 9.0), ("centroid_join", 2.0), ("other", 1.0)):
            results.write_text(spark, f"file://{tmp_path}/{name}/10M/{method}/metadata.json", f'{{"method": "{method}",\n "time_s": {t}, "cluster_time_s": 0.5, "params": {{"threshold": 1}}}}')
        results.write_text(spark, f"file://{tmp_path}/{name}/10M/statistics.json", '[{"method": "centroid_join", "recall": 0.75},\n {"method": "brute_force"}]')
    stats = results.statistics_table(spark, f"file://{tmp_path}/*/10M/statistics.json")
    got = {(r.dataset, r.method): (r.recall, r.join_time_s) for r in results.collect_runs(spark, f"file://{tmp_path}/*/10M/*/metadata.json", stats).collect()}
    assert got == {(d, m): v for d in ("X", "Y") for m, v in (("brute_force", (1.0, 8.5)), ("centroid_join", (0.75, 1.5)), ("other", (None, 0.5)))}


def test_report():
    text = results.report([{"method": "a", "time_s": 1.23456, "pair_count": 7, "recall": None}])
    assert text.splitlines()[1].split() == ["a", "1.235", "7"]


def test_pareto(spark):
    rows = [("a", "m", 1.0, 9.0), ("b", "m", 0.9, 5.0), ("c", "m", 0.8, 5.0), ("d", "m", 0.7, 6.0), ("e", "m", 0.6, 1.0), ("f", "n", 0.1, 7.0), ("g", "m", None, 0.1), ("h", "m", 0.9, 8.0)]
    df = spark.createDataFrame(rows, "method_name string, base_method string, recall double, time_s double")
    assert sorted(r.method_name for r in sweep.pareto(df).collect()) == ["a", "b", "e", "f"]


def test_grid():
    names = [n for n, _, _ in sweep.grid()]
    assert len(names) == len(set(names)) == 9 + 72 + 30 and "cuvs_cagra_k64_itopk32" not in names and "cuvs_ivf_flat_k64_nl128_np2" in names


def test_legacy_triplets(spark, tmp_path):
    rows = [(5, 1, 0.5), (7, 2, 1.25), (9, 3, 0.0)]
    df = spark.createDataFrame(rows, results.PAIRS).coalesce(1)
    assert results.write_triplets(df, str(tmp_path / "run")) == 3
    assert sorted(tuple(r) for r in results.read_triplets(spark, str(tmp_path / "run"), 2).collect()) == rows
    assert results.write_triplets(df.limit(0), str(tmp_path / "none")) == 0
    assert results.read_triplets(spark, str(tmp_path / "none")).count() == 0 == results.read_triplets(spark, str(tmp_path / "absent")).count()


def test_stream(spark, vectors, tmp_path):
    base, new = vectors.where("vec_id < 100"), vectors.where("vec_id >= 100")
    source = str(tmp_path / "in")
    new.where("vec_id < 120").coalesce(1).write.mode("append").parquet(source)
    args = (base, 3.0, str(tmp_path / "out"), str(tmp_path / "check"))
    stream = lambda: spark.readStream.schema("vec_id long, embedding array<float>").parquet(source)
    join_stream(stream(), *args, once=True).awaitTermination()
    new.where("vec_id >= 120").coalesce(1).write.mode("append").parquet(source)
    join_stream(stream(), *args, once=True).awaitTermination()  # takes up where it stopped
    got = spark.read.parquet(str(tmp_path / "out"))
    want = methods.vector_join(base, new, "brute_force", SMALL)
    assert sorted((r.a_idx, r.b_idx) for r in got.collect()) == sorted((r.a_idx, r.b_idx) for r in want.collect())
    assert degrees_of(got).agg({"degree": "sum"}).first()[0] == want.count()


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 66
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q)


def test_quick_comparison(spark, vectors, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/quick")
    got = {r["method"]: r for r in methods.run_quick(store, vectors.where("vec_id < 60"), None, 3.0, ["centroid", "brute_force"])}
    assert got["brute_force"]["recall"] == got["centroid"]["recall"] == 1.0 and got["centroid"]["n_points"] == 60 and got["centroid"]["n_neighbors_max"] >= got["centroid"]["n_neighbors_mean"] >= got["centroid"]["n_neighbors_min"]
    with pytest.raises(ValueError):
        methods.run_quick(store, vectors, None, 3.0, ["other"])
