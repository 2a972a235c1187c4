import numpy as np

from tessera.llm import rabitq

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, list(map(float, map(np.float32, v)))), list(map(float, map(np.float32, v))))
    out = {}
    for q, x in good.items():
        if q % 20 == 0:
            s = []
            for i, v in good.items():
                if i != q:
                    d = 0.0
                    for a, b in zip(v, x):
                        d += a * b
                    s.append((-d, i))
            out[q] = [(i, -d) for d, i in sorted(s)[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = result(rabitq.search(spark.createDataFrame(rows, SCHEMA))), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q in want:
        for i, s in got[q]:
            assert s == dict(brute([rows[q], rows[i]], 1)[q])[i] if i % 20 else True


def test_ties_and_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(i, v) for i in range(100)] + [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [1.0, float("nan"), 0.0]), (280, [float("inf"), 0.0, 0.0]), (300, []), (None, v), (0, v), (20, [9.0, 9.0, 9.0]), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", code string")
    got = result(rabitq.search(df))
    rows = [r for r in rows if r[1] is None or len(r[1]) == 3]
    assert got == brute(rows)
    assert rabitq.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, v), (1, [1.0, 0.0, 0.0]), (2, v)], SCHEMA)
    assert [i for i, _ in result(rabitq.search(few))[0]] == [2, 1]


def test_estimates_are_within_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    r = rabitq.rotation(64)
    assert all(np.allclose(q @ q.T, np.eye(64)) for q in np.split(r, rabitq.TURNS))
    y = x @ r.T
    norm = np.linalg.norm(x, axis=1)
    fit = np.abs(y).sum(axis=1) / 8 / rabitq.TURNS / norm
    guess = norm / fit * (np.sign(y) / 8 / rabitq.TURNS @ (r @ q))
    wide = norm * np.sqrt(1 - fit**2) / fit * rabitq.EPSILON / np.sqrt(rabitq.TURNS * 64 - 1) * np.linalg.norm(q)
    assert (guess - x @ q).mean() < 0.1 and (np.abs(guess - x @ q) <= wide).mean() > 0.9
