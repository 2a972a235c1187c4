import random

import pytest
import xxhash

from tessera.llm import components, simhash

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """ids -> smallest reachable id."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(fps))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A a A a A a", "É é x y z w", "word " * 5000, "x" * 100000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("hot", [4096, 8])
def test_links_reach_what_all_pairs_reach(spark, hot):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:
        fps |= {near(rng, f, k) for k in (1, 2, 3, 4, 4, 5, 6)}
    base = rng.getrandbits(64)
    fps |= {near(rng, base, rng.randint(0, 4)) for _ in range(150)}  # a dense group
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = simhash.links(df, hot)
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    place = {f: i for i, f in enumerate(fps)}
    roots = {r.node & (2**64 - 1): r.root for r in components.connected_components(found).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(f, ("alone", f)), set()).add(place[f])
    want = {}
    for i, r in slow_components(list(enumerate(fps))):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_hot_keys_link_indexed_fingerprints_of_any_block(spark):
    """Two bits of segment 2: all viable starts have an equal next segment, and all their keys are hot."""
    rng = random.Random(5)
    want, fps = [], []
    for _ in range(12):
        base, x = rng.getrandbits(64) & ~(0x1FFF << simhash.SHIFTS[2]), rng.getrandbits(13)
        y = x ^ 1 ^ (1 << rng.randint(1, 12))
        far = [v for v in range(1 << 13) if (v ^ x).bit_count() > 4 and (v ^ y).bit_count() > 4]
        want.append({base | x << simhash.SHIFTS[2], base | y << simhash.SHIFTS[2]})
        fps += [*want[-1], *(base | v << simhash.SHIFTS[2] for v in rng.sample(far, 60))]
    found = simhash.links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"), 8)
    pairs = [{r.a & (2**64 - 1), r.b & (2**64 - 1)} for r in found.collect()]
    assert [w for w in want if w not in pairs] == []


def test_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = {d: slow_fingerprint(t) for d, t in rows}
    comp = dict(slow_components(sorted(fps.items())))
    assert got == sorted((d, f"{fps[d]:016x}", comp[d]) for d, _ in rows)


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, "\n"), (7, "same text here now"), (7, "same text here now"), (8, "same text here now"), (None, "alone and without any id"), (2, "quite another thing to say")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (7, 7), (8, 7), (None, None), (2, 2)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA + ", fp int, component_id string, _fp int, __fp int")
    kept = simhash.keep_one(extra)
    assert kept.columns == extra.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["2", "3", "7", "None"]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components.connected_components(edges.limit(0)).count() == 0
