import hashlib
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import common, queries, substring

SCHEMA = "doc_id long, text string"


def slow(rows):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared, rows = [text(60), text(80), text(50)], []
    for d in range(60):
        w = text(rng.randint(0, 150))
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = s
        if rows and rng.random() < 0.3:
            w = rows[rng.randrange(len(rows))][1].split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
        rows.append((d, rng.choice([" ", "\n", "  "]).join(w)))
    rng.shuffle(rows)
    return rows + [(100, "w1 " * 300), (101, "w1 " * 120), (102, None), (103, ""), (None, rows[0][1]), rows[3], (rows[4][0], rows[5][1])]


@pytest.mark.parametrize("batches,fan_out,hot", [(1, 8, 100), (3, 1, 100), (5, 2, 3), (4, 8, 2), (4, 1, 1)])
def test_against_brute_force(spark, batches, fan_out, hot):
    rows = corpus(batches)
    df = spark.createDataFrame([(*r, "x", 3, 1, 2, "r", 5) for r in rows], SCHEMA + ", ranges string, hits int, _id int, _th int, _ranges string, _n_words int")
    got = substring.deduplicate(df, batches, fan_out, hot=hot)
    assert got.columns == [*df.columns, "__n_words", "_n_removed"]
    have = sorted(((r.doc_id, r["__n_words"], r._n_removed, " ".join((r.text or "").split())) for r in got.collect()), key=str)
    assert have == slow(rows)


def test_unchanged_texts_stay_as_they_are(spark):
    rows = [(1, "  a\n\nb  "), (2, None), (3, "")]
    got = substring.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows
    assert substring.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_reopens_and_compacts(spark, tmp_path):
    w = [f"t{i}" for i in range(90)]
    batches = [[(1, " ".join(w))], [(2, " ".join(["x", *w, "y"]))], [(3, "z " + " ".join(w[:70]))]]
    path, hits, dead = f"file://{tmp_path}/index", [], []
    for rows in batches:  # a new object each time: state is in the files alone
        index = substring.FingerprintIndex(spark, path, fan_out=1)
        h, d = index.ingest(spark.createDataFrame(rows, SCHEMA))
        hits.append(h)
        dead.append(d)
        assert len(index.runs) <= 2
    texts = spark.createDataFrame(sum(batches, []), SCHEMA)
    got = index.verify(texts, hits[0].unionAll(hits[1]).unionAll(hits[2]), dead[0].unionAll(dead[1]).unionAll(dead[2]))
    kept = {r.doc_id: substring.kept_words(substring.split_words(dict(sum(batches, []))[r.doc_id]), *np.array(r.ranges).T) for r in got.collect()}
    assert kept == {2: [b"x", b"y"], 3: [b"z"]}


def test_history_is_not_shuffled(spark, tmp_path):
    """A merge with the runs, and a compaction, read bucket by bucket: no exchange."""
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=5)
    rows = corpus(9)[:60]
    for lo in (0, 20, 40):
        index.ingest(spark.createDataFrame([r for r in rows if lo <= r[0] < lo + 20], SCHEMA))
    assert len(index.runs) == 3
    slot = Window.partitionBy("slot")
    plans = [
        index._classes(index.segments.merged()).withColumn("mixed", F.max("s1").over(slot)),
        index.copies.merged().groupBy("d1", "d2").agg(F.min("first")),
    ]
    for p in plans:
        p.collect()
        assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
        seen = p.select(*p.columns[:2]).collect()
        assert len(seen) == len(set(seen))  # and yet each group is in one task
    folder = index.segments.folder.removeprefix("file://")
    files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert 3 < len(files) <= 15  # one sorted file a run and bucket at most
    for f in files:
        t = pq.read_table(f"{folder}/{f}").to_pydict()
        keys = list(zip(t["slot"], t["s1"], t["s2"]))
        assert keys == sorted(keys) and len(set(t["run"])) == 1
    before = sorted(tuple(r) for r in index._classes(index.segments.merged()).drop("fresh").collect())
    index.compact()
    assert len(index.runs) == 1 and sorted(tuple(r) for r in index._classes(index.segments.merged()).drop("fresh").collect()) == before
    index.drop()


def test_one_key_may_hold_most_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k, f"v{k}") for k in range(300)], "k long, id long, v string")
    known = rows.groupBy("k").count().select("k", (F.col("k") * 10).alias("ten"), F.col("count").alias("n"))
    want = sorted(tuple(r) for r in rows.join(known.drop("n"), "k").select("k", "id", "v", "ten").collect())
    for keys in (2, 5, 10_000):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        got = common.join_known(rows, known.where("k <> 2"), ["k"]).select("k", "id", "v", "ten")
        assert sorted(tuple(r) for r in got.collect()) == [r for r in want if r[0] != 2]
    assert common.join_known(rows, known.limit(0), ["k"]).count() == 0


def test_candidates_are_confirmed_on_words(spark, monkeypatch):
    """With an index hash that collides all the time, only what the words have in common goes."""
    rows = corpus(4)
    weak = substring.Hashed.segments

    def segments(self):
        anchor, s1, s2, lo, hi = weak(self)
        return anchor % np.uint64(7), s1 % np.uint64(50), s2 % np.uint64(1), lo, hi

    monkeypatch.setattr(substring.Hashed, "segments", segments)
    df = spark.createDataFrame(rows, SCHEMA)
    index = substring.FingerprintIndex(spark)
    hits, dead = index.ingest(df)
    gone = {(r.doc_id, r.th): r.ranges for r in index.verify(df, hits, dead).collect()}
    first = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), d), d)
    text = {(r.doc_id, r.th): r.text for r in df.withColumn("th", substring._text_hash("text")).collect()}
    for key, ranges in gone.items():
        w = text[key].split()
        for r in ranges:
            for i in range(r.lo, r.hi + 1):
                assert first[tuple(w[i : i + 50])] < key[0]


def test_query_digest(spark, data):
    row = queries.op4_substring(spark, data).where(F.col("n_removed") == 0).first()
    text = spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.kept_sha256 == hashlib.sha256(" ".join(text.split()).encode()).hexdigest()
