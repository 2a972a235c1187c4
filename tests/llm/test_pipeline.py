import os

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontam, simhash, substring


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]
    at, frames = docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        at = substring.saved(stage(spark, at, data), name)
        frames.append(at)
    assert all(f.columns == docs.columns and f.dtypes == docs.dtypes for f in frames[:-1])
    known, near, cut, clean, packed = ([r for r in f.collect()] for f in frames[1:])
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(known) >= 0.99 * len(text) and all(text[r.doc_id] == r.text for r in known)
    # one of each group of near duplicates
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(frames[1]).collect()}
    assert sorted(r.doc_id for r in near) == sorted(set(groups.values()))
    # no window of 50 words is left that starts in two documents of the stage's input
    before = {r.doc_id: (r.text or "").split() for r in near}
    first = {}
    for d in sorted(before):
        for i in range(len(before[d]) - 49):
            first.setdefault(tuple(before[d][i : i + 50]), d)
    for r in cut:
        w, gone = before[r.doc_id], set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < r.doc_id:
                gone.update(range(i, i + 50))
        assert (r.text or "").split() == [x for i, x in enumerate(w) if i not in gone]
        assert r.n_chars == len(r.text)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    index = decontam.ItemIndex(items)
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in cut if not index.find(r.text))
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    assert corpus_pipeline.run(spark, data).count() == len(packed)


def test_odd_rows(spark, data, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, and empty tables."""
    for name in os.listdir(data):
        if name != "documents.parquet":
            os.symlink(f"{data}/{name}", tmp_path / name)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    some = docs.where("length(text) > 2000").orderBy("doc_id").first()
    long = " ".join(f"{w}" for w in (some.text + " ").split()) + " " + "the of and to in " * 20000
    odd = [(900001, None, "en"), (900002, "", None), (900003, " \n ", "en"), (900004, "12 34 !", "en"), (900005, long, "en"), (900006, some.text, "en"), (900006, some.text, "en"), (None, some.text, "en"), (None, None, None)]
    rows = spark.createDataFrame([(d, t, la, None, None) for d, t, la in odd], docs.schema)
    both = docs.unionByName(rows)
    for name in ("_rejected", "_score", "_fp", "_id", "_th", "_ranges", "_n_words", "_n_removed", "_items", "items", "fp", "h", "part"):
        both = both.withColumn(name, F.lit("x"))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, substring.saved(stage(spark, at, str(tmp_path)), name)
        if name != "best_fit_packing":
            assert at.columns == before.columns and at.dtypes == before.dtypes
    ids = {r.doc_id for r in at.collect()}
    assert not ids & {900001, 900002, 900003, 900004, 900006, None}  # no letters; copies of an earlier text
    for r in at.where("doc_id = 900005").groupBy("doc_id").agg(F.sum("length").alias("n")).collect():
        assert r.n > 100000
    empty = tmp_path / "empty"
    empty.mkdir()
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    os.symlink(f"{data}/benchmark.parquet", empty / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_driver_gives_memory_back(spark, monkeypatch):
    """Tables written one after another do not leave their plans and native memory with the driver."""
    calls = []
    monkeypatch.setattr(common, "release", lambda s, f=common.release: calls.append(s) or f(s))
    monkeypatch.setattr(common, "_released", [0.0])
    assert "RSS" in common.trim_jvm(spark)
    for _ in range(3):
        assert common.saved(spark.range(3), "few").count() == 3
    assert calls
