"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (2, 3 and 4 bytes of lower-cased letters, all
else a blank) with sublinear term frequency times inverse document frequency,
normalised.  Each language has a few centroids, found by spherical k-means on
a bounded, labelled sample.  The nearest centroid by cosine decides; a text
farther from it than nearly all of the sample was from its own is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fold, free_name, hash_share, map_batches, release

BINS = 1 << 14  # at most 1 << 16
NGRAMS = (2, 3, 4)
#: Bound of the labelled sample: about so many texts a language, those of least hash of id and text.
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 4
#: A text is rejected below this share of the sample's ``TAIL`` quantile of cosines.
SLACK, TAIL = 0.35, 0.002
#: Texts of fewer n-grams are nearer to nothing by nature; their share falls with their size.
FULL = 150
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_TABLE = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint64)
_CHUNK = 1 << 22


def has_letter(text: str | None) -> bool:
    first = _LETTER.search(text) if text else None  # a letter, or a number that is no digit
    return first is not None and (first[0].isalpha() or any(map(str.isalpha, text)))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BINS, np.int64)
    for lo in range(0, len(raw), _CHUNK):
        a = _TABLE[raw[max(0, lo - 3) : lo + _CHUNK]]
        a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
        a = np.concatenate(([np.uint64(32)], a, [np.uint64(32)]))
        g = a
        for n in range(2, max(NGRAMS) + 1):
            if len(a) < n:
                break
            g = (g[:-1] << np.uint64(8)) | a[n - 1 :]
            if n in NGRAMS:
                h = ((g + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
                out += np.bincount(h.astype(np.int64), minlength=BINS)
    return out


def weigh(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(count)
    v = np.zeros(BINS, np.float32)
    v[at] = (1 + np.log(count[at])) * idf[at]
    norm = np.sqrt((v[at] * v[at]).sum())
    return v / norm if norm else v


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows normalised
    of: np.ndarray  # language of each centroid
    floor: np.ndarray  # least cosine of each language

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine clipped to 0..1, and whether it is rejected."""
        if not has_letter(text) or not len(self.centroids):
            return UNKNOWN, 0.0, True
        count = counts(text)
        near = self.centroids @ weigh(count, self.idf)
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.languages[self.of[best]], score, score < self.floor[self.of[best]] * min(1.0, count.sum() / FULL)


def _cluster(x: np.ndarray, k: int, seed: int = 42, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts far apart."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < min(k, len(x)):
        c = np.concatenate((c, x[[int((x @ c.T).max(axis=1).argmin())]]))
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-9)
    return c.astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, n = [], []
        for text in b.column(1).to_pylist():
            c = counts(text)
            i = np.flatnonzero(c)
            at.append(i.astype(np.uint16).tobytes())
            n.append(np.minimum(c[i], 0xFFFFFFFF).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])


def fit(docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Fits on ``text`` and ``lang`` of rows where ``learn`` holds; about ``per_language`` texts each at most."""
    rows = docs.where(learn).where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in docs.where(learn).where("lang is not null and text is not null").groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    within, h = F.lit(False), F.xxhash64("doc_id", "text")
    for lang, n in sizes.items():
        within = within | ((F.col("lang") == lang) & hash_share(h, per_language / n))
    # equal rows share a hash; each counts once
    sample = rows.where(within).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropDuplicates()
    table = map_batches(sample, _features, "lang string, at binary, n binary").toArrow()
    got = sorted(zip(table.column("lang").to_pylist(), table.column("at").to_pylist(), table.column("n").to_pylist()))
    del table
    if not got:
        return LanguageModel([], np.ones(BINS, np.float32), np.zeros((0, BINS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    df = np.zeros(BINS)
    for _, at, _ in got:
        df[np.frombuffer(at, np.uint16)] += 1
    idf = (np.log((1 + len(got)) / (1 + df)) + 1).astype(np.float32)
    names, parts, of, floors = sorted({g[0] for g in got}), [], [], []
    full = np.zeros(BINS, np.int64)
    for k, lang in enumerate(names):
        mine = [g for g in got if g[0] == lang]
        x = np.zeros((len(mine), BINS), np.float32)
        for row, (_, at, n) in enumerate(mine):
            full[:] = 0
            full[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
            x[row] = weigh(full, idf)
        c = _cluster(x, centroids)
        parts.append(c)
        of += [k] * len(c)
        floors.append(SLACK * float(np.quantile((x @ c.T).max(axis=1), TAIL)))
    release(docs.sparkSession)  # what the driver held of the sample
    return LanguageModel(names, idf, np.concatenate(parts), np.array(of), np.array(floors))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with last columns lang_pred, score and rejected (names after ``prefix``).

    The language is ``und``, with score 0 and rejected, for a null text or one without a letter.
    The model is of a fixed size (bins x centroids), whatever the table's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = list(zip(*map(m.predict, b.column(at).to_pylist()))) or [[], [], []]
            more = [pa.array(list(got[0]), pa.string()), pa.array(list(got[1]), pa.float64()), pa.array([bool(x) for x in got[2]], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    fields = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return map_batches(docs, run, T.StructType([*docs.schema.fields, *fields]))


def identify(docs: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from rows outside fold ``held_out`` of ``folds``.

    Rows without a language teach nothing.  Null ids count as the text ``null`` for the fold.
    With nothing to learn from every language is ``und``.  Repeated rows come back as often as
    they came; an empty table gives an empty result; only doc_id, text and lang are read.
    """
    out = fold("doc_id", folds) == held_out
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = fit(src, ~out)
    return predict(src.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """``docs`` without the rows that are rejected (all columns kept), null and letterless texts among them."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = fit(src, fold("doc_id", folds) != held_out)
    prefix = "_"
    while any(free_name(f"{prefix}{n}", docs.columns) != f"{prefix}{n}" for n in ("lang_pred", "score", "rejected")):
        prefix += "_"
    return predict(docs, model, prefix=prefix).where(~F.col(f"{prefix}rejected")).select(docs.columns)
