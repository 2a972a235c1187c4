"""Approximate nearest neighbours on randomly rotated one-bit codes.

A vector, less the centroid of all, is rotated in ``TURNS`` random ways and kept as its signs (one bit
a dimension and turn) with two scalars: its norm, and the inner product of the unit vector
with its own code.  A query's inner product with a vector is estimated from the code;
``EPSILON`` standard errors around the estimate bound it.  Whatever may
belong to a query's nearest by that bound is reranked on the original vectors.  What a query's
nearest must reach at least is known beforehand from a bounded sample of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, new_path, saved

K = 20
EPSILON = 4.0
TURNS = 4
SEED = 42
#: Rows whose exact scores give each query a first threshold; a bound.
SAMPLE = 4096
#: Queries sent to the executors at once, on average (the bound of what is broadcast), and rows estimated at once.
QUERY_BLOCK = 8192
ROW_BLOCK = 1024


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """(TURNS * dim, dim): random orthogonal matrices one below the other."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(TURNS):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): one row per id, without vectors that are null, empty, zero, or hold a null or non-finite component.

    Of rows that share an id the least vector stays.  Vectors of another
    length than most take no part either (ties: the greater length).
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    src = src.where("vec_id is not null and v is not null and size(v) > 0").where(fine)
    dims = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    src = src.where(F.size("v") == (dims["d"] if dims else 0))
    return src.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the ``k + 1`` smallest ids: any other has ``k`` equals before it for every query."""
    w = Window.partitionBy("v").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).drop("_n")


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim)


def encode(rows: DataFrame, dim: int, center: np.ndarray) -> DataFrame:
    """(vec_id, v, code, norm, fit): packed signs and the two correction scalars."""
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (_matrix(b.column(1), dim) - center) @ turn.T
            norm = np.sqrt((x * x).sum(axis=1) / TURNS)
            fit = np.abs(x).sum(axis=1) / np.sqrt(dim) / TURNS / np.where(norm > 0, norm, 1)
            code = np.packbits(x > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(np.where(norm > 0, fit, 1.0))],
                names=["vec_id", "v", "code", "norm", "fit"],
            )

    return map_batches(rows, run, "vec_id long, v array<double>, code binary, norm double, fit double")


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first dimension to the last, so that equal rows get equal sums."""
    return np.add.accumulate(x * y, axis=1)[:, -1] if x.shape[1] and len(x) else np.zeros(len(x))


class _Best:
    """The ``k`` nearest so far of each query; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.q, self.v, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()

    def add(self, q: np.ndarray, row: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray) -> None:
        other = vec_ids[row] != self.ids[q]
        q, row = q[other], row[other]
        s = dot(vectors[row], self.queries[q])
        q, v, s = np.concatenate((self.q, q)), np.concatenate((self.v, vec_ids[row])), np.concatenate((self.s, s))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        same = np.concatenate(([False], (q[1:] == q[:-1]) & (v[1:] == v[:-1])))
        q, v, s = q[~same], v[~same], s[~same]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        keep = place < self.k
        self.q, self.v, self.s = q[keep], v[keep], s[keep]
        last = place[keep] == self.k - 1
        self.least[self.q[last]] = np.maximum(self.least[self.q[last]], self.s[last])


def _search(sent: Broadcast, center: np.ndarray, k: int, epsilon: float):
    """``sent``: ids, vectors and first thresholds of a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, least = sent.value
        dim = queries.shape[1]
        # one product gives estimate plus bound: the code's part, the centroid's, and the error's
        length = np.sqrt((queries * queries).sum(axis=1))
        left = np.concatenate((queries @ rotation(dim).T, (queries @ center)[:, None], length[:, None]), axis=1).astype(np.float32)
        best = _Best(query_ids, queries, k, least)
        for b in batches:
            ids, x = np.asarray(b.column(0)), _matrix(b.column(1), dim)
            bits = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
            norm, fit = np.asarray(b.column(3)), np.asarray(b.column(4))
            wide = norm * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit * (epsilon / np.sqrt(max(1, TURNS * dim - 1)))
            scale = norm / fit / np.sqrt(dim) / TURNS
            for lo in range(0, len(ids), ROW_BLOCK):
                at = slice(lo, lo + ROW_BLOCK)
                signs = np.unpackbits(bits[at], axis=1, count=TURNS * dim).astype(np.float32) * 2 - 1
                right = np.concatenate((signs * scale[at, None], np.ones((len(signs), 1)), wide[at, None]), axis=1).astype(np.float32)
                top = left @ right.T  # query x row
                if np.isinf(best.least).any():
                    n = min(k + 1, top.shape[1])
                    some = np.argpartition(-top, n - 1, axis=1)[:, :n]
                    best.add(np.repeat(np.arange(len(top)), n), some.ravel(), ids[at], x[at])
                slack = 1e-5 * (np.abs(best.least) + length * float(np.sqrt((x[at] * x[at]).sum(axis=1)).max()))
                need = np.where(np.isinf(best.least), -np.inf, best.least - np.where(np.isinf(slack), 0, slack)).astype(np.float32)
                q, row = np.divmod(np.flatnonzero(top >= need[:, None]), top.shape[1])
                for cut in range(0, len(q), 1 << 16):
                    best.add(q[cut : cut + (1 << 16)], row[cut : cut + (1 << 16)], ids[at], x[at])
        if len(best.q):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[best.q]), pa.array(best.v), pa.array(best.s)], names=["query_id", "vec_id", "score"])

    return run


def _first_thresholds(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Each query's ``k``-th best score in a sample of rows, a little lowered for rounding; -inf if it has fewer."""
    out = np.full(len(queries), -np.inf)
    for lo in range(0, len(queries), 1024):
        at = slice(lo, lo + 1024)
        s = queries[at] @ x.T
        s[query_ids[at][:, None] == ids[None, :]] = -np.inf
        if s.shape[1] >= k:
            out[at] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return np.where(np.isfinite(out), out - 1e-9 * np.abs(out), -np.inf)


def _with_threshold(known: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = known.value
        for b in batches:
            least = _first_thresholds(np.asarray(b.column(0)), _matrix(b.column(1), x.shape[1]), ids, x, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], names=["vec_id", "v", "least"])

    return run


def search(vectors: DataFrame, modulus: int = 20, k: int = K, epsilon: float = EPSILON, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``modulus``; they meet all
    rows in blocks of ``QUERY_BLOCK``.  See ``usable`` for the vectors that take no part.
    Fewer candidates than ``k``: all of them.  Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    rows = saved(usable(vectors, id_col, vec_col), "vectors")
    stats = rows.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    schema = "query_id long, vec_id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = stats["d"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(dim)
        for b in batches:
            acc += _matrix(b.column(0), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(acc)], names=["d", "x"])

    sums = map_batches(rows.select("v"), total, "d int, x double").groupBy("d").agg(F.sum("x").alias("x")).collect()
    center = np.zeros(dim)
    for r in sums:
        center[r["d"]] = r["x"] / stats["n"]
    codes = saved(encode(distinct_enough(rows, k), dim, center), "codes")
    asked = rows.where(F.pmod("vec_id", F.lit(modulus)) == 0)
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = codes.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    known = drawn.column("vec_id").to_numpy(), _matrix(drawn.column("v").combine_chunks(), dim)
    # the queries by block, each with its first threshold, written once
    dealt = map_batches(asked, _with_threshold(spark.sparkContext.broadcast(known), k), "vec_id long, v array<double>, least double")
    folder = new_path(spark, "queries")
    dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(folder)
    found = None
    for block in range(blocks):
        part = spark.read.schema("vec_id long, v array<double>, least double, block int").parquet(folder).where(F.col("block") == block).toArrow()
        if not len(part):
            continue
        ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("v").combine_chunks(), dim)
        sent = spark.sparkContext.broadcast((ids, x, part.column("least").to_numpy()))
        got = map_batches(codes, _search(sent, center, k, epsilon), schema)
        found = got if found is None else found.unionAll(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
