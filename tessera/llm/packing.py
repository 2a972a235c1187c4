"""Best-fit-decreasing packing of tokenised documents, certified by dual feasible functions.

Every partition packs its own pieces by best-fit decreasing and compares its number
of sequences with a lower bound: the largest sum of piece lengths under the
dual feasible functions of ``bound``.  Equal numbers certify the partition: no packing of its
pieces has fewer sequences, and it is closed.  Partitions with a gap keep their nearly full sequences and
exchange the documents of all others: these are dealt out anew and packed again by best-fit decreasing, as long as that saves
sequences.  ``certify`` gives the bound of all pieces together, and so how far the whole packing can be from the best.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, saved
from tessera.llm.tokens import Encoder

CAPACITY = 4096
END_ID = 1
#: Pieces packed together at once; a partition with more packs several such bundles.
BUNDLE = 50_000
#: Sequences filled to less than this share are exchanged.
NEARLY_FULL = 0.995
ROUNDS = 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, kind: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.open(path, kind)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.encode(b.column(1).to_pylist())):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    at.append(row)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def pieces(docs: DataFrame, tokenizer: str, kind: str = "word", capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); a null or empty text is its end token alone."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, _cut(tokenizer, kind, capacity, end_id), _PIECES, give_back=False)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin.  Equal lengths go in the given order."""
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room for exactly r more
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        room -= size
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """Lower bound of the number of bins for ``count[n]`` pieces of each length n: the best over two families of dual feasible functions.

    * cut(e): pieces above ``capacity - e`` count as whole bins, those under ``e`` as nothing, others as they are;
    * step(k): a piece of share x counts floor((k+1) x) / k of a bin, or x where (k+1) x is whole.
    """
    if not count.any():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    total = np.cumsum(count)
    mass = np.cumsum(count * size)
    for e in range(1, capacity // 2 + 1):
        whole = int(total[-1] - total[capacity - e])
        best = max(best, whole - (-int(mass[capacity - e] - mass[e - 1]) // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity) if len(lengths) else 0


_PACKED = _PIECES + ", part long, bin int, offset long, fill long, bins int, bound int"


def _pack(capacity: int, bundle: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            t = t.combine_chunks()
            lengths = t.column("length").to_numpy()
            bins, offsets, fill = best_fit_decreasing(lengths, capacity)
            n = len(lengths)
            more = [np.full(n, own * (1 << 16) + number), bins.astype(np.int32), offsets, fill[bins], np.full(n, len(fill), np.int32), np.full(n, bound(lengths, capacity), np.int32)]
            return pa.RecordBatch.from_arrays(
                [*(c.chunk(0) for c in t.columns), *map(pa.array, more)], names=[*t.schema.names, "part", "bin", "offset", "fill", "bins", "bound"]
            )

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= bundle:
                yield out()
                held, number = [], number + 1
        if held:
            yield out()

    return pack


def _packed(rows: DataFrame, n: int, capacity: int, bundle: int, name: str) -> DataFrame:
    parts = max(1, -(-n // bundle))
    return saved(map_batches(rows.repartition(parts), _pack(capacity, bundle), _PACKED), name)


def pack(found: DataFrame, capacity: int = CAPACITY, bundle: int = BUNDLE, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` rows -> the same with sequence_id, offset, certified, bins and bound.

    ``bins`` and ``bound`` are the number of sequences and its lower bound of the partition the row lies in at the end: one
    that was certified when packed, what a partition with a gap kept, or what was left when exchanging saved nothing more.
    ``certified``: the two are equal.  Each row keeps its place even if rows repeat.  An empty table gives an empty result.
    """
    names = [f.split()[0] for f in _PIECES.split(", ")]
    now = _packed(found, found.count(), capacity, bundle, "packed-0")
    done: list[DataFrame] = []  # closed sequences: certified partitions, and what those with a gap keep
    for k in range(rounds):
        tagged = now.withColumn("sequence_id", F.lit(k << 56) + F.shiftleft(F.col("part"), 24) + F.col("bin")).withColumn("group", F.lit(k << 56) + F.shiftleft(F.col("part"), 24))
        gap = F.col("bins") > F.col("bound")
        loose = now.where(gap & (F.col("fill") < int(NEARLY_FULL * capacity)))
        before = loose.agg(F.countDistinct("part", "bin").alias("b"), F.countDistinct("part").alias("p"), F.count(F.lit(1)).alias("n")).first()
        after = None
        if k + 1 < rounds and before["p"] > 1:
            after = _packed(loose.select(names), before["n"], capacity, bundle, f"packed-{k + 1}")
            if after.select("part", "bin").distinct().count() >= before["b"]:
                after = None
        if after is None:
            done.append(tagged)
            break
        done.append(tagged.where(~(gap & (F.col("fill") < int(NEARLY_FULL * capacity)))))
        now = after
    row = [*names, "sequence_id", "offset", "certified", "bins", "bound"]
    if len(done) == 1:
        return done[0].withColumn("certified", F.col("bins") == F.col("bound")).select(row)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    # what partitions kept is other than what they packed: count and bound it anew, from at most ``capacity`` numbers a partition
    lengths = out.groupBy("group", "length").agg(F.count(F.lit(1)).alias("n"))
    bins = out.groupBy("group").agg(F.countDistinct("sequence_id").cast("int").alias("bins"))

    def least(t: pa.Table) -> pa.Table:
        count = np.zeros(capacity + 1, np.int64)
        np.add.at(count, t.column("length").to_numpy(), t.column("n").to_numpy())
        return pa.table({"group": t.column("group").slice(0, 1), "bound": pa.array([bound_of_counts(count, capacity)], pa.int32())})

    true = saved(bins.join(lengths.groupBy("group").applyInArrow(least, "group long, bound int"), "group"), "certificates")
    return out.drop("bins", "bound").join(true, "group").withColumn("certified", F.col("bins") == F.col("bound")).select(row)


def certify(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """sequences: how many a packing has; bound: how many any packing of all its pieces has at least.  (One row a length is read.)"""
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": bound_of_counts(count, capacity)}


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents to packed pieces; see ``pieces`` and ``pack``.  Only doc_id and text are read, so columns of any other name may be there."""
    return pack(saved(pieces(docs, tokenizer, kind, capacity, end_id), "pieces"), capacity)
