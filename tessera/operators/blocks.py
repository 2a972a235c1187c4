"""The distributed matrix kernel that all joins share.

Rows of both sides carry a key (a tile, a list, a cluster).  Rows meet if their keys are
equal.  Sides of a key larger than ``rows_per_block`` are cut into blocks and every
block of one side meets every block of the other, so that no group grows
with its key's size.  A row is copied once for each block it meets, so blocks are large; a group is worked through in
strips of b rows, one matrix product each, so the memory of its distances is that of a strip.  Only
what the kernel keeps leaves it.

Many small clusters that meet many others are not keys: a row would be copied once for each cluster met.  Such clusters share a key, and
which may meet is a mask (``pos``, ``bits``), so a row is copied once for each key and block.  A mask of all keys needs no copies: blocks are stored once
and tasks read pairs of them (``places``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import saved

#: Most and fewest rows a side in one group.  Within these, blocks are as large as leave three groups for each task slot.
ROWS_PER_BLOCK, FEWEST = 32_768, 4096
#: Distances of one strip.
STRIP = 1 << 22
#: Error of a product in single precision, as a share of the distances looked for, up to which it serves.
SINGLE = 1e-3
#: Keys whose sizes are sent to the executors; more are joined.
MAX_KEYS = 200_000
#: Share of a group's pairs that its mask allows, below which clusters are worked through one by one.
SPARSE = 0.25
PAIRS = "a_idx long, b_idx long, dist double"


def side(vectors: DataFrame, name: str, key: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, <name>_idx, v), and the columns ``more``.  Null ids and vectors are left out.  Single-precision vectors are moved as such; kernels compute in double."""
    k = F.lit(0).cast("long").alias("key", metadata={"one": True}) if key is None else F.col(key).cast("long").alias("key")
    narrow = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    v = F.col(vec_col) if narrow else F.col(vec_col).cast("array<double>")
    out = vectors.select(k, F.col(id_col).cast("long").alias(f"{name}_idx"), v.alias("v"), *more)
    return out.where(F.col(f"{name}_idx").isNotNull() & F.col("v").isNotNull())


@dataclass(frozen=True)
class Tile:
    a: np.ndarray
    A: np.ndarray
    b: np.ndarray
    B: np.ndarray
    #: Of a masked group: each a row's place, and each b row's bits of the places that it may meet.
    pos: np.ndarray | None = None
    bits: np.ndarray | None = None
    #: What strips of the same a rows share.
    known: dict = field(default_factory=dict, compare=False)

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs may meet."""
        if self.bits is None:
            return np.ones(len(i), bool)
        at = self.pos[i]
        return (self.bits[j, at >> 3] >> (at & 7) & 1).astype(bool)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances of pairs by direct differences, dimension by dimension."""
        out = np.zeros(len(i))
        for d in range(self.A.shape[1]):
            x = self.A[i, d] - self.B[j, d]
            out += x * x
        return out

    def rough(self, most: float = np.inf) -> tuple[np.ndarray, float]:
        """All squared distances by a matrix product (row: b, column: a), and a bound of their error.

        Only those up to ``most`` matter: where the error of single precision is far below it, the product is taken in that, norms included.
        """
        if "na" not in self.known:
            self.known["na"] = (self.A * self.A).sum(axis=1)
        na, nb = self.known["na"], (self.B * self.B).sum(axis=1)
        # inputs, products and sums are rounded by 6e-8 each, of at most twice both norms
        top = (na.max(initial=0) + nb.max(initial=0)) * (self.A.shape[1] + 8)
        if top < 1e30 and top * 1.5e-7 + 1e-12 <= SINGLE * most < np.inf:
            if "single" not in self.known:
                self.known["single"] = np.column_stack([-2 * self.A, na, np.ones(len(na))]).astype(np.float32)
            return np.column_stack([self.B, np.ones(len(nb)), nb]).astype(np.float32) @ self.known["single"].T, float(top * 1.5e-7 + 1e-12)
        d = self.B @ self.A.T
        d *= -2
        d += nb[:, None]
        d += na[None, :]
        return d, float(top * 4e-16 + 1e-12)


#: Kernels give places in A and in B, and exact distances.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: A kernel treats each b row by itself, so it may be run on strips of them.
Kernel = Callable[[Tile], Found]


def _places(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix in which little is held: eight places are looked at together."""
    flat = held.ravel()
    whole = len(flat) & ~7
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, max(1, held.shape[1]))


def within(threshold: float) -> Kernel:
    """Pairs at most ``threshold`` apart (inclusive): survivors of the product are measured exactly."""

    def kernel(t: Tile) -> Found:
        d, eps = t.rough(threshold)
        j, i = _places(d <= threshold + eps)
        if t.bits is not None:
            ok = t.allowed(i, j)
            i, j = i[ok], j[ok]
        x = t.exact(i, j)
        keep = x <= threshold
        return i[keep], j[keep], x[keep]

    kernel.pairwise = True  # it judges each pair by itself
    return kernel


def nearest_within(k: int, threshold: float, tile_rows: int | None = None) -> Kernel:
    """Each b row's ``k`` nearest a rows of those it may meet and at most ``threshold`` apart, in each range of ``tile_rows`` ids of a; ties go to the smaller a_idx.

    A row's rank counts nearer rows alone, so what is beyond the threshold may go first.
    """

    def kernel(t: Tile) -> Found:
        d, eps = t.rough(threshold)
        tile = np.zeros(len(t.a), np.int64) if tile_rows is None else t.a // tile_rows
        near = d <= threshold + eps
        if np.count_nonzero(near) > 16 * k * len(t.b):  # too many to measure each
            if t.bits is not None:
                d[~np.unpackbits(t.bits, axis=1, bitorder="little")[:, t.pos].astype(bool)] = np.inf
            for one in np.unique(tile):
                cols = np.flatnonzero(tile == one)
                if k < len(cols):
                    part = d[:, cols]
                    near[:, cols] &= part <= np.partition(part, k - 1, axis=1)[:, k - 1, None] + 2 * eps
        j, i = _places(near)
        ok = t.allowed(i, j)
        i, j = i[ok], j[ok]
        x = t.exact(i, j)
        keep = x <= threshold
        i, j, x = i[keep], j[keep], x[keep]
        order = np.lexsort((t.a[i], x, tile[i], j))
        i, j, x = i[order], j[order], x[order]
        new = np.ones(len(j), bool)
        new[1:] = (j[1:] != j[:-1]) | (tile[i][1:] != tile[i][:-1])
        at = np.arange(len(j))
        keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
        return i[keep], j[keep], x[keep]

    return kernel


def nearest(k: int) -> Kernel:
    """Each b row's ``k`` nearest a rows; ties go to the smaller a_idx."""

    def kernel(t: Tile) -> Found:
        d, eps = t.rough()
        if k < d.shape[1]:
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            j, i = np.nonzero(d <= kth[:, None] + 2 * eps)
        else:
            j, i = (x.ravel() for x in np.indices(d.shape))
        x = t.exact(i, j)
        order = np.lexsort((t.a[i], x, j))
        i, j, x = i[order], j[order], x[order]
        keep = np.arange(len(j)) - np.searchsorted(j, j) < k
        return i[keep], j[keep], x[keep]

    return kernel


def closest(k: int, usable: Callable[[Tile, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Kernel:
    """The ``k`` closest usable pairs of a tile; ties by b_idx, then a_idx."""

    def kernel(t: Tile) -> Found:
        d, eps = t.rough()
        size, n = d.size, 4 * k + 64
        while True:
            at = np.arange(size) if n >= size else np.flatnonzero(d.ravel() <= np.partition(d.ravel(), n - 1)[n - 1] + 2 * eps)
            j, i = np.divmod(at, d.shape[1])
            x = t.exact(i, j)
            ok = usable(t, i, j, x)
            if ok.sum() >= k or n >= size:
                break
            n *= 8
        i, j, x = i[ok], j[ok], x[ok]
        order = np.lexsort((t.a[i], t.b[j], x))[:k]
        return i[order], j[order], x[order]

    return kernel


def first_of(ids: np.ndarray, k: int, *by: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each id, in order of ``by``."""
    order = np.lexsort((*by[::-1], ids))
    held = ids[order]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    at = np.arange(len(held))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _table(ids_a: np.ndarray, ids_b: np.ndarray, dist: np.ndarray) -> pa.Table:
    return pa.table({"a_idx": pa.array(ids_a, pa.int64()), "b_idx": pa.array(ids_b, pa.int64()), "dist": pa.array(dist, pa.float64())})


def _matrix(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column(name).to_numpy()
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(np.float64)


def block_rows(spark: SparkSession, n: int, m: int) -> int:
    """Rows a block for sides of ``n`` and ``m`` rows under one key."""
    return int(min(ROWS_PER_BLOCK, max(FEWEST, (n * m / (3 * max(1, spark.sparkContext.defaultParallelism))) ** 0.5)))


def _mask(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    pos, raw = x.column("pos").to_numpy(), y.column("bits").to_pylist()
    width = max(int(pos.max(initial=0)) // 8 + 1, *map(len, raw))
    return pos, np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)


def strips(tile: Tile, kernel: Kernel) -> Found:
    """The kernel over strips of b rows; under a mask that allows few pairs, cluster by cluster of a."""
    if tile.bits is not None:
        held = np.bincount(tile.pos, minlength=tile.bits.shape[1] * 8)
        met = np.unpackbits(tile.bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if held @ met < SPARSE * len(tile.a) * len(tile.b):
            return _each_cluster(tile, kernel, np.flatnonzero(held * met))
    rows = max(1, STRIP // max(1, len(tile.a)))
    parts, known = [], {}
    for lo in range(0, len(tile.b), rows):
        bits = None if tile.bits is None else tile.bits[lo : lo + rows]
        i, j, d = kernel(Tile(tile.a, tile.A, tile.b[lo : lo + rows], tile.B[lo : lo + rows], tile.pos, bits, known))
        parts.append((i, j + lo, d))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _each_cluster(tile: Tile, kernel: Kernel, places: np.ndarray) -> Found:
    order = np.argsort(tile.pos, kind="stable")
    ends = np.searchsorted(tile.pos[order], [places, places + 1])
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for p, lo, hi in zip(places, *ends):
        x, y = order[lo:hi], np.flatnonzero(tile.bits[:, p >> 3] >> (p & 7) & 1)
        i, j, d = strips(Tile(tile.a[x], tile.A[x], tile.b[y], tile.B[y]), kernel)
        parts.append((x[i], y[j], d))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _written(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as to:
        to.write_table(t)
    return sink.getvalue().to_pybytes()


def _block(ids: str, n: str) -> Column:
    return F.pmod(F.xxhash64(ids), F.col(n)).cast("int")


def _stored(rows: DataFrame, ids: str, most: int | None) -> DataFrame:
    """(lo, hi, least, most, block), stored: ``rows`` by key, a block of about ``most`` rows (None: all) a file, as bytes of Arrow; the places that its rows have (lo to hi) and may meet (least to most)."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("n")).limit(MAX_KEYS + 1).collect() if most else []
    if not most:
        dealt = rows.withColumn("n", F.lit(1))
    elif len(sizes) <= MAX_KEYS:
        dealt = rows.join(F.broadcast(rows.sparkSession.createDataFrame(sizes, "key long, n int")), "key")
    else:
        dealt = rows.join(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("n")), "key")
    dealt = dealt.withColumn("n", _block(ids, "n"))
    has, meets = "pos" in rows.columns, "bits" in rows.columns

    def pack(t: pa.Table) -> pa.Table:
        t = t.drop_columns(["key", "n"]).combine_chunks()
        row = [0, 0, 0, -1]
        if has:
            pos = t.column("pos").to_numpy()
            row[:2] = int(pos.min()), int(pos.max())
        if meets:
            t = t.set_column(t.schema.get_field_index("bits"), "bits", t.column("bits").chunk(0).dictionary_encode())
            raw = t.column("bits").chunk(0).dictionary.to_pylist()
            met = np.zeros(max(map(len, raw)), np.uint8)
            for r in raw:
                met[: len(r)] |= np.frombuffer(r, np.uint8)
            at = np.flatnonzero(np.unpackbits(met, bitorder="little"))
            row[2:] = (int(at[0]), int(at[-1])) if len(at) else (0, -1)
        return pa.table({**{c: pa.array([x], pa.int32()) for c, x in zip(("lo", "hi", "least", "most"), row)}, "block": pa.array([_written(t)], pa.binary())})

    packed = dealt.groupBy("key", "n").applyInArrow(pack, "lo int, hi int, least int, most int, block binary")
    return saved(packed, "blocks", maxRecordsPerFile=1)  # so that a task reads few of them


def _stored_pairs(a: DataFrame, b: DataFrame, rows: int, run: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``run`` on each pair of a stored block of a and one of b that may meet."""
    left = _stored(a, "a_idx", rows)
    right = left if b is a else _stored(b, "b_idx", None)
    pairs = left.select("lo", "hi", F.col("block").alias("x")).join(right.select("least", "most", F.col("block").alias("y")), F.expr("lo <= most and hi >= least")).select("lo", "hi", "x", "y")
    names = [{"cluster": "a_cluster"}, {"cluster": "b_cluster", "a_idx": "b_idx"}]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = (batch.column(c).to_pylist() for c in (0, 1))
            for k, (lo, hi) in enumerate(zip(lows, highs)):
                x, y = (pa.ipc.open_stream(batch.column(c)[k].as_buffer()).read_all() for c in (2, 3))
                x, y = (t.rename_columns([new.get(c, c) for c in t.column_names]) for t, new in zip((x, y), names))
                first = lo >> 3  # the block's own part of the mask
                x = x.set_column(x.schema.get_field_index("pos"), "pos", pa.array(x.column("pos").to_numpy() - first * 8))
                bits = y.column("bits").chunk(0)
                part = pa.DictionaryArray.from_arrays(bits.indices, pa.array([r[first : (hi >> 3) + 1] for r in bits.dictionary.to_pylist()], pa.binary()))
                yield from run(x, y.set_column(y.schema.get_field_index("bits"), "bits", part)).to_batches()

    return pairs.mapInArrow(each, PAIRS)


def block_pairs(rows: DataFrame, n: int, run: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """``run`` on each pair of ``n`` blocks of ``rows`` (by a hash of the ``vec_id``), each pair once, and on each block with itself (told by the last argument).

    Blocks are stored once and read by the pairs of them, so nothing is copied or shuffled for a block met.
    """
    dealt = rows.withColumn("n", F.lit(n)).withColumn("n", _block("vec_id", "n"))

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"n": t.column("n")[:1].combine_chunks(), "block": pa.array([_written(t.drop_columns(["n"]).combine_chunks())], pa.binary())})

    one = saved(dealt.groupBy("n").applyInArrow(pack, "n int, block binary"), "blocks", maxRecordsPerFile=1)  # so that a task reads few of them
    other = one.select(F.col("n").alias("m"), F.col("block").alias("y"))
    # of (n, m) and (m, n) the one or the other, so that tasks of any blocks have their share
    pairs = one.select("n", F.col("block").alias("x")).join(other, F.expr("if((n + m) % 2 = 0, n <= m, n > m)")).select("n", "m", "x", "y")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (pa.ipc.open_stream(batch.column(c)[k].as_buffer()).read_all() for c in (2, 3))
                yield from run(x, y, batch.column(0)[k].as_py() == batch.column(1)[k].as_py()).to_batches()

    return pairs.mapInArrow(each, schema)


#: How cluster pairs are written as keys.
PAIR_KEY = 1 << 31


def block_join(a: DataFrame, b: DataFrame, kernel: Kernel, rows_per_block: int | None = None, triangle: bool = False, self_join: bool = False, cluster_pairs: bool = False, keep_key: bool = False, places: bool = False) -> DataFrame:
    """(a_idx, b_idx, dist) of what the kernel keeps of each block pair.

    ``triangle``: both sides are the same rows under one key; each pair of blocks meets once.
    ``self_join``: pairs are given as a_idx > b_idx and none with itself.
    ``cluster_pairs``: keys are ``i * PAIR_KEY + j`` of clusters of the same rows, each pair of clusters once: pairs are given
    as a_idx > b_idx, of a cluster with itself each once.
    ``keep_key``: the key is a last column.
    A mask: ``a`` has ``pos``, a row's place in its key, and ``b`` has ``bits`` (little end first), the places that a row may meet; for ``cluster_pairs``
    both have their ``cluster``, and keys are of any kind.
    ``places``: the mask is of all keys, so every block of ``b`` may meet every one of ``a``; keys only say which rows lie together (those of b: its blocks).
    ``b`` may be ``a``, with both columns.  Blocks are stored once and read by the pairs of them, so nothing is copied or shuffled for a block met.
    ``rows_per_block``: see ``block_rows`` where it is absent.
    """
    masked = "pos" in a.columns
    most = rows_per_block or ROWS_PER_BLOCK
    blocks_of = lambda n: F.ceil(n / most).cast("int")
    if places:
        left = right = None
    elif a.schema["key"].metadata.get("one") and b.schema["key"].metadata.get("one"):
        # one key: a count a side, and no join that would be one on a constant
        n = a.count()
        m = n if triangle else b.count()
        most = rows_per_block or block_rows(a.sparkSession, n, m)
        left, right = (df.withColumn("na", blocks_of(F.lit(max(1, n)))).withColumn("nb", blocks_of(F.lit(max(1, m)))) for df in (a, b))
    else:
        na = a.groupBy("key").agg(blocks_of(F.count(F.lit(1))).alias("na"))
        nb = na.withColumnRenamed("na", "nb") if triangle else b.groupBy("key").agg(blocks_of(F.count(F.lit(1))).alias("nb"))
        sizes = na.join(nb, "key")
        few = sizes.select("key", "na", "nb").limit(MAX_KEYS + 1).collect()
        if len(few) <= MAX_KEYS:  # three numbers a key, and no shuffle of the vectors for a count
            sizes = F.broadcast(a.sparkSession.createDataFrame(few, "key long, na int, nb int"))
        left, right = a.join(sizes, "key"), b.join(sizes, "key")
    if not places:
        left, right = left.withColumn("i", _block("a_idx", "na")), right.withColumn("j", _block("b_idx", "nb"))
        left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i") if triangle else F.col("nb") - 1)))
        right = right.withColumn("i", F.explode(F.sequence(F.col("j") if triangle else F.lit(0), F.col("na") - 1)))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return keyed(_table([], [], []), 0)
        tile = Tile(*_matrix(x, "a_idx"), *_matrix(y, "b_idx"), *(_mask(x, y) if masked else ()))
        i, j, d = strips(tile, kernel)
        ia, ib = tile.a[i], tile.b[j]
        if cluster_pairs:
            if masked:
                apart = x.column("a_cluster").to_numpy()[i] != y.column("b_cluster").to_numpy()[j]
            else:
                one, other = divmod(x.column("key")[0].as_py(), PAIR_KEY)
                apart = np.full(len(ia), one != other)
            ia, ib = np.where(apart, np.maximum(ia, ib), ia), np.where(apart, np.minimum(ia, ib), ib)
            keep = ia > ib
            ia, ib, d = ia[keep], ib[keep], d[keep]
        if self_join:
            if triangle and x.column("i")[0].as_py() != x.column("j")[0].as_py():
                ia, ib = np.maximum(ia, ib), np.minimum(ia, ib)
            keep = ia > ib
            ia, ib, d = ia[keep], ib[keep], d[keep]
        return keyed(_table(ia, ib, d), x.column("key")[0].as_py() if keep_key else 0)

    def keyed(t: pa.Table, key: int) -> pa.Table:
        return t.append_column("key", pa.array(np.full(len(t), key, np.int64))) if keep_key else t

    if places:
        return _stored_pairs(a, b, most, run)
    cols = ["key", "i", "j"]
    more = [[F.col(c).alias(f"{name}_cluster" if c == "cluster" else c) for c in ("pos", "bits", "cluster") if c in df.columns] for name, df in (("a", a), ("b", b))]
    grouped = left.select(*cols, "a_idx", "v", *more[0]).groupBy(*cols).cogroup(right.select(*cols, "b_idx", "v", *more[1]).groupBy(*cols))
    return grouped.applyInArrow(run, f"{PAIRS}, key long" if keep_key else PAIRS)
