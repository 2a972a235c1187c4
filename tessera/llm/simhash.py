"""Near-duplicate detection over 64-bit SimHash fingerprints with a pigeonring filter.

Method.  A fingerprint is cut into ``m = tau + 1`` segments on a ring.  If two
fingerprints differ in at most ``tau`` bits, then some start segment has a
chain of consecutive segments whose cumulative differences stay within the
proportional budgets ``l * tau / m`` for every chain length ``l``.  With
``tau = 4`` the budgets are 0.8, 1.6, 2.4, ..., so a chain starts with an equal
segment, followed by one with at most one differing bit, and so on.  The first
two links are enforced by keys (start segment, its bits, the next segment's
bits or a one-bit variant of them); the longer chain is checked on candidates
before the full Hamming distance.

Within a key, links are found breadth first against the fingerprints not yet
reached, so a group of g copies yields at most g - 1 links (a spanning forest)
and never all of its pairs; the reachability is the same.  Keys with more than ``HOT_KEY``
indexed fingerprints, and those one bit from them, are dealt to several tasks: each block of indexed ones
meets each block of indexed ones and of probes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, map_batches, partitions, saved
from tessera.llm.components import connected_components

TAU = 4
SHINGLE = 4
WIDTHS = (13, 13, 13, 13, 12)  # of the tau + 1 segments, from the highest bit
SHIFTS = tuple(64 - sum(WIDTHS[: i + 1]) for i in range(len(WIDTHS)))
HOT_KEY = 4096

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PIECE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a whole text; 0 for null, empty and white-space-only texts."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, n)
    hashed = xxhash.xxh64_intdigest
    spans = list(zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(spans), _PIECE):
        h = np.array([hashed(line[s:e], 42) for s, e in spans[i : i + _PIECE]], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_signed(fingerprint(t)) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int64())], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per input row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, _fingerprints, "doc_id long, fp long")


def _part(fp, i: int):
    return F.shiftrightunsigned(fp, SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _entries(fps: DataFrame) -> DataFrame:
    """(key, fp, indexed): an indexed entry per start segment, and a probe per one-bit variant of the next."""
    fp, m, out = F.col("fp"), len(WIDTHS), []
    for i in range(m):
        j = (i + 1) % m
        first, then = _part(fp, i), _part(fp, j)
        base = F.shiftleft(first, 16).bitwiseOR(F.lit(i << 40))
        out.append(F.struct(base.bitwiseOR(then).alias("key"), F.lit(True).alias("indexed")))
        out += [F.struct(base.bitwiseOR(then.bitwiseXOR(F.lit(1 << b))).alias("key"), F.lit(False).alias("indexed")) for b in range(WIDTHS[j])]
    # a stored table comes back in few, large partitions; each row becomes some seventy
    return fps.repartition(partitions(fps.sparkSession)).select("fp", F.explode(F.array(*out)).alias("e")).select("e.key", "fp", "e.indexed")


def _near_keys():
    """The key itself and those one bit away in its second segment."""
    m, key = len(WIDTHS), F.col("key")
    flips = [F.when(F.shiftright(key, 40) == i, F.array(key, *[key.bitwiseXOR(F.lit(1 << b)) for b in range(WIDTHS[(i + 1) % m])])) for i in range(m)]
    return F.coalesce(*flips)


_MASKS = np.array([((1 << w) - 1) << s for w, s in zip(WIDTHS, SHIFTS)], dtype=np.uint64)


def _linked(x: np.ndarray, start: int, tau: int = TAU) -> np.ndarray:
    """Which differences ``x`` (xors) hold a viable chain from ``start``, then at most ``tau`` bits in all."""
    m = len(WIDTHS)
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for step in range(1, m):  # the last link is the full distance
        total += np.bitwise_count(x & _MASKS[(start + step - 1) % m])
        ok &= total * m <= step * tau
        if not ok.any():
            return ok
    ok[ok] = np.bitwise_count(x[ok]) <= tau
    return ok


def _forest(fps: np.ndarray, indexed: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links between indexed fingerprints and any others of one key, as a spanning forest."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        rest, wave = rest[:-1], [int(rest[-1])]
        while wave and len(rest):
            x = wave.pop()
            hit = _linked(fps[rest] ^ fps[x], start)
            if not indexed[x]:
                hit &= indexed[rest]
            new = rest[hit]
            out += [(x, int(y)) for y in new]
            wave += new.tolist()
            rest = rest[~hit]
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group; a group may go on in the next batch."""
    held: list[np.ndarray] = []

    def links(group, key, fp, indexed):
        cut = np.flatnonzero((group[1:] != group[:-1]) | (key[1:] != key[:-1])) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(group)]))
        busy = (hi - lo > 1) & (np.add.reduceat(indexed.astype(np.int64), lo) > 0)
        a, b = [], []
        pair = busy & (hi - lo == 2)
        p = lo[pair]
        x = fp[p] ^ fp[p + 1]
        for start in range(len(WIDTHS)):
            at = (key[p] >> 40) == start
            ok = _linked(x[at], start)
            a.append(fp[p[at][ok]])
            b.append(fp[p[at][ok] + 1])
        for s, e in zip(lo[busy & ~pair].tolist(), hi[busy & ~pair].tolist()):
            own, at = np.unique(fp[s:e], return_index=True)
            mark = np.zeros(len(own), bool)
            mark[np.searchsorted(own, fp[s:e][indexed[s:e]])] = True
            for i, j in _forest(own, mark, int(key[s] >> 40)):
                a.append(own[i : i + 1])
                b.append(own[j : j + 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    for batch in batches:
        cols = [np.asarray(c) if not pa.types.is_boolean(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols[2] = cols[2].view(np.uint64)
        if not len(cols[0]):
            continue
        held = [np.concatenate((h, c)) for h, c in zip(held, cols)] if held else cols
        cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0
        if cut:
            yield links(*[h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if held and len(held[0]):
        yield links(*held)


def links(fps: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Distinct ``fp`` values -> (a, b): links that connect what lies within ``TAU`` bits."""
    entries = _entries(fps)
    # a key gathers what is indexed there, and as probes what is indexed one bit away
    counted = saved(entries.where("indexed").groupBy("key").count().where(F.col("count") > hot_key), "hot-keys")
    load = counted.select(F.explode(_near_keys()).alias("key"), "count").groupBy("key").agg(F.sum("count").alias("count"))
    hot = saved(load.select("key", F.ceil(F.col("count") / hot_key).cast("int").alias("blocks")), "hot-blocks")
    if hot.isEmpty():
        dealt = entries.withColumn("g", F.col("key"))
    else:
        all_ = entries.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        # group (row, column): indexed entries go to all columns of their row, probes to all rows of their column;
        # indexed entries also go to their column in the rows before their own, so that each block of them meets each other once
        sides = F.when(F.col("indexed") & (F.col("other") < own), F.array(F.lit(False), F.lit(True))).otherwise(F.array(~F.col("indexed")))
        dealt = (
            all_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("side", F.explode(sides))
            .withColumn(
                "g",
                F.when(F.col("blocks") == 1, F.col("key")).otherwise(
                    F.xxhash64("key", F.when(F.col("side"), F.col("other")).otherwise(own), F.when(F.col("side"), own).otherwise(F.col("other")))
                ),
            )
        )
    grouped = dealt.select("g", "key", "fp", "indexed").repartition("g").sortWithinPartitions("g", "key")
    return map_batches(grouped, _search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, fingerprint (16 hex digits), component_id.

    * component_id is the smallest doc_id reachable over links, itself included.
    * null, empty and blank texts have fingerprint zero and are linked like any other.
    * repeated rows come back as often as they came; rows with a null doc_id get a
      component but never name one, unless all of its ids are null (then null).
    * an empty table gives an empty result; other columns are ignored.
    """
    fps = saved(fingerprints(docs, id_col, text_col), "fps")
    own = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-classes")
    roots = saved(connected_components(links(own.select("fp"))), "fp-roots")
    known = own.join(roots, own.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = known.join(least, "root").select("fp", "component_id")
    return fps.join(labelled, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per group of near duplicates: the smallest doc_id (all columns kept).

    Of repeated rows with that id one stays.  Rows with null ids stay only where
    no row of their group has an id, and then one of each fingerprint.
    """
    found = saved(near_duplicates(docs, id_col, text_col), "near")
    keep = found.where("doc_id = component_id").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct()
    named = docs.join(keep, id_col, "left_semi").dropDuplicates([id_col])
    name = free_name("_fp", docs.columns)
    nameless = found.where("doc_id is null and component_id is null").select(F.col("fp").alias(name)).distinct()
    rest = with_fingerprint(docs.where(F.col(id_col).isNull()), text_col, name).join(nameless, name, "left_semi").dropDuplicates([name])
    return named.select(docs.columns).unionByName(rest.select(docs.columns))


def with_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` and a last column ``name``."""
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([_signed(fingerprint(t)) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fp], names=[*b.schema.names, name])

    return map_batches(docs, add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
