"""Incremental exact substring deduplication on a log-structured fingerprint index.

Windows are ``WINDOW`` consecutive words.  Every window selects, by least hash,
one of the runs of ``ANCHOR`` words inside it (its anchor), so equal windows select
equal anchors at the same place; about one position in twenty is
selected.  What a document's windows around one anchor span is
a *segment*, and the index keeps one entry per distinct segment:
``(anchor hash, 128-bit segment hash, first and last doc_id)``.

* Each ingested batch becomes one immutable *run*, bucketed by anchor and sorted, written once.
* A new batch is merged with the runs bucket by bucket: bucket k of all runs is read by one task, so no historical
  entry is ever shuffled again.  Where a segment occurs in two documents, or an anchor with different
  surroundings, documents become candidates.
* Candidates are confirmed on their words: digests of the words themselves (``hashlib.blake2b``) of
  the whole segment, or of each window of it, must be equal.
* When ``fan_out`` runs have gathered, they are compacted into one before the next batch is merged.

An anchor with more than ``HOT`` distinct segments is dealt to ``SALTS`` buckets by segment hash from then on, so no
bucket grows with one passage that very many documents surround differently.  Documents that repeat an earlier document word for word are settled by a digest
of the whole text (in a log of its own) and never reach the index, so a group of copies costs one entry.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import delete_path, free_name, join_known, map_batches, new_path, partitions, release, saved

WINDOW = 50
ANCHOR = 10
#: Distinct segments of an anchor beyond which it is dealt to several buckets, and to how many.
HOT, SALTS = 20_000, 64

_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words or windows of one text digested at once.
_PIECE = 1 << 16


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Powers:
    """Powers of the multipliers and of their inverses modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if n > self.n:
            self.n = max(2 * self.n, n, 1 << 12)
            self.up, self.down = [], []
            for m in _MULT:
                for to, base in ((self.up, m), (self.down, pow(m, -1, 1 << 64))):
                    steps = np.full(self.n, base, np.uint64)
                    steps[0] = 1
                    to.append(np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashed:
    """Rolling hashes of a word list: any span's two 64-bit digests in constant time."""

    def __init__(self, words: list[bytes]) -> None:
        n = self.n = len(words)
        digest = xxhash.xxh3_128_digest
        h = np.empty((n, 2), np.uint64)
        for at in range(0, n, _PIECE):
            h[at : at + _PIECE] = np.frombuffer(b"".join([digest(w) for w in words[at : at + _PIECE]]), np.uint64).reshape(-1, 2)
        up, self.down = _POWERS.upto(n + 1)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h[:, k] * up[k][:n], dtype=np.uint64))) for k in (0, 1)]

    def spans(self, start: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
        p = self.sums[k]
        return _mix((p[stop] - p[start]) * self.down[k][start] + (stop - start).astype(np.uint64))

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor hash, both digests, first and last window of each segment."""
        at = np.arange(self.n - ANCHOR + 1)
        grams = self.spans(at, at + ANCHOR, 0)
        width = WINDOW - ANCHOR + 1
        chosen = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(self.n - WINDOW + 1)
        cut = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(chosen) - 1]))
        return grams[chosen[lo]], self.spans(lo, hi + WINDOW, 0), self.spans(lo, hi + WINDOW, 1), lo, hi


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_SCAN = "doc_id long, th long, n_words long, d1 long, d2 long, anchor array<long>, s1 array<long>, s2 array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, whole, parts, sizes = [], [], ([], [], []), [0]
        for text in b.column(2).to_pylist():
            words = split_words(text)
            n_words.append(len(words))
            whole.append(xxhash.xxh3_128_digest(b" ".join(words)))
            if len(words) >= WINDOW:
                got = Hashed(words).segments()[:3]
                for to, x in zip(parts, got):
                    to.append(x)
                sizes.append(len(got[0]))
            else:
                sizes.append(0)
        at = pa.array(np.cumsum(sizes), pa.int32())
        both = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
        lists = [pa.ListArray.from_arrays(at, _long(np.concatenate(p) if p else np.zeros(0, np.uint64))) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), *lists],
            names=["doc_id", "th", "n_words", "d1", "d2", "anchor", "s1", "s2"],
        )


def _digest(line: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(n, 2) longs: digests of the stretches of a text's words joined by one space."""
    blake, out = hashlib.blake2b, np.empty((len(start), 2), np.int64)
    for at in range(0, len(start), _PIECE):
        piece = slice(at, at + _PIECE)
        found = [blake(line[s:e], digest_size=16).digest() for s, e in zip(start[piece].tolist(), stop[piece].tolist())]
        out[piece] = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return out


_MARKS = "doc_id long, th long, lo int, hi int, h1 long, h2 long"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, hits): digests of the words of the segments that may repeat whole, and of each window of the others."""
    for b in batches:
        ids, ths, hits = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
        out: list[tuple] = []
        for row, text in enumerate(b.column(2).to_pylist()):
            words = split_words(text)
            if len(words) < WINDOW:
                continue
            known = hits[row].values
            keys, whole = np.asarray(known.field("s1")), known.field("whole").to_numpy(zero_copy_only=False)
            _, s1, _, lo, hi = Hashed(words).segments()
            s1 = s1.view(np.int64)
            mine = np.isin(s1, keys[whole])
            first, last = [lo[mine]], [hi[mine]]
            mine = np.isin(s1, keys[~whole])
            n = hi[mine] - lo[mine] + 1
            each = np.repeat(lo[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            first, last = np.concatenate([*first, each]), np.concatenate([*last, each])
            if len(first):
                line = b" ".join(words)
                end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begin = np.concatenate(([0], end[:-1] + 1))
                out.append((len(first), ids[row], ths[row], first, last, _digest(line, begin[first], end[last + WINDOW - 1])))
        if out:
            n = [o[0] for o in out]
            digests = np.concatenate([o[5] for o in out])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([o[1] for o in out], n)),
                    pa.array(np.repeat([o[2] for o in out], n)),
                    pa.array(np.concatenate([o[3] for o in out]).astype(np.int32)),
                    pa.array(np.concatenate([o[4] for o in out]).astype(np.int32)),
                    pa.array(np.ascontiguousarray(digests[:, 0])),
                    pa.array(np.ascontiguousarray(digests[:, 1])),
                ],
                names=[f.split()[0] for f in _MARKS.split(", ")],
            )


def _text_hash(text: str):
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


class RunLog:
    """Immutable runs below ``path``, in one table bucketed by the first column, each file sorted.

    A run adds one file to each bucket, so a plan over the table that groups by the first column reads bucket k of all runs in one task, without an exchange.
    (A union of a table a run would do as well, but Spark 4.1 plans it without an exchange and then, reading columns, does not align its partitions.)
    Folders are ``<name>-<generation>-<buckets>``: a compaction writes the next generation.  A run counts once its mark
    ``<folder>.done-<number>-<run>`` is there, so what a failed attempt left is never read.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, schema: str, buckets: int) -> None:
        self.spark, self.path, self.name, self.schema, self.buckets = spark, path, name, schema, buckets
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.runs: list[int] = []
        self.generation, self.table = 0, f"tessera_{name}_{uuid.uuid4().hex}"
        top = self._hadoop(path)
        fs = self._fs(top)
        marks = []
        for x in fs.listStatus(top) if fs.exists(top) else ():
            where, _, mark = x.getPath().getName().partition(".done-")
            kind, _, rest = where.partition("-")
            if mark and kind == name:
                marks.append((*map(int, rest.split("-")), *map(int, mark.split("-"))))
        if marks:
            self.generation = max(marks)[0]
            self.buckets = max(marks)[1]
            self.runs = [m[3] for m in sorted(marks) if m[0] == self.generation]
            order = ", ".join(self.columns[:3])
            spark.sql(f"CREATE TABLE {self.table} (run long, {schema}) USING parquet CLUSTERED BY ({self.columns[0]}) SORTED BY ({order}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.name}-{self.generation:06d}-{self.buckets}"

    def append(self, rows: DataFrame, placed: bool = False) -> None:
        """``placed``: the rows are partitioned as the buckets are, as those of a plan over the runs."""
        run = uuid.uuid4().int >> 66
        rows = rows.select(F.lit(run).cast("long").alias("run"), *self.columns)
        rows = rows if placed else rows.repartition(self.buckets, self.columns[0])
        writer = rows.write.mode("append").bucketBy(self.buckets, self.columns[0]).sortBy(*self.columns[:3])
        writer.option("path", self.folder).option("compression", "zstd").format("parquet").saveAsTable(self.table)
        mark = self._hadoop(f"{self.folder}.done-{len(self.runs)}-{run}")
        self._fs(mark).mkdirs(mark)
        self.runs.append(run)

    def read(self) -> DataFrame:
        """All rows, with their run."""
        return self.spark.table(self.table).where(F.col("run").isin(self.runs)) if self.runs else self.spark.createDataFrame([], f"run long, {self.schema}")

    def merged(self, last: int = 0) -> DataFrame:
        """All rows, with a column ``fresh``: what the ``last`` runs brought."""
        new = F.col("run").isin(self.runs[-last:]) if last else F.lit(False)
        return self.read().withColumn("fresh", new & F.col("fresh") if "fresh" in self.columns else new).drop("run")

    def replace(self, rows: DataFrame, placed: bool) -> None:
        """``rows`` of a plan over the runs become the next generation's only run."""
        old = self.table, self.folder, [f"{self.folder}.done-{k}-{run}" for k, run in enumerate(self.runs)]
        self.generation, self.table, self.runs = self.generation + 1, f"tessera_{self.name}_{uuid.uuid4().hex}", []
        self.append(rows, placed)
        self._delete(*old)

    def _delete(self, table: str, folder: str, marks: list[str]) -> None:
        for mark in marks:
            delete_path(self.spark, mark)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_path(self.spark, folder)

    def drop(self) -> None:
        self._delete(self.table, self.folder, [f"{self.folder}.done-{k}-{run}" for k, run in enumerate(self.runs)])
        self.runs = []


class FingerprintIndex:
    """Sorted immutable runs of segment fingerprints below ``path``.

    Batches arrive in ascending doc_id order; an earlier document always wins.
    ``ingest`` appends a batch's run and returns what it has in common with the runs; ``verify``
    turns that into the windows to remove.  Before a batch comes to ``fan_out`` runs, these are compacted into one.  An index of ``path`` that exists is opened, with its own number of buckets.
    """

    _RUN = "slot long, s1 long, s2 long, anchor long, first long, last long, n long, fresh boolean"
    _COPIES = "d1 long, d2 long, first long, n long"

    def __init__(self, spark: SparkSession, path: str | None = None, fan_out: int = 8, buckets: int | None = None, hot: int = HOT) -> None:
        self.spark, self.path, self.fan_out, self.hot = spark, path or new_path(spark, "fingerprints"), fan_out, hot
        n = buckets or partitions(spark)
        self.segments = RunLog(spark, self.path, "run", self._RUN, n)
        self.copies = RunLog(spark, self.path, "copies", self._COPIES, n)
        self.hot_anchors = RunLog(spark, self.path, "hot", "anchor long, count long", n)
        self.passing: list[str] = []  # tables that only the next verification needs

    @property
    def runs(self) -> list[int]:
        return self.segments.runs

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        self.passing.append(new_path(self.spark, name))
        return saved(df, name, self.passing[-1])

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``slot``: the anchor, or for a hot one the anchor and a salt."""
        if not self.hot_anchors.runs:
            return rows.withColumn("slot", F.col("anchor"))
        hot = self.hot_anchors.read().select("anchor", F.lit(True).alias("hot"))
        return rows.join(hot, "anchor", "left").withColumn("slot", F.when(F.col("hot"), self._salted()).otherwise(F.col("anchor")))

    @staticmethod
    def _salted(salt=None):
        return F.xxhash64("anchor", F.pmod("s1", F.lit(SALTS)) if salt is None else salt)

    @staticmethod
    def _classes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("slot", "s1", "s2").agg(F.min("anchor").alias("anchor"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("fresh").alias("fresh"))

    def compact(self) -> None:
        """Merges all runs into one; equal entries become one of the earliest and the latest document."""
        if len(self.runs) < 2:
            return
        copies = self.copies.merged().groupBy("d1", "d2").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        self.copies.replace(copies, True)
        rows, moved = self.segments.merged(), bool(self.hot_anchors.runs)
        if moved:  # entries from before their anchor was hot go to its slots
            rows = self._placed(rows.drop("slot"))
        self.segments.replace(self._classes(rows), not moved)

    def ingest(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``batch`` is (doc_id, text).  Returns

        * (doc_id, s1, whole): segments to confirm, of this batch and of documents ingested before - as a whole, or window by window;
        * (doc_id, th, lo, hi): all windows of the documents that repeat an earlier one word for word.
        """
        if len(self.runs) >= self.fan_out:
            self.compact()
        keyed = batch.where("doc_id is not null").select("doc_id", _text_hash("text").alias("th"), "text")
        scan = self._saved(map_batches(keyed, _scan, _SCAN), "scan").where(F.col("n_words") >= WINDOW)

        self.copies.append(scan.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
        first = self.copies.merged(1).groupBy("d1", "d2").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("fresh").alias("fresh")).where("fresh").drop("fresh")
        first = self._saved(first, "texts")  # of this batch's texts
        rows = join_known(scan.select("doc_id", "th", "n_words", "d1", "d2"), first.where("n > 1"), ["d1", "d2"])
        dead = rows.where("first < doc_id").select("doc_id", "th", F.lit(0).alias("lo"), (F.col("n_words") - WINDOW).cast("int").alias("hi"))

        alive = scan.join(first, [scan.d1 == first.d1, scan.d2 == first.d2, scan.doc_id == first["first"]], "left_semi")
        entries = self._saved(alive.select("doc_id", F.explode(F.arrays_zip("anchor", "s1", "s2")).alias("e")).select("e.anchor", "e.s1", "e.s2", "doc_id"), "entries")
        classes = entries.groupBy("anchor", "s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        self.segments.append(self._placed(classes.withColumn("fresh", F.lit(True))))
        brought = 1 + self._split_hot()

        slot = Window.partitionBy("slot")
        found = self._classes(self.segments.merged(brought))
        found = found.withColumn("mixed", (F.min("s1").over(slot) < F.max("s1").over(slot)) & F.max("fresh").over(slot))
        if self.hot_anchors.runs:  # a hot anchor has many surroundings, in whichever slot they are
            hot = self.hot_anchors.read().select("anchor").join(entries.select("anchor").distinct(), "anchor", "left_semi")
            slots = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(self._salted(F.col("salt").cast("long")).alias("slot"), F.lit(True).alias("hot")).distinct()
            found = found.join(slots, "slot", "left").withColumn("mixed", F.col("mixed") | F.coalesce("hot", F.lit(False))).drop("hot")
        twice = (F.col("first") < F.col("last")) & F.col("fresh")
        found = self._saved(found.where(twice | F.col("mixed")).select("s1", "s2", "first", "n", "mixed", twice.alias("twice")), "found")
        again = join_known(entries.select("s1", "s2", "doc_id"), found.where("twice").select("s1", "s2", "n"), ["s1", "s2"])
        hits = again.select("doc_id", "s1", F.lit(True).alias("whole"))
        hits = hits.unionAll(found.where("twice").select(F.col("first").alias("doc_id"), "s1", F.lit(True))).unionAll(found.where("mixed").select("first", "s1", F.lit(False)))
        release(self.spark)
        return hits, dead

    def _split_hot(self) -> int:
        """Anchors that the last run shows to be hot (one in ``hot`` entries at most) are known as such from now on; their entries,
        the earlier ones too, come once more, in their new slots.  Returns the number of runs this adds."""
        last = self.segments.merged(1).where("fresh")
        new = last.where(F.col("slot") == F.col("anchor")).groupBy("slot").count().where(F.col("count") > self.hot)  # no exchange
        if new.isEmpty():
            return 0
        self.hot_anchors.append(new.select(F.col("slot").alias("anchor"), "count"))
        moved = self.segments.merged(1).join(self.hot_anchors.merged(1).where("fresh").select(F.col("anchor").alias("slot")), "slot", "left_semi")
        self.segments.append(moved.withColumn("slot", self._salted()))
        return 1

    def verify(self, texts: DataFrame, hits: DataFrame, dead: DataFrame) -> DataFrame:
        """``texts`` (doc_id, text) of all documents that ``hits`` names -> (doc_id, th, ranges) of windows to remove.

        ``hits`` and ``dead`` (of this object's batches, or stored by the caller) are used up: their tables are deleted.
        """
        release(self.spark)
        keyed = texts.where("doc_id is not null").select("doc_id", _text_hash("text").alias("th"), "text")
        mine = hits.groupBy("doc_id").agg(F.collect_set(F.struct("s1", "whole")).alias("hits"))
        marks = self._saved(map_batches(keyed.join(mine, "doc_id").select("doc_id", "th", "text", "hits"), _mark, _MARKS), "marks")
        known = marks.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
        known = self._saved(known.select("h1", "h2", "first", "n"), "known")
        repeats = join_known(marks, known, ["h1", "h2"]).where("first < doc_id")
        gone = repeats.select("doc_id", "th", "lo", "hi").unionAll(dead)
        out = saved(gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
        for path in self.passing:
            delete_path(self.spark, path)
        self.passing = []
        release(self.spark)
        return out

    def drop(self) -> None:
        """Deletes the index."""
        for log in (self.segments, self.copies, self.hot_anchors):
            log.drop()
        delete_path(self.spark, self.path)


def kept_words(words: list[bytes], lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """The words that no window covers which starts in one of the ranges ``lo`` to ``hi``."""
    if not len(lo):
        return words
    n = len(words) + 1
    edge = np.bincount(lo, minlength=n)
    edge -= np.bincount(hi + WINDOW, minlength=n)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _cut(at: int, names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that lose words are rebuilt from the kept ones; all others stay as they are."""
        for b in batches:
            new, n_words, n_removed = [], [], []
            ranges = b.column(b.num_columns - 1)
            lo, hi = (np.asarray(ranges.values.field(f)) for f in ("lo", "hi"))
            edges = np.asarray(ranges.offsets)
            for row, text in enumerate(b.column(at)):
                text = text.as_py()
                words = split_words(text)
                mine = slice(edges[row], edges[row + 1] if ranges[row].is_valid else edges[row])
                keep = kept_words(words, lo[mine], hi[mine])
                n_words.append(len(words))
                n_removed.append(len(words) - len(keep))
                new.append(b" ".join(keep).decode("utf-8", "surrogatepass") if len(keep) < len(words) else text)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*b.schema.names[:-1], *names]
            )

    return cut


def deduplicate(docs: DataFrame, batches: int = 3, fan_out: int = 2, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with repeated windows cut out of the text, and two last columns ``_n_words`` and ``_n_removed`` (with more underscores, if ``docs`` has such).

    The table goes through a fresh index in ``batches`` ranges of doc_id, which is compacted when it has ``fan_out`` runs; the result
    does not depend on either.

    * null, empty and short texts (under ``WINDOW`` words) lose nothing and keep their text.
    * rows with a null doc_id lose nothing and are no one's source.
    * rows that share a doc_id are judged alike: neither is earlier than the other.
    * an empty table gives an empty result; further columns pass through.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds = src.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000).alias("q")).first()["q"] if batches > 1 else []
    edges = [None, *sorted(set(bounds or [])), None]
    index, found = FingerprintIndex(spark, fan_out=fan_out, hot=hot), []
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = src if lo is None else src.where(F.col("doc_id") > lo)
        found.append(index.ingest(part if hi is None else part.where(F.col("doc_id") <= hi)))
    hits, dead = found[0]
    for h, d in found[1:]:
        hits, dead = hits.unionAll(h), dead.unionAll(d)
    gone = index.verify(src, hits, dead)
    index.drop()  # an index of this table alone
    key, th, ranges, n_words, n_removed = (free_name(n, docs.columns) for n in ("_id", "_th", "_ranges", "_n_words", "_n_removed"))
    gone = gone.select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("ranges").alias(ranges))
    joined = docs.join(gone, [F.col(id_col).cast("long") == F.col(key), _text_hash(text_col) == F.col(th)], "left")
    joined = joined.select(*docs.columns, ranges)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])
    return map_batches(joined, _cut(docs.columns.index(text_col), [n_words, n_removed]), schema)


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
