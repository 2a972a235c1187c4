"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of the test items.

Every document is read whole, in passages that overlap by half: of ``PASSAGE`` words for items of up to as many,
of twice as many for items of up to twice as many, and so on.  So two neighbouring passages hold any copy of an item,
and one of them at least half of its score, however long it is.

A passage is a query against the test items of its length; an item is retrieved if its BM25 score reaches a share
of the score of its own text, so all items above it are, however many.  Items stand in ascending order of
that threshold, and each term has its postings in that order, its greatest impact, and its greatest impact in each block of
``BLOCK`` items it occurs in.  The search has two steps:

* the block maxima of a whole batch of passages are summed at once, and passages drop out whose sum reaches the least threshold of no block;
* each passage left goes through WAND: cursors over the postings of its distinct words are kept in the order of their items, the pivot is the first item
  whose cursors' greatest impacts together reach its threshold, a block whose maxima don't reach it is skipped as a whole, and
  only items left are scored.

A retrieved item is then verified on the document's words: its question part (all but the
last ``ANSWER`` words) and its answer part (those words) must both be found in the order of the
item - the longest chain of runs of ``GRAM`` words that ascends in both - to the shares ``QUESTION_SHARE`` and ``ANSWER_SHARE``,
in the passage and as many words before and after it.

The test items are sent to the executors in blocks of at most ``ITEMS`` items, so what
is broadcast stays bounded however large the benchmark is; document frequencies and lengths are those of all items.
The index is sparse (postings and block maxima), and a worker builds it once.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, map_batches, saved

STEP = 48
PASSAGE = 2 * STEP
K1, B = 1.2, 0.75
SHARE = 0.45  # of an item's own score
ANSWER = 8
GRAM = 3
QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.5
ITEMS = 20_000
BLOCK = 4
#: Words searched together, and sums of block maxima held at once.
GATHER, CELLS = 1 << 18, 1 << 21

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def passage_of(n: int) -> int:
    """Words of the passages in which items of ``n`` words are looked for."""
    size = PASSAGE
    while size < n:
        size *= 2
    return size


def chain(runs: list[tuple], places: dict[tuple, list[int]]) -> int:
    """Length of the longest chain of ``runs`` whose places in a text ascend as they do (longest increasing subsequence)."""
    tails: list[int] = []
    for run in runs:
        for place in reversed(places.get(run, ())):  # from the last, so that a run counts once
            at = bisect_left(tails, place)
            tails[at : at + 1] = [place]
    return len(tails)


class _Level:
    """Postings and block maxima of the items ``first`` to ``end``, which are looked for in passages of ``passage`` words."""

    def __init__(self, passage: int, first: int, end: int, term: np.ndarray, at: np.ndarray, impact: np.ndarray, terms: int, need: np.ndarray) -> None:
        """``term``, ``at``, ``impact``: postings in order of term, then item."""
        self.passage, self.first, self.end = passage, first, end
        self.ptr = np.searchsorted(term, np.arange(terms + 2)).astype(np.int64)
        self.at, self.impact = array("i", (at - first).astype(np.int32).tobytes()), array("d", impact.tobytes())
        block = (at - first) // BLOCK
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.block_ptr = np.searchsorted(term[new], np.arange(terms + 2)).astype(np.int64)
        self.block = block[new].astype(np.int64)
        self.most = np.maximum.reduceat(impact, new) if len(new) else np.zeros(0)
        self.block_list = array("i", self.block.astype(np.int32).tobytes())
        self.most_list = array("d", self.most.tobytes())
        self.top = np.zeros(terms + 1)
        if len(new):
            held = np.flatnonzero(self.block_ptr[1:] > self.block_ptr[:-1])
            self.top[held] = np.maximum.reduceat(self.most, self.block_ptr[held])
        self.need = need[first:end].tolist()
        self.blocks = -(-(end - first) // BLOCK)
        self.block_need = need[first:end:BLOCK]

    def wand(self, terms: list[int], alive: np.ndarray) -> list[int]:
        """Items (counted from ``first``) whose score for the distinct ``terms`` reaches their threshold; none lies in blocks that are not ``alive``."""
        at, impact, need, block, most = self.at, self.impact, self.need, self.block_list, self.most_list
        live = np.flatnonzero(alive).tolist()
        cursors = []  # item, place, end of the postings, greatest impact, begin and end of the blocks
        for t in terms:
            lo, hi = int(self.ptr[t]), int(self.ptr[t + 1])
            if lo < hi:
                cursors.append([at[lo], lo, hi, float(self.top[t]), int(self.block_ptr[t]), int(self.block_ptr[t + 1])])
        found: list[int] = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for c in cursors:
                total += c[3]
                if total >= need[c[0]] - 1e-6:
                    pivot = c[0]
                    break
            if pivot < 0:
                break
            own = pivot // BLOCK
            k = bisect_left(live, own)
            if k == len(live):
                break
            if live[k] != own:
                target = live[k] * BLOCK
            else:
                bound = 0.0
                for c in cursors:
                    if c[0] > pivot:
                        break
                    b = bisect_left(block, own, c[4], c[5])
                    if b < c[5] and block[b] == own:
                        bound += most[b]
                if bound < need[pivot] - 1e-6:  # later items of the block need no less, but other words may come in
                    target = min([(own + 1) * BLOCK, *(c[0] for c in cursors if c[0] > pivot)])
                elif cursors[0][0] == pivot:
                    score = sum(impact[c[1]] for c in cursors if c[0] == pivot)
                    if score >= need[pivot] - 1e-6:
                        found.append(pivot)
                    target = pivot + 1
                else:
                    target = pivot
            for c in cursors:
                if c[0] < target:
                    c[1] = bisect_left(at, target, c[1], c[2])
                    c[0] = at[c[1]] if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


class ItemIndex:
    """Inverted index of items in order of passage length and threshold."""

    def __init__(self, items: list[tuple[int, str]], stats: tuple[int, float, dict[str, int]] | None = None) -> None:
        """``stats``: number and mean words of all items, and how many hold each word; of ``items`` alone if absent."""
        tokens = [(i, ws) for i, ws in ((i, words(t)) for i, t in items) if ws]
        own = len(tokens)
        n, mean, df = stats or (own, sum(len(ws) for _, ws in tokens) / max(1, own), Counter(w for _, ws in tokens for w in set(ws)))
        self.terms = {w: k for k, w in enumerate(sorted(df))}
        held = np.array([df[w] for w in self.terms], np.float64)
        idf = np.log(1 + (n - held + 0.5) / (held + 0.5))
        rows = []
        for i, ws in tokens:
            codes = np.array([self.terms[w] for w in ws], np.int32)
            term, count = np.unique(codes, return_counts=True)
            impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * len(ws) / mean))
            rows.append((passage_of(len(ws)), float(impact.sum()), i, codes, term, impact))
        rows.sort(key=lambda r: (r[0], r[1], r[2], r[3].tobytes()))
        self.ids = [r[2] for r in rows]
        self.codes = [r[3] for r in rows]
        self.need = np.array([SHARE * r[1] for r in rows])
        self.levels: list[_Level] = []
        sizes = [r[0] for r in rows]
        for passage in sorted(set(sizes)):
            first, end = bisect_left(sizes, passage), bisect_right(sizes, passage)
            term = np.concatenate([r[4] for r in rows[first:end]])
            at = np.repeat(np.arange(first, end), [len(r[4]) for r in rows[first:end]])
            impact = np.concatenate([r[5] for r in rows[first:end]])
            order = np.lexsort((at, term))
            self.levels.append(_Level(passage, first, end, term[order], at[order], impact[order], len(self.terms), self.need))

    def verify(self, at: int, part: list[int]) -> bool:
        """Whether a stretch of a text (codes of its words) holds the item's question and answer, each in its order."""
        ws = self.codes[at].tolist()
        size = min(GRAM, len(ws))
        runs = lambda s: [tuple(s[i : i + size]) for i in range(max(1, len(s) - size + 1))]
        places: dict[tuple, list[int]] = {}
        for i, run in enumerate(runs(part)):
            places.setdefault(run, []).append(i)
        if len(ws) < GRAM:
            return tuple(ws) in places
        cut = max(len(ws) - ANSWER, GRAM)  # a short item is all question and all answer
        for side, share in ((runs(ws[:cut]), QUESTION_SHARE), (runs(ws[cut:] if len(ws) - cut >= GRAM else ws), ANSWER_SHARE)):
            if sum(r in places for r in side) < share * len(side) or chain(side, places) < share * len(side):
                return False
        return True

    def find_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of the items that each whole text holds."""
        found: list[set[int]] = [set() for _ in texts]
        if not self.ids:
            return [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []
        size, get, none = 0, self.terms.get, len(self.terms)
        for row, text in enumerate(texts):
            if text:
                held.append((row, np.array([get(w, none) for w in words(text)], np.int32)))
                size += len(held[-1][1])
            if size > GATHER:
                self._search(held, found)
                held, size = [], 0
        if held:
            self._search(held, found)
        return [sorted({self.ids[at] for at in f}) for f in found]

    def find(self, text: str | None) -> list[int]:
        return self.find_all([text])[0]

    def _search(self, held: list[tuple[int, np.ndarray]], found: list[set[int]]) -> None:
        held = [h for h in held if len(h[1])]
        if not held:
            return
        codes = np.concatenate([h[1] for h in held])
        sizes = np.array([len(h[1]) for h in held])
        base = np.cumsum(sizes) - sizes
        for level in self.levels:
            stride = level.passage // 2
            parts = np.maximum(1, -(-sizes // stride) - 1)  # passages of each text
            doc = np.repeat(np.arange(len(held)), parts)
            start = base[doc] + (np.arange(len(doc)) - (np.cumsum(parts) - parts)[doc]) * stride
            stop = np.minimum(start + level.passage, (base + sizes)[doc])
            some = max(1, min(CELLS // level.blocks, CELLS // level.passage))
            for lo in range(0, len(doc), some):
                self._passages(level, held, found, codes, base, *(x[lo : lo + some] for x in (doc, start, stop)))

    def _passages(self, level: _Level, held, found, codes: np.ndarray, base: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        none, size = len(self.terms), stop - start
        own = np.repeat(np.arange(len(doc)), size)
        term = codes[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)].astype(np.int64)
        known = term < none
        own, term = np.divmod(np.unique(own[known] * none + term[known]), none)  # each passage's distinct words
        edge = np.searchsorted(own, np.arange(len(doc) + 1))
        top = self._bounds(level, own, term, len(doc))
        alive = top >= level.block_need - 1e-6
        for p in np.flatnonzero(alive.any(axis=1)).tolist():
            row, ws = held[doc[p]]
            got = level.wand(term[edge[p] : edge[p + 1]].tolist(), alive[p])
            got = [at for at in (level.first + x for x in got) if at not in found[row]]
            if got:
                s, e = int(start[p] - base[doc[p]]), int(stop[p] - base[doc[p]])
                part = ws[max(0, s - level.passage) : e + level.passage].tolist()
                found[row].update(at for at in got if self.verify(at, part))

    @staticmethod
    def _bounds(level: _Level, own: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Passage x block: sums of the block maxima of each passage's words."""
        many = level.block_ptr[term + 1] - level.block_ptr[term]
        own, term, many = own[many > 0], term[many > 0], many[many > 0]
        out = np.zeros(n * level.blocks)
        upto = np.cumsum(many)
        lo = 0
        while lo < len(term):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS)))
            m = many[lo:hi]
            at = np.arange(m.sum()) + np.repeat(level.block_ptr[term[lo:hi]] - (np.cumsum(m) - m), m)
            out += np.bincount(np.repeat(own[lo:hi] * level.blocks, m) + level.block[at], level.most[at], len(out))
            lo = hi
        return out.reshape(n, level.blocks)


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) -> (part, word, size): each item's words once, and its number of words beside a null word."""
    for b in batches:
        for part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ws := words(text):
                own = [None, *sorted(set(ws))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(own), pa.int64()), pa.array(own, pa.string()), pa.array([len(ws)] * len(own), pa.int64())], names=["part", "word", "size"]
                )


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list[tuple[int, str]], tuple[int, float, dict[str, int]] | None]]:
    """Items in blocks of bounded size, and what ``ItemIndex`` needs to know of all items.

    Null items hold nothing; rows with a null item_id are item -1.
    """
    src = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n = src.count()
    if n <= most:
        yield [(r["item_id"], r["text"]) for r in src.orderBy("item_id", "text").collect()], None
        return
    parts = -(-n // (most // 2))
    dealt = saved(src.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    spoken = saved(map_batches(dealt.select("part", "text"), _spoken, "part long, word string, size long"), "item-words")
    total = spoken.where("word is null").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    df = spoken.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    known = saved(spoken.where("word is not null").select("part", "word").distinct().join(df, "word"), "item-df")
    for k in range(parts):
        block = [(r["item_id"], r["text"]) for r in dealt.where(F.col("part") == k).orderBy("item_id", "text").collect()]
        held = {r["word"]: r["df"] for r in known.where(F.col("part") == k).collect()}
        yield block, (total["n"], total["size"] / max(1, total["n"]) if total["n"] else 0.0, held)


_BUILT: dict[str, ItemIndex] = {}


def _index(name: str, block: tuple) -> ItemIndex:
    """The index of a block, built once by each worker (which keeps the last one)."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = ItemIndex(*block)
    return _BUILT[name]


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", out_col: str = "items", most: int = ITEMS) -> DataFrame:
    """``docs`` with a last column ``out_col`` (with underscores before it, if ``docs`` has one so called): ascending ids of the test items each text holds.

    * null and empty texts hold none; repeated rows are judged alike; empty tables give empty results or no finds.
    * items without words hold nothing and match nothing; an item of fewer than ``GRAM`` words must occur as it stands.
    * further columns pass through.
    """
    spark = docs.sparkSession
    out_col = free_name(out_col, docs.columns)
    at = docs.columns.index(text_col)
    out, first = docs, True
    for block in _blocks(items, most):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        had = not first

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name, had=had) -> Iterator[pa.RecordBatch]:
            index = None
            for b in batches:
                index = index or _index(name, sent.value)
                got = index.find_all(b.column(at).to_pylist())
                cols = list(b.columns)
                if had:
                    got = [sorted({*a, *g}) for a, g in zip(cols.pop().to_pylist(), got)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.list_(pa.int64()))], names=[*b.schema.names[: len(cols)], out_col])

        out = map_batches(out, run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.LongType()))]))
        first = False
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a test item (all columns kept)."""
    name = free_name("_items", docs.columns)
    return contaminated(docs, items, out_col=name).where(F.size(name) == 0).select(docs.columns)
