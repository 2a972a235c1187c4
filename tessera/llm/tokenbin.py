"""Token ids in binary files: frequency-ranked ids, 1 to 4 bytes each, control bits kept apart.

A shard file holds the documents of one range of doc_id, in ascending order:

    8 bytes   magic ``TSRTOK01``
    8 x u64   documents, tokens, distinct ids, bytes of lengths, control, data; 2 reserved
    u32[]     ids by falling frequency in this shard (ties: smaller id)
    i64[]     doc_id of each document, then u8[] whether it is null
    u64[]     tokens of each document
    u8[]      control bytes: 2 bits a token (bytes - 1), four tokens a byte, low bits first
    u8[]      data: each token's rank in as many bytes, low byte first

Ranks are of the shard's own counts, so a shard is written in one pass, read by
itself and rewritten by itself if its task is lost.  Files are written under a
name of the attempt and then renamed; a manifest row names the one that counts.  The manifest is written beside the shards
(``manifest`` below their folder) once all are there, so a folder is read by itself and files of failed attempts are told from good ones.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, new_path, partitions
from tessera.llm.tokens import Encoder

MAGIC = b"TSRTOK01"
#: A shard is closed when it holds so many tokens.
SHARD_TOKENS = 4_000_000
#: Tokens decoded at once.
BLOCK = 1 << 20

_BYTES = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)  # per control byte


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    more = (ranks > 0xFF).astype(np.uint8)
    for most in (0xFFFF, 0xFFFFFF):
        more += ranks > most
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = more
    quad = padded.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    start = np.cumsum(more, dtype=np.int64) + np.arange(len(ranks)) - more
    data = np.empty(len(ranks) + int(more.sum(dtype=np.int64)), np.uint8)
    data[start] = ranks & np.uint32(0xFF)
    for k in (1, 2, 3):
        at = np.flatnonzero(more >= k)
        if not len(at):
            break
        data[start[at] + k] = ranks[at] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks; sizes come from a table of all 256 control bytes."""
    out, at = np.empty(n, np.uint32), 0
    for lo in range(0, n, BLOCK):
        m = min(BLOCK, n - lo)
        size = _BYTES[control[lo // 4 : -(-(lo + m) // 4)]].ravel()[:m]
        stop = np.cumsum(size, dtype=np.int32)
        start = stop - size
        part = data[at : at + int(stop[-1])]
        value = part[start].astype(np.uint32)
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            if not len(more):
                break
            value[more] |= part[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
        out[lo : lo + m] = value
        at += len(part)
    return out


def shard_bytes(doc_ids: list[int | None], parts: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(parts), "<u4")
    count = np.bincount(ids)
    known = np.flatnonzero(count)
    known = known[np.lexsort((known, -count[known]))]
    rank = np.zeros(len(count), np.uint32)
    rank[known] = np.arange(len(known), dtype=np.uint32)
    control, data = encode_ranks(rank[ids])
    lengths = np.array([len(p) // 4 for p in parts], "<u8").tobytes()
    head = np.array([len(parts), len(ids), len(known), len(lengths), len(control), len(data), 0, 0], "<u8").tobytes()
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return b"".join((MAGIC, head, known.astype("<u4").tobytes(), names, lengths, control, data))


def read_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, token counts, and all ids of a shard file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, tokens, known, lengths, control, data, _, _ = map(int, np.frombuffer(raw, "<u8", 8, 8))
    at = 72
    table = np.frombuffer(raw, "<u4", known, at)
    at += 4 * known
    names = np.frombuffer(raw, "<i8", docs, at)
    missing = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    at += 9 * docs
    sizes = np.frombuffer(raw, "<u8", docs, at).astype(np.int64)
    at += lengths
    ranks = decode_ranks(np.frombuffer(raw, np.uint8, control, at), np.frombuffer(raw, np.uint8, data, at + control), tokens)
    return [None if m else int(x) for x, m in zip(names, missing)], sizes, table[ranks]


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


_MANIFEST = "part int, number int, path string, docs long, tokens long"


def _write(folder: str, tokenizer: str, kind: str, end_id: int, shard_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = Encoder.open(tokenizer, kind)
        system, root = _files(folder)
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            name = f"{root}/shard-{part:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.tok"
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{name}.writing", compression=None) as f:
                f.write(shard_bytes(ids, parts))
            system.move(f"{name}.writing", name)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "path": name.rpartition("/")[2], "docs": len(ids), "tokens": held}],
                schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]),
            )

        for b in batches:
            for doc, one in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                ids.append(doc)
                parts.append(one + end)
                held += len(one) // 4 + 1
                if held >= shard_tokens:
                    yield close()
                    ids, parts, held, number = [], [], 0, number + 1
        if ids:
            yield close()

    return write


def write_tokens(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, folder: str | None = None, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shard files and returns their manifest: folder, path, docs, tokens, start (tokens in all shards before).

    * null and empty texts are the end id alone; rows with a null doc_id come first.
    * rows that share a doc_id stand in the order of a hash of their text.
    * an empty table writes no file.
    Only the manifest (a row a shard) is held by the driver.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = src.repartitionByRange(partitions(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows = map_batches(ordered, _write(folder, tokenizer, kind, end_id, shard_tokens), _MANIFEST, give_back=False).collect()
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r["part"], r["number"])):
        out.append((folder, r["path"], r["docs"], r["tokens"], start))
        start += r["tokens"]
    spark.createDataFrame(out, _ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return open_tokens(spark, folder)


_ENTRY = "folder string, path string, docs long, tokens long, start long"


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder of shards, wherever it lies now."""
    return spark.read.schema(_ENTRY).parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for folder, path, start in zip(*(b.column(k).to_pylist() for k in (0, 1, 4))):
            system, root = _files(folder)
            with system.open_input_stream(f"{root}/{path}", compression=None) as f:
                names, sizes, ids = read_shard(f.read())
            stop = np.cumsum(sizes)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[hi - n : hi]) for hi, n in zip(stop.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(stop - sizes + start), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of a manifest."""
    n = max(1, manifest.count())
    return map_batches(manifest.repartition(min(n, 4 * partitions(manifest.sparkSession))), _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
