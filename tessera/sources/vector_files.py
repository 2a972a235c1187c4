"""Vector files as Spark data sources: ``u8bin``, ``fbin``, ``fvecs`` and ``bvecs``.

    register(spark)
    spark.read.format("fvecs").option("maxVectors", 1000).load("file:///data/x.fvecs")

gives (vec_id, embedding): the place in the file, and single-precision components.  Each
task reads its own range of rows; nothing reads a file as a whole.  The same formats can
be written: each task writes one part file, whose header is right by itself.

Formats (all little-endian):
  u8bin, fbin   u32 rows, u32 dimensions, then rows of u8 or f32
  fvecs, bvecs  for each row i32 dimensions, then f32 or u8; a partial last row is not read
Options: ``maxVectors`` (first rows in file order; 0 or absent: all), ``rowsPerTask``, ``dim`` (must match).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.storage import qualified

#: Element type, and whether the header is one for the file or one for each row.
FORMATS = {
    "u8bin": (np.dtype("u1"), True),
    "fbin": (np.dtype("<f4"), True),
    "fvecs": (np.dtype("<f4"), False),
    "bvecs": (np.dtype("u1"), False),
}
ROWS_PER_TASK = 1 << 18
_BATCH = 4096
SCHEMA = "vec_id bigint, embedding array<float>"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def shape(path: str, fmt: str) -> tuple[int, int]:
    """Rows and dimensions of a file, from its header and length."""
    dtype, whole = FORMATS[fmt]
    system, name = _open(path)
    with system.open_input_file(name) as f:
        size = f.size()
        if size < 4:
            return 0, 0
        if whole:
            n, d = np.frombuffer(f.read_at(8, 0), "<u4").tolist()
            return n, d
        d = int(np.frombuffer(f.read_at(4, 0), "<i4")[0])
        if d <= 0:
            raise ValueError(f"{path}: {d} dimensions")
        return size // (4 + d * dtype.itemsize), d


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int
    dim: int
    first_id: int


class _Reader(DataSourceReader):
    def __init__(self, fmt: str, options: dict[str, str]) -> None:
        self.fmt, self.options = fmt, {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        path, most = self.options.get("path"), int(self.options.get("maxvectors") or 0)
        if not path:
            raise ValueError("load() needs a path")
        system, name = _open(path)
        info = system.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        names = sorted(x.path for x in system.get_file_info(pafs.FileSelector(name)) if x.is_file and x.base_name.endswith(f".{self.fmt}")) if info.type == pafs.FileType.Directory else [name]
        prefix = path.split("://", 1)[0] + "://" if "://" in path and not path.startswith("file:") else ""
        step, out, done = int(self.options.get("rowspertask") or ROWS_PER_TASK), [], 0
        for x in names:
            where = f"{prefix}{x}"
            n, d = shape(where, self.fmt)
            if n and "dim" in self.options and int(self.options["dim"]) != d:
                raise ValueError(f"{where}: {d} dimensions, not {self.options['dim']}")
            n = min(n, most - done) if most else n
            out += [_Range(where, lo, min(lo + step, n), d, done) for lo in range(0, n, step)]
            done += n
        return out or [_Range("", 0, 0, 1, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.stop == part.start:
            return
        dtype, whole = FORMATS[self.fmt]
        head, row = (8, part.dim * dtype.itemsize) if whole else (0, 4 + part.dim * dtype.itemsize)
        system, name = _open(part.path)
        with system.open_input_file(name) as f:
            for lo in range(part.start, part.stop, _BATCH):
                n = min(_BATCH, part.stop - lo)
                raw = np.frombuffer(f.read_at(n * row, head + lo * row), np.uint8)
                if len(raw) < n * row:
                    raise ValueError(f"{part.path}: ends within row {lo + len(raw) // row}")
                raw = raw.reshape(n, row)
                if not whole:
                    if (raw[:, :4].copy().view("<i4") != part.dim).any():
                        raise ValueError(f"{part.path}: rows differ in dimensions")
                    raw = raw[:, 4:]
                x = np.ascontiguousarray(raw).view(dtype).astype(np.float32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.dim, pa.int32()), pa.array(x))
                ids = pa.array(np.arange(lo, lo + n, dtype=np.int64) + part.first_id)
                yield pa.RecordBatch.from_arrays([ids, lists], names=["vec_id", "embedding"])


#: A part file is closed when it holds so many bytes.
_PART_BYTES = 64 << 20


@dataclass
class _Wrote(WriterCommitMessage):
    files: list[tuple[str, str, int]]  # temporary and final name, rows


class _Writer(DataSourceArrowWriter):
    """Rows in the order they come; a task's file gets its name only when all tasks are done."""

    def __init__(self, fmt: str, path: str, overwrite: bool) -> None:
        self.fmt, self.path, self.overwrite = fmt, path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        dtype, whole = FORMATS[self.fmt]
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        part = f"{root}/part-{TaskContext.get().partitionId():06d}"
        held: list[np.ndarray] = []
        files: list[tuple[str, str, int]] = []
        size = 0

        def close() -> None:
            x = np.concatenate(held)
            name = f"{part}-{len(files):05d}"
            temporary = f"{name}.{uuid.uuid4().hex[:8]}.writing"
            with system.open_output_stream(temporary, compression=None) as f:
                if whole:
                    f.write(np.array(x.shape, "<u4").tobytes())
                    f.write(x.tobytes())
                else:
                    dim = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
                    f.write(np.concatenate((dim, x.view(np.uint8).reshape(len(x), -1)), axis=1).tobytes())
            files.append((temporary, f"{name}.{self.fmt}", len(x)))

        for b in batches:
            col = b.column(b.schema.names.index("embedding")).drop_null()
            if not len(col):
                continue
            widths = np.unique(np.diff(np.asarray(col.offsets)))
            if len(widths) > 1 or held and widths[0] != held[0].shape[1]:
                raise ValueError("vectors differ in dimensions")
            held.append(np.asarray(col.flatten()).reshape(len(col), -1).astype(dtype))
            size += held[-1].nbytes
            if size >= _PART_BYTES:  # a header states its file's rows, so what is held is bounded by the file
                close()
                held, size = [], 0
        if held:
            close()
        return _Wrote(files)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, root = _open(self.path)
        if self.overwrite:
            for x in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if x.base_name.endswith(f".{self.fmt}"):
                    system.delete_file(x.path)
        for m in messages:
            for temporary, final, _ in m.files if m is not None else ():
                system.move(temporary, final)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for temporary, _, _ in m.files if m is not None else ():
                system.delete_file(temporary)


def _source(fmt: str) -> type[DataSource]:
    class VectorFile(DataSource):
        @classmethod
        def name(cls) -> str:
            return fmt

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fmt, dict(self.options))

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            return _Writer(fmt, {k.lower(): v for k, v in self.options.items()}["path"], overwrite)

    VectorFile.__name__ = f"VectorFile_{fmt}"
    return VectorFile


def register(spark: SparkSession) -> None:
    for fmt in FORMATS:
        spark.dataSource.register(_source(fmt))


def load_vectors(spark: SparkSession, path: str, fmt: str, max_vectors: int | None = None, dim: int | None = None) -> DataFrame:
    """Vectors of a file in one of ``FORMATS``, or of a parquet table with an embedding column."""
    if fmt == "parquet":
        df = spark.read.parquet(path).select("vec_id", "embedding")
        return df.orderBy("vec_id").limit(max_vectors) if max_vectors else df
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    register(spark)
    reader = spark.read.format(fmt).option("maxVectors", str(max_vectors or 0))
    return (reader if dim is None else reader.option("dim", str(dim))).load(qualified(spark, path))


def save_vectors(vectors: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """Writes part files in id order (of ranges of ids)."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    register(vectors.sparkSession)
    ordered = vectors.select("vec_id", "embedding").where("embedding is not null").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    ordered.write.format(fmt).mode(mode).save(qualified(vectors.sparkSession, path))
