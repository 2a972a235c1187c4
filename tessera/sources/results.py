"""Stored runs: pairs as Parquet, metadata as JSON, legacy triplets, statistics and sweep summaries.

    <folder>/<method>/pairs/*.parquet     a_idx, b_idx, dist
    <folder>/<method>/metadata.json

All paths go through Spark's file systems.  A run exists once its metadata does, which is written last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import numeric, path_part
from tessera.storage import qualified

PAIRS = "a_idx long, b_idx long, dist double"
#: The columns of a sweep summary, in order.
SWEEP_COLUMNS = ["method_name", "base_method", "time_s", "pair_count", "recall", "k", "itopk_size", "n_lists", "n_probes", "n_clusters", "k_db_candidates"]
_METADATA = (
    "method string, base_method string, time_s double, pair_count long, n_tiles long, total_pairs_compared long, build_time_s double, cluster_time_s double, "
    "n_clusters long, scheduled_tiles long, total_possible_tiles long, prune_ratio double, "
    "N long, M long, D long, self_join boolean, recall double, params map<string,string>"
)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as it stands."""
    return "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


class ResultSet:
    """A lazy handle of one run."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        if not exists(spark, f"{folder}/metadata.json"):
            raise FileNotFoundError(f"{folder}/metadata.json")
        self.metadata: dict[str, Any] = json.loads(read_text(spark, f"{folder}/metadata.json"))

    @property
    def pairs(self) -> DataFrame:
        if exists(self.spark, f"{self.folder}/pairs"):
            return self.spark.read.schema(PAIRS).parquet(f"{self.folder}/pairs")
        return read_triplets(self.spark, self.folder)

    @property
    def pair_count(self) -> int:
        known = self.metadata.get("pair_count")
        return int(known) if known is not None else self.pairs.count()

    def __len__(self) -> int:
        return self.pair_count

    def rows(self) -> Iterator[Row]:
        """All pairs, a partition at a time."""
        return self.pairs.toLocalIterator(prefetchPartitions=True)

    def chunks(self, size: int = 1_000_000) -> Iterator[list[Row]]:
        held: list[Row] = []
        for r in self.rows():
            held.append(r)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held


class ResultStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, method: str, pairs: DataFrame, metadata: dict[str, Any] | None = None) -> ResultSet:
        """Writes pairs, then metadata; ``pair_count`` is counted unless given."""
        where = f"{self.folder}/{method}"
        fs, p = _fs(self.spark, f"{where}/metadata.json")
        if fs.exists(p):
            fs.delete(p, False)
        pairs.select("a_idx", "b_idx", F.col("dist").cast("double").alias("dist")).write.mode("overwrite").parquet(f"{where}/pairs")
        known = {"method": method, **(metadata or {})}
        known.setdefault("pair_count", self.spark.read.schema(PAIRS).parquet(f"{where}/pairs").count())
        write_text(self.spark, f"{where}/metadata.json", json.dumps(known, indent=2, default=str))
        return ResultSet(self.spark, where)

    def annotate(self, method: str, metadata: dict[str, Any]) -> ResultSet:
        """Replaces a run's metadata."""
        write_text(self.spark, f"{self.folder}/{method}/metadata.json", json.dumps(metadata, indent=2, default=str))
        return self.load(method)

    def load(self, method: str) -> ResultSet:
        return ResultSet(self.spark, f"{self.folder}/{method}")

    def exists(self, method: str) -> bool:
        return exists(self.spark, f"{self.folder}/{method}/metadata.json")

    def runs(self) -> list[str]:
        """Names of the stored runs, sorted."""
        fs, p = _fs(self.spark, self.folder)
        if not fs.exists(p):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory() and self.exists(x.getPath().getName()))


def read_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """One row for each metadata file of a glob, with the file's path; unknown fields are dropped, absent ones null."""
    return spark.read.schema(_METADATA).option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())


def collect_runs(spark: SparkSession, pattern: str, statistics: DataFrame | None = None, layout: str = r"/([^/]+)/[^/]+/([^/]+)/metadata\.json$") -> DataFrame:
    """Runs of a glob as dataset, method, time_s, cluster_time_s, join_time_s, recall.

    Dataset and method come from the path.  Exact methods have recall 1; others that of ``statistics`` (dataset, method, recall) or null.
    """
    m = read_metadata(spark, pattern)
    m = m.select(path_part("path", layout, 1).alias("dataset"), path_part("path", layout, 2).alias("method"), "time_s", F.coalesce("cluster_time_s", F.lit(0.0)).alias("cluster_time_s"))
    m = m.withColumn("join_time_s", F.col("time_s") - F.col("cluster_time_s"))
    if statistics is not None:
        m = m.join(statistics.select("dataset", "method", F.col("recall").alias("_r")), ["dataset", "method"], "left")
    else:
        m = m.withColumn("_r", F.lit(None).cast("double"))
    return m.select(*[c for c in m.columns if c != "_r"], F.when(F.col("method").contains("brute"), 1.0).otherwise(F.col("_r")).alias("recall"))


def write_statistics(spark: SparkSession, path: str, statistics: list[dict[str, Any]]) -> None:
    write_text(spark, path, json.dumps(statistics, indent=2, default=str))


def read_statistics(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    return json.loads(read_text(spark, path))


def statistics_table(spark: SparkSession, pattern: str, layout: str = r"/([^/]+)/[^/]+/statistics\.json$") -> DataFrame:
    """(dataset, method, recall) of the statistics files of a glob, for ``collect_runs``; the dataset comes from the path."""
    rows = spark.read.schema("method string, recall double").option("multiLine", True).json(pattern)
    return rows.select(path_part(F.input_file_name(), layout).alias("dataset"), "method", "recall")


def report(statistics: list[dict[str, Any]]) -> str:
    """A plain text table of run statistics, for consoles."""
    columns = ["method", "time_s", "pair_count", "recall", "n_neighbors_min", "n_neighbors_max", "n_neighbors_mean", "n_neighbors_std"]
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [columns, *[[cell(s.get(c)) for c in columns] for s in statistics]]
    wide = [max(len(x[i]) for x in lines) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) if i == 0 else v.rjust(w) for i, (v, w) in enumerate(zip(x, wide))) for x in lines)


def write_sweep(summary: DataFrame, path: str) -> None:
    """One CSV file (a row for each point of a sweep) with a header; absent values are blank."""
    have = [F.col(c) if c in summary.columns else F.lit(None).cast("string").alias(c) for c in SWEEP_COLUMNS]
    rows = summary.select(have).orderBy("method_name").collect()
    lines = [SWEEP_COLUMNS, *[["" if v is None else str(v) for v in r] for r in rows]]
    write_text(summary.sparkSession, path, "".join(",".join(x) + "\n" for x in lines))


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """A sweep summary; what is no number is null, and rows without a time go."""
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    for c in SWEEP_COLUMNS:
        text = text if c in text.columns else text.withColumn(c, F.lit(None).cast("string"))
    return text.select("method_name", "base_method", *[numeric(c).alias(c) for c in SWEEP_COLUMNS[2:]]).dropna(subset=["time_s"])


#: The files of a legacy run and their element types, little-endian.
TRIPLETS = {"a_indices.bin": "<i8", "b_indices.bin": "<i8", "distances.bin": "<f4"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_triplets(spark: SparkSession, folder: str, rows_per_task: int = 1 << 20) -> DataFrame:
    """Pairs of a legacy run: three files read side by side, a range of rows a task."""
    folder = qualified(spark, folder)
    system, root = _open(folder)
    sizes = [system.get_file_info(f"{root}/{n}") for n in TRIPLETS]
    if any(s.type == pafs.FileType.NotFound for s in sizes):
        return spark.createDataFrame([], PAIRS)
    counts = {s.size // np.dtype(t).itemsize for s, t in zip(sizes, TRIPLETS.values())}
    if len(counts) > 1:
        raise ValueError(f"{folder}: files of different lengths")
    n = counts.pop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, base = _open(folder)
        for b in batches:
            for k in b.column(0).to_pylist():
                lo, hi = k * rows_per_task, min(n, (k + 1) * rows_per_task)
                cols = []
                for name, t in TRIPLETS.items():
                    size = np.dtype(t).itemsize
                    with local.open_input_file(f"{base}/{name}") as f:
                        cols.append(np.frombuffer(f.read_at((hi - lo) * size, lo * size), t))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.float64))], names=["a_idx", "b_idx", "dist"])

    tasks = -(-n // rows_per_task)
    return spark.range(tasks, numPartitions=max(1, tasks)).mapInArrow(run, PAIRS)


def write_triplets(pairs: DataFrame, folder: str) -> int:
    """The legacy form of a result, streamed through the driver a partition at a time."""
    system, root = _open(qualified(pairs.sparkSession, folder))
    system.create_dir(root, recursive=True)
    files = [system.open_output_stream(f"{root}/{n}", compression=None) for n in TRIPLETS]
    total = 0
    try:
        held: list[Row] = []

        def flush() -> None:
            for f, t, c in zip(files, TRIPLETS.values(), range(3)):
                f.write(np.array([r[c] for r in held], t).tobytes())

        for r in pairs.select("a_idx", "b_idx", "dist").toLocalIterator(prefetchPartitions=True):
            held.append(r)
            total += 1
            if len(held) >= 100_000:
                flush()
                held = []
        flush()
    finally:
        for f in files:
            f.close()
    return total
