"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import storage
from tessera.storage import delete_path, new_path

__all__ = ["delete_path", "fold", "free_name", "hash_share", "join_known", "map_batches", "new_path", "partitions", "release", "saved", "small_batches", "trim_jvm"]

#: Rows and bytes handed to a Python worker at once: a batch ends at whichever comes first (a single row may be longer).
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more (it does so only after a collection), and gives the driver's memory back."""
    gc.collect()
    _give_back()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str:
    """Gives back what the driver's JVM has freed outside its heap: compilers, codecs and buffers leave it with malloc, some hundred MB in a long session.  What it says, or nothing where the JVM can't."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        named = jvm.java.lang.Class.forName
        kinds, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values))  # its own class is not open to calls
    except Exception:  # noqa: BLE001  another JVM or C library
        return ""


#: Seconds between two releases of tables written one after another.
RELEASE_EVERY_S = 2.0
_released = [0.0]


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``storage.saved``; what the driver held for it is released now and then, so its memory does not grow with the tables that a session has written."""
    out = storage.saved(df, name, path)
    if time.monotonic() - _released[0] > RELEASE_EVERY_S:
        release(df.sparkSession)
        _released[0] = time.monotonic()
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes.

    A DataFrame is planned when it runs, with its session's settings, so these two are lowered for the session (never raised).
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower()
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))


def _give_back() -> None:
    """Returns what a task's batches took to the system, so that idle workers hold no memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, give_back: bool = True) -> DataFrame:
    """``mapInArrow`` over bounded batches, whose workers give their memory back when a task ends (not those that go on with what they remember)."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if give_back:
                _give_back()

    return df.mapInArrow(task, schema)


#: A key that holds more than one in so many rows is joined apart, so at most so many are sent to the executors.
HOT_KEYS = 10_000


def join_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of stored ``rows`` with a stored table of one row a key, where a few keys may hold much of ``rows``.

    ``known`` has a column ``n``, the rows of its key (it is dropped).  The keys of more than one in ``HOT_KEYS`` of all rows are sent to the executors
    (fewer than ``HOT_KEYS`` of them, whatever the size of the tables), and only rows of other keys are shuffled.
    """
    least = (known.agg(F.sum("n").alias("n")).first()["n"] or 0) / HOT_KEYS
    hot, cold = (known.where(c).drop("n") for c in (F.col("n") > least, F.col("n") <= least))
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys)
    return rest.unionByName(rows.join(F.broadcast(hot), keys).select(rest.columns))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores put before it until no column of ``taken`` is called so (case aside)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the document id written as text, modulo ``modulus``; a null id counts as the text ``null``."""
    name = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(name, F.lit("null")).cast("binary")) % modulus


def hash_share(h: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the least ``share`` of all."""
    return F.lit(True) if share >= 1 else h <= F.lit(int(share * 2**64) - 2**63)
