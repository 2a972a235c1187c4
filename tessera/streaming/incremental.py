"""Vectors that arrive as a stream, joined with a static base as they come (an extension: batches are micro-batches)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.joins import threshold_join


def join_stream(stream: DataFrame, base: DataFrame, threshold: float, sink: str, checkpoint: str, once: bool = False, join: Callable[[DataFrame, DataFrame, float], DataFrame] = threshold_join) -> StreamingQuery:
    """Every arriving row (vec_id, embedding) against all of ``base``: (a_idx of base, b_idx of the stream, dist) to ``sink``.

    A micro-batch is written under its own number and replaces what an attempt before a failure wrote, so
    each pair is stored exactly once.  ``once``: what is there now, then stop.
    """

    def write(batch: DataFrame, number: int) -> None:
        join(base, batch, threshold).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.select("vec_id", "embedding").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def degrees_of(pairs: DataFrame) -> DataFrame:
    """Pairs a base row has had so far, of a (streaming or stored) result."""
    return pairs.groupBy("a_idx").agg(F.count(F.lit(1)).alias("degree"), F.min("dist").alias("least_dist"))
