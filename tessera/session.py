"""Session defaults for local work; a cluster's own settings are left as they are."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tessera", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and as many shuffle partitions as asked for (default 8)."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # matrix kernels: a thread a task
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
