"""Tables that cut lineage: written into the folder that the cluster names in ``spark.checkpoint.dir`` (shared by the driver and all
executors), so a lost executor costs a re-read and never a replay of the whole job."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without belongs to the cluster's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return f"file://{out.removeprefix('file:')}" if out.startswith("file:/") and not out.startswith("file://") else out


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only a local master (tests on one machine) may leave the setting out; a temporary folder is made then.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        _FOLDERS[app] = f"{qualified(spark, root).rstrip('/')}/tessera-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        delete_path(spark, folder)
    except Exception:  # noqa: BLE001  the session has ended; its folder is left to the cluster's cleaner
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this application's own, in any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, path: str | None = None, **options: int) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a reader of it; ``options`` are the writer's."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
