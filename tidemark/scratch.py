"""Shared scratch space: written tables and checkpoints that outlive an executor.

A cluster names the folder in ``spark.checkpoint.dir`` (or has set one by
``setCheckpointDir``); it is read from the session and never replaced. Only a local master without that setting gets a
temporary folder of its own, removed when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Raises on a cluster that names none."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError(f"{SETTING} is not set; a cluster needs a shared folder")
    if sc.applicationId not in _local:
        path = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local[sc.applicationId] = f"file://{path}"
    return _local[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the driver's Python ends, with the session open or stopped."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_delete, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target)
    return path


def _delete(fs, target) -> None:
    try:
        fs.delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM has ended before Python did
        pass


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a table written below the shared folder.

    Unlike the files of a checkpoint, which nobody deletes, it goes with the driver.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
