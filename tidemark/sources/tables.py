"""Parquet tables of a data folder, and the op-log view over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read table ``name`` (one Parquet file, or a folder of them) below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_oplog(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as an op-log: columns ``key, value, seq, op, flush_id``.

    An event of type ``error`` removes its user's key; removals hold ``''``,
    never NULL. ``flush_id`` cuts the log into runs of 500 operations.
    """
    gone = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.when(gone, "").otherwise(F.col("props")).alias("value"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, "DELETE").otherwise("PUT").alias("op"),
        F.floor(F.col("event_id") / 500).alias("flush_id"),
    )
