"""Replay of checked logs: what comes before the first broken record, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay(log: DataFrame, bad: Column, order: str = "offset", by: list[str] | None = None) -> DataFrame:
    """The records before the first bad one of each log (all of ``log``, or each of ``by``).

    The first bad place is one aggregate, so records need no global order: a
    running count of bad records would sort the whole log in one task. A NULL
    ``bad`` is bad; records of NULL order are dropped.
    """
    by, broken = by or [], F.coalesce(bad, F.lit(True))
    first = F.min(F.when(broken, F.col(order))).alias("_first")
    if not by:
        stop = log.agg(first).first()[0]
        return log.where(F.col(order) < stop) if stop is not None else log.where(F.col(order).isNotNull())
    ends = log.groupBy(*by).agg(first)
    return log.join(ends, by).where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).where(F.col(order).isNotNull()).drop("_first")


def next_seq(oplog: DataFrame) -> DataFrame:
    """One row ``next_seq``: one above the highest; 1 for an empty log."""
    return oplog.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("long").alias("next_seq"))


def is_empty(log: DataFrame) -> bool:
    """Whether a log holds no record; reads at most one."""
    return log.isEmpty()
