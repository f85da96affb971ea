"""Latency percentiles, throughput, scaling: the summaries of measured runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.95, 0.99, 0.999)


#: Accuracy of the cut points around a percentile: some 2 / ACCURACY of the values lie between them.
ACCURACY = 20_000


def percentiles(values: DataFrame, column: str, ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``p, value``: element ``min(floor(n * p), n - 1)`` of the sorted values.

    A sketch of quantiles gives two cut points around each percentile; one
    aggregation counts what lies below them, and only the values between are
    put in order, equal ones counted once. So no task holds more than a few of
    20,000 parts of the values, whatever they are; where a sketch misses, its cut
    points are opened. NULLs are left out; without values there are no rows.
    """
    rows, x = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")), F.col("value")
    total = rows.count()
    if not total:
        return rows.select(F.lit(0.0).alias("p"), "value").limit(0)
    ranks = [min(int(total * p), total - 1) for p in ps]
    near = [max(0.0, min(1.0, (r + 1) / total + d / ACCURACY)) for r in ranks for d in (-2, 2)]
    cuts = rows.agg(F.percentile_approx("value", near, ACCURACY)).first()[0]
    pairs = list(zip(cuts[::2], cuts[1::2]))
    tests = [f for i, (lo, hi) in enumerate(pairs) for f in (F.count_if(x < F.lit(lo)).alias(f"below{i}"), F.count_if(x <= F.lit(hi)).alias(f"upto{i}"))]
    counts = rows.agg(*tests).first()
    parts = []
    for i, (p, rank, (lo, hi)) in enumerate(zip(ps, ranks, pairs)):
        below, upto = counts[f"below{i}"], counts[f"upto{i}"]
        part = rows
        if rank >= below:
            part = part.where(x >= F.lit(lo))
        if rank < upto:
            part = part.where(x <= F.lit(hi))
        parts.append(part.select(F.lit(float(p)).alias("p"), F.lit(rank - (below if rank >= below else 0)).alias("rank"), "value"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = F.sum("n").over(Window.partitionBy("p").orderBy("value"))
    placed = found.groupBy("p", "rank", "value").agg(F.count("*").alias("n")).withColumn("upto", order)
    return placed.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("p", "value")


def latency_summary(values: DataFrame, column: str) -> DataFrame:
    """``stat, value`` with the least, mean (to six places) and greatest value and the percentiles."""
    v = F.col(column).cast("double")
    ends = values.agg(F.min(v).alias("min"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("max")).unpivot([], ["min", "mean", "max"], "stat", "value").where("value IS NOT NULL")
    named = percentiles(values, column).select(F.concat(F.lit("p"), F.regexp_replace((F.col("p") * 1000).cast("int").cast("string"), "0$", "")).alias("stat"), F.col("value").cast("double").alias("value"))
    return ends.unionByName(named)


def throughput(n_ops: Column, millis: Column) -> Column:
    """Operations per second; NULL for no time."""
    return F.when(millis > 0, n_ops * 1000.0 / millis)


def rates(ops: DataFrame, by: list[str]) -> DataFrame:
    """Operations, puts and removals of each group, with the share of puts."""
    return ops.groupBy(*by).agg(F.count("*").alias("n_ops"), F.count_if(F.col("op") == "PUT").alias("n_puts"), F.count_if(F.col("op") == "DELETE").alias("n_deletes")).withColumn("put_share", F.col("n_puts") / F.col("n_ops"))


def scaling(measured: DataFrame) -> DataFrame:
    """``threads, throughput, speedup, efficiency`` against the row of one thread (NULL without one)."""
    base = measured.agg(F.max(F.when(F.col("threads") == 1, F.col("throughput"))).alias("_base"))  # one row, sent to every task
    speedup = F.when(F.col("_base") > 0, F.col("throughput") / F.col("_base"))
    return measured.withColumn("_one", F.lit(1)).join(F.broadcast(base.withColumn("_one", F.lit(1))), "_one").select("threads", "throughput", speedup.alias("speedup"), (speedup / F.col("threads")).alias("efficiency"))


def file_reduction(before: Column, after: Column) -> Column:
    """Percent by which a count or size went down; NULL if there was nothing before."""
    return F.when(before > 0, (before - after) * 100.0 / before)
