"""Replicated logs: numbering, commit, and what a follower may apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lww import latest

#: Positions of a log are grouped in blocks of this many, to number and check it in many tasks.
BLOCK_BITS = 16


def assign_index(ops: DataFrame, by: list[str], order: str, last: int = 0) -> DataFrame:
    """``ops`` with ``index`` = last + 1, last + 2, ... in ``order`` within ``by``.

    Numbers are given within blocks of ``order`` and raised by the rows of the
    blocks before, so a log of any length is numbered by many tasks. ``order``
    is an integer, unique within ``by``.
    """
    rows = ops.withColumn("_block", F.shiftright(order, BLOCK_BITS))
    counts = rows.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by).orderBy("_block") if by else Window.partitionBy(F.lit(0)).orderBy("_block")
    ahead = counts.select(*by, "_block", (F.sum("_n").over(over) - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order))
    numbered = rows.withColumn("_i", inside).join(ahead, [*by, "_block"])
    return numbered.withColumn("index", F.col("_i") + F.col("_ahead") + F.lit(last)).drop("_i", "_ahead", "_block")


def contiguous_end(log: DataFrame, by: list[str]) -> DataFrame:
    """``*by, applied``: the highest n such that 1..n are all there; 0 if 1 is missing.

    Repeated indexes count once. A block is full if it has as many different
    indexes as it is long; the first one that isn't ends the prefix, and only
    its rows are put in order.
    """
    size = 1 << BLOCK_BITS
    # Index 1 is the first place of block 0.
    rows = log.where("index >= 1").select(*by, (F.col("index") - 1).alias("i")).distinct().withColumn("block", F.shiftright("i", BLOCK_BITS))
    blocks = rows.groupBy(*by, "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("block")
    runs = blocks.withColumn("at", F.row_number().over(order) - 1).withColumn("whole", (F.col("block") == F.col("at")) & (F.col("n") == size))
    # Full blocks from 0 on, then the block after them if it is there.
    full = runs.groupBy(*by).agg(F.min(F.when(~F.col("whole"), F.col("at"))).alias("stop"), F.max("at").alias("top"))
    full = full.select(*by, F.coalesce("stop", F.col("top") + 1).cast("long").alias("block"))
    part = rows.join(full, [*by, "block"]).withColumn("k", F.row_number().over(Window.partitionBy(*by, "block").orderBy("i")) - 1)
    inside = part.where((F.col("i") - F.col("k")) == F.shiftleft("block", BLOCK_BITS)).groupBy(*by).agg(F.count("*").alias("more"))
    logs = log.select(*by).distinct()
    return logs.join(full, by, "left").join(inside, by, "left").select(*by, (F.shiftleft(F.coalesce("block", F.lit(0).cast("long")), BLOCK_BITS) + F.coalesce("more", F.lit(0))).cast("long").alias("applied"))


def applied_prefix(log: DataFrame, commits: DataFrame, by: list[str], after: int = 0) -> DataFrame:
    """The rows a follower applies: ``index`` in ``(after, min(contiguous end, commit_index)]``.

    ``commits`` has ``*by, commit_index``; a log without one applies nothing.
    """
    ends = contiguous_end(log, by).join(commits, by).select(*by, F.least("applied", "commit_index").alias("_upto"))
    return log.join(ends, by).where((F.col("index") > after) & (F.col("index") <= F.col("_upto"))).drop("_upto")


def ingest(messages: DataFrame) -> DataFrame:
    """``store_id, term, index, op, key, value`` of every entry of every message; NULL and empty lists give none."""
    return messages.select("store_id", F.explode("entries").alias("e")).select("store_id", "e.term", "e.index", "e.op", "e.key", "e.value")


def follower_state(messages: DataFrame) -> DataFrame:
    """``store_id, term, commit_index``: both only ever rise; NULL commits count as none."""
    return messages.groupBy("store_id").agg(F.max("term").alias("term"), F.coalesce(F.max("leader_commit"), F.lit(0)).cast("long").alias("commit_index"))


def follower_log(messages: DataFrame) -> DataFrame:
    """One row per ``(store_id, index)`` of all messages: the entry of the highest term."""
    entries = ingest(messages)
    return latest(entries, ["store_id", "index"], ["term", "op", "key", "value"], ["term", "op", "key", "value"])


def acknowledged(ships: DataFrame, by: list[str]) -> DataFrame:
    """``*by, n_peers, n_acks, replicated``: replicated if a peer acknowledged, or there is none."""
    out = ships.groupBy(*by).agg(F.count("peer").alias("n_peers"), F.count_if(F.col("peer").isNotNull() & F.col("ack")).alias("n_acks"))
    return out.withColumn("replicated", (F.col("n_acks") > 0) | (F.col("n_peers") == 0))


def connected(peers: DataFrame) -> DataFrame:
    """One row ``n_peers, n_connected``."""
    return peers.agg(F.count("*").alias("n_peers"), F.count_if("connected").alias("n_connected"))


def divergence(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """``store_id, index, problem``: entries only one log has, or that differ in term, op, key or value."""
    columns = ["term", "op", "key", "value"]
    a = leader.select("store_id", "index", F.struct(*columns).alias("l"))
    b = follower.select("store_id", "index", F.struct(*columns).alias("f"))
    problem = F.when(F.col("l").isNull(), "missing_leader").when(F.col("f").isNull(), "missing_follower").when(~F.col("l").eqNullSafe(F.col("f")), "differs")
    return a.join(b, ["store_id", "index"], "full").select("store_id", "index", problem.alias("problem")).where("problem IS NOT NULL")
