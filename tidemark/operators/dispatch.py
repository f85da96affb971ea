"""Command streams answered as a node would: one reply per command, in order per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import wire


def replies(commands: DataFrame, role: str = "standalone", status_text: str | None = None, before: DataFrame | None = None) -> DataFrame:
    """``seq, verb, key, success, message, value, line`` for each row of ``(seq, line)``.

    A GET sees the last PUT or DELETE before it on its key; DELETE succeeds if
    the key was live. A follower refuses PUT and DELETE, and they change
    nothing. STATUS answers ``status_text`` as a value. Commands that can't be
    parsed, and STATUS without a text, answer UNKNOWN_COMMAND. ``seq`` is unique
    and at least 0. ``before`` has the rows ``key, value`` that were live before
    the first command; without it there are none.
    """
    rows = wire.with_command(commands.select("seq", "line"), "line").drop("line")
    if before is not None:
        rows = rows.unionByName(before.select(F.lit(-1).cast("long").alias("seq"), F.lit("PUT").alias("verb"), "key", "value"))
    writes, follows, told = F.col("verb").isin("PUT", "DELETE"), F.lit(role == "follower"), F.lit(status_text is not None)
    counts = writes & (~follows | (F.col("seq") < 0))
    rows = _last_write(rows.withColumn("w", F.when(counts, F.struct("seq", (F.col("verb") == "PUT").alias("put"), "value"))))
    live, get, put, delete = F.coalesce(F.col("last.put"), F.lit(False)), *(F.col("verb") == v for v in ("GET", "PUT", "DELETE"))
    ping, bye, status_asked = (F.col("verb") == v for v in ("PING", "QUIT", "STATUS"))
    message = (
        F.when(writes & follows, wire.NOT_LEADER)
        .when(put, wire.STORED)
        .when(delete, F.when(live, wire.DELETED).otherwise(wire.DELETE_FAILED))
        .when(get, F.when(live, "OK").otherwise(wire.NOT_FOUND))
        .when(ping, wire.PONG)
        .when(bye, wire.BYE)
        .when(status_asked & told, "OK")
        .otherwise(wire.UNKNOWN_COMMAND)
    )
    rows = rows.where("seq >= 0") if before is not None else rows
    success = F.when(writes & follows, False).when(get | delete, live).otherwise(put | ping | bye | (status_asked & told))
    value = F.when(get & live, F.col("last.value")).when(status_asked & told, F.lit(status_text))
    out = rows.select("seq", "verb", "key", success.alias("success"), message.alias("message"), value.alias("value"))
    return out.withColumn("line", wire.reply_line(F.col("success"), F.col("message"), F.col("value")))


def _last_write(rows: DataFrame) -> DataFrame:
    """``rows`` with ``last``: the greatest ``w`` of earlier rows of the key. ``w`` starts with seq, so it only grows.

    Ordered in blocks, as ``previous``: within a block row by row, over a key block by block.
    """
    rows = rows.withColumn("_block", F.shiftright("seq", 16))
    inner = Window.partitionBy("key", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("key IS NOT NULL").groupBy("key", "_block").agg(F.max("w").alias("_end")).select("key", "_block", F.max("_end").over(outer).alias("_before"))
    # Commands without a key join nothing and see no write.
    return rows.withColumn("_in", F.max("w").over(inner)).join(ends, ["key", "_block"], "left").withColumn("last", F.coalesce("_in", "_before")).drop("_in", "_before", "_block", "w")


def status(spark, node_id: int, role: str, term: int, commit_index: int, connections: int) -> DataFrame:
    """One row ``node_id, role, term, commit_index, connections, text``; a standalone node has no term."""
    kept = "" if role.upper() == "STANDALONE" else f"Term: {term}\nCommit Index: {commit_index}\n"
    text = f"Node ID: {node_id}\nRole: {role.upper()}\n{kept}Active Connections: {connections}"
    return spark.createDataFrame([(node_id, role.upper(), term, commit_index, connections, text)], "node_id int, role string, term long, commit_index long, connections int, text string")
