"""Command lines as a stream: from text files, or from a socket for trials."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import frames, wire
from tidemark.operators import dispatch, lww
from tidemark.plans.store import Store
from tidemark.scratch import cut

# Fixed value: the longest line a connection may send.
LINE_BYTES = 1 << 20


def lines(spark: SparkSession, folder: str | None = None, host: str | None = None, port: int | None = None) -> DataFrame:
    """Column ``value`` with lines from new text files of ``folder``, or from a socket (which can't be replayed)."""
    if folder is not None:
        return spark.readStream.text(folder)
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def requests(stream: DataFrame) -> DataFrame:
    """``verb, key, value`` of each line; lines that are too long are INVALID."""
    lines = stream.select(F.when(F.octet_length("value") <= LINE_BYTES, F.col("value")).alias("line"))
    return wire.with_command(lines, "line").drop("line")


def answer(store_path: str, replies_path: str, name: str, role: str = "leader") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that answers the lines (column ``value``) of stream ``name`` as a node at ``store_path`` would.

    Each batch's replies go to ``replies_path`` as ``seq, line`` in a folder of
    its own, in the order of the lines; its writes go to the store. The store
    remembers the batch, so one that comes again after a failure is answered from
    the same state or, once its writes are there, not again.
    """

    def run(batch: DataFrame, n: int) -> None:
        store = Store(batch.sparkSession, store_path)
        if store.wrote(name, n):
            return
        given = batch.select(F.when(F.octet_length("value") <= LINE_BYTES, F.col("value")).alias("line"))
        given = cut(given.withColumn("seq", F.monotonically_increasing_id()))
        asked = cut(wire.with_command(given, "line").select("seq", "verb", "key", "value"))
        before = lww.multi_get(store.rows(), asked.where("key IS NOT NULL")).select("key", "value")
        said = dispatch.replies(given, role, before=before)
        said.select("seq", "line").write.mode("overwrite").parquet(f"{replies_path}/batch={n}")
        ops = asked.where(F.col("verb").isin("PUT", "DELETE") & F.lit(role != "follower"))
        store.write(ops.select("key", "value", F.col("verb").alias("op"), F.col("seq").alias("at")), order="at", batch=(name, n))

    return run


def messages(stream: DataFrame) -> DataFrame:
    """``term, leader_commit, entries`` of each line as a replication frame, with ``ack`` as the follower answers it."""
    read = frames.decode_messages(stream.withColumnRenamed("value", "frame"))
    return read.select("term", "leader_commit", "entries", F.when(F.col("term").isNotNull(), "+OK").alias("ack"))
