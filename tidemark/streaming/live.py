"""Op-logs and replication messages as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.store import Store


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder, as they come; ``files_per_batch`` bounds a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def live_state(oplog: DataFrame) -> DataFrame:
    """The last operation of each key, for ``update`` mode. An older operation that comes late changes nothing."""
    best = F.max(F.struct("seq", "op", "value")).alias("best")
    return oplog.groupBy("key").agg(best).select("key", "best.value", "best.seq", "best.op")


def entries(messages: DataFrame) -> DataFrame:
    """The entries of replication messages, one row each."""
    return messages.select("store_id", F.explode("entries").alias("e")).select("store_id", "e.term", "e.index", "e.op", "e.key", "e.value")


def into_store(path: str, name: str, flush_bytes: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch to the store at ``path`` exactly once.

    The manifest remembers the last batch of stream ``name``, so a batch that
    is sent again after a failure is known. Without ``flush_bytes`` every batch
    becomes a run; with it, batches gather in the log up to that size.
    """

    def write(batch: DataFrame, n: int) -> None:
        store, rows = Store(batch.sparkSession, path), batch.select("key", "value", "seq", "op")
        if flush_bytes is None:
            store.load(rows, batch=(name, n))
        else:
            store.write(rows, batch=(name, n))
            store.flush_if_large(flush_bytes)
        store.compact_due()

    return write


def to_replicas(paths: list[str], acks: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that ships each batch to every replica's folder, each batch once.

    A replica that takes the batch acknowledges it; one that fails doesn't stop
    the others. A batch is replicated if a replica acknowledged it or there is
    none; else it fails, and comes again. ``acks`` names a folder for one row
    ``batch, peer, ack`` of each replica. ``catch_up`` brings failed ones what
    they lack.
    """

    def ship(batch: DataFrame, n: int) -> None:
        batch.persist()
        took, errors = [], []
        for p in paths:
            try:
                batch.write.mode("overwrite").parquet(f"{p}/batch={n}")
                took.append((n, p, True))
            except Exception as e:  # noqa: BLE001 - whatever ails a replica, the others go on
                took.append((n, p, False))
                errors.append(e)
        batch.unpersist()
        if acks is not None:
            batch.sparkSession.createDataFrame(took, "batch long, peer string, ack boolean").coalesce(1).write.mode("overwrite").parquet(f"{acks}/of={n}")
        if paths and not any(ack for *_, ack in took):
            raise errors[0]

    return ship


def catch_up(spark: SparkSession, acks: str) -> int:
    """Copy to each replica the batches it failed to take, from one that took them; returns how many were copied."""
    said = spark.read.schema("batch long, peer string, ack boolean").parquet(acks).collect()  # one row a batch and replica
    took = {r.batch: r.peer for r in said if r.ack}
    lacking = [r for r in said if not r.ack and r.batch in took]
    for r in lacking:
        spark.read.parquet(f"{took[r.batch]}/batch={r.batch}").write.mode("overwrite").parquet(f"{r.peer}/batch={r.batch}")
    for n in {r.batch for r in lacking}:
        rows = [(n, r.peer, True) for r in said if r.batch == n]
        spark.createDataFrame(rows, "batch long, peer string, ack boolean").coalesce(1).write.mode("overwrite").parquet(f"{acks}/of={n}")
    return len(lacking)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all there is and stop; a later call goes on from ``checkpoint``."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
