"""Was this key seen before? Exact verdicts out of a streaming state store.

Keys are spread over buckets. The state of a bucket holds its keys, each with the
lowest arrival id that showed it; it lies in RocksDB on disk, is checkpointed to
the shared folder and has no watermark, so a key is never forgotten. Every
arriving row leaves the state with its verdict in the batch it came with. A
bucket holds some ``KEYS_PER_BUCKET`` keys, so a task has one bucket's keys in
memory at a time, and a batch rewrites only the buckets it meets.

Rows of a key are reduced to the lowest id in the input's Arrow batches, before
the shuffle: all others are repeats whatever the state says, and are spread by
their own ids, so a hot key has no task of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.scratch import scratch_path
from tidemark.sources.commitlog import CommitLog

STORED = -1  # arrival of keys that were there before the stream
KEYS_PER_BUCKET = 1024
KEYED, REPEAT, NO_KEY = 0, 1, 2  # what a row is before it meets the state
VERDICTS = ("first", "repeat", "no key")
ROWS = "bucket long, kind int, name binary, arrival long"
OUT = "arrival long, verdict string, late boolean"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def pack(firsts: dict[bytes, int]) -> bytes:
    """Keys and their lowest arrivals as one value: number, arrivals, key ends, keys."""
    ends = np.cumsum([len(k) for k in firsts], dtype=np.int64)
    return np.int64(len(firsts)).tobytes() + np.fromiter(firsts.values(), np.int64, len(firsts)).tobytes() + ends.tobytes() + b"".join(firsts)


def unpack(data: bytes) -> dict[bytes, int]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    numbers, keys = np.frombuffer(data, np.int64, 2 * n, 8).tolist(), data[8 + 16 * n :]
    begins = [0, *numbers[n:]]
    return {keys[begins[i] : begins[i + 1]]: numbers[i] for i in range(n)}


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a key, all but the lowest are repeats; they go by their ids and without the key."""
    for b in batches:
        t = b.to_pandas()
        t = t.sort_values("arrival", kind="stable")
        again = t["name"].notna() & t.duplicated("name") & (t["arrival"] > STORED)
        t.loc[again, "kind"] = REPEAT
        t.loc[again, "bucket"] = t.loc[again, "spread"]
        t.loc[again, "name"] = None
        yield pa.RecordBatch.from_pandas(t[["bucket", "kind", "name", "arrival"]], schema=pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("name", pa.binary()), ("arrival", pa.int64())]), preserve_index=False)


def _judge(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Verdicts of a bucket's rows in the order of their ids; ``late`` marks one that takes back an earlier ``first``."""
    frame = pd.concat(frames)
    keyed = frame[frame["kind"] == KEYED].sort_values("arrival", kind="stable")
    rest = frame[frame["kind"] != KEYED]
    firsts = unpack(bytes(state.get[0])) if state.exists else {}
    ids, said, late = rest["arrival"].tolist(), [VERDICTS[k] for k in rest["kind"]], [False] * len(rest)
    changed = False
    for name, arrival in zip(keyed["name"], keyed["arrival"].tolist()):
        name = bytes(name)
        first = firsts.get(name)
        if first is None or arrival < first:
            firsts[name], changed = arrival, True
            if first is not None and first > STORED:
                ids.append(first), said.append("repeat"), late.append(True)
        if arrival > STORED:
            ids.append(arrival), said.append("first" if firsts[name] == arrival else "repeat"), late.append(False)
    if changed:
        state.update((pack(firsts),))
    yield pd.DataFrame({"arrival": pd.Series(ids, dtype="int64"), "verdict": pd.Series(said, dtype="str"), "late": pd.Series(late, dtype="bool")})


def _plain(path: str) -> str:
    """``path`` with the signs of patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


class SeenKeys:
    """A run of the state over Parquet folders: ``path`` keeps checkpoint and verdicts.

    Calling ``advance`` again with the same ``path`` goes on from the last
    checkpoint and reads only files that are new. Arrival ids must be unique and
    at least 0; rows without an id are left out. A row whose key is NULL is
    never a repeat and is not kept; a NULL store is a store of its own.

    ``expected`` keys give the number of buckets, fixed with the first run (by
    default the rows of the tables then); more keys than that are right but make
    longer buckets. ``partitions`` is the number of state partitions, fixed too.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int | None = None, partitions: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._expected, self._partitions = expected, partitions
        self._layout = CommitLog(spark, f"{self.path}/layout")

    def _fixed(self, folders: list[str]) -> dict[str, int]:
        """Buckets and partitions of this state; decided once, by the first run."""
        _, layout = self._layout.latest()
        if layout is None:
            expected = self._expected or sum(self.spark.read.parquet(f).count() for f in folders)
            layout = {"buckets": expected // KEYS_PER_BUCKET + 1, "partitions": self._partitions or self.spark.sparkContext.defaultParallelism}
            self._layout.publish(1, layout)
        return layout

    def _stream(self, session: SparkSession, folder: str, arrival: F.Column, files: int | None, buckets: int) -> DataFrame:
        reader = session.readStream.schema(session.read.parquet(folder).schema)
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        if self._layout.is_file(folder):  # a stream reads folders: of this one, only the file
            parent, _, name = folder.rpartition("/")
            rows = reader.option("pathGlobFilter", _plain(name)).parquet(_plain(parent))
        else:
            rows = reader.parquet(_plain(folder))
        store = F.coalesce(F.col("store_id").cast("string"), F.lit(""))
        spread = F.pmod(F.xxhash64(arrival), F.lit(buckets))
        keyed = F.col("key").isNotNull()
        name = F.when(keyed, F.concat(store.cast("binary"), F.lit("/").cast("binary"), F.col("key").cast("binary")))
        rows = rows.select(F.when(keyed, F.pmod(F.xxhash64("store_id", "key"), F.lit(buckets))).otherwise(spread).alias("bucket"), F.when(keyed, KEYED).otherwise(NO_KEY).alias("kind"), name.alias("name"), arrival.alias("arrival"), spread.alias("spread"))
        return rows.where("arrival IS NOT NULL").mapInArrow(_reduce, ROWS)

    def advance(self, arriving: str, stored: tuple[str, ...] = (), id_column: str = "op_id", files_per_batch: int | None = None) -> None:
        """Take in all rows of ``arriving``, ``files_per_batch`` files at a time, and the keys of the ``stored`` tables."""
        layout = self._fixed([arriving, *stored])
        session = self.spark.newSession()  # settings of the state are not those of the caller's session
        for k, v in {**STATE, "spark.sql.shuffle.partitions": str(layout["partitions"])}.items():
            session.conf.set(k, v)
        rows = self._stream(session, arriving, F.col(id_column).cast("long"), files_per_batch, layout["buckets"])
        for folder in stored:
            rows = rows.unionByName(self._stream(session, folder, F.lit(STORED).cast("long"), None, layout["buckets"]).where("name IS NOT NULL"))
        judged = rows.groupBy("bucket").applyInPandasWithState(_judge, OUT, "keys binary", "append", GroupStateTimeout.NoTimeout)

        def keep(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/verdicts/batch={n}")

        query = judged.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def verdicts(self, id_column: str = "op_id") -> DataFrame:
        """``id_column, verdict`` of each row so far: ``first``, ``repeat``, or ``no key``.

        Rows come as the state gave them. Only where a later batch brought a
        lower id of a key is the ``first`` of an earlier batch taken back.
        """
        rows = self.spark.read.schema("arrival long, verdict string, batch long, late boolean").parquet(f"{self.path}/verdicts")
        taken = rows.where("late").select("arrival", F.lit("repeat").alias("taken"))
        rows = rows.where("NOT late").select("arrival", "verdict")
        if not taken.isEmpty():
            rows = rows.join(taken, "arrival", "left").select("arrival", F.coalesce("taken", "verdict").alias("verdict"))
        return rows.withColumnRenamed("arrival", id_column)

    def repeats(self, id_column: str = "op_id") -> DataFrame:
        """``id_column`` of the rows whose key was there already."""
        return self.verdicts(id_column).where("verdict = 'repeat'").select(id_column)


#: Files of arrivals that the queries take in at a time, at least, and batches they make of many files.
FILES_PER_BATCH, BATCHES = 8, 8


def over_folder(spark: SparkSession, folder: str) -> SeenKeys:
    """The state after all of ``incoming_ops``, in several batches, on top of ``leader_sst`` and ``sst_index``."""
    seen = SeenKeys(spark, scratch_path(spark, "seen"))
    files_per_batch = max(FILES_PER_BATCH, -(-len(spark.read.parquet(f"{folder}/incoming_ops.parquet").inputFiles()) // BATCHES))
    seen.advance(f"{folder}/incoming_ops.parquet", (f"{folder}/leader_sst.parquet", f"{folder}/sst_index.parquet"), files_per_batch=files_per_batch)
    return seen


def exact_repeats(arriving: DataFrame, stored: DataFrame, id_column: str = "op_id") -> DataFrame:
    """The same answer by one batch aggregation over all keys, to measure wrong answers against."""
    arriving = arriving.where(F.col(id_column).isNotNull())
    rows = arriving.select("store_id", "key", F.col(id_column).alias("arrival")).unionByName(stored.select("store_id", "key", F.lit(STORED).cast("long").alias("arrival")))
    first = rows.where("key IS NOT NULL").groupBy("store_id", "key").agg(F.min("arrival").alias(id_column)).select(id_column)
    return arriving.where("key IS NOT NULL").select(id_column).join(first, id_column, "left_anti")


def error_rate(arriving: DataFrame, said: DataFrame, exact: DataFrame, id_column: str = "op_id") -> DataFrame:
    """One row: ``n_rows, n_repeats, n_wrong, wrong_rate`` of the verdicts ``said``."""
    truth = exact.select(id_column, F.lit(True).alias("truth"))
    rows = arriving.where(F.col("key").isNotNull() & F.col(id_column).isNotNull()).select(id_column).join(said.select(id_column, "verdict"), id_column, "left").join(truth, id_column, "left")
    wrong = F.coalesce("truth", F.lit(False)) != F.coalesce(F.col("verdict") == "repeat", F.lit(False))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("truth").alias("n_repeats"), F.count_if(wrong).alias("n_wrong")).withColumn("wrong_rate", F.when(F.col("n_rows") > 0, F.col("n_wrong") / F.col("n_rows")))
