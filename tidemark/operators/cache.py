"""What a least-recently-used cache of a given size would hold and hit, from an access trace."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lww import previous
from tidemark.scratch import cut

CAPACITY = 1000
#: Slices a trace is cut into. Their pairwise counts (SLICES squared, 8 MB) go to every task.
SLICES = 1024
LEAST_SLICE = 1 << 14
#: Values that are compared all with all before blocks are merged.
BLOCK = 64


def contents(trace: DataFrame, capacity: int = CAPACITY, key: str = "key", at: str = "seq") -> DataFrame:
    """``key, last_access`` of the ``capacity`` keys accessed last. Each access promotes; ties go by key."""
    last = trace.groupBy(key).agg(F.max(at).alias("last_access"))
    return last.orderBy(F.desc("last_access"), key).limit(capacity)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, how many of the values before it are smaller; merged block by block, without a loop over values."""
    n = len(values)
    size = BLOCK << max(0, (-(-n // BLOCK) - 1).bit_length()) if n else 0
    if not n:
        return np.empty(0, np.int64)
    # Ranks without ties: of equal values the later one is lower, so it doesn't count the earlier one.
    rank = np.arange(size)
    rank[np.lexsort((-np.arange(n), values))] = np.arange(n)
    counts = np.empty(size, np.int64)
    earlier = np.tri(BLOCK, k=-1, dtype=bool)
    for at in range(0, size, BLOCK << 8):
        r = rank[at : at + (BLOCK << 8)].reshape(-1, BLOCK)
        counts[at : at + r.size] = ((r[:, None, :] < r[:, :, None]) & earlier).sum(2).ravel()
    order = rank.reshape(-1, BLOCK).argsort(axis=1)
    place = (order + np.arange(0, size, BLOCK)[:, None]).reshape(-1)
    rank, width = rank[place], BLOCK
    while width < size:
        rows, places = rank.reshape(-1, 2 * width), place.reshape(-1, 2 * width)
        order = rows.argsort(axis=1, kind="stable")
        left = order < width
        places = np.take_along_axis(places, order, 1)
        counts[places[~left]] += left.cumsum(1)[~left]
        rank, place, width = np.take_along_axis(rows, order, 1).reshape(-1), places.reshape(-1), 2 * width
    return counts[:n]


def _ranked(trace: DataFrame) -> tuple[DataFrame, int, int]:
    """``trace`` (``key, t``) with ``rank`` from 0 by ``t``, its number of rows, and the width of a slice of ranks.

    Slices are ranges of ``t`` of about equal numbers of rows, however ``t`` lies.
    """
    slices = max(1, min(SLICES, -(-trace.count() // LEAST_SLICE)))
    rows = cut(trace.repartitionByRange(slices, "t").withColumn("_slice", F.spark_partition_id()))
    counts = sorted((r["_slice"], r["count"]) for r in rows.groupBy("_slice").count().collect())  # SLICES rows at most
    offsets, n = [], 0
    for s, c in counts:
        offsets.append((s, n))
        n += c
    ahead = trace.sparkSession.createDataFrame(offsets, "_slice int, _ahead long")
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy("t")) - 1
    ranked = rows.withColumn("_in", inside).join(F.broadcast(ahead), "_slice").select("key", "t", (F.col("_in") + F.col("_ahead")).alias("rank"))
    return ranked, n, max(LEAST_SLICE, -(-n // SLICES))


def hits(trace: DataFrame, capacity: int = CAPACITY, key: str = "key", at: str = "seq") -> DataFrame:
    """``key, at, distance, hit`` of every access.

    ``distance`` is the number of other keys accessed since the key's last
    access, NULL for its first; an access hits if it is below ``capacity``.
    Every access makes a pair (p, t) of the ranks of the access before it and
    of itself. Of the accesses between p and t, those that repeat a key seen
    since p are the pairs nested in (p, t); all others are different keys. Nested
    pairs are counted whole slices at a time, but for the two slices at the ends
    of a pair, which are counted in tasks of one slice, by merging. ``at`` is an
    integer, unique; rows where it is NULL are left out. NULL is a key.
    """
    rows, n, width = _ranked(trace.select(F.col(key).alias("key"), F.col(at).alias("t")).where("t IS NOT NULL"))
    rows = cut(previous(rows, ["key"], "rank", F.col("rank"), "p"))
    pairs = rows.where("p IS NOT NULL").select("t", "p", "rank", F.floor(F.col("p") / width).alias("ps"), F.floor(F.col("rank") / width).alias("ts"))
    table = np.zeros((SLICES + 1, SLICES + 1), np.int64)
    cells = pairs.groupBy("ps", "ts").count().toArrow()  # SLICES squared rows at most
    table[cells["ps"].to_numpy(), cells["ts"].to_numpy()] = cells["count"].to_numpy()
    # whole[a, b]: pairs that begin in a slice behind a and end in a slice before b.
    behind = np.vstack([table[::-1].cumsum(0)[::-1][1:], np.zeros((1, SLICES + 1), np.int64)])
    whole = np.hstack([np.zeros((SLICES + 1, 1), np.int64), behind.cumsum(1)[:, :-1]])
    sent = trace.sparkSession.sparkContext.broadcast(whole)

    def at_begin(g: pd.DataFrame) -> pd.DataFrame:
        """Pairs that begin in the same slice, behind p, and end before t; and the whole slices."""
        g = g.sort_values("p", ascending=False)
        g["nested"] = smaller_before(g["rank"].to_numpy()) + sent.value[g["ps"].to_numpy(), g["ts"].to_numpy()]
        return g

    def at_end(g: pd.DataFrame) -> pd.DataFrame:
        """Pairs that end in the same slice, before t, and begin in a slice behind p's."""
        g = g.sort_values("rank")
        g["nested"] += smaller_before(-g["ps"].to_numpy())
        return g

    schema = "t long, p long, rank long, ps long, ts long, nested long"
    pairs = pairs.select(*(F.col(c).cast("long").alias(c) for c in ("t", "p", "rank", "ps", "ts")))
    counted = pairs.groupBy("ps").applyInPandas(at_begin, schema).groupBy("ts").applyInPandas(at_end, schema)
    distances = counted.select(F.col("t").alias("_t"), (F.col("rank") - F.col("p") - 1 - F.col("nested")).alias("distance"))
    out = rows.join(distances, F.col("t") == F.col("_t"), "left")
    return out.select(F.col("key").alias(key), F.col("t").alias(at), "distance", F.coalesce(F.col("distance") < capacity, F.lit(False)).alias("hit"))


def replay(trace: DataFrame, capacity: int = CAPACITY, by: str = "cache") -> DataFrame:
    """What a cache answers to ``get``, ``put`` and ``invalidate``: ``by, seq, outcome, evicted``.

    ``trace`` has ``by, seq, op, key``. A get is a ``hit`` and promotes its key,
    or a ``miss`` and changes nothing; a put ``inserts`` or ``updates``, promotes,
    and evicts the key used longest ago once the cache is over ``capacity``;
    invalidate ``removes`` a key that is there (else ``absent``). Other operations
    are ``unknown``. Rows of NULL ``seq`` are left out; NULL is a key and a cache.

    What a cache holds depends on all that came before, so a cache is one task;
    its rows stream through in order and only ``capacity`` keys are kept. Many
    caches run side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        current: object = run  # no cache is this
        for b in batches:
            said, gone = [], []
            for cache, op, key in zip(*(b.column(c).to_pylist() for c in ("cache", "op", "key"))):
                if cache != current:
                    held, current = OrderedDict(), cache
                out = None
                there = key in held
                if op == "get":
                    said.append("hit" if there else "miss")
                    if there:
                        held.move_to_end(key)
                elif op == "put":
                    said.append("updates" if there else "inserts")
                    held[key] = True
                    held.move_to_end(key)
                    if len(held) > capacity:
                        out = held.popitem(last=False)[0]
                elif op == "invalidate":
                    said.append("removes" if there else "absent")
                    held.pop(key, None)
                else:
                    said.append("unknown")
                gone.append(out)
            yield pa.RecordBatch.from_arrays([b.column("cache"), b.column("seq"), pa.array(said, pa.string()), pa.array(gone, pa.string())], names=["cache", "seq", "outcome", "evicted"])

    rows = trace.where("seq IS NOT NULL").select(F.col(by).alias("cache"), F.col("seq").cast("long").alias("seq"), F.lower("op").alias("op"), F.col("key").cast("string").alias("key"))
    kind = rows.schema["cache"].dataType.simpleString()
    out = rows.repartition("cache").sortWithinPartitions("cache", "seq").mapInArrow(run, f"cache {kind}, seq long, outcome string, evicted string")
    return out.withColumnRenamed("cache", by)


def hit_rate(judged: DataFrame) -> DataFrame:
    """One row ``n_accesses, n_hits, hit_rate`` from the result of ``hits``."""
    return judged.agg(F.count("*").alias("n_accesses"), F.count_if("hit").alias("n_hits")).withColumn("hit_rate", F.when(F.col("n_accesses") > 0, F.col("n_hits") / F.col("n_accesses")))
