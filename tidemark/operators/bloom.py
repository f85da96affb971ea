"""Bloom filters over key columns: built by one aggregation, probed in Arrow batches.

A filter is a table ``word, bits`` of 64-bit words; words without bits are left
out. Places come from double hashing, ``h1 + i * h2`` modulo the number of bits.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 0.01
MAX_BITS = 1 << 30  # 128 MB, what may be sent to every task


def sized(n: int, rate: float = RATE) -> tuple[int, int]:
    """Bits and hash functions for ``n`` keys: floor(-n ln p / ln(2)^2), and floor(m / n ln 2), at least 1 each."""
    m = max(1, int(-n * math.log(rate) / math.log(2) ** 2))
    return m, max(1, int(m / max(1, n) * math.log(2)))


def _hashes(key: Column) -> tuple[Column, Column]:
    low = F.lit((1 << 31) - 1).cast("long")  # no product overflows
    return F.xxhash64(key).bitwiseAND(low), F.xxhash64(F.concat(key, F.lit("salt"))).bitwiseAND(low)


def build(keys: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The filter of the non-NULL values of ``column``; bits are joined before the shuffle."""
    h1, h2 = _hashes(F.col(column))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(m).cast("long")))
    bits = keys.where(F.col(column).isNotNull()).select(F.explode(places).alias("at"))
    return bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))


def probe(rows: DataFrame, column: str, bloom: DataFrame, m: int, k: int, name: str = "maybe") -> DataFrame:
    """``rows`` with ``name``: false only if the value is not among the keys; NULL gives false.

    The words go to every task up to ``MAX_BITS``; those of larger filters are
    joined with the places of the values, each different value once.
    """
    if m > MAX_BITS:
        return _joined_probe(rows, column, bloom, m, k, name)
    sent = rows.sparkSession.sparkContext.broadcast(_words(bloom, m))
    h1, h2 = _hashes(F.col(column))
    hashed = rows.withColumns({"_h1": h1, "_h2": h2, "_there": F.col(column).isNotNull()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            a, c = (b.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("_h1", "_h2"))
            hit = b.column("_there").to_numpy(zero_copy_only=False).copy()
            with np.errstate(over="ignore"):
                for i in range(k):
                    at = (a + np.int64(i) * c) % m
                    hit &= (held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            kept = b.drop_columns(["_h1", "_h2", "_there"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hit)], names=[*kept.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return hashed.mapInArrow(run, f"{fields}, `{name}` boolean")


def _words(bloom: DataFrame, m: int) -> np.ndarray:
    """All words of a filter of at most ``MAX_BITS``."""
    words = np.zeros((m + 63) // 64, np.uint64)
    for r in bloom.toLocalIterator():  # at most m / 64 rows
        words[r.word] = r.bits & 0xFFFFFFFFFFFFFFFF
    return words


def dump(bloom: DataFrame, m: int, k: int) -> bytes:
    """A filter as bytes: bits, hash functions, length, and the bits, lowest first. Larger ones than ``MAX_BITS`` stay tables."""
    if m > MAX_BITS:
        raise ValueError("write a filter of this size as the table it is")
    bits = _words(bloom, m).astype("<u8").tobytes()
    return struct.pack("<QQQ", m, k, len(bits)) + bits


def load(spark: SparkSession, data: bytes) -> tuple[DataFrame, int, int]:
    """The filter, ``m`` and ``k`` of ``dump``."""
    m, k, n = struct.unpack_from("<QQQ", data)
    words = np.frombuffer(data, "<i8", n // 8, 24)
    at = np.flatnonzero(words)
    return spark.createDataFrame(list(zip(at.tolist(), words[at].tolist())), "word long, bits long"), m, k


def _joined_probe(rows: DataFrame, column: str, bloom: DataFrame, m: int, k: int, name: str) -> DataFrame:
    h1, h2 = _hashes(F.col(column))
    hashed = rows.withColumns({"_h1": h1, "_h2": h2})
    values = hashed.where(F.col(column).isNotNull()).select("_h1", "_h2").distinct()
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.col("_h1") + i * F.col("_h2"), F.lit(m).cast("long"))))
    bits = values.select("_h1", "_h2", at.alias("_at")).withColumn("word", F.shiftright("_at", 6)).join(bloom, "word", "left")
    there = F.call_function("shiftrightunsigned", F.col("bits"), F.col("_at").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    answers = bits.groupBy("_h1", "_h2").agg(F.bool_and(F.coalesce(there, F.lit(False))).alias("_all"))
    return hashed.join(answers, ["_h1", "_h2"], "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_all", F.lit(False)).alias(name))


def measure(keys: DataFrame, others: DataFrame, column: str, rate: float = RATE) -> DataFrame:
    """One row ``n_keys, n_bits, missed, false_positives, n_others``: missed is always 0."""
    distinct, rest = keys.select(column).where(F.col(column).isNotNull()).distinct(), others.select(column).where(F.col(column).isNotNull()).distinct()
    rest = rest.join(distinct, column, "left_anti")
    n = distinct.count()
    m, k = sized(n, rate)
    bloom = build(distinct, column, m, k)
    both = distinct.withColumn("key_in", F.lit(True)).unionByName(rest.withColumn("key_in", F.lit(False)))
    judged = probe(both, column, bloom, m, k)
    return judged.agg(F.count_if("key_in").alias("n_keys"), F.lit(m).cast("long").alias("n_bits"), F.count_if(F.col("key_in") & ~F.col("maybe")).alias("missed"), F.count_if(~F.col("key_in") & F.col("maybe")).alias("false_positives"), F.count_if(~F.col("key_in")).alias("n_others"))
