"""Differences between two copies of a table, found from sketches of either side.

Rows are hashed into a field of 2^61 - 1 elements and put into small buckets by
key. A side's sketch of a bucket is its number of rows and the values, at a few
points, of the polynomial whose roots are its row hashes. The quotient of both
sides' values depends on the differing rows only; interpolating it recovers
their hashes (Minsky, Trachtenberg and Zippel, 2003). The bound on differences
doubles for the buckets it was too small for, which two further points verify.
Only the keys recovered are fetched and compared field by field.

A hash has 20 bits of key and 41 bits of row, so that a recovered hash names
the key to fetch. Two different rows of one key are taken for equal with a
probability of 2^-41.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import field
from tidemark.scratch import cut

ROWS_PER_BUCKET = 32
FIRST_BOUND, LAST_BOUND = 4, 64
CHECKS = 2
BUCKETS_PER_TASK = 1 << 15
ROW_BITS = 41
SKETCH = "bucket long, n int, points array<long>"
SKETCH_ARROW = pa.schema([("bucket", pa.int64()), ("n", pa.int32()), ("points", pa.list_(pa.int64()))])
FOUND = "bucket long, hash long"  # a NULL hash: the bound was too small
FOUND_ARROW = pa.schema([("bucket", pa.int64()), ("hash", pa.int64())])
FIELDS = ("value", "seq", "op")


def sample_points(bound: int) -> np.ndarray:
    """Where polynomials are evaluated under this bound; other points for each bound."""
    return np.random.default_rng(bound).integers(1, field.P, bound + CHECKS, dtype=np.uint64)


def hashed(side: DataFrame, bucket_bits: int) -> DataFrame:
    """``side`` with ``bucket`` (of its key) and ``hash`` (of its key and fields)."""
    key = F.xxhash64(F.col("store_id").isNull(), "store_id", F.col("key").isNull(), "key")
    row = F.xxhash64(*[x for c in (*FIELDS, "key", "store_id") for x in (F.col(c), F.col(c).isNull())])
    part = F.shiftleft(F.shiftrightunsigned(key, 44), ROW_BITS)
    return side.withColumns({"bucket": key.bitwiseAND((1 << bucket_bits) - 1), "hash": part + F.pmod(row, F.lit((1 << ROW_BITS) - 1))})


def _evaluate(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = sample_points(bound)
        for b in batches:
            lists = b.column("hashes")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy().astype(np.uint64)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            points = field.products(field.sub(np.broadcast_to(z, (len(values), len(z))), values[:, None]), offsets)
            flat = pa.array(points.ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("bucket"), pa.array(np.diff(offsets).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(z), dtype=np.int32)), flat)], schema=SKETCH_ARROW)

    return run


def _lists(side: DataFrame) -> DataFrame:
    """The set of hashes of each bucket. Copies of a row fall together before the shuffle."""
    return side.groupBy("bucket").agg(F.collect_set("hash").alias("hashes"))


def sketches(lists: DataFrame, bound: int) -> DataFrame:
    """One row per bucket ``(bucket, hashes)``: number of rows, values of its polynomial."""
    return lists.mapInArrow(_evaluate(bound), SKETCH)


def recover(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, z: np.ndarray, least: int = 1) -> tuple[list[list[int]], np.ndarray]:
    """Differing hashes of each bucket, and which buckets were solved.

    ``n``, ``m`` are the numbers of rows on the sides, ``a``, ``b`` the values
    at ``z``. Fewer than ``least`` differences have been ruled out before.
    """
    found: list[list[int]] = [[] for _ in n]
    usable = (a != 0).all(1) & (b != 0).all(1)
    solved = usable & (n == m) & (a == b).all(1)
    f = field.mul(a, field.inverse(b))
    bound = len(z) - CHECKS
    for total in range(least, bound + 1):
        for more in range(-total, total + 1, 2):
            at = np.flatnonzero(usable & ~solved & (n - m == more))
            if not len(at):
                continue
            over, under = (total + more) // 2, (total - more) // 2
            powers = np.stack([field.power(z[:total], i) for i in range(max(over, under) + 1)], 1)
            fa = f[at][:, :total]
            left = np.broadcast_to(powers[None, :, :over], (len(at), total, over))
            right = field.sub(np.zeros(1, np.uint64), field.mul(fa[:, :, None], powers[None, :, :under]))
            target = field.sub(field.mul(fa, powers[None, :, under]), np.broadcast_to(powers[None, :, over], fa.shape))
            x, fine = field.solve(np.concatenate([left, right, target[:, :, None]], 2))
            top, bottom = x[:, :over], x[:, over:]
            fine &= (field.evaluate(top, z) == field.mul(f[at], field.evaluate(bottom, z))).all(1)
            for i in np.flatnonzero(fine):
                r = field.roots([*map(int, top[i]), 1]), field.roots([*map(int, bottom[i]), 1])
                if r[0] is not None and r[1] is not None:
                    found[at[i]] = r[0] + r[1]
                    solved[at[i]] = True
    return found, solved


def _decode(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = sample_points(bound)

        def points(lists: pa.Array) -> np.ndarray:
            return np.array([x if x is not None else [1] * len(z) for x in lists.to_pylist()], np.uint64).reshape(-1, len(z))

        for b in batches:
            n, m = (b.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("n", "m"))
            found, solved = recover(n, m, points(b.column("a")), points(b.column("b")), z, 1 if bound == FIRST_BOUND else bound // 2 + 1)
            bucket = b.column("bucket").to_pylist()
            rows = [(bucket[i], h) for i, hs in enumerate(found) for h in hs] + [(bucket[i], None) for i in np.flatnonzero(~solved)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=FOUND_ARROW)

    return run


def differing_hashes(left: DataFrame, right: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket, hash`` of the rows that only one of two ``hashed`` sides has.

    The bound starts at ``FIRST_BOUND`` and doubles for the buckets not solved.
    A bucket that is empty on one side is its own difference, and one with
    more than ``LAST_BOUND`` differences in ``ROWS_PER_BUCKET`` or so rows saves
    nothing by a sketch: the hashes of these are compared as they are.
    """
    # Each side's hashes by bucket are written once, 8 bytes a row, so later rounds neither scan nor shuffle it again.
    sides = [cut(_lists(s)) for s in (left, right)]
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, n_buckets // BUCKETS_PER_TASK)
    results, bound, open_ = [], FIRST_BOUND, None
    while bound <= LAST_BOUND:
        l, r = (sketches(s if open_ is None else s.join(open_, "bucket", "left_semi"), bound) for s in sides)
        both = l.withColumnRenamed("points", "a").join(r.select("bucket", F.col("n").alias("m"), F.col("points").alias("b")), "bucket", "full")
        apart = F.col("n").isNull() | F.col("m").isNull() | (F.col("n") != F.col("m")) | (F.col("a") != F.col("b"))
        # Little data but much to compute: spread evenly, whatever the partitions' sizes.
        found = cut(both.where(apart).repartition(tasks).mapInArrow(_decode(bound), FOUND))
        results.append(found.where("hash IS NOT NULL"))
        open_ = found.where("hash IS NULL").select("bucket")
        if open_.isEmpty():
            break
        bound *= 2
    else:
        l, r = (s.join(open_, "bucket", "left_semi") for s in sides)
        none = F.array().cast("array<long>")
        a, b = F.coalesce("hashes", none), F.coalesce("other", none)
        listed = l.join(r.withColumnRenamed("hashes", "other"), "bucket", "full")
        results.append(listed.select("bucket", F.explode(F.concat(F.array_except(a, b), F.array_except(b, a))).alias("hash")))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def bucket_bits(rows: int) -> int:
    return min(43, max(4, (max(rows, 1) // ROWS_PER_BUCKET).bit_length()))


def differences(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("leader", "follower")) -> DataFrame:
    """Cases ``store_id, key, field`` between two sides with ``store_id, key, value, seq, op``.

    ``field`` is ``missing_<name>``, or for a key on both sides each of
    ``value``, ``seq``, ``op`` that differs; NULL equals NULL only. A row stored
    more than once counts once. If a side holds different rows of one key, the
    one of the greatest ``(seq, op, value)`` is compared. NULL is a key like
    any other. Other columns are ignored.
    """
    columns = ["store_id", "key", *FIELDS]
    sides = [s.select(*columns) for s in (left, right)]
    bits = bucket_bits(max(s.count() for s in sides))
    sides = [hashed(s, bits) for s in sides]
    place = (F.shiftleft("bucket", 20) + F.shiftright("hash", ROW_BITS)).alias("place")
    places = differing_hashes(*(s.select("bucket", "hash") for s in sides), 1 << bits).select(place).distinct()
    fetched = [s.withColumn("place", place).join(places, "place", "left_semi").select(*columns, F.lit(i).alias("side")) for i, s in enumerate(sides)]
    row = F.struct("seq", "op", "value")
    both = fetched[0].unionByName(fetched[1]).groupBy("store_id", "key").agg(F.max(F.when(F.col("side") == 0, row)).alias("l"), F.max(F.when(F.col("side") == 1, row)).alias("r"))
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    cases = [F.when(F.col("l").isNull(), f"missing_{names[0]}"), F.when(F.col("r").isNull(), f"missing_{names[1]}")]
    cases += [F.when(there & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), c) for c in FIELDS]
    return both.select("store_id", "key", F.explode(F.array_compact(F.array(*cases))).alias("field"))
