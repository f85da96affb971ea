"""Last writer wins: snapshots, lookups and listings over an op-log ``(key, value, seq, op)``.

Keys are ordered by their bytes; ``''`` is a key and a value like any other,
and NULL is one more key. Of rows with equal ``seq`` for a key, the greatest
``(op, value)`` wins, so repeated rows change nothing. Any ``op`` but PUT
removes. Empty logs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = "op = 'PUT'"
TOMBSTONE = "<TOMBSTONE>"
#: Rows of a key are put in order in blocks of this many sequence numbers, so a hot key is spread.
BLOCK_BITS = 16


def latest(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The row of the greatest ``order`` for each of ``keys``.

    Rows of a key are reduced to one before the shuffle (a window's group limit),
    so a hot key costs a row a task. Texts can't be kept in a hash table of an
    aggregation, so rows are sorted in any case; this sorts them once on either
    side of the shuffle. ``order`` should be total; ties are decided by ``payload``.
    """
    columns = list(dict.fromkeys([*order, *payload]))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in columns]))
    return rows.select(*keys, *[c for c in columns if c not in keys], place.alias("_place")).where("_place = 1").select(*keys, *[c for c in columns if c not in keys])


def lww(oplog: DataFrame) -> DataFrame:
    """``key, value, seq, op``: the last operation of each key, removals too."""
    return latest(oplog, ["key"], ["seq", "op", "value"], ["value"]).select("key", "value", "seq", "op")


def snapshot(oplog: DataFrame) -> DataFrame:
    """``key, value, seq`` of the live keys. The test for removals comes after the reduction, never before."""
    return lww(oplog).where(LIVE).drop("op")


def tombstones(oplog: DataFrame) -> DataFrame:
    """``key, seq`` of the keys whose last operation removed them."""
    return lww(oplog).where("op IS NULL OR op <> 'PUT'").select("key", "seq")


def point_get(oplog: DataFrame, key: str) -> DataFrame:
    """The live row of ``key``, or none. The key filter reaches the scan, as it goes by the grouping key."""
    return snapshot(oplog.where(F.col("key") == key))


def multi_get(oplog: DataFrame, keys: DataFrame) -> DataFrame:
    """The live rows of many keys (column ``key``), each once."""
    return snapshot(oplog.join(keys.select("key").distinct(), "key", "left_semi"))


def range_scan(oplog: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Live rows with ``low <= key <= high``; a missing bound is open."""
    if low is not None:
        oplog = oplog.where(F.col("key") >= low)
    if high is not None:
        oplog = oplog.where(F.col("key") <= high)
    return snapshot(oplog)


def prefix_scan(oplog: DataFrame, prefix: str) -> DataFrame:
    """Live rows whose key starts with ``prefix``."""
    return snapshot(oplog.where(F.col("key").startswith(prefix)))


def as_of(oplog: DataFrame, seq: int) -> DataFrame:
    """The snapshot as it was after operation ``seq``."""
    return snapshot(oplog.where(F.col("seq") <= seq))


def previous(rows: DataFrame, keys: list[str], order: str, what: Column, name: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with ``name``: ``what`` of the row before, by ``order``, of the same ``keys``; NULL for the first.

    Rows are ordered within blocks of ``order``; only one row per block is
    ordered over a whole key. ``order`` is an integer column, unique per key.
    """
    rows = rows.withColumns({"_block": F.shiftright(order, block_bits), "_what": F.struct(what.alias("x"))})
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    outer = Window.partitionBy(*keys).orderBy("_block")
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_what", order).alias("_end")).withColumn("_before", F.lag("_end").over(outer)).drop("_end")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*keys, "_block")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = rows.withColumn("_in", F.lag("_what").over(inner)).alias("r").join(ends.alias("e"), condition)
    own = [F.col(f"r.{c}") for c in rows.columns if c not in ("_block", "_what")]
    return joined.select(*own, F.coalesce("r._in", "e._before").getField("x").alias(name))


def removal_results(oplog: DataFrame) -> DataFrame:
    """``key, seq, existed`` of every removal: whether the key was live before it. Repeated rows count once."""
    rows = oplog.where("seq IS NOT NULL").groupBy("key", "seq").agg(F.max("op").alias("op"))
    return previous(rows, ["key"], "seq", F.col("op"), "was").where("op = 'DELETE'").select("key", "seq", F.coalesce(F.col("was") == "PUT", F.lit(False)).alias("existed"))


def listing(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """``source, key, value, seq`` of every stored row of each source, unmerged; removals show as such."""
    shown = F.when(F.col("op") == "PUT", F.col("value")).otherwise(TOMBSTONE)
    parts = [df.select(F.lit(name).alias("source") if name is not None else "source", "key", shown.alias("value"), "seq") for name, df in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Sorted runs merged to one: their union, reduced to the last operation of each key."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return lww(out)
