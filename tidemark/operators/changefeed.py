"""Current state from a feed of inserts, updates and deletes.

The feed is read as a signed multiset of images. Every change in force puts one
copy of its after-image (none for a removal) and takes one copy of its
before-image, the after-image of the change before it on the same key. The sum
over base and changes is the state: rows of positive multiplicity stay. Sums
don't depend on the order or number of deliveries, once repeated changes have
been dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Changes of one key are ordered in blocks of this many log positions, so a hot key is spread over many tasks.
BLOCK_BITS = 16
PUTS = ("PUT", "SET")


def entries_in_force(feed: DataFrame) -> DataFrame:
    """One row per ``(store_id, index)``: the entry of the highest term.

    Returns ``store_id, index, term, key, value, seq, put``. ``op`` is read in
    any case and without outer blanks: PUT and SET put, all else (NULL too)
    removes. Rows without store or index name no entry. A NULL term is the
    lowest. If copies of one entry differ against the rules of the log, a copy
    that puts, then the greatest value, wins. A removal's value comes out NULL.
    """
    put = F.coalesce(F.upper(F.btrim("op")).isin(*PUTS), F.lit(False))
    image = F.struct("term", put.alias("put"), F.when(put, F.col("value")).alias("value"), "key", "seq")
    return (
        feed.where("store_id IS NOT NULL AND index IS NOT NULL")
        .groupBy("store_id", "index")
        .agg(F.max(image).alias("e"))
        .select("store_id", "index", "e.term", "e.key", "e.value", "e.seq", "e.put")
    )


def _on_base(feed: DataFrame, base: DataFrame | None) -> DataFrame:
    """``feed`` with the entries of ``base``; raises for changes whose effect the base can't tell.

    A base has the last entry of every key, ``store_id, term, index, op, key,
    value, seq``; without ``op`` it says that no key was ever removed. A change
    up to the base's last index is placed if the base has a later entry of its
    key, or the entry itself, or that entry in another term for the same key.
    Two kinds can't be placed: one of a higher term that takes a key's last entry
    away (the key's value before it isn't kept), and one at an index the base
    doesn't have that would be its key's last (it may be late, or replaced by a
    higher term that isn't kept). For these the feed must be read whole.
    """
    columns = ["store_id", "term", "index", "op", "key", "value", "seq"]
    if base is None:
        return feed.select(*columns)
    kept = (base if "op" in base.columns else base.withColumn("op", F.lit("PUT"))).select(*columns)
    rank = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    top = kept.groupBy("store_id").agg(F.max("index").alias("top"))
    held = kept.select("store_id", "index", F.lit(True).alias("held"), F.col("term").alias("held_term"), F.col("key").alias("held_key"))
    last = kept.groupBy(F.col("store_id").alias("last_store"), F.col("key").alias("last_key")).agg(F.max("index").alias("last"))
    own = (F.col("store_id") == F.col("last_store")) & F.col("key").eqNullSafe(F.col("last_key"))
    late = entries_in_force(feed).join(top, "store_id").where("index <= top").join(held, ["store_id", "index"], "left").join(last, own, "left")
    taken = (rank("held_term") < rank("term")) & ~F.col("key").eqNullSafe(F.col("held_key"))
    unplaced = late.where(F.when(F.col("held"), taken).otherwise(~F.coalesce(F.col("last") > F.col("index"), F.lit(False))))
    if (r := unplaced.select("store_id", "index", "term").first()) is not None:
        raise ValueError(f"the base can't place entry {r['index']} of store {r.store_id}, term {r.term}; read the feed whole")
    return feed.select(*columns).unionByName(kept)


def last_entries(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The base for later changes: the last entry in force of every key, removals included.

    Returns ``store_id, term, index, op, key, value, seq``, with ``op`` PUT or DELETE.
    """
    image = F.struct("index", "term", F.when(F.col("put"), "PUT").otherwise("DELETE").alias("op"), "value", "seq")
    last = entries_in_force(_on_base(feed, base)).groupBy("store_id", "key").agg(F.max(image).alias("e"))
    return last.select("store_id", "e.term", "e.index", "e.op", "key", "e.value", "e.seq")


def live_rows(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The live keys after ``feed``: ``store_id, key, index, value``.

    ``feed`` has ``store_id, term, index, op, key, value, seq``. ``base``, if
    given, is an earlier state as ``last_entries`` gives it. NULL is a key like
    any other.
    """
    feed = _on_base(feed, base)
    block = F.shiftright("index", BLOCK_BITS)
    entries = entries_in_force(feed).select("store_id", "key", block.alias("block"), "index", "put", "value")
    order = Window.partitionBy("store_id", "key", "block").orderBy("index")
    after = F.when(F.col("put"), F.col("index"))
    # A removal that ends a block puts a copy of nothing: it tells that the block was there.
    images = F.array(
        F.when(F.col("put") | F.col("ends"), F.struct(after.alias("index"), F.lit(1).alias("copies"), "value")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("index"), F.lit(-1).alias("copies"), F.lit(None).cast("string").alias("value"))),
    )
    inside = (
        entries.withColumns({"before": F.lag(after).over(order), "ends": F.lead("index").over(order).isNull()})
        .select("store_id", "key", "block", F.explode(F.array_compact(images)).alias("i"))
        .groupBy("store_id", "key", "block", "i.index")
        .agg(F.sum("i.copies").alias("copies"), F.max("i.value").alias("value"))
        .where("copies <> 0")
    )
    # The first change of a block takes away what the key's block before it left.
    newest = F.max("block").over(Window.partitionBy("store_id", "key"))
    return (
        inside.withColumn("copies", F.col("copies") - F.when(newest > F.col("block"), 1).otherwise(0))
        .where("index IS NOT NULL AND copies > 0")
        .select("store_id", "key", "index", "value")
    )
