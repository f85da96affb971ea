"""The state of a change feed below one folder, brought up to date by increments.

The state is a signed multiset of images, in parts. Each increment adds one
part: for every key whose last entry it changes, minus one copy of the image
before and plus one copy of the image after. The sum over all parts is the
state; images of positive multiplicity stay, and those of puts are the live
rows. To place repeated, late and replaced entries exactly, the entries in
force are kept too, in parts and in buckets of blocks of log positions, of which
an increment reads those it meets. Images, entries and the name of the batch
are published together by one commit file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changefeed import BLOCK_BITS, entries_in_force
from tidemark.scratch import cut
from tidemark.sources.commitlog import CommitLog

#: Entries of a bucket, in the first increment.
ENTRIES_PER_BUCKET = 4_000_000
ENTRIES = "store_id int, index long, term long, key string, value string, seq long, put boolean, replaced boolean, old_key string, bucket int"
IMAGE = ["store_id", "key", "index", "term", "put", "value"]
IMAGES = "store_id int, key string, index long, term long, put boolean, value string, copies long"
LOWEST = -(1 << 63)


def _rank(term: Column) -> Column:
    return F.coalesce(term, F.lit(LOWEST))


def _same_key(a: str, b: str) -> Column:
    """Whether rows aliased ``a`` and ``b`` are of one key; NULL is a key."""
    return (F.col(f"{a}.store_id") == F.col(f"{b}.store_id")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))


def _last(rows: DataFrame) -> DataFrame:
    """The image of the highest index of each key."""
    image = F.struct("index", _rank(F.col("term")).alias("rank"), "term", "put", "value")
    return rows.groupBy("store_id", "key").agg(F.max(image).alias("i")).select("store_id", "key", "i.index", "i.term", "i.put", "i.value")


class FeedStore:
    """Entries in force and images of a feed (``store_id, term, index, op, key, value, seq``) at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _state(self) -> dict:
        return self.log.latest()[1] or {"parts": [], "settled": None, "buckets": None, "batches": {}}

    def _table(self, parts: list[str], name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}/{name}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def _entries(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(ENTRIES).option("basePath", f"{self.path}/entries").parquet(*[f"{self.path}/entries/part={p}" for p in parts]).drop("part")

    def _sum(self, images: DataFrame) -> DataFrame:
        return images.groupBy(*IMAGE).agg(F.sum("copies").alias("copies")).where("copies > 0").select(*IMAGE)

    def last_entries(self) -> DataFrame:
        """``store_id, key, index, term, put, value``: the last entry in force of every key, removals too."""
        return self._sum(self._table(self._state()["parts"], "images", IMAGES))

    def live(self) -> DataFrame:
        """``store_id, key, index, value`` of the live keys after all increments."""
        return self.last_entries().where("put").select("store_id", "key", "index", "value")

    def apply(self, feed: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Take in some rows of the feed, in any order, repeated or not.

        The state afterwards is that of all rows so far together (see
        ``changefeed.live_rows`` for what counts), however they were split. Rows
        at or below a store's settled position are repeats. ``batch`` names a
        stream and its batch; one that was committed before is left out.
        """
        state, n = self._state(), self.log.latest()[0]
        if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
            return
        part = f"part-{uuid.uuid4().hex}"
        buckets = state["buckets"] or max(1, feed.count() // ENTRIES_PER_BUCKET)
        changed = self._changed(feed, state, buckets)
        (changed.repartition("bucket") if buckets > 1 else changed).write.partitionBy("bucket").parquet(f"{self.path}/entries/part={part}")
        self._images(state, part).write.parquet(f"{self.path}/{part}/images")
        batches = {**state["batches"], **({batch[0]: batch[1]} if batch else {})}
        self.log.publish(n + 1, {**state, "parts": [*state["parts"], part], "buckets": buckets, "batches": batches})

    def _changed(self, feed: DataFrame, state: dict, buckets: int) -> DataFrame:
        """The entries of ``feed`` that come into force, with the key of the entry each replaces."""
        place = F.pmod(F.xxhash64("store_id", F.shiftright("index", BLOCK_BITS)), F.lit(buckets)).cast("int")
        fresh = entries_in_force(feed).withColumns({"store_id": F.col("store_id").cast("int"), "bucket": place})
        none = {"replaced": F.lit(False), "old_key": F.lit(None).cast("string")}
        if not state["parts"]:
            return fresh.withColumns(none)
        if state["settled"]:
            settled = self._table([state["settled"]], "settled", "store_id int, upto long")
            fresh = fresh.join(settled, "store_id", "left").where("upto IS NULL OR index > upto").drop("upto")
        fresh, held = cut(fresh), self._entries(state["parts"])
        if buckets > 1:
            held = held.where(F.col("bucket").isin([r.bucket for r in fresh.select("bucket").distinct().collect()]))  # at most all buckets
        at = ["bucket", "store_id", "index"]
        old = held.join(fresh.select(*at), at, "left_semi").groupBy(*at).agg(F.max(F.struct(_rank(F.col("term")).alias("rank"), "key")).alias("old"))
        rows = fresh.join(old, at, "left").where(F.col("old").isNull() | (F.col("old.rank") < _rank(F.col("term"))))
        return rows.withColumns({"replaced": F.col("old").isNotNull(), "old_key": F.col("old.key")}).drop("old")

    def _images(self, state: dict, part: str) -> DataFrame:
        """The increment's signed images: of each key it touches, the last entry before and after, where they differ."""
        changed = self._entries([part])
        news = _last(changed.select(*IMAGE))
        if not state["parts"]:
            return news.withColumn("copies", F.lit(1).cast("long")).select(*IMAGE, "copies")
        taken = changed.where("replaced").select("store_id", F.col("old_key").alias("key"), "index", F.col("key").alias("new_key"))
        touched = changed.select("store_id", "key").unionByName(taken.select("store_id", "key")).distinct()
        before = cut(self._sum(self._table(state["parts"], "images", IMAGES).alias("i").join(touched.alias("t"), _same_key("i", "t"), "left_semi")))
        gone = before.alias("b").join(taken.alias("t"), _same_key("b", "t") & (F.col("b.index") == F.col("t.index")))
        gone = cut(gone.select("b.store_id", "b.key", "b.index", (~F.col("t.new_key").eqNullSafe(F.col("b.key"))).alias("lost")))
        kept = before.alias("b").join(gone.alias("g"), _same_key("b", "g"), "left_anti").select(*IMAGE)
        after = news.select(*IMAGE).unionByName(kept)
        lost = gone.where("lost").select("store_id", "key")
        if not lost.isEmpty():
            # Another key took the place of a key's last entry: the one before it comes back.
            everything = self._entries([*state["parts"], part])
            own = everything.alias("e").join(lost.alias("l"), _same_key("e", "l"), "left_semi").select("store_id", "index").distinct()
            force = everything.join(own, ["store_id", "index"], "left_semi").groupBy("store_id", "index").agg(F.max(F.struct(_rank(F.col("term")).alias("rank"), "term", "key", "put", "value")).alias("e"))
            force = force.select("store_id", "e.key", "index", "e.term", "e.put", "e.value")
            after = after.unionByName(force.alias("e").join(lost.alias("l"), _same_key("e", "l"), "left_semi").select(*IMAGE))
        signed = before.select(*IMAGE, F.lit(-1).cast("long").alias("copies")).unionByName(_last(after).select(*IMAGE, F.lit(1).cast("long").alias("copies")))
        return signed.groupBy(*IMAGE).agg(F.sum("copies").alias("copies")).where("copies <> 0")

    def compact(self, settled: DataFrame | None = None) -> None:
        """Join all parts to one.

        ``settled`` (``store_id, upto``), if given, names positions up to which
        every entry has come and none is replaced any more, as a log's commit
        index does: of the entries up to there only the last one of each key is
        kept, and rows of the feed up to there are repeats from now on.
        """
        state, n, part = self._state(), self.log.latest()[0], f"part-{uuid.uuid4().hex}"
        if not state["parts"]:
            return
        entries = self._entries(state["parts"])
        image = F.struct(_rank(F.col("term")).alias("rank"), "term", "key", "value", "seq", "put")
        entries = entries.groupBy("bucket", "store_id", "index").agg(F.max(image).alias("e")).select("store_id", "index", "e.term", "e.key", "e.value", "e.seq", "e.put", F.lit(False).alias("replaced"), F.lit(None).cast("string").alias("old_key"), "bucket")
        name = state["settled"]
        if settled is not None:
            rows = settled.select(F.col("store_id").cast("int").alias("store_id"), F.col("upto").cast("long").alias("upto"))
            if name:
                rows = rows.unionByName(self._table([name], "settled", "store_id int, upto long"))
            rows.where("store_id IS NOT NULL").groupBy("store_id").agg(F.max("upto").alias("upto")).write.parquet(f"{self.path}/{part}/settled")
            name = part
        if name:
            marked = entries.join(self._table([name], "settled", "store_id int, upto long"), "store_id", "left").withColumn("final", F.coalesce(F.col("index") <= F.col("upto"), F.lit(False))).drop("upto")
            last = marked.where("final").groupBy("store_id", "key").agg(F.max("index").alias("last"))
            last = last.select(F.col("store_id").alias("s"), F.col("last"))
            entries = marked.join(last, (F.col("store_id") == F.col("s")) & (F.col("index") == F.col("last")), "left").where("NOT final OR last IS NOT NULL").drop("s", "last", "final")
        (entries.repartition("bucket") if (state["buckets"] or 1) > 1 else entries).write.partitionBy("bucket").parquet(f"{self.path}/entries/part={part}")
        self.last_entries().withColumn("copies", F.lit(1).cast("long")).write.parquet(f"{self.path}/{part}/images")
        self.log.publish(n + 1, {**state, "parts": [part], "settled": name})

    def vacuum(self) -> list[str]:
        """Delete the folders the last commit doesn't name; returns their names. Not while an increment is under way."""
        state = self._state()
        named = {*state["parts"], state["settled"]}
        made = {f.removeprefix("part=") for where in (self.path, f"{self.path}/entries") for f in self.log.folders(where)}
        gone = sorted(f for f in made - named if f.startswith("part-"))
        for f in gone:
            self.log.delete(f"{self.path}/{f}")
            self.log.delete(f"{self.path}/entries/part={f}")
        self.log.trim(1)
        return gone
