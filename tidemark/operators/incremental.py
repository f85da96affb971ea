"""Only what was added or replaced since the last good run, with an atomic commit.

A run fixes its upper limit (``feed_pos``) before it reads, takes what arrived
above the last one, writes it to a folder of its own, and then publishes output
and new watermark together by creating one commit file. A run
that dies before that leaves a folder nobody names; the next run starts from
the same watermark, so nothing is skipped and nothing is repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commitlog import CommitLog

LOWEST = -(1 << 62)
#: Stores whose watermarks may be broadcast: some 60 bytes each, so 12 MB.
BROADCAST_STORES = 200_000
BLOCK_BITS = 16
#: Entries of a bucket of the kept state, in the first run.
ENTRIES_PER_BUCKET = 4_000_000
ENTRIES = "store_id int, index long, term long, seq long, placed long, bucket int"


def watermarks(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each follower's watermark: ``store_id, node_id, max_seq, hi_term``.

    It comes from the ``ok`` run with the highest ``run_id``; ``max_seq`` from
    the file that run names. Without an ``ok`` run, and where the file, its row
    or its ``max_seq`` is missing, the watermark lies below every entry: a
    repeated entry is safer than a lost one. Repeated run rows count once.
    """
    good = F.col("status") == "ok"
    last = runs.groupBy("store_id", "node_id").agg(F.max(F.when(good, F.struct("run_id", "file_id", "hi_term"))).alias("last"))
    files = manifest.groupBy(F.col("id").alias("file_id")).agg(F.max("max_seq").alias("max_seq"))
    return (
        last.select("store_id", "node_id", F.col("last.file_id").alias("file_id"), F.col("last.hi_term").alias("hi_term"))
        .join(files, "file_id", "left")
        .select("store_id", "node_id", F.coalesce("max_seq", F.lit(LOWEST)).alias("max_seq"), F.coalesce("hi_term", F.lit(LOWEST)).alias("hi_term"))
    )


def upper_limit(log: DataFrame, after: int | None = None) -> int:
    """The last feed position there is now; rows that arrive later wait for the next run. Reads only what lies above ``after``."""
    if after is not None:
        log = log.where(F.col("feed_pos") > after)
    return log.agg(F.max("feed_pos")).first()[0] or after or 0


def _until(log: DataFrame, upto: int) -> DataFrame:
    """Rows that arrived up to ``upto``; a row without a feed position has always arrived."""
    return log.where((F.col("feed_pos") <= upto) | F.col("feed_pos").isNull())


def changed_entries(log: DataFrame, marks: DataFrame, upto: int | None = None) -> DataFrame:
    """Entries in force above a follower's watermark: ``store_id, node_id, index, term, seq``.

    Of entries that share ``(store_id, index)`` the highest term is in force.
    An entry is due if its ``seq`` is above ``max_seq`` or its ``term`` above
    ``hi_term``. Rows without store or index name no entry; a NULL seq counts
    as above every watermark. Rows no follower of the store could want are
    dropped in the scan, before the shuffle: entries that share an index share
    the seq, so what is left still holds the entry in force. A row of NULL
    ``feed_pos`` counts as arrived, whatever ``upto`` is.
    """
    if upto is not None:
        log = _until(log, upto)
    by_store = marks.where("store_id IS NOT NULL").groupBy("store_id").agg(
        F.collect_set(F.struct("node_id", "max_seq", "hi_term")).alias("marks"),  # a store's few followers
        F.min("max_seq").alias("low_seq"),
        F.min("hi_term").alias("low_term"),
    )
    small = marks.select("store_id").distinct().count() <= BROADCAST_STORES
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    seq = F.coalesce("seq", F.lit(-LOWEST))
    wanted = (
        log.select("store_id", "index", "term", seq.alias("seq"))
        .where("index IS NOT NULL")
        .join(side(by_store.select("store_id", "low_seq", "low_term")), "store_id")
        .where((F.col("seq") > F.col("low_seq")) | (F.col("term") > F.col("low_term")))
    )
    force = wanted.groupBy("store_id", "index").agg(F.max("term").alias("term"), F.max_by("seq", F.coalesce("term", F.lit(LOWEST))).alias("seq"))
    return (
        force.join(side(by_store.select("store_id", "marks")), "store_id")
        .select("store_id", "index", "term", "seq", F.explode("marks").alias("mark"))
        .where((F.col("seq") > F.col("mark.max_seq")) | (F.col("term") > F.col("mark.hi_term")))
        .select("store_id", F.col("mark.node_id").alias("node_id"), "index", "term", "seq")
    )


def _arrivals(log: DataFrame, after: int | None, upto: int) -> DataFrame:
    """``store_id, index, term, seq, placed``: by index, the entry in force among the rows that arrived in ``(after, upto]``.

    ``placed`` is the highest term of a row with a feed position. Fixed-width
    values throughout, so copies are joined in a hash table before the shuffle.
    """
    at = F.col("feed_pos")
    here = at <= upto if after is None else (at > after) & (at <= upto)
    rows = log.where((here | at.isNull()) & F.col("store_id").isNotNull() & F.col("index").isNotNull())
    rank = F.coalesce("term", F.lit(LOWEST))
    return rows.groupBy("store_id", "index").agg(F.max("term").alias("term"), F.max_by("seq", rank).alias("seq"), F.max(F.when(at.isNotNull(), rank)).alias("placed"))


def _bucket(n: int) -> F.Column:
    """Blocks of 65,536 positions of a log stay together, so that what arrives in order meets few buckets."""
    return F.pmod(F.xxhash64("store_id", F.shiftright("index", BLOCK_BITS)), F.lit(n)).cast("int")


def _small(followers: DataFrame) -> DataFrame:
    """Followers, sent to every task if there are few; a store of many entries then has no task of its own."""
    return F.broadcast(followers) if followers.count() <= BROADCAST_STORES else followers


def due_by_marks(force: DataFrame, marks: DataFrame) -> DataFrame:
    """Entries in force (``store_id, index, term, seq``) above each follower's own watermark; a NULL seq is above all."""
    seq, marks = F.coalesce("seq", F.lit(-LOWEST)), marks.where("store_id IS NOT NULL")
    rows = force.join(_small(marks), "store_id").where((seq > F.col("max_seq")) | (F.col("term") > F.col("hi_term")))
    return rows.select("store_id", "node_id", "index", "term", seq.alias("seq"))


class RunStore:
    """Outputs, watermarks and entries of runs below one folder, published by commit files.

    A run reads the rows of the feed in ``(after, upto]`` alone. What it must
    know of earlier ones is kept with the commits: the entries in force, as one
    part a run, in buckets of blocks of positions, of which it reads those it
    meets; and the highest ``seq`` and ``term`` of each store.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _read(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}/{name}")

    def marks(self) -> DataFrame | None:
        """Watermarks of the last committed run."""
        _, entry = self.log.latest()
        return self._read(entry["run"], "marks") if entry else None

    def output(self, n: int) -> DataFrame:
        """What run ``n`` gave; a commit of ``compact`` gave nothing."""
        entry = self.log.read(n)
        rows = self._read(entry["run"], "output")
        return rows.limit(0) if entry.get("compacted") else rows

    def _entries(self, folders: list[str]) -> DataFrame:
        """``store_id, index, term, seq, placed, bucket`` as the parts of several runs have them."""
        return self.spark.read.schema(ENTRIES).option("basePath", f"{self.path}/entries").parquet(*[f"{self.path}/entries/part={f}" for f in folders]).drop("part")

    def _new(self, fresh: DataFrame, last: dict) -> DataFrame:
        """Of ``fresh`` entries those whose term no earlier run has placed."""
        held = self._entries(last["parts"]).where("placed IS NOT NULL")
        if last["buckets"] > 1:
            met = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most all buckets
            held = held.where(F.col("bucket").isin(met))
        held = held.groupBy("bucket", "store_id", "index").agg(F.max("placed").alias("held"))
        rank = F.coalesce("term", F.lit(LOWEST))
        return fresh.join(held, ["bucket", "store_id", "index"], "left").where(F.col("held").isNull() | (F.col("held") < rank)).drop("held")

    def run(self, log: DataFrame, first_marks: DataFrame, fail_before_commit: bool = False) -> int:
        """Process what is new, commit output and watermark as one, return the run's number.

        Output is ``store_id, node_id, index, term, seq``. A follower's first
        run starts from its watermark in ``first_marks``, whenever it appears:
        all entries in force so far that lie above it are due. After that an
        entry is due once it has come into force by a row above the last
        commit's ``upto``, so a late entry of low ``seq`` is not passed over.
        Nothing tells when a row of NULL ``feed_pos`` arrived: it is due in every
        run until a copy of its entry has a position, as a repeated entry is
        safer than a lost one. Rows without store or index name no entry.
        """
        done, last = self.log.latest()
        after = last["upto"] if last else None
        upto, folder = upper_limit(log, after), f"run-{uuid.uuid4().hex}"
        buckets = last["buckets"] if last else max(1, log.count() // ENTRIES_PER_BUCKET)
        fresh = _arrivals(log, after, upto).withColumn("bucket", _bucket(buckets))
        arrived = self._new(fresh, last) if last else fresh
        if buckets > 1:
            arrived = arrived.repartition("bucket")
        arrived.write.partitionBy("bucket").parquet(f"{self.path}/entries/part={folder}")
        arrived = self._entries([folder])

        tops = arrived.select("store_id", "seq", "term")
        if last:
            tops = tops.unionByName(self._read(last["run"], "tops"))
        tops.groupBy("store_id").agg(F.max("seq").alias("seq"), F.max("term").alias("term")).write.parquet(f"{self.path}/{folder}/tops")

        parts = [*(last["parts"] if last else []), folder]
        if last:
            known = self.marks()
            same = [first_marks[c].eqNullSafe(known[c]) for c in ("store_id", "node_id")]
            late = first_marks.join(known, same, "left_anti").select(*known.columns)
            due = arrived.join(_small(known.select("store_id", "node_id")), "store_id").select("store_id", "node_id", "index", "term", "seq")
            if not late.isEmpty():
                all_ = self._entries(parts).join(late.select("store_id").distinct(), "store_id", "left_semi")
                force = all_.groupBy("store_id", "index").agg(F.max("term").alias("term"), F.max_by("seq", F.coalesce("term", F.lit(LOWEST))).alias("seq"))
                due = due.unionByName(due_by_marks(force, late))
            marks = known.unionByName(late)
        else:
            marks, due = first_marks, due_by_marks(arrived, first_marks)
        due.write.parquet(f"{self.path}/{folder}/output")
        top = self._read(folder, "tops").select("store_id", F.col("seq").alias("_seq"), F.col("term").alias("_term"))
        marks = marks.join(top, "store_id", "left")
        marks.select("store_id", "node_id", F.greatest("max_seq", "_seq").alias("max_seq"), F.greatest("hi_term", "_term").alias("hi_term")).write.parquet(f"{self.path}/{folder}/marks")
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        # A commit of compact() counts among the runs' numbers.
        self.log.publish(done + 1, {"run": folder, "upto": upto, "parts": parts, "buckets": buckets})
        return done + 1

    def compact(self) -> None:
        """Join the parts of the kept entries to one, so that a run reads one for each bucket it meets."""
        n, last = self.log.latest()
        if last is None or len(last["parts"]) < 2:
            return
        rank, folder = F.coalesce("term", F.lit(LOWEST)), f"run-{uuid.uuid4().hex}"
        rows = self._entries(last["parts"]).groupBy("bucket", "store_id", "index").agg(F.max("term").alias("term"), F.max_by("seq", rank).alias("seq"), F.max("placed").alias("placed"))
        (rows.repartition("bucket") if last["buckets"] > 1 else rows).write.partitionBy("bucket").parquet(f"{self.path}/entries/part={folder}")
        self.log.publish(n + 1, {**last, "parts": [folder], "compacted": True})

    def vacuum(self) -> list[str]:
        """Delete the folders that no commit names, those of failed runs; returns their names. Not while a run is under way."""
        named = {f for n in self.log.numbers() for e in (self.log.read(n),) for f in (e["run"], *e["parts"])}
        made = {f.removeprefix("part=") for where in (self.path, f"{self.path}/entries") for f in self.log.folders(where)}
        gone = sorted(f for f in made - named if f.startswith("run-"))
        for f in gone:
            self.log.delete(f"{self.path}/{f}")
            self.log.delete(f"{self.path}/entries/part={f}")
        return gone
