"""Sorted runs and their files: sizes, indexes, key ranges, what to compact."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.record_bytes import record_bytes
from tidemark.operators.lww import latest

# When a level is compacted, and how often a run's index has an entry.
L0_FILES = 4
LEVEL_BYTES = {1: 10 << 20, 2: 100 << 20}
INDEX_EVERY = 16
FILE_FACTS = pa.schema([("file", pa.string()), ("min_key", pa.string()), ("max_key", pa.string()), ("max_seq", pa.int64()), ("size_bytes", pa.int64()), ("n_rows", pa.int64())])


def record_size() -> Column:
    """Bytes of a row's record."""
    return record_bytes(F.col("key"), F.col("value"), F.col("op") == "PUT")


def memtable_size(oplog: DataFrame) -> DataFrame:
    """One row ``size_bytes, n_keys`` of the log reduced to one entry per key; 0, 0 when empty."""
    kept = latest(oplog, ["key"], ["seq", "op", "value"], ["value"])
    return kept.agg(F.coalesce(F.sum(record_size()), F.lit(0)).cast("long").alias("size_bytes"), F.count("*").alias("n_keys"))


def flush(oplog: DataFrame, run: str = "flush_id") -> DataFrame:
    """``run, key, value, seq, op``: each run's part of the log with one entry per key."""
    return latest(oplog, [run, "key"], ["seq", "op", "value"], ["value"]).select(run, "key", "value", "seq", "op")


def facts() -> list[Column]:
    """Aggregates that describe a run: ``min_key, max_key, max_seq, size_bytes, n_rows``."""
    return [F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"), F.sum(record_size()).cast("long").alias("size_bytes"), F.count("*").alias("n_rows")]


def run_meta(runs: DataFrame, run: str = "flush_id") -> DataFrame:
    """``run, min_key, max_key, max_seq, size_bytes, n_rows`` of each run; ``max_seq`` is the run's own."""
    return runs.groupBy(run).agg(*facts())


def sparse_index(runs: DataFrame, run: str = "flush_id") -> DataFrame:
    """``run, key, byte_offset`` of every 16th row of each run, in key order, from the first.

    Runs are files of bounded size (a compaction cuts its result into such), so each is numbered in one task.
    """
    order = Window.partitionBy(run).orderBy("key")
    offset = F.coalesce(F.sum(record_size()).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return runs.select(run, "key", offset.alias("byte_offset"), (F.row_number().over(order) - 1).alias("i")).where(F.col("i") % INDEX_EVERY == 0).drop("i")


def level_sizes(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``level, n_files, size_bytes``; a NULL size counts as 0."""
    return manifest.groupBy(*(by or []), "level").agg(F.count("*").alias("n_files"), F.sum(F.coalesce("size_bytes", F.lit(0))).cast("long").alias("size_bytes"))


def compaction_due(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``level, n_files, size_bytes, due``: level 0 by its files, levels 1 and 2 by their bytes."""
    limit = F.create_map(*[F.lit(x) for pair in LEVEL_BYTES.items() for x in pair])
    due = F.when(F.col("level") == 0, F.col("n_files") >= L0_FILES).otherwise(F.coalesce(F.col("size_bytes") > F.try_element_at(limit, F.col("level")), F.lit(False)))
    return level_sizes(manifest, by).withColumn("due", due)


def may_hold(manifest: DataFrame, low: str, high: str | None = None) -> DataFrame:
    """The files whose key range meets ``[low, high]``; a file with no range may hold anything."""
    return manifest.where((F.coalesce(F.col("min_key") <= (low if high is None else high), F.lit(True))) & F.coalesce(F.col("max_key") >= low, F.lit(True)))


def compaction_inputs(manifest: DataFrame, by: list[str]) -> DataFrame:
    """``*by, source_level, id, level``: the files each compaction would read.

    From level 0 all files, from a deeper level the file of the lowest
    ``min_key`` (then id); and of the next level those that meet the sources'
    key range. Stores without files of a level have no compaction of it.
    """
    first = F.row_number().over(Window.partitionBy(*by, "level").orderBy("min_key", "id"))
    chosen = manifest.withColumn("n", first).where("level = 0 OR n = 1").select(*by, F.col("level").alias("source_level"), "id", "level", "min_key", "max_key")
    span = chosen.groupBy(*by, "source_level").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    target = manifest.withColumn("source_level", F.col("level") - 1).join(span, [*by, "source_level"]).where("NOT (max_key < low OR min_key > high)")
    columns = [*by, "source_level", "id", "level"]
    return chosen.select(*columns).unionByName(target.select(*columns))


def compacted(runs: DataFrame, bottom: bool) -> DataFrame:
    """The merge of runs ``(key, value, seq, op)``; at the bottom removals go, elsewhere they stay to hide older rows."""
    merged = latest(runs, ["key"], ["seq", "op", "value"], ["value"]).select("key", "value", "seq", "op")
    return merged.where("op = 'PUT'") if bottom else merged


def merged(runs: DataFrame, bottom: bool) -> DataFrame:
    """``compacted`` for runs that are range-partitioned by key: the last operation of each key where it lies, in key order.

    Every input has a key once at most, so there is nothing to reduce before
    the shuffle; and rows sorted by key and seq need no aggregation behind it.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("op"), F.desc("value")))
    last = runs.select("key", "value", "seq", "op", place.alias("n")).where("n = 1").drop("n")
    return last.where("op = 'PUT'") if bottom else last


def _file_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of each stretch of rows of one file; keys come in order, so the ends are the first and the last."""
    for b in batches:
        for file in pc.unique(b.column("file")):
            t = b.filter(pc.equal(b.column("file"), file))
            key = t.column("key")
            row = [file.as_py(), key[0].as_py(), key[-1].as_py(), pc.max(t.column("seq")).as_py(), pc.sum(t.column("size")).as_py(), len(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(FILE_FACTS.names, row))], schema=FILE_FACTS)


def file_facts(rows: DataFrame) -> list[dict]:
    """``file, min_key, max_key, max_seq, size_bytes, n_rows`` of each file of written, sorted runs, in key order.

    The driver gets one row for each file.
    """
    sized = rows.select(F.col("_metadata.file_name").alias("file"), "key", "seq", record_size().cast("long").alias("size"))
    parts = sized.mapInArrow(_file_facts, "file string, min_key string, max_key string, max_seq long, size_bytes long, n_rows long")
    whole = parts.groupBy("file").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), *(f(c).alias(c) for f, c in ((F.max, "max_seq"), (F.sum, "size_bytes"), (F.sum, "n_rows"))))
    return sorted((r.asDict() for r in whole.collect()), key=lambda f: f["min_key"].encode())


def without(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    """The manifest without the ids in ``removed``."""
    return manifest.join(removed.select("id").distinct(), "id", "left_anti")


def amplification(oplog: DataFrame) -> DataFrame:
    """One row: stored and live entries, their ratio, and the share compaction frees."""
    kept = latest(oplog, ["key"], ["seq", "op", "value"], ["value"]).agg(F.count_if(F.col("op") == "PUT").alias("n_live"))
    rows = oplog.agg(F.count("*").alias("n_entries"))
    # Two single-row results.
    both = rows.withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one")
    return both.select("n_entries", "n_live", F.when(F.col("n_live") > 0, F.col("n_entries") / F.col("n_live")).alias("space_amplification"), F.when(F.col("n_entries") > 0, (F.col("n_entries") - F.col("n_live")) * 100.0 / F.col("n_entries")).alias("reclaimed_percent"))
