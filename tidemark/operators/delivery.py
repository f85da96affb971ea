"""Exactly one copy of every entry that was delivered at least once.

An identifier is (producer, number): the producer is ``(store_id, term)``, the
number is ``index``. Seen numbers are kept as disjoint ranges per producer, so
a dense log of any length costs a handful of ranges. A number inside a range is
a surplus copy; an uncovered number is accepted once and its range merged with
its neighbours. Identifiers that are no producer and number (a NULL part, a
negative or huge index) are compared whole, one by one.

Two passes run the same range book. The first works on each input partition in
arrival order and needs no shuffle: whatever it finds covered is surplus for
sure, so a hot identifier leaves at most one row per partition. The second
works on blocks of ``BLOCK`` consecutive numbers of a producer, so that a hot
producer is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16
NUMBER_BITS = 40
TOP = (1 << NUMBER_BITS) - 2  # one number is never used, so that two producers' ranges never touch
CHUNK = 1 << 16
#: Producers and odd identifiers that a pass keeps in memory before it begins anew. With a chunk's more, codes stay below 2^23.
MAX_PRODUCERS, MAX_ODD = 1 << 20, 1 << 20

RANGE, ENTRY, KNOWN, ODD = 0, 1, 2, 3  # what a row between the passes is
FLOW = "kind tinyint, store_id int, term long, block long, lo long, hi long, delivery_id long, pos int"
FLOW_ARROW = pa.schema([("kind", pa.int8()), ("store_id", pa.int32()), ("term", pa.int64()), ("block", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("delivery_id", pa.int64()), ("pos", pa.int32())])
OUT = "outcome string, store_id int, term long, lo long, hi long, delivery_id long, pos int"
OUT_ARROW = pa.schema([("outcome", pa.string()), ("store_id", pa.int32()), ("term", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("delivery_id", pa.int64()), ("pos", pa.int32())])
RANGES = "store_id int, term long, lo long, hi long"


class RangeBook:
    """Disjoint, sorted, non-touching ranges over one 64-bit number line."""

    def __init__(self) -> None:
        self.lo = np.empty(0, np.int64)
        self.hi = np.empty(0, np.int64)

    def covered(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lo, keys, "right") - 1
        inside = at >= 0
        inside[inside] = keys[inside] <= self.hi[at[inside]]
        return inside

    def add(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Merge ranges in; overlapping and touching ones become one."""
        lo, hi = np.concatenate([self.lo, lo]), np.concatenate([self.hi, hi])
        if not len(lo):
            return
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        starts = np.concatenate([[True], lo[1:] > hi[:-1] + 1])
        ends = np.concatenate([starts[1:], [True]])
        self.lo, self.hi = lo[starts], hi[ends]

    def accept(self, keys: np.ndarray) -> np.ndarray:
        """True where a key, in the given order, is new; new keys are merged in."""
        new = np.zeros(len(keys), bool)
        free = np.flatnonzero(~self.covered(keys))
        if len(free):
            numbers, first = np.unique(keys[free], return_index=True)
            new[free[first]] = True
            cuts = np.flatnonzero(np.diff(numbers) > 1)
            self.add(numbers[np.concatenate([[0], cuts + 1])], numbers[np.concatenate([cuts, [len(numbers) - 1]])])
        return new

    def take_below(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove and return the ranges that begin below ``key``."""
        n = int(np.searchsorted(self.lo, key))
        gone = self.lo[:n], self.hi[:n]
        self.lo, self.hi = self.lo[n:], self.hi[n:]
        return gone


class Producers:
    """Dense codes of producers, in order of first sight, to put all on one number line."""

    def __init__(self) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        self.names: list[tuple[int, int]] = []

    def code(self, store: np.ndarray, term: np.ndarray) -> np.ndarray:
        pairs = np.stack([store.astype(np.int64), term], 1)
        if not len(pairs):
            return np.empty(0, np.int64)
        names, back = np.unique(pairs, axis=0, return_inverse=True)
        codes = np.empty(len(names), np.int64)
        # A producer's rows come together in the second pass: codes rise with first sight there.
        first = np.full(len(names), len(pairs))
        np.minimum.at(first, back.ravel(), np.arange(len(pairs)))
        for i in np.argsort(first):
            name = (int(names[i, 0]), int(names[i, 1]))
            if name not in self.codes:
                self.codes[name] = len(self.names)
                self.names.append(name)
            codes[i] = self.codes[name]
        return codes[back.ravel()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).fill_null(0).to_numpy()


def _new_odd(t: pa.Table, rows: np.ndarray, seen: set) -> np.ndarray:
    """Exact keyed lookup of identifiers that fit no range."""
    new = np.zeros(len(rows), bool)
    part = t.select(["store_id", "term", "lo"]).take(pa.array(rows))
    for i, name in enumerate(zip(*(c.to_pylist() for c in part.columns))):
        if name not in seen:
            seen.add(name)
            new[i] = True
    return new


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in arrival order: entries that this partition has seen become KNOWN."""
    book, producers, odd = RangeBook(), Producers(), set()
    for t in _chunks(batches):
        # What this pass forgets the second one finds out, so its memory may end.
        if len(producers.names) >= MAX_PRODUCERS:
            book, producers = RangeBook(), Producers()
        if len(odd) >= MAX_ODD:
            odd.clear()
        kind = t.column("kind").to_numpy().copy()
        rows = np.flatnonzero(kind == ENTRY)
        keys = (producers.code(_numbers(t, "store_id")[rows], _numbers(t, "term")[rows]) << NUMBER_BITS) + _numbers(t, "lo")[rows]
        kind[rows[~book.accept(keys)]] = KNOWN
        rows = np.flatnonzero(kind == ODD)
        kind[rows[~_new_odd(t, rows, odd)]] = KNOWN
        # A known copy is only carried on; its arrival spreads it over the tasks.
        block = np.where(kind == KNOWN, _numbers(t, "delivery_id"), _numbers(t, "block"))
        yield from t.set_column(0, "kind", pa.array(kind, pa.int8())).set_column(3, "block", pa.array(block, pa.int64())).cast(FLOW_ARROW).to_batches()


def _second_pass(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, producers, odd = RangeBook(), Producers(), set()
        mask = (1 << NUMBER_BITS) - 1

        def ranges(lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
            names = [producers.names[i] for i in lo >> NUMBER_BITS]
            n = len(lo)
            return pa.RecordBatch.from_arrays([pa.array(["range"] * n, pa.string()), pa.array([s for s, _ in names], pa.int32()), pa.array([t for _, t in names], pa.int64()), pa.array(lo & mask), pa.array(hi & mask), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], schema=OUT_ARROW)

        for t in _chunks(batches):
            kind = t.column("kind").to_numpy()
            ranged = np.flatnonzero((kind == RANGE) | (kind == ENTRY))
            base = producers.code(_numbers(t, "store_id")[ranged], _numbers(t, "term")[ranged]) << NUMBER_BITS
            lo, hi = base + _numbers(t, "lo")[ranged], base + _numbers(t, "hi")[ranged]
            old = kind[ranged] == RANGE
            book.add(lo[old], hi[old])  # stored ranges are older than any row of this batch
            new = np.zeros(len(kind), bool)
            new[ranged[~old]] = book.accept(lo[~old])
            rows = np.flatnonzero(kind == ODD)
            new[rows] = _new_odd(t, rows, odd)
            outcome = np.where(kind == RANGE, "", np.where(new, "accepted", "surplus"))
            keep = np.flatnonzero(np.isin(outcome, list(wanted)))
            if len(keep):
                part = t.select(["store_id", "term", "lo", "hi", "delivery_id", "pos"]).take(pa.array(keep))
                yield from part.add_column(0, "outcome", pa.array(outcome[keep])).cast(OUT_ARROW).to_batches()
            if len(ranged):  # rows come block by block, so blocks before the last one are done
                done = book.take_below(int(lo[-1] >> BLOCK_BITS << BLOCK_BITS))
                if "range" in wanted and len(done[0]):
                    yield ranges(*done)
                if len(producers.names) >= MAX_PRODUCERS:
                    # Codes begin anew; of the old ones only the last producer can go on.
                    last, fresh = producers.names[int(lo[-1] >> NUMBER_BITS)], Producers()
                    fresh.code(np.array([last[0]]), np.array([last[1]]))
                    book.lo, book.hi, producers = book.lo & mask, book.hi & mask, fresh
            odd.clear()
            if kind[-1] == ODD:  # odd identifiers come sorted by their hash; only the last hash can go on
                at = rows[_numbers(t, "block")[rows] == _numbers(t, "block")[-1]]
                _new_odd(t, at, odd)
        if "range" in wanted and len(book.lo):
            yield ranges(book.lo, book.hi)

    return run


def outcomes(messages: DataFrame, seen: DataFrame | None = None, wanted: tuple[str, ...] = ("accepted", "surplus", "range"), unnamed: bool = False) -> DataFrame:
    """Decide every copy of every entry of ``messages``.

    ``messages`` has ``delivery_id, store_id, entries[term, index]``; other
    columns are ignored. ``seen`` has the ranges of earlier runs (columns
    ``store_id, term, lo, hi``, as returned here). The result has one row per
    ``accepted`` or ``surplus`` copy and, for ``range``, the numbers seen so
    far, cut at block borders (``merge_ranges`` joins them).

    The copy first by ``(delivery_id, pos)`` is accepted unless ``seen`` covers
    it. Empty or NULL ``entries`` and elements that are NULL give no row. A NULL
    in one part of an identifier equals NULL. A NULL delivery_id counts as
    arrived first. With ``unnamed``, an element whose term and index are both
    NULL is an identifier like any other; without, it gives no row, and only
    these two fields of the elements are read.
    """
    if unnamed:
        # Only whole elements tell a NULL one from one of NULL fields; the others are left out before the sort.
        pairs = F.transform("entries", lambda e: F.when(e.isNotNull(), F.struct(e["term"].alias("term"), e["index"].alias("index"))))
        messages, entry, there = messages.select("delivery_id", "store_id", pairs.alias("entries")), F.posexplode("entries"), F.col("e").isNotNull()
    else:
        entry = F.posexplode(F.arrays_zip(F.col("entries.term").alias("term"), F.col("entries.index").alias("index")))
        there = F.col("e.term").isNotNull() | F.col("e.index").isNotNull()
    rows = messages.select("delivery_id", "store_id", "entries").sortWithinPartitions("delivery_id").select("delivery_id", F.col("store_id").cast("int").alias("store_id"), entry.alias("pos", "e"))
    term, index = F.col("e.term").cast("long"), F.col("e.index").cast("long")
    fine = F.coalesce(F.col("store_id").isNotNull() & term.isNotNull() & index.between(0, TOP), F.lit(False))
    flow = rows.where(there).select(
        F.when(fine, ENTRY).otherwise(ODD).cast("tinyint").alias("kind"),
        "store_id",
        term.alias("term"),
        F.when(fine, F.shiftright(index, BLOCK_BITS)).otherwise(F.xxhash64("store_id", term, index)).alias("block"),
        index.alias("lo"),
        index.alias("hi"),
        F.col("delivery_id").cast("long").alias("delivery_id"),
        F.col("pos").cast("int").alias("pos"),
    )
    flow = flow.mapInArrow(_first_pass, FLOW)
    if seen is not None:
        first, last = F.shiftright("lo", BLOCK_BITS), F.shiftright("hi", BLOCK_BITS)
        parts = seen.select(F.col("store_id").cast("int").alias("store_id"), "term", "lo", "hi", F.explode(F.sequence(first, last)).alias("block"))
        begin = F.shiftleft("block", BLOCK_BITS)
        parts = parts.select(F.lit(RANGE).cast("tinyint").alias("kind"), "store_id", "term", "block", F.greatest("lo", begin).alias("lo"), F.least("hi", begin + ((1 << BLOCK_BITS) - 1)).alias("hi"), F.lit(None).cast("long").alias("delivery_id"), F.lit(None).cast("int").alias("pos"))
        flow = flow.unionByName(parts)
    # A known copy goes by its arrival, not by its producer: hot producers must not gather.
    known = F.col("kind") == KNOWN
    spread = [F.when(known, F.lit(None)).otherwise(F.col(c)) for c in ("store_id", "term")]
    flow = flow.repartition(*spread, "block").sortWithinPartitions(F.when(F.col("kind") == RANGE, ENTRY).otherwise(F.col("kind")), "store_id", "term", "block", "kind", "delivery_id", "pos")
    return flow.mapInArrow(_second_pass(frozenset(wanted)), OUT)


def surplus_copies(messages: DataFrame, seen: DataFrame | None = None, unnamed: bool = False) -> DataFrame:
    """Every copy but the one kept: ``delivery_id, pos``."""
    return outcomes(messages, seen, ("surplus",), unnamed).select("delivery_id", "pos")


def accepted_entries(messages: DataFrame, seen: DataFrame | None = None, unnamed: bool = False) -> DataFrame:
    """The kept copies: ``store_id, term, index, delivery_id, pos``, each identifier once."""
    return outcomes(messages, seen, ("accepted",), unnamed).select("store_id", "term", F.col("lo").alias("index"), "delivery_id", "pos")


def delivered_once(messages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The entries themselves: ``store_id, delivery_id, pos`` and all fields of each kept copy.

    The places to keep go back to their messages by ``delivery_id``, which must
    be unique and not NULL here.
    """
    kept = accepted_entries(messages, seen, unnamed=True).groupBy("delivery_id").agg(F.collect_list("pos").alias("_kept"))
    rows = messages.join(kept, "delivery_id").select("store_id", "delivery_id", F.explode("_kept").alias("pos"), "entries")
    return rows.select("store_id", "delivery_id", "pos", F.get("entries", "pos").alias("e")).select("store_id", "delivery_id", "pos", "e.*")


def seen_ranges(messages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The disjoint ranges of all numbers seen, to be stored for the next run."""
    return merge_ranges(outcomes(messages, seen, ("range",)))


def merge_ranges(parts: DataFrame) -> DataFrame:
    """Join ranges that touch at block borders.

    Only the ranges that reach a border are ordered per producer: at most two a
    block, however many ranges a block holds.
    """
    size = 1 << BLOCK_BITS
    edge = (F.col("lo") % size == 0) | (F.col("hi") % size == size - 1)
    parts = parts.select(F.col("store_id").cast("int").alias("store_id"), "term", "lo", "hi")
    by = "PARTITION BY store_id, term ORDER BY lo"
    joined = (
        parts.where(edge)
        .withColumn("fresh", F.expr(f"CASE WHEN lo = lag(hi) OVER ({by}) + 1 THEN 0 ELSE 1 END"))
        .withColumn("island", F.expr(f"sum(fresh) OVER ({by})"))
        .groupBy("store_id", "term", "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("island")
    )
    return parts.where(~edge).unionByName(joined)
