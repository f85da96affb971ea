"""Held-out passages inside a training corpus.

Items are cut into windows of ``WORDS`` words; the set of their hashes is sent to
every task, and each document's windows are looked up in it. Words are compared
as a reader sees them. The lookup uses a coarse form of a word in which every
letter that may stand for another, by shape or by case, is one; each hit is then
verified letter by letter. A word is a run of letters and digits, so languages
written without spaces have a sentence for a word: nothing of fewer than
``WORDS`` sentences is found there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lookalike import SAME_SHAPE, Transducer
from tidemark.scratch import cut

WORDS = 8
#: Hashes of item windows that are sent to every task at a time, 64 MB.
ROUND_HASHES = 1 << 23
#: Words of texts that are looked up at a time.
CHUNK_WORDS = 1 << 18
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _cases(c: str) -> set[str]:
    return {x for x in (c, c.lower(), c.upper(), c.casefold(), c.title()) if len(x) == 1}


def _groups() -> dict[str, str]:
    """Each letter of a look-alike group, or a case of one, to one letter for all that are linked so."""
    parent: dict[str, str] = {}

    def top(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for c, others in SAME_SHAPE.items():
        for x in (c, *others):
            for y in _cases(x):
                a, b = sorted((top(c), top(y)))
                parent[b] = a
    return {c: top(c) for c in parent}


class Words:
    """Splits texts into words and compares words; one for each Python process."""

    _one: Words | None = None

    def __init__(self) -> None:
        shared = Transducer.shared()
        self._form = shared.form
        self._word = re.compile(f"(?:[^\\W_]|{shared.marks}|{shared.invisible})+")
        self._coarse = str.maketrans(_groups())
        self.coarse = lru_cache(1 << 17)(self._coarse_of)
        self.fine = lru_cache(1 << 14)(self._fine_of)
        self.same = lru_cache(1 << 16)(self._same)
        self.code = lru_cache(1 << 17)(lambda w: xxhash.xxh3_64_intdigest(self._coarse_of(w)))

    @classmethod
    def shared(cls) -> Words:
        if cls._one is None:
            cls._one = cls()
        return cls._one

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the words of ``text`` begin and end; a run of invisible characters alone is no word."""
        return [m.span() for m in self._word.finditer(text) if self.coarse(m[0])]

    def split(self, text: str) -> list[str]:
        return [w for w in self._word.findall(text) if w.isascii() or self.coarse(w)]

    def _fine_of(self, word: str) -> str:
        return unicodedata.normalize("NFD", self._form(word))

    def _coarse_of(self, word: str) -> str:
        # Twice: folding case may part letters that the form had joined.
        return unicodedata.normalize("NFD", self._form(word).casefold()).translate(self._coarse)

    def _seen_as(self, c: str) -> set[str]:
        """All letters ``c`` may be read as when case doesn't matter."""
        alike = (c, *SAME_SHAPE.get(c, ""))
        return {self._form(y) for x in alike for y in _cases(x)}

    def _same(self, a: str, b: str) -> bool:
        """Whether a reader sees the same word, but for case."""
        a, b = self.fine(a), self.fine(b)
        if a == b or a.casefold() == b.casefold():
            return True
        return len(a) == len(b) and all(x == y or y in self._seen_as(x) or x in self._seen_as(y) for x, y in zip(a, b))


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each ``n`` consecutive codes; their polynomial modulo 2^64."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * FACTOR + codes[j : len(codes) - n + 1 + j]
    return out


class HashSet:
    """Sorted hashes behind a bit for each value of their lowest bits, which answers for most of what isn't there."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.sort(hashes)
        bits = max(16, min(26, int(len(hashes)).bit_length() + 4))
        self.mask = np.uint64((1 << bits) - 1)
        self.some = np.zeros(1 << bits, bool)
        self.some[self.sorted & self.mask] = True

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes`` that are in the set."""
        at = np.flatnonzero(self.some[hashes & self.mask])
        if len(at):
            near = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
            at = at[self.sorted[near] == hashes[at]]
        return at


def _scan(n: int, held: HashSet | None):
    """A function from batches ``id, text`` to the windows ``id, place, hash, raw`` of the texts, or those that ``held`` holds."""

    def chunk(ids: list, split: list[list[str]], kind: pa.DataType) -> pa.RecordBatch:
        code = Words.shared().code
        sizes = np.array([len(ws) for ws in split])
        flat = [w for ws in split for w in ws]
        hashes = window_hashes(np.fromiter(map(code, flat), np.uint64, len(flat)), n)
        ends = sizes.cumsum()
        at = np.arange(len(hashes)) if held is None else held.held(hashes)
        text = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[text] if len(at) else np.empty(0, bool)
        at, text = at[inside], text[inside]
        raw = [" ".join(flat[k : k + n]) for k in at.tolist()]
        place = at - (ends[text] - sizes[text])
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in text.tolist()], kind), pa.array(place, pa.int32()), pa.array(hashes[at].view(np.int64)), pa.array(raw, pa.string())], names=["id", "place", "hash", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words.shared().split
        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(split(t))
                size += len(texts[-1])
                if size >= CHUNK_WORDS:
                    yield chunk(ids, texts, b.column(0).type)
                    ids, texts, size = [], [], 0
            if size:
                yield chunk(ids, texts, b.column(0).type)

    return run


def _windows(texts: DataFrame, n: int, held: HashSet | None = None) -> DataFrame:
    """``id, place, hash, raw`` of the windows of ``texts`` (``id, text``), those of ``held`` only if it is given."""
    kind = texts.schema["id"].dataType.simpleString()
    return texts.where("text IS NOT NULL").mapInArrow(_scan(n, held), f"id {kind}, place int, hash long, raw string")


def _hits(texts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``id, place, item_id`` of the windows of ``texts`` (``id, text``) that read as a window of an item.

    The hashes of all item windows go to every task, 8 bytes each and at most
    ``ROUND_HASHES`` at a time; item sets of any size take as many rounds over
    the texts. Only windows whose hash is held leave the scan; they are joined
    with the items' windows and compared letter by letter.
    """
    spark = texts.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("id"), "text")
    wanted = cut(_windows(rows, n).select(F.col("id").alias("item_id"), "hash", F.col("raw").alias("other")).distinct())
    hashes = wanted.select("hash").distinct()
    rounds = max(1, -(-hashes.count() // ROUND_HASHES))
    found = None
    for r in range(rounds):
        mine = hashes if rounds == 1 else hashes.where(F.pmod(F.shiftrightunsigned("hash", 32), F.lit(rounds)) == r)
        part = mine.toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)  # ROUND_HASHES or so
        if len(part):
            sent = spark.sparkContext.broadcast(HashSet(part))
            scan = lambda batches, sent=sent: _scan(n, sent.value)(batches)
            kind = texts.schema["id"].dataType.simpleString()
            hits = texts.where("text IS NOT NULL").mapInArrow(scan, f"id {kind}, place int, hash long, raw string")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"id {texts.schema['id'].dataType.simpleString()}, place int, item_id long")
    return _verified(found.join(wanted, "hash"), f"id {texts.schema['id'].dataType.simpleString()}, place int, item_id long")


def leaks(documents: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """``item_id, doc_id``: the document holds ``n`` consecutive words of the item, once each.

    NULL and empty texts hold nothing; items of fewer than ``n`` words can't
    leak. Whole texts are read. Other columns are ignored.
    """
    hits = _hits(documents.select(F.col("doc_id").cast("long").alias("id"), "text"), items, n)
    return hits.select("item_id", F.col("id").alias("doc_id")).distinct()


def _verified(pairs: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` of those ``pairs`` whose windows ``raw`` and ``other`` read the same."""
    names = [c.split()[0] for c in schema.split(", ")]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.shared()
        for b in batches:
            keep = [all(map(words.same, x.split(" "), y.split(" "))) for x, y in zip(b.column("raw").to_pylist(), b.column("other").to_pylist())]
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    return pairs.select(*names, "raw", "other").mapInArrow(verify, schema)


def _without(text: str, spans: list[tuple[int, int]], starts: list[int], n: int) -> tuple[str, int]:
    """``text`` without the windows that begin at the words ``starts`` (in order), and how many pieces went."""
    gone: list[list[int]] = []
    for k in starts:
        begin, end = spans[k][0], spans[k + n - 1][1]
        if gone and begin <= gone[-1][1]:
            gone[-1][1] = end
        else:
            gone.append([begin, end])
    for begin, end in reversed(gone):
        text = text[:begin] + text[end:]
    return text, len(gone)


def cleaned(documents: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """``doc_id, text, n_removed``: the documents with every leaked span cut out.

    A span is a stretch of words in which every window is a leak, from the
    first word's beginning to the last word's end. Documents without a leak,
    NULL texts too, come out as they are with ``n_removed`` 0. What leaks in a
    text depends on the text alone, so the places found go back by the text's
    hash; they are few, and equal texts have them once.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("id"))
    places = _hits(rows.select("id", "text"), items, n).groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("places"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Words.shared().spans
        for b in batches:
            done = [_without(t, spans(t), at, n) if at else (t, 0) for t, at in zip(b.column("text").to_pylist(), b.column("places").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([r for _, r in done], pa.int32())], names=["doc_id", "text", "n_removed"])

    return rows.join(places, "id", "left").select("doc_id", "text", "places").mapInArrow(cut_out, "doc_id long, text string, n_removed int")
