"""Replication frames: messages with length-prefixed entries, as text.

``term|leader_commit|count|len|entry|len|entry...``, an entry being
``term|index|op|keylen|key|valuelen|value``; lengths count bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operation codes in frames.
OPS = {"PUT": 1, "DELETE": 2}
_ENTRY = pa.struct([("term", pa.int64()), ("index", pa.int64()), ("op", pa.string()), ("key", pa.string()), ("value", pa.string())])
MESSAGE = "term long, leader_commit long, entries array<struct<term: long, index: long, op: string, key: string, value: string>>"


def encode_entry(e: Column) -> Column:
    """One entry as text; NULL key and value count as empty, NULL numbers as 0."""
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    key, value = (F.coalesce(e[c], F.lit("")) for c in ("key", "value"))
    code = F.when(e["op"] == "PUT", str(OPS["PUT"])).otherwise(str(OPS["DELETE"]))
    return F.concat_ws("|", number(e["term"]), number(e["index"]), code, F.octet_length(key).cast("string"), key, F.octet_length(value).cast("string"), value)


def encode_message(term: Column, leader_commit: Column, entries: Column) -> Column:
    """A message as one frame, without the line end that the wire adds. NULL entries count as none."""
    texts = F.transform(F.coalesce(entries, F.array().cast("array<struct<term:long,index:long,op:string,key:string,value:string>>")), encode_entry)
    parts = F.transform(texts, lambda t: F.concat(F.octet_length(t).cast("string"), F.lit("|"), t))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return F.concat_ws("|", number(term), number(leader_commit), F.size(parts).cast("string"), parts)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self) -> int:
        end = self.data.index(b"|", self.at)
        out, self.at = int(self.data[self.at : end]), end + 1
        return out

    def text(self, last: bool = False) -> bytes:
        n = self.number()
        out, end = self.data[self.at : self.at + n], self.at + n
        if n < 0 or len(out) < n or not last and self.data[end : end + 1] not in (b"|", b""):
            raise ValueError("a length doesn't fit")
        self.at = end + 1
        return out


def decode(frame: bytes) -> tuple[int, int, list[dict]]:
    """Term, leader's commit and entries of one frame; raises ValueError if it is malformed."""
    frame = frame.rstrip(b"\r\n") if frame.endswith(b"\n") else frame
    head = frame.split(b"|", 3)
    if len(head) < 3:
        raise ValueError("a frame has at least three parts")
    term, commit, count = (int(x) for x in head[:3])
    body, entries = _Reader(head[3] if len(head) > 3 else b""), []
    for _ in range(count):
        e = _Reader(body.text())
        row = {"term": e.number(), "index": e.number()}
        op = e.number()
        row |= {"op": "PUT" if op == OPS["PUT"] else "DELETE", "key": e.text().decode(), "value": e.text(last=True).decode()}
        entries.append(row)
    return term, commit, entries


def decode_messages(frames: DataFrame, column: str = "frame") -> DataFrame:
    """``frames`` with the decoded ``term, leader_commit, entries``.

    Length-prefixed text is no regular language, so it is read in Arrow batches.
    A malformed or NULL frame gives NULLs. Columns of these names are replaced.
    """
    kept = frames.drop("term", "leader_commit", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text in b.column(column).to_pylist():
                try:
                    out.append(decode(text.encode()))
                except (ValueError, AttributeError):
                    out.append((None, None, None))
            term, commit, entries = zip(*out) if out else ((), (), ())
            arrays = [*b.columns, pa.array(term, pa.int64()), pa.array(commit, pa.int64()), pa.array(entries, pa.list_(_ENTRY))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, "term", "leader_commit", "entries"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, {MESSAGE}")
