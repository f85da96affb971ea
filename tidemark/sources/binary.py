"""Binary logs and sorted runs as Spark data sources.

``spark.dataSource.register(LogFiles)`` gives the format ``tidemark_log`` (read
and append), ``RunFiles`` the format ``tidemark_run`` (read). A file is one
partition. Reads of runs skip files whose key range can't hold a wanted key, and
go to the nearest sparse-index entry, if key filters are pushed
(``spark.sql.python.filterPushdown.enabled``).

Both formats open files as Python does: the paths must be the same disk for all
tasks. ``read_logs`` reads logs from any file system Spark knows. ``append_log``
writes, and refuses on a cluster unless the caller says that the folder is shared.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from glob import glob
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Layouts (little-endian), codes, and how often a run's index has an entry.
LOG_HEAD = struct.Struct("<IQBII")  # checksum, seq, op, key length, value length
LOG_BODY = struct.Struct("<QBII")
RUN_HEAD = struct.Struct("<QBII")  # seq, op, key length, value length
LOG_OPS = {1: "PUT", 2: "DELETE"}
RUN_OPS = {0: "PUT", 1: "DELETE"}
INDEX_EVERY = 16
BLOOM_RATE = 0.01
LOG_SCHEMA = "offset long, checksum long, seq long, op string, key binary, value binary, good boolean"
LOG_ARROW = pa.schema([("offset", pa.int64()), ("checksum", pa.int64()), ("seq", pa.int64()), ("op", pa.string()), ("key", pa.binary()), ("value", pa.binary()), ("good", pa.bool_())])
RUN_SCHEMA = "key binary, value binary, seq long, op string"


def log_record(seq: int, op: str, key: bytes, value: bytes) -> bytes:
    code = next(c for c, name in LOG_OPS.items() if name == op)
    body = LOG_BODY.pack(seq, code, len(key), len(value)) + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def read_log(path: str) -> Iterator[tuple]:
    """Records of a log file up to the first one that is cut off or whose checksum fails.

    The broken record comes last, with ``good`` false and what could be read.
    """
    with open(path, "rb") as f:
        yield from _records(f, os.fstat(f.fileno()).st_size)


def _records(f: BinaryIO, size: int) -> Iterator[tuple]:
    at = 0
    while head := f.read(LOG_HEAD.size):
        if len(head) < LOG_HEAD.size:
            yield (at, None, None, None, None, None, False)
            return
        checksum, seq, op, key_len, value_len = LOG_HEAD.unpack(head)
        left = size - f.tell()
        body = f.read(key_len + value_len) if key_len + value_len <= left else b""
        good = len(body) == key_len + value_len and op in LOG_OPS and zlib.crc32(head[4:] + body) == checksum
        yield (at, checksum, seq, LOG_OPS.get(op), body[:key_len], body[key_len:], good)
        if not good:
            return
        at += len(head) + len(body)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of each log file and its records as ``tidemark_log`` gives them, from any file system. A file is held in memory, so up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                if rows := list(_records(BytesIO(data), len(data))):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, f.type) for c, f in zip(zip(*rows), LOG_ARROW))], names=["path", *LOG_ARROW.names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, f"path string, {LOG_SCHEMA}")


def append_log(rows: DataFrame, folder: str, shared: bool = False) -> None:
    """Append ``seq, op, key, value`` to the log in ``folder``, a segment for each task. ``shared``: all tasks see one disk there."""
    spark = rows.sparkSession
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("each task would write to its own machine; name a shared folder and say so")
    spark.dataSource.register(LogFiles)
    rows.select("seq", "op", "key", "value").write.format("tidemark_log").mode("append").save(folder)


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _files(options: dict, suffix: str) -> list[str]:
    path = options["path"].removeprefix("file://").removeprefix("file:")
    return sorted(glob(f"{path}/**/*{suffix}", recursive=True)) if os.path.isdir(path) else sorted(glob(path))


class LogFiles(DataSource):
    """Format ``tidemark_log``: option ``path`` is a file, a pattern or a folder of ``.bin`` files."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LogWriter(self.options, schema.fieldNames())


class _LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = _files(options, ".bin")

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in self.files] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        yield from read_log(partition.path) if partition.path else ()


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class _LogWriter(DataSourceWriter):
    """Each task writes and syncs one segment under a hidden name; the commit gives it its own."""

    def __init__(self, options: dict, names: list[str]) -> None:
        self.folder, self.names = options["path"].removeprefix("file://").removeprefix("file:"), names

    def write(self, rows: Iterable) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/.{uuid.uuid4().hex}"
        binary = lambda v: b"" if v is None else bytes(v) if not isinstance(v, str) else v.encode()
        with open(path, "wb") as f:
            for row in rows:
                r = dict(zip(self.names, row))
                f.write(log_record(r["seq"], r["op"], binary(r["key"]), binary(r["value"])))
            f.flush()
            os.fsync(f.fileno())
        return _Written(path)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        begun = len(_files({"path": self.folder}, ".bin"))
        for i, m in enumerate(m for m in messages if m):
            os.rename(m.path, f"{self.folder}/log_{begun + i:08d}.bin")

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


def write_run(path: str, rows: Iterable[tuple[bytes, bytes, int, str]]) -> None:
    """One run file from rows in key order: records, key range, sparse index, Bloom bits, footer."""
    keys, index = [], []
    with open(path, "wb") as f:
        for i, (key, value, seq, op) in enumerate(rows):
            if i % INDEX_EVERY == 0:
                index.append((key, f.tell()))
            keys.append(key)
            f.write(RUN_HEAD.pack(seq, next(c for c, n in RUN_OPS.items() if n == op), len(key), len(value)) + key + value)
        at = f.tell()
        low, high = (keys[0], keys[-1]) if keys else (b"", b"")
        f.write(struct.pack("<II", len(low), len(high)) + low + high + struct.pack("<I", len(index)))
        for key, offset in index:
            f.write(struct.pack("<I", len(key)) + key + struct.pack("<Q", offset))
        bloom = Bloom.sized(len(keys))
        for key in keys:
            bloom.add(key)
        bits = bloom.dump()
        f.write(struct.pack("<I", len(bits)) + bits + struct.pack("<Q", at))


class Bloom:
    """Bits set by double hashing; the usual sizes for a rate of wrong positives."""

    def __init__(self, m: int, k: int, bits: bytearray | None = None) -> None:
        self.m, self.k, self.bits = m, k, bits or bytearray((m + 7) // 8)

    @classmethod
    def sized(cls, n: int, rate: float = BLOOM_RATE) -> Bloom:
        m = max(1, int(-n * math.log(rate) / math.log(2) ** 2))
        return cls(m, max(1, int(m / max(n, 1) * math.log(2))))

    def _places(self, key: bytes) -> Iterator[int]:
        a, b = zlib.crc32(key), zlib.crc32(key + b"salt") | 1
        return ((a + i * b) % self.m for i in range(self.k))

    def add(self, key: bytes) -> None:
        for i in self._places(key):
            self.bits[i >> 3] |= 1 << (i & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self._places(key))

    def dump(self) -> bytes:
        return struct.pack("<QQQ", self.m, self.k, len(self.bits)) + bytes(self.bits)

    @classmethod
    def load(cls, data: bytes) -> Bloom:
        m, k, n = struct.unpack_from("<QQQ", data)
        return cls(m, k, bytearray(data[24 : 24 + n]))


class RunMeta:
    """Key range, sparse index and Bloom bits from a run file's end."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            f.seek(-8, os.SEEK_END)
            (self.data_end,) = struct.unpack("<Q", f.read(8))
            f.seek(self.data_end)
            low, high = struct.unpack("<II", f.read(8))
            self.low, self.high = f.read(low), f.read(high)
            (n,) = struct.unpack("<I", f.read(4))
            self.index = []
            for _ in range(n):
                (size,) = struct.unpack("<I", f.read(4))
                key = f.read(size)
                self.index.append((key, struct.unpack("<Q", f.read(8))[0]))
            (size,) = struct.unpack("<I", f.read(4))
            self.bloom = f.read(size)


class RunFiles(DataSource):
    """Format ``tidemark_run``: option ``path`` is a file, a pattern or a folder of ``.bin`` files.

    Option ``own_bloom`` says that the files are of this writer: lookups of one
    key then ask their Bloom bits, which other writers set by their own hash.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_run"

    def schema(self) -> str:
        return RUN_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RunReader(self.options)


class _RunReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.low, self.high = _files(options, ".bin"), None, None
        self.own_bloom = options.get("own_bloom", "false") == "true"

    def pushFilters(self, filters: list) -> Iterable:
        """Bounds on ``key`` narrow what is read; all filters are applied again by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(getattr(f, "value", None), (bytes, bytearray)):
                v = bytes(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = v if self.low is None else max(self.low, v)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = v if self.high is None else min(self.high, v)
        return filters

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in self.files] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        meta = RunMeta(partition.path)
        if self.low is not None and meta.high < self.low or self.high is not None and meta.low > self.high:
            return
        if self.own_bloom and self.low is not None and self.low == self.high and self.low not in Bloom.load(meta.bloom):
            return
        begin = 0
        for key, offset in meta.index:
            if self.low is not None and key <= self.low:
                begin = offset
        with open(partition.path, "rb") as f:
            f.seek(begin)
            while f.tell() < meta.data_end:
                seq, op, key_len, value_len = RUN_HEAD.unpack(f.read(RUN_HEAD.size))
                key, value = f.read(key_len), f.read(value_len)
                if self.high is not None and key > self.high:
                    return
                yield (key, value, seq, RUN_OPS.get(op))
