"""Byte lengths and checksums of log and run records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a record besides key and value, and operation codes in log records.
RECORD_BYTES = 17
WAL_HEADER_BYTES = 21
WAL_PUT, WAL_DELETE = 1, 2
RUN_PUT, RUN_DELETE = 0, 1


def _reversed_hex(number: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a number, lowest first, as hexadecimal digits."""
    out = None
    for i in range(size):
        byte = F.shiftleft(F.shiftright(number, 8 * i).bitwiseAND(0xFF), 8 * (size - 1 - i))
        out = byte if out is None else out.bitwiseOR(byte)
    return F.lpad(F.hex(out), 2 * size, F.lit("0"))


def little_endian(number: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a number, lowest first, as binary. NULL gives NULL."""
    return F.unhex(_reversed_hex(number.cast("long"), size))


def record_bytes(key: Column, value: Column, put: Column) -> Column:
    """Stored size of an entry; a removal stores no value, a NULL value no byte."""
    return RECORD_BYTES + F.octet_length(key) + F.when(put, F.coalesce(F.octet_length(value), F.lit(0))).otherwise(0)


def wal_checksum(seq: Column, op: Column, key: Column, value: Column) -> Column:
    """CRC-32 of a log record: seq, op code, both lengths, key, value. NULL text counts as empty."""
    key, value = F.coalesce(key, F.lit("")), F.coalesce(value, F.lit(""))
    code = F.when(op == "PUT", WAL_PUT).otherwise(WAL_DELETE)
    head = [_reversed_hex(seq.cast("long"), 8), F.lpad(F.hex(code.cast("long")), 2, F.lit("0")), *(_reversed_hex(F.octet_length(x).cast("long"), 4) for x in (key, value))]
    return F.crc32(F.concat(F.unhex(F.concat(*head)), key.cast("binary"), value.cast("binary")))
