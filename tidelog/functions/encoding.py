"""Byte-exact encodings of records, index pointers, footers and manifest entries as Column expressions.

All integers are big-endian. Layouts (fixed values):
  record    u32 total, u32 key length, key, i8 op, [update: i32 value length, value], u32 CRC-32 of what lies between
            total and CRC; total = 9 + key or 13 + key + value, without its own four bytes
  pointer   u32 key length, key, u32 start, u32 length
  footer    u32 start of index, u32 length of first index entry, u32 entries
  manifest  u32 total, u8 level, u8 name length, name, u32 start key length, start key, u32 end key length, end key,
            u8 deleted; total = 11 + name + start key + end key
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import UPDATE


def uint(value: Column, width: int = 4) -> Column:
    """Big-endian bytes of an unsigned integer."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def read_uint(data: Column, start: Column | int, width: int = 4) -> Column:
    """Unsigned integer of `width` bytes at the 0-based `start`."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(width))), 16, 10).cast("long")


def _cut(data: Column, start: Column, length: Column) -> Column:
    return F.substring(data, (start + 1).cast("int"), length.cast("int"))


def record_size(key: Column, value: Column, op: Column) -> Column:
    """Bytes of an encoded record, its length field included."""
    update = F.lit(17) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
    return F.when(op == UPDATE, update).otherwise(F.lit(13) + F.octet_length(key)).cast("long")


def record_body(key: Column, value: Column, op: Column) -> Column:
    """What the checksum covers."""
    key = key.cast("binary")
    value = F.coalesce(value.cast("binary"), F.lit(bytearray(b"")))
    head = F.concat(uint(F.octet_length(key)), key, uint(op, 1))
    return F.when(op == UPDATE, F.concat(head, uint(F.octet_length(value)), value)).otherwise(head)


def encode_record(key: Column, value: Column, op: Column) -> Column:
    body = record_body(key, value, op)
    return F.concat(uint(record_size(key.cast("binary"), value.cast("binary"), op) - 4), body, uint(F.crc32(body)))


def decode_record(data: Column) -> Column:
    """Struct (key, value, op, crc, actual) of an encoded record; `crc` is the stored checksum, `actual` the computed."""
    klen = read_uint(data, 4)
    op = read_uint(data, klen + 8, 1).cast("byte")
    vlen = read_uint(data, klen + 9)
    value = F.when(op == UPDATE, F.when(vlen > 0, _cut(data, klen + 13, vlen)).otherwise(F.lit(bytearray(b""))))
    end = F.octet_length(data).cast("long") - 4
    return F.struct(
        F.when(klen > 0, _cut(data, F.lit(8), klen)).otherwise(F.lit(bytearray(b""))).alias("key"), value.alias("value"), op.alias("op"),
        read_uint(data, end).alias("crc"), F.crc32(_cut(data, F.lit(4), end - 4)).alias("actual"),
    )


def verified(decoded: Column) -> Column:
    """The decoded record; raises where the checksum does not match."""
    text = F.concat(F.lit("expected checksum of WAL record does not match! expected="), decoded["crc"].cast("string"), F.lit(", actual="), decoded["actual"].cast("string"))
    return F.when(decoded["crc"] == decoded["actual"], decoded).otherwise(F.raise_error(text))


def encode_pointer(key: Column, start: Column, length: Column) -> Column:
    key = key.cast("binary")
    return F.concat(uint(F.octet_length(key)), key, uint(start), uint(length))


def decode_pointer(data: Column) -> Column:
    klen = read_uint(data, 0)
    return F.struct(_cut(data, F.lit(4), klen).alias("key"), read_uint(data, klen + 4).alias("start_byte"), read_uint(data, klen + 8).alias("length"))


def pointer_size(key: Column) -> Column:
    return (F.octet_length(key) + 12).cast("long")


def encode_footer(index_start: Column, length: Column, entries: Column) -> Column:
    return F.concat(uint(index_start), uint(length), uint(entries))


def decode_footer(data: Column) -> Column:
    return F.struct(read_uint(data, 0).alias("index_start_byte"), read_uint(data, 4).alias("length"), read_uint(data, 8).alias("index_entries"))


def encode_entry(level: Column, name: Column, start_key: Column, end_key: Column, deleted: Column) -> Column:
    name, start_key, end_key = (c.cast("binary") for c in (name, start_key, end_key))
    total = F.lit(11) + F.octet_length(name) + F.octet_length(start_key) + F.octet_length(end_key)
    parts = [uint(total), uint(level, 1), uint(F.octet_length(name), 1), name]
    for bound in (start_key, end_key):
        parts += [uint(F.octet_length(bound)), bound]
    return F.concat(*parts, uint(deleted.cast("int"), 1))


def decode_entry(data: Column) -> Column:
    name = read_uint(data, 5, 1)
    start = read_uint(data, name + 6)
    end = read_uint(data, name + start + 10)
    return F.struct(
        read_uint(data, 4, 1).cast("short").alias("level"), _cut(data, F.lit(6), name).cast("string").alias("filename"),
        _cut(data, name + 10, start).alias("start_key"), _cut(data, name + start + 14, end).alias("end_key"),
        (read_uint(data, name + start + end + 14, 1) != 0).alias("deleted"),
    )
