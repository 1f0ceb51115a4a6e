"""Record files: logs and data blocks of encoded records, one after another (layout: `functions.encoding`).

A small codec for the driver's log, a reader that turns files into changes, and a writer of one file a partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.encoding import encode_record
from tidelog.schema import UPDATE


class ChecksumError(ValueError):
    pass


def encode(key: bytes, value: bytes | None, op: int) -> bytes:
    body = struct.pack(">I", len(key)) + key + struct.pack(">b", op)
    if op == UPDATE:
        body += struct.pack(">i", len(value or b"")) + (value or b"")
    return struct.pack(">I", len(body) + 4) + body + struct.pack(">I", zlib.crc32(body))


def decode(data: bytes, start: int = 0) -> tuple[bytes, bytes | None, int, int]:
    """(key, value, op, end) of the record at `start`; raises on a torn record or a wrong checksum."""
    if len(data) - start < 4:
        raise EOFError("torn record")
    (total,) = struct.unpack_from(">I", data, start)
    end = start + 4 + total
    if end > len(data) or total < 9:
        raise EOFError("torn record")
    body, (crc,) = data[start + 4 : end - 4], struct.unpack_from(">I", data, end - 4)
    if zlib.crc32(body) != crc:
        raise ChecksumError(f"expected checksum of WAL record does not match! expected={crc}, actual={zlib.crc32(body)}")
    (klen,) = struct.unpack_from(">I", body)
    op = body[4 + klen]
    return bytes(body[4 : 4 + klen]), bytes(body[9 + klen :]) if op == UPDATE else None, op, end


def records(data: bytes, stop: int | None = None) -> Iterator[tuple[bytes, bytes | None, int]]:
    at, stop = 0, len(data) if stop is None else stop
    while at < stop:
        key, value, op, at = decode(data, at)
        yield key, value, op


def block_end(data: bytes) -> int:
    """Where a segment file's records end: its index start, from the 12-byte footer."""
    return struct.unpack_from(">I", data, len(data) - 12)[0]


def _read(segments: bool, lenient: bool):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, rows, error = data.as_buffer().to_pybytes(), [], None
                try:
                    for row in records(data, block_end(data) if segments else None):
                        rows.append(row)
                except (EOFError, ChecksumError) as e:
                    if not lenient:
                        raise
                    error = str(e)
                n = len(rows)
                cols = [[path] * n, list(range(n)), *([r[k] for r in rows] for k in range(3)), [None] * n]
                if error:
                    for c, v in zip(cols, (path, n, None, None, None, error), strict=True):
                        c.append(v)
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int8(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "position", "key", "value", "op", "error"])

    return run


def read(spark: SparkSession, paths: str | list[str], segments: bool = False, lenient: bool = False) -> DataFrame:
    """(path, position, key, value, op, error) of record files, a task a file.

    `segments`: files with an index and a footer behind the records. A torn or corrupt record fails the read; with
    `lenient` it gives a row with `error` and ends its file.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(_read(segments, lenient), "path string, position long, key binary, value binary, op byte, error string")


def changes_of(rows: DataFrame) -> DataFrame:
    """Changes from record files in order of path and position; seq is dense within a file and leaves room for 2^31 records."""
    paths = rows.select("path").distinct().orderBy("path")
    ranks = {r[0]: k for k, r in enumerate(paths.collect())}  # one row a file
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]) if ranks else F.create_map().cast("map<string,int>")
    seq = F.shiftleft(rank[F.col("path")].cast("long"), 31) + F.col("position")
    return rows.where("error is null").select("key", "value", "op", seq.alias("seq"))


def encoded(changes: DataFrame) -> DataFrame:
    """(seq, record) of each change, by built-in functions."""
    return changes.select("seq", encode_record(F.col("key"), F.col("value"), F.col("op")).alias("record"))
