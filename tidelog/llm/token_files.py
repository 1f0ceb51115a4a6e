"""Token-ID files: independent zstandard frames, a trailing seek table and a checksum for each frame.

File format (all integers little-endian). Token ids of the documents in order, each document closed by the end id, as
unsigned 16-bit (or 32-bit, if the vocabulary needs it) integers, cut into zstandard frames of FRAME bytes or the
document that reaches beyond it; a document longer than FRAME is cut too, so a reader's memory is bounded. Then two
skippable frames, which zstd tools pass over:
  documents   magic 0x184D2A50, length, u8 bytes per id, u32 count, then per document i64 doc_id and u32 ids
  seek table  magic 0x184D2A5E, length, per frame u32 compressed, u32 decompressed, u32 low half of XXH64 of the
              decompressed bytes; u32 count of frames, u8 0x80, u32 0x8F92EAB1 (the public zstd seekable format)
`read_documents` decompresses only frames that hold a requested document and compares their checksums.

Documents go to files in ascending doc_id order: Spark's range partitioning cuts the ids, each range is sorted and
encoded in its task and written under a task-unique name, then renamed, so a repeated task leaves one whole file. Files lie in the folder the cluster shares, reached by pyarrow.fs (file:, hdfs: and the like).

Encoding uses the tokenizers library. A text is cut before single spaces between non-space characters, where the
byte-level pre-tokenizer always starts a new token, and each distinct piece is encoded once per worker.

Defined results: a null or empty text is the end id alone. Rows of one doc_id follow each other, ordered by a hash of the
text, then the text, and may go on in the next file. Rows without a doc_id come first, with the id stored as the least 64-bit integer and given back as null. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import textnum as T
from tidelog.llm.scratch import Scratch, spark_of

FRAME = 1 << 16
CACHE, JOINED = 2_000_000, 1 << 15  # pieces a worker keeps, bytes encoded as one string
SHARD, SLICE = 48 << 20, 1 << 19  # bytes of text a file, about, and at a time
NO_ID = -(1 << 63)
_DOCS, _SEEK, _END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_LEAD = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))


class Encoder:
    """Vectorised front of a byte-level BPE tokenizer with a cache of encoded pieces.

    The cache is numpy only: sorted runs of piece names with their places in `flat`, the ids of all cached pieces. New
    pieces are encoded joined to long strings; ids stand for so many bytes each, which tells where a piece ends.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.wide = len(vocab) > 1 << 16
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[np.fromiter(vocab.values(), np.int64, len(vocab))] = np.fromiter(map(len, vocab), np.int64, len(vocab))
        self.reset()

    def reset(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.flat, self.used = np.zeros(1 << 16, np.uint32 if self.wide else np.uint16), 0
        self.first, self.size, self.count = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, and how many each has."""
        got = [np.array(e.ids, self.flat.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.concatenate(got) if got else self.flat[:0]), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, raw: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that may follow each other in a text."""
        if not len(first):
            return self.flat[:0], np.zeros(0, np.int64)
        chunk = np.cumsum(last - first) // JOINED
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
        pieces = [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        ids, _ = self._ids([b"".join(pieces[a:b]).decode() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pieces)], strict=True)])
        reach, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(last - first)
        upto = np.searchsorted(reach, ends)
        if reach[-1] != ends[-1] or (reach[upto] != ends).any():
            raise ValueError("not a byte-level vocabulary")
        return ids, np.diff(upto + 1, prepend=0)

    def _add(self, names: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Encode and cache pieces of `raw`, those that are not `free` one by one; their places."""
        order = np.argsort(~free, kind="stable")
        n = int(free.sum())
        ids, sizes = self._joined(raw, first[order[:n]], last[order[:n]])
        more, alone = self._ids([raw[first[k] : last[k]].decode() for k in order[n:]])
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, alone])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(sizes) > len(self.size):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        new = slice(self.count, self.count + len(sizes))
        self.size[new], self.first[new] = sizes, self.used + np.cumsum(sizes) - sizes
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(new.start, new.stop)
        self.used, self.count = self.used + len(ids), new.stop
        self.runs.append((names, place))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            both = [np.concatenate(x) for x in zip(self.runs.pop(), self.runs.pop(), strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.runs.append((both[0][order], both[1][order]))
        return place

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts with offsets `at`, and how many each has."""
        low, high = int(at[0]), int(at[-1])
        part = data[low:high]
        n = len(part)
        if not n:
            return self.flat[:0].copy(), np.zeros(len(at) - 1, np.int64)
        plain = (part > 0x20) & (part != 0x7F)
        lead = _LEAD[part]  # may begin or be a space beyond ASCII
        cut = np.zeros(n, bool)
        cut[3 : n - 1] = (part[3 : n - 1] == 0x20) & plain[2 : n - 2] & plain[4:] & ~lead[4:] & ~lead[1 : max(1, n - 3)] & ~lead[: max(0, n - 4)]
        cut[np.unique(at[:-1][at[:-1] < high] - low)] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n)
        unique, where, back = np.unique(T.span_hashes(part, first, last), return_index=True, return_inverse=True)
        if self.count + len(unique) > CACHE and self.count:
            self.reset()
        slot = np.full(len(unique), -1, np.int64)
        for names, place in self.runs:
            spot = np.minimum(np.searchsorted(names, unique), len(names) - 1)
            hit = names[spot] == unique
            slot[hit] = place[spot[hit]]
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            a, b = first[where[fresh]], last[where[fresh]]
            free = (b - a > 2) & (part[a] == 0x20) & plain[np.minimum(a + 1, n - 1)] & ~lead[np.minimum(a + 1, n - 1)] & plain[b - 1] & ~lead[b - 2] & ~lead[b - 3]
            slot[fresh] = self._add(unique[fresh], part.tobytes(), a, b, free)
        slot = slot[back.ravel()]
        sizes = self.size[slot].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.first[slot] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        doc = np.searchsorted(at, first + low, "right") - 1
        return ids, np.bincount(doc, sizes, minlength=len(at) - 1).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a worker and vocabulary, with the pieces it knows from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Writes one file; documents come in order."""

    def __init__(self, out, width: int, level: int = 3):
        import zstandard

        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.held_bytes, self.docs, self.table = [], 0, [], []

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // self.width))
        for k in range(0, len(ids), FRAME):
            self.held.append(ids[k : k + FRAME])
            self.held_bytes += len(self.held[-1])
            if self.held_bytes >= FRAME:
                self._flush()

    def _flush(self) -> None:
        import xxhash

        raw = b"".join(self.held)
        if raw:
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> int:
        """Write the tables; number of ids."""
        self._flush()
        docs = struct.pack("<BI", self.width, len(self.docs)) + b"".join(struct.pack("<qI", *d) for d in self.docs)
        seek = b"".join(struct.pack("<III", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0x80, _END)
        for magic, body in ((_DOCS, docs), (_SEEK, seek)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.out.close()
        return sum(n for _, n in self.docs)


class Reader:
    """Random access to one file: `documents` lists (doc_id, ids), `ids(k)` reads the k-th document's."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != _END:
            raise ValueError("not a token file")
        start = size - 9 - 12 * count
        table = np.frombuffer(self._read(start, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(table[:, 1])])
        magic, length, self.width, n = struct.unpack("<IIBI", self._read(int(self.packed[-1]), 13))
        if magic != _DOCS:
            raise ValueError("no table of documents")
        docs = np.frombuffer(self._read(int(self.packed[-1]) + 13, length - 5), np.dtype([("id", "<i8"), ("n", "<u4")]))
        self.documents = docs
        self.first = np.concatenate([[0], np.cumsum(docs["n"].astype(np.int64))])
        self.at, self.frame = -1, b""

    def _read(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _load(self, k: int) -> bytes:
        import xxhash
        import zstandard

        if k != self.at:
            raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.packed[k]), int(self.packed[k + 1] - self.packed[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"checksum of frame {k} does not match")
            self.at, self.frame = k, raw
        return self.frame

    def ids(self, k: int) -> np.ndarray:
        low, high = int(self.first[k]) * self.width, int(self.first[k + 1]) * self.width
        out, f = [], int(np.searchsorted(self.raw, low, "right")) - 1
        while low < high:
            stop = min(high, int(self.raw[f + 1]))
            out.append(self._load(f)[low - int(self.raw[f]) : stop - int(self.raw[f])])
            low, f = stop, f + 1
        return np.frombuffer(b"".join(out), np.uint16 if self.width == 2 else np.uint32)


def _write(folder: str, tokenizer: str, end_id: int):
    """Encode the rows (doc_id, text) of a partition in order and write its file."""

    def run(batches):
        part, writer, out = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if writer is None:
                encoder = encoder_of(tokenizer)
                kind = np.uint32 if encoder.wide else np.uint16
                tail = np.array([end_id], kind).tobytes()
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                temp = f"{base}/.{uuid.uuid4().hex}"
                out = store.open_output_stream(temp)
                writer = Writer(out, kind().itemsize)
            names = batch.column(0).to_pylist()
            data, at = T.utf8(batch.column(1))
            for low, high in T.groups_of(at, SLICE):
                ids, sizes = encoder.encode(data, at[low : high + 1])
                ends = np.cumsum(sizes)
                for k, e, s in zip(range(low, high), ends, sizes, strict=True):
                    writer.add(NO_ID if names[k] is None else names[k], ids[e - s : e].astype(kind).tobytes() + tail)
        if writer is not None:
            total = writer.close()
            store.move(temp, f"{base}/part-{part:06d}.tok")
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, len(writer.docs), total)], ["part", "documents", "ids"])

    return run


def _read_back(folder: str):
    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/part-{part:06d}.tok") as source:
                    reader = Reader(source)
                    for low in range(0, len(reader.documents), 4096):
                        rows = range(low, min(low + 4096, len(reader.documents)))
                        docs = reader.documents[rows.start : rows.stop]
                        sums = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in rows]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(docs["id"], pa.int64(), mask=docs["id"] == NO_ID), pa.array(reader.first[rows.start : rows.stop] + offset, pa.int64()),
                            pa.array(docs["n"].astype(np.int64)), pa.array(sums, pa.int64()), pa.array([part] * len(rows), pa.int64()),
                        ], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode `docs` (doc_id, text) and write files to `folder`; (part, documents, ids) of each file, staged."""
    scratch = Scratch(spark_of(docs), "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]  # many rows without a doc_id, or of one, are cut too
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(max(12, -(-total // SHARD)), *order).sortWithinPartitions(*order, "text")
    return scratch.keep(ordered.mapInArrow(_write(folder, tokenizer, end_id), "part long, documents long, ids long"), "files")


def read_digests(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, read from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = files.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("offset"))
    spread = offsets.repartition("part")
    return spread.mapInArrow(_read_back(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, file long")


def read_documents(folder: str, file: int, positions: list[int]) -> list[np.ndarray]:
    """Ids of chosen documents of one file; only their frames are decompressed."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/part-{file:06d}.tok") as source:
        reader = Reader(source)
        return [reader.ids(k) for k in positions]


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of `docs` to the shared folder and return what reading them back gives."""
    folder = Scratch(spark_of(docs), "token-files").base
    return read_digests(write_tokens(docs, tokenizer, folder), folder)
