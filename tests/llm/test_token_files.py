"""Token files: exact round trip, random access, checksums, order."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyarrow import fs

from tidelog.llm import queries, token_files
from tidelog.llm.scratch import Scratch

pytest.importorskip("tokenizers")
SEED = random.Random(5)
PARTS = ["the", " cat", "'s", "  two", "\n\n", "\t", "é", "über", " 12", "3.5", "...", " ", " ", "!", "😀", "don't", " ", "x" * 30, "日本", "\x85", "\x1f", "a-b"]


def text():
    return "".join(SEED.choice(PARTS) for _ in range(SEED.randint(0, 40)))


def test_encoder_like_the_library():
    from tokenizers import Tokenizer

    from tidelog.llm import textnum as T

    tokenizer, encoder = Tokenizer.from_file(queries.byte_bpe()), token_files.Encoder(queries.byte_bpe())
    texts = [text() for _ in range(1500)] + ["", "a b c " * 9000, " lead", "trail ", " <|endoftext|> x<|endoftext|>y"]
    import pyarrow as pa

    for some in (["one"], [""], texts, texts[::-1]):  # pieces that never follow another, none, new ones, known ones
        ids, sizes = encoder.encode(*T.utf8(pa.array(some)))
        at = 0
        for t, n in zip(some, sizes, strict=True):
            assert ids[at : at + n].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
            at += n


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    rows = [(k, text()) for k in SEED.sample(range(10_000), 120)] + [(20_000, None), (20_001, ""), (20_002, "long text here " * 20_000)]
    got = token_files.digests(spark.createDataFrame(rows, "doc_id long, text string"), queries.byte_bpe()).collect()
    expected, start = {}, 0
    for doc_id, t in sorted(rows):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected


def test_frames_are_read_alone_and_checked(spark):
    folder = Scratch(spark, "test").base
    rows = [(k, f"document number {k} " * (k * 300 + 1)) for k in range(12)]
    files = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), queries.byte_bpe(), folder).collect()
    store, base = fs.FileSystem.from_uri(folder)
    last = max(files, key=lambda f: f.ids)
    path = f"{base}/part-{last.part:06d}.tok"
    with store.open_input_file(path) as source:
        reader = token_files.Reader(source)
        ids = reader.ids(0)
        assert len(ids) == reader.documents["n"][0]
        data = bytearray(reader._read(0, source.size()))
    assert token_files.read_documents(folder, last.part, [0])[0].tolist() == ids.tolist()
    at = int(reader.packed[-1])
    assert struct.unpack_from("<I", data, at)[0] == 0x184D2A50 and struct.unpack_from("<I", data, len(data) - 4)[0] == 0x8F92EAB1
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(whole) == 2 * int(reader.documents["n"].sum())
    seek = len(data) - 9 - 12 * len(reader.sums)
    data[seek + 8] ^= 1  # the first frame's checksum
    with store.open_output_stream(path) as out:
        out.write(bytes(data))
    with pytest.raises(ValueError, match="checksum of frame 0"):
        token_files.read_documents(folder, last.part, [0])


def test_rows_without_an_id_are_spread_over_files(spark):
    rows = [(None, f"text {k}") for k in range(300)] + [(5, f"other {k}") for k in range(300)] + [(9, "last")]
    got = token_files.digests(spark.createDataFrame(rows, "doc_id long, text string"), queries.byte_bpe()).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [5] * 300 + [9]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    for doc_id in (None, 5):
        assert len({r.file for r in got if r.doc_id == doc_id}) > 1
