"""Byte-exact encodings, by expressions and by the driver's codec."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import encoding as E
from tidelog.sources import binary
from tidelog.sources.binary import ChecksumError

from .test_resolve import log_of


def test_record_sizes_and_checksum(spark):
    rows = log_of(spark, ["+foo=bar", "-foo", "+foo2=bar2", "+="]).select(
        E.record_size(F.col("key"), F.col("value"), F.col("op")).alias("n"), E.encode_record(F.col("key"), F.col("value"), F.col("op")).alias("r"), "key", "value", "op", "seq"
    ).orderBy("seq").collect()
    assert [r.n for r in rows] == [23, 16, 25, 17] and [len(r.r) for r in rows] == [23, 16, 25, 17]
    for r in rows:
        assert bytes(r.r) == binary.encode(bytes(r.key), None if r.value is None else bytes(r.value), r.op)
    assert int.from_bytes(rows[0].r[:4], "big") == 19 and int.from_bytes(rows[1].r[:4], "big") == 12
    assert int.from_bytes(rows[0].r[-4:], "big") == 538011314


def test_record_round_trip_and_bad_checksum(spark):
    log = log_of(spark, ["+foo=bar", "-foo", "+x=", "+=y"])
    coded = log.select("*", E.encode_record(F.col("key"), F.col("value"), F.col("op")).alias("r"))
    for r in coded.select("*", E.verified(E.decode_record(F.col("r"))).alias("d")).collect():
        assert (r.d.key, r.d.value, r.d.op) == (r.key, r.value, r.op)
    bad = bytearray(binary.encode(b"foo", b"bar", 0)[:-4] + (12).to_bytes(4, "big"))
    text = "expected checksum of WAL record does not match! expected=12, actual=538011314"
    with pytest.raises(Exception, match="expected=12, actual=538011314"):
        spark.createDataFrame([(bad,)], "r binary").select(E.verified(E.decode_record(F.col("r")))).collect()
    with pytest.raises(ChecksumError) as e:
        binary.decode(bytes(bad))
    assert str(e.value) == text


def test_pointers_footers_and_entries(spark):
    one = spark.range(1)
    p = one.select(E.encode_pointer(F.lit(b"foo"), F.lit(3_000_000_000), F.lit(7)).alias("p"))
    assert tuple(p.select(E.decode_pointer(F.col("p")).alias("d")).first().d) == (bytearray(b"foo"), 3_000_000_000, 7) and len(p.first().p) == 15
    f = one.select(E.encode_footer(F.lit(1), F.lit(2), F.lit(3)).alias("f"))
    assert bytes(f.first().f) == b"\0\0\0\1\0\0\0\2\0\0\0\3" and tuple(f.select(E.decode_footer(F.col("f")).alias("d")).first().d) == (1, 2, 3)
    m = one.select(E.encode_entry(F.lit(3), F.lit("foo"), F.lit(b"foo"), F.lit(b"bar"), F.lit(False)).alias("m"))
    assert int.from_bytes(m.first().m[:4], "big") == 20 and len(m.first().m) == 24
    assert tuple(m.select(E.decode_entry(F.col("m")).alias("d")).first().d) == (3, "foo", bytearray(b"foo"), bytearray(b"bar"), False)


def test_record_files(spark, tmp_path):
    rows = [(b"foo", b"bar", 0), (b"foo", None, 1), (b"foo", b"baz", 0)]
    data = b"".join(binary.encode(*r) for r in rows)
    (tmp_path / "1.wal").write_bytes(data)
    (tmp_path / "2.wal").write_bytes(binary.encode(b"oooooh", b"wweeee", 0))
    got = binary.read(spark, [str(tmp_path / "1.wal"), str(tmp_path / "2.wal")])
    log = binary.changes_of(got)
    from tidelog.operators.resolve import snapshot

    assert {bytes(r.key): bytes(r.value) for r in snapshot(log).collect()} == {b"foo": b"baz", b"oooooh": b"wweeee"}
    (tmp_path / "3.wal").write_bytes(data[:-3])
    with pytest.raises(Exception, match="torn"):
        binary.read(spark, str(tmp_path / "3.wal")).collect()
    torn = binary.read(spark, str(tmp_path / "3.wal"), lenient=True).collect()
    assert [r.error for r in torn] == [None, None, "torn record"]
    assert [bytes(r.record) for r in binary.encoded(log).orderBy("seq").collect()][:3] == [binary.encode(*r) for r in rows]


def test_segment_files(spark, tmp_path):
    block = b"".join(binary.encode(*r) for r in [(b"bar", b"1", 0), (b"baz", None, 1)])
    index = (3).to_bytes(4, "big") + b"bar" + (0).to_bytes(4, "big") + (21).to_bytes(4, "big")
    (tmp_path / "s.sst").write_bytes(block + index + len(block).to_bytes(4, "big") + len(index).to_bytes(4, "big") + (1).to_bytes(4, "big"))
    got = binary.read(spark, str(tmp_path / "s.sst"), segments=True).collect()
    assert [(bytes(r.key), r.op) for r in got] == [(b"bar", 0), (b"baz", 1)]
