"""Bounds, sparse index, footers, seeks, splits, and the manifest's arithmetic."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import lookup, segments
from tidelog.plans import leveling

from .test_resolve import log_of


def test_bounds_and_index(spark):
    run = log_of(spark, ["+foo=bar", "+baz=bax"]).withColumn("segment_id", F.lit("test"))
    assert tuple(segments.bounds(run).first()) == ("test", bytearray(b"baz"), bytearray(b"foo"), 2, 46)
    index = segments.sparse_index(run, stride=1).orderBy("key").collect()
    assert [(bytes(r.key), r.start_byte, r.length) for r in index] == [(b"baz", 0, 23), (b"foo", 23, 23)]
    assert tuple(segments.footers(run, stride=1).first()) == ("test", 46, 15, 2)


def test_every_key_of_a_long_segment_is_found(spark):
    run = spark.range(2500).select(F.lit(0).alias("segment_id"), F.format_string("%05d", "id").alias("key"), F.lit("v").alias("value"), F.lit(0).alias("op"))
    index = segments.sparse_index(run)
    assert index.count() == 3
    probes = run.where("key in ('00000', '00999', '01000', '02499')").select("segment_id", "key").unionByName(spark.createDataFrame([(0, "!")], "segment_id int, key string"))
    got = {r.key: r.start_byte for r in lookup.seek(probes, index).collect()}
    assert got == {"!": None, "00000": 0, "00999": 0, "01000": 23000, "02499": 46000}


def test_pruning_is_inclusive(spark, monkeypatch):
    table = spark.createDataFrame([("s", "alpha", "omega"), ("t", "zeta", "zz")], "segment_id string, start_key string, end_key string")
    keys = spark.createDataFrame([("foo",), ("alpha",), ("omega",), ("zomg",), ("zzz",), ("a",)], "key string")
    expected = {("foo", "s"), ("alpha", "s"), ("omega", "s"), ("zomg", "t")}
    assert {tuple(r) for r in lookup.prune(keys, table).collect()} == expected
    monkeypatch.setattr(lookup, "SEGMENTS", 1)  # more segments than are broadcast
    assert {tuple(r) for r in lookup.prune(keys, table).collect()} == expected


@pytest.mark.parametrize(("a", "b", "expected"), [(("a", "z"), ("m", "n"), True), (("m", "n"), ("a", "z"), True), (("a", "b"), ("b", "c"), True), (("a", "b"), ("c", "d"), False)])
def test_overlap(spark, a, b, expected):
    assert spark.range(1).select(lookup.overlaps(*[F.lit(x) for x in (*a, *b)])).first()[0] is expected


def test_greedy_split_counts_anew(spark):
    run = spark.range(50).select(F.format_string("%03d", "id").alias("key"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("value"), F.lit(0).alias("op"))
    parts, part, used = [], 0, 0
    for k in range(50):
        if used > 100:
            part, used = part + 1, 0
        used += 17 + 3 + k % 7
        parts.append(part)
    got = segments.split_greedily(run, limit=100).orderBy("key").collect()
    assert [r.part for r in got] == parts
    ranged = segments.split_greedily(run, limit=100, ranges=3)
    assert ranged.count() == 50 and ranged.select("range").distinct().count() == 3


@pytest.mark.parametrize(("limit", "kind"), [(0, "string"), (100, "binary"), (700, "string"), (1500, "string"), (10**6, "string")])
def test_greedy_split_over_ranges_is_that_of_one_stream(spark, monkeypatch, limit, kind):
    monkeypatch.setattr(segments, "RANGE_RECORDS", 60, raising=False)  # ten ranges, longer and shorter than a part
    monkeypatch.setattr(segments, "RANGE_LIMITS", 0, raising=False)
    rows = [(None if k % 50 == 7 else f"{k * 7919 % 1000:03d}", None if k % 11 == 0 else "x" * (k * k % 61), int(k % 5 == 0)) for k in range(600)]
    expected, part, used = {}, 0, 0
    for key, value, op in sorted(rows, key=lambda row: (row[0] is None, row[0])):
        if used > limit:
            part, used = part + 1, 0
        used += 0 if key is None else 13 + len(key) if op else 17 + len(key) + len(value or "")
        expected.setdefault(key, []).append(part)
    run = spark.createDataFrame(rows, "key string, value string, op int").withColumn("key", F.col("key").cast(kind))
    got = segments.split_greedily(run, limit=limit)
    assert max(got.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 300  # no task has the run
    found = {}
    for row in got.orderBy("part").collect():
        found.setdefault(row.key if row.key is None else bytes(row.key).decode() if kind == "binary" else row.key, []).append(row.part)
    assert found == expected


ENTRY = "ordinal long, level int, filename string, start_key string, end_key string, bytes long, deleted boolean"


def test_manifest_fold(spark):
    rows = [(0, 0, "foo", "foo", "bar", 1, False), (1, 0, "bar", "baz", "bax", 1, False), (2, 0, "bar", "baz", "bax", 1, True), (3, 1, "", "a", "b", 5, False), (4, 1, "", "a", "b", 5, False), (5, 1, "", "a", "b", 5, True), (6, 2, "x", "a", "b", 1, False), (7, 2, "x", "a", "b", 1, True)]
    entries = spark.createDataFrame(rows, ENTRY)
    assert [(r.level, r.filename, r.ordinal) for r in leveling.live(entries).orderBy("ordinal").collect()] == [(0, "foo", 0), (1, "", 4)]
    assert leveling.levels_seen(entries).first()[0] == 3
    assert leveling.unmatched_removals(entries).count() == 0
    assert leveling.unmatched_removals(spark.createDataFrame([(0, 0, "x", "a", "b", 1, True)], ENTRY)).count() == 1
    assert {tuple(r) for r in leveling.level_stats(leveling.live(entries)).collect()} == {(0, 1, 1), (1, 1, 5)}


def test_triggers(spark):
    stats = spark.createDataFrame([(0, 4, 0), (0, 3, 10**9), (1, 9, 10_000_000), (1, 1, 10_000_001), (2, 1, 100_000_001)], "level int, files long, bytes long")
    assert [r.due for r in leveling.due(stats).collect()] == [True, False, False, True, True]


def test_candidates_hold_a_containing_segment(spark):
    rows = [(0, 1, "a", "m", "n", 1, False), (1, 1, "b", "x", "y", 1, False), (2, 2, "wide", "a", "z", 1, False), (3, 2, "off", "o", "p", 1, False)]
    got = leveling.candidates(leveling.live(spark.createDataFrame(rows, ENTRY)), 1)
    assert {r.filename for r in got.collect()} == {"a", "wide"}
