"""Reads by key: segment pruning, single and many keys, ranges, prefixes, and the sparse-index seek.

Segment tables (one row a segment) are small and are broadcast only up to SEGMENTS rows; beyond that, CUTS of their
start keys slice the key space, each segment goes to the slices it touches, and keys meet it there by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.resolve import snapshot

SEGMENTS, CUTS = 200_000, 128


def contains(start_key: Column, end_key: Column, key: Column) -> Column:
    """Whether a segment's inclusive bounds hold a key."""
    return (start_key <= key) & (key <= end_key)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two inclusive ranges share a key; a range that holds the other whole does."""
    return (start <= other_end) & (other_start <= end)


def get(log: DataFrame, key) -> DataFrame:
    """(key, value, seq) of one visible key; no row if there is none."""
    return snapshot(log.where(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The visible of many keys (`keys`: key). Spark broadcasts the keys if they are few and joins by a shuffle if not."""
    return snapshot(log.join(keys.select("key").distinct(), "key", "left_semi"))


def range_scan(log: DataFrame, low=None, high=None) -> DataFrame:
    """The visible keys from `low` to `high`, both included; None is no bound."""
    for bound, test in ((low, F.col("key").__ge__), (high, F.col("key").__le__)):
        log = log if bound is None else log.where(test(F.lit(bound)))
    return snapshot(log)


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with `prefix`; None if there is none."""
    cut = bytes(prefix).rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_scan(log: DataFrame, prefix) -> DataFrame:
    """The visible keys that begin with `prefix`; written as a range too, so that it reaches the scan."""
    low = log.where(F.col("key") >= F.lit(prefix))
    if isinstance(prefix, str):
        return snapshot(low.where(F.startswith("key", F.lit(prefix))))
    high = successor(prefix)
    return snapshot(low if high is None else low.where(F.col("key") < F.lit(high)))


def prune(keys: DataFrame, segments: DataFrame) -> DataFrame:
    """(key, segment_id) of the segments (segment_id, start_key, end_key) whose bounds hold a key."""
    keys, few = keys.select("key"), segments.select("segment_id", "start_key", "end_key")
    inside = contains(F.col("start_key"), F.col("end_key"), F.col("key"))
    if few.limit(SEGMENTS + 1).count() <= SEGMENTS:
        return keys.join(F.broadcast(few), inside).select("key", "segment_id")
    picked = few.select("start_key").distinct().orderBy(F.xxhash64("start_key")).limit(CUTS)
    cuts = F.array(*[F.lit(r[0]) for r in picked.orderBy("start_key").collect()])
    slice_of = lambda k: F.size(F.filter(cuts, lambda c: c <= k))
    spread = few.withColumn("slice", F.explode(F.sequence(slice_of(F.col("start_key")), slice_of(F.col("end_key")))))
    return keys.withColumn("slice", slice_of(F.col("key"))).join(spread, "slice").where(inside).select("key", "segment_id")


def seek(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(segment_id, key, start_byte): for each key (segment_id, key), the last index entry at or before it.

    An as-of join: entries and keys are sorted together in each segment and the last entry is carried on. Keys before
    the first entry get a null.
    """
    entries = index.select("segment_id", "key", F.col("start_byte").alias("at"), F.lit(0).alias("side"))
    probes = keys.select("segment_id", "key", F.lit(None).cast("long").alias("at"), F.lit(1).alias("side"))
    order = Window.partitionBy("segment_id").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = entries.unionByName(probes).withColumn("start_byte", F.last("at", ignorenulls=True).over(order))
    return rows.where("side = 1").select("segment_id", "key", "start_byte")
