"""Newest version wins: from a change-log to what is visible.

`snapshot` is the way to read: deletions are dropped after the newest version is found, never before, or older values
would come back. The aggregate is combined before the shuffle, so the versions of a hot key meet as one row a task.
A filter on `key` is pushed below the aggregate to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import DELETE, UPDATE, effective


def latest(log: DataFrame) -> DataFrame:
    """(key, value, op, seq): the newest change of each key; the value of a deletion is null."""
    payload = F.struct(effective(F.col("value"), F.col("op")).alias("value"), F.col("op"), F.col("seq"))
    newest = log.groupBy("key").agg(F.max_by(payload, "seq").alias("m"))
    return newest.select("key", "m.value", "m.op", "m.seq")


def snapshot(log: DataFrame) -> DataFrame:
    """(key, value, seq) of the keys that are visible."""
    return latest(log).where(F.col("op") == UPDATE).select("key", "value", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The snapshot after the change `seq`."""
    return snapshot(log.where(F.col("seq") <= seq))


def tombstones(log: DataFrame) -> DataFrame:
    """(key, seq) of the keys whose newest change is a deletion."""
    return latest(log).where(F.col("op") == DELETE).select("key", "seq")


def merge(runs: list[DataFrame], drop_tombstones: bool = False) -> DataFrame:
    """One run from several: the newest version of each key. Deletions stay unless nothing older can lie below."""
    newest = latest(reduce(DataFrame.unionByName, runs))
    return newest.where(F.col("op") == UPDATE) if drop_tombstones else newest


def layered(runs: list[DataFrame]) -> DataFrame:
    """The newest version of each key by position: the first run of the list that has the key, whatever `seq` says."""
    tagged = [run.select("key", "value", "op", F.lit(k).alias("layer")) for k, run in enumerate(runs)]
    payload = F.struct(effective(F.col("value"), F.col("op")).alias("value"), "op")
    newest = reduce(DataFrame.unionByName, tagged).groupBy("key").agg(F.min_by(payload, "layer").alias("m"))
    return newest.where(F.col("m.op") == UPDATE).select("key", "m.value")


def deletions(log: DataFrame) -> DataFrame:
    """(key, seq, was_present) of each deletion: whether it hid a visible value."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("seq"))
    rows = log.select("key", "seq", "op", before.alias("before")).where(F.col("op") == DELETE)
    return rows.select("key", "seq", (F.coalesce("before", F.lit(DELETE)) == UPDATE).alias("was_present"))


def size_of(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def live_bytes(log: DataFrame) -> DataFrame:
    """One row, `bytes`: keys and values of the snapshot."""
    return snapshot(log).agg(F.coalesce(F.sum(size_of(F.col("key"), F.col("value"))), F.lit(0)).cast("long").alias("bytes"))


def flush_points(log: DataFrame, limit: int, buckets: int = 1, slices: int = 1 << 16) -> DataFrame:
    """(bucket, seq, bytes): in each bucket of keys, the first change after which the changes so far exceed `limit` bytes.

    `buckets` splits the log by key hash, as a store with so many tails would. Sizes only add up, so no bucket is ordered
    whole: `slices` equal ranges of `seq`, which counts changes, are summed up (combined before the shuffle) and tell the one
    slice of a bucket in which the limit is passed, and that alone is ordered.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int") if buckets > 1 else F.lit(0)
    rows = log.select(bucket.alias("bucket"), "seq", size_of(F.col("key"), effective(F.col("value"), F.col("op"))).alias("bytes"))
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slices))
    rows = rows.withColumn("slice", F.floor((F.col("seq") - F.lit(low or 0)) / F.lit(width)))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket", "slice").agg(F.sum("bytes").alias("all"))  # at most buckets * slices rows
    sums = sums.withColumn("ahead", F.coalesce(F.sum("all").over(before), F.lit(0))).where((F.col("ahead") <= limit) & (F.col("ahead") + F.col("all") > limit))
    passed = rows.join(sums, ["bucket", "slice"])
    so_far = F.col("ahead") + F.sum("bytes").over(Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = passed.select("bucket", "seq", so_far.alias("bytes")).where(F.col("bytes") > limit)
    return passed.groupBy("bucket").agg(F.min("seq").alias("seq"), F.min_by("bytes", "seq").cast("long").alias("bytes"))
