"""Sorted runs: bounds, offsets, sparse index, footers and splits, for tables with a `segment_id` column.

Windows are partitioned by segment, which a store keeps near its byte target, so no window spans the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.encoding import pointer_size, record_size

STRIDE = 1000
SPLIT_BYTES = 2_000_000
RANGE_RECORDS, RANGE_BYTES = 1 << 19, 1 << 26  # what a task sorts at most, about
RANGE_LIMITS = 8  # but a range is as long as so many parts


def bounds(segments: DataFrame) -> DataFrame:
    """(segment_id, start_key, end_key, records, bytes) of each segment (segment_id, key, value, op)."""
    size = record_size(F.col("key"), F.col("value"), F.col("op"))
    return segments.groupBy("segment_id").agg(
        F.min("key").alias("start_key"), F.max("key").alias("end_key"), F.count("*").alias("records"), F.sum(size).alias("bytes")
    )


def offsets(segments: DataFrame) -> DataFrame:
    """The rows with their place in the segment: `record` from 0, `start_byte` and `length` of the encoded record."""
    order = Window.partitionBy("segment_id").orderBy("key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("length", record_size(F.col("key"), F.col("value"), F.col("op")))
    return rows.withColumns({
        "record": (F.row_number().over(order) - 1).cast("long"),
        "start_byte": F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"),
    })


def sparse_index(segments: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(segment_id, key, start_byte, length) of every `stride`-th record."""
    return offsets(segments).where(F.col("record") % stride == 0).select("segment_id", "key", "start_byte", "length")


def footers(segments: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(segment_id, index_start_byte, length, index_entries): length is the first index entry's."""
    rows = bounds(segments)
    entries = F.ceil(F.col("records") / F.lit(stride)).cast("long")
    return rows.select("segment_id", F.col("bytes").alias("index_start_byte"), pointer_size(F.col("start_key")).alias("length"), entries.alias("index_entries"))


def _greedy(limit: int, starts: list[tuple[int, int]]):
    """Numbers sorted rows; `starts` tells for each range the part open where it begins and the bytes that part has."""

    def run(batches):
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(batch.num_columns - 1).to_numpy()
            part, used = state or starts[batch.column(batch.num_columns - 2)[0].as_py()]
            ahead = np.cumsum(sizes) - sizes
            parts = np.empty(len(sizes), np.int64)
            row = least = 0
            while True:
                cut = max(int(np.searchsorted(ahead, ahead[row] + limit - used, "right")), least)
                parts[row:cut] = part
                if cut == len(sizes):
                    break
                part, used, row, least = part + 1, 0, cut, cut + 1
            state = part, used + int(ahead[-1] + sizes[-1] - ahead[row])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(parts)], [*batch.schema.names[:-2], "part"])

    return run


def _passages(limit: int):
    """What a range (key, range, size) does to a part that is open where it begins, whatever bytes that part has.

    These decide only at which row the first cut is, one of those in the first `limit` bytes or the one after; all rows
    with another outcome than the next are given, with the bytes `ahead` of them in the range, the `cuts` from there on
    and the bytes `left` in the last part. The last row stands for no cut. Only the first has the lowest key, `low`.
    """

    def run(batches):
        low, total = None, 0
        first, at, cuts = (np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            if low is None:
                low, index = batch.column(0)[0], batch.column(1)[0].as_py()
            sizes = batch.column(2).to_numpy()
            ahead = total + np.cumsum(sizes) - sizes
            seen = first[-1] if first.size else -1
            if seen <= limit:
                fresh = np.unique(ahead[: np.searchsorted(ahead, limit, "right") + 1])
                fresh = fresh[fresh > seen]
                first, at, cuts = np.append(first, fresh), np.append(at, fresh), np.append(cuts, np.ones_like(fresh))
            going = np.flatnonzero(at + limit < ahead[-1])
            while going.size:
                at[going] = ahead[np.searchsorted(ahead, at[going] + limit, "right")]
                cuts[going] += 1
                going = going[at[going] + limit < ahead[-1]]
            total = int(ahead[-1] + sizes[-1])
        if low is None:
            return
        told = np.append((cuts[1:] != cuts[:-1]) | (at[1:] != at[:-1]), True)
        ahead = np.append(first[told], np.iinfo(np.int64).max)
        lows = pa.array([low.as_py()] + [None] * (len(ahead) - 1), low.type)
        columns = [pa.array(np.full(len(ahead), index, np.int32)), lows, pa.array(ahead), pa.array(np.append(cuts[told], 0)), pa.array(np.append(total - at[told], total))]
        yield pa.RecordBatch.from_arrays(columns, ["range", "low", "ahead", "cuts", "left"])

    return run


def _entries(limit: int):
    """(range, low, part, used) of each range from the passages of all in order: a number or two are carried over."""

    def run(batches):
        last, passed, part, used = None, True, 0, 0
        for batch in batches:
            out = []
            for index, low, ahead, cuts, left in zip(*(c.to_pylist() for c in batch.columns)):
                if index != last:
                    last, passed = index, False
                    out.append((index, low, part, used))
                if not passed and ahead > limit - used:
                    part, used, passed = part + cuts, left if cuts else used + left, True
            kinds = [pa.int32(), batch.schema.field("low").type, pa.int64(), pa.int64()]
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["range", "low", "part", "used"])

    return run


def _range_of(key: Column, lows: list, kind: str) -> Column:
    """The last range whose lowest key is not above `key`, found by halving; null is above all keys."""
    if len(lows) == 1:
        return F.lit(0)
    table = F.array(*[F.lit(low).cast(kind) for low in lows])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((len(lows) - 1).bit_length()))])
    reached = lambda at: (at < len(lows)) & F.coalesce(F.get(table, at) <= key, key.isNull())
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at + step), at + step).otherwise(at))


def split_greedily(run: DataFrame, limit: int = SPLIT_BYTES, ranges: int = 1) -> DataFrame:
    """The rows of a run with `range` and `part`: a part closes once its encoded records exceed `limit` bytes.

    The count starts anew after each part, which no window expresses, so a task carries it over sorted rows. With one
    range the parts are those of one stream, though no task has it whole: the keys are dealt into ranges of bounded size,
    one pass tells what each does to any count it may be entered with, which one small task follows from range to range,
    and the next numbers the rows. So the run is read four times (its size, Spark's bounds, the two passes) and must be
    the same each time. Null keys come last, without bytes. Rows of one key, which a run has once, stay in one range. More
    ranges split the key space first and each inside.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    size = F.coalesce(record_size(F.col("key"), F.col("value"), F.col("op")), F.lit(0)).alias("__size")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in run.schema)
    sized, order, starts = run.select("*", size), [F.col("key").asc_nulls_last(), F.col("__size")], [(0, 0)]
    if ranges > 1:
        dealt = sized.repartitionByRange(ranges, "key").withColumn("__range", F.lit(0))
    else:
        kind, lows = run.schema["key"].dataType.simpleString(), [None]
        records, total = sized.agg(F.count("*"), F.coalesce(F.sum("__size"), F.lit(0))).first()
        bounded = min(max(-(-records // RANGE_RECORDS), -(-total // RANGE_BYTES)), total // max(1, RANGE_LIMITS * limit))
        if bounded > 1:
            cut = sized.select("key", "__size").repartitionByRange(bounded, order[0]).sortWithinPartitions(*order)
            passages = cut.select("key", F.spark_partition_id().alias("range"), "__size").mapInArrow(_passages(limit), f"range int, low {kind}, ahead long, cuts long, left long")
            entries = passages.repartition(1).sortWithinPartitions("range", "ahead").mapInArrow(_entries(limit), f"range int, low {kind}, part long, used long")
            found = sorted(entries.collect(), key=lambda row: row["range"])
            lows, starts = [row["low"] for row in found], [(row["part"], row["used"]) for row in found]
        dealt = sized.withColumn("__range", _range_of(F.col("key"), lows, kind)).repartitionById(len(lows), F.col("__range"))
    rows = dealt.sortWithinPartitions(*order).select(*run.columns, "__range", "__size")
    parts = rows.mapInArrow(_greedy(limit, starts), f"{kinds}, part long")
    return parts.withColumn("range", F.spark_partition_id().cast("long") if ranges > 1 else F.lit(0).cast("long"))
