"""What to compact: live segments from the manifest log, level statistics, triggers and candidates.

Entries are (ordinal, level, filename, start_key, end_key, bytes, deleted); `ordinal` is their place in the manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.lookup import overlaps

L0_FILES = 4
LEVEL_BYTES = 1_000_000
FANOUT = 10


def live(entries: DataFrame) -> DataFrame:
    """Added entries that no later removal cancels; one removal cancels one addition, the earliest first.

    The k-th addition and the k-th removal of a (level, filename) belong together.
    """
    nth = F.row_number().over(Window.partitionBy("level", "filename", "deleted").orderBy("ordinal"))
    rows = entries.withColumn("nth", nth)
    gone = rows.where("deleted").select("level", "filename", "nth")
    return rows.where("not deleted").join(gone, ["level", "filename", "nth"], "left_anti").drop("nth", "deleted")


def unmatched_removals(entries: DataFrame) -> DataFrame:
    """(level, filename) of removals that no addition precedes; a sound manifest has none."""
    sign = F.when(F.col("deleted"), -1).otherwise(1)
    left = F.sum(sign).over(Window.partitionBy("level", "filename").orderBy("ordinal"))
    return entries.select("level", "filename", left.alias("left")).where("left < 0").select("level", "filename").distinct()


def level_stats(segments: DataFrame) -> DataFrame:
    """(level, files, bytes) of live segments."""
    return segments.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))


def levels_seen(entries: DataFrame) -> DataFrame:
    """One row, `levels`: how many levels ever had a segment; a level counts on after it empties."""
    return entries.where("not deleted").agg(F.countDistinct("level").alias("levels"))


def due(stats: DataFrame) -> DataFrame:
    """`stats` with `due`: level 0 at L0_FILES files, level n above FANOUT^n * LEVEL_BYTES bytes."""
    budget = F.pow(F.lit(float(FANOUT)), F.col("level")) * LEVEL_BYTES
    return stats.withColumn("due", F.when(F.col("level") == 0, F.col("files") >= L0_FILES).otherwise(F.col("bytes") > budget))


def picks(segments: DataFrame) -> DataFrame:
    """What a compaction of each level starts from: all of level 0, else the level's first segment."""
    first = F.row_number().over(Window.partitionBy("level").orderBy("ordinal"))
    return segments.withColumn("place", first).where("level = 0 or place = 1").drop("place")


def candidates(segments: DataFrame, level: int) -> DataFrame:
    """The picks of `level` and the segments of the next level that overlap their joint range."""
    own = picks(segments.where(F.col("level") == level))
    span = own.agg(F.min("start_key").alias("low"), F.max("end_key").alias("high"))  # one row
    below = segments.where(F.col("level") == level + 1)
    return own.unionByName(below.join(F.broadcast(span), overlaps(F.col("start_key"), F.col("end_key"), F.col("low"), F.col("high")), "left_semi"))
