"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component being the least node reachable.

    Self loops and nulls are ignored, repeated edges count once; an empty table gives an empty result. Each step
    only takes minima (combined before the shuffle) and joins back on the node, so a hub is never gathered.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before, turn = scratch.keep(pairs, f"{name}-0"), None, 0
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before or mark[0] == 0:
            break
        before, turn = mark, turn + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = scratch.keep(small, f"{name}-{turn}")
        if turn > 1:
            scratch.drop(f"{name}-{turn - 1}")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(roots)
