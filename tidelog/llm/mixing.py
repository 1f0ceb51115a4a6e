"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its count of `[^\\x20\\x09-\\x0D]+`. Sources in code point order, null last, weigh 5, 2, 1,
repeating, and share the sum of all sizes; a target stops at 3 times its source's size and the excess is shared again
by weight, which is min(3 * source size, level * weight) for the one level that gives the whole sum. Complete epochs
come first: floor(target / source size) copies of every document. The rest of the target is filled in the order of
the keys -ln(u) / quality, u a hash of the document, until the budget is reached; the document at the border is taken
if that brings the sum nearer.

Keys are never sorted within a source at large: quantiles of the keys (a mergeable sketch) cut each source into
SLICES ranges, range sums (combined before the shuffle) are prefix-summed, and only the range at the border, about
1/SLICES of a source, is sorted. No step gathers a source in one task.

`quality` is the share of characters that are letters or white space, from 0.05 to 1. Defined results: null and blank
texts have size 0 and take 0 words; a source whose size is 0 has target 0; null is a source of its own. Repeated rows
are taken one by one, in any order, being alike. Reruns agree. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch, spark_of

WEIGHTS, CAP, SLICES = (5, 2, 1), 3, 512


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - odd / F.greatest(F.length(text), F.lit(1)))


def key_of(doc_id: Column, text: Column, quality: Column, seed: int) -> Column:
    """Exponential key; u is 52 bits of md5 over seed, doc_id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / quality


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size) with target and, of that, complete epochs and the rest; one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = totals.withColumn("weight", weigh.cast("double"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") * CAP / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "all": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole),
        "below": F.coalesce(F.sum(F.col("source_size") * CAP).over(by_ratio), F.lit(0)), "below_weight": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)),
    })
    # sources are capped in order of cap / weight; the level rises while that is due and falls after
    level = (F.col("all") - F.col("below")) / (F.col("all_weight") - F.col("below_weight"))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    rows = rows.withColumn("target", F.least(F.col("source_size") * CAP * F.lit(1.0), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    return rows.select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def mixed(docs: DataFrame, seed: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times) for every row of `docs` (doc_id, text, source).

    `times` is how often the mix takes the document, `taken` the words that gives. Columns named in `carry` follow.
    """
    scratch = Scratch(spark_of(docs), "mix")
    rows = docs.select("doc_id", *carry, F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text"), quality_of(F.col("text")), seed).alias("key"))
    rows = scratch.keep(rows, "sizes")
    cuts = F.percentile_approx("key", F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)]), F.lit(10 * SLICES))
    plan = rows.groupBy("source").agg(F.sum("size").alias("source_size"), cuts.alias("cuts"))
    plan = scratch.keep(plan, "sources")
    goal = targets(plan.select("source", "source_size"))
    plan = scratch.keep(plan.join(goal.withColumnRenamed("source", "s").drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "plan")

    slot = F.size(F.filter("cuts", lambda c: c < F.col("key")))
    placed = rows.alias("r").join(plan.select(F.col("source").alias("s"), "cuts"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", *carry, "source", "size", "key", slot.alias("slot"))
    placed = scratch.keep(placed, "placed")
    sums = placed.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ranges = sums.join(plan.drop("cuts").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    ranges = ranges.select("s", F.col("slot").alias("t"), "ahead", "words", "source_size", "target", "epochs", "rest")
    both = placed.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("t")))

    base = ["doc_id", *carry, "size", "source_size", "target", "epochs"]
    full = F.col("ahead") + F.col("words") <= F.col("rest")
    out = F.col("ahead") >= F.col("rest")
    sure = both.where(full | out).select(*base, F.when(full & (F.col("rest") > 0), 1).otherwise(0).alias("more"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    border = both.where(~(full | out)).withColumn("so_far", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = (F.col("so_far") + F.col("size") <= F.col("rest")) | ((F.col("so_far") < F.col("rest")) & (2 * (F.col("rest") - F.col("so_far")) >= F.col("size")))
    near = border.select(*base, F.when(fits, 1).otherwise(0).alias("more"))
    times = (F.col("epochs") + F.col("more")).cast("long")
    return sure.union(near).select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), *carry)


def mix(docs: DataFrame, seed: int = 10) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, columns as they are.

    Rows are named by a hash of doc_id, source and text, so ids may be missing or repeat; rows alike in all three are taken
    equally often, each once more if the budget ends among them.
    """
    named = docs.withColumn("__row", F.xxhash64("doc_id", F.col("source").cast("string"), "text"))
    times = mixed(named, seed, ("__row",)).where("times > 0").select(F.col("__row").alias("__id"), "times").groupBy("__id").agg(F.max("times").alias("__times"))
    out = named.join(times, F.col("__row") == F.col("__id"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).drop("__row", "__id", "__times", "__copy")
