"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits of the lower-cased text; features are 5-word shingles, weighted by how often they
occur in the window. A window is as long as the benchmark item it is held against (a text shorter than the item is one
window). Of all windows that hold as many shared shingles as the threshold asks for, those are laid that end with a
shared shingle or start the text: what a window has in common with an item rises only where a shared shingle comes in,
so the earliest of the best windows is among them, in whatever order the text has the item's shingles.

Each window and each item has a 64-bit SimHash, cut into 6 blocks. If two fingerprints differ in at most RADIUS = 23
bits, some block differs in at most 3 of them (6 * 4 = 24 > 23), so probing each block against the item blocks with up
to 3 bits flipped finds every fingerprint within the radius. At similarity 0.8 the expected distance is 9.7 bits with
a deviation of 2.9, so 23 leaves 4.6 deviations. Candidates are verified by the exact weighted similarity
sum(min) / sum(max) of their shingle counts.

The shingles of the benchmark are broadcast only while there are at most `broadcast_shingles` of them (checked by a
count); a larger benchmark is joined by a shuffle. Everything is built-in DataFrame expressions.

Defined results: null texts are empty and match nothing; items of fewer than 5 words are ignored, as no 5-word shingle
tells them from prose; repeated rows of a document give the result once; rows without doc_id or item_id are ignored
in `matches`, while `clean` needs no ids of documents; empty tables give no matches. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch, spark_of

SIZE, RADIUS = 5, 23
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # offset, bits
NEAR = 3


def word_list(text: Column) -> Column:
    """Words of a text; an empty array for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingle_list(words: Column) -> Column:
    """5-word shingles of an array of five words at least, in order and with repeats."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (SIZE - 1)), lambda i: F.array_join(F.slice(words, i, SIZE), " "))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of an array of strings; each occurrence is one vote."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def votes(bit: Column) -> Column:
        on = lambda h: F.when(F.call_function("shiftright", h, bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(1)).otherwise(F.lit(-1))
        return F.aggregate(hashes, F.lit(0), lambda s, h: s + on(h))

    one = F.lit(1).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: F.when(votes(b) > 0, acc.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(acc))


def weighted_similarity(x: Column, y: Column) -> Column:
    """sum(min) / sum(max) over the counts of two arrays."""
    count = lambda a, e: F.size(F.filter(a, lambda v: v == e))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, e: s + F.least(count(x, e), count(y, e)))
    return common / (F.size(x) + F.size(y) - common)


def _block(fp: Column, offset: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _flips(bits: int) -> list[int]:
    return [sum(1 << k for k in c) for r in range(NEAR + 1) for c in combinations(range(bits), r)]


def _near_values(k: int, value: Column, bits: int) -> Column:
    """Block k's values with up to NEAR bits flipped."""
    masks = F.array(*[F.lit(m).cast("long") for m in _flips(bits)])
    return F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value")))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, broadcast_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, similarity, start) of every document and item with a window of similarity `threshold` or more.

    `similarity` is the best window's, `start` the first word of the earliest such window.
    """
    scratch = Scratch(spark_of(docs), "leaks")
    items = benchmark.where("item_id is not null").select("item_id", word_list(F.col("text")).alias("words")).where(F.size("words") >= SIZE)
    items = items.select("item_id", F.size("words").alias("length"), shingle_list(F.col("words")).alias("item"))
    items = scratch.keep(items.withColumn("item_fp", simhash(F.col("item"))).dropDuplicates(), "items")

    spots = items.select("length", F.explode("item").alias("s")).select(F.xxhash64("s").alias("h"), "length").distinct()
    few = spots.count() <= broadcast_shingles
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("digest"))  # rows of one doc_id may differ
    listed = texts.select("doc_id", "digest", word_list(F.col("text")).alias("words")).where(F.size("words") >= SIZE)
    at = listed.select("doc_id", "digest", "words", F.explode(F.sequence(F.lit(0), F.size("words") - SIZE)).alias("i"))
    five = F.concat_ws(" ", *[F.get("words", F.col("i") + k) for k in range(SIZE)])
    places = at.select("doc_id", "digest", F.size("words").alias("n"), "i", F.xxhash64(five).alias("h")).join(F.broadcast(spots) if few else spots, "h")
    places = places.groupBy("doc_id", "digest", "n", "length").agg(F.sort_array(F.collect_set("i")).alias("places"))
    sizes = F.least("n", "length") + F.col("length") - 2 * (SIZE - 1)  # shingles of window and item
    need = F.greatest(F.lit(1), F.ceil(sizes * (threshold / (1 + threshold)) - 1e-9)).cast("int")
    places = places.withColumn("need", need).where(F.size("places") >= F.col("need"))
    ends = places.select("doc_id", "digest", "length", "need", "places", F.posexplode("places").alias("k", "end"))
    full = (F.col("k") + 1 >= F.col("need")) & (F.get("places", F.col("k") - F.col("need") + 1) >= F.col("end") + SIZE - F.col("length"))
    starts = ends.where(full).select("doc_id", "digest", "length", F.greatest(F.lit(0), F.col("end") + SIZE - F.col("length")).alias("start")).distinct()
    # only hashes are exchanged, and the texts that have windows are fetched again
    fetched = texts.join(starts.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "length")).alias("laid")), ["doc_id", "digest"])
    windows = fetched.select("doc_id", word_list(F.col("text")).alias("words"), "laid").select("doc_id", "words", F.inline("laid"))
    windows = windows.select("doc_id", "start", "length", F.slice("words", F.col("start") + 1, F.col("length")).alias("window")).distinct()
    windows = windows.select("doc_id", "start", "length", shingle_list(F.col("window")).alias("window"))
    windows = scratch.keep(windows.withColumn("fp", simhash(F.col("window"))), "windows")

    values = lambda fp: F.array(*[F.struct(F.lit(k).alias("block"), _block(fp, *b).alias("value")) for k, b in enumerate(BLOCKS)])
    near = [_near_values(k, _block(F.col("item_fp"), o, bits), bits) for k, (o, bits) in enumerate(BLOCKS)]
    index = items.select("item_id", "item_fp", "length", F.explode(F.concat(*near)).alias("e")).select("item_id", "item_fp", "length", "e.*")
    probes = windows.select("doc_id", "start", "length", "fp", F.explode(values(F.col("fp"))).alias("e")).select("doc_id", "start", "length", "fp", "e.*")
    pairs = probes.join(index, ["block", "value", "length"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = pairs.select("doc_id", "start", "length", "fp", "item_id", "item_fp").distinct()
    rated = pairs.join(windows, ["doc_id", "start", "length", "fp"]).join(items.drop("length"), ["item_id", "item_fp"])
    rated = rated.select("doc_id", "item_id", "start", weighted_similarity(F.col("window"), F.col("item")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = rated.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.s")).cast("long").alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` that match no item, columns as they are; the matched documents are joined by a shuffle unless Spark finds them small.

    Rows are named by a hash of doc_id and text, so ids may be missing or repeat.
    """
    named = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    bad = matches(named.select(F.col("__row").alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias("__bad")).distinct()
    return named.join(bad, F.col("__row") == F.col("__bad"), "left_anti").drop("__row")
