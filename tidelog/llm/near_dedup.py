"""MinHash near-duplicate groups by tensored banding, every link verified on full shingle sets.

Signature. 2*GROUPS small collections of ROWS minhashes each: A_1..A_GROUPS and B_1..B_GROUPS. The table keys are
the GROUPS^2 pairs (A_i, B_j), so 256 tables of six minhashes cost 96 minhashes instead of 1,536. A pair of sets
with Jaccard similarity J meets in some table with probability (1 - (1 - J^3)^16)^2: at the threshold 0.85 it is
missed with probability 5e-7, less above it.

Plan. Documents with equal shingle sets form one class, whose least doc_id stands for it. A_i or B_j keys held by
one class only cannot make a shared table key, so pairs are only formed from keys held by two or more. Each bucket
links its members to its least member (a star, found by a combined minimum, never by listing the bucket's pairs).
The stars are verified on whole texts and give components. A pair that shares a bucket but is still in two
components is then compared in the residual pass: buckets are cut into blocks of BLOCK members, block pairs are
spread over tasks, each pair is looked at in the first table it shares, and a 512-bin one-permutation sketch (5.5
standard errors of slack) and the size bound admit it to the verification on full sets. A bucket's largest component,
if it is larger than a block, has blocks of its own that meet the other components' only, so a hot group of near copies
costs in proportion to its size, not its square. No bucket is capped and no candidate dropped by count.

Defined results: null or blank texts have an empty set (n_shingles 0), are linked with nothing and kept. Rows with
the same doc_id count as one document. A null doc_id gets its text's component (null if no numbered row has that
text) and is not kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnum as T
from tidelog.llm.components import components
from tidelog.llm.scratch import Scratch, spark_of

GROUPS, ROWS, BINS, BLOCK = 16, 3, 512, 256
BROADCAST = 1_000_000  # ids, 8 bytes each, sent to all executors at most; more are joined by a shuffle
SLICE = 1 << 21
_SEEDS = T.mix(np.arange(1, 4 * GROUPS * ROWS + 1, dtype=T.U) * T.U(77777))


def _sets(column, low: int, high: int, size: int, data, at) -> list[np.ndarray]:
    names, docs = T.words(data, at[low : high + 1])
    return T.sets(*T.shingles(names, docs, high - low, size), high - low)


def _features(size: int):
    def run(batches):
        for batch in batches:
            data, at = T.utf8(batch.column(1))
            counts, digests, keys = [], [], []
            for low, high in T.groups_of(at, SLICE):
                found = _sets(batch.column(1), low, high, size, data, at)
                full = [x for x in found if len(x)]
                if full:
                    cat = np.concatenate(full)
                    first = np.concatenate([[0], np.cumsum([len(x) for x in full])[:-1]])
                    sig = np.empty((len(full), 2 * GROUPS * ROWS), dtype=T.U)
                    for k in range(sig.shape[1]):
                        sig[:, k] = np.minimum.reduceat((cat ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | T.U(1)), first)
                    with np.errstate(over="ignore"):
                        rows = (sig.reshape(-1, 2 * GROUPS, ROWS) * T._STEP[:ROWS]).sum(2, dtype=T.U)
                        key = iter(T.mix(rows + np.arange(2 * GROUPS, dtype=T.U) * T.U(0x1F3D5B79A1C3E5F7)).view(np.int64))
                for x in found:
                    counts.append(len(x))
                    digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    keys.append(next(key) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys"])

    return run


def _sketches(size: int):
    """One byte for each of BINS ranges of the hash space: of the least shingle in it, 0 if there is none."""

    def run(batches):
        for batch in batches:
            data, at = T.utf8(batch.column(1))
            counts, out = [], []
            for low, high in T.groups_of(at, SLICE):
                for x in _sets(batch.column(1), low, high, size, data, at):
                    bins, first = np.unique(x >> T.U(64 - 9), return_index=True)
                    sketch = np.zeros(BINS, np.uint8)
                    sketch[bins.astype(np.int64)] = 1 + (T.mix(x[first]) % T.U(255)).astype(np.uint8)
                    counts.append(len(x))
                    out.append(sketch.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(out, pa.binary())], ["cid", "text", "n", "sketch"])

    return run


def _verified(size: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = T.utf8(batch.column(2)), T.utf8(batch.column(3))
            keep = []
            for low, high in T.groups_of(a[1] + b[1], SLICE):
                for x, y in zip(_sets(None, low, high, size, *a), _sets(None, low, high, size, *b), strict=True):
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
            rows = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(rows.columns, ["a", "b"])

    return run


def _blocks(percent: int):
    """Pairs of one block pair (rows sorted by it) that the sketch and the sizes admit."""

    def compare(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows["cid"], kind="stable")
        cid, comp, n, chunk, sketch, a = (rows[k][order] for k in ("cid", "comp", "n", "chunk", "sketch", "a"))
        across = rows["lo"][0] != rows["hi"][0]
        left, right = [], []
        for i in range(len(cid) - 1):
            j = np.arange(i + 1, len(cid))
            j = j[(comp[j] != comp[i]) & (cid[j] != cid[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if across:
                j = j[chunk[j] != chunk[i]]
            if len(j):
                one, rest = sketch[i], sketch[j]
                used = ((rest > 0) | (one > 0)).sum(1)
                same = ((rest == one) & (one > 0)).sum(1)
                t = percent / 100
                union = np.maximum((n[j] + n[i]) / (1 + t), used)  # of sets at the threshold; the bins sample it without replacement
                j = j[same + 2 >= used * (t - 5.5 * np.sqrt(t * (1 - t) / used * (1 - used / union)))]
            if len(j):  # a holds the tables' keys in ascending order
                shared = (a[j][:, :, None] == a[i][None, None, :]).any(2)
                j = j[a[j, shared.argmax(1)] == rows["key"][0]]
            if len(j):
                left.append(np.full(len(j), cid[i]))
                right.append(cid[j])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(left), cat(right)

    def run(batches):
        rest: dict[str, np.ndarray] | None = None
        names = ("key", "lo", "hi", "cid", "comp", "n", "chunk")

        def tables(column, cid):
            """The keys of each row, sorted, with marks of its own in place of the missing."""
            out = np.repeat(np.arange(len(cid))[:, None], GROUPS, 1) - (1 << 62)
            sizes = np.asarray(column.value_lengths())
            out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(k) for k in sizes])] = column.flatten().to_numpy()
            return np.sort(np.where(out < len(cid) - (1 << 62), (-(1 << 62)) - cid[:, None], out), 1)

        def pairs(rows, start, end):
            return compare({k: v[start:end] for k, v in rows.items()})

        for batch in batches:
            now = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            raw = b"".join(batch.column(len(names)).to_pylist())
            now["sketch"] = np.frombuffer(raw, np.uint8).reshape(-1, BINS)
            now["a"] = tables(batch.column(len(names) + 1), now["cid"])
            if rest is not None:
                now = {k: np.concatenate([rest[k], now[k]]) for k in now}
            change = np.flatnonzero((np.diff(now["key"]) != 0) | (np.diff(now["lo"]) != 0) | (np.diff(now["hi"]) != 0)) + 1
            cuts, out = [0, *change.tolist()], []
            for start, end in zip(cuts, cuts[1:], strict=False):
                out.append(pairs(now, start, end))
            rest = {k: v[cuts[-1] :] for k, v in now.items()}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]).astype(np.int64)) for i in (0, 1)], ["a", "b"])
        if rest is not None and len(rest["cid"]):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in pairs(rest, 0, len(rest["cid"]))], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text); see the module's head.

    Two documents are linked if 100 * |common shingles| >= percent * |all shingles|; component_id is the least
    doc_id reachable by links, kept marks the row that carries it.
    """
    spark = spark_of(docs)
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = scratch.keep(rows.mapInArrow(_features(size), "doc_id long, n_shingles long, digest binary, keys array<long>"), "features")
    classes = feats.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("keys").alias("keys"))
    classes = scratch.keep(classes, "classes")

    each = classes.where("cid is not null").select("cid", F.posexplode("keys").alias("at", "key"))
    shared = each.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("key")
    alive = each.join(shared, "key").groupBy("cid").agg(F.collect_set(F.when(F.col("at") < GROUPS, F.col("key"))).alias("a"), F.collect_set(F.when(F.col("at") >= GROUPS, F.col("key"))).alias("b"))
    alive = scratch.keep(alive.where("size(a) > 0 and size(b) > 0"), "alive")

    tables = alive.select("cid", F.explode("a").alias("x"), "b").select("cid", "x", F.explode("b").alias("y")).select("cid", F.xxhash64("x", "y").alias("k"))
    pivots = tables.groupBy("k").agg(F.min("cid").alias("p"), F.max("cid").alias("q")).where("p < q").select("k", "p")
    stars = scratch.keep(tables.join(pivots, "k").where("cid > p").select(F.col("p").alias("a"), F.col("cid").alias("b")).distinct(), "stars")

    members = scratch.keep(stars.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "members")
    few = F.broadcast(members) if members.count() <= BROADCAST else members
    texts = rows.join(few, rows.doc_id == few.cid).select("cid", "text").dropDuplicates(["cid", "text"])
    texts = scratch.keep(texts.mapInArrow(_sketches(size), "cid long, text string, n long, sketch binary"), "texts")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        left, right = texts.select(F.col("cid").alias("a"), F.col("text").alias("x")), texts.select(F.col("cid").alias("b"), F.col("text").alias("y"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
        return scratch.keep(both.mapInArrow(_verified(size, percent), "a long, b long"), name)

    first = links(stars, "links")
    found = components(first, scratch, "c1")

    label = members.join(found, members.cid == found.node, "left").select("cid", F.coalesce("component", "cid").alias("comp"))
    in_a = alive.select("cid", "a", F.explode("a").alias("key")).join(label, "cid")
    by_comp = in_a.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = by_comp.groupBy("key").agg(F.sum("m").alias("s"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).where("s > 2 and comps > 1")
    # a component that fills blocks of its own is only held against the rest of the bucket, never against itself
    most = F.when(F.col("top.m") > BLOCK, F.col("top.m")).otherwise(0)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", F.when(most > 0, F.col("top.comp")).alias("top"), blocks(most).alias("own"), blocks(F.col("s") - most).alias("rest"))
    open_rows = in_a.join(mixed, "key").join(texts.select("cid", "n", "sketch"), "cid").withColumn("in_top", F.coalesce(F.col("comp") == F.col("top"), F.lit(False)))
    at = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    open_rows = open_rows.withColumn("chunk", F.when(F.col("in_top"), at(F.col("own"))).otherwise(F.col("own") + at(F.col("rest"))))
    others = F.sequence(F.when(F.col("in_top"), F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("rest") - 1)
    spread = open_rows.select("key", "cid", "comp", "n", "chunk", "sketch", "a", F.explode(others).alias("other"))
    spread = spread.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "cid", "comp", "n", "chunk", "sketch", "a")
    spread = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = spread.mapInArrow(_blocks(percent), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    second = links(scratch.keep(pairs, "pairs"), "links2")
    if second.head(1):
        found = components(first.union(second), scratch, "c2")
    scratch.drop("alive", "stars", "texts", "pairs")

    final = classes.join(found, classes.cid == found.node, "left").select("digest", F.coalesce("component", "cid").alias("component_id"))
    out = feats.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    whole = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of `docs` whose document stands for its group, columns as they are.

    Where ids are missing or repeated, rows are told apart by a hash of doc_id and text: of each group of linked or equal
    texts one row stays, and every row without words does.
    """
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").head(1):
        kept = near_duplicates(docs, percent, size).where("kept").select(F.col("doc_id").alias("__kept"))
        return docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    named = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    kept = near_duplicates(named.select(F.col("__row").alias("doc_id"), "text"), percent, size).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    out = named.join(kept, F.col("__row") == F.col("__kept"), "left_semi")
    worded = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    return out.where(~worded).unionByName(out.where(worded).dropDuplicates(["__row"])).drop("__row")
