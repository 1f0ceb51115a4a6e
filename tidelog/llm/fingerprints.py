"""Document fingerprints by locally consistent parsing.

A text is a string of bytes. At each level equal neighbours are joined to runs, then deterministic coin tossing labels
every symbol from itself and the one before: twice the lowest bit where they differ, plus that bit. Repeated TOSSES
times this leaves labels below 6 that still differ between neighbours; a phrase begins at each local maximum. A phrase
is named by a hash of its symbols, and the names are the next level's string. Which symbols begin a phrase depends on
a few neighbours only, so equal substrings get equal names inside, wherever they lie.

The fingerprint is a minhash sketch (SLOTS bytes, hex) of the names at levels 3 and up, phrases of about 20 bytes and
more; a text with fewer than ENOUGH names at a level gives those of the level below too. Equal texts have equal
fingerprints; the empty text has the empty one. `likeness` compares two fingerprints.

Neighbours in doc_id order are found by one exchange: ids are cut into ranges, each range is sorted in its task, and the
first document of a range is sent along to the range before it.

Defined results: null texts are empty. Rows of one doc_id follow each other by text; rows without one come last. A
single row's next document is itself. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textnum as T
from tidelog.llm.scratch import spark_of

TOSSES, LEVELS, FIRST, ENOUGH, SLOTS = 4, 6, 3, 8, 128
SHARD, SLICE = 32 << 20, 1 << 19
_WEIGHTS = T.mix(np.arange(1, 257, dtype=T.U)) | T.U(1)
_SEEDS = T.mix(np.arange(1, 2 * SLOTS + 1, dtype=T.U) * T.U(0x5851F42D4C957F2D))
_LOW_BIT = np.array([0] + [(k & -k).bit_length() - 1 for k in range(1, 256)], np.uint8)
_BYTES = T.mix(np.arange(256, dtype=T.U) + T.U(1 << 40))


def _lowest(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit of each (nonzero) 64-bit value."""
    bit = (x & (~x + T.U(1))).astype(np.float64)  # a power of two is exact
    return (np.frexp(bit)[1] - 1).astype(np.uint8)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 that differ between neighbours of a text; `first` marks the first symbol of each text."""
    before = np.roll(names, 1)
    low = _lowest(np.where(first, T.U(1), names ^ before))
    label = (low << 1 | (names >> low.astype(T.U) & T.U(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(TOSSES - 1):
        before = np.roll(label, 1)
        low = np.where(first, 0, _LOW_BIT[label ^ before]).astype(np.uint8)
        label = (low << 1 | (label >> low & 1)).astype(np.uint8)
    return label


def parse(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: phrase names and their texts. `docs` ascends."""
    with np.errstate(over="ignore"):
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(names))).astype(T.U)
        names, docs = T.mix(names[at] + length * T.U(0x2545F4914F6CDD1D)), docs[at]  # runs
        first = np.ones(len(docs), bool)
        first[1:] = docs[1:] != docs[:-1]
        label = _labels(names, first).astype(np.int8)
        left, right = np.roll(label, 1), np.roll(label, -1)
        left[first] = 127
        last = np.roll(first, -1)
        right[last] = -1
        start = first | ((label > left) & (label > right))
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(names)))
        place = np.arange(len(names)) - np.repeat(at, size)
        sums = np.add.reduceat(names * _WEIGHTS[place & 255], at)
        return T.mix(sums + size.astype(T.U)), docs[at]


def fingerprints(texts: list[bytes]) -> list[str]:
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    docs = np.repeat(np.arange(n), [len(t) for t in texts])
    out = [""] * n
    if not len(data):
        return out
    names, levels = _BYTES[data], []
    for _ in range(LEVELS):
        names, docs = parse(names, docs)
        levels.append((names, docs, np.bincount(docs, minlength=n)))
    picked, owners = [], []
    for k, (names, docs, _) in enumerate(levels):
        if k + 1 >= FIRST:
            picked.append(names)
            owners.append(docs)
        else:
            few = (levels[k + 1][2] < ENOUGH)[docs]
            picked.append(names[few])
            owners.append(docs[few])
    names, docs = np.concatenate(picked), np.concatenate(owners)
    order = np.argsort(docs, kind="stable")
    names, docs = names[order], docs[order]
    at = np.flatnonzero(np.diff(docs, prepend=-1))
    sketch = np.empty((len(at), SLOTS), np.uint8)
    for k in range(SLOTS):
        least = np.minimum.reduceat((names ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | T.U(1)), at)
        sketch[:, k] = (T.mix(least) & T.U(255)).astype(np.uint8)
    for k, doc in enumerate(docs[at].tolist()):
        out[doc] = sketch[k].tobytes().hex()
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1, of two fingerprints: the share of equal slots less what chance gives."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(v), np.uint8) for v in (a, b))
    return max(0.0, (float((x == y).mean()) - 1 / 256) / (1 - 1 / 256))


def fingerprint(text: Column | str) -> Column:
    """Column expression: the fingerprint of a text."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        data, at = T.utf8(column)
        out = []
        for low, high in T.groups_of(at, SLICE):
            out += fingerprints([data[at[i] : at[i + 1]].tobytes() for i in range(low, high)])
        return pa.array(out, pa.string())

    return run(text)


def edited(text: str, after: str) -> str:
    """`text` with its last third (rounded down) replaced by as much of the beginning of `after`."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _rate(rows: list[tuple[int | None, str]], follower: str):
    """A batch of results; `rows` in order, `follower` the text after the last."""
    texts = [t for _, t in rows] + [follower]
    changed = [edited(t, texts[k + 1]) for k, (_, t) in enumerate(rows)]
    raw = [t.encode() for t in changed]
    prints = fingerprints([t.encode() for t in texts] + raw)
    own, other = prints[: len(texts)], prints[len(texts) :]
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()),
        pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(own[:-1]), pa.array(other),
        pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)]), pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)]),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _in_order(batches):
    """Rows (part, extra, doc_id, text) in order; the extra row of a part only follows its last document."""
    held, size, part = [], 0, None
    for batch in batches:
        columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        for p, extra, doc_id, text in zip(*columns, batch.column(3), strict=True):
            text = text.as_py()
            if held and (p != part or extra or size > SLICE):
                yield _rate(held, text)
                held, size = [], 0
            part = p
            if not extra:
                held.append((doc_id, text))
                size += len(text)


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of `docs` (doc_id, text).

    A document is held against itself with its last third replaced by the beginning of the next (descending doc_id,
    after the last the first), and against that next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tops = _range_tops(rows)
    last = max(0, len(tops) - 1) + int(bool(len(tops)) and bool(rows.where("doc_id is null").head(1)))
    dealt = rows.select(_range_of(tops)("doc_id").alias("r"), "doc_id", "text").select(F.col("r.part").alias("part"), F.col("r.top").alias("top"), F.lit(False).alias("extra"), "doc_id", "text")
    heads = dealt.where("top").groupBy("part").agg(F.min("text").alias("text"))  # one row a range
    before = F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1)
    heads = heads.select(before.cast("int").alias("part"), F.lit(True).alias("extra"), F.lit(None).cast("long").alias("doc_id"), "text")
    both = dealt.drop("top").union(heads)
    own = _own_partition(_partition_keys(spark_of(docs), last + 1))("part")
    both = both.repartition(last + 1, own).sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return both.mapInArrow(_in_order, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _range_tops(rows: DataFrame) -> np.ndarray:
    """Greatest doc_id of each of the ranges of about SHARD bytes that ids are cut into, ascending. Only ids are exchanged, and a number a range comes back."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = rows.select("doc_id").where("doc_id is not null").repartitionByRange(max(12, -(-total // SHARD)), "doc_id")
    tops = ids.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("top")).select("top").toArrow()
    return np.sort(tops.column(0).to_numpy())


def _partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers that hash partitioning deals to n partitions, one each; by their own hash ranges would share some and leave others empty."""
    ids = spark.range(64 * n).select(F.col("id").cast("int").alias("id"))
    found = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).toArrow()
    keys = np.arange(n, dtype=np.int32)
    keys[found["p"].to_numpy()] = found["id"].to_numpy()
    return keys


def _own_partition(keys: np.ndarray):
    @F.arrow_udf("int")
    def key(part: pa.Array) -> pa.Array:
        return pa.array(keys[part.to_numpy()], pa.int32())

    return key


def _range_of(tops: np.ndarray):
    """Column function: the range of an id, the highest ids first and null last, and whether the id begins it."""
    kind = pa.struct([("part", pa.int32()), ("top", pa.bool_())])

    @F.arrow_udf("struct<part:int,top:boolean>")
    def place(ids: pa.Array) -> pa.Array:
        none = np.asarray(ids.is_null())
        at = np.searchsorted(tops, ids.fill_null(0).to_numpy(zero_copy_only=False))
        part = np.where(none, len(tops), len(tops) - 1 - at).astype(np.int32)
        top = none | (tops[np.minimum(at, len(tops) - 1)] == ids.fill_null(0).to_numpy(zero_copy_only=False)) if len(tops) else none
        return pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array(top, pa.bool_())], fields=list(kind))

    return place
