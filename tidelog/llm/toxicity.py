"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A sentence ends at . ! ? or a line break. Its score is the logistic of a bias plus the weights of its words and of
their first 4, 5 and 6 bytes. Training takes a document's score for 1 - prod(1 - sentence score). Only document labels are
known there, so the gradient reaches a sentence in proportion to its share of the blame, and the sentences that carry
the toxicity are found by the same scores.

A document is rated by the same product over its offending sentences (0.5 or more); one that has none gets the score of
its worst sentence. So slight scores do not add up with length, and a text joined from texts below 0.5 stays below 0.5.

Fitting is bounded: at most `per_class` labelled documents of each class (those with the least hash of doc_id) are
gathered in one task, long ones as well, in the order of the hash as long as they fit into `total_bytes`; class
weights make up for the share each class had. Scoring covers every whole text. Labels are read from rows with crc32(doc_id as text) mod 5 <> 0 only, and neither labels
nor lang, source or doc_id enter a score.

Defined results: null and empty texts, and texts without words, score 0.0. Repeated rows get equal scores. Labels
that are null or not 0/1 are ignored; without labels of both classes every score is 0.0. Extra columns pass through.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnum as T

PREFIXES = (4, 5, 6)
SLICE = 1 << 20
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    names: np.ndarray  # sorted hashes of features
    weights: np.ndarray
    bias: float
    sieve: np.ndarray  # 2^20 flags by the low bits of names

    @staticmethod
    def make(names: np.ndarray, weights: np.ndarray, bias: float) -> Model:
        order = np.argsort(names)
        sieve = np.zeros(1 << 20, bool)
        sieve[(names & T.U((1 << 20) - 1)).astype(np.int64)] = True
        return Model(names[order], weights[order], bias, sieve)


def _instances(data: np.ndarray, at: np.ndarray):
    """Features of the texts with offsets `at`: (feature hash, sentence), and of each sentence its text, first and end byte."""
    low, high = int(at[0]), int(at[-1])
    part = data[low:high]
    part = part + (((part >= 65) & (part <= 90)) * np.uint8(32))
    inside = _WORD[part]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    edge = np.unique(at[:-1][at[:-1] < high] - low)
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    stops = np.cumsum(_STOP[part])
    doc = np.searchsorted(at, first + low, "right") - 1
    place = stops[first] + doc * (int(stops[-1]) + 1) if len(first) else first
    new = np.diff(place, prepend=-1) != 0
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(first)) - 1 if len(heads) else heads
    names = [T.span_hashes(part, first, last)]
    which = [sentence]
    for k in PREFIXES:
        long = np.flatnonzero(last - first > k)
        names.append(T.mix(T.span_hashes(part, first[long], first[long] + k) + T.U(k)))
        which.append(sentence[long])
    return np.concatenate(names), np.concatenate(which), doc[heads], first[heads] + low, last[tails] + low


def _vocabulary(data: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names, sorted, of the features that enough documents of a class have; memory is that of a slice and of the names."""
    vocab, counts = np.zeros(0, T.U), np.zeros((2, 0), np.int32)
    for low, high in T.groups_of(at, SLICE):
        names, sentence, owner, _, _ = _instances(data, at[low : high + 1])
        owner = owner[sentence]
        order = np.lexsort((owner, names))
        names, owner = names[order], owner[order]
        once = np.ones(len(names), bool)
        once[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        names, owner = names[once], owner[once] + low
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
        toxic = np.add.reduceat(y[owner], first) if len(first) else np.zeros(0)
        new, names = np.stack([toxic, np.diff(np.append(first, len(names))) - toxic]).astype(np.int32), names[first]
        spot = np.searchsorted(vocab, names)
        known = vocab[np.minimum(spot, len(vocab) - 1)] == names if len(vocab) else np.zeros(len(names), bool)
        counts[:, spot[known]] += new[:, known]
        vocab, counts = np.insert(vocab, spot[~known], names[~known]), np.insert(counts, spot[~known], new[:, ~known], axis=1)
    return vocab[counts.max(0) >= max(1, min(6, int(y.sum()) // 10))]


def fit(texts, labels, share: tuple[float, float] = (1.0, 1.0), rounds: int = 150, rate: float = 2.0, sparse: float = 3e-3) -> Model:
    """Train by full-batch gradient steps with momentum; `share` weighs the two classes.

    After each step weights shrink by `rate * sparse` towards 0 (an L1 penalty), so what many toxic documents share wins over
    what is rare in each. Features of fewer than 6 documents of a class (or of a tenth as many as are toxic) are left out.
    """
    y = np.asarray(labels, float)
    empty = Model.make(np.zeros(0, T.U), np.zeros(0), -60.0)
    if not len(y) or y.min() == y.max():
        return empty
    data, at = T.utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    vocab = _vocabulary(data, at, y)
    if not len(vocab):
        return empty
    slices, docs, count = [], [], 0  # of each slice its sentences, how many features each has, and the features
    for low, high in T.groups_of(at, SLICE):
        names, sentence, owner, _, _ = _instances(data, at[low : high + 1])
        spot = np.minimum(np.searchsorted(vocab, names), len(vocab) - 1)
        real = vocab[spot] == names
        pair = np.unique(sentence[real] * len(vocab) + spot[real])  # a feature counts once in a sentence
        slices.append((slice(count, count + len(owner)), np.bincount(pair // len(vocab), minlength=len(owner)).astype(np.int32), (pair % len(vocab)).astype(np.int32)))
        docs.append(owner + low)
        count += len(owner)
    docs = np.concatenate(docs)
    theta, bias = np.zeros(len(vocab)), -6.0
    pace, bias_pace = np.zeros(len(vocab)), 0.0
    cost = np.where(y > 0, share[1], share[0])
    has = np.bincount(docs, minlength=len(y)) > 0
    z = np.empty(count)
    for _ in range(rounds):
        for part, size, name in slices:
            z[part] = bias + np.bincount(np.repeat(np.arange(len(size)), size), theta[name], minlength=len(size))
        np.clip(z, -30, 30, out=z)
        s = 1 / (1 + np.exp(-z))
        p = np.clip(-np.expm1(-np.bincount(docs, np.logaddexp(0, z), minlength=len(y))), 1e-9, 1)
        dz = s * ((1 - y / p) * cost * has)[docs]
        pace *= 0.9
        for part, size, name in slices:
            pace += np.bincount(name, np.repeat(dz[part], size), minlength=len(vocab)) / y.sum()
        bias_pace = 0.9 * bias_pace + dz.sum() / y.sum()
        theta -= rate * pace
        theta = np.sign(theta) * np.maximum(0, np.abs(theta) - rate * sparse)
        bias -= rate * bias_pace
    strong = np.abs(theta) > 1e-3
    return Model.make(vocab[strong], theta[strong], float(bias))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, total_bytes: int = 24 << 20) -> Model:
    """Fit on the labelled documents that are not held out; `per_class` and `total_bytes` bound what one task gathers, the driver gets the weights."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return fit([], [])
    order = F.xxhash64("doc_id", F.lit(8))
    chosen = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    picked = chosen[0].union(chosen[1])  # 2 * per_class rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("size").alias("size"))
    fitting, left = [], total_bytes
    for doc_id, toxic, size, _ in sorted(sizes.withColumn("hash", order).collect(), key=lambda r: (r.hash, r.doc_id)):
        if size <= left:
            fitting.append((doc_id, toxic))
            left -= size
    if not fitting:
        return fit([], [])
    picked = docs.sparkSession.createDataFrame(fitting, "doc_id long, toxic int")
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions("doc_id", "text")
    got = rows.mapInArrow(_fitted(totals), "names array<long>, weights array<double>, bias double").collect()  # one row
    return Model.make(np.array(got[0].names, np.int64).view(T.U), np.array(got[0].weights, float), got[0].bias) if got else fit([], [])


def _fitted(totals: dict[int, int]):
    """Fit in one task on what `train` has bounded, (doc_id, text, toxic) in order; `totals` are the rows each class has in all."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        data, at = T.utf8(table["text"])
        first: dict[bytes, int] = {}
        for k in range(len(table)):  # of equal texts the first
            first.setdefault(hashlib.md5(data[at[k] : at[k + 1]]).digest(), k)
        chosen = pa.array(first.values(), pa.int64())
        y = table["toxic"].take(chosen).to_pylist()
        n = [max(1, y.count(0)), max(1, y.count(1))]
        scale = [totals[k] / n[k] for k in (0, 1)]
        top = max(scale)
        model = fit(table["text"].combine_chunks().take(chosen), y, (scale[0] / top, max(scale[1] / top, 0.2)))
        columns = [pa.array([model.names.view(np.int64)], pa.list_(pa.int64())), pa.array([model.weights], pa.list_(pa.float64())), pa.array([model.bias], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["names", "weights", "bias"])
        del held, table, data, at
        pa.default_memory_pool().release_unused()  # the worker lives on
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _rate(column, model: Model, found: bool):
    data, at = T.utf8(column)
    scores, places = [], []
    for low, high in T.groups_of(at, SLICE):
        names, which, docs, first, last = _instances(data, at[low : high + 1])
        z = np.full(len(docs), model.bias)
        if len(model.names):
            hit = np.flatnonzero(model.sieve[(names & T.U((1 << 20) - 1)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(model.names, names[hit]), len(model.names) - 1)
            real = model.names[spot] == names[hit]
            which, spot, name = which[hit][real], spot[real], names[hit][real]
            order = np.lexsort((name, which))
            which, spot = which[order], spot[order]
            once = np.ones(len(which), bool)
            once[1:] = (np.diff(which) != 0) | (np.diff(spot) != 0)
            z += np.bincount(which[once], model.weights[spot[once]], minlength=len(docs))
        z = np.clip(z, -60, 30)
        worst = np.full(high - low, -np.inf)
        np.maximum.at(worst, docs, z)
        joined = -np.expm1(-np.bincount(docs, np.logaddexp(0, z) * (z >= 0), minlength=high - low))
        scores.append(np.maximum(joined, 1 / (1 + np.exp(-worst))))
        if found:
            base = int(at[low])
            chars = np.concatenate([[0], np.cumsum((data[base : int(at[high])] & 0xC0) != 0x80, dtype=np.int32)])
            bad = np.flatnonzero(z >= 0)
            cut = np.searchsorted(docs[bad], np.arange(high - low + 1))
            for i in range(high - low):
                own = bad[cut[i] : cut[i + 1]]
                places.append([{"start": int(chars[first[k] - base] - chars[at[low + i] - base]), "end": int(chars[last[k] - base] - chars[at[low + i] - base]), "score": float(1 / (1 + np.exp(-z[k])))} for k in own])
    return np.concatenate(scores) if scores else np.zeros(0), places


def score(model: Model):
    """Column function: score of a text, 0 to 1."""

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        return pa.array(_rate(text, model, False)[0], pa.float64())

    return toxicity


def offending(model: Model):
    """Column function: sentences scored 0.5 or more, as code point ranges from the first word's start to the last word's end."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<start:bigint,end:bigint,score:double>>")
    def sentences(text: pa.Array) -> pa.Array:
        return pa.array(_rate(text, model, True)[1], kind)

    return sentences


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) for every row of `docs`."""
    model = train(docs, labels)
    rated = docs.select("doc_id", score(model)("text").alias("score"), offending(model)("text").alias("offending"))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score below 0.5, columns as they are."""
    model = train(docs, labels)
    return docs.withColumn("__toxicity", score(model)("text")).where("__toxicity < 0.5").drop("__toxicity")
