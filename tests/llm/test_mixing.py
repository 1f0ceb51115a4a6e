"""Targets by hand, sampling against a plain reading of the rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing


def goals(sizes):
    """Targets by repeated sharing, as the rule is stated."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 3 * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 5, None: 7}, {"a": 0, "b": 3}, {None: 5}, {f"s{k}": 10 ** (k % 5) for k in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in mixing.targets(df).collect()}
    for s, t in goals(sizes).items():
        assert got[s].target == pytest.approx(t)
        assert got[s].epochs * sizes[s] + got[s].rest == pytest.approx(t) and 0 <= got[s].rest <= max(sizes[s], 1e-6)


def test_sampling_fills_the_targets(spark):
    rnd = random.Random(4)
    docs = [(k, " ".join(["word"] * rnd.randint(0, 60)) + " 1!" * rnd.randint(0, 30), rnd.choice(["a"] * 6 + ["b", "c", None])) for k in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mixed(df).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    sums = {s: sum(n for d, n in size.items() if source[d] == s) for s in set(source.values())}
    want = goals(sums)
    keys = {r.doc_id: (r.key, r.doc_id) for r in df.select("doc_id", mixing.key_of(F.col("doc_id"), F.col("text"), mixing.quality_of(F.col("text")), 10).alias("key")).collect()}
    for s, t in want.items():
        mine = [r for r in rows if source[r.doc_id] == s]
        epochs, so_far, rest = int(t // sums[s]), 0, t - t // sums[s] * sums[s]
        for r in sorted(mine, key=lambda r: keys[r.doc_id]):
            n = size[r.doc_id]
            more = rest > 0 and (so_far + n <= rest or (so_far < rest and 2 * (rest - so_far) >= n))
            assert (r.size, r.source_size, r.taken) == (n, sums[s], (epochs + more) * n) and r.target == pytest.approx(t)
            so_far += n
        assert abs(sum(r.taken for r in mine) - t) <= max(size.values())
    assert {r.doc_id: r.taken for r in mixing.mixed(df.repartition(7)).collect()} == {r.doc_id: r.taken for r in rows}
    out = mixing.mix(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {r.doc_id: r.times for r in rows if r.times}


def test_missing_and_repeated_ids_are_taken(spark):
    rows = [(None, f"text {k} words", "a") for k in range(20)] + [(5, f"other {k} words here", "b") for k in range(20)] + [(6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    goal = goals({"a": 60, "b": 80, None: 0})
    assert abs(taken["a"] - goal["a"]) <= 3 and abs(taken["b"] - goal["b"]) <= 4
