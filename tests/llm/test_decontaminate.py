"""Decontamination against every window by brute force, and native plans."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidelog.llm import decontaminate as D

VOCABULARY = [f"w{k}" for k in range(300)]


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(text, item):
    t, i = words(text), words(item)
    if len(t) < 5 or len(i) < 5:
        return None
    m, best = min(len(t), len(i)), None
    for start in range(max(0, len(t) - len(i)) + 1):
        x, y = shingles(t[start : start + m]), shingles(i)
        common = sum((x & y).values())
        s = common / (sum(x.values()) + sum(y.values()) - common)
        if s >= 0.8 and (best is None or s > best[0]):
            best = (s, start)
    return best


def test_like_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n: [rnd.choice(VOCABULARY) for _ in range(n)]
    items = [text(rnd.choice((4, 5, 12, 40, 90))) for _ in range(12)]
    docs = []
    for k in range(60):
        body, item = text(rnd.randint(0, 150)), list(rnd.choice(items))
        for _ in range(rnd.choice((0, 0, 1, 2, 8))):
            item[rnd.randrange(len(item))] = "edit"
        at = rnd.randint(0, len(body))
        docs.append((k, " ".join(body[:at] + (item if k % 3 else []) + body[at:])))
    docs.append((99, " ".join(items[2] * 3)))
    bench = [(k, ", ".join(i).upper()) for k, i in enumerate(items)]
    expected = {(d, i): b for d, t in docs for i, x in bench if (b := brute(t, x))}
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for shingles_sent in (2_000_000, 0):  # broadcast or shuffled
        got = D.matches(*args, broadcast_shingles=shingles_sent).collect()
        assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in got} == {k: (round(s, 9), at) for k, (s, at) in expected.items()}
    assert len(expected) >= 15
    left = {r.doc_id for r in D.clean(*args).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in expected}


def test_reordered_items_are_found(spark):
    part = lambda c, n: [f"{c}{k}" for k in range(n)]
    swapped = part("b", 30) + part("a", 30)
    docs = [(1, part("x", 40) + swapped + part("y", 40)), (2, swapped), (3, swapped + part("y", 9)), (4, part("x", 9) + swapped), (5, part("a", 30) + part("x", 40)), (6, part("b", 26) + part("a", 26))]
    docs = [(k, " ".join(w)) for k, w in docs] + [(1, " ".join(part("x", 7) + swapped))]  # another text of doc_id 1
    item = " ".join(part("a", 30) + part("b", 30))
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string")
    expected = {}
    for d, t in docs:
        if b := brute(t, item):
            expected[d] = max(expected.get(d, b), b, key=lambda x: (x[0], -x[1]))
    for shingles_sent in (2_000_000, 0):
        got = D.matches(*args, broadcast_shingles=shingles_sent).collect()
        assert {r.doc_id: (round(r.similarity, 9), r.start) for r in got} == {k: (round(s, 9), at) for k, (s, at) in expected.items()}
    assert set(expected) == {1, 2, 3, 4}


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(400):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), D.RADIUS):
            b ^= 1 << bit
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((k, signed(a), signed(b)))
    df = spark.createDataFrame(rows, "k long, a long, b long")
    hit = F.lit(False)
    for k, (o, bits) in enumerate(D.BLOCKS):
        hit = hit | _near(k, o, bits)
    assert df.where(~hit).count() == 0


def _near(k, o, bits):
    return F.exists(D._near_values(k, D._block(F.col("a"), o, bits), bits), lambda e: e["value"] == D._block(F.col("b"), o, bits))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    plan = D.matches(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_clean_tells_rows_apart_without_ids(spark):
    item = " ".join(f"item{k}" for k in range(20))
    docs = spark.createDataFrame([(None, f"before {item} after"), (None, "clean text of more than five words"), (3, item), (3, "another clean text of some words"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.text or "")[:7] for r in D.clean(docs, bench).collect()) == ["", "another", "clean t"]
