"""Near-duplicate groups against all pairs of full shingle sets."""

import random
import re

import pytest

from tidelog.llm import near_dedup


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent):
    sets = {d: shingle_set(t) for d, t in docs}
    component = {d: d for d in sets}

    def root(d):
        while component[d] != d:
            d = component[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                component[high] = low
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def corpus(rnd):
    vocabulary = [f"word{k}" for k in range(400)]
    docs = []
    for k in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((2, 5, 30, 120, 400)))]
        for _ in range(rnd.choice((1, 1, 2, 5))):
            copy = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 5, 9))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs.append((len(docs), " ".join(copy).upper() if k % 5 == 0 else "\n".join(copy)))
    chain = [rnd.choice(vocabulary) for _ in range(200)]
    for k in range(30):  # neighbours are alike, ends are not
        chain = chain[4:] + [rnd.choice(vocabulary) for _ in range(4)]
        docs.append((1000 + k, " ".join(chain)))
    return docs + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "One  TWO"), (2005, "one two three")]


@pytest.mark.parametrize("percent", [85, 80])
def test_like_all_pairs(spark, percent):
    docs = corpus(random.Random(percent))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, percent)
    kept = near_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in brute(docs, percent).items() if v[2])


def hot(rnd):
    """A large group of near copies, and texts that share tables with it without being linked to its least member."""
    base = [f"word{rnd.randrange(400)}" for _ in range(150)]
    docs = []
    for k in range(90):
        copy = list(base)
        for at in rnd.sample(range(150), 2 if k < 60 else rnd.choice((3, 4, 5, 6))):
            copy[at] = f"x{k}y{at}"
        docs.append((k, " ".join(copy)))
    return docs


@pytest.mark.parametrize("block", [4, 16])
def test_blocks_of_a_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    for docs in (hot(random.Random(block)), corpus(random.Random(2))):
        got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, 85)


def test_members_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST", 0)
    docs = corpus(random.Random(1))[:60]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, 85)


def test_missing_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(1), "a"), (None, text(2), "b"), (None, text(2), "b"), (7, text(3), "c"), (7, text(4), "d"), (8, text(4) + " more", "e"), (None, None, "f"), (None, "", "g"), (9, text(1), "h")]
    got = [(r.text, r.kept) for r in near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()]
    assert sorted((t or "").split(" ")[0] for t, _ in got) == ["", "", "w1x0", "w2x0", "w3x0", "w4x0"]
    assert {k for _, k in got} >= {"b", "c", "f", "g"}
