"""Edit join of lines against all pairs."""

import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


points = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
word = st.text("abé", max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(word, word), min_size=1, max_size=12), st.sampled_from([0, 1, 2, 3, 7, 8, 15, 16, 31]))
def test_banded_distance(pairs, most):
    got = L.distances_within([points(a) for a, _ in pairs], [points(b) for _, b in pairs], most)
    assert got.tolist() == [min(distance(a, b), most + 1) for a, b in pairs]


def edit(rnd, text, n):
    for _ in range(n):
        at = rnd.randrange(len(text) + 1)
        text = rnd.choice((text[:at] + rnd.choice("abcé ") + text[at:], text[:at] + text[at + 1 :], text[:at] + "z" + text[at + 1 :]))
    return text


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(24, 40), st.integers(0, 2))
def test_lines_within_two_edits_share_an_entry(seed, length, edits):
    rnd = random.Random(seed)
    a = "".join(rnd.choice("ab") for _ in range(length))
    b = edit(rnd, a, edits)
    if len(b) < L.NEAR:
        return
    (ka, oa, *_), (kb, ob, *_) = (L.entries_of(L._Lines(points(x))) for x in (a, b))
    index = lambda k, o: set(k[(o & np.uint64(1)) == 1].tolist())
    assert set(ka.tolist()) & index(kb, ob) or set(kb.tolist()) & index(ka, oa)


def expected(docs):
    first, copies = {}, {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r\v\f"):
                first.setdefault(line, (doc_id, k))
                copies[line] = copies.get(line, 0) + 1
    lines = list(first)
    near = {x: [y for y in lines if y != x and len(x) >= L.NEAR and len(y) >= L.NEAR and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2] for x in lines}
    out = {}
    for x in lines:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        head = min(first[y] for y in seen)
        out[first[x]] = (copies[x], len(near[x]), *head, head == first[x])
    return out


def test_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)  # groups go through several blocks
    rnd = random.Random(7)
    seeds = ["".join(rnd.choice("abcdefé ") for _ in range(rnd.randint(24, 60))) for _ in range(12)]
    lines = seeds + [edit(rnd, rnd.choice(seeds), rnd.randint(0, 4)) for _ in range(60)] + ["short", "short", "shorT", " ", ""]
    lines += [f"one line that many vary at the end {k:02d}" for k in range(40)]
    docs = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6)))) for k in range(90)] + [(100, None), (101, "\n".join(lines))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = expected(docs)
    for bound in (1_000_000, 0):  # line names broadcast or shuffled
        monkeypatch.setattr(L, "BROADCAST", bound)
        rows = L.near_lines(df).collect()
        assert {(r.doc_id, r.line): (r.copies, r.n_links, r.component_doc, r.component_line, r.kept) for r in rows} == want
    kept = {k for k, v in want.items() if v[-1]}
    for r in L.deduplicated(df).collect():
        text = dict(docs)[r.doc_id]
        assert r.text == (text and "\n".join(x for k, x in enumerate(text.split("\n")) if (r.doc_id, k) in kept or not x.strip()))


def test_edits_grow_with_the_line(spark, monkeypatch):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    seeds = [text(n) for n in (10, 15, 22, 26, 100, 119, 121, 122, 160, 279, 400, 700, 1300)]
    lines = list(seeds)
    for x in seeds:
        lines += [edit(rnd, x, k) for k in (1, 2, 3, len(x) // 50, len(x) // 42, len(x) // 30) if k]
    lines.append(seeds[9].replace(seeds[9][100:104], "WORD"))
    lines = list(dict.fromkeys(lines))
    near = lambda a, b: abs(len(a) - len(b)) <= L.allowed(min(len(a), len(b))) and distance(a, b) <= L.allowed(min(len(a), len(b)))
    want = {k: sum(near(x, y) for y in lines if y != x) for k, x in enumerate(lines)}
    assert want[len(lines) - 1] and sum(n > 0 for n in want.values()) > len(seeds) * 3
    rows = L.near_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in rows} == want
    assert [L.allowed(n).item() for n in (9, 10, 23, 24, 119, 120, 279, 40_000)] == [0, 1, 1, 2, 2, 3, 6, 1000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=70), st.text("ab", max_size=70), st.integers(0, 50)), min_size=1, max_size=6))
def test_distances_of_any_size(pairs):
    got = L.distances_beyond([points(a) for a, _, _ in pairs], [points(b) for _, b, _ in pairs], np.array([m for *_, m in pairs]))
    assert got.tolist() == [distance(a, b) <= m for a, b, m in pairs]


def test_windows_of_long_lines_leave_a_shared_entry():
    rnd = random.Random(3)
    for length in [*range(120, 1300, 37), 2500]:
        a = "".join(rnd.choice("abcdefgh ") for _ in range(length))
        edits, b = int(L.allowed(length)), list(a)
        for k in range(edits):  # evenly spaced, which leaves the shortest stretches
            b[(k + 1) * length // (edits + 1)] = "Z"
        (ka, *_), (kb, *_) = (L.entries_of(L._Lines(points(x))) for x in (a, "".join(b)))
        assert set(ka.tolist()) & set(kb.tolist()), length
        shorter = "".join(x for x in b if x != "Z")  # those characters gone: the other end of what is allowed, a band lower perhaps
        if edits <= L.allowed(len(shorter)):
            kc = L.entries_of(L._Lines(points(shorter)))[0]
            assert set(ka.tolist()) & set(kc.tolist()), length


def test_beyond_the_broadcast_texts_of_candidates_alone_are_kept_and_shuffles_go(spark, monkeypatch):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    lines = [text(rnd.randint(30, 300)) for _ in range(2000)]
    lines += [edit(rnd, x, 1) for x in lines[:40]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    counts, keep = {}, L.Scratch.keep

    def counted(self, table, name):
        out = keep(self, table, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(L.Scratch, "keep", counted)
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    monkeypatch.setattr(L, "BROADCAST", 0)
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = L.near_lines(df)
    for _ in range(100):  # they are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert 80 <= counts["names"] <= counts["texts"] < len(lines) / 2
    assert sum(r.n_links for r in rows.collect()) == 80


def test_a_repeated_line_gives_its_entries_once(monkeypatch):
    monkeypatch.setattr(L, "FLUSH", 1000)  # a flush each slice
    monkeypatch.setattr(L, "SLICE", 400)
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    once, often = (
        sum(len(x) for b in L._entries(6)(iter([pa.RecordBatch.from_pydict({"text": [text] * n})])) for x in b.column(1).to_pylist()) for n in (1, 50)
    )
    assert once == often > 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["ab", "abé", "abж", "ab😀"]), st.integers(0, 300), st.integers(0, 12), st.booleans())
def test_verified_pairs_of_characters_of_any_width(seed, letters, length, edits, repeated):
    rnd = random.Random(seed)
    a = letters * (length // len(letters)) if repeated else "".join(rnd.choice(letters) for _ in range(length))
    b = edit(rnd, a, edits)
    lines = [points(x) for x in (a, b, a[::-1])]
    left, right = np.array([0, 1, 0]), np.array([1, 2, 2])
    texts = [a, b, a[::-1]]
    near = [distance(texts[i], texts[j]) <= L.allowed(min(len(texts[i]), len(texts[j]))) for i, j in zip(left, right, strict=True)]
    assert L._verify(lines, left, right).tolist() == near


def test_what_cannot_end_in_time_is_not_followed():
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    a, b = [text(400) for _ in range(40)], [text(400) for _ in range(40)]
    flat, at, size = L._laid([points(x) for x in a + b])
    words, many = L._words(flat)
    most = np.full(40, 10)
    assert many == 8
    looked = []

    class Counted(np.ndarray):
        def take(self, x, **more):
            looked.append(np.size(x))
            return np.asarray(self).take(x, **more)

    got = L._distances(words.view(Counted), many, at[:40], size[:40], at[40:], size[40:], most)
    assert (got == 11).all()
    assert sum(looked) < 40 * 400  # words; the band of ten edits has 21 cells a column, 40 * 400 * 21 in all
