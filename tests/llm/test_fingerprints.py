"""Local consistency, neighbours in order, and likeness."""

import hashlib
import random

import numpy as np

from tidelog.llm import fingerprints as P


def names(data, levels):
    s, d = P._BYTES[np.frombuffer(data, np.uint8)], np.zeros(len(data), np.int64)
    for _ in range(levels):
        s, d = P.parse(s, d)
    return s.tolist()


def test_equal_substrings_share_their_inside():
    rnd = random.Random(1)
    some = lambda n: bytes(rnd.choice(b"abcdefghij aaaa") for _ in range(n))
    common = some(4000)
    for level, lost in ((1, 12), (2, 14), (3, 16)):
        for _ in range(5):
            a, b = (names(some(rnd.randint(0, 300)) + common + some(rnd.randint(0, 300)), level) for _ in range(2))
            inside = names(common, level)[lost:-lost]
            assert len(inside) > 20
            find = lambda s: any(s[i : i + len(inside)] == inside for i in range(len(s)))
            assert find(a) and find(b)


def test_phrases_are_short_and_parse_is_per_text():
    rnd = random.Random(2)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 400))) for _ in range(50)] + [b"a" * 1000, b"", b"x"]
    assert P.fingerprints(texts) == [P.fingerprints([t])[0] for t in texts]
    assert len(names(b"a" * 1000, 1)) == 1
    size = [len(names(bytes(rnd.randrange(256) for _ in range(9000)), k)) for k in (0, 1, 2)]
    assert 2 < size[0] / size[1] < 5 and 2 < size[1] / size[2] < 5


def test_results(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    docs = [(k * 3, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((1, 3, 60, 900))))) for k in range(150)]
    docs += [(7, None), (8, ""), (1000, docs[5][1]), (10, "é" * 50)]
    for n in (len(docs), 1):
        rows = P.compared(spark.createDataFrame(docs[:n], "doc_id long, text string")).collect()
        order = sorted(docs[:n], key=lambda d: -d[0])
        after = {d: order[(k + 1) % n][1] or "" for k, (d, _) in enumerate(order)}
        assert len(rows) == n
        for r in rows:
            text = dict(docs)[r.doc_id] or ""
            cut = text[: len(text) - len(text) // 3] + after[r.doc_id][: len(text) // 3]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(cut.encode()).hexdigest()
            assert [r.fingerprint, r.edited_fingerprint] == P.fingerprints([text.encode(), cut.encode()])
            assert 0 <= r.near_edited <= 1 and r.near_next == P.likeness(r.fingerprint, P.fingerprints([after[r.doc_id].encode()])[0])
    long = [r for r in P.compared(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.n_chars > 200]
    assert all(r.near_edited > 0.25 > 0.1 > r.near_next for r in long if r.doc_id not in (15, 18, 1000))
    prints = {r.doc_id: r.fingerprint for r in long}
    assert 15 not in prints or prints[15] == prints[1000]


def test_column(spark):
    df = spark.createDataFrame([("some text to print",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(P.fingerprint("text")).collect()] == [*P.fingerprints([b"some text to print"]), "", ""]
