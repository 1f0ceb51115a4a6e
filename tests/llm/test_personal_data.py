"""Base spans by Python's re, discovery of unseen identifiers, and native plans."""

import hashlib
import random
import re

from tidelog.llm import personal_data as P

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def stated(text):
    out = []
    for k, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_like_the_stated_patterns(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("a.@1 2-+()%_9:é\n0") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += [None, "", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4 +1 (234) 555-6789", "4111 1111 1111 1111 and 4111-1111-1111-1112", "a@b.c_d@e.f", "1" * 5000, "1." * 900, "a@a" + ".b" * 900, "é😀 a@b.co", "5" + "-" * 5000 + "5"]
    rows = P.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        base = stated(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in base) for k in STATED], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(r.spans.split(","))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    known = [f"ticket {k}: write to mailbox: user{k}@host{k}.org before noon" for k in range(6)]
    known += [f"the order of the {k} day went to the 4111 1111 1111 1111 desk" for k in range(4)]
    unseen = ["please use mailbox: jane.doe@intranet today", "the 12345 days of the year", "mailbox: nobody home"]
    rows = P.digests(spark.createDataFrame(list(enumerate(known + unseen)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[10].spans == "email:20:37" and rows[10].n_email == 0
    assert rows[11].spans == rows[12].spans == ""  # "the" comes before far more than cards
    assert rows[0].spans == "email:28:43" and [rows[k].n_spans for k in (0, 10, 11)] == [1, 1, 0]


def test_no_python_in_the_plan(spark):
    plan = P.digests(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
