"""The ledger against a plain recount."""

from collections import Counter

from tidelog.llm import queries, token_counts
from tidelog.llm.scratch import Scratch

DOC = "doc_id long, source string, lang string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, DOC)


def totals(ledger):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens, r.chars) for r in ledger.totals().collect()}


def recount(rows):
    out = Counter()
    for _, s, lang, t in rows:
        for k, v in enumerate((1, len((t or "").split()), len(t or ""))):
            out[s, lang, k] += v
    keys = {k[:2] for k in out}
    return {(s, lang, "words@1"): tuple(out[s, lang, k] for k in range(3)) for s, lang in keys}


def test_deltas(spark):
    ledger = token_counts.Ledger(spark, Scratch(spark, "counts").base, dict([token_counts.word_counter()]))
    assert totals(ledger) == {}
    rows = [(1, "a", "en", "one two"), (2, "a", "de", "drei"), (3, None, None, None), (4, "b", "en", "x y z"), (4, "b", "en", "x y z")]
    assert ledger.commit("first", inserts=table(spark, rows)) and totals(ledger) == recount(rows)
    assert not ledger.commit("first", inserts=table(spark, rows)) and totals(ledger) == recount(rows)
    revised = [(1, "b", "en", "moved and longer"), (9, "c", "en", "new")]
    assert ledger.commit("second", revisions=table(spark, revised), deletes=table(spark, [(2, None, None, None), (77, None, None, None)]))
    now = [r for r in rows if r[0] not in (1, 2)] + revised
    assert totals(ledger) == recount(now)
    ledger.commit("third", deletes=table(spark, [(k, None, None, None) for k in (1, 4, 9)]))
    assert totals(ledger) == recount([r for r in now if r[0] == 3])
    again = token_counts.Ledger(spark, ledger.folder, ledger.tokenizers)  # state lies in the folder
    assert not again.commit("third", inserts=table(spark, rows)) and totals(again) == totals(ledger)
    ledger.commit("empty", inserts=table(spark, []))
    assert totals(ledger) == totals(again) and len(ledger.commits()) == 4


def test_a_lost_race_is_summed_anew(spark, monkeypatch):
    folder = Scratch(spark, "counts").base
    mine, other = (token_counts.Ledger(spark, folder, dict([token_counts.word_counter()])) for _ in range(2))
    publish, rows = mine.files.publish, [(1, "a", "en", "one")]

    def late(name, data):
        monkeypatch.setattr(mine.files, "publish", publish)
        other.commit("theirs", inserts=table(spark, rows))
        return publish(name, data)

    monkeypatch.setattr(mine.files, "publish", late)
    assert mine.commit("mine", inserts=table(spark, rows)) and totals(mine) == recount(rows * 2)


def test_tokens_of_the_public_vocabulary(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    rows = [(k, "s", "en", f"Some text, number {k}! " * k) for k in range(8)]
    version, counter = token_counts.byte_bpe_counter(queries.byte_bpe())
    got = token_counts.counted(table(spark, rows), {version: counter}).collect()
    assert [(r.documents, r.tokens) for r in got] == [(8, sum(len(tokenizer.encode(r[3], add_special_tokens=False).ids) for r in rows))]
