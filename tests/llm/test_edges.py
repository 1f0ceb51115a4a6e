"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: a defined result for every operator."""

import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, fingerprints, line_dedup, main_text, mixing, near_dedup, personal_data, queries, token_counts, token_files, toxicity

LONG = "many words of a long text " * 8000
ROWS = [
    (1, "a plain text of six words", "en", "s1"), (1, "a plain text of six words", "en", "s1"), (None, "a plain text of six words", None, None), (None, None, None, None),
    (2, None, "en", "s1"), (3, "", "de", "s2"), (4, " \n\t ", "de", None), (5, LONG, "en", "s2"), (6, "x" * 50_000, "fr", "s2"), (7, "é ü ñ 😀\r\nzeile", "fr", "s3"),
]
EXTRA = ["part", "words", "key", "n", "size", "digest", "score", "rest", "target", "class", "name", "host", "kept", "times", "label", "found", "base", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "many words of a long text many words of a long"), (None, "x"), (2, None), (3, "few words")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (7, 0), (6, None), (None, 1), (2, 3)], "doc_id long, toxic int")


RUNS = {
    "op1": lambda d, b, lab: decontaminate.matches(d, b),
    "op1_clean": lambda d, b, lab: decontaminate.clean(d, b),
    "op2": lambda d, b, lab: personal_data.digests(d),
    "op3": lambda d, b, lab: token_files.digests(d, queries.byte_bpe()),
    "op4": lambda d, b, lab: token_counts.counted(d, dict([token_counts.word_counter(), token_counts.byte_bpe_counter(queries.byte_bpe())])),
    "op5": lambda d, b, lab: line_dedup.near_lines(d),
    "op5_deduplicated": lambda d, b, lab: line_dedup.deduplicated(d),
    "op6": lambda d, b, lab: near_dedup.near_duplicates(d),
    "op6_deduplicated": lambda d, b, lab: near_dedup.deduplicated(d),
    "op7": lambda d, b, lab: main_text.main_text(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.col("source"))),
    "op8": lambda d, b, lab: toxicity.scored(d, lab),
    "op8_clean": lambda d, b, lab: toxicity.clean(d, lab),
    "op9": lambda d, b, lab: fingerprints.compared(d),
    "op10": lambda d, b, lab: mixing.mixed(d),
    "op10_mix": lambda d, b, lab: mixing.mix(d),
}
EVERY_ROW = {"op2", "op3", "op5_deduplicated", "op6", "op7", "op8", "op9", "op10"}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(docs, bench, labels, name):
    rows = RUNS[name](docs, bench, labels).collect()
    if name in EVERY_ROW:
        assert len(rows) == len(ROWS)
    if name == "op1":
        assert [(r.doc_id, r.item_id, r.similarity) for r in rows] == [(5, 1, 1.0)]
    if name in ("op2", "op9", "op7", "op8"):  # equal texts, equal results
        same = {tuple(r[c] for c in r.__fields__ if c in ("n_email", "spans", "fingerprint", "text", "score")) for r in rows if ("doc_id" in r and r.doc_id == 1) or ("page_id" in r and r.page_id == 1)}
        assert len(same) == 1
    if name == "op6":
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
        assert got[1, 2] == (1, True) and got[None, 2] == (1, False) and got[2, 0] == (2, True) and got[None, 0] == (None, False)
    if name == "op10":
        assert all(r.taken <= 3 * r.size for r in rows) and {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    if name.endswith(("clean", "mix", "deduplicated")):
        assert set(rows[0].__fields__) >= {"doc_id", "text", *EXTRA}


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(docs, bench, labels, name):
    df = RUNS[name](docs.limit(0), bench.limit(0), labels.limit(0))
    assert df.collect() == []
    assert df.columns == RUNS[name](docs, bench, labels).columns
