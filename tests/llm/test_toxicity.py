"""Held-out accuracy on the labelled documents, blame on sentences, and no leak of labels."""

import os
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_sentences_carry_the_blame(spark):
    good, bad = "The day was fine and the sea was calm", "You are a vile rotten scoundrel"
    docs = [(k, f"{good}. {bad if k % 3 == 0 else 'We went home'}. {good} at {k}!") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in docs], "doc_id long, toxic int")
    rows = toxicity.scored(df, labels).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    for r in rows:
        assert [docs[r.doc_id][1][s.start : s.end] for s in r.offending] == ([bad] if r.doc_id % 3 == 0 else [])
    assert {r.doc_id for r in toxicity.clean(df, labels).collect()} == {k for k, _ in docs if k % 3}


def test_only_texts_and_labels_not_held_out_matter(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 2 == 0, "awful").otherwise("nice")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.scored(docs, x).collect()} for x in (labels, wrong))
    assert one == two and len(set(one.values())) == 2


def test_a_long_document_is_in_the_sample(spark):
    long = "The sea was calm and the day was fine. " * 2000
    docs = spark.createDataFrame([(k, f"You are vile. {long}" if k % 2 else f"You are kind. {long}") for k in range(20)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.scored(docs, labels).collect())
    assert toxicity.train(docs, labels, total_bytes=800_000).names.size  # as many as fit
    assert not toxicity.train(docs, labels, total_bytes=1000).names.size


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_length_alone_is_not_toxic(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").collect() if r.text]
    clean = [t for t, s in zip(clean, toxicity._rate(pa.array(clean), model, False)[0], strict=True) if s < 0.5]
    text = "\n".join(clean)
    assert len(text) > 4_000_000
    long = [text[:1_000_000], text[-1_000_000:], text[:4_000_000]]
    assert toxicity._rate(pa.array(long), model, False)[0].max() < 0.5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = toxicity.scored(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    right = sum(r.predicted == r.toxic for r in known) / len(known)
    found = [r.predicted for r in known if r.toxic == 1]
    assert right > 0.97 and sum(found) / len(found) > 0.85  # about one toxic label in 25 has no text to it
