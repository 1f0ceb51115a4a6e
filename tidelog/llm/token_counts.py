"""Delta-maintained token counts by source, language and tokenizer version.

A ledger is a folder of signed entries, one row a document and tokenizer and batch: an insert adds a document, a delete takes
away what is held of it, a revision does both. Totals are additive: those of a commit are the last totals plus the
batch's entries summed, so a batch costs in proportion to itself; nothing is counted again.

A batch is committed under an id. Its entries and the new totals are written first, under names of their own, then one
small file with the next number makes them count; the file names its batch, and a batch whose id is there is
skipped, so a batch may be sent again after any failure. If another writer took the number, the sum is done anew.
What a failed batch has left behind is never read.

Tokenizer versions are named by the vocabulary's name and digest. Defined results: null texts have 0 tokens and 0
characters; null sources and languages are groups of their own; repeated rows of an insert count one by one; a delete
or revision of a document that is not held takes nothing away, and one without doc_id is ignored (a revision still
inserts). Extra columns are ignored; an empty batch changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textnum as T
from tidelog.llm.scratch import shared_dir
from tidelog.llm.token_files import encoder_of
from tidelog.sources.files import Files

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens", "chars"]
KIND = "source string, lang string, tokenizer string, documents long, tokens long, chars long"


def byte_bpe_counter(path: str) -> tuple[str, Column]:
    """(version, count of tokens as a function of the column `text`) of a byte-level BPE vocabulary file."""
    with open(path, "rb") as file:
        version = f"{os.path.basename(path).split('.')[0]}@{hashlib.sha256(file.read()).hexdigest()[:12]}"

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        encoder = encoder_of(path)
        data, at = T.utf8(text)
        out = []
        for low, high in T.groups_of(at, 1 << 19):
            out += encoder.encode(data, at[low : high + 1])[1].tolist()
        return pa.array(out, pa.int64())

    return version, count(F.col("text"))


def word_counter() -> tuple[str, Column]:
    """Words: runs of anything but ASCII white space."""
    return "words@1", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, Column]):
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers
        self.files = Files(spark, self.folder)
        self.files.make("commits")

    def commits(self) -> list[dict]:
        return [json.loads(self.files.read(f"commits/{n}")) for n in self.files.list("commits") if n.endswith(".json")]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens, chars) as of the last commit."""
        done = self.commits()
        return self._read(f"totals/{done[-1]['name']}") if done else self.spark.createDataFrame([], KIND)

    def _read(self, *names: str) -> DataFrame:
        kind = KIND if names[0].startswith("totals/") else f"doc_id long, {KIND}"
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{n}" for n in names])

    def _counted(self, docs: DataFrame) -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        counts = [F.struct(F.lit(v).alias("tokenizer"), c.alias("tokens")) for v, c in self.tokenizers.items()]
        rows = rows.select("doc_id", "source", "lang", F.length("text").cast("long").alias("chars"), F.array(*counts).alias("counts"))
        return rows.select("doc_id", "source", "lang", "chars", F.explode_outer("counts").alias("c")).select("doc_id", "source", "lang", "c.tokenizer", F.lit(1).cast("long").alias("documents"), "c.tokens", "chars")

    def _held(self, ids: DataFrame) -> DataFrame:
        """What earlier batches hold of documents, negated."""
        names = [f"entries/{c['name']}" for c in self.commits()]
        if not names:
            return self.spark.createDataFrame([], f"doc_id long, {KIND}")
        mine = self._read(*names).join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi")
        sums = mine.groupBy("doc_id", *KEYS).agg(*[(-F.sum(c)).alias(c) for c in SUMS])
        return sums.where("documents <> 0 or tokens <> 0 or chars <> 0")

    def commit(self, batch_id: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Apply a batch: `inserts` and `revisions` (doc_id, source, lang, text), `deletes` (doc_id). False if it is there already."""
        while True:
            done = self.commits()
            if any(c["batch"] == batch_id for c in done):
                return False
            name = uuid.uuid4().hex
            parts = [self._counted(d) for d in (inserts, revisions) if d is not None]
            gone = [d.select("doc_id") for d in (deletes, revisions) if d is not None]
            if gone:
                parts.append(self._held(gone[0] if len(gone) == 1 else gone[0].union(gone[1])))
            delta = parts[0] if parts else self.spark.createDataFrame([], f"doc_id long, {KIND}")
            for p in parts[1:]:
                delta = delta.unionByName(p)
            delta.write.parquet(f"{self.folder}/entries/{name}")
            change = self._read(f"entries/{name}").drop("doc_id")
            totals = self.totals().unionByName(change).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
            totals.where("documents <> 0 or tokens <> 0 or chars <> 0").coalesce(1).write.parquet(f"{self.folder}/totals/{name}")
            if self.files.publish(f"commits/{len(done):012d}.json", json.dumps({"batch": batch_id, "name": name}).encode()):
                return True


def counted(docs: DataFrame, tokenizers: dict[str, Column], folder: str | None = None) -> DataFrame:
    """Totals of a whole table: one batch, sent twice, as after a lost answer; the second is skipped."""
    spark = docs.sparkSession
    ledger = Ledger(spark, folder or f"{shared_dir(spark)}/tidelog-counts-{uuid.uuid4().hex}", tokenizers)
    for _ in range(2):
        ledger.commit("load", inserts=docs)
    return ledger.totals()
