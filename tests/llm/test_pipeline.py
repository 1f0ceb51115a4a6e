"""The pipeline: its stages in order, each over what the one before kept, checked against brute force on the smallest tables."""

import os
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from tidelog.llm import queries, toxicity

from .test_decontaminate import brute, shingles, words
from .test_near_dedup import brute as groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline as C
    from tidelog.llm.scratch import Scratch

    assert [name for name, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {0: {r.doc_id: r.text for r in docs.collect()}}
    out = {}
    for k, (name, stage) in enumerate(C.STAGES):
        docs = scratch.keep(stage(spark, docs, SF), name)
        rows = docs.collect()
        if name != "token_files":
            assert docs.columns == columns
            kept[k + 1] = {r.doc_id: r.text for r in rows}
            out[name] = rows
        else:
            out[name] = rows
    scores = {r.doc_id: r.score for r in toxicity.scored(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert set(kept[1]) == {d for d in kept[0] if scores[d] < 0.5}
    component = groups(list(kept[1].items()), 80)
    assert set(kept[2]) == {d for d, v in component.items() if v[2]}
    items = [(x, shingles(words(x))) for _, x in bench]
    leaks = lambda t: any(s & shingles(words(t)) and brute(t, x) for x, s in items)
    assert set(kept[3]) == {d for d, t in kept[2].items() if not leaks(t)}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    ids = [np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in sorted(out["mixing"], key=lambda r: r.doc_id)]
    want = sorted((r.doc_id, len(i), zlib.crc32(i.tobytes())) for r, i in zip(sorted(out["mixing"], key=lambda r: r.doc_id), ids, strict=True))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out["token_files"]) == want
    assert sorted(r.start for r in out["token_files"])[-1] == sum(len(i) for i in ids[:-1])
    assert [tuple(r) for r in sorted(C.run(spark, SF).collect(), key=lambda r: r.start)] == [tuple(r) for r in sorted(out["token_files"], key=lambda r: r.start)]
