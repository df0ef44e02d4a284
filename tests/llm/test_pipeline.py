"""The pipeline stage by stage, on the smallest tables, against brute-force versions of its stages."""

import hashlib

import corpus_pipeline
import numpy as np
from test_operators import brute_classes, texts

from assayer.llm import exact_dedup, mixing, quality
from assayer.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        seen.append(name)
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "quality classifier":
            scores = quality.score(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(ids) == {r.doc_id for r in scores.collect() if r.predicted}
        elif name == "exact dedup":
            last = {}
            for i, t in texts(before).items():
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
                last[key] = max(i, last.get(key, i))
            assert sorted(ids) == sorted(last.values())
        elif name == "near dedup":
            assert sorted(ids) == sorted({c for c in brute_classes(texts(before)).values()})
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert {i: ids.count(i) for i in set(ids)} == {i: n for i, n in copies.items() if n}
        if name != "BPE":
            assert docs.columns == columns
        else:
            t, bodies = Tokenizer.from_file(tokenizer_path()), texts(before)
            for r in docs.collect():
                packed = np.array(t.encode(bodies[r.doc_id], add_special_tokens=False).ids, dtype="<u4").tobytes()
                assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
    assert seen == ["quality classifier", "exact dedup", "near dedup", "mixing", "BPE"]


def test_run_gives_what_the_stages_give(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() and exact_dedup.SALTS and {"doc_id", "n_tokens", "ids_sha256"} <= set(got.columns)
