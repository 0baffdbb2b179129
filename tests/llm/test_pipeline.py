"""The pipeline's stages, each against plain loops over what its predecessor kept."""
import hashlib
from collections import Counter

import public_tokenizers as P

import corpus_pipeline
from frameloom.llm import bpe, quality

from .fixture import near_components
from .test_native import normal


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    columns = kept.columns
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in kept.collect()]
        out = stage(spark, kept, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        outputs[name] = after = [tuple(r) for r in out.collect()]
        if name != "byte_bpe":
            assert out.columns == columns and set(after) <= set(before)
        ids = [r[0] for r in after]
        if name == "quality":
            verdict = {r.doc_id: r.kept for r in quality.classify(kept, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert sorted(ids) == sorted(i for i, k in verdict.items() if k) and 0 < len(ids) < len(before)
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before):
                first.setdefault(normal(r[1]), r[0])
            assert sorted(ids) == sorted(first.values())
        elif name == "near_dedup":
            assert sorted(ids) == sorted(i for i, (_, c) in near_components(before).items() if i == c)
        elif name == "mixing":
            assert max(Counter(ids).values()) <= 2
        else:
            enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
            want = Counter((r[0], len(enc.encode_ordinary(r[1])), hashlib.sha256(r[1].encode()).hexdigest()) for r in before)
            assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out.collect()) == want
        kept = out
    ran = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert ran == Counter(outputs["byte_bpe"])
