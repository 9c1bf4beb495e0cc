import zlib
from collections import Counter

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF), "test"))
    return out


def test_decisions_take_effect(spark, stages):
    from mediajobs.llm import quality, toxicity

    docs, good, clean, single, mix, packed = stages
    for s in stages[1:5]:
        assert s.columns == docs.columns
    ids = lambda d: Counter(r.doc_id for r in d.select("doc_id").collect())
    assert set(ids(good)) == {r.doc_id for r in quality.digest(docs).where("kept").collect()}
    scores = toxicity.score(good, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(ids(clean)) == {r.doc_id for r in scores if not r.predicted}
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert max(ids(single).values()) == 1
    from test_jaccard import brute

    want = {c for _, _, c in brute(sorted(texts.items()))}
    assert set(ids(single)) == want
    assert max(ids(mix).values()) <= 2
    assert set(ids(mix)) <= set(ids(single))
    copies = Counter(r.doc_id for r in packed.where("piece = 0").collect())
    assert copies == ids(mix)


def test_packed_tokens_are_those_of_the_mix(stages):
    from mediajobs.llm import packing
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    for r in stages[5].limit(50).collect():
        import numpy as np

        ids = np.array(t.encode(texts[r.doc_id], add_special_tokens=False).ids + [0], np.uint32)[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())


def test_run_equals_stages(spark, stages):
    key = lambda d: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])
