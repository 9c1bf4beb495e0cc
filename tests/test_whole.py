"""Queries that take all rows of the test tables."""

import re

import duckdb
import pytest
from mediajobs.plans import media

SF = "/root/testdata/sf0.001"


def by_sql(name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(media.ORACLE_SQL[name]).fetchall()


def same_as_sql(spark, name):
    got = [tuple(r) for r in media.QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(by_sql(name), key=str)
    return got


@pytest.mark.parametrize("part", ["extract_document_text", "cap_candidates", "truncate_candidates", "rerank_score", "rerank_topn", "rerank_meta"])
def test_rerank_queries_take_all_documents_and_items(spark, part):
    documents = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    items = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}
    queries = {i // 16 for i in documents}
    got = same_as_sql(spark, f"{part}_all")
    if part == "extract_document_text":
        assert sorted(r[0] for r in got) == sorted(documents)
    elif part == "rerank_meta":
        assert {r[0] for r in got} == queries | items and sum(r[2] for r in got) == len(documents)
    else:
        assert {r[0] for r in got} == queries


def test_pad_batch_takes_all_tokens(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = {i: len([w for w in re.split("[ \t\n\x0b\f\r]+", t) if w]) for i, t in texts.items()}
    longest = {}
    for i, k in n.items():
        longest[i // 8] = max(longest.get(i // 8, 0), k)
    assert max(n.values()) > 20
    assert sorted(same_as_sql(spark, "pad_batch_all")) == sorted((i, i // 8, longest[i // 8], k) for i, k in n.items())


def test_tensors_have_the_whole_size_of_the_models(spark):
    import numpy as np
    from mediajobs.operators import images

    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = media.QUERIES["image_to_tensor"](spark, SF).collect()
    assert sorted(r.vec_id for r in got) == sorted(rows)
    assert {r.n for r in got} == {3 * 224 * 224}  # 3 * 16 * 16 before
    for r in got[:5]:
        grey = (np.abs(np.array(rows[r.vec_id], np.float32)) * np.float32(255)).astype(np.uint8).reshape(8, 8, 1)
        want = images.tensor(np.repeat(grey, 3, 2), 224)
        assert (r.least, r.most) == pytest.approx((want.min(), want.max()), abs=1e-3)
