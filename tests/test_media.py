import math
import random

import numpy as np
import pytest
from mediajobs.operators import embedding, images, ingest, models, rerank, search
from mediajobs.sources import tables
from pyspark.sql import functions as F


def chunks(n, size=1024, overlap=128, clip=8192):
    n = min(n, clip)
    out, at = [], 0
    while True:
        out.append((at, min(size, n - at)))
        if at + size >= n:
            return out
        at += size - overlap


@pytest.mark.parametrize("n", [0, 1, 1022, 1023, 1024, 1025, 1920, 1921, 8191, 8192, 8193, 20000])
def test_chunks(spark, n):
    df = spark.range(1).select(F.lit("t").alias("text_id"), (F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("ids"))
    c = embedding.chunk_tokens(df)
    assert [(r.start, len(r.ids)) for r in c.orderBy("chunk_index").collect()] == chunks(n)
    for r in embedding.build_chunk_instances(c, -1, -2).collect():
        assert r.ids[0] == -1 and r.ids[-1] == -2 and r.weight == len(r.ids) == len(r.mask) <= 1024


def test_buckets_batches_padding_usage(spark):
    sizes = [256, 257, 384, 385, 512, 513, 0, 1, 2, 3]
    items = spark.createDataFrame([("m", i, n, f"r{i % 3}", "text") for i, n in enumerate(sizes)], "model string, arrival int, n_tokens int, request_id string, modality string")
    got = {r.arrival: (r.bucket, r.batch) for r in embedding.length_bucket_batches(items).collect()}
    assert got == {0: (0, 0), 6: (0, 0), 7: (0, 0), 8: (0, 0), 9: (0, 1), 1: (1, 0), 2: (1, 0), 3: (2, 0), 4: (2, 0), 5: (3, 0)}
    rows = spark.createDataFrame([(0, [1, 2], [1, 1]), (0, [3], [1]), (1, [], [])], "batch_id int, ids array<int>, mask array<int>")
    assert [(r.ids, r.mask) for r in embedding.pad_batch(rows, 9).orderBy("batch_id", F.desc("ids")).collect()] == [([3, 9], [1, 0]), ([1, 2], [1, 1]), ([], [])]
    stats = embedding.batch_stats(items, embedding.length_bucket_batches(items).groupBy("bucket", "batch").agg(F.count("*").alias("n_items"))).first()
    assert (stats.submitted_items, stats.bucket_0, stats.bucket_3, stats.requests, stats.largest_request, stats.batches_of_4, stats.batches_of_1) == (10, 5, 1, 3, 4, 1, 2)
    assert embedding.batch_stats(items.limit(0)).first().mean_tokens == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], 1), (1, [0.0, 0.0], 0), (2, [0.0, 0.0], 1)], "text_id int, vector array<double>, weight int")
    got = {r.text_id: r.vector for r in embedding.merge_chunk_vectors(df).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]
    h = spark.range(1).select(embedding.mean_pool(F.lit([[1.0, 2.0], [3.0, 6.0]]), F.lit([1, 1])).alias("a"), embedding.mean_pool(F.lit([[1.0, 2.0]]), F.lit([0])).alias("b")).first()
    assert h.a == [2.0, 4.0] and h.b == [0.0, 0.0]
    r = spark.createDataFrame([("x", ["a", "b"]), ("y", [])], "request_id string, inputs array<string>")
    assert [(x.request_id, x.item_index, x.input) for x in embedding.normalize_embed_input(r).collect()] == [("x", 0, "a"), ("x", 1, "b")]
    with pytest.raises(Exception, match="input must be"):
        embedding.normalize_embed_input(spark.createDataFrame([("x", None)], "request_id string, inputs array<string>")).collect()


def test_knn_forms_agree_with_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(120, 5)), 1)
    x[7] = x[3]
    items = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(500, None, 0)], "media_id long, v array<double>, label int")
    queries = items.where("media_id < 6").select(F.col("media_id").alias("query_id"), F.col("v").alias("query_vector"))
    want = {}
    for q in range(6):
        d = ((x - x[q]) ** 2).sum(1)
        want[q] = [int(i) for i in np.lexsort((np.arange(120), np.round(d, 9)))[:4]]
    for f in (search.knn, search.knn_builtin):
        got = {}
        for r in f(queries, items, "v", 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.media_id)
        assert got == want
    some = search.knn(queries, items, "v", 4, filter_expr="label = 1").collect()
    assert len(some) == 24 and all(r.media_id % 3 == 1 for r in some)
    assert len(search.knn(queries, items, "v", 4, filter_expr="label = 1", prefilter=False).collect()) < 24
    with pytest.raises(Exception, match="expected 4"):
        search.validate_dimensions(items, "v", 4).collect()
    good, bad = search.validate_dimensions(items.withColumn("v", F.when(F.col("media_id") == 1, F.array(F.lit(1.0))).otherwise(F.col("v"))), "v", 5, "quarantine")
    assert (good.count(), bad.count()) == (120, 1)


FIGURES = [
    ("d1", 0, 0, "f0", 1, "img-a", "c", None, "chart", "s3://x", "p"), ("d1", 0, 1, "f1", 1, "", "c", None, None, None, "p"), ("d1", 0, 2, "f2", 2, "img-a", "c", None, "", "", "p"),
    ("d2", 1, 0, "f0", 1, "img-a", "c", None, None, None, "p"), ("d2", 1, 1, "f1", 1, "img-b", "c", None, None, None, "p"), ("d2", 1, 2, "f2", 1, None, "c", None, None, None, "p"),
]
FIG_SCHEMA = "document_id string, doc_ordinal long, pos int, figure_id string, page int, image string, caption string, ocr_text string, figure_type string, source_uri string, provider_name string"


def test_ingest_twice(spark, tmp_path):
    figures = spark.createDataFrame(FIGURES, FIG_SCHEMA)
    hashed = figures.select(ingest.content_hash(F.col("image")).alias("hash")).where("hash is not null").distinct()
    vectors = hashed.select("hash", F.lit("clip").alias("model"), F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("vector"))
    empty = spark.createDataFrame([], "hash string")
    records, seen = ingest.ingest(figures, empty, vectors, "clip", "dino", (2, 3), 5.0)
    documents = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "document_id string")
    first = {r.document_id: (r.ingested_count, r.skipped_duplicates, len(r.media_ids)) for r in ingest.ingest_summary(documents, seen, records).collect()}
    assert first == {"d1": (1, 1, 1), "d2": (1, 1, 1), "d3": (0, 0, 0)}
    got = {r.source_native_id + r.parent_uri: (r.source_type, r.source_uri, r.multimodal_vector, r.dino_vector) for r in records.collect()}
    assert got == {"f0d1": ("chart", "s3://x", [1.0, 0.0], None), "f1d2": ("figure", "d2", [1.0, 0.0], None)}
    tables.write_media(records, str(tmp_path), (2, 3))
    media = tables.read_media(spark, str(tmp_path), (2, 3))
    again, seen = ingest.ingest(figures, media, vectors, "clip", "dino", (2, 3), 6.0)
    assert again.count() == 0 and tables.media_count(media) == 2
    row = media.first()
    assert tables.media_get_by_id(media, row.media_id).first().hash == row.hash == tables.media_get_by_hash(media, row.hash).first().hash
    with pytest.raises(Exception, match="expected 9"):
        ingest.ingest(figures, empty, vectors, "clip", "dino", (9, 3), 5.0)[0].collect()


def test_rerank(spark):
    docs = [{"title": " T ", "year": 3, "steps": ["a", {"text": "b"}], "z": "no"}, {"z": "only", "n": 5}, ["x", None, {"name": "y"}], "plain ", "{bad", {"title": " ", "source": True}]
    import json

    df = spark.createDataFrame([(i, json.dumps(d) if not isinstance(d, str) else d) for i, d in enumerate(docs)], "pos int, document string")
    got = [r.t for r in df.select("pos", rerank.extract_document_text(F.col("document")).alias("t")).orderBy("pos").collect()]
    assert got == ["T 3 a b", "only", "x y", "plain", "{bad", "True"]
    rows = [("q", i, "d" * (999 + i)) for i in range(9)] + [("p", 0, "e")]
    c = spark.createDataFrame(rows, "query_id string, pos int, document string")
    queries = spark.createDataFrame([("q", "d", 2), ("p", "e", None), ("o", "x", 0)], "query_id string, query string, top_n int")
    capped = rerank.truncate_candidates(rerank.cap_candidates(c).withColumn("text", F.when(F.col("pos") > 0, F.col("document")).otherwise("")))
    assert capped.agg(F.max(F.length("text"))).first()[0] == 1000
    meta = {r.query_id: (r.total_documents, r.scored_documents, r.discarded_documents, r.text_truncated_documents, r.applied_top_n) for r in rerank.rerank_meta(queries, capped).collect()}
    assert meta == {"q": (9, 8, 1, 6, 2), "p": (1, 1, 0, 0, None), "o": (0, 0, 0, 0, None)}
    with pytest.raises(Exception, match="too many documents"):
        rerank.cap_candidates(c, strict=True).collect()
    scored = capped.withColumn("score", F.when(F.col("pos") == 3, 2.0).otherwise(1.0))
    top = [(r.query_id, r.pos) for r in rerank.rerank_topn(scored, queries).orderBy("query_id", "rank").collect()]
    assert top == [("p", 0), ("q", 3), ("q", 0)]
    with pytest.raises(Exception, match="negative"):
        rerank.rerank_topn(scored, queries.withColumn("top_n", F.lit(-1))).collect()


def test_search_by_text_and_image(spark):
    media = models.embed_table(spark.createDataFrame([(1, "red fox"), (2, "blue whale"), (3, "red car")], "media_id long, input string"))
    media = media.select("media_id", F.col("vector").alias("multimodal_vector"), F.col("vector").alias("dino_vector"))
    q = spark.createDataFrame([(1, "text", "blue whale", None), (2, "image", None, "red fox"), (3, "text", "", None), (4, "image", "x", None)], "query_id long, mode string, query_text string, query_image string")
    assert {r.query_id: r.error_code for r in search.validate_search(q).collect()} == {1: None, 2: None, 3: 400, 4: 400}
    t = search.search_by_text(q, media, 1).collect()
    assert (1, 2) in [(r.query_id, r.media_id) for r in t] and 3 not in [r.query_id for r in t] and "multimodal_vector" not in t[0]
    assert [(r.query_id, r.media_id) for r in search.search_by_image(q, media, 1).collect()] == [(2, 1)]


def test_images(spark):
    import base64

    long = base64.b64encode(b"x" * 40).decode()
    rows = [("a", "data:image/png;base64,QQ=="), ("b", long), ("c", "/f.png"), ("d", "nothing!"), ("e", base64.b64encode(b"short").decode())]
    files = spark.createDataFrame([("/f.png", bytearray(b"zz"))], "path string, content binary")
    got = {r.id: (r.kind, bytes(r.image_bytes) if r.image_bytes else None) for r in images.decode_image_input(spark.createDataFrame(rows, "id string, data string"), files).collect()}
    assert got == {"a": ("data_uri", b"A"), "b": ("base64", b"x" * 40), "c": ("path", b"zz"), "d": ("error", None), "e": ("error", None)}
    flat = images.tensor(np.full((10, 7, 3), 128, np.uint8), 16)
    assert flat.shape == (3, 16, 16)
    for c in range(3):
        assert flat[c] == pytest.approx((128 / 255 - images.MEAN[c]) / images.STD[c], abs=1e-5)
    same = random.Random(1)
    px = np.array([[[same.randrange(256) for _ in range(3)] for _ in range(16)] for _ in range(16)], np.uint8)
    assert images.tensor(px, 16) == pytest.approx(((px / 255 - images.MEAN) / images.STD).transpose(2, 0, 1), abs=1e-5)
    assert math.isclose(float(images._weights(50, 20).sum()), 20)
