"""Queries of the embedding, ingest, search and rerank operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import cut, new_path
from ..functions.sizes import small
from ..operators import embedding, images, ingest, known, models, pivots, rerank, search
from ..sources import tables
from .inputs import TURNS, table

MODELS = """
SELECT * FROM VALUES ('bge', 'embedding', CAST(NULL AS STRING), CAST(NULL AS STRING)), ('ir', 'embedding', 'pooled_ir', 'query: '),
('st', 'embedding', 'sentence_transformer', 'search: '), ('clip', 'multimodal_embedding', NULL, NULL), ('dinov3', 'dino_embedding', NULL, NULL)
AS m(id, type, embedding_backend, query_prefix)
"""


def _vectors(spark, sf):
    """Vectors, and half as long ones of the means of every two components."""
    at = lambda k: F.element_at("embedding", k).cast("double")
    visual = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: ((at(2 * i - 1) + at(2 * i)) / 2).cast("float"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("media_id"), "embedding", visual.alias("visual"), "label")


def _knn(spark, sf, column, **options):
    v = search.validate_dimensions(_vectors(spark, sf), column, 64 if column == "embedding" else 32)
    queries = v.where("media_id % 25 = 0").select(F.col("media_id").alias("query_id"), F.col(column).alias("query_vector"))
    out = search.knn(queries, v, column, 5, **options)
    return out.withColumn("distance", F.round("distance", 6))


def knn_multimodal(spark, sf):
    return _knn(spark, sf, "embedding")


def knn_visual(spark, sf):
    return _knn(spark, sf, "visual")


def filtered_search(spark, sf):
    return _knn(spark, sf, "embedding", filter_expr="label < 3")


def knn_builtin(spark, sf):
    v = _vectors(spark, sf)
    queries = v.where("media_id % 25 = 0").select(F.col("media_id").alias("query_id"), F.col("visual").alias("query_vector"))
    return search.knn_builtin(queries, v, "visual", 5).withColumn("distance", F.round("distance", 6))


def _pruned(spark, sf, column, **options):
    """The same searches with the vectors' stored pivot table."""
    v = search.validate_dimensions(_vectors(spark, sf), column, 64 if column == "embedding" else 32)
    queries = v.where("media_id % 25 = 0").select(F.col("media_id").alias("query_id"), F.col(column).alias("query_vector"))
    stored = pivots.pivot_table(v, column, new_path(spark, "pivots"), columns=["label"])
    return pivots.knn_pruned(queries, stored, 5, **options).withColumn("distance", F.round("distance", 6))


def knn_pivots(spark, sf):
    return _pruned(spark, sf, "embedding")


def knn_visual_pivots(spark, sf):
    return _pruned(spark, sf, "visual")


def filtered_search_pivots(spark, sf):
    return _pruned(spark, sf, "embedding", filter_expr="label < 3")


def validate_dimensions(spark, sf):
    v = _vectors(spark, sf).withColumn("embedding", F.when(F.col("media_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    good, bad = search.validate_dimensions(v, "embedding", 64, "quarantine")
    return good.select("media_id", F.lit("valid").alias("part")).union(bad.select("media_id", F.lit("quarantine").alias("part")))


def _tokens(spark, sf):
    """White-space words of documents; a word's id is its length."""
    words = F.filter(F.split("text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")
    ids = F.transform(words, F.length)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), ids.alias("ids"), "lang", "source")


def chunk_tokens(spark, sf):
    c = embedding.chunk_tokens(_tokens(spark, sf).select("text_id", "ids"))
    return c.select("text_id", "chunk_index", "start", F.size("ids").alias("n"), F.coalesce(F.element_at("ids", 1), F.lit(-1)).alias("first"))


def build_chunk_instances(spark, sf):
    c = embedding.build_chunk_instances(embedding.chunk_tokens(_tokens(spark, sf).select("text_id", "ids")), 0, 2)
    return c.select("text_id", "chunk_index", "weight", F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


def tokenize(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", models.tokenize(F.col("text")).alias("ids"), models.tokenize(F.col("text"), max_length=256).alias("cut"))
    return d.select("doc_id", F.size("ids").alias("n"), F.size("cut").alias("n_cut"), *[F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(f"{c}_md5") for c in ("ids", "cut")])


def _items(spark, sf):
    return _tokens(spark, sf).select("text_id", F.col("lang").alias("model"), F.col("text_id").alias("arrival"), F.size("ids").alias("n_tokens"), F.col("source").alias("request_id"))


def length_bucket_batches(spark, sf):
    return embedding.length_bucket_batches(_items(spark, sf)).select("text_id", "model", "bucket", "batch")


def pad_batch(spark, sf):
    """Whole texts, none of their tokens left out."""
    t = _tokens(spark, sf).withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    p = embedding.pad_batch(t.withColumn("batch_id", F.floor(F.col("text_id") / 8)))
    return p.select("text_id", "batch_id", F.size("ids").alias("n"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


def embedding_usage(spark, sf):
    items = _items(spark, sf).withColumn("modality", F.when(F.col("text_id") % 4 == 0, "image").otherwise("text"))
    return embedding.embedding_usage(items)


def batch_stats(spark, sf):
    items = embedding.length_bucket_batches(_items(spark, sf))
    batches = items.groupBy("model", "bucket", "batch").agg(F.count("*").alias("n_items"))
    return embedding.batch_stats(items, batches).withColumn("mean_tokens", F.round("mean_tokens", 6))


def normalize_embed_input(spark, sf):
    """A request for each TURNS turns of a conversation."""
    part = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / TURNS)).alias("request_id")
    c = table(spark, sf, "conversations").groupBy(part).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("inputs"))
    return embedding.normalize_embed_input(c)


def _requests(spark, sf):
    names = F.array(*[F.lit(x) for x in ("bge", "ir", "st", "clip", "dinov3", "none")])
    c = table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", F.element_at(names, (F.col("conv_id") % 6 + 1).cast("int")).alias("model"), F.when(F.col("turn") % 3 == 0, "image").otherwise("text").alias("modality"),
        F.when(F.col("role") == "user", "query").otherwise("document").alias("input_type"), "text",
    )


def route_embedding(spark, sf):
    return embedding.route_embedding(_requests(spark, sf), spark.sql(MODELS)).select("conv_id", "turn", "model", "route", "error_code")


def apply_query_prefix(spark, sf):
    m = small(spark.sql(MODELS).select(F.col("id").alias("model"), "query_prefix"))
    r = _requests(spark, sf).join(m, "model", "left")
    return r.select("conv_id", "turn", embedding.apply_query_prefix(F.col("text"), F.col("input_type"), F.col("query_prefix")).alias("text"))


def _exploded(df, key):
    """Vectors by place, rounded, for comparison."""
    return df.select(key, F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 5) + 0.0)


def mean_pool(spark, sf):
    hidden = F.array(F.col("embedding"), F.reverse("embedding"), F.col("embedding"))
    mask = F.array(F.lit(1), F.lit(1), F.lit(0))
    v = _vectors(spark, sf).select("media_id", embedding.mean_pool(hidden, mask).alias("vector"))
    return _exploded(v, "media_id")


def decode_predictions(spark, sf):
    none, k = F.lit(None).cast("array<float>"), F.col("media_id") % 2 == 0
    v = _vectors(spark, sf).select(
        "media_id", F.when(k, F.col("embedding")).otherwise(none).alias("sentence_embedding"), F.lit(None).cast("array<array<float>>").alias("token_embeddings"),
        F.array(F.col("embedding"), F.col("embedding")).alias("last_hidden_state"), F.lit(None).cast("array<array<float>>").alias("output"), F.array(F.lit(1), F.lit(0)).alias("mask"),
    )
    return _exploded(embedding.decode_predictions(v), "media_id")


def l2_normalize(spark, sf):
    v = _vectors(spark, sf).select("media_id", embedding.l2_normalize(F.transform("visual", lambda x: x * 3)).alias("vector"))
    return _exploded(v, "media_id")


def merge_chunk_vectors(spark, sf):
    c = _vectors(spark, sf).select(F.col("label").alias("text_id"), F.col("embedding").alias("vector"), (F.col("media_id") % 5 + 1).alias("weight"))
    return _exploded(embedding.merge_chunk_vectors(c), "text_id")


def embed_table(spark, sf):
    v = models.embed_table(table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("input")))
    return v.select("conv_id", "turn", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 5) + 0.0)


def decode_image_input(spark, sf):
    k = F.col("page_id") % 3
    b64 = F.base64(F.encode("html", "UTF-8"))
    data = F.when(k == 0, F.concat(F.lit("data:image/png;base64,"), b64)).when(k == 1, b64).otherwise(F.lit("/no such file"))
    p = table(spark, sf, "pages").select("page_id", data.alias("data"))
    return images.decode_image_input(p).select("page_id", "kind", F.length("image_bytes").alias("n_bytes"))


def image_to_tensor(spark, sf):
    """Vectors as 8 x 8 grey images, as whole tensors of the visual models' size."""
    px = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex((F.abs(x) * 255).cast("int")), 2, "0")), ""))
    v = table(spark, sf, "embeddings").select("vec_id", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), px.alias("data")).alias("image"))
    t = v.select("vec_id", images.image_to_tensor(F.col("image")).alias("t"))
    return t.select("vec_id", F.size("t").alias("n"), F.round(F.array_min("t"), 3).alias("least"), F.round(F.array_max("t"), 3).alias("most"))


def image_to_tensor_same_size(spark, sf):
    """The same images at their own size: scaled and normalised only."""
    px = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex((F.abs(x.cast("double")) * 255).cast("int")), 2, "0")), ""))
    v = table(spark, sf, "embeddings").select("vec_id", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), px.alias("data")).alias("image"))
    t = v.select("vec_id", images.image_to_tensor(F.col("image"), 8).alias("t")).select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("channel"), "t")
    t = t.select("vec_id", "channel", F.slice("t", F.col("channel") * 64 - 63, 64).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t.select("vec_id", "channel", *[F.round(f("t").cast("double"), 3).alias(n) for f, n in ((F.array_min, "least"), (F.array_max, "most"))], F.round(total, 2).alias("total"))


def _figures(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("d"), F.floor(F.col("doc_id") / 4).cast("string")).alias("document_id"), F.floor(F.col("doc_id") / 4).alias("doc_ordinal"), (F.col("doc_id") % 4).cast("int").alias("pos"),
        F.concat(F.lit("f"), F.when(F.col("doc_id") % 4 == 3, F.col("doc_id") - 2).otherwise(F.col("doc_id")).cast("string")).alias("figure_id"), F.lit(1).alias("page"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("image"),
        F.col("source").alias("caption"), F.lit(None).cast("string").alias("ocr_text"), F.when(F.col("doc_id") % 3 == 0, "chart").when(F.col("doc_id") % 3 == 1, "").alias("figure_type"),
        F.when(F.col("doc_id") % 2 == 0, "").alias("source_uri"), F.lit("p1").alias("provider_name"), "doc_id",
    )


def _stored(spark, sf):
    return _figures(spark, sf).where("doc_id % 10 = 0 and image is not null").select(ingest.content_hash(F.col("image")).alias("hash"))


def _hashed(spark, sf):
    return ingest.figures_with_image(_figures(spark, sf)).withColumn("hash", ingest.content_hash(F.col("image")))


def figures_with_image(spark, sf):
    return ingest.figures_with_image(_figures(spark, sf)).select("doc_id")


def content_hash(spark, sf):
    return _hashed(spark, sf).select("doc_id", "hash")


def anti_join_existing(spark, sf):
    return ingest.anti_join_existing(_hashed(spark, sf), _stored(spark, sf)).select("doc_id", "hash")


def anti_join_filtered(spark, sf):
    """The same with the stored filter of hashes, written in two parts."""
    path, stored = new_path(spark, "filter"), _stored(spark, sf)
    known.write_filter(stored.where("hash < '8'"), path)
    known.add_to_filter(stored.where("hash >= '8'"), path)
    return known.new_figures(_hashed(spark, sf).drop("image"), stored, known.HashFilter(spark, path)).select("doc_id", "hash")


def dedup_within_batch(spark, sf):
    return ingest.dedup_within_batch(_hashed(spark, sf).drop("image")).select("doc_id", "hash")


def _vectors_of(spark, sf):
    h = _hashed(spark, sf).where("doc_id % 3 = 0").select("hash").distinct()
    return h.select("hash", F.lit("clip").alias("model"), F.array(F.length("hash").cast("float"), F.lit(1.0).cast("float")).alias("vector"))


def attach_embeddings(spark, sf):
    a = ingest.attach_embeddings(_hashed(spark, sf).drop("image"), _vectors_of(spark, sf), "clip", "dinov3")
    return a.select("doc_id", F.size("multimodal_vector").alias("mm"), F.col("dino_vector").isNull().alias("no_visual"))


def _ingest(spark, sf):
    return ingest.ingest(_figures(spark, sf), _stored(spark, sf), _vectors_of(spark, sf), "clip", "dinov3", (2, 2), 0.0)


def ingest_job(spark, sf):
    records, _ = _ingest(spark, sf)
    return records.select("source_type", "source_uri", "source_native_id", "parent_uri", "mime_type", "page", "caption", "hash", "parser_provider", F.coalesce(F.size("multimodal_vector"), F.lit(0)).alias("mm"))


def ingest_summary(spark, sf):
    records, hashed = _ingest(spark, sf)
    documents = _figures(spark, sf).select("document_id").distinct()
    s = ingest.ingest_summary(documents, hashed, records)
    ids = F.md5(F.array_join("media_ids", ","))
    return s.select("document_id", "ingested_count", "skipped_duplicates", F.size(F.array_distinct("media_ids")).alias("n_ids"), ids.alias("ids_md5"))


def media_lookup(spark, sf):
    """Bulk lookup of stored hashes."""
    return ingest.duplicates_of_existing(_hashed(spark, sf).drop("image"), _stored(spark, sf)).select("doc_id", "hash")


def _media(spark, sf):
    """Every two documents share a media id."""
    d = table(spark, sf, "documents").where("text is not null").select((F.col("doc_id") - F.col("doc_id") % 2).alias("media_id"), F.col("text").alias("input"), "lang")
    v = models.embed_table(d)
    # stored, as a search reads its media more than once
    return cut(v.select("media_id", "lang", "vector")).select("media_id", "lang", F.col("vector").alias("multimodal_vector"), F.col("vector").alias("dino_vector"))


def _queries(spark, sf):
    b = table(spark, sf, "benchmark")
    mode = F.when(F.col("item_id") % 2 == 0, "text").otherwise("image")
    return b.select(F.col("item_id").alias("query_id"), mode.alias("mode"), F.when(mode == "text", F.col("text")).alias("query_text"), F.when((mode == "image") & (F.col("item_id") % 3 != 0), F.col("text")).alias("query_image"))


def validate_search(spark, sf):
    return search.validate_search(_queries(spark, sf)).select("query_id", "mode", "error_code")


def search_by_text(spark, sf):
    found = search.search_by_text(_queries(spark, sf), _media(spark, sf), 5, size=16)
    return found.select("query_id", "rank", "media_id", "lang", F.round("distance", 6).alias("distance"))


def search_by_image(spark, sf):
    found = search.search_by_image(_queries(spark, sf), _media(spark, sf), 5, size=16)
    return found.select("query_id", "rank", "media_id", "lang", F.round("distance", 6).alias("distance"))


def search_ingested(spark, sf):
    """Figures ingested, written, read again, and searched by text among the odd ones: the ids are those of the records."""
    figures = _figures(spark, sf)
    h = _hashed(spark, sf).groupBy("hash").agg(F.min("image").alias("input"))
    vectors = models.embed_table(h).select("hash", F.lit("clip").alias("model"), "vector")
    records, _ = ingest.ingest(figures, _stored(spark, sf), vectors, "clip", "dinov3", (16, 16), 0.0)
    root = new_path(spark, "media")
    tables.write_media(records, root, (16, 16))
    media = tables.read_media(spark, root, (16, 16)).withColumn("odd", F.expr("cast(substring(source_native_id, 2) as long) % 2"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = search.search_by_text(asked, media, 5, size=16, filter_expr="odd = 1")
    return found.select("query_id", "rank", "media_id", F.round("distance", 6).alias("distance"))


def _written(spark, sf):
    """The media table after two appends."""
    records, _ = _ingest(spark, sf)
    root = new_path(spark, "media")
    for half in ("hash < '8'", "hash >= '8'"):
        tables.write_media(records.where(half), root, (2, 2))
    return tables.read_media(spark, root, (2, 2))


def write_media(spark, sf):
    media = _written(spark, sf)
    whole = F.array_join(F.transform("multimodal_vector", lambda x: x.cast("int").cast("string")), ",")
    return media.select("media_id", "source_native_id", "hash", whole.alias("multimodal"), "created_at", "embedding_model", F.lit(tables.media_count(media)).alias("stored"))


def media_get(spark, sf):
    """Records of even figures looked up by id, many at once; the first of them also on its own, by id and by hash."""
    media = _written(spark, sf)
    ids = media.where("cast(substring(source_native_id, 2) as long) % 2 = 0").select("media_id")
    found = tables.media_get_many(media, ids).select("media_id", "hash")
    one = found.orderBy("media_id").first()
    if one:
        alone = [tables.media_get_by_id(media, one.media_id), tables.media_get_by_hash(media, one.hash)]
        found = found.where(F.col("media_id") != one.media_id).union(alone[0].select("media_id", "hash").intersect(alone[1].select("media_id", "hash")))
    return found.select("media_id", "hash", F.lit(found.count()).alias("found"))


def _document():
    return F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("source").alias("title"), F.col("text"), F.col("n_chars").alias("year")))).otherwise(F.col("text"))


def _candidates(spark, sf):
    """All documents as candidates, 16 a query: the number of queries grows with the table."""
    d = table(spark, sf, "documents")
    return d.select(F.floor(F.col("doc_id") / 16).alias("query_id"), F.col("doc_id").alias("pos"), _document().alias("document"))


def extract_document_text(spark, sf):
    c = _candidates(spark, sf)
    return c.select("pos", rerank.extract_document_text(F.col("document")).alias("text"))


def _capped(spark, sf):
    return rerank.text_candidates(_candidates(spark, sf))


def cap_candidates(spark, sf):
    return rerank.cap_candidates(_candidates(spark, sf)).select("query_id", "pos", "total")


def truncate_candidates(spark, sf):
    return _capped(spark, sf).select("query_id", "pos", F.length("text").alias("n"), "truncated")


def rerank_score(spark, sf):
    pairs = _capped(spark, sf).join(_rerank_queries(spark, sf), "query_id")
    return models.rerank_score(pairs).select("query_id", "pos", "score")


def rerank_logits(spark, sf):
    """Scores from logits: a vector and its reverse as two positions."""
    v = _vectors(spark, sf)
    return v.select("media_id", F.round(models.score_of_logits(F.array(F.reverse("embedding"), F.col("visual"))), 6).alias("score"))


def rerank_topn(spark, sf):
    scored = _candidates(spark, sf).select("query_id", "pos", (F.col("pos") % 7).cast("double").alias("score"))
    return rerank.rerank_topn(scored, _rerank_queries(spark, sf)).select("query_id", "pos", "rank")


def rerank_meta(spark, sf):
    return rerank.rerank_meta(_rerank_queries(spark, sf), _capped(spark, sf))


def _rerank_queries(spark, sf):
    """A query for each id of candidates and each benchmark item; texts of items by place, in turn."""
    b = table(spark, sf, "benchmark")
    ids = _candidates(spark, sf).select("query_id").union(b.select("item_id")).distinct()
    n = b.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    q = ids.crossJoin(F.broadcast(n)).withColumn("item_id", F.pmod("query_id", "n"))  # one row
    return q.join(b.select("item_id", F.col("text").alias("query")), "item_id").select("query_id", "query", (F.col("query_id") % 4).cast("int").alias("top_n"))


_NAMES = """knn_multimodal knn_visual filtered_search knn_builtin knn_pivots knn_visual_pivots filtered_search_pivots validate_dimensions chunk_tokens build_chunk_instances tokenize
length_bucket_batches pad_batch embedding_usage batch_stats normalize_embed_input route_embedding apply_query_prefix mean_pool decode_predictions
l2_normalize merge_chunk_vectors embed_table decode_image_input image_to_tensor figures_with_image content_hash anti_join_existing anti_join_filtered dedup_within_batch
attach_embeddings ingest_job ingest_summary media_lookup validate_search search_by_text search_by_image extract_document_text cap_candidates
truncate_candidates rerank_score rerank_logits rerank_topn rerank_meta image_to_tensor_same_size write_media media_get search_ingested""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
#: Earlier names of these queries, kept for whoever calls them; both are the whole tables'.
_ALL = "extract_document_text cap_candidates truncate_candidates rerank_score rerank_topn rerank_meta pad_batch".split()
QUERIES |= {f"{name}_all": QUERIES[name] for name in _ALL}

_VISUAL = "list_transform(range(1, 33), lambda i: CAST((CAST(embedding[2 * i - 1] AS DOUBLE) + embedding[2 * i]) / 2 AS FLOAT))"
_KNN = """
WITH v AS (SELECT vec_id AS media_id, label, {v} AS x FROM embeddings),
s AS (SELECT q.media_id AS query_id, i.media_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda k: (CAST(q.x[k] AS DOUBLE) - i.x[k]) ** 2)) AS d
      FROM v q JOIN v i ON q.media_id % 25 = 0 AND {f})
SELECT query_id, CAST(rank AS INT) AS rank, media_id, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, media_id) AS rank FROM s) WHERE rank <= 5"""
_N = r"""t AS (SELECT doc_id AS text_id, lang AS model, source AS request_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, len(w) AS n, CASE WHEN greatest(len(w), 1) <= 256 THEN 0 WHEN len(w) <= 384 THEN 1 WHEN len(w) <= 512 THEN 2 ELSE 3 END AS bucket FROM t)"""
_CHUNKS = "WITH " + _N + """,
c AS (SELECT text_id, w, n, unnest(range(0, CAST(greatest(0, ceil((least(n, 8192) - 1024) / 896.0)) AS BIGINT) + 1)) AS k FROM n),
z AS (SELECT text_id, CAST(k AS INT) AS chunk_index, CAST(k * 896 AS INT) AS start, CAST(greatest(0, least(1024, least(n, 8192) - k * 896)) AS INT) AS m, w FROM c)
"""
_FIG = """f AS (SELECT doc_id, 'f' || CASE WHEN doc_id % 4 = 3 THEN doc_id - 2 ELSE doc_id END AS figure_id, 'd' || (doc_id // 4) AS document_id, doc_id AS o, CASE WHEN doc_id % 11 <> 0 THEN text END AS image, source AS caption FROM documents),
h AS (SELECT *, sha256(image) AS hash FROM f WHERE length(image) > 0),
st AS (SELECT hash FROM h WHERE doc_id % 10 = 0),
first AS (SELECT * FROM h WHERE hash NOT IN (SELECT hash FROM st) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY o) = 1)
"""
_BATCHES = "b AS (SELECT *, (row_number() OVER (PARTITION BY model, bucket ORDER BY text_id) - 1) // (CASE bucket WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END) AS batch FROM n)"
_CAND = r"""c AS (SELECT doc_id // 16 AS query_id, doc_id AS pos, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN source || ' ' || regexp_replace(text, '^\s+|\s+$', '', 'g') || ' ' || n_chars ELSE text END, '^\s+|\s+$', '', 'g') AS text
      FROM documents),
k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 8),
q AS (SELECT i.query_id, b.text FROM (SELECT query_id FROM c UNION SELECT item_id FROM benchmark) i JOIN benchmark b ON b.item_id = i.query_id % (SELECT count(*) FROM benchmark))
"""
#: The hash encoder's vectors of texts ``t`` (id, text, ...), as x.
_ENCODED = r"""
h AS (SELECT *, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16) AS hs FROM t),
n AS (SELECT *, list_transform(range(0, 16), lambda k: len(list_filter(hs, lambda y: y = k))::DOUBLE) AS c FROM h),
e AS (SELECT * EXCLUDE (hs, c), list_transform(c, lambda v: CAST(CASE WHEN list_sum(c) > 0 THEN v / sqrt(list_sum(list_transform(c, lambda u: u * u))) ELSE 0 END AS FLOAT)) AS x FROM n)
"""
_SEARCH = """
WITH t AS (SELECT 'q' AS side, item_id AS id, '' AS lang, text FROM benchmark WHERE {asked} UNION ALL SELECT 'm', doc_id - doc_id % 2, lang, text FROM documents WHERE text IS NOT NULL),""" + _ENCODED + """,
s AS (SELECT q.id AS query_id, m.id AS media_id, m.lang, list_sum(list_transform(range(1, 17), lambda k: (CAST(m.x[k] AS DOUBLE) - q.x[k]) ** 2)) AS d FROM e q JOIN e m ON q.side = 'q' AND m.side = 'm')
SELECT query_id, CAST(rank AS INT) AS rank, media_id, lang, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, media_id) AS rank FROM s) WHERE rank <= 5"""
_RECORDS = """
r AS (SELECT substr(sha256(hash || chr(31) || document_id || chr(31) || figure_id || chr(31) || (doc_id % 4)), 1, 32) AS media_id, figure_id, doc_id, hash, image FROM first)
"""

ORACLE_SQL = {
    "knn_multimodal": _KNN.format(v="embedding", f="true"),
    "knn_visual": _KNN.format(v=_VISUAL, f="true"),
    "knn_builtin": _KNN.format(v=_VISUAL, f="true"),
    "filtered_search": _KNN.format(v="embedding", f="i.label < 3"),
    "knn_pivots": _KNN.format(v="embedding", f="true"),
    "knn_visual_pivots": _KNN.format(v=_VISUAL, f="true"),
    "filtered_search_pivots": _KNN.format(v="embedding", f="i.label < 3"),
    "validate_dimensions": "SELECT vec_id AS media_id, CASE WHEN vec_id % 7 = 0 THEN 'quarantine' ELSE 'valid' END AS part FROM embeddings",
    "chunk_tokens": _CHUNKS + "SELECT text_id, chunk_index, start, m AS n, CAST(coalesce(length(w[start + 1]), -1) AS INT) AS first FROM z",
    "build_chunk_instances": _CHUNKS + "SELECT text_id, chunk_index, least(m, 1022) + 2 AS weight, 0 AS first, 2 AS last, least(m, 1022) + 2 AS mask_sum FROM z",
    "tokenize": "WITH " + _N + """,
i AS (SELECT text_id, n, list_transform(w, lambda x: 1000 + CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 30000) AS ids FROM n)
SELECT text_id AS doc_id, CAST(n AS INT) AS n, CAST(least(n, 256) AS INT) AS n_cut, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(ids[1:256], ',')) AS cut_md5 FROM i""",
    "length_bucket_batches": "WITH " + _N + "," + _BATCHES + "SELECT text_id, model, bucket, batch FROM b",
    "pad_batch": "WITH " + _N + "SELECT text_id, text_id // 8 AS batch_id, CAST(max(n) OVER (PARTITION BY text_id // 8) AS INT) AS n, CAST(n AS INT) AS mask_sum FROM n",
    "embedding_usage": "WITH " + _N + "SELECT request_id, CAST(sum(CASE WHEN text_id % 4 = 0 THEN 1 ELSE n END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN text_id % 4 = 0 THEN 1 ELSE n END) AS BIGINT) AS total_tokens FROM n GROUP BY request_id",
    "batch_stats": "WITH " + _N + "," + _BATCHES + """,
r AS (SELECT request_id, count(*) AS k FROM n GROUP BY 1), g AS (SELECT count(*) AS k FROM b GROUP BY model, bucket, batch)
SELECT count(*) AS submitted_items, count(*) FILTER (bucket = 0) AS bucket_0, count(*) FILTER (bucket = 1) AS bucket_1, count(*) FILTER (bucket = 2) AS bucket_2, count(*) FILTER (bucket = 3) AS bucket_3,
  CAST(sum(greatest(n, 1)) AS BIGINT) AS token_sum, round(sum(greatest(n, 1)) / count(*), 6) AS mean_tokens, max(greatest(n, 1)) AS max_tokens,
  (SELECT count(*) FROM r) AS requests, (SELECT count(*) FROM r WHERE k > 1) AS list_requests, (SELECT max(k) FROM r) AS largest_request,
  (SELECT count(*) FROM g) AS backend_batches, (SELECT CAST(sum(k) AS BIGINT) FROM g) AS backend_items, (SELECT CAST(sum(k) AS BIGINT) FROM g WHERE k > 1) AS batched_items,
  (SELECT count(*) FROM g WHERE k = 1) AS batches_of_1, (SELECT count(*) FROM g WHERE k = 2) AS batches_of_2, (SELECT count(*) FROM g WHERE k = 3) AS batches_of_3, (SELECT count(*) FROM g WHERE k >= 4) AS batches_of_4
FROM n""",
    "normalize_embed_input": "SELECT conv_id || '-' || (turn // 64) AS request_id, CAST(row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) - 1 AS INT) AS item_index, text AS input FROM conversations",
    "route_embedding": """
SELECT conv_id, turn, ['bge', 'ir', 'st', 'clip', 'dinov3', 'none'][conv_id % 6 + 1] AS model,
  CASE WHEN conv_id % 6 = 5 THEN NULL WHEN conv_id % 6 = 4 THEN CASE WHEN turn % 3 = 0 THEN 'visual' END WHEN turn % 3 = 0 THEN 'multimodal_image'
       WHEN conv_id % 6 = 3 THEN 'multimodal_text' ELSE ['chunked', 'pooled_ir', 'sentence_transformer'][conv_id % 6 + 1] END AS route,
  CASE WHEN conv_id % 6 = 5 THEN 404 WHEN conv_id % 6 = 4 AND turn % 3 <> 0 THEN 400 END AS error_code FROM conversations""",
    "apply_query_prefix": "SELECT conv_id, turn, CASE WHEN role = 'user' AND conv_id % 6 = 1 THEN 'query: ' WHEN role = 'user' AND conv_id % 6 = 2 THEN 'search: ' ELSE '' END || text AS text FROM conversations",
    "mean_pool": "SELECT vec_id AS media_id, CAST(i - 1 AS INT) AS i, round((CAST(embedding[i] AS DOUBLE) + embedding[65 - i]) / 2, 5) + 0.0 AS x FROM embeddings, range(1, 65) AS r(i)",
    "decode_predictions": "SELECT vec_id AS media_id, CAST(i - 1 AS INT) AS i, round(CAST(embedding[i] AS DOUBLE), 5) + 0.0 AS x FROM embeddings, range(1, 65) AS r(i)",
    "l2_normalize": "SELECT vec_id AS media_id, CAST(i - 1 AS INT) AS i, round(CAST(v[i] AS DOUBLE) / sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) ** 2))), 5) + 0.0 AS x FROM (SELECT vec_id, " + _VISUAL + " AS v FROM embeddings), range(1, 33) AS r(i)",
    "merge_chunk_vectors": """
WITH m AS (SELECT label, i, sum(CAST(embedding[i] AS DOUBLE) * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1) AS x FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i)
SELECT label AS text_id, CAST(i - 1 AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) + 0.0 AS x FROM m""",
    "embed_table": "WITH t AS (SELECT conv_id, turn, text FROM conversations)," + _ENCODED + "SELECT conv_id, turn, CAST(i - 1 AS INT) AS i, round(CAST(x[i] AS DOUBLE), 5) + 0.0 AS x FROM e, range(1, 17) AS r(i)",
    "decode_image_input": "SELECT page_id, ['data_uri', 'base64', 'error'][page_id % 3 + 1] AS kind, CASE WHEN page_id % 3 < 2 THEN CAST(strlen(html) AS INT) END AS n_bytes FROM pages",
    "figures_with_image": "WITH " + _FIG + "SELECT doc_id FROM h",
    "content_hash": "WITH " + _FIG + "SELECT doc_id, hash FROM h",
    "anti_join_existing": "WITH " + _FIG + "SELECT doc_id, hash FROM h WHERE hash NOT IN (SELECT hash FROM st)",
    "anti_join_filtered": "WITH " + _FIG + "SELECT doc_id, hash FROM h WHERE hash NOT IN (SELECT hash FROM st)",
    "dedup_within_batch": "WITH " + _FIG + "SELECT doc_id, hash FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY o) = 1",
    "attach_embeddings": "WITH " + _FIG + "SELECT doc_id, CASE WHEN hash IN (SELECT hash FROM h WHERE doc_id % 3 = 0) THEN 2 END AS mm, true AS no_visual FROM h",
    "ingest_job": "WITH " + _FIG + """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'chart' ELSE 'figure' END AS source_type, document_id AS source_uri, figure_id AS source_native_id, document_id AS parent_uri, 'image/png' AS mime_type, 1 AS page,
       caption, hash, 'p1' AS parser_provider, CASE WHEN hash IN (SELECT hash FROM h WHERE doc_id % 3 = 0) THEN 2 ELSE 0 END AS mm FROM first""",
    "ingest_summary": "WITH " + _FIG + "," + _RECORDS + """,
a AS (SELECT document_id, count(*) AS n FROM h GROUP BY 1), b AS (SELECT 'd' || (doc_id // 4) AS document_id, count(*) AS n, string_agg(media_id, ',' ORDER BY doc_id) AS ids FROM r GROUP BY 1)
SELECT d.document_id, CAST(coalesce(b.n, 0) AS INT) AS ingested_count, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS INT) AS skipped_duplicates, CAST(coalesce(b.n, 0) AS INT) AS n_ids,
       md5(coalesce(ids, '')) AS ids_md5
FROM (SELECT DISTINCT document_id FROM f) d LEFT JOIN a USING (document_id) LEFT JOIN b USING (document_id)""",
    "media_lookup": "WITH " + _FIG + "SELECT doc_id, hash FROM h WHERE hash IN (SELECT hash FROM st)",
    "validate_search": "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'text' ELSE 'image' END AS mode, CASE WHEN item_id % 2 = 1 AND item_id % 3 = 0 THEN 400 END AS error_code FROM benchmark",
    "extract_document_text": "WITH " + _CAND + "SELECT pos, text FROM c",
    "cap_candidates": "WITH " + _CAND + "SELECT query_id, pos, total FROM k",
    "truncate_candidates": "WITH " + _CAND + "SELECT query_id, pos, CAST(least(length(text), 1000) AS INT) AS n, length(text) > 1000 AS truncated FROM k",
    "rerank_score": "WITH " + _CAND + r""",
w AS (SELECT query_id, pos, len(list_filter(list_distinct(regexp_split_to_array(lower(q.text), '\s+')), lambda x: x <> '' AND list_contains(regexp_split_to_array(lower(left(k.text, 1000)), '\s+'), x))) AS s
      FROM k JOIN q USING (query_id))
SELECT query_id, pos, CAST(s AS DOUBLE) AS score FROM w""",
    "rerank_logits": "SELECT vec_id AS media_id, round(list_max(" + _VISUAL + "), 6) AS score FROM embeddings",
    "rerank_topn": "WITH " + _CAND + """
SELECT query_id, pos, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos % 7 DESC, pos) AS rank FROM c JOIN q USING (query_id))
WHERE query_id % 4 = 0 OR rank <= query_id % 4""",
    "rerank_meta": "WITH " + _CAND + """
SELECT query_id, false AS strict_recall, coalesce(max(total), 0) AS total_documents, count(pos) AS scored_documents, coalesce(max(total), 0) - count(pos) AS discarded_documents,
       count(*) FILTER (length(k.text) > 1000) AS text_truncated_documents, CAST(nullif(query_id % 4, 0) AS INT) AS applied_top_n
FROM q LEFT JOIN k USING (query_id) GROUP BY query_id""",
    "search_by_text": _SEARCH.format(asked="item_id % 2 = 0"),
    "search_by_image": _SEARCH.format(asked="item_id % 2 = 1 AND item_id % 3 <> 0"),
    "image_to_tensor_same_size": """
WITH p AS (SELECT vec_id, c, (CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 255) AS INT) / 255.0 - [0.485, 0.456, 0.406][c]) / [0.229, 0.224, 0.225][c] AS t FROM embeddings, range(1, 65) AS r(i), range(1, 4) AS s(c))
SELECT vec_id, CAST(c AS INT) AS channel, round(min(t), 3) AS least, round(max(t), 3) AS most, round(sum(t), 2) AS total FROM p GROUP BY vec_id, c""",
    "write_media": "WITH " + _FIG + "," + _RECORDS + """
SELECT media_id, figure_id AS source_native_id, hash, CASE WHEN hash IN (SELECT hash FROM h WHERE doc_id % 3 = 0) THEN '64,1' END AS multimodal, 0.0::DOUBLE AS created_at,
       'clip' AS embedding_model, (SELECT count(*) FROM first) AS stored FROM r""",
    "media_get": "WITH " + _FIG + "," + _RECORDS + """
SELECT media_id, hash, CAST(count(*) OVER () AS BIGINT) AS found FROM r WHERE doc_id % 2 = 0""",
    "search_ingested": "WITH " + _FIG + "," + _RECORDS + """,
t AS (SELECT 'q' AS side, CAST(item_id AS VARCHAR) AS id, 0 AS odd, text FROM benchmark UNION ALL SELECT 'm', media_id, doc_id % 2, image FROM r),""" + _ENCODED.replace("h AS (", "hh AS (").replace("FROM h)", "FROM hh)") + """,
s AS (SELECT q.id AS query_id, m.id AS media_id, list_sum(list_transform(range(1, 17), lambda k: (CAST(m.x[k] AS DOUBLE) - q.x[k]) ** 2)) AS d FROM e q JOIN e m ON q.side = 'q' AND m.side = 'm' AND m.odd = 1)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, media_id, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, media_id) AS rank FROM s) WHERE rank <= 5""",
}
ORACLE_SQL |= {f"{name}_all": ORACLE_SQL[name] for name in _ALL}
