"""Preparing texts for embedding models, and pooling what the models return.

Tokens are arrays of ids; chunks, batches and statistics are Column expressions.
Models are injected functions (``models.py``).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.sizes import small

#: Limits (fixed values).
CLIP, CHUNK, OVERLAP = 8192, 1024, 128
#: Token counts up to which a bucket reaches, and its batch size; the last holds the rest.
BUCKETS = ((256, 4), (384, 2), (512, 2), (None, 1))


def normalize_embed_input(requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, inputs array<string>, ...) to one row per item: item_index, input; no inputs is an error."""
    checked = F.when(F.col("inputs").isNotNull(), F.col("inputs")).otherwise(F.raise_error(F.lit("input must be a string or a list")))
    return requests.select("*", F.posexplode(checked).alias("item_index", "input")).drop("inputs")


def route_embedding(requests: DataFrame, models: DataFrame) -> DataFrame:
    """``requests`` (model, modality, ...) with route, or error_code: visual, multimodal_image, multimodal_text, pooled_ir, sentence_transformer, chunked."""
    m = small(models.select(F.col("id").alias("model"), F.col("type").alias("_type"), F.col("embedding_backend").alias("_backend"), F.lit(True).alias("_known")))
    out = requests.join(m, "model", "left")
    image = F.col("modality") == "image"
    visual = (F.col("_type") == "dino_embedding") | F.lower("model").startswith("dino")
    known = F.coalesce("_known", F.lit(False))
    error = F.when(~known, 404).when(visual & ~image, 400)
    route = (
        F.when(visual, "visual").when((F.col("_type") == "multimodal_embedding") & image, "multimodal_image")
        .when(F.col("_type") == "multimodal_embedding", "multimodal_text").when(image, "multimodal_image")
        .when(F.col("_backend") == "pooled_ir", "pooled_ir").when(F.col("_backend") == "sentence_transformer", "sentence_transformer")
        .otherwise("chunked")
    )
    return out.withColumn("error_code", error).withColumn("route", F.when(error.isNull(), route)).drop("_type", "_backend", "_known")


def apply_query_prefix(text: Column, input_type: Column, prefix: Column) -> Column:
    return F.when((input_type == "query") & (F.coalesce(prefix, F.lit("")) != ""), F.concat(prefix, text)).otherwise(text)


def guarded(chunk: int, overlap: int) -> tuple[int, int, int]:
    """Chunk, overlap and step within their limits: chunk >= 8, overlap <= chunk - 4, step >= 1."""
    chunk = max(8, chunk)
    overlap = max(0, min(overlap, chunk - 4))
    return chunk, overlap, max(1, chunk - overlap)


def chunk_starts(n: Column, chunk: int = CHUNK, overlap: int = OVERLAP, clip: int = CLIP) -> Column:
    """Starts of the chunks of ``n`` tokens; one empty chunk for none."""
    chunk, _, step = guarded(chunk, overlap)
    last = F.greatest(F.lit(0), F.ceil((F.least(n, F.lit(clip)) - chunk) / float(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def chunk_tokens(texts: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP, clip: int = CLIP) -> DataFrame:
    """``texts`` (text_id, ids) to chunks: text_id, chunk_index, start, ids."""
    size, _, _ = guarded(chunk, overlap)
    rows = texts.withColumn("_ids", F.slice("ids", 1, clip)).drop("ids")
    rows = rows.select("*", F.posexplode(chunk_starts(F.size("_ids"), chunk, overlap, clip)).alias("chunk_index", "start"))
    return rows.withColumn("ids", F.slice("_ids", F.col("start") + 1, size)).drop("_ids")


def build_chunk_instances(chunks: DataFrame, begin: int, end: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks cut to ``chunk`` - 2 tokens with begin and end ids, an all-ones mask, and their weight."""
    ids = F.concat(F.array(F.lit(begin)), F.slice("ids", 1, chunk - 2), F.array(F.lit(end)))
    out = chunks.withColumn("ids", ids)
    return out.withColumns({"mask": F.transform("ids", lambda _: F.lit(1)), "weight": F.size("ids")})


def pad_batch(rows: DataFrame, pad: int = 0) -> DataFrame:
    """``rows`` (batch_id, ids, mask) padded to the longest of each batch."""
    longest = F.max(F.size("ids")).over(W.partitionBy("batch_id"))
    rows = rows.withColumn("_missing", longest - F.size("ids"))
    return rows.withColumns(
        {"ids": F.concat("ids", F.array_repeat(F.lit(pad), F.col("_missing"))), "mask": F.concat("mask", F.array_repeat(F.lit(0), F.col("_missing")))}
    ).drop("_missing")


def bucket_of(n: Column) -> Column:
    out = F
    for k, (most, _) in enumerate(BUCKETS):
        out = out.when(n <= most, k) if most else out.otherwise(k)
    return out


def length_bucket_batches(items: DataFrame) -> DataFrame:
    """``items`` (model, arrival, n_tokens) with bucket and batch: first in, first out within model and bucket.

    Models and buckets are few and hold any share of the items, so places are sums over slices of arrival.
    """
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    size = F.element_at(F.array(*[F.lit(s) for _, s in BUCKETS]), bucket_of(n) + 1)
    placed = numbered(items.withColumn("bucket", bucket_of(n)), ["model", "bucket"], "arrival", "_place")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Masked mean of token vectors (array of arrays); the divisor is 1e-9 at least."""
    total = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    weighted = F.zip_with(hidden, mask, lambda v, m: F.transform(v, lambda x: x * m))
    zero = F.transform(F.element_at(hidden, 1), lambda _: F.lit(0.0).cast("double"))
    summed = F.aggregate(weighted, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(summed, lambda x: x / F.greatest(total, F.lit(1e-9)))


def decode_predictions(rows: DataFrame) -> DataFrame:
    """``rows`` (sentence_embedding, token_embeddings, last_hidden_state, output, mask) with ``vector``."""
    hidden = F.coalesce("token_embeddings", "last_hidden_state", "output")
    found = F.coalesce("sentence_embedding", F.when(hidden.isNotNull(), mean_pool(hidden, F.col("mask"))))
    return rows.withColumn("vector", F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("prediction without a known output"))))


def l2_normalize(vector: Column) -> Column:
    """``vector`` over its length; a zero vector is left as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector.cast("array<double>"))


def merge_chunk_vectors(chunks: DataFrame) -> DataFrame:
    """``chunks`` (text_id, vector, weight) to text_id, vector: weighted mean (weights 1 at least), normalised."""
    weight = F.greatest(F.col("weight"), F.lit(1)).cast("double")
    mean = Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")), weight)
    return chunks.groupBy("text_id").agg(vector_to_array(mean).alias("vector")).withColumn("vector", l2_normalize(F.col("vector")))


def embedding_usage(items: DataFrame) -> DataFrame:
    """``items`` (request_id, modality, n_tokens) to prompt_tokens and total_tokens; images count 1 each."""
    n = F.when(F.col("modality") == "image", F.lit(1)).otherwise(F.col("n_tokens")).cast("long")
    return items.groupBy("request_id").agg(F.sum(n).alias("prompt_tokens")).withColumn("total_tokens", F.col("prompt_tokens"))


def batch_stats(items: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """One row of statistics: ``items`` (request_id, n_tokens), ``batches`` (one row per batch, n_items)."""
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    per = items.withColumn("n", n.cast("long")).withColumn("bucket", bucket_of(n)).groupBy("request_id").agg(
        F.count("*").alias("items"), F.sum("n").alias("tokens"), F.max("n").alias("most"),
        *[F.count_if(F.col("bucket") == k).alias(f"b{k}") for k in range(len(BUCKETS))],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    stats = per.agg(
        total("items").alias("submitted_items"), *[total(f"b{k}").alias(f"bucket_{k}") for k in range(len(BUCKETS))], total("tokens").alias("token_sum"),
        (total("tokens") / F.greatest(F.lit(1), total("items"))).alias("mean_tokens"), F.coalesce(F.max("most"), F.lit(0)).alias("max_tokens"),
        F.count("*").alias("requests"), F.count_if(F.col("items") > 1).alias("list_requests"), F.coalesce(F.max("items"), F.lit(0)).alias("largest_request"),
    )
    if batches is None:
        return stats
    size = F.least(F.col("n_items"), F.lit(4))
    return stats.crossJoin(  # one row with one row
        batches.agg(F.count("*").alias("backend_batches"), total("n_items").alias("backend_items"), total(F.when(F.col("n_items") > 1, F.col("n_items"))).alias("batched_items"), *[F.count_if(size == k).alias(f"batches_of_{k}") for k in (1, 2, 3, 4)])
    )
