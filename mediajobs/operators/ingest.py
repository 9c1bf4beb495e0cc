"""Figures to media records: content hashes, deduplication, vectors, dimension checks.

Images are hashed once and left out of every shuffle but the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_empty
from .search import validate_dimensions


def figures_with_image(figures: DataFrame) -> DataFrame:
    return figures.where(F.coalesce(F.length("image") > 0, F.lit(False)))


def content_hash(image: Column) -> Column:
    """SHA-256 hex of the image string as UTF-8."""
    return F.sha2(F.encode(image, "UTF-8"), 256)


def anti_join_existing(figures: DataFrame, media: DataFrame) -> DataFrame:
    """``figures`` (hash) whose hash the media table lacks; only its hash column is read.

    ``known.new_figures`` does the same with a stored filter, and shuffles few of them.
    """
    return figures.join(media.select("hash").where("hash is not null"), "hash", "left_anti")


def duplicates_of_existing(figures: DataFrame, media: DataFrame) -> DataFrame:
    return figures.join(media.select("hash"), "hash", "left_semi")


def dedup_within_batch(figures: DataFrame) -> DataFrame:
    """The first row of each hash by (doc_ordinal, pos), with map-side combine rather than a window over a hot hash."""
    order = F.struct("doc_ordinal", "pos")
    first = figures.groupBy("hash").agg(F.min(order).alias("o")).select("hash", "o.doc_ordinal", "o.pos")
    return figures.join(first, ["hash", "doc_ordinal", "pos"], "left_semi")


def attach_embeddings(figures: DataFrame, vectors: DataFrame, embedding_model: str, dino_model: str) -> DataFrame:
    """``figures`` with multimodal_vector and dino_vector from ``vectors`` (hash, model, vector); null where there is none.

    Of several vectors of one hash and model, the smallest is taken, so figures stay as many as they are.
    """
    out = figures
    for model, name in ((embedding_model, "multimodal_vector"), (dino_model, "dino_vector")):
        found = vectors.where(F.col("model") == model).groupBy("hash").agg(F.min("vector").alias(name))
        out = out.join(found, "hash", "left").withColumn(name, F.when(F.size(name) > 0, F.col(name)))
    return out.withColumn("embedding_model", F.lit(embedding_model))


def media_id_of() -> Column:
    """Id of the record of a hashed figure."""
    key = F.concat_ws("\x1f", "hash", "document_id", "figure_id", F.col("pos").cast("string"))
    return F.substring(F.sha2(key, 256), 1, 32)


def build_media_records(figures: DataFrame, as_of: float) -> DataFrame:
    """Figures with their document to media records; ids are hashes, so retries agree."""
    null = F.lit(None).cast("string")
    return figures.select(
        media_id_of().alias("media_id"),
        F.coalesce(non_empty(F.col("figure_type")), F.lit("figure")).alias("source_type"),
        F.coalesce(non_empty(F.col("source_uri")), F.col("document_id")).alias("source_uri"),
        F.col("figure_id").alias("source_native_id"),
        F.col("document_id").alias("parent_uri"),
        F.lit("image/png").alias("mime_type"),
        "page",
        F.col("figure_id").alias("figure_number"),
        "caption",
        "ocr_text",
        null.alias("vlm_summary"),
        "hash",
        F.lit(float(as_of)).alias("created_at"),
        F.lit(float(as_of)).alias("updated_at"),
        "multimodal_vector",
        "dino_vector",
        F.col("provider_name").alias("parser_provider"),
        null.alias("parser_version"),
        "embedding_model",
        null.alias("embedding_version"),
    )


def ingest(figures: DataFrame, media: DataFrame, vectors: DataFrame, embedding_model: str, dino_model: str, sizes: tuple[int, int], as_of: float) -> tuple[DataFrame, DataFrame]:
    """(new media records, hashed figures with image). Wrong vector sizes fail before anything is written."""
    hashed = figures_with_image(figures).withColumn("hash", content_hash(F.col("image"))).drop("image")
    new = dedup_within_batch(anti_join_existing(hashed, media))
    records = build_media_records(attach_embeddings(new, vectors, embedding_model, dino_model), as_of)
    records = validate_dimensions(records, "multimodal_vector", sizes[0])
    return validate_dimensions(records, "dino_vector", sizes[1]), hashed


def ingest_summary(documents: DataFrame, hashed: DataFrame, records: DataFrame) -> DataFrame:
    """Per document: ingested_count, skipped_duplicates, media_ids in order of figures; zeros without figures."""
    seen = hashed.groupBy("document_id").agg(F.count("*").alias("n"))
    # a figure's record is found by its id, which holds its place; figure ids may repeat
    made = hashed.select("document_id", "pos", media_id_of().alias("media_id")).join(records.select("media_id"), "media_id", "left_semi")
    made = made.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("pos", "media_id"))), lambda x: x["media_id"]).alias("media_ids"))
    out = documents.select("document_id").join(seen, "document_id", "left").join(made, "document_id", "left")
    ids = F.coalesce("media_ids", F.array().cast("array<string>"))
    return out.select("document_id", F.size(ids).alias("ingested_count"), (F.coalesce("n", F.lit(0)) - F.size(ids)).cast("int").alias("skipped_duplicates"), ids.alias("media_ids"))
