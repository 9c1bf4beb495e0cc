"""Dimension tables from configuration files, and the media table."""

from __future__ import annotations

import hashlib
import json
import os

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER_SCHEMA = (
    "name string, ordinal int, driver string, location string, enabled boolean, priority int, timeout double, "
    "capabilities array<string>, model string, api_mode string, executable_present boolean"
)
MODEL_SCHEMA = (
    "id string, type string, ovms_model string, embedding_backend string, tokenizer_path string, max_length int, batch_size int, "
    "query_prefix string, preferred_device string, fallback_device string, policy string"
)
#: Drivers that a provider may name (fixed values).
DRIVERS = ("http", "command", "cli")
#: Models where no file names any: id, type, served name (fixed values).
DEFAULT_MODELS = (
    ("qwen-reranker", "rerank", "qwen-reranker"), ("bge-m3-i8", "embedding", "bge-m3-i8"), ("bge-m3", "embedding", "bge-m3-i8"),
    ("jina-clip-v2", "multimodal_embedding", "jina-clip-v2"), ("dinov3", "dino_embedding", "dinov3"),
)
#: What a model has unless its entry says otherwise (fixed values).
MODEL_DEFAULTS = {"preferred_device": "GPU", "fallback_device": "CPU", "policy": "GPU_PREFERRED"}


def load_provider_dim(spark: SparkSession, path: str, explicit: bool = True, executables: frozenset[str] | None = None) -> DataFrame:
    """Providers of a YAML file in file order. A missing or empty file is an error only if it was named explicitly."""
    if not os.path.exists(path):
        if explicit:
            raise FileNotFoundError(f"provider configuration {path!r} does not exist")
        return spark.createDataFrame([], PROVIDER_SCHEMA)
    with open(path, encoding="utf-8") as f:
        return provider_dim(spark, f.read(), path, explicit, executables)


def provider_dim(spark: SparkSession, text: str, path: str = "", explicit: bool = True, executables: frozenset[str] | None = None) -> DataFrame:
    """Providers of YAML text; ``path`` names it in errors."""
    rows = []
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuntimeError(f"provider configuration {path!r} is not YAML: {e}") from e
    if not isinstance(data, dict):
        raise ValueError(f"provider configuration {path!r} must be a dictionary")
    listed = data.get("providers", {})
    if explicit and not (isinstance(listed, dict) and listed):
        raise ValueError(f"provider configuration {path!r} has no providers")
    for name, p in (listed or {}).items():
        if not isinstance(p, dict):
            continue
        driver = p.get("driver", "http")
        if driver not in DRIVERS:
            raise ValueError(f"unknown driver {driver!r} of provider {name!r}")
        present = None if driver == "http" or executables is None else p.get("command") in executables
        rows.append((
            name, len(rows), driver, p.get("location", "remote"), bool(p.get("enabled", True)), int(p.get("priority", 100)),
            float(p.get("timeout_seconds") or p.get("timeout", 300.0)), [str(c) for c in p.get("capabilities") or []], p.get("model"), p.get("api_mode"), present,
        ))
    return spark.createDataFrame(rows, PROVIDER_SCHEMA)


def _models(path: str | None, parse) -> dict:
    """Entries of a registry file by id; empty if there is no such file or it isn't one."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return _entries(parse(f), parse is json.load)


def _entries(data, bare: bool) -> dict:
    listed = data.get("models", data if bare else None) if isinstance(data, dict) else None
    return {k: m for k, m in listed.items() if isinstance(m, dict)} if isinstance(listed, dict) else {}


def load_model_dim(spark: SparkSession, yaml_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """Models of the YAML file, else of the JSON file, else DEFAULT_MODELS; the served name defaults to model_id, then to the id."""
    return _model_rows(spark, _models(yaml_path, yaml.safe_load) or _models(json_path, json.load))


def model_dim(spark: SparkSession, text: str) -> DataFrame:
    """Models of YAML text."""
    return _model_rows(spark, _entries(yaml.safe_load(text), False))


def _model_rows(spark: SparkSession, models: dict) -> DataFrame:
    models = models or {i: {"type": kind, "ovms_model": served} for i, kind, served in DEFAULT_MODELS}
    names = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]
    rows = []
    for name, given in models.items():
        m = {**MODEL_DEFAULTS, "ovms_model": given.get("model_id", name), **given, "id": name}
        rows.append(tuple(m.get(c) for c in names))
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def media_path(root: str, mm_size: int, dino_size: int) -> str:
    return f"{root}/media_{mm_size}_{dino_size}"


#: Buckets of a media table, by hash.
BUCKETS = 64


def _table(spark: SparkSession, path: str) -> str:
    """The session's name for the media table at ``path``."""
    return f"media_{hashlib.md5(path.encode()).hexdigest()}"


def write_media(records: DataFrame, root: str, sizes: tuple[int, int]) -> None:
    """Append validated records to the table of these vector sizes.

    The table is bucketed and sorted by hash, so a lookup or a join by hash reads one
    bucket of each, or none anew; Parquet Bloom filters on hash and media_id let
    lookups skip the row groups that lack a value.
    """
    spark, path = records.sparkSession, media_path(root, *sizes)
    writer = records.repartition(BUCKETS, "hash").write.mode("append").format("parquet").option("path", path)
    for column in ("hash", "media_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    name = _table(spark, path)
    if not spark.catalog.tableExists(name):
        _register(spark, path, name)
    writer.bucketBy(BUCKETS, "hash").sortBy("hash").saveAsTable(name)


def _register(spark: SparkSession, path: str, name: str) -> bool:
    """Makes the files at ``path``, if there are any, known to this session as a bucketed table."""
    try:
        schema = spark.read.parquet(path).schema
    except AnalysisException as e:
        if not any(c in str(e) for c in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {BUCKETS} BUCKETS LOCATION '{path}'")
    return True


def read_media(spark: SparkSession, root: str, sizes: tuple[int, int]) -> DataFrame:
    """The table of these vector sizes; an error if nothing was ever written to it."""
    path = media_path(root, *sizes)
    name = _table(spark, path)
    if not spark.catalog.tableExists(name) and not _register(spark, path, name):
        return spark.read.parquet(path)  # which says what is missing
    spark.catalog.refreshTable(name)
    return spark.table(name)


def media_get_by_id(media: DataFrame, media_id: str) -> DataFrame:
    """Reads the row groups whose Bloom filter may hold the id."""
    return media.where(F.col("media_id") == media_id).limit(1)


def media_get_by_hash(media: DataFrame, content_hash: str) -> DataFrame:
    """Reads one bucket."""
    return media.where(F.col("hash") == content_hash).limit(1)


def media_get_many(media: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (media_id); a join for many of them at once."""
    return media.join(ids.select("media_id").distinct(), "media_id", "left_semi")


def media_count(media: DataFrame) -> int:
    return media.count()
