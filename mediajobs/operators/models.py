"""Injected model functions and their deterministic defaults.

An encoder maps a list of strings to an array of vectors, a tokenizer to lists of
ids, a scorer (query, text) pairs to scores. Defaults are hashes, so tests and
retries agree; real models are passed in, and loaded once per worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces


#: Words repeat; a worker keeps the numbers of the latest ones.
@lru_cache(1 << 16)
def _number(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hash_tokenizer(texts: list[str]) -> list[list[int]]:
    """White-space words as the first 32 bits of their md5, modulo 30,000, plus 1,000."""
    return [[1000 + _number(w) % 30000 for w in (t or "").split()] for t in texts]


def hash_encoder(texts: list[str], size: int = 16) -> np.ndarray:
    """A vector of word-hash counts, normalised."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.fromiter((_number(w) % size for w in (t or "").split()), np.int64), minlength=size)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """Distinct words of the query that the text has."""
    return [float(len(set((q or "").lower().split()) & set((t or "").lower().split()))) for q, t in zip(queries, texts, strict=True)]


def tokenize(text: Column, tokenizer: Callable = hash_tokenizer, max_length: int | None = None) -> Column:
    """Token ids of ``text`` (null: none), cut to ``max_length`` (8 at least) if given."""

    most = None if max_length is None else max(8, max_length)

    def run(texts: pa.Array) -> pa.Array:
        made = [pa.array([list(x)[:most] for x in tokenizer(p.to_pylist())], pa.list_(pa.int32())) for p in pieces(texts)]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def embed_table(items: DataFrame, encoder: Callable = hash_encoder, column: str = "input", batch: int = 32) -> DataFrame:
    """``items`` with ``vector`` array<float>, encoded in batches."""
    schema = items.withColumn("vector", F.lit(None).cast("array<float>")).schema

    def encoded(texts: list) -> pa.Array:
        vectors = [np.asarray(v, np.float32) for i in range(0, len(texts), batch) for v in encoder(texts[i : i + batch])]
        ends = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vectors)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (piece for part in parts for piece in pieces(part)):
            columns = dict(zip(p.schema.names, p.columns, strict=True)) | {"vector": encoded(p.column(column).to_pylist())}
            yield pa.RecordBatch.from_pydict(columns)

    return items.mapInArrow(run, schema)


def rerank_score(pairs: DataFrame, scorer: Callable = overlap_scorer, batch: int = 2) -> DataFrame:
    """``pairs`` (query, text, ...) with ``score``."""

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(q), batch):
            out += scorer(q.iloc[i : i + batch].tolist(), t.iloc[i : i + batch].tolist())
        return pd.Series(out, dtype=float)

    return pairs.withColumn("score", F.pandas_udf(run, "double")(F.col("query"), F.col("text")))


def score_of_logits(logits: Column) -> Column:
    """Greatest value over the vocabulary at the last position."""
    return F.array_max(F.element_at(logits, -1))
