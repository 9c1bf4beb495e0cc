"""Reranking candidates of queries.

``candidates``: query_id, pos, document (JSON text or plain text). Rows of one
query are few (MAX_DOCS are scored); windows are over (query_id).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.sizes import spread, tasks_of_bytes

#: Limits (fixed values).
MAX_DOCS, MAX_CHARS = 8, 1000
#: Keys of a document that are read, in this order, and keys whose lists are read after them (fixed values).
TEXT_KEYS = (
    "title", "name", "abstract", "summary", "snippet", "description", "text", "content", "route", "reaction", "conditions",
    "reagents", "reactants", "products", "source", "institution", "degree", "year",
)
LIST_KEYS = ("steps", "step_list", "items", "routes", "documents")
#: What ``str.strip`` takes off; how JSON's objects, lists and strings begin, how its other values do, and a pattern that none of these misses.
SPACE = "".join(filter(str.isspace, map(chr, range(0x3001))))
OPENING, SCALAR, SCALARS = '{["', "-0123456789tfnNI", "^[ \\t\\n\\r]*(true|false|null|NaN|-?Infinity|-?[0-9][0-9.eE+-]*)[ \\t\\n\\r]*$"


def flatten_text(value) -> str:
    """Readable text of a JSON value; numbers (and booleans) under TEXT_KEYS count, elsewhere only strings do."""
    if value is None:
        return ""
    if isinstance(value, list):
        return " ".join(filter(None, map(flatten_text, value)))
    if not isinstance(value, dict):
        return str(value).strip()
    named = (value.get(k) for k in TEXT_KEYS)
    parts = [v.strip() if isinstance(v, str) else str(v) for v in named if isinstance(v, (str, int, float))]
    for k in LIST_KEYS:
        if isinstance(value.get(k), list):
            parts += map(flatten_text, value[k])
    if not any(parts):
        parts = [v.strip() for v in value.values() if isinstance(v, str)]
    return " ".join(filter(None, parts)).strip()


def _text(document: str | None) -> str:
    try:
        return flatten_text(json.loads(document))
    except (TypeError, ValueError):
        return (document or "").strip()


def _texts(documents: pa.Array, most: int | None = None) -> pa.Array:
    made = [pa.array([_text(d)[:most] for d in p.to_pylist()], pa.string()) for p in pieces(documents)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def extract_document_text(document: Column, most: int | None = None) -> Column:
    """Text of a candidate: JSON objects and lists flattened, plain text stripped; its first ``most`` characters, if given.

    Only documents that may be JSON are sent to Python, which decides about them.
    """

    def texts(documents: pa.Array) -> pa.Array:
        return _texts(documents, most)

    first = F.substring(F.ltrim(document, F.lit(" \t\n\r")), 1, 1)
    json_like = first.isin(*OPENING) | (first.isin(*SCALAR) & document.rlike(SCALARS))
    made = F.arrow_udf(texts, "string")(F.when(json_like, document))
    plain = F.coalesce(F.btrim(document, F.lit(SPACE)), F.lit(""))
    return F.when(json_like, made).otherwise(plain if most is None else F.substring(plain, 1, most))


def cap_candidates(candidates: DataFrame, most: int = MAX_DOCS, strict: bool = False) -> DataFrame:
    """The first ``most`` candidates of each query, with total; strict: more are an error."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("pos"))
    total = F.count("*").over(W.partitionBy("query_id"))
    rows = candidates.withColumn("total", total)
    if strict:
        rows = rows.withColumn("total", F.when(F.col("total") <= most, F.col("total")).otherwise(F.raise_error(F.lit("too many documents")).cast("long")))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def truncate_candidates(candidates: DataFrame, chars: int = MAX_CHARS) -> DataFrame:
    """``text`` (empty: the document itself) cut to ``chars``, and truncated."""
    text = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.col("text")).otherwise(F.col("document"))
    return candidates.withColumn("text", text).withColumn("truncated", F.coalesce(F.length("text") > chars, F.lit(False))).withColumn("text", F.substring("text", 1, chars))


def text_candidates(candidates: DataFrame, most: int = MAX_DOCS, chars: int = MAX_CHARS, strict: bool = False) -> DataFrame:
    """Capped candidates with their extracted texts, truncated.

    Tasks are as many as the documents' bytes ask for: Python gets what a task holds
    in batches of up to 10,000 rows, whatever their size.
    """
    rows = spread(candidates, tasks_of_bytes(candidates, "document"), "query_id")
    # one character more than is kept tells that a text was longer
    return truncate_candidates(cap_candidates(rows, most, strict).withColumn("text", extract_document_text(F.col("document"), chars + 1)), chars)


def rerank_topn(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """``scored`` (query_id, pos, score) with rank by score, ties in order of pos; cut to top_n where it is above 0."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    top = F.coalesce("top_n", F.lit(0))
    checked = F.when(top >= 0, top).otherwise(F.raise_error(F.lit("top_n must not be negative")).cast("int"))
    rows = scored.join(queries.select("query_id", checked.alias("_top")), "query_id").withColumn("rank", F.row_number().over(order))
    return rows.where((F.col("_top") == 0) | (F.col("rank") <= F.col("_top"))).drop("_top")


def rerank_meta(queries: DataFrame, capped: DataFrame, strict: bool = False) -> DataFrame:
    """Per query: strict_recall, total, scored, discarded and truncated documents, applied_top_n; zeros without candidates."""
    per = capped.groupBy("query_id").agg(F.max("total").alias("total"), F.count("*").alias("scored"), F.count_if("truncated").alias("cut"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return queries.join(per, "query_id", "left").select(
        "query_id", F.lit(strict).alias("strict_recall"), n("total").alias("total_documents"), n("scored").alias("scored_documents"),
        (n("total") - n("scored")).alias("discarded_documents"), n("cut").alias("text_truncated_documents"),
        F.when(F.col("top_n") > 0, F.col("top_n")).alias("applied_top_n"),
    )
