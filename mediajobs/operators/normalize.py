"""Raw parser payloads to typed document, page, block, figure and table tables.

``raw`` is a DataFrame (document_id string, payload string of JSON). The payload
is parsed to a VARIANT once (``parsed``); all child tables are narrow
projections of it, without a shuffle. Items of a list are built by one function
each (``page``, ``block``, ...), for child tables and for nested documents alike.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import as_array, as_string, bound, falsy, is_array, is_object, path_eval
from ..functions.numbering import numbered
from ..functions.text import clean_caption, coerce_page, join_stripped

#: Keys that never leave a sanitised payload (fixed values; compared case-insensitively).
PRIVATE_KEYS = (
    "token", "api_key", "access_token", "refresh_token", "authorization", "password", "secret", "file_content_base64",
    "upload_url", "agent_upload_url", "full_zip_url", "markdown_url", "jsonl_url", "resulturl",
)


@dataclass(frozen=True)
class Mapping:
    """Path expressions of a provider's payload (defaults are fixed values)."""

    markdown: str | None = "markdown || text || data.markdown || data.text"
    text: str | None = None
    pages: str | None = "pages || data.pages"
    blocks: str | None = "blocks || data.blocks || data.layout_blocks || result"
    figures: str | None = "figures || data.figures"
    tables: str | None = "tables || data.tables"
    block_type: str | None = "type || label"
    block_content: str | None = "content || text || res"
    block_page: str | None = "page"
    block_bbox: str | None = "bbox"
    figure_id: str | None = "id || figure_id"
    figure_image: str | None = "image || img || image_base64 || image_url"
    figure_caption: str | None = "caption"
    figure_page: str | None = "page"
    figure_bbox: str | None = "bbox"
    figure_ocr: str | None = "ocr_text || ocr"
    table_id: str | None = "id || table_id"
    table_markdown: str | None = "markdown || content"
    table_html: str | None = "html"
    table_page: str | None = "page"
    table_caption: str | None = "caption"


def parsed(raw: DataFrame) -> DataFrame:
    """``raw`` with the payload as variant ``v``."""
    return raw.withColumn("v", F.try_parse_json("payload"))


def _rows(parsed_raw: DataFrame, path: str | None, build) -> DataFrame:
    """One row per object in the list at ``path``: document_id, pos (place in the raw list), and the fields that ``build`` makes."""
    listed = parsed_raw.select("document_id", F.posexplode(as_array(path_eval(path, F.col("v")))).alias("pos", "item"))
    return listed.where(is_object(F.col("item"))).select("document_id", "pos", *build(F.col("document_id"), F.col("pos"), F.col("item")))


def _nested(path: str | None, build) -> Column:
    """The same as an array of structs (pos, fields), in order; empty where there is no list."""
    found = as_array(path_eval(path, F.col("v")))
    row = lambda item, pos: F.when(is_object(item), F.struct(pos.alias("pos"), *build(F.col("document_id"), pos, item)))
    out = F.filter(F.transform(found, row), lambda x: x.isNotNull())
    return F.coalesce(out, F.slice(F.transform(F.array(F.parse_json(F.lit("{}"))), row), 2, 1))


def _bbox(value: Column) -> Column:
    return F.when(is_array(value), F.try_variant_get(value, "$", "array<double>"))


def page(document: Column, pos: Column, item: Column) -> list[Column]:
    number = F.try_variant_get(item, "$.page_number", "int")
    return [
        F.coalesce(number, pos + 1).alias("page_number"),
        F.try_variant_get(item, "$.width", "double").alias("width"),
        F.try_variant_get(item, "$.height", "double").alias("height"),
        as_string(F.try_variant_get(item, "$.text", "variant")).alias("text"),
    ]


def normalize_pages(parsed_raw: DataFrame, m: Mapping = Mapping()) -> DataFrame:
    return _rows(parsed_raw, m.pages, page)


def block_type(raw_type: Column) -> Column:
    """One of heading, table, figure, formula, text; the first test that fits decides."""
    t = F.lower(raw_type)
    has = lambda *words: F.greatest(*[t.contains(w) for w in words], F.lit(False))
    return (
        F.when(has("head", "title"), "heading").when(has("table"), "table").when(has("figure", "image", "chart"), "figure")
        .when(has("formula"), "formula").otherwise("text")
    )


def block_content(value: Column) -> Column:
    """A list's lines (an object's ``text``) joined by newlines, else the string form."""
    line = lambda x: F.when(
        is_object(x), F.coalesce(as_string(F.try_variant_get(x, "$.text", "variant")), F.lit(""))
    ).otherwise(F.coalesce(as_string(x), F.lit("null")))
    return bound(value, lambda v: F.coalesce(F.array_join(F.transform(as_array(v), line), "\n"), as_string(v), F.lit("")))


def block(m: Mapping):
    return lambda document, pos, item: [
        F.concat(document, F.lit("-b"), pos.cast("string")).alias("block_id"),
        block_type(F.coalesce(as_string(path_eval(m.block_type, item)), F.lit("text"))).alias("type"),
        block_content(path_eval(m.block_content, item)).alias("content"),
        bound(path_eval(m.block_page, item), coerce_page).alias("page"),
        bound(path_eval(m.block_bbox, item), _bbox).alias("bbox"),
    ]


def normalize_blocks(parsed_raw: DataFrame, m: Mapping = Mapping()) -> DataFrame:
    return _rows(parsed_raw, m.blocks, block(m))


def figure(m: Mapping):
    return lambda document, pos, item: [
        F.coalesce(as_string(path_eval(m.figure_id, item)), F.concat(document, F.lit("-fig"), pos.cast("string"))).alias("figure_id"),
        bound(path_eval(m.figure_page, item), coerce_page).alias("page"),
        bound(path_eval(m.figure_bbox, item), _bbox).alias("bbox"),
        as_string(path_eval(m.figure_image, item)).alias("image"),
        as_string(path_eval(m.figure_caption, item)).alias("caption"),
        as_string(path_eval(m.figure_ocr, item)).alias("ocr_text"),
    ]


def normalize_figures(parsed_raw: DataFrame, m: Mapping = Mapping()) -> DataFrame:
    return _rows(parsed_raw, m.figures, figure(m))


def table(m: Mapping):
    return lambda document, pos, item: [
        F.coalesce(as_string(path_eval(m.table_id, item)), F.concat(document, F.lit("-tbl"), pos.cast("string"))).alias("table_id"),
        bound(path_eval(m.table_page, item), coerce_page).alias("page"),
        as_string(path_eval(m.table_caption, item)).alias("caption"),
        as_string(path_eval(m.table_html, item)).alias("html"),
        as_string(path_eval(m.table_markdown, item)).alias("markdown"),
    ]


def normalize_tables(parsed_raw: DataFrame, m: Mapping = Mapping()) -> DataFrame:
    return _rows(parsed_raw, m.tables, table(m))


def markdown_column(m: Mapping) -> Column:
    """The markdown path, else the text path, else the blocks' contents."""
    v = F.col("v")
    found = path_eval(m.markdown, v)
    if m.text:
        found = bound(found, lambda x: F.when(~falsy(x), x).otherwise(path_eval(m.text, v)))
    text = bound(found, lambda x: F.coalesce(
        join_stripped(F.transform(as_array(x), as_string), "\n\n"), F.when(~falsy(x), as_string(x)), F.lit("")
    ))
    contents = F.transform(
        F.filter(as_array(path_eval(m.blocks, v)), is_object), lambda x: block_content(path_eval(m.block_content, x))
    )
    composed = F.array_join(F.filter(contents, lambda x: x != ""), "\n\n")
    return bound(text, lambda x: F.when(x != "", x).otherwise(F.coalesce(composed, F.lit(""))))


def normalize_markdown(parsed_raw: DataFrame, m: Mapping = Mapping()) -> DataFrame:
    """document_id, markdown."""
    return parsed_raw.select("document_id", markdown_column(m).alias("markdown"))


def assemble_document(parsed_raw: DataFrame, m: Mapping = Mapping()) -> DataFrame:
    """One nested row per row of ``parsed_raw``: markdown, metadata, and the child tables as arrays in their order.

    Everything is built within the row, without joins, so repeated ids stay rows of their own.
    """
    return parsed_raw.select(
        "document_id", markdown_column(m).alias("markdown"), _nested(m.pages, page).alias("pages"), _nested(m.blocks, block(m)).alias("blocks"),
        _nested(m.figures, figure(m)).alias("figures"), _nested(m.tables, table(m)).alias("tables"),
        F.create_map(F.lit("raw_length"), F.length("payload").cast("string")).alias("metadata"),
    )


# ---------------------------------------------------------------- content lists of archives


def content_list(archives: DataFrame) -> DataFrame:
    """Items of content lists: ``archives`` (document_id, content_list JSON string) to document_id, pos, item, page_idx, type."""
    return _typed(archives.select("document_id", F.posexplode(as_array(F.parse_json("content_list"))).alias("pos", "item")))


def content_items(rows: DataFrame) -> DataFrame:
    """The same of items that are rows already: document_id, pos (a number in their order), item (JSON string)."""
    return _typed(rows.select("document_id", "pos", F.parse_json("item").alias("item")))


def _typed(items: DataFrame) -> DataFrame:
    return items.withColumn("page_idx", F.coalesce(F.try_variant_get("item", "$.page_idx", "int"), F.lit(1))).withColumn(
        "type", F.coalesce(F.try_variant_get("item", "$.type", "string"), F.lit(""))
    )


def content_list_pages(items: DataFrame) -> DataFrame:
    """document_id, ordinal (by first item), page_number, text (texts and titles, a newline behind each)."""
    line = F.when(
        F.col("type").isin("text", "title"),
        F.concat(F.coalesce(F.try_variant_get("item", "$.text", "string"), F.lit("")), F.lit("\n")),
    )
    rows = items.withColumn("line", line).groupBy("document_id", "page_idx").agg(
        F.min("pos").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("text"),
    )
    return numbered(rows, ["document_id"], "first", "ordinal").select("document_id", "ordinal", F.col("page_idx").alias("page_number"), "text")


def _first_truthy(item: Column, *keys: str) -> Column:
    return path_eval(" || ".join(keys), item)


def content_list_figures(items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Image items, numbered; ``files`` (document_id, path, content binary) gives their bytes as base64."""
    item = F.col("item")
    out = numbered(items.where("type = 'image'"), ["document_id"], "pos").select(
        "document_id",
        F.col("place").cast("string").alias("figure_number"),
        clean_caption(_first_truthy(item, "image_caption", "img_caption", "caption")).alias("caption"),
        F.col("page_idx").alias("page"),
        F.coalesce(F.try_variant_get(item, "$.img_path", "string"), F.lit("")).alias("img_path"),
    )
    if files is None:
        return out
    bytes_of = files.select("document_id", F.col("path").alias("img_path"), F.base64("content").alias("image_base64"))
    return out.join(bytes_of, ["document_id", "img_path"], "left")


def content_list_tables(items: DataFrame) -> DataFrame:
    item = F.col("item")
    body = as_string(_first_truthy(item, "table_body", "text", "markdown"))
    return numbered(items.where("type = 'table'"), ["document_id"], "pos").select(
        "document_id",
        F.col("place").cast("string").alias("table_number"),
        clean_caption(_first_truthy(item, "table_caption", "caption")).alias("caption"),
        F.col("page_idx").alias("page"),
        F.coalesce(body, F.lit("")).alias("markdown"),
    )


# ---------------------------------------------------------------- sanitising, input sources


def _clean(value):
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items() if k.lower() not in PRIVATE_KEYS}
    return [_clean(v) for v in value] if isinstance(value, list) else value


def _sanitized(payload: pd.Series) -> pd.Series:
    def one(text):
        try:
            return json.dumps(_clean(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return text

    return payload.map(one)


def sanitize_payload(payload: Column) -> Column:
    """JSON text without PRIVATE_KEYS at any depth; text that isn't JSON is returned as it is."""
    return F.pandas_udf(_sanitized, "string")(payload)


def resolve_input_source(requests: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``requests`` with source (path, base64, url or none), file_name and resolved_mime.

    ``files`` (path): files that exist; only then does a path win.
    """
    exists = F.lit(False)
    if files is not None:
        found = files.select(F.col("path").alias("_path")).distinct()
        requests = requests.join(found, requests.file_path == found._path, "left")
        exists = F.col("_path").isNotNull()
    data, url = F.col("file_content_base64"), F.col("file_url")
    head = F.when(data.contains(","), F.substring_index(data, ",", 1)).otherwise(F.lit(""))
    image = head.contains("image/")
    name = lambda path: F.regexp_extract(path, r"([^/]*)$", 1)
    has = lambda c: F.coalesce(c != "", F.lit(False))
    source = F.when(exists & has(F.col("file_path")), "path").when(has(data), "base64").when(has(url), "url").otherwise("none")
    out = requests.withColumn("source", source)
    of_url = name(F.substring_index(url, "?", 1))
    file_name = (
        F.when(F.col("source") == "path", name(F.col("file_path")))
        .when((F.col("source") == "base64") & image, F.lit("image.png"))
        .when((F.col("source") == "url") & (of_url != ""), of_url).otherwise(F.lit("document.pdf"))
    )
    default = F.when(has(F.col("mime_type")), F.col("mime_type")).otherwise(F.lit("application/pdf"))
    mime = F.when((F.col("source") == "base64") & image, F.replace(F.substring_index(head, ";", 1), F.lit("data:"), F.lit(""))).otherwise(default)
    return out.withColumn("file_name", file_name).withColumn("resolved_mime", mime).drop("_path")
