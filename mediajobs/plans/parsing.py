"""Queries of the normalising, routing and health operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsonpath import as_string, path_eval
from ..functions.shared import new_path
from ..functions.sizes import small
from ..functions.text import clean_caption, coerce_page
from ..operators import health, normalize, routing
from ..sources import archives, results, tables
from . import inputs
from .inputs import GROUPS_SQL, HEALTH_SQL, LINES_SQL, PROVIDERS_SQL, RANKED_SQL, table

M = normalize.Mapping(
    blocks="blocks || data.blocks", figures="figures || data.figures", tables="tables || data.tables", markdown="markdown || data.markdown"
)


def _parsed(spark, sf):
    return normalize.parsed(inputs.raw_documents(spark, sf))


def _joined(column):
    """Whole numbers of an array as text, for comparison."""
    return F.array_join(F.transform(column, lambda x: x.cast("int").cast("string")), ",")


def path_eval_query(spark, sf):
    v = F.col("v")
    return _parsed(spark, sf).select(
        "document_id",
        as_string(path_eval("markdown || data.markdown", v)).alias("markdown"),
        as_string(path_eval("blocks[0].type || data.blocks[0].type", v)).alias("first_type"),
        F.coalesce(F.size(F.try_variant_get(path_eval("figures[].img || data.figures[].img", v), "$", "array<variant>")), F.lit(0)).alias("n_images"),
    )


def normalize_markdown(spark, sf):
    return normalize.normalize_markdown(_parsed(spark, sf), M)


def normalize_pages(spark, sf):
    return normalize.normalize_pages(_parsed(spark, sf), M)


def normalize_blocks(spark, sf):
    return normalize.normalize_blocks(_parsed(spark, sf), M).withColumn("bbox", _joined("bbox"))


def normalize_figures(spark, sf):
    return normalize.normalize_figures(_parsed(spark, sf), M).withColumn("bbox", _joined("bbox"))


def normalize_tables(spark, sf):
    return normalize.normalize_tables(_parsed(spark, sf), M)


def coerce_page_query(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.parse_json("props"))
    return e.select("event_id", coerce_page(path_eval("k", F.col("v"))).alias("page"), coerce_page(path_eval("none", F.col("v"))).alias("missing"))


#: Fields of a document's parts that are compared.
_VALUES = {"blocks": ("block_id", "type", "content"), "figures": ("figure_id", "caption", "ocr_text"), "tables": ("table_id", "caption", "html", "markdown"), "pages": ("page_number", "text")}


def _digested(column, fields):
    return F.md5(F.array_join(F.transform(F.col(column), lambda x: F.concat_ws(" ", *[x[k] for k in fields])), "\n"))


def assemble_document(spark, sf):
    d = normalize.assemble_document(_parsed(spark, sf), M)
    return d.select("document_id", F.length("markdown").alias("markdown_chars"), *[F.size(c).alias(f"n_{c}") for c in ("pages", "blocks", "figures", "tables")], F.element_at("blocks", -1)["block_id"].alias("last_block"),
        F.md5("markdown").alias("markdown_md5"), *[_digested(c, f).alias(f"{c}_md5") for c, f in _VALUES.items()])


def read_jsonl_results(spark, sf):
    """One payload of JSON lines for each TURNS turns of a conversation, read back as page texts joined by blank lines."""
    line = F.struct("turn", F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.col("text")).alias("markdown"))).alias("pages")).alias("result"))).alias("j"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["j"]), "\n \n")
    part = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / inputs.TURNS))
    files = table(spark, sf, "conversations").groupBy(part.alias("document_id")).agg(text.alias("value"))
    raw = files.select("document_id", results.jsonl_payload(F.col("value")).alias("payload"))
    return normalize.normalize_markdown(normalize.parsed(raw), normalize.Mapping(markdown="jsonl[].result.pages[].markdown.text"))


def read_json_results(spark, sf):
    """Objects, other JSON and plain text as payloads."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 3
    value = F.when(k == 0, F.to_json(F.struct("text"))).when(k == 1, F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("not json "), F.col("doc_id").cast("string")))
    v = F.parse_json(results.json_payload(value))
    return d.select("doc_id", F.length(as_string(path_eval("text", v))).alias("text_chars"), as_string(path_eval("result[0]", v)).alias("item"))


def read_text_results(spark, sf):
    """Output lines as blocks."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), results.text_payload(F.col("text"), F.lit("lines")).alias("payload"))
    return normalize.normalize_blocks(normalize.parsed(d)).groupBy("document_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("content")).alias("chars"))


def _items(spark, sf):
    return normalize.content_items(inputs.conversation_items(spark, sf))


def content_list_pages(spark, sf):
    return normalize.content_list_pages(_items(spark, sf))


def content_list_figures(spark, sf):
    return normalize.content_list_figures(_items(spark, sf)).drop("img_path")


def content_list_tables(spark, sf):
    return normalize.content_list_tables(_items(spark, sf))


def read_zip_results(spark, sf):
    """Archives of documents, unpacked: markdown, items of the content list, other files."""
    a = results.unpack_archives(inputs.archives(spark, sf))
    n = F.size(F.try_variant_get(F.parse_json("content_list"), "$", "array<variant>"))
    return a.select("document_id", "markdown", n.alias("n_items"), F.size("files").alias("n_files"), F.length(F.element_at("files", "images/1.png")).alias("file_bytes"))


def archive_items(spark, sf):
    """Items of the archives' content lists."""
    items = normalize.content_list(results.unpack_archives(inputs.archives(spark, sf)))
    return items.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length(F.try_variant_get("item", "$.text", "string"))).alias("chars"), F.max("page_idx").alias("page"))


def _name(column="document_id"):
    """A file's name without its ending."""
    return F.regexp_extract(column, "([^/]+)\\.[a-z]+$", 1)


def _bytes(text):
    return F.encode(text, "UTF-8").alias("content")


def _empty(g, ending):
    """An empty file beside every fourth."""
    return g.where("g % 4 = 0").select(F.concat(F.lit("empty-"), F.col("g").cast("string"), F.lit(ending)).alias("name"), F.lit(b"").alias("content"))


def read_json_files(spark, sf):
    """Files of objects, arrays, plain text and nothing, written and read back: how many texts a payload has, and which."""
    g = inputs.document_groups(spark, sf)
    k, joined = F.col("g") % 3, F.array_join("texts", "\n")
    value = F.when(k == 0, F.to_json(F.struct("texts"))).when(k == 1, F.to_json("texts")).otherwise(F.concat(F.lit("- "), joined))
    folder = inputs.write_files(g.select(F.concat(F.col("g").cast("string"), F.lit(".json")).alias("name"), _bytes(value)).union(_empty(g, ".json")), new_path(spark, "json"))
    v = F.parse_json("payload")
    listed = F.coalesce(F.try_variant_get(v, "$.texts", "array<string>"), F.try_variant_get(v, "$.result", "array<string>"), F.array(F.try_variant_get(v, "$.text", "string")))
    read = results.read_json_results(spark, folder).select(_name().alias("file"), listed.alias("texts"))
    return read.select("file", F.size("texts").alias("n"), F.md5(F.array_join("texts", "\n")).alias("md5"))


def read_jsonl_files(spark, sf):
    """Files of JSON lines, and empty ones, read back as Markdown."""
    g = inputs.document_groups(spark, sf)
    lines = F.array_join(F.transform("texts", lambda x: F.to_json(F.struct(F.struct(x.alias("text")).alias("result")))), "\n\n")
    folder = inputs.write_files(g.select(F.concat(F.col("g").cast("string"), F.lit(".jsonl")).alias("name"), _bytes(lines)).union(_empty(g, ".jsonl")), new_path(spark, "jsonl"))
    read = normalize.parsed(results.read_jsonl_results(spark, folder).withColumn("document_id", _name()))
    found = normalize.normalize_markdown(read, normalize.Mapping(markdown="jsonl[].result.text"))
    return found.select("document_id", F.length("markdown").alias("n"), F.md5("markdown").alias("md5"))


def read_text_files(spark, sf):
    """Files of command output in the three forms, each read as what it is."""
    g = inputs.document_groups(spark, sf)
    forms = {"json": F.to_json(F.struct(F.array_join("texts", "\n").alias("text"))), "lines": F.array_join("texts", "\n"), "text": F.concat(F.lit(" \n"), F.array_join("texts", "\n"))}
    out = None
    for i, (form, value) in enumerate(forms.items()):
        mine = g.where(F.col("g") % 3 == i)
        folder = inputs.write_files(mine.select(F.concat(F.col("g").cast("string"), F.lit(".out")).alias("name"), _bytes(value)).union(_empty(mine, ".out")), new_path(spark, form))
        v = F.parse_json("payload")
        n = F.coalesce(F.size(F.try_variant_get(v, "$.blocks", "array<variant>")), F.lit(0))
        read = results.read_text_results(spark, folder, form).select(_name().alias("file"), F.lit(form).alias("form"), n.alias("n"), F.md5(F.try_variant_get(v, "$.text", "string")).alias("md5"))
        out = read if out is None else out.union(read)
    return out


def _archive_folder(spark, sf):
    return inputs.write_files(inputs.group_archives(spark, sf), new_path(spark, "archives"))


def read_zip_documents(spark, sf):
    """Archives on disk, read by the data source in small parts: their Markdown, and the items of their content lists."""
    a = archives.documents_of(archives.read_entries(spark, _archive_folder(spark, sf), f"{archives.NOTE},{archives.LIST}", 1 << 20))
    items = F.try_variant_get(F.try_parse_json("content_list"), "$", "array<variant>")
    texts = F.transform(items, lambda x: F.try_variant_get(x, "$.text", "string"))
    return a.select(_name().alias("archive"), F.md5("markdown").alias("markdown"), F.size(items).alias("n"), F.md5(F.array_join(texts, "\n")).alias("items"))


def read_zip_files(spark, sf):
    """The archives' other files, one row each; of second content lists, their texts."""
    f = results.read_zip_files(spark, _archive_folder(spark, sf))
    items = F.when(F.col("path").endswith(".json"), F.try_variant_get(F.try_parse_json(F.col("content").cast("string")), "$", "array<variant>"))
    texts = F.array_join(F.transform(items, lambda x: F.try_variant_get(x, "$.text", "string")), "\n")
    n = F.when(items.isNotNull(), F.size(items)).otherwise(F.length("content"))
    return f.select(_name().alias("archive"), "path", n.alias("n"), F.md5(F.coalesce(texts.cast("binary"), "content")).alias("md5"))


def load_provider_dim(spark, sf):
    found = frozenset(["france", "china", "peru"])
    p = tables.provider_dim(spark, inputs.provider_yaml(spark, sf), executables=found)
    return p.select("name", "ordinal", "driver", "location", "enabled", "priority", "timeout", F.array_join("capabilities", ",").alias("capabilities"), "executable_present")


def load_model_dim(spark, sf):
    m = tables.model_dim(spark, inputs.model_yaml(spark, sf))
    return m.select("id", "type", "ovms_model", "max_length", "preferred_device", "fallback_device", "policy")


def clean_caption_query(spark, sf):
    c = table(spark, sf, "conversations").withColumn("v", F.parse_json(F.to_json(F.struct(F.array(F.concat(F.lit(" "), "role"), F.lit("\t"), F.col("text")).alias("c")))))
    return c.select("conv_id", "turn", clean_caption(path_eval("c", F.col("v"))).alias("caption"), clean_caption(path_eval("x", F.col("v"))).alias("none"))


def resolve_input_source(spark, sf):
    none = F.lit(None).cast("string")
    r = table(spark, sf, "pages").select(
        F.col("page_id").alias("request_id"), none.alias("file_path"), F.col("url").alias("file_url"), none.alias("mime_type"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("data:image/jpeg;base64,"), F.base64(F.encode("url", "UTF-8")))).alias("file_content_base64"),
    )
    return normalize.resolve_input_source(r).select("request_id", "source", "file_name", "resolved_mime")


def sanitize_payload(spark, sf):
    wrapped = F.concat(F.lit('{"Token":"x","in":[{"api_key":1,"props":'), "props", F.lit(',"Secret":{"a":2}}],"resultUrl":"u"}'))
    return table(spark, sf, "events").select("event_id", normalize.sanitize_payload(wrapped).alias("payload"))


def _ranked(spark, sf):
    return routing.rank_candidates(routing.route_candidates(inputs.requests(spark, sf), inputs.providers(spark)))


def route_candidates(spark, sf):
    return routing.route_candidates(inputs.requests(spark, sf), inputs.providers(spark)).select("request_id", "provider")


def satisfies_capabilities(spark, sf):
    return routing.capability_table(inputs.requests(spark, sf), inputs.providers(spark))


def rank_candidates(spark, sf):
    return _ranked(spark, sf).select("request_id", "provider", "rank")


def resolve_fallback(spark, sf):
    r = _ranked(spark, sf)
    return routing.resolve_fallback(r, inputs.attempts(r)).withColumn("attempted_providers", F.array_join("attempted_providers", ","))


def routing_failures(spark, sf):
    r = _ranked(spark, sf)
    return routing.routing_failures(inputs.requests(spark, sf), r, inputs.attempts(r)).withColumn("attempted_providers", F.array_join("attempted_providers", ","))


def classify_attempt(spark, sf):
    code = F.element_at(F.array(*[F.lit(x) for x in (200, 201, 202, 204, 429, 500, 404)]), (F.col("event_id") % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in health.ACCEPTED]), (F.col("user_id") % 4 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", code.alias("code"), kind.alias("call_kind"))
    return e.select("event_id", health.classify_attempt(F.col("code"), F.col("call_kind")).alias("outcome"))


def _health(spark, sf):
    return health.provider_health(inputs.health_events(spark, sf))


def provider_health(spark, sf):
    return _health(spark, sf).drop("ts")


def provider_available_at(spark, sf):
    r = inputs.requests(spark, sf)
    return health.provider_available_at(r, _health(spark, sf), inputs.providers(spark)).withColumn("request_id", F.col("request_id").cast("long"))


def provider_status_report(spark, sf):
    return health.provider_status_report(_health(spark, sf), inputs.providers(spark)).drop("capabilities")


QUERIES = {
    "path_eval": path_eval_query, "normalize_markdown": normalize_markdown, "normalize_pages": normalize_pages, "normalize_blocks": normalize_blocks,
    "normalize_figures": normalize_figures, "normalize_tables": normalize_tables, "coerce_page": coerce_page_query, "assemble_document": assemble_document,
    "read_jsonl_results": read_jsonl_results, "read_json_results": read_json_results, "read_text_results": read_text_results,
    "content_list_pages": content_list_pages, "content_list_figures": content_list_figures, "content_list_tables": content_list_tables,
    "read_zip_results": read_zip_results, "archive_items": archive_items, "read_json_files": read_json_files, "read_jsonl_files": read_jsonl_files,
    "read_text_files": read_text_files, "read_zip_documents": read_zip_documents, "read_zip_files": read_zip_files, "load_provider_dim": load_provider_dim, "load_model_dim": load_model_dim,
    "clean_caption": clean_caption_query, "resolve_input_source": resolve_input_source, "sanitize_payload": sanitize_payload,
    "route_candidates": route_candidates, "satisfies_capabilities": satisfies_capabilities, "rank_candidates": rank_candidates,
    "resolve_fallback": resolve_fallback, "routing_failures": routing_failures, "classify_attempt": classify_attempt,
    "provider_health": provider_health, "provider_available_at": provider_available_at, "provider_status_report": provider_status_report,
}

_BOX = "CASE WHEN i % 3 = 0 THEN '0,' || i || ',' || (i + 1) || ',' || (i * 2) END"
_TYPE = "CASE i % 6 WHEN 0 THEN 'heading' WHEN 2 THEN 'table' WHEN 3 THEN 'figure' WHEN 4 THEN 'formula' WHEN 5 THEN 'heading' ELSE 'text' END"
_ITEMS = """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, role, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, CAST(turn // 3 + 1 AS INT) AS page FROM conversations)
"""

ORACLE_SQL = {
    "path_eval": "WITH " + LINES_SQL + """
SELECT document_id, (SELECT coalesce(text, '') FROM documents d WHERE CAST(d.doc_id AS VARCHAR) = document_id) AS markdown,
       'paragraph_title' AS first_type, CAST(count(*) FILTER (i % 6 = 3) AS INT) AS n_images FROM l GROUP BY document_id""",
    "normalize_markdown": "SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(text, '') AS markdown FROM documents",
    "normalize_pages": "WITH " + LINES_SQL + "SELECT document_id, CAST(i // 6 AS INT) AS pos, CAST(CASE WHEN i % 12 = 0 THEN i + 100 ELSE i // 6 + 1 END AS INT) AS page_number, CAST(i / 2 AS DOUBLE) AS width, CAST(CASE WHEN i % 4 = 0 THEN i + 1 END AS DOUBLE) AS height, x AS text FROM l WHERE i % 6 = 0",
    "normalize_blocks": "WITH " + LINES_SQL + f"SELECT document_id, CAST(i AS INT) AS pos, document_id || '-b' || i AS block_id, {_TYPE} AS type, x AS content, CAST(i % 4 AS INT) AS page, {_BOX} AS bbox FROM l",
    "normalize_figures": "WITH " + LINES_SQL + "SELECT document_id, CAST(i // 6 AS INT) AS pos, CASE WHEN i % 2 = 0 THEN 'f' || i ELSE document_id || '-fig' || (i // 6) END AS figure_id, CAST(i AS INT) AS page, " + _BOX + " AS bbox, x AS image, 'c' || i AS caption, x AS ocr_text FROM l WHERE i % 6 = 3",
    "normalize_tables": "WITH " + LINES_SQL + "SELECT document_id, CAST(i // 6 AS INT) AS pos, document_id || '-tbl' || (i // 6) AS table_id, 1 AS page, 't' || i AS caption, '<td>' || x AS html, x AS markdown FROM l WHERE i % 6 = 2",
    "coerce_page": "SELECT event_id, CAST(CASE WHEN regexp_full_match(props->>'k', '[0-9]+') THEN CAST(props->>'k' AS INT) ELSE 1 END AS INT) AS page, 1 AS missing FROM events",
    "assemble_document": "WITH " + LINES_SQL + """
SELECT document_id, CAST(sum(length(x)) + count(*) - 1 AS INT) AS markdown_chars, CAST(count(*) FILTER (i % 6 = 0) AS INT) AS n_pages,
       CAST(count(*) AS INT) AS n_blocks, CAST(count(*) FILTER (i % 6 = 3) AS INT) AS n_figures, CAST(count(*) FILTER (i % 6 = 2) AS INT) AS n_tables,
       document_id || '-b' || max(i) AS last_block, md5(string_agg(x, chr(10) ORDER BY i)) AS markdown_md5,
       md5(string_agg(document_id || '-b' || i || ' ' || """ + _TYPE + """ || ' ' || x, chr(10) ORDER BY i)) AS blocks_md5,
       md5(coalesce(string_agg(CASE WHEN i % 2 = 0 THEN 'f' || i ELSE document_id || '-fig' || (i // 6) END || ' c' || i || ' ' || x, chr(10) ORDER BY i) FILTER (i % 6 = 3), '')) AS figures_md5,
       md5(coalesce(string_agg(document_id || '-tbl' || (i // 6) || ' t' || i || ' <td>' || x || ' ' || x, chr(10) ORDER BY i) FILTER (i % 6 = 2), '')) AS tables_md5,
       md5(string_agg(CASE WHEN i % 12 = 0 THEN i + 100 ELSE i // 6 + 1 END || ' ' || x, chr(10) ORDER BY i) FILTER (i % 6 = 0)) AS pages_md5
FROM l GROUP BY document_id""",
    "read_jsonl_results": r"SELECT conv_id || '-' || (turn // 64) AS document_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> ''), '') AS markdown FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations) GROUP BY conv_id, turn // 64",
    "read_zip_results": """
SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(text, '') AS markdown, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INT) AS n_items, 1 AS n_files,
       CAST(strlen(left(coalesce(text, ''), 10)) AS INT) AS file_bytes FROM documents""",
    "archive_items": "WITH " + LINES_SQL + "SELECT document_id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars, 1 AS page FROM l GROUP BY document_id",
    "read_json_files": "WITH " + GROUPS_SQL + """
SELECT CAST(g AS VARCHAR) AS file, CAST(CASE WHEN g % 3 = 2 THEN 1 ELSE len(texts) END AS INT) AS n,
       md5(CASE WHEN g % 3 = 2 THEN '- ' ELSE '' END || array_to_string(texts, chr(10))) AS md5 FROM g
UNION ALL SELECT 'empty-' || g, 1, md5('') FROM g WHERE g % 4 = 0""",
    "read_jsonl_files": "WITH " + GROUPS_SQL + r""",
m AS (SELECT g, coalesce(array_to_string(list_filter(list_transform(texts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10)), '') AS m FROM g)
SELECT CAST(g AS VARCHAR) AS document_id, CAST(length(m) AS INT) AS n, md5(m) AS md5 FROM m
UNION ALL SELECT 'empty-' || g, 0, md5('') FROM g WHERE g % 4 = 0""",
    "read_text_files": "WITH " + GROUPS_SQL + r""",
t AS (SELECT g, ['json', 'lines', 'text'][g % 3 + 1] AS form, array_to_string(texts, chr(10)) AS t FROM g),
s AS (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS s FROM t)
SELECT CAST(g AS VARCHAR) AS file, form, CAST(CASE WHEN form = 'lines' THEN len(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '\S'))) ELSE 0 END AS INT) AS n,
       md5(CASE WHEN form = 'json' THEN t ELSE s END) AS md5 FROM s
UNION ALL SELECT 'empty-' || g, form, 0, md5('') FROM t WHERE g % 4 = 0""",
    "read_zip_documents": "WITH " + GROUPS_SQL + """
SELECT CAST(g AS VARCHAR) AS archive, md5(CASE WHEN g % 2 = 1 AND len(texts) > 2 THEN texts[3] ELSE texts[1] END) AS markdown,
       CASE WHEN g % 3 > 0 THEN CAST(len(texts) AS INT) END AS n, CASE WHEN g % 3 > 0 THEN md5(array_to_string(texts, chr(10))) END AS items FROM g""",
    "read_zip_files": "WITH " + GROUPS_SQL + """
SELECT CAST(g AS VARCHAR) AS archive, 'images/' || i || '.png' AS path, CAST(strlen(texts[i + 1]) AS INT) AS n, md5(texts[i + 1]) AS md5
FROM (SELECT g, texts, unnest(range(len(texts))) AS i FROM g)
UNION ALL
SELECT CAST(g AS VARCHAR), 'auto/1_content_list.json', CAST(len(texts) - 1 AS INT), md5(coalesce(array_to_string(texts[2:], chr(10)), '')) FROM g WHERE g % 3 = 2""",
    "load_provider_dim": """
SELECT n_name AS name, CAST(n_nationkey AS INT) AS ordinal, ['http', 'command', 'cli'][n_nationkey % 3 + 1] AS driver, CASE WHEN n_nationkey % 2 = 1 THEN 'local' ELSE 'remote' END AS location,
       n_nationkey % 5 <> 0 AS enabled, CAST(CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey * 10 ELSE 100 END AS INT) AS priority, CASE WHEN n_nationkey % 2 = 1 THEN 30.0 ELSE 300.0 END::DOUBLE AS timeout,
       ['', 'pdf', 'pdf,ocr'][n_regionkey % 3 + 1] AS capabilities, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 2 = 1 AND lower(n_name) IN ('france', 'china', 'peru') END AS executable_present FROM nation""",
    "load_model_dim": """
SELECT r_name AS id, CASE WHEN r_regionkey % 2 = 1 THEN 'embedding' ELSE 'rerank' END AS type, CASE WHEN r_regionkey > 2 THEN 'served-' || r_regionkey ELSE r_name END AS ovms_model,
       CAST(100 * r_regionkey AS INT) AS max_length, CASE WHEN r_regionkey > 2 THEN 'CPU' ELSE 'GPU' END AS preferred_device, 'CPU' AS fallback_device, 'GPU_PREFERRED' AS policy FROM region""",
    "read_json_results": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(length(text) AS INT) WHEN 2 THEN CAST(length('not json ' || doc_id) AS INT) END AS text_chars, CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR) END AS item FROM documents",
    "read_text_results": r"SELECT CAST(doc_id AS VARCHAR) AS document_id, count(*) AS n_lines, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS x FROM documents) WHERE x <> '' GROUP BY doc_id",
    "content_list_pages": _ITEMS + """
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY min(pos)) AS INT) AS ordinal, page AS page_number,
       coalesce(string_agg(text || chr(10), '' ORDER BY pos) FILTER (turn % 4 NOT IN (1, 2)), '') AS text FROM c GROUP BY document_id, page""",
    "content_list_figures": _ITEMS + r"""
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY pos) AS VARCHAR) AS figure_number,
       role || ' ' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS caption, page FROM c WHERE turn % 4 = 1""",
    "content_list_tables": _ITEMS + """
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY pos) AS VARCHAR) AS table_number, role AS caption, page, text AS markdown
FROM c WHERE turn % 4 = 2""",
    "clean_caption": r"SELECT conv_id, turn, role || ' ' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS caption, '' AS none FROM conversations",
    "resolve_input_source": """
SELECT page_id AS request_id, CASE WHEN page_id % 3 = 0 THEN 'base64' ELSE 'url' END AS source,
       CASE WHEN page_id % 3 = 0 THEN 'image.png' WHEN regexp_extract(split_part(url, '?', 1), '[^/]*$') = '' THEN 'document.pdf'
            ELSE regexp_extract(split_part(url, '?', 1), '[^/]*$') END AS file_name,
       CASE WHEN page_id % 3 = 0 THEN 'image/jpeg' ELSE 'application/pdf' END AS resolved_mime FROM pages""",
    "sanitize_payload": """SELECT event_id, '{"in":[{"props":' || replace(props, ' ', '') || '}]}' AS payload FROM events""",
    "route_candidates": RANKED_SQL + "SELECT request_id, provider FROM c",
    "satisfies_capabilities": "WITH " + PROVIDERS_SQL + "SELECT event_id AS request_id, provider AS name, (event_id % 3 = 2 OR pdf) AND (event_id % 3 <> 1 OR tab) AS fits FROM events, p WHERE event_type IN ('view', 'click')",
    "rank_candidates": RANKED_SQL + "SELECT request_id, provider, CAST(rank AS INT) AS rank FROM c",
    "resolve_fallback": RANKED_SQL + """,
w AS (SELECT request_id, min(rank) FILTER (success) AS first FROM a GROUP BY request_id)
SELECT a.request_id, max(provider) FILTER (rank = first) AS provider_name, CASE WHEN max(first) = 1 THEN 'success' ELSE 'fallback' END AS status,
       max(latency_ms) FILTER (rank = first) AS latency_ms, string_agg(provider, ',' ORDER BY rank) AS attempted_providers,
       max(error) FILTER (rank = first - 1) AS fallback_reason FROM a JOIN w USING (request_id) WHERE rank <= first GROUP BY a.request_id""",
    "routing_failures": RANKED_SQL + """
SELECT request_id, CAST(503 AS INT) AS code, '' AS attempted_providers, CAST(NULL AS VARCHAR) AS last_error FROM r WHERE request_id NOT IN (SELECT request_id FROM c)
UNION ALL
SELECT request_id, 502, string_agg(provider, ',' ORDER BY rank), max_by(error, rank) FROM a GROUP BY request_id HAVING NOT bool_or(success)""",
    "classify_attempt": """
SELECT event_id, CASE WHEN c = 4 THEN 'quota' WHEN (u = 0 AND c <= 2) OR (u = 1 AND c <= 3) OR (u = 2 AND c = 0) OR (u = 3 AND c <= 2) THEN 'success' ELSE 'failure' END AS outcome
FROM (SELECT event_id, event_id % 7 AS c, user_id % 4 AS u FROM events)""",
    "provider_health": "WITH " + HEALTH_SQL + "SELECT provider, event_id, kind, failure_count, quota_state, cooldown_until, last_success, last_failure, latency_ms FROM s",
    "provider_available_at": "WITH " + PROVIDERS_SQL + "," + HEALTH_SQL + """,
z AS (SELECT provider, ts, max_by(quota_state, event_id) AS q, CAST(max_by(coalesce(cooldown_until, 0), event_id) AS DOUBLE) AS cd FROM s GROUP BY provider, ts),
r AS (SELECT event_id AS request_id, ts, provider, enabled AND present AS up FROM events, p WHERE event_type IN ('view', 'click'))
SELECT request_id, r.provider, up AND coalesce(q <> 'exhausted', true) AND coalesce(epoch(r.ts) >= cd, true) AS available
FROM r ASOF LEFT JOIN z ON r.provider = z.provider AND r.ts >= z.ts""",
    "provider_status_report": "WITH " + PROVIDERS_SQL + "," + HEALTH_SQL + """,
x AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id DESC) = 1)
SELECT p.provider AS name, ordinal, CASE WHEN remote THEN 'remote' ELSE 'local' END AS location, enabled, priority, present AS executable_present,
       failure_count, quota_state, cooldown_until, last_success, last_failure, latency_ms FROM p LEFT JOIN x USING (provider)""",
}
