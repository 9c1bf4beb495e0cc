"""Inputs of the queries, derived from the test tables."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import batched, rows_of
from ..sources.archives import opened

LABELS = ["paragraph_title", "text", "Table", "figure_caption", "formula", "header"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_files(files: DataFrame, folder: str) -> str:
    """``files`` (name, content binary) as files below ``folder``, by the tasks that hold them; a task run again writes the same."""

    def run(batches):
        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        for b in batches:
            for name, content in rows_of([b]):
                system.create_dir(f"{inner}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{inner}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, pa.schema([("n", pa.int64())]))

    files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


#: Documents of a file.
FILE_DOCS = 16


def document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, texts (of FILE_DOCS documents, null: empty, by id)."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / FILE_DOCS).alias("g"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]).alias("texts"))


GROUPS_SQL = "g AS (SELECT doc_id // 16 AS g, list(coalesce(text, '') ORDER BY doc_id) AS texts FROM documents GROUP BY doc_id // 16)"


def seconds(ts):
    """Epoch seconds of a timestamp without time zone, as double."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, payload: lines of a text as blocks, tables, figures and pages; every fifth under ``data``."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    label = lambda i: F.element_at(F.array(*[F.lit(x) for x in LABELS]), i % len(LABELS) + 1)
    pairs = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    pick = lambda k, f: F.transform(F.filter(pairs, lambda p: p["i"] % 6 == k), f)
    box = lambda p: F.when(p["i"] % 3 == 0, F.array(F.lit(0), p["i"], p["i"] + 1, p["i"] * 2))
    blocks = F.transform(pairs, lambda p: F.struct(label(p["i"]).alias("type"), p["x"].alias("content"), (p["i"] % 4).cast("string").alias("page"), box(p).alias("bbox")))
    figures = pick(3, lambda p: F.struct(F.when(p["i"] % 2 == 0, F.concat(F.lit("f"), p["i"].cast("string"))).alias("id"), F.lit("").alias("image"), p["x"].alias("img"), p["i"].alias("page"), box(p).alias("bbox"), F.concat(F.lit("c"), p["i"].cast("string")).alias("caption"), F.lit("").alias("ocr_text"), p["x"].alias("ocr")))
    tables = pick(2, lambda p: F.struct(p["x"].alias("content"), (-p["i"]).alias("page"), F.concat(F.lit("t"), p["i"].cast("string")).alias("caption"), F.concat(F.lit("<td>"), p["x"]).alias("html")))
    pages = pick(0, lambda p: F.struct(F.when(p["i"] % 12 == 0, p["i"] + 100).alias("page_number"), p["x"].alias("text"), (p["i"] / 2).alias("width"), F.when(p["i"] % 4 == 0, p["i"] + 1).alias("height")))
    text = F.coalesce("text", F.lit(""))
    body = F.struct(text.alias("markdown"), blocks.alias("blocks"), figures.alias("figures"), tables.alias("tables"), pages.alias("pages"))
    nested = F.struct(F.lit("").alias("markdown"), F.array().cast("array<string>").alias("blocks"), body.alias("data"))
    payload = F.when(F.col("doc_id") % 5 == 0, F.to_json(nested)).otherwise(F.to_json(body))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), payload.alias("payload"))


LINES_SQL = """
l AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
"""


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, pos, item: turns of a conversation as text, image and table items, one row each."""
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 4 == 1, "image").when(F.col("turn") % 4 == 2, "table").when(F.col("role") == "system", "title").otherwise("text")
    item = F.to_json(
        F.struct(
            kind.alias("type"), (F.floor(F.col("turn") / 3) + 1).alias("page_idx"), F.col("text"),
            F.when(kind == "image", F.array(F.concat(F.lit(" "), "role"), F.lit(" "), "text")).alias("image_caption"),
            F.when(kind == "table", F.concat(F.col("role"), F.lit("  "))).alias("caption"),
        )
    )
    return rows.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("pos"), item.alias("item"))


#: Turns of one payload: no payload holds a whole conversation, however long.
TURNS = 64


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, content: a ZIP archive of each document, with its lines as content list and one other file."""

    def packed(name, text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("auto/a.md" if len(name) % 2 else "full.md", text)
            z.writestr("b.md", "not this one")
            z.writestr("auto/x_content_list.json", json.dumps([{"type": "text", "text": line} for line in text.split("\n")]))
            z.writestr("images/1.png", text[:10].encode())
        return name, out.getvalue()

    def run(batches):
        yield from batched((packed(*row) for row in rows_of(batches)), pa.schema([("document_id", pa.string()), ("content", pa.binary())]), lambda r: len(r[1]))

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, "document_id string, content binary")


def group_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, content: an archive for each group of documents: their texts as notes, as items of a content list, and as files."""

    def packed(g, texts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("images/", b"")
            for i, text in enumerate(texts):
                z.writestr("full.md" if i == 2 and g % 2 else f"auto/n{i}.md", text)
                z.writestr(f"images/{i}.png", text.encode())
            for i in range(g % 3):
                z.writestr(f"auto/{i}_content_list.json", json.dumps([{"type": "text", "text": text} for text in texts[i:]]))
        return f"{g}.zip", out.getvalue()

    def run(batches):
        yield from batched((packed(*row) for row in rows_of(batches)), pa.schema([("name", pa.string()), ("content", pa.binary())]), lambda r: len(r[1]))

    return document_groups(spark, sf_dir).mapInArrow(run, "name string, content binary")


def provider_yaml(spark: SparkSession, sf_dir: str) -> str:
    """A provider file with an entry for each nation (a dimension table of 25 rows)."""
    entries = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        p = {"driver": ("http", "command", "cli")[r.n_nationkey % 3], "enabled": r.n_nationkey % 5 != 0, "capabilities": ["pdf", "ocr"][: r.n_regionkey % 3]}
        if r.n_nationkey % 2:
            p |= {"location": "local", "priority": r.n_regionkey * 10, "timeout_seconds": 30, "command": r.n_name.lower()}
        entries[r.n_name] = p
    return yaml.safe_dump({"providers": entries}, sort_keys=False)


def model_yaml(spark: SparkSession, sf_dir: str) -> str:
    """A model file with an entry for each region (a dimension table of 5 rows)."""
    entries = {}
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        m = {"type": "embedding" if r.r_regionkey % 2 else "rerank", "max_length": 100 * r.r_regionkey}
        entries[r.r_name] = m | ({"model_id": f"served-{r.r_regionkey}", "preferred_device": "CPU"} if r.r_regionkey > 2 else {})
    return yaml.safe_dump({"models": entries}, sort_keys=False)


def providers(spark: SparkSession) -> DataFrame:
    p = spark.range(7).select(F.col("id").cast("int").alias("i"))
    caps = F.filter(F.array(F.when(F.col("i") != 3, F.lit("PDF")), F.when(F.col("i") % 3 != 1, F.lit("table")), F.when(F.col("i") % 3 != 2, F.lit("Figures")), F.lit("ocr")), lambda x: x.isNotNull())
    return p.select(
        F.concat(F.lit("p"), F.col("i").cast("string")).alias("name"), F.col("i").alias("ordinal"),
        F.when(F.col("i") % 2 == 1, "remote").otherwise("local").alias("location"), (F.col("i") != 5).alias("enabled"),
        (F.col("i") * 37 % 50).alias("priority"), (F.col("i") != 6).alias("executable_present"), caps.alias("capabilities"),
    )


PROVIDERS_SQL = """
p AS (SELECT 'p' || i AS provider, CAST(i AS INT) AS ordinal, i % 2 = 1 AS remote, i <> 5 AS enabled,
             CAST((i * 37) % 50 AS INT) AS priority, i <> 6 AS present, i <> 3 AS pdf, i % 3 <> 1 AS tab FROM range(7) AS t(i))
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each view and click; the other events are those of providers' health."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    k = F.col("event_id") % 3
    needs = F.when(k == 0, F.array(F.lit("pdf"))).when(k == 1, F.array(F.lit("Tables"), F.lit("pdf"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.col("event_id").alias("request_id"), seconds(F.col("ts")).alias("ts"), F.when(F.col("event_id") % 2 == 0, "public").otherwise("private").alias("privacy"),
        needs.alias("needs"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("preferred_provider"),
    )


#: Requests with their eligible providers, ranked.
RANKED_SQL = (
    "WITH "
    + PROVIDERS_SQL
    + """,
r AS (SELECT event_id AS request_id, ts, event_id % 2 = 0 AS public, event_id % 3 AS k, 'p' || (user_id % 7) AS preferred
      FROM events WHERE event_type IN ('view', 'click')),
c AS (SELECT r.request_id, p.provider, p.ordinal, p.priority,
             row_number() OVER (PARTITION BY r.request_id ORDER BY (p.provider = r.preferred) DESC, p.priority DESC, p.ordinal) AS rank
      FROM r JOIN p ON p.enabled AND (r.public OR NOT p.remote) AND (r.k = 2 OR p.pdf) AND (r.k <> 1 OR p.tab)),
a AS (SELECT *, (request_id * 7 + ordinal * 3) % 4 = 0 AS success, 'e' || ordinal AS error, CAST(request_id % 100 AS DOUBLE) AS latency_ms FROM c)
"""
)


def attempts(ranked: DataFrame) -> DataFrame:
    ok = (F.col("request_id") * 7 + F.col("ordinal") * 3) % 4 == 0
    return ranked.select(
        "request_id", "provider", ok.alias("success"), F.concat(F.lit("e"), F.col("ordinal").cast("string")).alias("error"),
        (F.col("request_id") % 100).cast("double").alias("latency_ms"),
    )


def health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error', 'signup')")
    kind = F.when(F.col("event_type") == "purchase", "success").when((F.col("event_type") == "signup") & (F.col("event_id") % 501 == 0), "quota").otherwise("failure")
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("provider"), seconds(F.col("ts")).alias("ts"), "event_id", kind.alias("kind"), F.col("value").alias("latency_ms"))


HEALTH_SQL = """
h AS (SELECT 'p' || (user_id % 7) AS provider, ts, event_id, epoch(ts) AS t, value AS latency_ms,
             CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'signup' AND event_id % 501 = 0 THEN 'quota' ELSE 'failure' END AS kind
      FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
g AS (SELECT *, sum(CASE WHEN kind = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY ts, event_id) AS grp FROM h),
f AS (SELECT *, CAST(CASE WHEN kind = 'success' THEN 0 ELSE count(*) FILTER (kind <> 'success') OVER (PARTITION BY provider, grp ORDER BY ts, event_id) END AS INT) AS failure_count FROM g),
s AS (SELECT provider, ts, event_id, kind, t, failure_count,
             CASE WHEN max(kind = 'quota') OVER w THEN 'exhausted' ELSE 'unknown' END AS quota_state,
             CASE WHEN kind = 'quota' THEN t + 3600 WHEN kind = 'failure' THEN t + least(30 * pow(2, least(failure_count, 20) - 1), 300) END AS cooldown_until,
             max(CASE WHEN kind = 'success' THEN t END) OVER w AS last_success,
             max(CASE WHEN kind <> 'success' THEN t END) OVER w AS last_failure,
             last_value(CASE WHEN kind = 'success' THEN latency_ms END IGNORE NULLS) OVER w AS latency_ms
      FROM f WINDOW w AS (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
"""
