"""Readers of raw parser results."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import batched, rows_of
from ..functions.jsonpath import is_object
from ..functions.text import strip
from .archives import LIST, NOTE, documents_of, files_of, read_entries, read_files


def _quoted(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")))


def json_payload(text: Column) -> Column:
    """Payload of one JSON result: objects as they are, other JSON as {"result": ...}, other text as {"text": ...}."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), _quoted(text)).when(is_object(v), text).otherwise(F.concat(F.lit('{"result":'), F.to_json(v), F.lit("}")))


def jsonl_payload(text: Column) -> Column:
    """Payload {"jsonl": [...]} of JSON lines in their order; blank lines are skipped, a bad line is an error."""
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    parsed = F.transform(lines, lambda x: F.to_json(F.parse_json(x)))
    return F.concat(F.lit('{"jsonl":['), F.array_join(parsed, ","), F.lit("]}"))


def text_payload(text: Column, form: Column) -> Column:
    """Payload of a command's output by its format: json, lines, else text."""
    out = strip(text)
    lines = F.filter(F.transform(F.split(out, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    blocks = F.transform(lines, lambda x: F.struct(F.lit("text").alias("type"), x.alias("content")))
    as_json = F.when(F.try_parse_json(out).isNull(), _quoted(out)).otherwise(out)
    return (
        F.when(form == "json", as_json)
        .when(form == "lines", F.to_json(F.struct(out.alias("text"), blocks.alias("blocks"))))
        .otherwise(F.to_json(F.struct(out.alias("text"), out.alias("markdown"))))
    )


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """document_id (path) and value of each file, empty ones too; bytes that aren't UTF-8 are replaced."""
    return read_files(spark, path).select("document_id", F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def read_json_results(spark: SparkSession, path: str) -> DataFrame:
    """document_id (file path), payload."""
    return _whole(spark, path).select("document_id", json_payload(F.col("value")).alias("payload"))


def read_jsonl_results(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).select("document_id", jsonl_payload(F.col("value")).alias("payload"))


def read_text_results(spark: SparkSession, path: str, form: str) -> DataFrame:
    return _whole(spark, path).select("document_id", text_payload(F.col("value"), F.lit(form)).alias("payload"))


ARCHIVE = "document_id string, markdown string, content_list string, files map<string, binary>"
_ARCHIVE = pa.schema([("document_id", pa.string()), ("markdown", pa.string()), ("content_list", pa.string()), ("files", pa.map_(pa.string(), pa.binary()))])


def unpack(content: bytes) -> tuple[str, str | None, dict[str, bytes]]:
    """Markdown, content list (JSON text) and other entries of a result archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        notes = [n for n in names if n.endswith(".md")]
        chosen = "full.md" if "full.md" in notes else notes[0] if notes else None
        markdown = archive.read(chosen).decode("utf-8", "replace") if chosen else ""
        listed = next((n for n in names if n.endswith("content_list.json")), None)
        items = archive.read(listed).decode("utf-8") if listed else None
        rest = {n: archive.read(n) for n in names if n != listed and n not in notes and not n.endswith("/")}
    return markdown, items, rest


def unpack_archives(archives: DataFrame) -> DataFrame:
    """``archives`` (document_id, content binary) to ARCHIVE rows, one archive at a time."""

    def run(batches):
        rows = ((name, *unpack(content)) for name, content in rows_of(batches))
        yield from batched(rows, _ARCHIVE, lambda r: len(r[1]) + len(r[2] or "") + sum(map(len, r[3].values())))

    return archives.select("document_id", "content").mapInArrow(run, ARCHIVE)


def read_zip_results(spark: SparkSession, path: str) -> DataFrame:
    """document_id, markdown, content_list of ZIP files; a content list that isn't JSON is an error when it is read.

    Entries are read one at a time; those of other kinds aren't read (see ``read_zip_files``).
    """
    return documents_of(read_entries(spark, path, f"{NOTE},{LIST}"))


def read_zip_files(spark: SparkSession, path: str) -> DataFrame:
    """document_id, path (in the archive), content of the other files in ZIP files."""
    return files_of(read_entries(spark, path))
