"""Spark data sources for result files and archives, read where their tasks run.

``spark.read.format("result_files").load(path)`` gives document_id (the file's path)
and content of every file, of empty ones too (Spark's own file sources leave those
out). Small files share a task.

``spark.read.format("result_archives").load(path)`` gives document_id (the archive's
path), entry, position, size and content. Only the archives' names and sizes, and of
archives beyond ``split`` bytes their directories, are read on the driver; a task
opens its archives and inflates one entry at a time, so neither an archive nor a
list of them is ever held whole. Large archives are cut into ranges of entries, small
ones share a task.

Options: ``split`` (compressed bytes of a task, about), ``contents`` (comma-separated
endings of the entries whose content is wanted; the others' is null and not read).

Paths are those of any file system that pyarrow opens (local, HDFS, S3, GCS): a file,
a folder (its files at any depth; of archives, ``*.zip``), or a pattern within one folder. Defined cases:
an archive without entries gives one row with a null entry, so it isn't lost;
directories are entries of no content; a file that isn't an archive is an error.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
#: Bytes of content that go to Spark at a time, about.
BATCH_BYTES = 4 << 20
SCHEMA = "document_id string, entry string, position int, size long, content binary"
_ENTRY = pa.schema([("document_id", pa.string()), ("entry", pa.string()), ("position", pa.int32()), ("size", pa.int64()), ("content", pa.binary())])
FILE_SCHEMA = "document_id string, content binary"
_FILE = pa.schema([("document_id", pa.string()), ("content", pa.binary())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


class _Raw(io.RawIOBase):
    """A pyarrow file as Python expects one: seeking before its start is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.file.read(len(b))
        b[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the start of a file")
        return self.file.seek(min(at, self.file.size()))

    def tell(self) -> int:
        return self.file.tell()


@contextmanager
def archive_at(path: str) -> Iterator[zipfile.ZipFile]:
    system, inner = opened(path)
    with system.open_input_file(inner) as f, zipfile.ZipFile(io.BufferedReader(_Raw(f), 1 << 20)) as archive:
        yield archive


def found(path: str, ending: str = "") -> list[tuple[str, int]]:
    """Paths and sizes of the files at ``path``, in the order of paths; of a folder, those with ``ending``."""
    system, inner = opened(path)
    folder, _, last = inner.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        files = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        files = [system.get_file_info(inner)]
        if files[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if files[0].type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.path.endswith(ending)]
    prefix = path[: path.index(inner)] if inner in path else ""
    return sorted((prefix + f.path, f.size) for f in files if f.type == fs.FileType.File)


@dataclass
class Part(InputPartition):
    """Archives, each with the range of its entries that the task reads; the end is null for all of them."""

    archives: list[tuple[str, int, int | None]]


def parts(files: list[tuple[str, int]], split: int, divide: bool = True) -> list[Part]:
    out, held, size = [], [], 0
    for path, n in files:
        if n > split and divide:
            with archive_at(path) as archive:
                sizes = [e.compress_size for e in archive.infolist()]
            lo = run = 0
            for i, s in enumerate(sizes):
                if run and run + s > split:
                    out.append(Part([(path, lo, i)]))
                    lo, run = i, 0
                run += s
            out.append(Part([(path, lo, None)]))
            continue
        if held and size + n > split:
            out.append(Part(held))
            held, size = [], 0
        held.append((path, 0, None))
        size += n
    return out + ([Part(held)] if held else [])


def entries_of(part: Part, contents: tuple[str, ...] | None) -> Iterator[tuple]:
    for path, lo, hi in part.archives:
        with archive_at(path) as archive:
            entries = archive.infolist()
            if not entries:
                yield path, None, None, None, None
            for i in range(lo, len(entries) if hi is None else hi):
                e = entries[i]
                wanted = not e.is_dir() and (contents is None or e.filename.endswith(contents))
                yield path, e.filename, i, e.file_size, archive.read(e) if wanted else None


def files_in(part: Part) -> Iterator[tuple]:
    for path, _, _ in part.archives:
        system, inner = opened(path)
        with system.open_input_file(inner) as f:
            yield path, f.read()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Part]:
        return parts(found(self.path), self.split, divide=False) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(files_in(partition), _FILE)


class _ArchiveReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.contents = tuple(c.strip() for c in options["contents"].split(",")) if options.get("contents") else None

    def partitions(self) -> list[Part]:
        return parts(found(self.path, ".zip"), self.split) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(entries_of(partition, self.contents), _ENTRY)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (content last) in batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 100
        if size > BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class ResultFiles(DataSource):
    """``result_files``: whole files as rows."""

    @classmethod
    def name(cls) -> str:
        return "result_files"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


class ResultArchives(DataSource):
    """``result_archives``: entries of ZIP archives as rows."""

    @classmethod
    def name(cls) -> str:
        return "result_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _ArchiveReader:
        return _ArchiveReader(dict(self.options))


def read_files(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """FILE_SCHEMA rows of the files at ``path``."""
    spark.dataSource.register(ResultFiles)
    return spark.read.format("result_files").option("split", split).load(path)


def read_entries(spark: SparkSession, path: str, contents: str | None = None, split: int = SPLIT) -> DataFrame:
    """SCHEMA rows of the archives at ``path``."""
    spark.dataSource.register(ResultArchives)
    reader = spark.read.format("result_archives").option("split", split)
    return (reader.option("contents", contents) if contents else reader).load(path)


NOTE, LIST = ".md", "content_list.json"


def documents_of(entries: DataFrame) -> DataFrame:
    """document_id, markdown, content_list (JSON text) of each archive.

    The markdown is that of ``full.md``, else of the first ``*.md``, else empty; the
    list is the first entry that ends in ``content_list.json``, else null.
    """
    note, listed = F.col("entry").endswith(NOTE), F.col("entry").endswith(LIST)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    order = F.struct((F.col("entry") != "full.md").alias("other"), "position")
    return entries.groupBy("document_id").agg(
        F.coalesce(F.min_by(F.when(note, text), F.when(note, order)), F.lit("")).alias("markdown"),
        F.min_by(F.when(listed, text), F.when(listed, order)).alias("content_list"),
    )


def files_of(entries: DataFrame) -> DataFrame:
    """document_id, path (in the archive), content of the archives' other files, one row each."""
    listed = F.col("entry").endswith(LIST)
    first = entries.where(listed).groupBy("document_id").agg(F.min("position").alias("_list"))
    rest = entries.where(F.col("entry").isNotNull() & ~F.col("entry").endswith(NOTE) & ~F.col("entry").endswith("/"))
    # only further content lists need to know which is the first
    further = rest.where(listed).join(first, "document_id").where("position > _list").drop("_list")
    return rest.where(~listed).unionByName(further).select("document_id", F.col("entry").alias("path"), "content")
