"""File sources: listings, strict text, converted documents, and one level of zip archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.identity import content_hash, set_hash
from lectern.functions.text import file_name
from lectern.operators.chunking import parse_converted

ENTRY = "path string, pos int, name string, content binary"
ENTRY_NAMES, ENTRY_TYPES = ["path", "pos", "name", "content"], [pa.string(), pa.int32(), pa.string(), pa.binary()]
#: Bytes of entries that go out together, or one entry.
ENTRIES_BYTES = 4 << 20


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_path, mtime (epoch seconds, 0 before the epoch) and size of a folder's files, not its subfolders'.

    Contents aren't read: the source prunes them. It leaves out empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.select(F.col("path").alias("doc_path"), F.greatest(F.unix_timestamp("modificationTime"), F.lit(0)).alias("mtime"), F.col("length").alias("size"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, pos (argument order) and content; a path given twice gives two rows.

    Spark's reader leaves out empty files, so a path that it doesn't return is one of those; one
    that isn't there raises.
    """
    listed = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "given string, pos int")
    files = spark.read.format("binaryFile").load([literal_path(p) for p in dict.fromkeys(paths)]).select("path", "content")
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    met = listed.join(files, bare("path") == bare("given"), "left")
    return met.select(F.coalesce("path", "given").alias("path"), "pos", F.coalesce("content", F.lit(b"")).alias("content"))


def strict_text(content) -> object:
    """A binary column as text; bytes that aren't UTF-8 raise."""
    return F.validate_utf8(content.cast("string"))


def quarantine_text(content) -> object:
    """A binary column as text; bytes that aren't UTF-8 give null."""
    return F.try_validate_utf8(content.cast("string"))


def converted_items(files: DataFrame) -> DataFrame:
    """path, pos, page, text of converted documents' items; malformed JSON raises."""
    return files.select("path", F.inline(parse_converted(strict_text(F.col("content")))))


def safe_entry(name: str) -> bool:
    """Whether an archive entry stays inside the folder that it is extracted to."""
    parts = name.replace("\\", "/").split("/")
    return not (name.startswith(("/", "\\")) or (len(name) > 1 and name[1] == ":") or ".." in parts)


def expand_zips(files: DataFrame, nested: bool = False) -> DataFrame:
    """path, pos, name, content: archives become their entries, other files themselves, in order.

    Entries with unsafe names are skipped; archives inside archives are entries that are never
    opened, and are left out unless `nested`.
    """

    def entries(path: str, name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        if not path.lower().endswith(".zip"):
            yield name, content
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for e in z.infolist():
                if not e.is_dir() and safe_entry(e.filename) and (nested or not e.filename.lower().endswith(".zip")):
                    yield e.filename, z.read(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                path, pos, name, content = (c[k].as_py() for c in batch.columns)
                for entry, data in entries(path, name, content):
                    made.append((path, pos, entry, data))
                    size += len(data or b"") + 64
                    if size >= ENTRIES_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), ENTRY_TYPES)], ENTRY_NAMES)
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), ENTRY_TYPES)], ENTRY_NAMES)

    # One pass over the files: what makes them isn't run once for archives and once for the others.
    named = files.where("path is not null").select("path", F.col("pos").cast("int").alias("pos"), file_name(F.col("path")).alias("name"), "content")
    return named.mapInArrow(run, ENTRY)


def hashed_set(files: DataFrame) -> str:
    """Order-independent hash of a set of files."""
    return files.select(content_hash(F.col("content")).alias("h")).agg(set_hash(F.col("h")).alias("h")).first().h


Converter = Callable[[str, bytes], list[tuple[str, int | None]]]


def convert_files(files: DataFrame, converter: Converter) -> DataFrame:
    """path, pos, page, text, error: a converter (path, bytes) -> items over file contents.

    A file that the converter can't convert is one row with the error's text and no item; one
    without items gives no row. Contents come from Spark's reader, so any store will do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                try:
                    rows = [(r.path, k, p, t, None) for k, (t, p) in enumerate(converter(r.path, r.content))]
                except Exception as e:  # whatever a converter raises is the file's result
                    rows = [(r.path, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "pos", "page", "text", "error"]).astype({"pos": "Int32", "page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, pos int, page int, text string, error string")


def literal_path(path: str) -> str:
    """A path that the file source takes as it is: characters that it would read as a pattern are escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def open_files(spark: SparkSession, paths: DataFrame, at_once: int = 10_000) -> Iterator[DataFrame]:
    """path and content of the files of a table (one column), in tables of `at_once` files.

    The source takes paths from the driver, so they are streamed to it a block at a time.
    """
    block: list[str] = []
    for (path,) in paths.toLocalIterator():
        block.append(literal_path(path))
        if len(block) == at_once:
            yield spark.read.format("binaryFile").load(block).select("path", "content")
            block = []
    if block:
        yield spark.read.format("binaryFile").load(block).select("path", "content")
