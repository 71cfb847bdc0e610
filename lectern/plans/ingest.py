"""Whole plans: folder ingest, loading corpora, asking."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.identity import content_hash, set_hash
from lectern.functions.text import question_problem
from lectern.operators import qa, retrieval
from lectern.operators.chunking import assemble, chunk_pages, split_column
from lectern.operators.parse_cache import ParseCache
from lectern.operators.store import Store, file_status, to_ingest
from lectern.sources.files import Converter, convert_files, expand_zips, open_files, quarantine_text, read_files, scan_folder, strict_text
from lectern.storage import Workspace
from lectern.streaming.watch import watch_batches


def _items(raw: DataFrame, converter: Converter | None) -> DataFrame:
    """path, pos, page, text, error of file contents: a converter's items, or the whole text without page."""
    if converter:
        return convert_files(raw, converter)
    text = quarantine_text(F.col("content"))
    wrong = F.when(text.isNull(), "UnicodeDecodeError: not UTF-8")
    return raw.select("path", F.lit(0).alias("pos"), F.lit(None).cast("int").alias("page"), text.alias("text"), wrong.alias("error"))


def store_files(files: DataFrame, raw: DataFrame, store: Store, most: int, embedder: retrieval.Embedder | None, converter: Converter | None, batch: tuple[str, int] | None = None) -> DataFrame:
    """Convert, chunk, embed and store files (doc_path, mtime, size) with their contents: doc_path and error.

    A file that can't be converted isn't stored, nor is its metadata, so it is tried again next time.
    """
    work = Workspace(files.sparkSession, "ingest")
    items = work.save(_items(raw, converter).withColumnRenamed("path", "doc_path"))
    failed = work.save(items.where("error is not null").select("doc_path", "error"))
    good = items.where("error is null")
    if converter:
        chunks = chunk_pages(good, most, "doc_path").withColumnRenamed("piece", "text")
    else:
        chunks = split_column(good, "text", most, "doc_path").withColumn("page", F.lit(None).cast("int")).withColumnRenamed("piece", "text")
    meta = files.join(failed, "doc_path", "left_anti").select("doc_path", "mtime", "size", F.lit(int(time.time())).cast("bigint").alias("last_ingested_at"))
    # Embedded in the same rows as they are stored in, by one call for each of them.
    store.replace(retrieval.embed(chunks.select("doc_path", "chunk_index", "page", "text"), "text", embedder), work.save(meta), batch)
    return failed


def ingest_folder(spark: SparkSession, folder: str, store: Store, most: int = 4000, embedder: retrieval.Embedder | None = None, prune: bool = False, converter: Converter | None = None, at_once: int = 10_000) -> DataFrame:
    """Store new and changed files: doc_path, skipped_unchanged, chunks_stored, error.

    Contents are read for those files only, `at_once` files to a commit. converter: makes items
    with pages of a file's bytes, which are chunked by page; without one files are text, and one
    that isn't UTF-8 is an error. prune: also remove what the folder no longer has.
    """
    work = Workspace(spark, "folder")
    files = work.save(scan_folder(spark, folder))
    # Written before the store changes: the report is of the state that was found.
    status = work.save(file_status(files, store.meta()))
    fresh = work.save(to_ingest(files, store.meta()))
    errors = []
    for raw in open_files(spark, fresh.select("doc_path"), at_once):
        part = fresh.join(raw.select(F.col("path").alias("doc_path")), "doc_path", "left_semi")
        errors.append(store_files(part, raw, store, most, embedder, converter))
    if prune:
        store.remove(store.meta().join(files, "doc_path", "left_anti"))
    failed = reduce(DataFrame.unionByName, errors) if errors else spark.createDataFrame([], "doc_path string, error string")
    stored = store.chunks().groupBy("doc_path").agg(F.count("*").alias("n"))
    report = status.select("doc_path", (F.col("status") == "unchanged").alias("skipped_unchanged")).join(stored, "doc_path", "left").join(failed, "doc_path", "left")
    none = F.col("skipped_unchanged") | F.col("error").isNotNull()
    return report.select("doc_path", "skipped_unchanged", F.when(none, 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("chunks_stored"), "error")


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, most: int = 4000, embedder: retrieval.Embedder | None = None, converter: Converter | None = None, once: bool = False, writer: str | None = None) -> StreamingQuery:
    """Store files as they come to a folder, each batch once.

    The store commits a batch's number with its data, under the writer's name (the checkpoint by
    default): a batch that the stream repeats after a failure is known and changes nothing.
    """
    name = writer or checkpoint

    def ingest(batch: DataFrame, number: int) -> None:
        if not store.applied(name, number):
            files = batch.select(F.col("path").alias("doc_path"), F.greatest(F.unix_timestamp("modificationTime"), F.lit(0)).alias("mtime"), F.col("length").alias("size"))
            store_files(files, batch.select("path", "content"), store, most, embedder, converter, (name, number))

    return watch_batches(spark, folder, ingest, checkpoint, once)


def load_documents(spark: SparkSession, paths: list[str], converter: Converter, cache: ParseCache, context: int, most: int = 4000) -> DataFrame:
    """One corpus row of documents and archive entries, converted: as load_text(), and `failed`.

    Each different content is converted once, ever: its text is put to the cache, and so is a
    failure, as a row without text, which stays in the corpus' hash and names. most: characters
    of a page's chunk; chunks are joined by line feeds.
    """
    if not paths:
        raise ValueError("no files given")
    work = Workspace(spark, "documents")
    entries = work.save(expand_zips(read_files(spark, paths)).withColumn("file_hash", content_hash(F.col("content"))))
    wanted = entries.select("file_hash").distinct()
    # Taken before anything is put, since what is put may push it out.
    hits = work.save(cache.entries().join(wanted, "file_hash", "left_semi").select("file_hash", "text", "error"))
    missing = wanted.join(hits.select("file_hash"), "file_hash", "left_anti")
    todo = entries.join(missing, "file_hash", "left_semi").dropDuplicates(["file_hash"])
    # A converter sees the entry's name; its rows carry the content's hash.
    items = work.save(convert_files(todo.select(F.concat_ws("\n", "file_hash", "name").alias("path"), "content"), _by_name(converter)))
    items = items.withColumn("file_hash", F.substring_index("path", "\n", 1))
    chunks = chunk_pages(items.where("error is null"), most, "file_hash")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "piece")))
    texts = chunks.groupBy("file_hash").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["piece"]), "\n"), F.lit("\n")).alias("text"))
    failed = items.where("error is not null").select("file_hash", "error")
    made = todo.select("file_hash").join(texts, "file_hash", "left").join(failed, "file_hash", "left")
    made = work.save(made.select("file_hash", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error"))
    cache.put(made)
    cache.touch(hits)
    known = entries.select("pos", "name", "file_hash").join(hits.unionByName(made).select("file_hash", "text"), "file_hash")
    known = work.save(known.withColumn("corpus", F.lit("corpus")))
    # What failed keeps its place in hash and names, and has no part in the text.
    whole = assemble(known.where("text is not null").withColumn("order", F.struct("pos", "name")), "corpus", "name", "text", "order").select("corpus", "text")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")
    facts = known.groupBy("corpus").agg(set_hash(F.col("file_hash")).alias("doc_hash"), names, F.count_if(F.col("text").isNull()).alias("failed"))
    out = facts.join(whole, "corpus", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return out.select("doc_hash", "text", "names", F.char_length("text").cast("bigint").alias("chars"), qa.fits(F.col("text"), F.lit(context)).alias("fits_in_one_chunk"), "failed")


def _by_name(converter: Converter) -> Converter:
    return lambda path, content: converter(path.split("\n", 1)[1], content)


def load_text(spark: SparkSession, paths: list[str], context: int) -> DataFrame:
    """One corpus row of text files and zip entries: doc_hash, text, names, chars, fits_in_one_chunk."""
    if not paths:
        raise ValueError("no files given")
    files = expand_zips(read_files(spark, paths)).withColumn("corpus", F.lit("corpus"))
    texts = files.select("corpus", "pos", "name", strict_text(F.col("content")).alias("text"), F.struct("pos", "name").alias("order"))
    whole = assemble(texts, "corpus", "name", "text", "order")
    key = files.groupBy("corpus").agg(set_hash(content_hash(F.col("content"))).alias("doc_hash"))
    return whole.join(key, "corpus").select("doc_hash", "text", "names", F.char_length("text").cast("bigint").alias("chars"), qa.fits(F.col("text"), F.lit(context)).alias("fits_in_one_chunk"))


def ask_document(spark: SparkSession, paths: list[str], question: str, context: int = 8192, fraction: float = 0.25, word: str | None = None) -> dict:
    """Load, map, reduce and attribute in one call with the offline generator.

    word: what the extraction looks for; the longest word of the question by default.
    """
    problem = spark.range(1).select(question_problem(F.lit(question)).alias("p")).first().p
    if problem:
        raise ValueError(f"the question is {problem}")
    corpus = load_text(spark, paths, context)
    facts = corpus.select("chars", "fits_in_one_chunk", "names").first()
    target = word or max((w.strip("?.,!") for w in question.split()), key=len)
    most = 10**9 if facts.fits_in_one_chunk else max(200, int(context * fraction)) * 4
    found = qa.map_phase(corpus, min(most, 1_000_000_000), lambda p: qa.extract_sentence(p, target), "doc_hash") if not facts.fits_in_one_chunk else corpus.select("doc_hash", F.lit(0).cast("bigint").alias("chunk_index"), qa.extract_sentence(F.col("text"), target).alias("excerpt"))
    rows = found.orderBy("chunk_index").collect()
    kept = [r for r in rows if r.excerpt != "NONE"]
    return {
        "answer": qa.SEPARATOR.join(r.excerpt for r in kept),
        "used_map_reduce": not facts.fits_in_one_chunk,
        "chars_loaded": facts.chars,
        "source_files": facts.names,
        "sources": [] if facts.fits_in_one_chunk else [(r.chunk_index, r.excerpt) for r in kept],
    }


__all__ = ["ask_document", "ingest_folder", "ingest_stream", "load_documents", "load_text"]
