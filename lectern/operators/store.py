"""A versioned chunk store: immutable files in buckets and one manifest that is renamed into place.

Tables: chunks(chunk_id, doc_path, chunk_index, page, text, embedding) and meta(doc_path, mtime,
size, last_ingested_at). Both are dealt into buckets by a hash of the path, and the manifest names
one set of files for each bucket: a batch reads and rewrites the buckets that its documents are
in, and no others. A batch that touches K documents advances the version by K; ids are never used
twice. The manifest also keeps the number of the last batch of each named writer, in the same
rename as its data, so a batch that comes again after a failure changes nothing. One writer at a
time; readers keep the files that they opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import Workspace, steady, written

from .ordered import number_rows

CHUNKS = "chunk_id long, doc_path string, chunk_index long, page int, text string, embedding array<float>"
META = "doc_path string, mtime long, size long, last_ingested_at long"


def unchanged(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Files whose path, mtime and size the store knows."""
    return files.join(meta.select("doc_path", "mtime", "size"), ["doc_path", "mtime", "size"], "left_semi")


def to_ingest(files: DataFrame, meta: DataFrame) -> DataFrame:
    """New and changed files. Only metadata is joined, so contents of the others stay unread."""
    return files.join(meta.select("doc_path", "mtime", "size"), ["doc_path", "mtime", "size"], "left_anti")


def file_status(files: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_path with status new, changed or unchanged."""
    old = meta.select("doc_path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    same = (F.col("_m") == F.col("mtime")) & (F.col("_s") == F.col("size"))
    status = F.when(F.col("_m").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return files.join(old, "doc_path", "left").select("doc_path", status.alias("status"))


def replace_documents(chunks: DataFrame, meta: DataFrame, new_chunks: DataFrame, new_meta: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """Chunks and meta after the documents of new_meta were replaced; fresh ids from next_id on."""
    paths = new_meta.select("doc_path")
    numbered = number_rows(new_chunks.join(paths, "doc_path", "left_semi"), "doc_path", "chunk_index", base=next_id, name="chunk_id")
    return (
        chunks.join(paths, "doc_path", "left_anti").unionByName(numbered.select(*chunks.columns)),
        meta.join(paths, "doc_path", "left_anti").unionByName(new_meta.select(*meta.columns)),
    )


def remove_documents(chunks: DataFrame, meta: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    return chunks.join(paths, "doc_path", "left_anti"), meta.join(paths, "doc_path", "left_anti")


#: Buckets of a new store.
BUCKETS = 64


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_id: int = 0
    #: The file set of each bucket, empty where it holds nothing.
    buckets: tuple[str, ...] = ("",) * BUCKETS
    #: The last batch of each named writer.
    batches: dict[str, int] = field(default_factory=dict)


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_path"), F.lit(n)).cast("int")


class Store:
    """A store under a path that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = steady(spark), path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._options = jvm.org.apache.hadoop.fs
        if self._fs.exists(self._path(self._current)):
            stream = self._fs.open(self._path(self._current))
            found = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self.manifest = Manifest(**found | {"buckets": tuple(found["buckets"])})
        else:
            self._publish(Manifest(buckets=("",) * buckets))

    @property
    def _current(self) -> str:
        return f"{self.path}/_CURRENT"

    @property
    def version(self) -> int:
        return self.manifest.version

    def _read(self, table: str, schema: str, only: list[int] | None = None) -> DataFrame:
        wanted = range(len(self.manifest.buckets)) if only is None else only
        files = [f"{self.path}/{self.manifest.buckets[b]}/{table}/bucket={b}" for b in wanted if self.manifest.buckets[b]]
        # A bucket may have documents without chunks, and then no folder of chunks.
        files = [f for f in files if self._fs.exists(self._path(f))] if table == "chunks" else files
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    def meta(self) -> DataFrame:
        return self._read("meta", META)

    def document(self, doc_path: str) -> DataFrame:
        """Metadata of one document, from its bucket alone."""
        n = len(self.manifest.buckets)
        b = self.spark.range(1).select(F.lit(doc_path).alias("doc_path")).select(bucket_of(n).alias("b")).first().b
        return self._read("meta", META, [b]).where(F.col("doc_path") == doc_path)

    def _publish(self, manifest: Manifest) -> None:
        fresh = f"{self.path}/_NEXT-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(fresh), True)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._options.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(fresh), self._path(self._current), options)
        self.manifest = manifest

    def _commit(self, chunks: DataFrame, meta: DataFrame, touched: list[int], manifest: Manifest) -> None:
        """Write the touched buckets' rows and point the manifest at them."""
        name, n = f"files/{uuid.uuid4().hex}", len(manifest.buckets)
        # Sorted by path, so that row groups can be skipped by it; large buckets are split, small ones joined.
        dealt = chunks.withColumn("bucket", bucket_of(n)).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", "doc_path", "chunk_index").write.partitionBy("bucket").parquet(f"{self.path}/{name}/chunks")
        meta.withColumn("bucket", bucket_of(n)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/meta")
        there = {b for b in touched if self._fs.exists(self._path(f"{self.path}/{name}/meta/bucket={b}"))}
        sets = [(name if b in there else "") if b in touched else old for b, old in enumerate(manifest.buckets)]
        self._publish(replace(manifest, buckets=tuple(sets)))

    def applied(self, writer: str, batch: int) -> bool:
        """Whether a named writer's batch, or a later one, is in the store."""
        return self.manifest.batches.get(writer, -1) >= batch

    def _touched(self, paths: DataFrame) -> tuple[int, list[int]]:
        """Documents and their buckets, of which there is a fixed number."""
        rows = paths.select("doc_path").distinct().groupBy(bucket_of(len(self.manifest.buckets)).alias("b")).count().collect()
        return sum(r["count"] for r in rows), sorted(r.b for r in rows)

    def replace(self, new_chunks: DataFrame, new_meta: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Upsert documents; the version grows by their number. Returns that number.

        batch: a writer's name and the number of its batch. One that has been applied changes nothing.
        """
        if batch and self.applied(*batch):
            return 0
        batches = self.manifest.batches | ({batch[0]: batch[1]} if batch else {})
        number, touched = self._touched(new_meta)
        if number:
            work = Workspace(self.spark, "upsert")
            # What is new may come from costly calls: evaluated once, it is counted and numbered from a table.
            added = work.save(new_chunks.join(new_meta.select("doc_path").distinct(), "doc_path", "left_semi"))
            chunks, meta = replace_documents(self._read("chunks", CHUNKS, touched), self._read("meta", META, touched), added, new_meta, self.manifest.next_id)
            self._commit(chunks, meta, touched, replace(self.manifest, version=self.version + number, next_id=self.manifest.next_id + added.count(), batches=batches))
        elif batch:
            self._publish(replace(self.manifest, batches=batches))
        return number

    def remove(self, paths: DataFrame) -> int:
        """Remove documents; the version grows by the number of those that were there."""
        _, asked = self._touched(paths)
        there = self._read("meta", META, asked).select("doc_path").unionByName(self._read("chunks", CHUNKS, asked).select("doc_path")).distinct()
        gone = written(there.join(paths.select("doc_path").distinct(), "doc_path", "left_semi"))
        number, touched = self._touched(gone)
        if number:
            chunks, meta = remove_documents(self._read("chunks", CHUNKS, touched), self._read("meta", META, touched), gone)
            self._commit(chunks, meta, touched, replace(self.manifest, version=self.version + number))
        return number
