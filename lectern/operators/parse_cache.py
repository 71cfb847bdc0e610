"""A persistent cache of converted texts, bounded in bytes, as a log of puts and touches.

Entries are keyed by the hash of a file's content. A put or a touch appends rows and rewrites
nothing; the newest time of a hash is its last access. When the texts outgrow the capacity, the
log is folded: the entries used most recently whose sizes fit together are written as a new
generation, and one small file that names it is renamed into place. A failure is kept as an entry
without text, so that a file which can't be converted isn't tried again.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import steady

from .caches import PARSE_CAPACITY, accepted, survivors

LOG = "file_hash string, at long, bytes long, text string, error string, put boolean"


class ParseCache:
    """A cache under a path that Spark's file systems reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = PARSE_CAPACITY):
        self.spark, self.path, self.capacity = steady(spark), path.rstrip("/"), capacity
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._options = jvm.org.apache.hadoop.fs
        if not self._fs.exists(self._path(f"{self.path}/_CURRENT")):
            self._publish("log-0")
        stream = self._fs.open(self._path(f"{self.path}/_CURRENT"))
        self.log = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()

    def _publish(self, log: str) -> None:
        fresh = f"{self.path}/_NEXT-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(fresh), True)
        out.write(bytearray(log.encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._options.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(fresh), self._path(f"{self.path}/_CURRENT"), options)
        self.log = log

    def _rows(self) -> DataFrame:
        at = f"{self.path}/{self.log}"
        return self.spark.read.schema(LOG).parquet(at) if self._fs.exists(self._path(at)) else self.spark.createDataFrame([], LOG)

    def _append(self, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in LOG.split(", ")]
        rows.withColumn("at", F.lit(time.time_ns())).select(*columns).write.mode("append").parquet(f"{self.path}/{self.log}")

    def entries(self) -> DataFrame:
        """file_hash, text, error, bytes, last_access of what the cache holds."""
        rows = self._rows()
        last = rows.groupBy("file_hash").agg(F.max("at").alias("last_access"), F.max_by(F.struct("text", "error", "bytes"), F.when(F.col("put"), F.col("at"))).alias("_e"))
        return last.where("_e is not null").select("file_hash", "_e.text", "_e.error", "_e.bytes", "last_access")

    def put(self, entries: DataFrame) -> None:
        """Add texts or errors (file_hash, text, error); a text larger than the cache is refused silently."""
        sized = entries.select("file_hash", "text", "error", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.lit(True).alias("put"))
        self._append(accepted(sized, F.col("bytes"), self.capacity))
        self.compact()

    def touch(self, hashes: DataFrame) -> None:
        """Note that entries were used; hashes that the cache lacks are ignored."""
        nothing = F.lit(None)
        known = hashes.select("file_hash").distinct().join(self.entries().select("file_hash"), "file_hash", "left_semi")
        self._append(known.select("file_hash", nothing.cast("string").alias("text"), nothing.cast("string").alias("error"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("put")))

    def compact(self, always: bool = False) -> bool:
        """Fold the log when its texts outgrow the capacity: whether it was folded."""
        total = self.entries().agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        if total <= self.capacity and not always:
            return False
        kept = survivors(self.entries(), F.col("bytes"), self.capacity, F.desc("last_access"), "file_hash")
        log = f"log-{uuid.uuid4().hex}"
        kept.select("file_hash", F.col("last_access").alias("at"), "bytes", "text", "error", F.lit(True).alias("put")).write.parquet(f"{self.path}/{log}")
        self._publish(log)
        return True
