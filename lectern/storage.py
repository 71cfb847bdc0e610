"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def steady(spark: SparkSession) -> SparkSession:
    """Unions that keep their sides' partitioning fail where AQE has coalesced the sides apart."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def bounded(spark: SparkSession, size: int = 8 << 20) -> SparkSession:
    """Let no Arrow batch hold more than `size` bytes or one row, where rows may be large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if now <= 0 or now > size:
        spark.conf.set(key, str(size))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a private one in local mode where it is unset.

    On a cluster an unset folder raises: executors would write where nobody else reads.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session is gone already
            return


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan scans, from the file index; 0 where it scans none."""
    total, stack = 0, [df._jdf.queryExecution().optimizedPlan()]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "LogicalRelation":
            total += int(node.relation().sizeInBytes())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return total


class Workspace:
    """Tables that one operator call writes to the shared folder to cut its lineage."""

    def __init__(self, spark: SparkSession, name: str):
        steady(spark)
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._paths: list[tuple[DataFrame, str]] = []
        _made.append((spark, self.root))

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write and reread: a lost executor costs a file read, never the lineage."""
        path, schema = self.path(), df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        for entry in [x for x in self._paths if x[0] is df]:
            self._paths.remove(entry)
            delete(self.spark, entry[1])


def written(df: DataFrame) -> DataFrame:
    """Write and reread, so that two readers see one evaluation."""
    return Workspace(df.sparkSession, "table").save(df)
