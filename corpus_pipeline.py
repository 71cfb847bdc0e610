"""From raw documents to token ids: quality, near duplicates, contamination, privacy, encoding.

Every stage reads all that its predecessor kept and returns whole rows of documents, the last
one token ids. The second and third stage decide about rows by hashes of id and text (128 bits,
64 for contamination), so rows without an id, or with an id that repeats, are judged by their own
text. Rows without words are linked with nothing and stay. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Workspace
from lectern.llm.decontaminate import decontaminate
from lectern.llm.jaccard import link_documents
from lectern.llm.packed import split_by_ids
from lectern.llm.pieces import round_trip
from lectern.llm.pii import pseudonymise
from lectern.llm.quality import keep_good
from lectern.llm.queries import pii_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two long columns, hashes of id and text (nulls told apart), and their names."""
    names = ["_key1", "_key2"]
    while set(names) & {c.lower() for c in docs.columns}:
        names = [n + "_" for n in names]
    row = F.col("doc_id"), F.col("text")
    return docs.withColumns({names[0]: F.xxhash64(F.lit(1), *row), names[1]: F.xxhash64(*row[::-1], F.lit(2))}), names


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of linked rows that with the smallest id stays, once.

    Where ids tie, the smallest key of id and text stays; rows without id come last.
    """
    work = Workspace(spark, "groups")
    rows, keys = _keyed(docs)
    found = work.save(link_documents(rows, carry=tuple(keys))).where("component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("first")
    winners = work.save(found.groupBy("component").agg(first).select(*(F.col(f"first.{k}").alias(k) for k in keys)))
    counts = found.groupBy(*keys).count()
    others = work.save(counts.select(*keys).join(winners, keys, "left_anti"))
    twice = work.save(counts.where("count > 1").select(*keys).join(winners, keys, "left_semi"))
    # Rows whose key is in no decision stay where they are.
    untouched, named = split_by_ids(rows, others.unionByName(twice), keys[0])
    kept = named.join(others, keys, "left_anti")
    once = kept.join(twice, keys, "left_semi").dropDuplicates(keys)
    decided = kept.join(twice, keys, "left_anti").unionByName(once)
    return untouched.unionByName(decided.select(*untouched.columns)).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark window go."""
    rows, (key, _) = _keyed(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    hit = Workspace(spark, "hits").save(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct())
    untouched, named = split_by_ids(rows, hit, key)
    return untouched.unionByName(named.join(hit, key, "left_anti").select(*untouched.columns)).select(*docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: personal data become pseudonyms of the same format and length."""
    return pseudonymise(docs, pii_key(spark), found_col="_pii").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids of every text, and whether they decode to it."""
    return round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("privacy", privacy),
    ("encoding", encoding),
]

#: No SQL: the classifier is trained, and encoding has no SQL form. tests/llm hold each stage
#: against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
