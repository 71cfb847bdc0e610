"""Keyed caches as tables: lookup, bounded put, eviction, prefix reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import common_prefix
from lectern.storage import written

from .ordered import running_sum, segmented_last

# Bytes of the parse cache, and what a text must share with the last one.
PARSE_CAPACITY = 10 << 30
PREFIX_CHARS, PREFIX_SHARE = 2000, 0.5
#: Characters of a block whose digest tells texts apart.
BLOCK = 512


def context_capacity(free_bytes: int) -> int:
    return min(free_bytes // 2, 50_000_000_000)


def lookup(rows: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    """Rows with the cached columns and `hit`; a cache without duplicates keeps their number."""
    known = cache.dropDuplicates(list(keys)).withColumn("hit", F.lit(True))
    return rows.join(known, list(keys), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def accepted(entries: DataFrame, size: Column, capacity: int) -> DataFrame:
    """Entries that a put stores: larger ones than the whole cache are refused silently."""
    return entries.where(size <= capacity)


def survivors(entries: DataFrame, size: Column, capacity: int, *recency: Column | str) -> DataFrame:
    """Entries left after eviction by least recent use: the most recent whose sizes fit together."""
    return running_sum(entries, size, *recency, name="_total").where(F.col("_total") <= capacity).drop("_total")


def evictions(loads: DataFrame, session: str, content: str, *order: str) -> DataFrame:
    """For every load the content that it evicts: the session's previous one, if different."""
    return segmented_last(loads, {"_before": F.col(content)}, session, *order).withColumn("evicted", F.when(F.col("_before") != F.col(content), F.col("_before"))).drop("_before")


def append_only(new: DataFrame, last: DataFrame, *keys: str, least: int = PREFIX_CHARS, share: float = PREFIX_SHARE) -> DataFrame:
    """New texts that extend the last one under the same keys: keys, prefix, suffix.

    The texts must differ, share at least `least` leading characters and `share` of the last
    one's length, and leave something to add. Joined by the keys and a hash of the prefix.
    """
    head = lambda c: F.xxhash64(F.left(F.col(c), F.lit(least)))
    a = new.select(*keys, F.col("text").alias("_new"), head("text").alias("_h"))
    b = last.select(*keys, F.col("text").alias("_old"), head("text").alias("_h"))
    met = a.join(b, [*keys, "_h"]).where((F.col("_new") != F.col("_old")) & (F.char_length("_old") >= least))
    met = met.withColumn("prefix", common_prefix(F.col("_new"), F.col("_old")))
    fine = (F.col("prefix") >= least) & (F.col("prefix") >= F.char_length("_old") * share)
    suffix = F.substring(F.col("_new"), (F.col("prefix") + 1).cast("int"), F.char_length("_new"))
    return met.where(fine).select(*keys, "prefix", suffix.alias("suffix")).where("suffix <> ''")


def extended(pairs: DataFrame, texts: DataFrame, new: str, old: str, least: int = PREFIX_CHARS, share: float = PREFIX_SHARE) -> DataFrame:
    """Pairs of keys whose texts (doc, text) are append_only(): new, old, prefix and suffix_chars.

    No text meets another. Pairs meet digests of blocks, of which the first holds `least`
    characters; then each takes the two blocks in which its texts part. Equal blocks are kept once,
    however many texts share them.
    """
    long_ = texts.where(F.char_length("text") >= least)
    blocks = F.concat(F.array(F.left("text", F.lit(least))), F.regexp_extract_all(F.substring("text", least + 1, (1 << 31) - 1), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    digest = lambda b: F.unhex(F.md5(b.cast("binary")))
    marks = written(long_.select("doc", F.char_length("text").alias("_n"), F.transform(blocks, digest).alias("_marks")))
    side = lambda name, tag: marks.select(F.col("doc").alias(name), F.col("_n").alias(f"_n_{tag}"), F.col("_marks").alias(f"_marks_{tag}"))
    met = pairs.select(new, old).join(side(new, "new"), new).join(side(old, "old"), old)
    parted = F.array_position(F.zip_with("_marks_new", "_marks_old", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    met = met.withColumn("_at", parted.cast("int")).where("_at > 1")  # 0: the same text; 1: another start
    shared = (F.lit(least) + (F.col("_at") - 2) * BLOCK).cast("bigint")
    met = met.select(new, old, "_n_new", "_n_old", shared.alias("_shared"), F.get("_marks_new", F.col("_at") - 1).alias("_m_new"), F.get("_marks_old", F.col("_at") - 1).alias("_m_old"))
    # A new text that ends with the shared blocks adds nothing, whatever the old one goes on with.
    met = written(met.where("_m_new is not null"))
    tails = long_.select(F.explode(F.slice(blocks, 2, (1 << 31) - 1)).alias("_block")).distinct().select(digest(F.col("_block")).alias("_m"), "_block")
    wanted = met.select(F.explode(F.array("_m_new", "_m_old")).alias("_m")).where("_m is not null").distinct()
    tails = written(tails.join(wanted, "_m"))
    part = lambda tag: tails.select(F.col("_m").alias(f"_m_{tag}"), F.col("_block").alias(f"_b_{tag}"))
    met = met.join(part("new"), "_m_new").join(part("old"), "_m_old", "left")
    met = met.withColumn("prefix", F.col("_shared") + F.coalesce(common_prefix(F.col("_b_new"), F.col("_b_old")), F.lit(0).cast("bigint")))
    fine = (F.col("prefix") >= F.col("_n_old") * share) & (F.col("prefix") < F.col("_n_new"))
    return met.where(fine).select(new, old, "prefix", (F.col("_n_new") - F.col("prefix")).alias("suffix_chars"))


def prefix_pairs(docs: DataFrame, key: str, least: int = PREFIX_CHARS, share: float = PREFIX_SHARE) -> DataFrame:
    """key, before, prefix: every text with each different one of a smaller key whose start it keeps.

    They share at least `least` leading characters and `share` of the earlier one's length. Exact
    copies are compared once. An earlier text is looked up by one prefix, the longest of a series
    of lengths (each a quarter above the last) within what must be shared, so texts with no more
    than a common header don't meet.
    """
    lengths = [least]
    while lengths[-1] < 1 << 30:
        lengths.append(max(lengths[-1] + 1, lengths[-1] * 5 // 4))
    # The bound is a lambda variable, so that characters are counted once and not for each length.
    within = lambda n: F.transform(F.array(n), lambda m: F.filter(F.array(*map(F.lit, lengths)), lambda x: x <= m))[0]
    head = lambda n: F.xxhash64(F.left("text", n)).alias("_head")
    found = docs.where(F.char_length("text") >= least).select(key, "text", F.sha2(F.col("text").cast("binary"), 256).alias("_id"))
    texts, ids = found.select("_id", "text").dropDuplicates(["_id"]), found.select(key, "_id")
    needed = F.greatest(F.lit(least), F.ceil(F.char_length("text") * share).cast("int"))
    old = texts.withColumn("_n", F.array_max(within(needed))).select(F.col("_id").alias("_old"), "_n", head(F.col("_n")))
    new = texts.select("_id", "text", F.explode(within(F.char_length("text"))).alias("_n")).select(F.col("_id").alias("_new"), "_n", head(F.col("_n")))
    met = new.join(old, ["_n", "_head"]).where("_new <> _old").select("_new", "_old")
    side = lambda name: texts.select(F.col("_id").alias(name), F.col("text").alias(f"{name}_text"))
    both = met.join(side("_new"), "_new").join(side("_old"), "_old")
    both = both.select("_new", "_old", common_prefix(F.col("_new_text"), F.col("_old_text")).alias("prefix"), F.char_length("_old_text").alias("_chars"))
    fine = both.where((F.col("prefix") >= least) & (F.col("prefix") >= F.col("_chars") * share))
    named = fine.join(ids.withColumnRenamed("_id", "_new"), "_new").join(ids.select(F.col(key).alias("before"), F.col("_id").alias("_old")), "_old")
    return named.where(F.col("before") < F.col(key)).select(key, "before", "prefix")


def answers(asked: DataFrame, versions: DataFrame, key: str = "corpus", at: str = "at", question: str = "question") -> DataFrame:
    """Questions with version, hit and first_at: each finds the answer to an equal one over the same version.

    asked: key, at and question; versions: key, at and version, the log of a corpus' versions. A
    question is about the last version logged at its time or before (null: none yet, and nothing
    is cached for it). The first of equal questions to a version pays; an answer to an older
    version is stale and never found. Ties in time: the version counts first, and of questions
    asked at one time one pays.
    """
    kind = lambda df, n: df.withColumn("_kind", F.lit(n))
    log = kind(versions.select(key, F.col(at).alias("_at"), F.col("version").alias("_v")), 0)
    both = log.unionByName(kind(asked.withColumn("_at", F.col(at)).withColumn("_id", F.monotonically_increasing_id()), 1), allowMissingColumns=True)
    seen = segmented_last(both, {"version": F.col("_v")}, key, "_at", "_kind", "_id").where("_kind = 1")
    seen = written(seen.drop("_v", "_kind", "_at"))
    first = seen.where("version is not null").groupBy(F.col(key).alias("_key"), F.col("version").alias("_version"), F.col(question).alias("_q")).agg(F.min(F.struct(F.col(at).alias("at"), F.col("_id").alias("id"))).alias("_first"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("version") == F.col("_version")) & F.col(question).eqNullSafe(F.col("_q"))
    met = seen.join(first, same, "left")
    hit = F.coalesce(F.col("_first.id") != F.col("_id"), F.lit(False))
    return met.select(*asked.columns, "version", hit.alias("hit"), F.when(hit, F.col("_first.at")).alias("first_at"))


def hit_rate(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def upsert(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The table with the rows of new in place of those with equal keys (null keys are equal)."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = same[0]
    for c in same[1:]:
        both = both & c
    kept = table.alias("a").join(new.select(*keys).distinct().alias("b"), both, "left_anti")
    return kept.unionByName(new)
