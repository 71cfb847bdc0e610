"""Context reuse of question-answering sessions: which calls each question costs.

Sessions over one model and window share a cache of primed contexts, keyed by document. Loading
another document evicts the session's previous one; a question primes the document's context once
for each load, or takes it from memory, from the cache as it was at the load, or extends the
context of the document that was primed last when the text has only grown.

A loop would carry this state from event to event. Whether a context is cached depends on the last
put or eviction of its document alone, and puts and evictions depend on who loads and asks what,
not on the cache, so every part of the state is the last value of its kind before an event: three
scans, each over range partitions, whatever one session, document or model holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import Workspace, steady

from .caches import PREFIX_CHARS, PREFIX_SHARE, extended
from .ordered import segmented_last

# The labels of the calls.
CALLS = {"refused": "", "memory": "answer", "cache": "answer", "prefix": "prefix-reprime,answer", "cold": "prime,answer"}


def resolve_contexts(events: DataFrame, texts: DataFrame, mode: str = "swap", reuse: Column | None = None, least: int = PREFIX_CHARS, share: float = PREFIX_SHARE) -> DataFrame:
    """key, session, at, doc, tier, labels, suffix_chars: one row for each question.

    events: key (model and window), session, at (a number that orders all events, each its own),
    kind (`load` or `ask`) and doc, the document's hash, for loads. texts: doc and text. tier is
    `memory`, `cache`, `prefix`, `cold`, or `refused` where the session has loaded nothing.
    mode: `raw` reuses and keeps nothing; `swap` reuses what is cached; `adaptive` does so where
    `reuse`, a condition on the question's event, holds, else it primes anew. suffix_chars is what
    a prefix leaves to prime. Events without kind or key, and other columns, are ignored.
    """
    if mode not in ("raw", "swap", "adaptive"):
        raise ValueError(f"unknown mode: {mode}")
    steady(events.sparkSession)
    work = Workspace(events.sparkSession, "session")
    wanted = F.lit(True) if reuse is None else F.coalesce(reuse, F.lit(False))
    rows = events.where("key is not null and kind in ('load', 'ask')").select("key", "session", "at", "kind", "doc", wanted.alias("_wanted"), F.struct("key", "session").alias("_who"))
    load, ask = F.col("kind") == "load", F.col("kind") == "ask"
    seen = work.save(segmented_last(rows, {"_load": F.when(load, F.struct("at", "doc")), "_ask": F.when(ask, F.col("at"))}, "_who", "at"))
    asks = seen.where(ask).select("key", "session", "at", F.col("_load.doc").alias("doc"), F.col("_load.at").alias("_load_at"), F.coalesce(F.col("_ask") > F.col("_load.at"), F.lit(False)).alias("_active"), F.col("_load").isNotNull().alias("_loaded"), "_wanted")
    result = lambda df, tier, suffix=None: df.select("key", "session", "at", "doc", tier.alias("tier"), (F.lit(None) if suffix is None else suffix).cast("bigint").alias("suffix_chars"))
    if mode == "raw":
        found = result(asks, F.when(F.col("_loaded"), "cold").otherwise("refused"))
        return _labelled(found)
    known = asks.where("_loaded")
    first = known.where("not _active")
    first = work.save(segmented_last(first, {"_last": F.struct("doc")}, "key", "at").withColumn("_last", F.col("_last.doc")))
    entry = lambda df, doc, at, op: df.select("key", F.col(doc).alias("doc"), F.col(at).alias("at"), F.lit(op).alias("op"))
    loads = seen.where(load)
    switched = loads.where(~F.col("_load.doc").eqNullSafe(F.col("doc"))).where("_load is not null")
    log = entry(known, "doc", "at", "put").unionByName(switched.select("key", F.col("_load.doc").alias("doc"), "at", F.lit("evict").alias("op")))
    log = log.unionByName(entry(loads, "doc", "at", "warm")).unionByName(entry(first.where("not _last <=> doc"), "_last", "at", "last"))
    log = log.withColumn("_what", F.struct("key", "doc"))
    held = segmented_last(log, {"_op": F.when(F.col("op").isin("put", "evict"), F.col("op"))}, "_what", "at")
    probes = work.save(held.where("op in ('warm', 'last') and _op = 'put'").select(F.col("key").alias("_k"), F.col("at").alias("_at"), "op"))
    warm = probes.where("op = 'warm'").select("_k", "_at", F.lit(True).alias("_warm"))
    kept = probes.where("op = 'last'").select("_k", "_at", F.lit(True).alias("_kept"))
    state = first.join(warm, (F.col("key") == F.col("_k")) & (F.col("_load_at") == F.col("_at")), "left").drop("_k", "_at")
    state = state.join(kept, (F.col("key") == F.col("_k")) & (F.col("at") == F.col("_at")), "left").drop("_k", "_at")
    state = work.save(state)
    # Texts are compared once for each pair of documents that may extend each other.
    pairs = state.where("_warm is null and _kept").select("doc", F.col("_last")).distinct()
    grown = extended(pairs, texts, "doc", "_last", least, share)
    grown = grown.select(F.col("doc").alias("_a"), F.col("_last").alias("_b"), F.col("suffix_chars").alias("_suffix"))
    state = state.join(grown, (F.col("doc") == F.col("_a")) & (F.col("_last") == F.col("_b")) & F.col("_kept") & F.col("_warm").isNull(), "left")
    tier = F.when(F.col("_warm"), F.when(F.col("_wanted"), "cache").otherwise("cold")).when(F.col("_suffix").isNotNull(), "prefix").otherwise("cold")
    found = result(state, tier, F.col("_suffix")).unionByName(result(known.where("_active"), F.lit("memory"))).unionByName(result(asks.where("not _loaded"), F.lit("refused")))
    return _labelled(found)


def _labelled(found: DataFrame) -> DataFrame:
    labels = F.create_map(*(F.lit(x) for kv in CALLS.items() for x in kv))[F.col("tier")]
    return found.select("key", "session", "at", "doc", "tier", labels.alias("labels"), "suffix_chars")


def chunk_reuse(asks: DataFrame, chunks: DataFrame, mode: str = "swap") -> DataFrame:
    """key, at, doc, chunks, reused: how many of a question's chunks were primed before it.

    asks: key, at (unique) and doc; chunks: doc and content_hash, a row for each chunk. A chunk's
    primed context is kept by its content under the key, whoever asked first, and switching
    documents doesn't evict it; within a question a later equal chunk finds the first one's.
    """
    if mode == "raw":
        n = chunks.groupBy(F.col("doc").alias("_d")).agg(F.count("*").alias("_n"))
        met = asks.join(n, F.col("doc") == F.col("_d"), "left")
        return met.select("key", "at", "doc", F.coalesce("_n", F.lit(0).cast("bigint")).alias("chunks"), F.lit(0).cast("bigint").alias("reused"))
    # A content is primed by the first question over any document that holds it: no row for each question and chunk.
    first = asks.groupBy("key", "doc").agg(F.min("at").alias("at"))
    held = chunks.select(F.col("doc").alias("_d"), "content_hash").distinct()
    primed = first.join(held, F.col("doc") == F.col("_d")).groupBy("key", "content_hash").agg(F.min("at").alias("at"))
    paid = primed.groupBy(F.col("key").alias("_k"), F.col("at").alias("_at")).agg(F.count("*").alias("_paid"))
    n = chunks.groupBy(F.col("doc").alias("_d")).agg(F.count("*").alias("_n"))
    met = asks.join(n, F.col("doc") == F.col("_d"), "left").join(paid, F.col("key").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")), "left")
    total = F.coalesce("_n", F.lit(0).cast("bigint"))
    return met.select("key", "at", "doc", total.alias("chunks"), (total - F.coalesce("_paid", F.lit(0).cast("bigint"))).alias("reused"))
