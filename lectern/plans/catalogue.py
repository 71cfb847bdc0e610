"""The queries over the driver tables and their independent DuckDB counterparts."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import models as M
from lectern.functions import text as T
from lectern.functions.identity import content_hash, set_hash
from lectern.functions.vectors import cosine
from lectern.operators import caches, calls, chunking, ordered, profile, qa, retrieval, rope, session, sizing, store, workspaces
from lectern.sources.html import page_items

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Sizes used by the queries: a chunk, a context window, the word that extractions look for.
CHUNK, CONTEXT, WORD = 800, 4096, "that"


def ship(spark: SparkSession, root: str) -> None:
    """Add the package to the session's Python path, once."""
    sc = spark.sparkContext
    if not getattr(sc, "_lectern_sent", False):
        folder = Path(tempfile.mkdtemp())
        sc.addPyFile(shutil.make_archive(str(folder / "lectern"), "zip", root, "lectern"))
        sc._lectern_sent = True


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must agree with it."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --- pieces of SQL -------------------------------------------------------------------------

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _split_sql(source: str, keys: str, text: str, most: int, name: str = "pieces") -> str:
    """CTEs that split a text as bounded_split() does, one piece for each step of the recursion."""
    cut = f"coalesce(nullif(length(regexp_extract(substr(rest, 1, {most}), '(?s)^(.*)\\s', 1)), 0), {most})"
    return f"""
    {name}_walk AS (
        SELECT {keys}, 0 AS step, CAST(NULL AS VARCHAR) AS raw, {text} AS rest, length({text}) <= {most} AS whole FROM {source}
        UNION ALL
        SELECT {keys}, step + 1, substr(rest, 1, cut), substr(rest, cut + 1), whole
        FROM (SELECT *, CASE WHEN length(rest) <= {most} THEN greatest(length(rest), 1) ELSE {cut} END AS cut FROM {name}_walk
              WHERE rest <> '' OR (step = 0 AND whole))
    ),
    {name} AS (
        SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY step) - 1 AS BIGINT) AS chunk_index, piece
        FROM (SELECT {keys}, step, whole, {_TRIM.format('raw')} AS piece FROM {name}_walk WHERE step > 0)
        WHERE whole OR piece <> ''
    )"""


# --- chunking ------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_split_sql('documents', 'doc_id', 'text', CHUNK)} SELECT doc_id, chunk_index, sha256(piece) AS chunk_hash, CAST(length(piece) AS BIGINT) AS n_chars FROM pieces")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunking.split_column(table(spark, sf_dir, "documents"), "text", CHUNK, "doc_id")
    return pieces.select("doc_id", "chunk_index", content_hash(F.col("piece")).alias("chunk_hash"), long(F.char_length("piece")).alias("n_chars"))


def _items(docs: DataFrame) -> DataFrame:
    """Lines as page items: four to a page, some without page, some blank."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    page = F.when(F.col("pos") % 11 != 10, F.floor(F.col("pos") / 4).cast("int"))
    return lines.select("doc_id", long("pos").alias("pos"), page.alias("page"), F.when(F.col("pos") % 13 == 12, " ").otherwise(F.col("text")).alias("text"))


_ITEMS = r"""
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
    items AS (SELECT doc_id, pos, CASE WHEN pos % 11 <> 10 THEN pos // 4 END AS page, CASE WHEN pos % 13 = 12 THEN ' ' ELSE t END AS t FROM lines),
    kept AS (SELECT *, row_number() OVER w AS k, lag(page) OVER w AS before FROM items WHERE regexp_matches(t, '\S') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    turns AS (SELECT *, sum(CASE WHEN k > 1 AND before IS NOT DISTINCT FROM page THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM kept),
    runs AS (SELECT doc_id, run, min(page) AS page, string_agg(t, chr(10) ORDER BY pos) AS text FROM turns GROUP BY doc_id, run)"""


@query(f"""WITH RECURSIVE {_ITEMS}, {_split_sql('runs', 'doc_id, run, page', 'text', CHUNK)}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, chunk_index) - 1 AS BIGINT) AS chunk_index, CAST(page AS BIGINT) AS page, sha256(piece) AS chunk_hash FROM pieces""")
def chunk_pages_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_pages(_items(table(spark, sf_dir, "documents")), CHUNK)
    return chunks.select("doc_id", "chunk_index", long("page").alias("page"), content_hash(F.col("piece")).alias("chunk_hash"))


@query(f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, length(text) <= floor({CONTEXT} * 0.8) * 4 AS fits FROM documents")
def fits_in_one_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", long(F.char_length("text")).alias("n_chars"), qa.fits(F.col("text"), F.lit(CONTEXT)).alias("fits"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_FRACTIONS = (0.1, 0.25, 0.5, 0.75)
_PLAN = {f: max(200, int(CONTEXT * f)) * 4 for f in _FRACTIONS}


@query("WITH RECURSIVE " + ", ".join(_split_sql("documents", "doc_id, source", "text", most, f"p{k}") for k, most in enumerate(_PLAN.values())) + " " + " UNION ALL ".join(f"SELECT source, CAST({f} AS DOUBLE) AS fraction, CAST({most} AS BIGINT) AS max_chars, count(*) AS pieces FROM p{k} GROUP BY source" for k, (f, most) in enumerate(_PLAN.items())))
def map_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "text")
    # One pass over the texts for all fractions; only counts are shuffled.
    counts = [F.sum(F.size(T.bounded_split(F.col("text"), most))).alias(f"n{k}") for k, most in enumerate(_PLAN.values())]
    rows = F.array(*(F.struct(F.lit(f).alias("fraction"), F.col(f"n{k}").alias("pieces")) for k, f in enumerate(_FRACTIONS)))
    plan = docs.groupBy("source").agg(*counts).select("source", F.inline(rows))
    return plan.select("source", "fraction", T.map_budget(F.lit(CONTEXT), F.col("fraction")).alias("max_chars"), long("pieces").alias("pieces"))


_LEVELS = (1000, 10_000, 20_000, 50_000)


@query("WITH RECURSIVE " + ", ".join(_split_sql("documents", "doc_id", "text", most, f"l{k}") for k, most in enumerate(_LEVELS)) + " SELECT doc_id, level, count(*) AS pieces, CAST(max(n) AS BIGINT) AS longest FROM (" + " UNION ALL ".join(f"SELECT doc_id, CAST({k} AS BIGINT) AS level, length(piece) AS n FROM l{k}" for k in range(len(_LEVELS))) + ") GROUP BY doc_id, level")
def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = chunking.levels(table(spark, sf_dir, "documents"), "text", _LEVELS, "doc_id")
    return split.groupBy("doc_id", "level").agg(F.count("*").alias("pieces"), long(F.max(F.char_length("piece"))).alias("longest"))


def _linked_sql(k: int) -> str:
    """Pieces of one level with where they begin and end, and where their first visible character stands."""
    return f"""q{k} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS chunk_index, a, b, a + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start
        FROM (SELECT doc_id, step, whole, raw, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY step) - length(raw) AS a, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY step) AS b, {_TRIM.format('raw')} AS piece FROM l{k}_walk WHERE step > 0)
        WHERE whole OR piece <> '')"""


@query("WITH RECURSIVE " + ", ".join(_split_sql("documents", "doc_id", "text", most, f"l{k}") + ", " + _linked_sql(k) for k, most in enumerate(_LEVELS)) + " " + " UNION ALL ".join(f"SELECT q.doc_id, CAST({k} AS BIGINT) AS level, q.chunk_index, CAST(q.start AS BIGINT) AS start, " + (f"p.chunk_index AS parent_index FROM q{k} q LEFT JOIN q{k + 1} p ON p.doc_id = q.doc_id AND q.start BETWEEN p.a AND greatest(p.b - 1, p.a)" if k + 1 < len(_LEVELS) else f"NULL AS parent_index FROM q{k} q") for k in range(len(_LEVELS))))
def hierarchy_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chunking.linked_levels(table(spark, sf_dir, "documents"), "text", _LEVELS, "doc_id")
    return linked.select("doc_id", "level", "chunk_index", "start", "parent_index")


# --- identity ------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


@query("SELECT source, sha256(string_agg(h, ',' ORDER BY h)) AS hash, count(*) AS files FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def corpus_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("source", content_hash(F.col("text")).alias("h"))
    return hashed.groupBy("source").agg(set_hash(F.col("h")).alias("hash"), F.count("*").alias("files"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"WITH RECURSIVE {_split_sql('documents', 'doc_id', 'text', CHUNK)} SELECT count(*) AS pieces, count(DISTINCT piece) AS calls FROM pieces")
def distinct_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = chunking.split_column(table(spark, sf_dir, "documents"), "text", CHUNK, "doc_id").select(content_hash(F.col("piece")).alias("h"))
    return hashed.groupBy("h").agg(F.count("*").alias("n")).agg(F.sum("n").alias("pieces"), F.count("*").alias("calls"))


@query("SELECT source, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS hash, files FROM (SELECT source, string_agg('=== ' || doc_id || ' ===' || chr(10) || text || chr(10), chr(10) || chr(10) ORDER BY doc_id) AS t, count(*) AS files FROM documents GROUP BY source)")
def corpus_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit("\n")))
    whole = chunking.assemble(docs, "source", "doc_id", "text", "doc_id")
    return whole.select("source", long(F.char_length("text")).alias("n_chars"), content_hash(F.col("text")).alias("hash"), long(F.size("names")).alias("files"))


@query(f"""WITH RECURSIVE whole AS (SELECT source, string_agg('=== ' || doc_id || ' ===' || chr(10) || text || chr(10), chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY source),
    {_split_sql('whole', 'source', 't', CHUNK)} SELECT source, chunk_index, sha256(piece) AS chunk_hash, CAST(length(piece) AS BIGINT) AS n_chars FROM pieces""")
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source's joined documents, with no source held as one value."""
    header = F.concat(F.lit("=== "), F.col("doc_id").cast("string"), F.lit(" ===\n"), "text", F.lit("\n"))
    parts = table(spark, sf_dir, "documents").select("source", "doc_id", header.alias("text"))
    pieces = rope.split_corpus(parts, "source", "doc_id", most=CHUNK, separator="\n\n")
    return pieces.select("source", "chunk_index", content_hash(F.col("piece")).alias("chunk_hash"), long(F.char_length("piece")).alias("n_chars"))


# --- vectors -------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 6)"


@query(f"SELECT vec_id, other_id, {_COS.format('embedding', 'other')} AS score FROM (SELECT vec_id, embedding, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other_id, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings) WHERE other_id IS NOT NULL")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("label").orderBy("vec_id")
    pairs = table(spark, sf_dir, "embeddings").withColumns({"other_id": F.lag("vec_id").over(order), "other": F.lag("embedding").over(order)}).where("other_id is not null")
    return pairs.select("vec_id", "other_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS BIGINT) AS rank, vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY s DESC, vec_id LIMIT 10")
def retrieve_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    first = chunks.orderBy("vec_id").select("embedding").first()
    best = retrieval.top_k(chunks, first.embedding if first else [], 10, "vec_id")
    # Ten rows: numbering them in one task is no bottleneck.
    place = F.row_number().over(W.orderBy(F.desc("score"), "vec_id")).cast("bigint")
    return best.select(place.alias("rank"), "vec_id", F.round("score", 6).alias("score"))


_BATCHED = """
    q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY label),
    s AS (SELECT query_id, vec_id, e.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[])) AS s FROM embeddings e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)"""


def _label_queries(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query")).withColumnRenamed("label", "query_id")


@query(f"WITH {_BATCHED} SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 10")
def retrieve_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    return retrieval.top_k_batched(chunks, _label_queries(chunks), 10, "vec_id").withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {'list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))'} AS s FROM embeddings e, embeddings q)) WHERE rank <= 5")
def retrieve_for_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query: too many to broadcast, so both sides meet in blocks."""
    chunks = table(spark, sf_dir, "embeddings")
    asked = chunks.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k_blocks(chunks, asked, 5, "vec_id").withColumn("score", F.round("score", 6))


@query(f"WITH {_BATCHED} SELECT query_id, sum(CASE WHEN label = query_id THEN 1 ELSE 0 END)::BIGINT AS same, count(*) AS n FROM r WHERE rank <= 10 GROUP BY query_id")
def retrieve_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    best = retrieval.top_k_batched(chunks, _label_queries(chunks), 10, "vec_id")
    return best.join(chunks.select("vec_id", "label"), "vec_id").groupBy("query_id").agg(F.count_if(F.col("label") == F.col("query_id")).alias("same"), F.count("*").alias("n"))


@query("SELECT vec_id, CAST(1 AS DOUBLE) AS self, CAST(0 AS DOUBLE) AS zero, CAST(0 AS DOUBLE) AS shorter, CAST(0 AS DOUBLE) AS empty FROM embeddings")
def cosine_guard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    none = F.transform(v, lambda x: x * 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(v, v), 6).alias("self"), cosine(v, none).alias("zero"), cosine(v, F.slice(v, F.lit(1), F.size(v) - 1)).alias("shorter"), cosine(v, F.array().cast("array<float>")).alias("empty"))


# --- store ---------------------------------------------------------------------------------


def _files(docs: DataFrame) -> DataFrame:
    """Documents as files: path, mtime, size."""
    return docs.select(F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("doc_path"), F.col("doc_id").alias("mtime"), long(F.octet_length("text")).alias("size"), "text", "doc_id")


def _known(files: DataFrame) -> DataFrame:
    """An earlier state of the store: without every seventh file, and with an older size of every fifth."""
    size = F.col("size") - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    return files.where(F.col("doc_id") % 7 != 0).select("doc_path", "mtime", size.alias("size"), F.lit(0).cast("bigint").alias("last_ingested_at"), "doc_id", "text")


_PATH = "'doc-' || lpad(CAST(doc_id AS VARCHAR), 12, '0')"


@query(f"SELECT {_PATH} AS doc_path, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents")
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(table(spark, sf_dir, "documents"))
    return store.file_status(files, _known(files))


def _stored(known: DataFrame) -> DataFrame:
    return chunking.split_column(known, "text", CHUNK, "doc_path").withColumnRenamed("piece", "text")


_STORE = f"""WITH RECURSIVE {_split_sql('documents', 'doc_id', 'text', CHUNK)},
    old AS (SELECT doc_id, count(*) AS n FROM pieces WHERE doc_id % 7 <> 0 GROUP BY doc_id),
    fresh AS (SELECT doc_id, chunk_index, (SELECT CAST(sum(n) AS BIGINT) FROM old) + row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS id FROM pieces WHERE doc_id % 7 = 0 OR doc_id % 5 = 0)"""


@query(f"{_STORE} SELECT {_PATH} AS doc_path, count(*) AS chunks, CAST(min(id) AS BIGINT) AS first_id, CAST(max(id) AS BIGINT) AS last_id FROM fresh GROUP BY doc_id")
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(table(spark, sf_dir, "documents"))
    known = _known(files)
    meta = known.select("doc_path", "mtime", "size", "last_ingested_at")
    before = _stored(known)
    base = before.count()
    old = before.withColumn("chunk_id", F.lit(-1).cast("bigint")).select("chunk_id", "doc_path", "chunk_index", "text")
    changed = store.to_ingest(files, meta)
    new_meta = changed.select("doc_path", "mtime", "size", F.lit(1).cast("bigint").alias("last_ingested_at"))
    chunks, _ = store.replace_documents(old, meta, _stored(changed), new_meta, base)
    return chunks.where("chunk_id >= 0").groupBy("doc_path").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


@query(f"""WITH RECURSIVE {_split_sql('documents', 'doc_id', 'text', CHUNK)}
    SELECT (SELECT count(DISTINCT doc_id) FROM pieces WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0) AS removed, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM pieces WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 0""")
def store_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(table(spark, sf_dir, "documents"))
    known = _known(files)
    paths = files.where(F.col("doc_id") % 3 == 0).select("doc_path")
    chunks, meta = store.remove_documents(_stored(known), known.select("doc_path"), paths)
    removed = known.join(paths, "doc_path", "left_semi").agg(F.count("*").alias("removed"))
    return removed.crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(meta.agg(F.count("*").alias("documents")))


# --- caches --------------------------------------------------------------------------------


@query("""WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 AND strlen(text) <= 2000)
    SELECT doc_id, sha256(text) IN (SELECT h FROM c) AS hit FROM documents""")
def parse_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("file_hash"), F.octet_length("text").alias("bytes"))
    puts = caches.accepted(docs.where(F.col("doc_id") % 2 == 0), F.col("bytes"), 2000)
    return caches.lookup(docs.select("doc_id", "file_hash"), puts.select("file_hash"), "file_hash").select("doc_id", "hit")


_ENTRIES = "SELECT user_id, max(epoch_us(ts)) AS last_access, max(event_id) AS last_event, CAST(max(trunc(value * 1000)) AS BIGINT) AS bytes FROM events GROUP BY user_id"
_CAPACITY = 5_000_000


@query(f"SELECT user_id, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY last_access DESC, last_event DESC ROWS UNBOUNDED PRECEDING) AS total FROM ({_ENTRIES})) WHERE total <= {_CAPACITY}")
def lru_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(micros()).alias("last_access"), F.max("event_id").alias("last_event"), long(F.max(long(F.col("value") * 1000))).alias("bytes"))
    return caches.survivors(entries, F.col("bytes"), _CAPACITY, F.desc("last_access"), F.desc("last_event")).select("user_id", "bytes")


@query("SELECT event_id, CASE WHEN before <> event_type THEN before END AS evicted FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)")
def corpus_switch_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.evictions(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "evicted")


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 100),
    p AS (SELECT a.doc_id, b.doc_id AS before, b.n, string_split(a.text, '') AS x, string_split(b.text, '') AS y FROM t a JOIN t b ON left(a.text, 100) = left(b.text, 100) AND a.doc_id > b.doc_id AND a.text <> b.text),
    c AS (SELECT doc_id, before, n, least(len(x), len(y)) AS most, list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda k: x[k] = y[k]), false) AS differs FROM p),
    l AS (SELECT doc_id, before, CAST(CASE WHEN coalesce(differs, 0) = 0 THEN most ELSE differs - 1 END AS BIGINT) AS prefix, n FROM c)
    SELECT doc_id, before, prefix FROM l WHERE prefix >= 0.5 * n""")
def common_prefix_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.prefix_pairs(table(spark, sf_dir, "documents"), "doc_id", 100)


_SUFFIX = " And one more sentence."


@query(f"SELECT doc_id, CAST(length(text) AS BIGINT) AS prefix, CAST({len(_SUFFIX)} AS BIGINT) AS suffix_chars FROM documents WHERE length(text) >= 2000")
def append_only_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "documents").select("doc_id", "text")
    grown = last.withColumn("text", F.concat("text", F.lit(_SUFFIX)))
    return caches.append_only(grown, last, "doc_id").select("doc_id", "prefix", long(F.char_length("suffix")).alias("suffix_chars"))


@query("""WITH q AS (SELECT conv_id, turn, md5(text) AS h, CAST(conv_id % 3 AS BIGINT) AS corpus_version FROM conversations WHERE role = 'user'),
    f AS (SELECT *, row_number() OVER (PARTITION BY h, corpus_version ORDER BY conv_id, turn) AS k FROM q)
    SELECT corpus_version, count(*) AS lookups, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM f GROUP BY corpus_version""")
def answer_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.md5(F.col("text").cast("binary")).alias("h"), (F.col("conv_id") % 3).alias("corpus_version"))
    # The first of equal questions to a version misses, all others hit: counts suffice.
    groups = asked.groupBy("h", "corpus_version").agg(F.count("*").alias("n"))
    rates = groups.groupBy("corpus_version").agg(F.sum("n").alias("lookups"), F.sum(F.col("n") - 1).alias("hits"))
    return rates.withColumn("hit_rate", F.round(F.col("hits") / F.col("lookups"), 6))


@query("""WITH v AS (SELECT user_id % 3 AS corpus, event_id AS t, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS version FROM events WHERE event_type = 'error'),
    q AS (SELECT conv_id, turn, md5(text) AS question, conv_id % 3 AS corpus, conv_id * 8 + turn AS t FROM conversations WHERE role = 'user'),
    a AS (SELECT q.*, v.version FROM q ASOF LEFT JOIN v ON v.corpus = q.corpus AND v.t <= q.t),
    f AS (SELECT *, row_number() OVER (PARTITION BY corpus, version, question ORDER BY t) AS k, min(t) OVER (PARTITION BY corpus, version, question) AS first_t FROM a)
    SELECT conv_id, turn, CAST(version AS BIGINT) AS version, version IS NOT NULL AND k > 1 AS hit, CAST(CASE WHEN version IS NOT NULL AND k > 1 THEN first_t END AS BIGINT) AS first_at FROM f""")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the corpus version at their time; errors among the events stand for re-ingests."""
    bumps = table(spark, sf_dir, "events").where("event_type = 'error'").select(long(F.col("user_id") % 3).alias("corpus"), long("event_id").alias("at"))
    log = ordered.segmented_sum(bumps, F.lit(1).cast("bigint"), "corpus", "at", name="version")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("question"), long(F.col("conv_id") % 3).alias("corpus"), long(F.col("conv_id") * 8 + F.col("turn")).alias("at"))
    return caches.answers(asked, log).select("conv_id", "turn", "version", "hit", "first_at")


# --- questions and answers -----------------------------------------------------------------

_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(rf"SELECT conv_id, turn, CASE WHEN {_TRIM.format('text')} = '' THEN 'empty' WHEN {_WORDS} < 3 THEN 'too generic' END AS problem, CAST({_WORDS} AS BIGINT) AS words FROM conversations WHERE role = 'user'")
def question_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", T.question_problem(F.col("text")).alias("problem"), T.word_count(F.col("text")).alias("words"))


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return qa.map_phase(docs, CHUNK, lambda p: qa.extract_sentence(p, WORD), "source", "doc_id")


_MAP = f"""WITH RECURSIVE {_split_sql('documents', 'source, doc_id', 'text', CHUNK)},
    found AS (SELECT source, doc_id, chunk_index, {_TRIM.format(f"list_filter(string_split(piece, '.'), lambda s: contains(s, ' {WORD} '))[1]")} AS excerpt FROM pieces),
    kept AS (SELECT * FROM found WHERE excerpt IS NOT NULL AND excerpt <> '' AND lower(excerpt) <> 'none')"""


@query(f"{_MAP} SELECT doc_id, chunk_index, excerpt FROM kept")
def extract_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extractions(spark, sf_dir).select("doc_id", "chunk_index", "excerpt")


@query(f"{_MAP}, f AS (SELECT source, string_agg(excerpt, chr(10) || '---' || chr(10) ORDER BY doc_id, chunk_index) AS facts, count(*) AS n FROM kept GROUP BY source) SELECT s.source, sha256(coalesce(facts, '')) AS answer_hash, coalesce(n, 0) AS n_facts FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN f ON f.source = s.source")
def map_reduce_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = qa.answer_all(table(spark, sf_dir, "documents"), _extractions(spark, sf_dir), "source", "doc_id", "chunk_index")
    return answers.select("source", content_hash(F.col("facts")).alias("answer_hash"), "n_facts")


@query(f"{_MAP} SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_index) - 1 AS BIGINT) AS fact, doc_id, chunk_index, length(excerpt)::BIGINT AS excerpt_chars FROM kept")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id", "chunk_index")).cast("bigint") - 1
    return _extractions(spark, sf_dir).select("source", place.alias("fact"), "doc_id", "chunk_index", long(F.char_length("excerpt")).alias("excerpt_chars"))


@query(f"""{_MAP.split(", found AS")[0]}, said AS (SELECT source, length(piece) AS n, length(coalesce({_TRIM.format(f"list_filter(string_split(piece, '.'), lambda s: contains(s, ' {WORD} '))[1]")}, 'NONE')) AS m FROM pieces)
    SELECT source, count(*) AS calls, CAST(sum(greatest(1, n // 4)) AS BIGINT) AS prompt_tokens, CAST(sum(greatest(1, m // 4)) AS BIGINT) AS eval_tokens, round(sum(greatest(1, n // 4) / 1000 * 1000), 3) AS prompt_eval_ms, round(sum(greatest(1, m // 4) / 50 * 1000), 3) AS eval_ms FROM said GROUP BY source""")
def call_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timed call for each chunk, summed by source."""
    pieces = chunking.split_column(table(spark, sf_dir, "documents"), "text", CHUNK, "source")
    made, _ = calls.timed_calls(pieces.withColumnRenamed("piece", "prompt"), calls.SentenceGenerator(WORD))
    sums = made.groupBy("source").agg(F.count("*").alias("calls"), *(F.sum(c).alias(n) for c, n in (("prompt_eval_count", "prompt_tokens"), ("eval_count", "eval_tokens"), ("prompt_eval_ms", "prompt_eval_ms"), ("eval_ms", "eval_ms"))))
    return sums.withColumns({c: F.round(c, 3) for c in ("prompt_eval_ms", "eval_ms")})


@query("SELECT conv_id, turn, CAST(k AS BIGINT) AS question, CASE WHEN k = 1 THEN 'prime,answer' ELSE 'answer' END AS labels, CAST(CASE WHEN k = 1 THEN 2 ELSE 1 END AS BIGINT) AS calls FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user')")
def call_log_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.turn_labels(table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id", "turn").select("conv_id", "turn", "question", "labels", "calls")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS response, CAST(arg_max(length(text), turn) AS BIGINT) AS eval_count, count(*) AS lines FROM conversations GROUP BY conv_id")
def ndjson_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("text").alias("response"), F.char_length("text").alias("eval_count")))
    folded = qa.fold_stream(turns.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")
    return folded.select("conv_id", "response", "eval_count", "lines")


def _session_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as loads and questions: types are models, users sessions; the document at hand grows for forty events.

    Two of three events load the document at hand before they ask; the others ask about what the session has.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.agg(F.max("doc_id")).first()[0] or 0
    base, version = F.floor(F.col("event_id") / 40) % (n + 1), F.floor(F.col("event_id") / 4) % 10
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), long("user_id").alias("session"), long("event_id").alias("event_id"), long(base).alias("base"), long(version).alias("version"))
    rows = rows.withColumn("doc", F.concat_ws("-", "base", "version"))
    loads = rows.where("event_id % 3 <> 0").withColumns({"kind": F.lit("load"), "at": F.col("event_id") * 2})
    events = loads.unionByName(rows.withColumns({"kind": F.lit("ask"), "at": F.col("event_id") * 2 + 1}))
    grown = rows.select("doc", "base", "version").distinct().join(docs, F.col("base") == F.col("doc_id"))
    texts = grown.select("doc", F.concat("text", F.expr(f"repeat('{_SUFFIX}', int(version))")).alias("text"))
    return events.select("key", "session", "at", "kind", F.when(F.col("kind") == "load", F.col("doc")).alias("doc")), texts


_SESSIONS = f"""
    r AS (SELECT event_type AS key, CAST(user_id AS BIGINT) AS session, event_id, event_id // 40 % (SELECT max(doc_id) + 1 FROM documents) AS base, event_id // 4 % 10 AS version FROM events),
    ev AS (SELECT key, session, event_id * 2 AS seq, 'load' AS kind, base || '-' || version AS doc FROM r WHERE event_id % 3 <> 0 UNION ALL SELECT key, session, event_id * 2 + 1, 'ask', NULL FROM r),
    tx AS (SELECT DISTINCT base || '-' || version AS doc, text || repeat('{_SUFFIX}', CAST(version AS INTEGER)) AS t FROM r JOIN documents ON doc_id = base)"""


# The state machine itself: one event of each model a step, the whole state in a row.
@query(f"""WITH RECURSIVE {_SESSIONS},
    pre AS (SELECT n.doc AS doc, o.doc AS last FROM (SELECT *, left(t, 2000) AS h FROM tx WHERE length(t) >= 2000) n JOIN (SELECT *, left(t, 2000) AS h, CAST(greatest(2000, ceil(length(t) * 0.5)) AS INTEGER) AS m FROM tx WHERE length(t) >= 2000) o
            ON n.h = o.h AND n.doc <> o.doc WHERE length(n.t) >= o.m AND left(n.t, o.m) = left(o.t, o.m) AND NOT starts_with(o.t, n.t)),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM ev),
    st AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS session, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS doc, CAST(NULL AS VARCHAR) AS tier, CAST([] AS VARCHAR[]) AS cache,
                  CAST(MAP {{}} AS MAP(BIGINT, STRUCT(doc VARCHAR, warm BOOLEAN, active BOOLEAN))) AS cur, CAST(NULL AS VARCHAR) AS last FROM (SELECT DISTINCT key FROM ev)
        UNION ALL
        SELECT key, k, session, seq, now AS doc, tier,
               CASE WHEN kind = 'load' THEN list_filter(cache, lambda x: c.doc IS NULL OR c.doc = given OR x <> c.doc) WHEN c.doc IS NULL OR list_contains(cache, c.doc) THEN cache ELSE list_append(cache, c.doc) END,
               CASE WHEN kind = 'ask' AND c.doc IS NULL THEN cur ELSE map_concat(cur, MAP {{session: CASE WHEN kind = 'load' THEN struct_pack(doc := given, warm := list_contains(list_filter(cache, lambda x: c.doc IS NULL OR c.doc = given OR x <> c.doc), given), active := false) ELSE struct_pack(doc := c.doc, warm := c.warm, active := true) END}}) END,
               CASE WHEN tier IN ('cache', 'prefix', 'cold') THEN c.doc ELSE last END
        FROM (SELECT s.key, e.k, e.session, e.seq, e.kind, e.doc AS given, c, c.doc AS now, cache, cur, s.last,
                     CASE WHEN e.kind = 'load' THEN NULL WHEN c.doc IS NULL THEN 'refused' WHEN c.active THEN 'memory' WHEN c.warm THEN 'cache' WHEN pre.doc IS NOT NULL AND list_contains(cache, s.last) THEN 'prefix' ELSE 'cold' END AS tier
              FROM (SELECT st.*, map_extract(st.cur, n.session)[1] AS c FROM st JOIN o AS n ON n.key = st.key AND n.k = st.k + 1) s JOIN o AS e ON e.key = s.key AND e.k = s.k + 1 LEFT JOIN pre ON pre.doc = s.c.doc AND pre.last = s.last))
    SELECT key, session, seq, doc, tier, CASE tier WHEN 'refused' THEN '' WHEN 'prefix' THEN 'prefix-reprime,answer' WHEN 'cold' THEN 'prime,answer' ELSE 'answer' END AS labels FROM st WHERE tier IS NOT NULL""")
def context_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, texts = _session_events(spark, sf_dir)
    return session.resolve_contexts(events, texts).select("key", "session", F.col("at").alias("seq"), "doc", "tier", "labels")


@query(f"""WITH RECURSIVE {_SESSIONS}, {_split_sql('tx', 'doc', 't', CHUNK)},
    asks AS (SELECT event_type AS key, CAST(event_id AS BIGINT) AS seq, event_id // 40 % (SELECT max(doc_id) + 1 FROM documents) || '-' || event_id // 4 % 10 AS doc FROM events),
    u AS (SELECT key, seq, doc, row_number() OVER (PARTITION BY key, md5(piece) ORDER BY seq, chunk_index) AS k FROM asks JOIN pieces USING (doc))
    SELECT key, seq, a.doc, coalesce(n, 0) AS chunks, coalesce(reused, 0) AS reused, CASE WHEN coalesce(reused, 0) = 0 THEN 'cold' WHEN reused = n THEN 'adaptive-reuse' ELSE 'adaptive-reuse-partial (' || reused || '/' || n || ' chunks)' END AS tier
    FROM asks a LEFT JOIN (SELECT key, seq, count(*) AS n, CAST(count(*) FILTER (k > 1) AS BIGINT) AS reused FROM u GROUP BY key, seq) USING (key, seq)""")
def chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over chunked documents: how many chunks find their primed context."""
    _, texts = _session_events(spark, sf_dir)
    pieces = chunking.split_column(texts, "text", CHUNK, "doc").select("doc", content_hash(F.col("piece")).alias("content_hash"))
    n = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    doc = F.concat_ws("-", long(F.floor(F.col("event_id") / 40) % (n + 1)), long(F.floor(F.col("event_id") / 4) % 10))
    asks = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), long("event_id").alias("at"), doc.alias("doc"))
    found = session.chunk_reuse(asks, pieces)
    return found.select("key", F.col("at").alias("seq"), "doc", "chunks", "reused", M.tier(F.col("chunks"), F.col("reused")).alias("tier"))


_LABEL = "[the model ran out of budget before completing an answer - showing its unfinished reasoning instead]"


@query(f"SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN {_TRIM.format('text')} WHEN turn % 2 = 0 THEN '{_LABEL}' || chr(10) || chr(10) || {_TRIM.format('text')} ELSE '' END AS answer FROM conversations")
def answer_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank, thought = F.col("turn") % 3 == 0, F.col("turn") % 2 == 0
    response, thinking = F.when(blank, "  ").otherwise(F.col("text")), F.when(thought, F.concat(F.lit("\n"), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.answer_text(response, thinking, T.utrim).alias("answer"))


@query(r"""WITH q AS (SELECT conv_id, turn, lower(['compare ', 'summary: ', 'the history of ', 'how many ', ''][CAST(turn % 5 AS INT) + 1] || text) AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\b(compare|versus|vs|difference|differ)\b') THEN 'comparison' WHEN regexp_matches(t, '\b(summari[sz]e|summary|overview)\b') THEN 'summary'
        WHEN regexp_matches(t, '\b(history|origin|evolution|timeline)\b') THEN 'history' WHEN regexp_matches(t, '\b(how many|how much|count|total)\b') THEN 'quantity' ELSE 'fact-lookup' END AS type FROM q""")
def query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.get(F.array(*map(F.lit, ("compare ", "summary: ", "the history of ", "how many ", ""))), (F.col("turn") % 5).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_type(F.concat(lead, "text")).alias("type"))


@query(f"""WITH t AS (SELECT doc_id, source, greatest(1, length(text) // 4) AS tokens FROM documents)
    SELECT doc_id, CASE WHEN sum(tokens) OVER (PARTITION BY source) <= {CONTEXT * 8} THEN 'full' ELSE 'retrieval' END AS route, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= {CONTEXT * 8} AS inside FROM t""")
def budget_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.route_by_budget(table(spark, sf_dir, "documents"), "source", T.token_estimate(F.col("text")), CONTEXT * 8, "doc_id").select("doc_id", "route", "inside")


_BUDGET, _ROUNDS = 1600, 7


def _round_sql(k: int) -> str:
    """One round of packing and extraction: f are the facts of round k, d what ends with it."""
    said = f"{_TRIM.format(f"list_filter(string_split_regex(text, '[.]|' || chr(10) || '---' || chr(10)), lambda s: contains(s, ' {WORD} '))[1]")}"
    return f"""w{k} AS (SELECT source, i, excerpt, a, b, CAST(1 AS BIGINT) AS pack, length(excerpt) AS used FROM f{k} WHERE i = 1
        UNION ALL SELECT f.source, f.i, f.excerpt, f.a, f.b, CASE WHEN used + 5 + length(f.excerpt) <= {_BUDGET} THEN pack ELSE pack + 1 END, CASE WHEN used + 5 + length(f.excerpt) <= {_BUDGET} THEN used + 5 + length(f.excerpt) ELSE length(f.excerpt) END
        FROM w{k} w JOIN f{k} f ON f.source = w.source AND f.i = w.i + 1),
    g{k} AS (SELECT source, pack, string_agg(excerpt, chr(10) || '---' || chr(10) ORDER BY i) AS text, min(a) AS a, max(b) AS b FROM w{k} GROUP BY source, pack),
    e{k} AS (SELECT source, pack, a, b, {said} AS excerpt FROM g{k}),
    r{k} AS (SELECT * FROM e{k} WHERE excerpt IS NOT NULL AND excerpt <> '' AND lower(excerpt) <> 'none'),
    s{k} AS (SELECT g.source, CASE WHEN g.n = 1 THEN 'fits' WHEN r.size IS NULL THEN 'nothing' WHEN r.size >= g.size THEN 'stuck' ELSE 'on' END AS fate
        FROM (SELECT source, count(*) AS n, sum(length(text) + 5) AS size FROM g{k} GROUP BY source) g LEFT JOIN (SELECT source, sum(length(excerpt) + 5) AS size FROM r{k} GROUP BY source) r ON r.source = g.source),
    d{k} AS (SELECT source, pack - 1 AS part, text, a, b, CAST({k} AS BIGINT) AS rounds, fate = 'stuck' AS over FROM g{k} JOIN s{k} USING (source) WHERE fate IN ('fits', 'stuck')
        UNION ALL SELECT source, 0, '', NULL, NULL, {k + 1}, false FROM s{k} WHERE fate = 'nothing'),
    f{k + 1} AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY pack) AS i, excerpt, a, b FROM r{k} JOIN s{k} USING (source) WHERE fate = 'on')"""


@query(f"""{_MAP}, f0 AS (SELECT source, i, excerpt, i - 1 AS a, i - 1 AS b FROM (SELECT source, excerpt, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_index) AS i FROM kept)),
    {', '.join(_round_sql(k) for k in range(_ROUNDS))} SELECT source, CAST(part AS BIGINT) AS part, rounds, over, CAST(a AS BIGINT) AS first_fact, CAST(b AS BIGINT) AS last_fact, sha256(text) AS answer_hash FROM ({' UNION ALL '.join(f'SELECT * FROM d{k}' for k in range(_ROUNDS))})""")
def recursive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ordered.segmented_sum(_extractions(spark, sf_dir), F.lit(1).cast("bigint"), "source", "doc_id", "chunk_index", name="fact").withColumn("fact", F.col("fact") - 1)
    done = qa.recursive_reduce(facts, "source", "fact", _BUDGET, lambda p: qa.extract_sentence(p, WORD, qa.FACT_ENDS))
    return done.select("source", "part", "rounds", "over", F.col("first").alias("first_fact"), F.col("last").alias("last_fact"), content_hash(F.col("facts")).alias("answer_hash"))


@query(r"SELECT conv_id, turn, regexp_matches(lower(t), '\?.*\S.*\?|,? and (what|who|when|where|why|how|its|their)\b|\bof the .* (that|which|whose)\b') AS compound FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') || CASE WHEN turn % 2 = 0 THEN ', and what else' ELSE '' END AS t FROM conversations)")
def query_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.when(F.col("turn") % 2 == 0, ", and what else").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_compound(text).alias("compound"))


# --- speed and cost ------------------------------------------------------------------------

_FOLD = """
    o AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT user_id, k, n, x AS v FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.n, f.v + (o.x - f.v) / (least(f.k, 20) + 1) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)"""


def _averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.running_average(table(spark, sf_dir, "events"), "user_id", F.col("value"), "ts", "event_id")


@query(f"WITH RECURSIVE {_FOLD} SELECT user_id, round(v, 6) AS average, n FROM f WHERE k = n")
def speed_profile_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averages(spark, sf_dir).select("user_id", F.round("average", 6).alias("average"), "n")


@query(f"WITH RECURSIVE {_FOLD} SELECT user_id, round(v, 6) AS before, round(v + v / (least(n, 20) + 1), 6) AS after FROM f WHERE k = n")
def speed_profile_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.col("average") + (F.col("average") * 2 - F.col("average")) / (F.least(F.col("n"), F.lit(M.WINDOW)) + 1)
    return _averages(spark, sf_dir).select("user_id", F.round("average", 6).alias("before"), F.round(moved, 6).alias("after"))


# A profile of one model, as the swap predictor takes it.
_SPEED = {"prefill": 900.0, "decode": 40.0, "answer": 64.0, "overhead": 35.0, "bandwidth": 2e5, "question": 12}


@query(f"""WITH t AS (SELECT doc_id, greatest(1, length(text) // 4) AS tokens, doc_id % 4 <> 0 AS cached FROM documents),
    c AS (SELECT *, tokens * 6.5 / {_SPEED['bandwidth']} * 1000 + 12 / {_SPEED['prefill']} * 1000 + {_SPEED['answer']} / {_SPEED['decode']} * 1000 + {_SPEED['overhead']} + tokens % 7 * 4.0 AS swap_ms, (tokens + 12) / {_SPEED['prefill']} * 1000 + {_SPEED['answer']} / {_SPEED['decode']} * 1000 + {_SPEED['overhead']} AS raw_ms FROM t),
    m AS (SELECT unnest(['adaptive', 'raw', 'swap']) AS mode)
    SELECT mode, doc_id, round(swap_ms, 4) AS swap_ms, round(raw_ms, 4) AS raw_ms, swap_ms < raw_ms AS chose_swap, CASE WHEN cached AND (mode = 'swap' OR mode = 'adaptive' AND swap_ms < raw_ms) THEN 'reuse' ELSE 'cold' END AS resolution FROM c, m""")
def swap_vs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = {k: F.lit(float(v)) for k, v in _SPEED.items()}
    docs = table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), (F.col("doc_id") % 4 != 0).alias("cached"))
    swap, raw = M.swap_cost(F.col("tokens"), s["question"], F.lit(6.5), s["bandwidth"], s["prefill"], s["decode"], s["answer"], s["overhead"])
    # Some contexts are slower to load than the model says.
    priced = docs.withColumns({"swap_ms": swap + F.col("tokens") % 7 * 4.0, "raw_ms": raw}).withColumn("chose_swap", F.col("swap_ms") < F.col("raw_ms"))
    modes = priced.withColumn("mode", F.explode(F.array(*map(F.lit, sorted(M.MODES)))))
    return modes.select("mode", "doc_id", F.round("swap_ms", 4).alias("swap_ms"), F.round("raw_ms", 4).alias("raw_ms"), "chose_swap", M.resolution(F.col("mode"), F.col("cached"), F.col("chose_swap")).alias("resolution"))


def _calls(events: DataFrame) -> DataFrame:
    """Events as a call log: types are labels, values are times."""
    label = F.when(F.col("event_id") % 3 == 0, "prime").when(F.col("event_id") % 3 == 1, "answer").otherwise("reduce")
    return events.select("user_id", "ts", "event_id", label.alias("label"), F.lit(900).alias("prompt_eval_count"), F.col("value").alias("prompt_eval_ms"), (F.col("event_id") % 40 + 1).alias("eval_count"), (F.col("value") * 2).alias("eval_ms"), (F.col("value") * 3 + F.col("event_id") % 11 - 5).alias("wall_ms"))


def _fold_sql(name: str, source: str, x: str) -> str:
    return f"""{name}_o AS (SELECT user_id, {x} AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM {source}),
    {name} AS (SELECT user_id, k, n, CAST(x AS DOUBLE) AS v FROM {name}_o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.n, f.v + (o.x - f.v) / (least(f.k, 20) + 1) FROM {name} f JOIN {name}_o o ON o.user_id = f.user_id AND o.k = f.k + 1)"""


@query(f"""WITH RECURSIVE ing AS (SELECT * FROM events WHERE event_id % 3 <> 1),
    fst AS (SELECT user_id, min((ts, event_id)) AS f FROM ing GROUP BY user_id),
    ans AS (SELECT e.* FROM events e JOIN fst USING (user_id) WHERE e.event_id % 3 = 1 AND (e.ts, e.event_id) > f),
    {_fold_sql('a', 'ing', '900 / greatest(value / 1000, 1e-9)')}, {_fold_sql('b', 'ing', '(event_id % 40 + 1) / greatest(value * 2 / 1000, 1e-9)')},
    {_fold_sql('c', 'ans', 'event_id % 40 + 1')}, {_fold_sql('d', 'ans', 'greatest(0, value * 3 + event_id % 11 - 5 - value - value * 2)')}
    SELECT a.user_id, round(a.v, 3) AS prefill_tps, round(b.v, 3) AS eval_tps, round(coalesce(c.v, 0), 6) AS expected_answer_tokens, round(coalesce(d.v, 0), 6) AS fixed_overhead_ms, a.n AS ingest_samples, coalesce(c.n, 0) AS swap_samples
    FROM a JOIN b ON b.user_id = a.user_id AND b.k = b.n LEFT JOIN c ON c.user_id = a.user_id AND c.k = c.n LEFT JOIN d ON d.user_id = a.user_id AND d.k = d.n WHERE a.k = a.n""")
def speed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profile.profiles(_calls(table(spark, sf_dir, "events")), "user_id", "ts", "event_id")
    return made.withColumns({c: F.round(c, n) for c, n in (("prefill_tps", 3), ("eval_tps", 3), ("expected_answer_tokens", 6), ("fixed_overhead_ms", 6))})


@query("""WITH d AS (SELECT user_id, count(*) AS total, count(*) FILTER (value > 20) AS reused FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN total = 0 OR reused = 0 THEN 'cold' WHEN total = reused THEN 'adaptive-reuse' ELSE 'adaptive-reuse-partial (' || reused || '/' || total || ' chunks)' END AS tier FROM d""")
def cache_tier_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 20).alias("reused"))
    return seen.select("user_id", M.tier(F.col("total"), F.col("reused")).alias("tier"))


@query("SELECT event_id, round(100 / greatest(value / 1000, 1e-9), 4) AS tokens_per_s, round(greatest(0, value - value * 0.6 - CAST(event_id % 50 AS DOUBLE)), 6) AS overhead_ms FROM events")
def throughput_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(M.throughput(F.lit(100), v), 4).alias("tokens_per_s"), F.round(M.overhead_ms(v, v * 0.6, (F.col("event_id") % 50).cast("double")), 6).alias("overhead_ms"))


@query("""WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, round(max(value) FILTER (k = 1) / greatest(max(value) FILTER (k = 2), 0.001), 6) AS speed_up FROM o GROUP BY user_id HAVING count(*) > 1""")
def bench_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    runs = table(spark, sf_dir, "events").select("user_id", "value", place.alias("k")).where("k <= 2").groupBy("user_id")
    both = runs.agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("cold"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("warm")).where("warm is not null")
    return both.select("user_id", F.round(F.col("cold") / F.greatest(F.col("warm"), F.lit(0.001)), 6).alias("speed_up"))


_FIT = "CASE WHEN kv = 0 THEN 131072 ELSE least(131072, greatest(greatest(CAST(floor(free * 0.85) AS BIGINT) - weights - 1000000000, 0) // nullif(kv, 0), 4096)) END"


@query(f"""WITH m AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 400000000 AS weights, CAST(2 * (p_size % 48) * 8 * 128 * 2 AS BIGINT) AS kv, CAST(trunc(p_retailprice * 10000) AS BIGINT) * 2000 AS free FROM part)
    SELECT p_partkey, kv, CAST({_FIT} AS BIGINT) AS safe_context, CAST(CASE WHEN p_partkey % 10 = 0 THEN 8192 ELSE {_FIT} END AS BIGINT) AS context,
    CASE WHEN p_partkey % 10 = 0 THEN 'override' WHEN {_FIT} = 131072 THEN 'nominal' ELSE 'capped by memory' END AS why FROM m""")
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", (long("p_size") * 400000000).alias("weights"), M.kv_bytes(F.col("p_size") % 48, F.lit(8), F.lit(128)).alias("kv"), (long(F.col("p_retailprice") * 10000) * 2000).alias("free"))
    safe = M.fit_context(F.lit(131072), F.col("weights"), F.col("kv"), F.col("free"))
    sized = part.withColumns({"safe_context": safe, "override": F.when(F.col("p_partkey") % 10 == 0, 8192).cast("bigint")}).withColumn("context", M.resolve_context(F.col("override"), F.col("safe_context")))
    nothing = F.lit(None).cast("bigint")
    return sized.select("p_partkey", "kv", "safe_context", "context", M.context_report(F.col("context"), F.col("override").isNotNull(), F.lit(131072).cast("bigint"), nothing, F.col("free")).alias("why"))


@query("""SELECT p_partkey, CAST(1024 * (1 + p_size) AS BIGINT) AS context_length, CASE WHEN p_partkey % 2 = 0 THEN CAST(512 * p_size AS BIGINT) END AS original_context_length,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN (p_size + 128) / 3.0 END AS key_length FROM part""")
def model_info_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.parse_model_info(table(spark, sf_dir, "part").select("p_partkey", _metadata().alias("json")), "p_partkey", "json")


def _metadata() -> Column:
    """Metadata of a part taken as a model: with or without a trained window, with key lengths of each kind."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    original = F.when(k % 2 == 0, F.concat(F.lit(', "m.rope.scaling.original_context_length": '), (F.col("p_size") * 512).cast("string"))).otherwise("")
    length = F.when(k % 3 == 0, F.concat(F.lit(', "m.attention.key_length": '), size)).when(k % 3 == 1, F.concat(F.lit(', "m.attention.key_length": ['), size, F.lit(', 128, "x"]'))).otherwise(', "m.attention.key_length": []')
    return F.concat(F.lit('{"m.context_length": '), ((F.col("p_size") + 1) * 1024).cast("string"), original, length, F.lit("}"))


_MODELS = """
    m AS (SELECT p_partkey, CAST(1024 * (1 + p_size) AS BIGINT) AS nominal, CASE WHEN p_partkey % 2 = 0 THEN CAST(512 * p_size AS BIGINT) END AS trained,
        CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN (p_size + 128) / 3.0 ELSE 64.0 END AS head_dim,
        CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * 100000000 END AS weights, CASE WHEN p_partkey % 7 <> 0 THEN CAST(trunc(p_retailprice * 100) AS BIGINT) * 100000 END AS free,
        CASE WHEN p_partkey % 10 = 0 THEN CAST(8192 AS BIGINT) END AS override FROM part),
    n AS (SELECT *, CAST(trunc(2 * (p_partkey % 40) * 8 * head_dim * 2) AS BIGINT) AS kv, coalesce(trained, nominal) AS ceiling FROM m),
    s AS (SELECT *, CASE WHEN kv = 0 OR free IS NULL THEN ceiling ELSE least(ceiling, greatest(greatest(CAST(floor(free * 0.85) AS BIGINT) - weights - 1000000000, 0) // nullif(kv, 0), 4096)) END AS safe FROM n),
    c AS (SELECT *, coalesce(override, safe) AS context FROM s)"""


@query(f"""WITH {_MODELS} SELECT p_partkey, nominal, trained, round(head_dim, 6) AS head_dim, kv, CAST(safe AS BIGINT) AS safe, CAST(context AS BIGINT) AS context,
    CASE WHEN override IS NOT NULL THEN 'override' WHEN context = nominal THEN 'nominal' WHEN free IS NULL THEN 'trained, memory unknown' WHEN context < ceiling THEN 'capped by memory' ELSE 'trained' END AS why FROM c""")
def model_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    models = table(spark, sf_dir, "part").select(
        "p_partkey",
        _metadata().alias("metadata"),
        F.when(k % 11 != 0, long("p_size") * 100000000).alias("weights"),
        (k % 40).alias("layers"),
        F.lit(8).alias("kv_heads"),
        F.lit(64).alias("head_dim"),
        F.when(k % 7 != 0, long(F.col("p_retailprice") * 100) * 100000).alias("free"),
    )
    made = sizing.estimate_models(models, "p_partkey", F.when(F.col("p_partkey") % 10 == 0, 8192))
    return made.select("p_partkey", "nominal", "trained", F.round("head_dim", 6).alias("head_dim"), "kv", "safe", "context", "why")


# --- serving -------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN value > 10 THEN least(CAST(floor(value * (event_id % 100)) AS BIGINT), 2000) ELSE 0 END AS done, CAST(2000 AS BIGINT) AS total FROM events")
def progress_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate, elapsed, total = F.when(F.col("value") > 10, F.col("value")).otherwise(0.0), F.col("event_id") % 100, F.lit(2000).cast("bigint")
    done = F.when(rate > 0, F.least(F.floor(rate * elapsed).cast("bigint"), total)).otherwise(F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "events").select("event_id", done.alias("done"), total.alias("total"))


@query("""WITH c AS (SELECT event_id, epoch_us(ts) // 1000 AS a, CAST(trunc(value) AS BIGINT) AS d, ts FROM events),
    s AS (SELECT *, sum(d) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM c)
    SELECT event_id, CAST(s + max(a - s + d) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - d - a AS BIGINT) AS wait_ms FROM s""")
def fifo_queue_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    arrival = F.floor(micros() / 1000).cast("bigint")
    return ordered.queue_waits(calls, arrival, long("value"), "ts", "event_id").select("event_id", long("wait").alias("wait_ms"))


@query("SELECT name, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT *, event_type || ' ' || user_id % 7 AS name FROM events)) WHERE k = 1")
def workspace_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "event_type", (F.col("user_id") % 7).cast("string"))
    saves = table(spark, sf_dir, "events").select(name.alias("name"), "event_id", "value", micros().alias("at"))
    return workspaces.latest(saves, "name", "at", "event_id").select("name", "event_id", "value")


@query(r"""WITH n AS (SELECT p_partkey, regexp_replace(' ' || p_name || '/../' || p_brand || '! ', '^\s+|\s+$', '', 'g') AS t FROM part)
    SELECT p_partkey, CASE WHEN t <> '' AND length(t) <= 100 THEN nullif(regexp_replace(regexp_replace(t, '[^\p{L}\p{N} _-]', '', 'g'), '^\s+|\s+$', '', 'g'), '') END AS name FROM n""")
def sanitize_workspace_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_name", F.lit("/../"), "p_brand", F.lit("! "))
    return table(spark, sf_dir, "part").select("p_partkey", T.workspace_name(raw).alias("name"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '[^/\\]*$', 0), ''), 'upload') AS name FROM pages")
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 8000 THEN 'deny' ELSE 'allow' END AS decision FROM documents")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.octet_length("text") > 8000, "deny").otherwise("allow").alias("decision"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS shown FROM documents")
def truncate_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_display(F.col("text")).alias("shown"))


@query("SELECT user_id, CASE WHEN f < 0.97 THEN 'only ' || CAST(round_even(f * 100, 0) AS BIGINT) || '% of m is resident' END AS warning FROM (SELECT user_id, CAST(user_id % 128 AS DOUBLE) / 128 AS f FROM (SELECT DISTINCT user_id FROM events))")
def offload_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("f", (F.col("user_id") % 128).cast("double") / 128)
    return users.select("user_id", M.offload_warning(F.col("f"), F.lit("m")).alias("warning"))


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ', ' ORDER BY turn) AS missing FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("path", F.col("turn").cast("string"))
    spaces = turns.groupBy(F.col("conv_id").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("/", F.col("conv_id").cast("string"), "path").alias("p")))), lambda x: x["p"]).alias("paths"))
    files = turns.where("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), "path").alias("path"))
    gone = workspaces.missing_paths(spaces, files)
    return gone.select(F.col("name").alias("conv_id"), F.regexp_replace("missing", r"\d+/", "").alias("missing"))


@query()
def html_to_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_items(table(spark, sf_dir, "pages"))


def _zipped(docs: DataFrame) -> DataFrame:
    """Documents as archives: two entries, a nested archive and an unsafe name in each."""
    import io
    import zipfile

    import pyarrow as pa

    def make(batches):
        for batch in batches:
            for ids, texts in ((batch.column(0)[k : k + 256], batch.column(1)[k : k + 256]) for k in range(0, batch.num_rows, 256)):
                made = []
                for text in texts.to_pylist():
                    raw = io.BytesIO()
                    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                        for name, body in (("a.txt", text), ("b/c.txt", text[::-1]), ("nested.ZIP", "x"), ("../out.txt", "x")):
                            z.writestr(name, body)
                    made.append(raw.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([f"{x}.zip" for x in ids.to_pylist()]), ids.cast(pa.int32()), pa.array(made, pa.binary())], ["path", "pos", "content"])

    return docs.select("doc_id", "text").mapInArrow(make, "path string, pos int, content binary")


@query("SELECT doc_id || '.zip' AS path, 'a.txt' AS name, CAST(strlen(text) AS BIGINT) AS bytes FROM documents UNION ALL SELECT doc_id || '.zip', 'b/c.txt', strlen(text) FROM documents")
def zip_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.sources.files import expand_zips

    return expand_zips(_zipped(table(spark, sf_dir, "documents"))).select("path", "name", long(F.octet_length("content")).alias("bytes"))


@query("SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(doc_id % 9 AS BIGINT) AS page, CAST(length(text) AS BIGINT) AS n_chars FROM documents UNION ALL SELECT doc_id, 1, NULL, 2 FROM documents")
def converted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"), F.array(F.struct((F.col("doc_id") % 9).cast("int").alias("page_no"))).alias("prov")), F.struct(F.lit("ok").alias("text"), F.array().cast("array<struct<page_no:int>>").alias("prov"))).alias("texts")))
    items = table(spark, sf_dir, "documents").select("doc_id", F.inline(chunking.parse_converted(json)))
    return items.select("doc_id", long("pos").alias("pos"), long("page").alias("page"), long(F.char_length("text")).alias("n_chars"))


@query("SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(max(turn) AS BIGINT) AS deepest FROM conversations GROUP BY conv_id")
def dependency_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Turns behind a gap come as many levels later as are missing: one edge, whatever its length.
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.greatest(F.col("turn").cast("bigint"), F.lit(0)).alias("turn")).where("turn is not null").distinct()
    before = F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    node = lambda turn: F.struct("conv_id", turn.alias("turn"))
    edges = turns.withColumn("before", before).select(node(F.col("turn")).alias("node"), F.when(F.col("before").isNotNull(), node(F.col("before"))).alias("needs"), (F.col("turn") - F.coalesce("before", F.lit(0))).alias("dist"))
    levels = qa.dependency_levels(spark, edges)
    return levels.groupBy(F.col("node.conv_id").alias("conv_id")).agg(F.max("level").alias("deepest"))
