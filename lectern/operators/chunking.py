"""From page items to numbered chunks, and from files to corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import bounded_split, raw_pieces, utrim


def split_column(df: DataFrame, text: str, most: int, *keys: str) -> DataFrame:
    """One row for each piece of the text, numbered from 0 inside its row: chunk_index, piece."""
    return df.select(*keys, F.posexplode(bounded_split(F.col(text), most)).alias("chunk_index", "piece")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def coalesce_pages(items: DataFrame, doc: str = "doc_id", pos: str = "pos", page: str = "page", text: str = "text") -> DataFrame:
    """Join neighbouring items of one page by line feeds: doc, run, page, text.

    Blank items go first, so they never break a run; a page that comes back starts a new run;
    two unknown pages are one page.
    """
    kept = items.where(F.col(text).rlike(r"(?U)\S"))
    order = W.partitionBy(doc).orderBy(pos)
    turn = F.when((F.row_number().over(order) > 1) & F.lag(page).over(order).eqNullSafe(F.col(page)), 0).otherwise(1)
    runs = kept.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("bigint") - 1)
    joined = runs.groupBy(doc, "run").agg(F.first(page, ignorenulls=True).alias(page), F.array_sort(F.collect_list(F.struct(pos, text))).alias("_items"))
    return joined.select(doc, "run", page, F.array_join(F.transform("_items", lambda x: x[text]), "\n").alias(text))


def chunk_pages(items: DataFrame, most: int, doc: str = "doc_id", pos: str = "pos", page: str = "page", text: str = "text") -> DataFrame:
    """Chunks of page items: doc, chunk_index (0-based, continuous over pages), page, piece."""
    runs = coalesce_pages(items, doc, pos, page, text)
    pieces = runs.select(doc, "run", page, F.posexplode(bounded_split(F.col(text), most)).alias("_at", "piece"))
    index = F.row_number().over(W.partitionBy(doc).orderBy("run", "_at")).cast("bigint") - 1
    return pieces.select(doc, index.alias("chunk_index"), page, "piece")


def parse_converted(json: Column) -> Column:
    """Items of a converted document: array of (pos, page, text); malformed JSON raises."""
    kind = "struct<texts: array<struct<text: string, prov: array<struct<page_no: int>>>>>"
    texts = F.coalesce(F.from_json(json, kind, {"mode": "FAILFAST"})["texts"], F.array().cast("array<struct<text: string, prov: array<struct<page_no: int>>>>"))
    return F.transform(texts, lambda t, i: F.struct(i.alias("pos"), F.get(t["prov"], F.lit(0))["page_no"].alias("page"), t["text"].alias("text")))


def assemble(files: DataFrame, corpus: str, name: str, text: str, order: str) -> DataFrame:
    """One text for each corpus: a header line and the text of every file, in argument order.

    A corpus text is one value, so it must fit a row; the chunks of its files need no assembly.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).cast("string").alias("n"), F.col(text).alias("t"))))
    return files.groupBy(corpus).agg(
        F.array_join(F.transform(parts, lambda x: F.concat(F.lit("=== "), x["n"], F.lit(" ===\n"), x["t"])), "\n\n").alias("text"),
        F.transform(parts, lambda x: x["n"]).alias("names"),
    )


def levels(df: DataFrame, text: str, sizes: tuple[int, ...], *keys: str) -> DataFrame:
    """The text split at several sizes: keys, level, chunk_index, piece."""
    out = None
    for k, most in enumerate(sizes):
        part = split_column(df, text, most, *keys).withColumn("level", F.lit(k).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out


def linked_levels(df: DataFrame, text: str, sizes: tuple[int, ...], key: str) -> DataFrame:
    """levels() of ascending sizes with links: key, level, chunk_index, start, piece, parent_index.

    start is where a piece's first character that isn't white space stands in the text; its parent
    is the piece of the next coarser level that holds that character (null on the coarsest).
    Parents are met by bins of the coarser size, of which a piece touches two at most.
    """
    parts = []
    for k, most in enumerate(sizes):
        raw = df.select(key, F.char_length(text).alias("_n"), F.posexplode(raw_pieces(F.col(text), most)).alias("_pos", "_raw"))
        order = W.partitionBy(key).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
        placed = raw.withColumn("_end", F.sum(F.char_length("_raw")).over(order))
        placed = placed.select(key, "_pos", (F.col("_end") - F.char_length("_raw")).alias("_from"), "_end", "_raw", (F.col("_n") <= most).alias("_whole"))
        bare = placed.withColumn("piece", utrim(F.col("_raw"))).where("_whole or piece <> ''")
        lead = F.char_length("_raw") - F.char_length(F.regexp_replace("_raw", r"(?U)^\s+", ""))
        index = F.row_number().over(W.partitionBy(key).orderBy("_pos")).cast("bigint") - 1
        parts.append(bare.select(key, F.lit(k).cast("long").alias("level"), index.alias("chunk_index"), (F.col("_from") + lead).alias("start"), "piece", "_from", "_end"))
    out = None
    for k, part in enumerate(parts):
        if k + 1 < len(parts):
            size = sizes[k + 1]
            up = parts[k + 1].select(F.col(key).alias("_key"), F.col("chunk_index").alias("parent_index"), F.col("_from").alias("_pf"), F.col("_end").alias("_pe"))
            up = up.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_pf") / size), F.floor(F.greatest(F.col("_pe") - 1, F.col("_pf")) / size))))
            inside = F.col(key).eqNullSafe(F.col("_key")) & (F.floor(F.col("start") / size) == F.col("_bin")) & (F.col("start") >= F.col("_pf")) & (F.col("start") < F.greatest(F.col("_pe"), F.col("_pf") + 1))
            part = part.join(up, inside, "left")
        else:
            part = part.withColumn("parent_index", F.lit(None).cast("long"))
        part = part.select(key, "level", "chunk_index", F.col("start").cast("long").alias("start"), "piece", "parent_index")
        out = part if out is None else out.unionByName(part)
    return out
