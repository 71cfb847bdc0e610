"""Question answering over documents: routing, map, reduce, attribution, and call logs."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import bounded_split, document_budget, relevant, utrim
from lectern.storage import Workspace, steady, written

from .ordered import segmented_sum
from .rope import pack_facts

# What joins facts, and the longest generated answer in tokens.
SEPARATOR = "\n---\n"
NUM_PREDICT = 1536
FACT_ENDS = rf"\.|{SEPARATOR}"


class Generator(Protocol):
    """Answers a prompt, given an opaque context; streams parts to a callback if asked to."""

    def generate(self, prompt: str, context: list[int] | None = None) -> dict: ...


def generate_streaming(generator: Generator, prompt: str, context: list[int] | None, on_token) -> dict:
    """A generator's own streaming, or one callback with the whole text."""
    own = getattr(generator, "generate_streaming", None)
    if own:
        return own(prompt, context, on_token)
    done = generator.generate(prompt, context)
    if done["response"]:
        on_token(done["response"])
    return done


class HttpGenerator:
    """POST to <host>/api/generate."""

    def __init__(self, host: str, model: str, num_ctx: int, timeout: float = 3600):
        self.url, self.model, self.num_ctx, self.timeout = f"{host.rstrip('/')}/api/generate", model, num_ctx, timeout

    def _post(self, prompt: str, context: list[int] | None, stream: bool):
        body = {"model": self.model, "prompt": prompt, "stream": stream, "options": {"num_ctx": self.num_ctx, "num_predict": NUM_PREDICT}}
        if context is not None:
            body["context"] = context
        return urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout)

    def generate(self, prompt: str, context: list[int] | None = None) -> dict:
        with self._post(prompt, context, False) as r:
            return json.load(r)

    def generate_streaming(self, prompt: str, context: list[int] | None, on_token) -> dict:
        last, text, thought = None, [], []
        with self._post(prompt, context, True) as r:
            for line in r:
                if line.strip():
                    last = json.loads(line)
                    if last.get("response"):
                        on_token(last["response"])
                        text.append(last["response"])
                    thought.append(last.get("thinking") or "")
        if last is None:
            raise ValueError("the stream ended without a line")
        return last | {"response": "".join(text), "thinking": "".join(thought) or None}


def ask_column(generator: Generator):
    """A pandas UDF that sends a prompt column to a generator, one client for each partition."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series([generator.generate(p)["response"] for p in prompts])

    return run


def fits(text: Column, context: Column) -> Column:
    return F.char_length(text) <= document_budget(context)


def extract_sentence(piece: Column, word: str, ends: str = r"\.") -> Column:
    """The deterministic extraction of the offline generator: the first sentence that holds the word, or NONE.

    ends: a pattern of what ends a sentence; joined facts end at their separator too (FACT_ENDS).
    """
    hits = F.filter(F.split(piece, ends), lambda s: F.contains(s, F.lit(f" {word} ")))
    return F.coalesce(utrim(F.get(hits, F.lit(0))), F.lit("NONE"))


def map_phase(docs: DataFrame, most: int, extract, *keys: str, text: str = "text") -> DataFrame:
    """keys, chunk_index, excerpt of the chunks that say something.

    Equal pieces are extracted once where `extract` is an external call: pass a column function
    over `piece` for expressions, and use distinct_pieces() before costly calls.
    """
    pieces = docs.select(*keys, F.posexplode(bounded_split(F.col(text), most)).alias("chunk_index", "piece"))
    said = pieces.select(*keys, F.col("chunk_index").cast("bigint").alias("chunk_index"), extract(F.col("piece")).alias("excerpt"))
    return said.where(relevant(F.col("excerpt")))


def distinct_pieces(pieces: DataFrame, piece: str = "piece") -> DataFrame:
    """One row for each different piece, keyed by its hash: the calls that a pass needs."""
    return pieces.select(F.sha2(F.col(piece).cast("binary"), 256).alias("content_hash"), piece).dropDuplicates(["content_hash"])


def reduce_phase(extractions: DataFrame, group: str, *order: str) -> DataFrame:
    """group, facts, n_facts: excerpts in document order, joined for the final call."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "excerpt")))
    return extractions.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["excerpt"]), SEPARATOR).alias("facts"), F.count("*").alias("n_facts"))


def answer_all(groups: DataFrame, extractions: DataFrame, group: str, *order: str) -> DataFrame:
    """A reduced row for every group, even without a fact: the final call always runs."""
    return groups.select(group).distinct().join(reduce_phase(extractions, group, *order), group, "left").select(group, F.coalesce("facts", F.lit("")).alias("facts"), F.coalesce("n_facts", F.lit(0).cast("bigint")).alias("n_facts"))


def recursive_reduce(facts: DataFrame, group: str, order: str | int, budget, extract=None, excerpt: str = "excerpt", block: int | None = None) -> DataFrame:
    """Pack and reduce facts until what a group says fits the budget: group, part, facts, first, last, rounds, over.

    facts holds one row for each excerpt, numbered within its group. In each round neighbours are
    packed up to `budget` characters, and every pack is extracted from again; an excerpt cites the
    range of numbers that its pack came from. A group is done when one pack holds it all. One
    that no longer shrinks is returned in parts, flagged `over`; one of which nothing relevant is
    left has empty facts and cites nothing. Rounds have no limit: every one shrinks its groups.
    Without `order`, as (facts, group, budget, extract), each row holds a group's joined `facts`.
    """
    if extract is None:
        facts, order, budget, extract = facts.select(group, F.lit(0).cast("long").alias("_fact"), F.col("facts").alias(excerpt)), "_fact", order, budget
    steady(facts.sparkSession)
    work, gap = Workspace(facts.sparkSession, "reduce"), len(SEPARATOR)
    # An excerpt over the budget comes in pieces that cite the same number.
    cut = facts.select(group, F.col(order).alias("first"), F.posexplode(bounded_split(F.col(excerpt), budget)).alias("sub", "excerpt")).where("excerpt <> ''")
    now = segmented_sum(cut, F.lit(1).cast("long"), group, "first", "sub", name="at").select(group, "at", "excerpt", "first", F.col("first").alias("last"))
    done, k = [], 0
    while True:
        size = F.char_length("excerpt") + gap
        packed = pack_facts(now, group, "at", size, budget + gap, block)
        parts = F.array_sort(F.collect_list(F.struct("at", "excerpt")))
        text = F.array_join(F.transform(parts, lambda x: x["excerpt"]), SEPARATOR).alias("facts")
        packs = work.save(packed.groupBy(group, "_pack").agg(text, F.min("first").alias("first"), F.max("last").alias("last")))
        sums = packs.groupBy(group).agg(F.count("*").alias("_n"), F.sum(F.char_length("facts") + gap).alias("_old"))
        said = packs.select(group, "_pack", extract(F.col("facts")).alias("excerpt"), "first", "last").where(relevant(F.col("excerpt")))
        said = work.save(said)
        less = said.groupBy(F.col(group).alias("_g")).agg(F.sum(F.char_length("excerpt") + gap).alias("_new"))
        state = sums.join(less, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
        state = work.save(state.withColumn("_fate", F.when(F.col("_n") == 1, "fits").when(F.col("_new").isNull(), "nothing").when(F.col("_new") >= F.col("_old"), "stuck").otherwise("on")).select(F.col(group).alias("_g"), "_fate"))
        fate = lambda df, *which: df.join(state.where(F.col("_fate").isin(*which)), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
        ended = fate(packs, "fits", "stuck")
        part = segmented_sum(ended, F.lit(1).cast("long"), group, "_pack", name="part")
        done.append(part.select(group, (F.col("part") - 1).alias("part"), "facts", "first", "last", F.lit(k).cast("bigint").alias("rounds"), (F.col("_fate") == "stuck").alias("over")))
        none = F.lit(None).cast(now.schema["first"].dataType)
        done.append(state.where("_fate = 'nothing'").select(F.col("_g").alias(group), F.lit(0).cast("bigint").alias("part"), F.lit("").alias("facts"), none.alias("first"), none.alias("last"), F.lit(k + 1).cast("bigint").alias("rounds"), F.lit(False).alias("over")))
        if state.where("_fate = 'on'").isEmpty():
            return reduce(DataFrame.unionByName, done)
        now, k = fate(said, "on").select(group, F.col("_pack").alias("at"), "excerpt", "first", "last"), k + 1


def turn_labels(turns: DataFrame, session: str, order: str, mode: str = "swap") -> DataFrame:
    """Calls of each question of a session: the first primes a context, later ones reuse it (not in raw mode)."""
    placed = segmented_sum(turns, F.lit(1).cast("bigint"), session, order, name="question")
    first = (F.col("question") == 1) | F.lit(mode == "raw")
    return placed.withColumns({"labels": F.when(first, "prime,answer").otherwise("answer"), "calls": F.when(first, 2).otherwise(1).cast("bigint")})


def fold_stream(lines: DataFrame, key: str, order: str, json_column: str) -> DataFrame:
    """One response for each stream of JSON lines: texts joined in order, counts of the last line."""
    kind = "response string, thinking string, eval_count bigint, prompt_eval_count bigint"
    kept = lines.where(utrim(F.col(json_column)) != "").select(key, order, F.from_json(json_column, kind, {"mode": "FAILFAST"}).alias("j"))
    ordered = F.array_sort(F.collect_list(F.struct(order, "j")))
    join = lambda c: F.array_join(F.transform(ordered, lambda x: F.coalesce(x["j"][c], F.lit(""))), "")
    return kept.groupBy(key).agg(join("response").alias("response"), join("thinking").alias("thinking"), F.max_by(F.col("j.eval_count"), order).alias("eval_count"), F.count("*").alias("lines"))


def dependency_levels(spark, edges: DataFrame) -> DataFrame:
    """node and level of a sub-query graph (node, needs): a node comes after all that it needs.

    A column `dist`, where there is one, says how many levels after `needs` (or after the start) a
    node comes, so that a run of nodes nobody asks about is one weighted edge.

    Chains, where each node needs one other, are crossed by pointer doubling, in as many joins as
    their length has binary digits; only nodes with several needs take a join for each level. No
    cap on depth or rows. Nodes that no start leads to get no row; a cycle that one leads to raises.
    """
    steady(spark)
    apart = F.col("dist").cast("bigint") if "dist" in edges.columns else F.when(F.col("needs").isNull(), 0).otherwise(1).cast("bigint")
    edges = written(edges.select("node", "needs", apart.alias("dist")).groupBy("node", "needs").agg(F.max("dist").alias("dist")))
    single = edges.groupBy("node").agg(F.count("*").alias("n"), F.max("needs").alias("to"), F.max("dist").alias("dist")).where("n = 1 AND to IS NOT NULL").select("node", "to", "dist")
    # done: the pointer has left the chain, at a start or at a node with several needs.
    links = written(single.join(single.select(F.col("node").alias("to"), F.lit(False).alias("done")), "to", "left").select("node", "to", "dist", F.coalesce("done", F.lit(True)).alias("done")))
    for _ in range(links.count().bit_length() + 1):
        if links.where("NOT done").isEmpty():
            break
        ahead = links.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("done").alias("_done"))
        jumped = links.where("NOT done").join(ahead, "to").select("node", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"))
        links = written(links.where("done").unionByName(jumped))
    chains = links.where("done").drop("done")
    known = front = written(edges.where("needs IS NULL").select("node", F.col("dist").alias("level")))
    joints = edges.where("needs IS NOT NULL").join(single, "node", "left_anti")
    joints = joints.join(chains.select(F.col("node").alias("needs"), "to", F.col("dist").alias("_far")), "needs", "left")
    joints = written(joints.select("node", F.coalesce("to", "needs").alias("to"), (F.coalesce("_far", F.lit(0)) + F.col("dist")).alias("dist")))
    left = joints.select("node").distinct().count()
    while left >= 0 and not front.isEmpty():
        later = joints.join(front.select(F.col("node").alias("to"), "level"), "to").groupBy("node").agg(F.max(F.col("level") + F.col("dist")).alias("level"))
        old = known.select("node", F.col("level").alias("_level"))
        front = written(later.join(old, "node", "left").where("_level IS NULL OR level > _level").select("node", "level"))
        known = written(known.join(front.select("node"), "node", "left_anti").unionByName(front))
        left -= 1
    if not front.isEmpty():
        raise ValueError("the sub-queries need each other in a cycle")
    ends = known.select(F.col("node").alias("to"), "level")
    return known.unionByName(chains.join(ends, "to").select("node", (F.col("level") + F.col("dist")).alias("level")))


def route_by_budget(docs: DataFrame, group: str, tokens: Column, budget: int, order: str) -> DataFrame:
    """Documents with route `full` where their whole group fits the budget, else `retrieval`, and whether they fit it in order."""
    total = F.sum("_t").over(W.partitionBy(group))
    upto = F.sum("_t").over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    with_t = docs.withColumn("_t", tokens)
    return with_t.withColumns({"route": F.when(total <= budget, "full").otherwise("retrieval"), "inside": upto <= budget}).drop("_t")
