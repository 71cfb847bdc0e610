"""Generator calls with their timings: one row for each call, whatever tasks are tried again.

Calls run inside Arrow stages, and what they took is part of their row. Rows reach a table through
Spark's commit, which takes one attempt of each task, so a retried or speculated task leaves no
second row; the attempt that won is noted. Totals come from an observation of the same write.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lectern.storage import Workspace

from .qa import Generator

ANSWER = "response string, thinking string, context_out array<long>"
TIMING = "prompt_eval_count long, prompt_eval_ms double, eval_count long, eval_ms double, wall_ms double, attempt long"


class SentenceGenerator:
    """The offline generator: the first sentence that holds a word, else NONE, at stated speeds."""

    def __init__(self, word: str, prefill_tps: float = 1000.0, eval_tps: float = 50.0):
        self.word, self.prefill_tps, self.eval_tps = word, prefill_tps, eval_tps

    def generate(self, prompt: str, context: list[int] | None = None) -> dict:
        said = next((s.strip() for s in prompt.split(".") if f" {self.word} " in s), "NONE")
        read, made = max(1, len(prompt) // 4), max(1, len(said) // 4)
        return {"response": said, "context": [*(context or []), read], "prompt_eval_count": read, "prompt_eval_duration": int(read / self.prefill_tps * 1e9), "eval_count": made, "eval_duration": int(made / self.eval_tps * 1e9)}


def timed_calls(calls: DataFrame, generator: Generator, prompt: str = "prompt", context: str | None = None) -> tuple[DataFrame, dict]:
    """The calls with answers and timings, written once, and their totals (calls, wall_ms, prompt_tokens, eval_tokens).

    calls: a row for each call, with its prompt and, if named, the context that it goes on from.
    Durations of the generator's reply are nanoseconds and become milliseconds; counts that it
    doesn't give are 0. A null prompt is an empty one. Columns of calls stay; those that bear the
    name of an answer or a timing are replaced.
    """
    made = f"{ANSWER}, {TIMING}"
    names = [c.split()[0] for c in made.split(", ")]
    kept = calls.select(*(c for c in calls.columns if c not in names))
    asked = [prompt] + ([context] if context else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().attemptNumber()
        for batch in batches:
            rows = []
            for row in batch[asked].itertuples(index=False):
                before = list(row[1]) if context and row[1] is not None else None
                began = time.perf_counter()
                reply = generator.generate(row[0] or "", before)
                wall = (time.perf_counter() - began) * 1000
                ms = lambda name: (reply.get(name) or 0) / 1e6
                rows.append((reply.get("response"), reply.get("thinking"), reply.get("context"), reply.get("prompt_eval_count") or 0, ms("prompt_eval_duration"), reply.get("eval_count") or 0, ms("eval_duration"), wall, attempt))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), made])
    totals = Observation()
    seen = kept.mapInPandas(run, schema).observe(totals, F.count("*").alias("calls"), F.coalesce(F.sum("wall_ms"), F.lit(0.0)).alias("wall_ms"), F.coalesce(F.sum("prompt_eval_count"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("eval_count"), F.lit(0)).alias("eval_tokens"))
    return Workspace(calls.sparkSession, "calls").save(seen), totals.get
