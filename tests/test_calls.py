"""Timed calls: one row each, whatever tasks are tried again."""

import json
import os
import subprocess
import sys

from lectern.operators import calls

RETRY = """
import os, sys, json
from pyspark.sql import SparkSession
from pyspark import TaskContext
from lectern.operators import calls

class Failing(calls.SentenceGenerator):
    def generate(self, prompt, context=None):
        if prompt == "p7" and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
        return super().generate(prompt, context)

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = spark.createDataFrame([(k, f"p{k}") for k in range(20)], "k int, prompt string").repartition(3)
made, totals = calls.timed_calls(rows, Failing("that"))
print("RESULT" + json.dumps([sorted(r.k for r in made.collect()), sorted({r.attempt for r in made.collect()}), totals["calls"]]))
"""


def test_a_retried_task_leaves_one_row_a_call(tmp_path):
    out = subprocess.run([sys.executable, "-c", RETRY, str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": os.environ["PYTHONPATH"]})
    found = json.loads(next(x for x in out.stdout.splitlines() if x.startswith("RESULT"))[6:])
    assert found[0] == list(range(20)) and found[1] == [0, 1] and found[2] == 20


def test_timings_and_contexts(spark):
    rows = spark.createDataFrame([(1, "we see that it is. no", [4, 5], "x"), (2, None, None, "y")], "k int, prompt string, before array<long>, wall_ms string")
    made, totals = calls.timed_calls(rows, calls.SentenceGenerator("that"), context="before")
    a, b = made.orderBy("k").collect()
    assert (a.response, a.context_out, a.prompt_eval_count, a.prompt_eval_ms, a.eval_count, a.eval_ms) == ("we see that it is", [4, 5, 5], 5, 5.0, 4, 80.0)
    assert (b.response, b.prompt_eval_count) == ("NONE", 1) and a.wall_ms >= 0
    assert totals["calls"] == 2 and totals["prompt_tokens"] == 6 and totals["eval_tokens"] == 5
    none, zero = calls.timed_calls(rows.limit(0), calls.SentenceGenerator("that"))
    assert none.count() == 0 and zero["calls"] == 0

    class Bare:
        def generate(self, prompt, context=None):
            return {"response": None}

    assert [tuple(r)[-6:-2] for r in calls.timed_calls(rows.select("k", "prompt"), Bare())[0].collect()] == [(0, 0.0, 0, 0.0)] * 2
