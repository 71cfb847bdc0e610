"""Speed profiles: bounded running averages over ordered observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.models import WINDOW

from .ordered import segmented_sum


def fold_average(values: Column, window: int = WINDOW) -> Column:
    """The running average of an array in its order: old + (new - old) / (min(n, window) + 1)."""
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((a["v"] + (x - a["v"]) / (F.least(a["n"], F.lit(window)) + 1)).alias("v"), (a["n"] + 1).alias("n"))
    return F.when(F.size(values) > 0, F.aggregate(values, start, step, lambda a: a["v"]))


def running_average(rows: DataFrame, key: str, value: Column, *order: Column | str, window: int = WINDOW, name: str = "average") -> DataFrame:
    """key, average and n of ordered observations, without gathering a key's rows in an array.

    The recurrence has a closed form: the first window + 1 values enter as their mean, which then
    fades by window / (window + 1) with each later value. Places are counted over range
    partitions, so a key that holds most rows is split over tasks like any other.
    """
    keep = window / (window + 1)
    placed = segmented_sum(rows.select(key, value.cast("double").alias("_x"), *_named(order)), F.lit(1).cast("bigint"), key, *_again(order), name="_k")
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    placed = placed.join(counts, F.col(key).eqNullSafe(F.col("_key")))
    late = F.pow(F.lit(keep), F.greatest(F.col("_n") - F.greatest(F.col("_k"), F.lit(window + 1)), F.lit(0)))
    weight = late / F.when(F.col("_k") > window + 1, F.lit(window + 1)).otherwise(F.least(F.col("_n"), F.lit(window + 1)))
    return placed.groupBy(key).agg(F.sum(F.col("_x") * weight).alias(name), F.count("*").alias("n"))


def _named(order: tuple) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).alias(f"_o{k}") for k, c in enumerate(order)]


def _again(order: tuple) -> list[str]:
    return [f"_o{k}" for k in range(len(order))]


def profiles(calls: DataFrame, key: str, *order: str) -> DataFrame:
    """Speed profiles from a call log (key, label, counts and milliseconds).

    Priming and reducing calls give prefill and decode speed; answering calls give answer length
    and overhead, but only once a profile exists. A key without an ingest has no profile.
    """
    ingest = calls.where(F.col("label").isin("prime", "prefix-reprime", "reduce"))
    speed = lambda n, ms: F.col(n).cast("double") / F.greatest(F.col(ms) / 1000, F.lit(1e-9))
    a = running_average(ingest, key, speed("prompt_eval_count", "prompt_eval_ms"), *order, name="prefill_tps").withColumnRenamed("n", "ingest_samples")
    b = running_average(ingest, key, speed("eval_count", "eval_ms"), *order, name="eval_tps").drop("n")
    first = calls.where("label <> 'answer'").groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    later = calls.join(first, F.col(key).eqNullSafe(F.col("_key"))).where((F.col("label") == "answer") & (F.struct(*order) > F.col("_first")))
    c = running_average(later, key, F.col("eval_count"), *order, name="expected_answer_tokens").withColumnRenamed("n", "swap_samples")
    over = F.greatest(F.lit(0.0), F.col("wall_ms") - F.col("prompt_eval_ms") - F.col("eval_ms"))
    d = running_average(later, key, over, *order, name="fixed_overhead_ms").drop("n")
    zero = F.lit(0)
    out = a.join(b, key).join(c, key, "left").join(d, key, "left")
    return out.select(key, "prefill_tps", "eval_tps", F.coalesce("expected_answer_tokens", F.lit(0.0)).alias("expected_answer_tokens"), F.coalesce("fixed_overhead_ms", F.lit(0.0)).alias("fixed_overhead_ms"), "ingest_samples", F.coalesce("swap_samples", zero).cast("bigint").alias("swap_samples"))
