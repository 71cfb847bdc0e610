"""Model facts: context sizes, memory need, speed and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usable share of free memory, bytes beside weights and cache, the least window,
# bytes of a cached number, the residency to warn below, the modes, and the observations after
# which a running average stops getting slower.
SAFETY, OVERHEAD_BYTES, LEAST_CONTEXT, DTYPE_BYTES = 0.85, 1_000_000_000, 4096, 2
OFFLOAD_BELOW = 0.97
MODES = ("swap", "raw", "adaptive")
WINDOW = 20


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {', '.join(MODES)}")
    return mode


def kv_bytes(layers: Column, heads: Column, head_dim: Column, dtype_bytes: int = DTYPE_BYTES) -> Column:
    """Bytes of the key-value cache for one token."""
    return (F.lit(2) * layers * heads * head_dim * dtype_bytes).cast("bigint")


def fit_context(ceiling: Column, weights: Column, kv: Column, free: Column, safety: float = SAFETY) -> Column:
    """The longest window up to the ceiling whose memory need fits; unknown memory: the ceiling."""
    room = F.greatest(F.floor(free * safety).cast("bigint") - weights - OVERHEAD_BYTES, F.lit(0).cast("bigint"))
    tokens = F.greatest(F.floor(room / F.nullif(kv, F.lit(0))).cast("bigint"), F.lit(LEAST_CONTEXT).cast("bigint"))
    return F.when((kv == 0) | free.isNull(), ceiling.cast("bigint")).otherwise(F.least(ceiling.cast("bigint"), tokens))


def resolve_context(override: Column, safe: Column) -> Column:
    return F.coalesce(override, safe)


def context_report(context: Column, overridden: Column, nominal: Column, trained: Column, free: Column) -> Column:
    """Why a window has its size, as one label."""
    ceiling = F.coalesce(trained, nominal)
    return (
        F.when(overridden, "override")
        .when(context == nominal, "nominal")
        .when(free.isNull(), "trained, memory unknown")
        .when(context < ceiling, "capped by memory")
        .otherwise("trained")
    )


def free_memory(line: Column) -> Column:
    """Bytes free from a `used,total` line in MiB; null if it can't be read."""
    parts = F.transform(F.split(F.element_at(F.split(line, "\n"), 1), ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999")).cast("bigint"))
    free = F.get(parts, F.lit(1)) - F.get(parts, F.lit(0))
    return F.when(free.isNotNull(), F.greatest(free, F.lit(0).cast("bigint")) * 1048576)


def offload_warning(fraction: Column, model: Column) -> Column:
    return F.when(fraction < OFFLOAD_BELOW, F.format_string("only %d%% of %s is resident", F.bround(fraction * 100).cast("bigint"), model))  # ties to even, as the reference's {:.0}


def throughput(count: Column, ms: Column) -> Column:
    return count.cast("double") / F.greatest(ms / 1000, F.lit(1e-9))


def overhead_ms(wall: Column, prompt: Column, answer: Column) -> Column:
    return F.greatest(F.lit(0.0), wall - prompt - answer)


def swap_cost(doc_tokens: Column, question_tokens: Column, bytes_per_token: Column, bandwidth: Column, prefill: Column, decode: Column, answer_tokens: Column, overhead: Column) -> tuple[Column, Column]:
    """Predicted milliseconds of reusing a stored context, and of priming afresh (our own model)."""
    tail = answer_tokens / decode * 1000 + overhead
    swap = doc_tokens * bytes_per_token / bandwidth * 1000 + question_tokens / prefill * 1000 + tail
    raw = (doc_tokens + question_tokens) / prefill * 1000 + tail
    return swap, raw


def resolution(mode: Column, cached: Column, swap_wins: Column) -> Column:
    """`reuse` or `cold` for a mode, a stored context, and the prediction (null: none made)."""
    return F.when((mode == "swap") & cached, "reuse").when((mode == "adaptive") & cached & F.coalesce(swap_wins, F.lit(False)), "reuse").otherwise("cold")


def tier(total: Column, reused: Column) -> Column:
    """How much of a map phase was reused, among the chunks that had a decision."""
    part = F.format_string("adaptive-reuse-partial (%d/%d chunks)", reused, total)
    return F.when((total == 0) | (reused == 0), "cold").when(total == reused, "adaptive-reuse").otherwise(part)


def answer_text(response: Column, thinking: Column, trim) -> Column:
    """The trimmed response, else the labelled trimmed thinking, else nothing."""
    label = "[the model ran out of budget before completing an answer - showing its unfinished reasoning instead]\n\n"
    thought = F.nullif(trim(thinking), F.lit(""))
    return F.coalesce(F.nullif(trim(response), F.lit("")), F.concat(F.lit(label), thought), F.lit(""))


def json_average(value: Column) -> Column:
    """Mean of a number or of an array's numbers, whose other members count in the divisor only."""
    whole = F.try_variant_get(value, "$", "bigint")
    many = F.try_variant_get(value, "$", "array<variant>")
    numbers = F.transform(many, lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")))
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x >= 0, x).otherwise(0))
    scalar = F.when((F.schema_of_variant(value) == "BIGINT") & (whole >= 0), whole.cast("double"))
    return F.coalesce(scalar, F.when(F.size(many) > 0, total / F.size(many)))


def predict_swap(doc_tokens: Column, question_tokens: Column, context: Column, bandwidth: Column, prefill: Column, decode: Column, answer_tokens: Column, overhead: Column, samples: Column) -> Column:
    """(predicted_swap_ms, predicted_raw_ms, chose_swap), or null without an answered call."""
    per_token = F.octet_length(F.to_json(context)) / F.greatest(F.size(context), F.lit(1))
    swap, raw = swap_cost(doc_tokens, question_tokens, per_token, bandwidth, prefill, decode, answer_tokens, overhead)
    decision = F.struct(swap.alias("predicted_swap_ms"), raw.alias("predicted_raw_ms"), (swap < raw).alias("chose_swap"))
    return F.when((samples > 0) & context.isNotNull(), decision)
