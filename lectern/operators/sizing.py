"""What a model needs and which window it should get, from its metadata, weights and free memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import models as M


def parse_model_info(rows: DataFrame, key: str, json: str, *keep: str) -> DataFrame:
    """key, context_length, original_context_length, key_length from metadata with prefixed names, and columns to keep."""
    fields = F.from_json(json, "map<string, string>")
    by = lambda suffix: F.try_element_at(F.map_values(F.map_filter(fields, lambda k, _: F.endswith(k, F.lit(suffix)))), F.lit(1))
    whole = lambda v: F.when(v.rlike(r"^\d+$"), v.cast("bigint"))
    plausible = lambda n: F.when((n > 0) & (n <= 4294967295), n)
    return rows.select(key, plausible(whole(by(".context_length"))).alias("context_length"), plausible(whole(by(".rope.scaling.original_context_length"))).alias("original_context_length"), M.json_average(F.try_parse_json(by(".attention.key_length"))).alias("key_length"), *keep)


def estimate_models(models: DataFrame, key: str = "model", override: Column | None = None) -> DataFrame:
    """One estimate for each model: key, nominal, trained, head_dim, kv, weights, free, safe, context, why.

    models: key, metadata (JSON), weights (bytes, null: unknown, taken as none), layers, kv_heads,
    head_dim (derived) and free (bytes of memory, null: can't be measured). The metadata's own key
    length goes before the derived one; the ceiling is the trained window where it is given, else
    the nominal one; an override is taken as it is. Metadata without a plausible window raises.
    """
    columns = ("weights", "layers", "kv_heads", "head_dim", "free", "_override")
    asked = models.withColumn("_override", F.lit(None).cast("bigint") if override is None else override.cast("bigint"))
    known = parse_model_info(asked, key, "metadata", *columns)
    nominal = F.when(F.col("context_length").isNull(), F.raise_error(F.concat(F.lit("no plausible window in the metadata of "), F.col(key).cast("string")))).otherwise(F.col("context_length"))
    sized = known.select(key, nominal.cast("bigint").alias("nominal"), F.col("original_context_length").alias("trained"), F.coalesce("key_length", F.col("head_dim").cast("double")).alias("head_dim"), F.coalesce("weights", F.lit(0)).cast("bigint").alias("weights"), F.col("free").cast("bigint").alias("free"), "layers", "kv_heads", "_override")
    sized = sized.withColumn("kv", M.kv_bytes(F.col("layers"), F.col("kv_heads"), F.col("head_dim")))
    sized = sized.withColumn("safe", M.fit_context(F.coalesce("trained", "nominal"), F.col("weights"), F.col("kv"), F.col("free")))
    sized = sized.withColumn("context", M.resolve_context(F.col("_override"), F.col("safe")))
    why = M.context_report(F.col("context"), F.col("_override").isNotNull(), F.col("nominal"), F.col("trained"), F.col("free"))
    return sized.select(key, "nominal", "trained", "head_dim", "kv", "weights", "free", "safe", "context", why.alias("why"))
