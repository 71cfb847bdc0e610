"""Model estimates."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import sizing

KIND = "model string, metadata string, weights long, layers int, kv_heads int, head_dim int, free long"


def estimate(spark, *rows, override=None):
    return {r.model: r for r in sizing.estimate_models(spark.createDataFrame(rows, KIND), override=override).collect()}


def test_the_trained_window_and_the_memory_cap_the_nominal_one(spark):
    scaled = '{"a.context_length": 393216, "a.rope.scaling.original_context_length": 8192, "a.attention.key_length": 128}'
    plain = '{"b.context_length": 32768}'
    big = '{"c.context_length": 393216, "c.attention.key_length": 128}'
    got = estimate(
        spark,
        ("trained", scaled, 1 << 30, 40, 8, 160, 1 << 40),
        ("unknown", scaled, None, 40, 8, 160, None),
        ("nominal", plain, 1 << 30, 4, 2, 64, 1 << 40),
        ("capped", big, 15_200_000_000, 40, 8, 160, 16 << 30),
        ("no cache", plain, 1, 0, 8, 64, 0),
    )
    assert {m: (r.context, r.why) for m, r in got.items()} == {"trained": (8192, "trained"), "unknown": (8192, "trained, memory unknown"), "nominal": (32768, "nominal"), "capped": (4096, "capped by memory"), "no cache": (32768, "nominal")}
    assert got["capped"].kv == 163_840 and got["nominal"].head_dim == 64 and got["unknown"].weights == 0


def test_an_override_is_taken_as_it_is(spark):
    got = estimate(spark, ("m", '{"x.context_length": 4096}', 1, 1, 1, 1, 1), override=F.lit(1_000_000))
    assert (got["m"].context, got["m"].why) == (1_000_000, "override")


@pytest.mark.parametrize("metadata", ["{}", '{"x.context_length": 0}', '{"x.context_length": 4294967296}', '{"x.context_length": "much"}', None])
def test_metadata_without_a_plausible_window_raises(spark, metadata):
    with pytest.raises(Exception, match="plausible"):
        estimate(spark, ("m", metadata, 1, 1, 1, 1, 1))
