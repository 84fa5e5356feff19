"""Sketched quantiles: their error, merging and edge cases."""

import numpy as np
import pytest

from keyfold.streaming import metrics


@pytest.mark.parametrize("shape", ["uniform", "lognormal", "ties"])
def test_ranks_of_merged_sketches_are_within_bounds(spark, shape):
    rng = np.random.default_rng(4)
    x = {"uniform": rng.random(60_000), "lognormal": rng.lognormal(sigma=3, size=60_000), "ties": rng.integers(0, 5, 60_000).astype(float)}[shape]
    df = spark.createDataFrame([("t", i % 7, float(v)) for i, v in enumerate(x)], "topic string, partition int, seconds double").repartition(6)
    parts = metrics.summaries(df, "seconds", "topic", "partition")
    assert parts.count() == 7
    r = metrics.quantiles(metrics.merged(parts, "topic"), "topic").first()
    assert (r["count"], r["q100"]) == (60_000, x.max()) and abs(r["sum"] - x.sum()) < 1e-6 * x.sum()
    for q, err in ((0.9, 0.05), (0.99, 0.005)):
        v = r[f"q{round(100 * q)}"]
        assert (x < v).mean() <= q + err and (x <= v).mean() >= q - err


def test_nulls_one_value_and_no_values(spark):
    df = spark.createDataFrame([("a", None), ("a", 3.0), ("b", None)], "topic string, seconds double")
    rows = metrics.quantiles(metrics.summaries(df, "seconds", "topic"), "topic").collect()
    assert [(r["topic"], r["count"], r["q90"], r["q99"], r["q100"]) for r in rows] == [("a", 1, 3.0, 3.0, 3.0)]
