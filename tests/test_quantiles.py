import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.quantiles import linear, lower_median, order_statistics


@pytest.mark.parametrize("kind", ["spread", "equal", "tiny", "huge", "skewed"])
def test_order_statistics(spark, kind):
    r = random.Random(1)
    values = {
        "spread": [r.uniform(-5, 5) for _ in range(900)], "equal": [2.5] * 900, "tiny": [r.randrange(4) * 5e-324 for _ in range(900)],
        "huge": [r.choice([-1.7e308, 1.7e308, 0.0]) for _ in range(900)], "skewed": [10 ** r.uniform(-30, 30) for _ in range(899)] + [1e300],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ranks = [0, 1, 224, 449, 450, 898, 899]
    assert order_statistics(df, F.col("v"), ranks, 8, 5) == [sorted(values)[k] for k in ranks]


def test_whole_numbers(spark):
    r = random.Random(2)
    values = [r.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [(1 << 62) + r.randrange(50) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert order_statistics(df, F.col("v"), list(range(0, 600, 61)), 8, 5) == sorted(values)[::61]
    assert lower_median(df, F.col("v")) == sorted(values)[299]
    assert lower_median(df.limit(0), F.col("v")) is None


def test_both_ways_agree(spark):
    r = random.Random(3)
    values = [r.gauss(0, 100) for _ in range(501)]
    df = spark.createDataFrame([(v, v / 3) for v in values], "a double, b double")
    columns = {"a": F.col("a"), "b": F.col("b")}
    want = np.quantile(values, [0.25, 0.5, 0.9])
    for limit in (0, 10**9):
        got = linear(df, columns, [0.25, 0.5, 0.9], limit)
        assert np.allclose(got["a"], want) and np.allclose(got["b"], want / 3)
