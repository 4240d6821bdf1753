"""Medians by rounds of histograms."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyquill.operators import predictions


def test_A5_medians_equal_sorting(spark):
    rng = random.Random(2)
    kinds = {
        "one": [3.5], "two": [1.0, 2.0], "ties": [1.0] * 7 + [2.0] * 7, "signs": [-1.5, -2.5, 0.0, -0.0, 7.0], "wide": [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(501)],
        "near": [1.0 + i * 2.0**-52 for i in range(1000)], "inf": [float("inf"), float("-inf"), 1.0], "subnormal": [5e-324, 1e-323, -5e-324, 0.0], "gap": [-1e300] * 5 + [1e300] * 5,
    }
    rows = [(m, v) for m, values in kinds.items() for v in values] + [("none", None), ("ties", None)]
    rng.shuffle(rows)
    got = {r["metric"]: r for r in predictions.metric_stats(spark.createDataFrame(rows, "metric string, value double").repartition(3)).collect()}
    assert set(got) == set(kinds)
    for m, values in kinds.items():
        want = np.median(values)
        assert got[m]["median"] == want or math.isclose(got[m]["median"], want, rel_tol=1e-15), m
        assert (got[m]["min"], got[m]["max"], got[m]["n"]) == (min(values), max(values), len(values))
    assert predictions.metric_stats(spark.createDataFrame([], "metric string, value double")).count() == 0


def test_A5_no_task_holds_a_hot_metric(spark):
    """All rows are one metric's, all different: the rows that any exchange by metric gives a task are buckets, not values."""
    values = spark.range(200_000).select(F.lit("m").alias("metric"), (F.xxhash64("id") / 1e3).alias("value"))
    met = []
    real = predictions.once

    def watched(df, tag):
        out = real(df, tag)
        if tag == "middle":
            met.append(out.count())
        return out

    predictions.once = watched
    try:
        got = predictions.metric_stats(values).first()
    finally:
        predictions.once = real
    want = np.median(values.toPandas()["value"])
    assert got["median"] == want and got["n"] == 200_000 and met == [2] * 4
