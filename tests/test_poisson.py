"""Poisson bootstrap: dealt out over tasks, with the draws of the hash."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from roentgrid.operators.metrics import bootstrap


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_poisson_draws_are_dealt_out(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v")).coalesce(1)
    out = bootstrap.poisson_bootstrap_mean(rows, "v", ["id"], 5)
    assert "Repartition 4, true" in _plan(out)


def test_poisson_draws_follow_the_hash(spark):
    given = [(1, 2.0), (2, None), (3, 5.0), (None, 1.0), (3, 5.0)]
    got = bootstrap.poisson_bootstrap_mean(spark.createDataFrame(given, "id long, v double"), "v", ["id"], 40, seed=9).first()

    def times(b, key):
        words = ["9", "poisson", str(b)] + ([] if key is None else [str(key)])
        u = int(hashlib.md5("|".join(words).encode()).hexdigest()[:15], 16) / float(1 << 60)
        total, p, k = 0.0, math.e**-1, 0
        while total + p > total:
            total, k = total + p, k + 1
            p /= k
            if u < total:
                return k - 1
        return k

    means = []
    for b in range(40):
        drawn = [(v, times(b, key)) for key, v in given if v is not None]
        if sum(k for _, k in drawn):
            means.append(sum(v * k for v, k in drawn) / sum(k for _, k in drawn))
    mean = sum(means) / len(means)
    assert got["mean"] == pytest.approx(mean)
    assert got["std"] == pytest.approx(math.sqrt(sum((m - mean) ** 2 for m in means) / len(means)))
