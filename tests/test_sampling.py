"""Shuffles by arithmetic and draws as counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import sampling


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 5, 7, 16, 17, 99, 1000, 4097])
def test_every_position_comes_once(spark, rows):
    df = spark.range(rows).withColumnRenamed("id", "row")
    found = [r["position"] for r in sampling.shuffle_rows(df, "row", rows, 3, 1).orderBy("row").collect()]
    assert sorted(found) == list(range(rows))
    assert found == [r["position"] for r in sampling.shuffle_rows(df.repartition(5), "row", rows, 3, 1).orderBy("row").collect()]
    if rows > 50:
        other = [r["position"] for r in sampling.shuffle_rows(df, "row", rows, 3, 2).orderBy("row").collect()]
        assert sum(a == b for a, b in zip(found, other, strict=True)) < 0.1 * rows
        # Neighbours come far apart: a third of all rows on average, within five standard errors.
        assert abs(np.abs(np.diff(found)).mean() / rows - 1 / 3) < 5 * 0.236 / rows**0.5


def test_shuffle_needs_no_exchange(spark):
    df = spark.range(10).withColumnRenamed("id", "row")
    plan = sampling.shuffle_rows(df, "row", 10, 0, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_large_tables_and_wrong_rows(spark):
    n = 1 << 59
    some = spark.range(n - 2000, n).withColumnRenamed("id", "row")
    found = [r["position"] for r in sampling.shuffle_rows(some, "row", n, 1, 1).collect()]
    assert len(set(found)) == 2000 and all(0 <= x < n for x in found)
    assert np.mean(found) / n == pytest.approx(0.5, abs=0.05)
    with pytest.raises(ValueError):
        sampling.shuffle_rows(some, "row", 1 << 60, 1, 1)


def shards(spark, weights):
    return spark.createDataFrame([(f"s{i:04d}", float(w)) for i, w in enumerate(weights)], "url string, weight double")


def test_counts_follow_the_weights(spark):
    weights = [i % 9 for i in range(300)]
    df = shards(spark, weights)
    draws = 10**10
    got = {r["url"]: r["n_draws"] for r in sampling.resample_counts(df, "url", draws, 5, 0, "weight").collect()}
    assert sum(got.values()) == draws
    expected = {f"s{i:04d}": draws * w / sum(weights) for i, w in enumerate(weights) if w}
    assert got.keys() == expected.keys()
    chi = sum((got[k] - e) ** 2 / e for k, e in expected.items())
    free = len(expected) - 1
    assert abs(chi - free) < 5 * (2 * free) ** 0.5
    again = sampling.resample_counts(df.repartition(7), "url", draws, 5, 0, "weight")
    assert {r["url"]: r["n_draws"] for r in again.collect()} == got
    other = sampling.resample_counts(df, "url", draws, 5, 1, "weight")
    assert {r["url"]: r["n_draws"] for r in other.collect()} != got


def test_single_draws_are_spread_as_they_should(spark):
    """Over many epochs, few draws: mean and variance of one shard's count are binomial."""
    rng_counts = [
        sampling._split(20, np.array([1.0, 0.0, 2.0, 5.0]), np.random.default_rng([1, e])) for e in range(4000)
    ]
    counts = np.array(rng_counts)
    assert (counts.sum(axis=1) == 20).all() and (counts[:, 1] == 0).all()
    assert counts.mean(axis=0) == pytest.approx([2.5, 0, 5, 12.5], abs=0.15)
    assert counts.var(axis=0) == pytest.approx([20 * p * (1 - p) for p in (1 / 8, 0, 1 / 4, 5 / 8)], abs=0.3)


def test_no_draws_and_no_weights(spark):
    assert sampling.resample_counts(shards(spark, [1, 2]), "url", 0, 1, 1).count() == 0
    with pytest.raises(ValueError):
        sampling.resample_counts(shards(spark, [0, 0]), "url", 3, 1, 1, "weight")
    equal = sampling.resample_counts(shards(spark, [0, 0, 0]), "url", 3000, 1, 1)
    assert equal.agg(F.sum("n_draws")).first()[0] == 3000 and equal.count() == 3
