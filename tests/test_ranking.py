"""Ranks, cuts and splits against plain Python on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import ranking, sampling


def table(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, score double").repartition(5)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    "n, low, high, mode, expected",
    [
        (10, 0.3, 0.5, "reference", [5]),
        (10, 0.3, 0.5, "exact", [4, 5]),
        (10, 0.0, 0.2, "reference", [2]),
        (10, 0.0, 0.2, "exact", [1, 2]),
        (4, 0.0, 0.2, "exact", []),
    ],
)
def test_band_by_hand(spark, n, low, high, mode, expected):
    df = table(spark, [float(-i) for i in range(n)])  # id 0 has rank 1
    assert [i + 1 for i in ids(ranking.rank_band(df, "score", "id", low, high, mode))] == expected


def test_band_sizes(spark):
    df = table(spark, [float(i) for i in range(1000)])
    assert ranking.rank_band(df, "score", "id", 0.3, 0.5, "reference").count() == 199
    assert ranking.rank_band(df, "score", "id", 0.3, 0.5).count() == 200


def test_band_that_would_keep_nearly_all_is_refused(spark):
    with pytest.raises(ValueError):
        ranking.rank_band(table(spark, [1.0, 2.0, 3.0, 4.0]), "score", "id", 0, 0.2, "reference")


@pytest.mark.parametrize("heavy", ["ties", "spread", "one value"])
def test_narrowing_is_exact(spark, monkeypatch, heavy):
    """With a tiny driver bound the search has to narrow several times, also where a third of the
    rows share one value."""
    monkeypatch.setattr(ranking, "CUT_ROWS", 20)
    monkeypatch.setattr(ranking, "CUT_SPLITS", 8)
    r = random.Random(3)
    n = 2000
    values = {
        "ties": [r.choice([1.0, 1.0, 5.0, r.random() * 10]) for _ in range(n)],
        "spread": [r.random() ** 9 for _ in range(n)],
        "one value": [2.0] * n,
    }[heavy]
    df = table(spark, values)
    order = sorted(range(n), key=lambda i: (values[i], i), reverse=True)
    for low, high in [(0, 0.2), (0.33, 0.41), (0.05, 0.95), (0.5, 1.0)]:
        kept = ids(ranking.rank_band(df, "score", "id", low, high))
        assert kept == sorted(order[int(low * n) : int(high * n)])


def test_top_fraction_of_nothing_is_nothing(spark):
    assert ranking.top_fraction(table(spark, [1.0, 2.0, 3.0]), "score", "id", 0.2).count() == 0
    assert ranking.top_fraction(table(spark, [1.0, 2.0, 3.0]), "score", "id", 1.0).count() == 3


def test_rank_in_hot_group(spark):
    """Two thirds of the rows share a group and a value; ranks stay dense."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("g"), F.lit(1.0).alias("v")
    )
    ranked = ranking.rank_in_group(df, [F.col("v"), F.col("id")], ["g"])
    shape = ranked.groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b")
    )
    assert shape.filter("n <> d or a <> 1 or b <> n").isEmpty()
    hot = [r["id"] for r in ranked.filter("g = -1").orderBy("rank").collect()]
    assert hot == sorted(hot)


@pytest.mark.parametrize("n", [10, 11, 64])
@pytest.mark.parametrize("parts", [1, 3, 7, 100])
def test_splits(spark, n, parts):
    rows = spark.range(n)
    even = [r["part"] for r in ranking.even_splits(rows, [F.col("id")], parts).orderBy("id").collect()]
    bounds = [round(i * n / parts) for i in range(parts + 1)]
    assert even == [max(i for i in range(parts) if bounds[i] <= row) for row in range(n)]
    plain = [r["part"] for r in ranking.contiguous_split(rows, [F.col("id")], parts).orderBy("id").collect()]
    bounds = [i * n // parts for i in range(parts + 1)]
    assert plain == [max(i for i in range(parts) if bounds[i] <= row) for row in range(n)]


def test_running_total(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v")).repartition(6)
    total, expected = 0, []
    for i in range(500):
        total += i % 7
        expected.append(total)
    found = ranking.running_total(df, [F.col("id")], "v").orderBy("id").collect()
    assert [r["running"] for r in found] == expected


def test_class_cap_has_no_window_over_a_class(spark):
    df = spark.range(10000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("label"))
    capped = sampling.per_class_cap(df, "label", "id", 5, seed=1)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan
    assert capped.groupBy("label").count().filter("count <> 5").isEmpty()


def test_random_samples_repeat(spark):
    df = spark.range(1000)
    one = ids(ranking.random_fraction(df, "id", 0.25, seed=4))
    assert len(one) == 250
    assert one == ids(ranking.random_fraction(df.repartition(7), "id", 0.25, seed=4))
    assert one != ids(ranking.random_fraction(df, "id", 0.25, seed=5))


def test_null_is_a_group(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"))
    ranked = ranking.rank_in_group(df, [F.col("id")], ["g"])
    assert ranked.count() == 100
    assert ranked.groupBy("g").agg(F.max("rank").alias("m")).filter("m <> 25").isEmpty()


def test_a_null_score_has_no_rank(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id bigint, score double")
    with pytest.raises(Exception, match="score is null"):
        ranking.top_fraction(df, "score", "id", 0.5).collect()


@pytest.mark.parametrize("k", [3, 2000])
def test_class_cap_is_one_plan(spark, k):
    df = spark.range(9000).selectExpr("id", "case when id % 3 = 0 then null when id % 10 = 1 then 'a' else 'b' end as label")
    sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    found = {r["label"]: r["count"] for r in sampling.per_class_cap(df, "label", "id", k, seed=5).groupBy("label").count().collect()}
    assert found == {label: min(n, k) for label, n in sizes.items()}
