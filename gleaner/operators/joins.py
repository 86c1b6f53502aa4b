"""Joins by key, by position and by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.probabilities import any_in_labels
from gleaner.operators.ranking import row_index


def range_lookup(
    points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, width: float
) -> DataFrame:
    """Each point with the interval ``start <= point < end`` that holds it.

    Both sides are cut into bins of ``width``, so this is an equi-join on the bin and not a
    comparison of every point with every interval. With ``width`` near the mean interval length
    the intervals fill about twice as many bins as there are intervals.
    """
    binned = intervals.withColumn(
        "_bin",
        F.explode(
            F.sequence(
                F.floor(F.col(start) / F.lit(float(width))),
                F.floor(F.col(end) / F.lit(float(width))),
            )
        ),
    )
    return (
        points.withColumn("_bin", F.floor(F.col(point) / F.lit(float(width))))
        .join(binned, "_bin")
        .filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
        .drop("_bin")
    )


def row_offsets(df: DataFrame, file: str) -> DataFrame:
    """Rows of each file and the global position of its first row, files in name order."""
    counts = df.groupBy(file).agg(F.count(F.lit(1)).alias("rows"))
    # One row per file.
    earlier = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        file, "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start")
    )


def global_to_local(ids: DataFrame, identity: str, offsets: DataFrame, file: str) -> DataFrame:
    """Global row positions as (file, position in the file)."""
    bounds = offsets.select(
        file, F.col("start").alias("_start"), (F.col("start") + F.col("rows")).alias("_end")
    ).filter("_end > _start")
    width = bounds.agg(F.avg(F.col("_end") - F.col("_start"))).first()[0] or 1.0
    return range_lookup(ids, identity, bounds, "_start", "_end", width).select(
        *ids.columns, file, (F.col(identity) - F.col("_start")).alias("row_id")
    )


def attach_metadata(
    assigned: DataFrame, metadata: DataFrame, scores: DataFrame, key: str = "key"
) -> DataFrame:
    """Cluster map: the cluster, file position and pair score of every key."""
    return assigned.join(metadata, key).join(scores, key)


def attach_embeddings(cluster_map: DataFrame, embeddings: DataFrame, key: str = "key") -> DataFrame:
    """Vectors for the members of the cluster map, one shuffle on the key."""
    return cluster_map.join(embeddings, key)


def coreset_semi_join(samples: DataFrame, coreset: DataFrame, key: str = "key") -> DataFrame:
    """Samples whose key was selected."""
    return samples.join(coreset.select(key), key, "left_semi")


def first_by_key(samples: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; ``order`` must tell the copies of a key apart.

    The copies are found on the narrow columns alone. Only rows that lose to an earlier copy are
    taken out, and a rare loser list is small enough for Spark to broadcast.
    """
    place = F.struct(*order)
    firsts = (
        samples.groupBy(key)
        .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
        .select(key, "_first")
    )
    return (
        samples.join(firsts, key, "left")
        .filter(F.col("_first").isNull() | (F.col("_first") == place))
        .select(*samples.columns)
    )


def class_map(train: DataFrame, validation: DataFrame, name: str) -> DataFrame:
    """Position of every validation class among the sorted training classes.

    Raises when a validation class has no match.
    """
    places = row_index(train.select(name).distinct(), [F.col(name)], "idx_train")
    wanted = row_index(validation.select(name).distinct(), [F.col(name)], "idx_validation")
    missing = wanted.join(places, name, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"classes without a match: {[r[name] for r in missing]}")
    return wanted.join(places, name).select(
        name, F.col("idx_validation").cast("int"), F.col("idx_train").cast("int")
    )


def membership(
    predictions: DataFrame, ranked: str, real_labels: DataFrame, identity: str, labels: str, ks: list[int]
) -> DataFrame:
    """For each k, whether a top-k class is among the accepted labels. Rows without labels drop."""
    usable = real_labels.filter(F.size(labels) > 0)
    hits: list[Column] = [any_in_labels(ranked, labels, k).alias(f"hit_{k}") for k in ks]
    return predictions.join(usable, identity).select(identity, *hits)
