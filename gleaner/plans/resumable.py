"""Selections that go on where an earlier run ended.

A run has a folder. It holds the settings, the assigned rows laid out by batches of clusters, the
result of every finished batch, and a manifest: one small file per finished batch, which appears only
when the batch's result is whole. A later call with the same settings does what is missing; other
settings are refused, since their results would not belong together.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.clustering import assign_clusters
from gleaner.operators.components import connected_components, pick_per_component
from gleaner.operators.dedup import exclude_clusters, linking_edges, score_table, threshold_filter
from gleaner.plans.coresets import GRAPH_THRESHOLD, SCORE_THRESHOLD
from gleaner.sources.sinks import write_cluster_map
from gleaner.storage import exists, materialize, read_text, write_once

BATCHES = 64
_ASSIGNED = (
    T.StructType()
    .add("cluster_id", T.IntegerType())
    .add("centroid_dist", T.DoubleType())
    .add("centroid_cosine", T.DoubleType())
    .add("bucket", T.IntegerType())
)


def finished_batches(spark: SparkSession, path: str, batches: int) -> list[int]:
    """The batches that the manifest of a run names."""
    return [b for b in range(batches) if exists(spark, f"{path}/manifest/{b:05d}.json")]


def in_batches(
    rows: DataFrame,
    centroids: DataFrame,
    path: str,
    work: Callable[[DataFrame], DataFrame],
    settings: dict,
    exclude: list[int] | DataFrame = (),
    batches: int = BATCHES,
    most: int | None = None,
    embedding: str = "embedding",
) -> DataFrame | None:
    """What ``work`` makes of the assigned rows, one batch of clusters after the other.

    Clusters in ``exclude`` are left out after the assignment, before anything is compared. ``most``
    ends the call after so many batches. Returns None while batches are missing.
    """
    spark = rows.sparkSession
    if isinstance(exclude, DataFrame):
        # Kept with the run, so that it cannot change on the way.
        if not exists(spark, f"{path}/excluded/_SUCCESS"):
            exclude.select("cluster_id").distinct().write.mode("overwrite").parquet(f"{path}/excluded")
        exclude, named = spark.read.parquet(f"{path}/excluded"), "table"
    else:
        exclude = named = sorted(exclude)
    wanted = json.dumps(settings | {"exclude": named, "batches": batches}, sort_keys=True, default=str)
    write_once(spark, f"{path}/settings.json", wanted)
    found = read_text(spark, f"{path}/settings.json")
    if found != wanted:
        raise ValueError(f"{path} belongs to a run with other settings: {found}")
    if not exists(spark, f"{path}/assigned/_SUCCESS"):
        write_cluster_map(assign_clusters(rows, centroids, embedding), f"{path}/assigned", batches)
    layout = T.StructType([f for f in rows.schema.fields if f.name not in _ASSIGNED.names] + _ASSIGNED.fields)
    assigned = spark.read.schema(layout).parquet(f"{path}/assigned")
    done = set(finished_batches(spark, path, batches))
    pending = [b for b in range(batches) if b not in done]
    for b in pending if most is None else pending[:most]:
        part = assigned.filter(F.col("bucket") == b).drop("bucket")
        kept = exclude_clusters(part, exclude) if not isinstance(exclude, list) or exclude else part
        work(kept).write.mode("overwrite").parquet(f"{path}/result/batch={b}")
        count = spark.read.parquet(f"{path}/result/batch={b}").count()
        write_once(spark, f"{path}/manifest/{b:05d}.json", json.dumps({"batch": b, "rows": count}))
    if most is not None and most < len(pending):
        return None
    return spark.read.parquet(f"{path}/result").drop("batch")


def score_coreset(
    rows: DataFrame,
    centroids: DataFrame,
    path: str,
    threshold: float = SCORE_THRESHOLD,
    order: str = "far",
    exclude: list[int] | DataFrame = (),
    batches: int = BATCHES,
    most: int | None = None,
    identity: str = "id",
    embedding: str = "embedding",
    floor: float | None = None,
) -> DataFrame | None:
    """The rows at or below the threshold. Scores stay in the run's folder: a later call serves any
    other threshold from them (not below ``floor``, if one is given)."""
    if floor is not None and floor > threshold:
        raise ValueError("the floor of the scores must not exceed the threshold")

    def work(part: DataFrame) -> DataFrame:
        return score_table(part, order, "cluster_id", identity, embedding, floor=floor)

    settings = {"plan": "score", "order": order, "floor": floor, "identity": identity, "embedding": embedding}
    scores = in_batches(rows, centroids, path, work, settings, exclude, batches, most, embedding)
    return None if scores is None else threshold_filter(scores, threshold)


def graph_coreset(
    rows: DataFrame,
    centroids: DataFrame,
    path: str,
    threshold: float = GRAPH_THRESHOLD,
    pick: str = "middle",
    exclude: list[int] | DataFrame = (),
    batches: int = BATCHES,
    most: int | None = None,
    identity: str = "id",
    embedding: str = "embedding",
) -> DataFrame | None:
    """One row per group of near-duplicates, without its vector."""

    def work(part: DataFrame) -> DataFrame:
        links = linking_edges(part, threshold, "cluster_id", identity, embedding)
        groups = materialize(connected_components(part, links, identity), "components")
        chosen = pick_per_component(part, groups, pick, identity, embedding)
        return part.drop(embedding).join(chosen.select(identity), identity, "left_semi")

    settings = {"plan": "graph", "threshold": threshold, "pick": pick, "identity": identity, "embedding": embedding}
    return in_batches(rows, centroids, path, work, settings, exclude, batches, most, embedding)
