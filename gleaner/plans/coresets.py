"""The three selections end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from gleaner.operators import tiles
from gleaner.operators.clustering import assign_clusters
from gleaner.operators.components import connected_components, pick_per_component
from gleaner.operators.dedup import linking_edges, score_table, threshold_filter
from gleaner.operators.dynamics import prune_by_uncertainty
from gleaner.operators.joins import coreset_semi_join, first_by_key
from gleaner.operators.ranking import chained_bands
from gleaner.sources import archives
from gleaner.storage import materialize

# Thresholds of the published coresets.
SCORE_THRESHOLD = 0.945
GRAPH_THRESHOLD = 0.86


def score_coreset(
    rows: DataFrame,
    centroids: DataFrame,
    threshold: float = SCORE_THRESHOLD,
    order: str | Column = "far",
    band: tuple[float, float] | None = None,
    band_mode: str = "exact",
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
    floor: float | None = None,
) -> DataFrame:
    """Assign, score, keep rows at or below the threshold, then a band of the pair score.

    Two tables are written: the assigned vectors, which every comparison reads, and the scores,
    from which any other threshold (not below ``floor``, if one is given) can be served.
    """
    if floor is not None and floor > threshold:
        raise ValueError("the floor of the scores must not exceed the threshold")
    assigned = materialize(assign_clusters(rows, centroids, embedding), "assigned")
    scores = materialize(
        score_table(
            assigned, order, "cluster_id", identity, embedding, block_rows=block_rows, floor=floor
        ),
        "scores",
    )
    kept = threshold_filter(scores, threshold)
    return chained_bands(kept, identity, [("clip_score", *band)], band_mode) if band else kept


def graph_coreset(
    rows: DataFrame,
    centroids: DataFrame,
    threshold: float = GRAPH_THRESHOLD,
    pick: str | list[Column] = "middle",
    bands: list[tuple[str, float, float]] | None = None,
    band_mode: str = "exact",
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """Assign, link near-duplicates, keep one row per group, then bands of pair score or of the
    cosine to the centroid, each ranked among the survivors of the one before."""
    assigned = materialize(assign_clusters(rows, centroids, embedding), "assigned")
    links = linking_edges(assigned, threshold, "cluster_id", identity, embedding, block_rows)
    groups = materialize(connected_components(assigned, links, identity), "components")
    chosen = pick_per_component(assigned, groups, pick, identity, embedding)
    kept = assigned.drop(embedding).join(chosen.select(identity), identity, "left_semi")
    return chained_bands(materialize(kept, "kept"), identity, bands, band_mode) if bands else kept


def uncertainty_coreset(
    file_list: DataFrame, history: DataFrame, window: int = 10, fraction: float = 0.75
) -> DataFrame:
    """Keep the samples a model was most uncertain about."""
    return prune_by_uncertainty(file_list, materialize(history, "history"), window, fraction)


def apply_coreset(
    source: str, coreset: DataFrame, target: str, key: str = "key", max_rows: int = archives.KEYS_PER_SHARD
) -> DataFrame:
    """Rewrite the archives of ``source`` with the selected samples only; returns what was written.

    A key that comes twice is written once, the first time it comes. All choices are made on the
    index of the archives: bytes of samples that were not selected are never read, and bytes of those
    that were are read once, by the task that writes them.
    """
    index = materialize(archives.read_index(coreset.sparkSession, source), "index")
    keys = coreset.select(coreset[key].cast("bigint").alias("key"))
    chosen = materialize(first_by_key(coreset_semi_join(index, keys), "key", ["url", "position"]), "selected")
    archives.copy_archives(chosen, source, target, max_rows)
    return chosen.drop("members")
