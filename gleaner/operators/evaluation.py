"""Metrics that compare subsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.captions import has_caption_and_image
from gleaner.functions.vectors import COMPARE_DECIMALS, cosine, l2_normalize, matrix, unit_rows
from gleaner.operators import tiles
from gleaner.operators.clustering import (
    BROADCAST_BYTES,
    STRIP_ENTRIES,
    centroid_blocks,
    drop_zero_vectors,
    mean_vectors,
)
from gleaner.operators.joins import membership
from gleaner.storage import materialize

# Fixed value: logits are this many times the cosine.
LOGIT_SCALE = 100.0


def class_prototypes(prompts: DataFrame, label: str, embedding: str = "embedding") -> DataFrame:
    """(label, prototype): prompt vectors normalised, averaged per class and normalised again."""
    unit = drop_zero_vectors(prompts, embedding).select(label, l2_normalize(embedding).alias("_unit"))
    return mean_vectors(unit, label, "_unit", "_mean").select(
        label, l2_normalize("_mean").alias("prototype")
    )


def zero_shot_logits(
    images: DataFrame,
    prototypes: DataFrame,
    label: str = "label",
    embedding: str = "embedding",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``images`` without vectors, with ``logits``: 100 times the cosine to each class prototype,
    classes in label order. Prototypes beyond the broadcast bound go out in blocks, one pass each."""
    table = prototypes.select(F.col(label).alias("cluster_id"), F.col("prototype").alias("centroid"))
    result = drop_zero_vectors(images, embedding)
    for number, block in enumerate(centroid_blocks(table, limit)):
        if number:
            result = materialize(result, "logits")
        result = _add_logits(result, block.matrix, embedding)
    return result.drop(embedding)


def _add_logits(images: DataFrame, prototypes: np.ndarray, embedding: str) -> DataFrame:
    """Append the logits of these classes to those already there."""
    shared = images.sparkSession.sparkContext.broadcast(prototypes)
    kept = [f for f in images.schema.fields if f.name != "logits"]
    continued = "logits" in images.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        step = max(1, STRIP_ENTRIES // len(classes))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                logits = LOGIT_SCALE * (unit_rows(matrix(batch.column(embedding))) @ classes.T)
                logits = np.round(logits, COMPARE_DECIMALS)
                if continued:
                    logits = np.hstack([matrix(batch.column("logits")), logits])
                ends = pa.array(np.arange(len(logits) + 1, dtype=np.int32) * logits.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name) for f in kept]
                    + [pa.ListArray.from_arrays(ends, pa.array(logits.ravel()))],
                    [f.name for f in kept] + ["logits"],
                )

    schema = T.StructType(kept + [T.StructField("logits", T.ArrayType(T.DoubleType()))])
    return images.mapInArrow(work, schema)


def topk_accuracy(scored: DataFrame, label: str = "label", ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: the share of rows whose label is among the best k logits, ties to the lower class.

    A label's place is the number of classes ahead of it, so nothing is sorted. A label without a
    logit is a miss; a null label does not count.
    """
    place = F.col(label)
    own = F.get("logits", place)
    ahead = F.size(F.filter("logits", lambda x, i: (x > own) | ((x == own) & (i < place))))
    placed = scored.select(F.when(place.isNotNull(), F.when(own.isNull(), F.lit(max(ks))).otherwise(ahead)).alias("_ahead"))
    return placed.agg(*[F.avg((F.col("_ahead") < k).cast("int")).alias(f"top{k}") for k in ks])


def real_accuracy(
    predictions: DataFrame,
    real_labels: DataFrame,
    identity: str,
    ranked: str = "ranked",
    labels: str = "labels",
    ks: tuple[int, ...] = (1, 5),
) -> DataFrame:
    """One row: percent of rows with an accepted label among the best k. Rows whose list of
    accepted labels is empty do not count."""
    hits = membership(predictions, ranked, real_labels, identity, labels, list(ks))
    return hits.agg(*[(F.avg(F.col(f"hit_{k}").cast("int")) * 100).alias(f"real_top{k}") for k in ks])


def partner_ranks(
    queries: DataFrame,
    targets: DataFrame,
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """(id, partner_rank): 1 plus the number of targets more similar to a row than its own
    partner, which has the same id. Block tiles count; no pair leaves a task."""
    both = partner_ranks_both_ways(queries, targets, identity, embedding, block_rows)
    return both.filter("_side = 0").drop("_side")


def partner_ranks_both_ways(
    queries: DataFrame,
    targets: DataFrame,
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """(_side, id, partner_rank): ``partner_ranks`` of the queries (side 0), and of the targets (side 1).

    A similarity counts in both directions, so the vectors are
    shuffled for one comparison. A row without a partner has no rank, but is compared with.
    """
    queries, targets = (drop_zero_vectors(d.select(identity, embedding), embedding) for d in (queries, targets))

    def side(own: DataFrame, other: DataFrame) -> DataFrame:
        # A row goes once for every partner; only the first time others are compared with it.
        nth = F.row_number().over(Window.partitionBy(identity).orderBy(identity)).alias("_nth")
        partner = other.filter(F.col(identity).isNotNull()).select(identity, F.col(embedding).alias("_partner"), nth)
        return own.join(partner, identity, "left").select(
            F.lit(0).alias("_cluster"),
            F.col(identity).alias("_id"),
            F.round(cosine(embedding, "_partner"), COMPARE_DECIMALS).alias("_order"),
            F.col(embedding).cast("array<double>").alias("_vector"),
            (F.coalesce("_nth", F.lit(1)) == 1).alias("_faced"),
        )

    own = queries.schema[identity].dataType.simpleString()
    parts = tiles.cross_tiles(
        side(queries, targets), side(targets, queries), tiles.facing_counts,
        f"_side int, _id {own}, _better bigint", block_rows, ["_faced"],
    )
    return parts.groupBy("_side", F.col("_id").alias(identity)).agg((F.sum("_better") + 1).alias("partner_rank"))


def rank_metrics(ranks: DataFrame, direction: str) -> DataFrame:
    """One row: mean rank, floor of the median plus 1, recall at 1, 5 and 10.

    The exact median comes from a count per rank, not from a sorted list.
    """
    counts = ranks.groupBy("partner_rank").agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.lit(direction).alias("direction"),
        (F.sum(F.col("partner_rank") * F.col("_n")) / F.sum("_n")).alias("mean_rank"),
        (F.floor(F.percentile(F.col("partner_rank") - 1, F.lit(0.5), F.col("_n"))) + 1)
        .cast("double")
        .alias("median_rank"),
        *[
            (F.sum(F.when(F.col("partner_rank") <= k, F.col("_n")).otherwise(0)) / F.sum("_n")).alias(f"recall_{k}")
            for k in (1, 5, 10)
        ],
    )


def retrieval_metrics(
    images: DataFrame,
    texts: DataFrame,
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """Retrieval metrics in both directions, one row each."""
    ranks = materialize(partner_ranks_both_ways(images, texts, identity, embedding, block_rows), "partner-ranks")
    forward = rank_metrics(ranks.filter("_side = 0"), "image_to_text")
    back = rank_metrics(ranks.filter("_side = 1"), "text_to_image")
    return forward.unionByName(back)


def weighted_mean(df: DataFrame, value: str, weight: str, group: list[str] | None = None) -> DataFrame:
    """Sum of value times weight over the sum of weights."""
    return df.groupBy(*(group or [])).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"),
        F.sum(weight).alias("weight"),
    )


def count_samples(samples: DataFrame, shard: str = "shard", files: str = "files") -> DataFrame:
    """Usable samples (caption and image present) of every shard, and in total (null shard)."""
    return (
        samples.select(shard, has_caption_and_image(files).cast("int").alias("_usable"))
        .rollup(shard)
        .agg(F.sum("_usable").alias("n_samples"))
    )


def running_best(history: DataFrame, value: str, run: list[str], epoch: str = "epoch") -> DataFrame:
    """``history`` with the best value so far of each run. A run has one row per epoch."""
    so_far = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best", F.max(value).over(so_far))
