"""Near-duplicates inside clusters: scores, thresholds, links and reports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.keys import seeded_hash
from gleaner.functions.vectors import content_hash
from gleaner.operators import tiles
from gleaner.operators.clustering import drop_zero_vectors
from gleaner.operators.ranking import kth_largest, rank_in_group, running_total
from gleaner.storage import materialize

# Ids of one row where a class of copies is written out; two such rows make a quarter of a million pairs.
PART_ROWS = 512


def order_value(order: str | Column, identity: str = "id", seed: int = 0) -> Column:
    """The value rows are compared by, lowest first; ties go to the lower id.

    ``far`` puts rows far from their centroid first, ``near`` those close to it, ``random`` is a
    seeded hash, ``score_desc`` puts the highest pair score first. Any numeric Column also serves.
    """
    if isinstance(order, Column):
        return order.cast("double")
    if order == "far":
        return -F.col("centroid_dist")
    if order == "near":
        return F.col("centroid_dist")
    if order == "random":
        return seeded_hash(identity, seed).cast("double")
    if order == "score_desc":
        return -F.col("clip_score")
    raise ValueError(f"unknown order {order!r}")


@dataclass(frozen=True)
class _Collapsed:
    """Rows to compare, their number per cluster, and the copies that need no comparison (None if
    the table has none)."""

    distinct: DataFrame
    sizes: DataFrame
    copies: DataFrame | None


def _collapse(df: DataFrame, cluster: str, identity: str, embedding: str) -> _Collapsed:
    """Split exact copies from the rows that have to be compared.

    Of equal vectors in a cluster only the first stays; the others are fully described by it
    (their similarity to it is 1, the highest there is). Digests are written once as narrow rows,
    from which copies and sizes follow without the vectors; a group of copies of any size leaves
    one row for the tiles. Expects the column ``_order``; copies carry the id of their first row
    as ``_first``.
    """
    digest = content_hash(embedding).alias("_digest")
    width = F.size(embedding).alias("_size")
    digests = materialize(df.select(cluster, identity, "_order", digest, width), "digests")
    firsts = (
        digests.groupBy(cluster, "_digest")
        .agg(F.min(F.struct("_order", identity)).alias("_lead"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
        .select(cluster, "_digest", F.col("_lead")[identity].alias("_first"))
    )
    marked = digests.join(materialize(firsts, "copies"), [cluster, "_digest"], "left")
    copies = marked.filter(F.col("_first") != F.col(identity)).select(cluster, identity, "_first")
    copies = materialize(copies, "copies")
    if copies.isEmpty():
        return _Collapsed(df, tiles.cluster_rows(digests, cluster, F.col("_size")), None)
    # Vectors meet ids here, never a digest that many rows share.
    gone = copies.select(identity)
    return _Collapsed(
        df.join(gone, identity, "left_anti"),
        tiles.cluster_rows(digests.join(gone, identity, "left_anti"), cluster, F.col("_size")),
        copies,
    )


def semdedup_score(
    df: DataFrame,
    order: str | Column = "far",
    cluster: str = "cluster_id",
    identity: str = "id",
    embedding: str = "embedding",
    seed: int = 0,
    block_rows: int = tiles.BLOCK_ROWS,
    floor: float | None = None,
) -> DataFrame:
    """(id, semdedup_score): the highest similarity of a row to a row before it in its cluster.

    Clipped at 0; the first row of a cluster scores 0. Zero vectors are left out. With a
    ``floor`` (0 or more), scores at or below it are reported as the floor, which lets comparisons stop
    early; thresholds from the floor upward give the same rows.
    """
    ready = (
        drop_zero_vectors(df, embedding)
        .withColumn("_order", order_value(order, identity, seed))
        .select(cluster, identity, embedding, "_order")
    )
    split = _collapse(ready, cluster, identity, embedding)
    kind = df.schema[identity].dataType.simpleString()
    partial = tiles.self_tiles(
        split.distinct, cluster, identity, embedding, "_order",
        tiles.earlier_maxima if floor is None else tiles.above_floor(max(0.0, float(floor))),
        f"_id {kind}, _best double", block_rows, split.sizes,
    )
    compared = partial.groupBy(F.col("_id").alias(identity)).agg(F.max("_best").alias("semdedup_score"))
    if split.copies is None:
        return compared
    return compared.unionByName(split.copies.select(identity, F.lit(1.0).alias("semdedup_score")))


def distance_rank(
    df: DataFrame,
    order: str | Column = "far",
    cluster: str = "cluster_id",
    identity: str = "id",
    seed: int = 0,
) -> DataFrame:
    """(id, cluster, dis_rank): 0-based position of a row in its cluster's order."""
    narrow = df.select(cluster, identity, order_value(order, identity, seed).alias("_order"))
    ranked = rank_in_group(narrow, [F.col("_order"), F.col(identity)], [cluster], "dis_rank")
    return ranked.select(cluster, identity, (F.col("dis_rank") - 1).cast("int").alias("dis_rank"))


def score_table(
    df: DataFrame,
    order: str | Column = "far",
    cluster: str = "cluster_id",
    identity: str = "id",
    embedding: str = "embedding",
    seed: int = 0,
    block_rows: int = tiles.BLOCK_ROWS,
    floor: float | None = None,
) -> DataFrame:
    """``df`` without its vectors, with ``semdedup_score`` and ``dis_rank``."""
    scores = semdedup_score(df, order, cluster, identity, embedding, seed, block_rows, floor)
    ranks = distance_rank(drop_zero_vectors(df, embedding), order, cluster, identity, seed)
    return df.drop(embedding).join(scores, identity).join(ranks.drop(cluster), identity)


def threshold_filter(scores: DataFrame, threshold: float, score: str = "semdedup_score") -> DataFrame:
    """Rows with a duplicate score at or below the threshold."""
    return scores.filter(F.col(score) <= F.lit(threshold))


def exclude_clusters(df: DataFrame, ids: list[int] | DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``df`` without the given clusters."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(cluster), cluster, "left_anti")
    return df.filter(~F.col(cluster).isin(ids))


def cluster_sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_rows"))


def oversize_clusters(df: DataFrame, limit: int, cluster: str = "cluster_id") -> DataFrame:
    """Clusters with more than ``limit`` rows, and the pairs a full comparison would take."""
    n = F.col("n_rows")
    return cluster_sizes(df, cluster).filter(n > limit).withColumn("n_pairs", F.expr("n_rows * (n_rows - 1) div 2"))


def pairwise_in_cluster(
    df: DataFrame,
    threshold: float,
    cluster: str = "cluster_id",
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """Per cluster: pairs compared, pairs above the threshold, highest similarity (-1 without a
    pair). Every pair is compared; none is emitted."""
    kind = df.schema[cluster].dataType.simpleString()
    parts = tiles.self_tiles(
        drop_zero_vectors(df, embedding), cluster, identity, embedding, None,
        tiles.profile_above(threshold),
        f"cluster_id {kind}, _pairs bigint, _above bigint, _best double", block_rows,
    )
    return parts.groupBy(F.col("cluster_id").alias(cluster)).agg(
        F.sum("_pairs").alias("n_pairs"),
        F.sum("_above").alias("n_above"),
        F.max("_best").alias("max_sim"),
    )


def similarity_edges(
    df: DataFrame,
    threshold: float,
    cluster: str = "cluster_id",
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """(cluster_id, src, dst, sim) for all pairs of rows above the threshold, the lower id first.

    Copies of a vector are compared once, as one class; a pair of classes becomes the pairs of their rows
    behind the tiles. Rows without an id are in no pair.

    Use ``linking_edges`` to group rows: it joins the same rows with fewer edges than rows.
    """
    kind, own = (df.schema[c].dataType.simpleString() for c in (cluster, identity))
    ready = drop_zero_vectors(df, embedding).filter(F.col(identity).isNotNull()).select(cluster, identity, embedding)
    keyed = ready.withColumn("_key", _class_key(cluster, embedding))
    keys = materialize(keyed.select(cluster, identity, "_key", F.size(embedding).alias("_size")), "digests")
    found = keys.groupBy("_key").agg(
        F.first(cluster).alias(cluster), F.first("_size").alias("_size"), F.count(F.lit(1)).alias("_copies")
    )
    found = materialize(found.withColumn("_class", F.monotonically_increasing_id()), "classes")
    sizes = tiles.cluster_rows(found, cluster, F.col("_size"))
    if found.filter("_copies > 1").isEmpty():
        return tiles.self_tiles(
            ready, cluster, identity, embedding, None, tiles.pairs_above(threshold),
            f"cluster_id {kind}, src {own}, dst {own}, sim double", block_rows, sizes,
        )
    # One row per class is left of its copies before they are shuffled.
    distinct = keyed.drop(identity).dropDuplicates(["_key"]).join(found.select("_key", "_class"), "_key").drop("_key")
    near = tiles.self_tiles(
        distinct, cluster, "_class", embedding, None, tiles.pairs_above(threshold),
        f"cluster_id {kind}, src bigint, dst bigint, sim double", block_rows, sizes,
    )
    if threshold < 1:
        several = found.filter("_copies > 1")
        near = near.unionByName(
            several.select(
                F.col(cluster).alias("cluster_id"), F.col("_class").alias("src"), F.col("_class").alias("dst"), F.lit(1.0).alias("sim")
            )
        )
    return _pairs_of_rows(near, _members(keys, found, identity))


def _class_key(cluster: str, embedding: str) -> Column:
    """Equal for equal vectors of one cluster. The digest has a fixed length, so the two parts stay apart."""
    return F.concat(content_hash(embedding), F.coalesce(F.concat(F.lit(":"), F.col(cluster).cast("string")), F.lit("")))


def _members(keys: DataFrame, found: DataFrame, identity: str) -> DataFrame:
    """(_class, _part, _ids): the ids of a class in parts of about ``PART_ROWS``, so that no row holds a hot class."""
    parts = F.ceil(F.col("_copies") / F.lit(PART_ROWS))
    part = F.pmod(F.xxhash64("_row"), parts)
    rows = keys.select("_key", F.col(identity).alias("_id"), F.monotonically_increasing_id().alias("_row"))
    placed = rows.join(found.select("_key", "_class", "_copies"), "_key").select("_class", part.alias("_part"), "_id")
    return materialize(placed.groupBy("_class", "_part").agg(F.collect_list("_id").alias("_ids")), "members")


def _pairs_of_rows(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, src, dst, sim) of rows from such pairs of classes; a class paired with itself gives each
    pair of its rows once.

    Pairs of parts are spread over the tasks before they become pairs of rows, so that a hot class is
    not the work of one.
    """
    lefts, rights = (members.toDF(end, f"_part_{end}", f"_ids_{end}") for end in ("src", "dst"))
    same = F.col("src") == F.col("dst")
    facing = pairs.join(lefts, "src").join(rights, "dst").filter(~same | (F.col("_part_src") <= F.col("_part_dst")))
    facing = facing.select(
        "cluster_id", "sim", "_ids_src", "_ids_dst", (same & (F.col("_part_src") == F.col("_part_dst"))).alias("_own")
    ).hint("rebalance")
    each = facing.select("cluster_id", "sim", "_ids_dst", "_own", F.posexplode("_ids_src").alias("_at", "_a"))
    behind = F.slice("_ids_dst", F.col("_at") + 2, F.size("_ids_dst"))
    each = each.select("cluster_id", "sim", "_a", F.explode(F.when(F.col("_own"), behind).otherwise(F.col("_ids_dst"))).alias("_b"))
    return each.select("cluster_id", F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "sim")


def linking_edges(
    df: DataFrame,
    threshold: float,
    cluster: str = "cluster_id",
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """(src, dst): edges that connect the same rows as all pairs above the threshold would.

    Every tile returns a spanning forest, every copy one edge, so the table stays near the number
    of rows even where thousands of rows resemble one another.
    """
    ready = drop_zero_vectors(df, embedding).select(
        cluster, identity, embedding, F.lit(0.0).alias("_order")
    )
    split = _collapse(ready, cluster, identity, embedding)
    own = df.schema[identity].dataType.simpleString()
    links = tiles.self_tiles(
        split.distinct, cluster, identity, embedding, None, tiles.forest_above(threshold),
        f"src {own}, dst {own}", block_rows, split.sizes,
    )
    if threshold >= 1 or split.copies is None:
        return links
    return links.unionByName(split.copies.select(F.col("_first").alias("src"), F.col(identity).alias("dst")))


def max_similarity_to(
    df: DataFrame,
    others: DataFrame,
    cluster: str = "cluster_id",
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """(id, max_sim): each row's highest similarity to a row of ``others`` in the same cluster,
    -1 where there is none."""

    def side(rows: DataFrame) -> DataFrame:
        return drop_zero_vectors(rows, embedding).select(
            F.col(cluster).alias("_cluster"),
            F.col(identity).alias("_id"),
            F.lit(0.0).alias("_order"),
            F.col(embedding).alias("_vector"),
        )

    own = df.schema[identity].dataType.simpleString()
    wanted = side(df)
    # Clusters that only the other side has would make tiles without left rows.
    facing = side(others).join(wanted.select("_cluster").distinct(), "_cluster", "left_semi")
    parts = tiles.cross_tiles(
        wanted, facing, tiles.facing_maxima, f"_id {own}, _best double", block_rows
    )
    return parts.groupBy(F.col("_id").alias(identity)).agg(F.max("_best").alias("max_sim"))


# --- reports --------------------------------------------------------------------------------


def keep_ratio(rows: DataFrame, kept: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Rows in, rows kept and the ratio in percent, per cluster and in total (null cluster)."""
    counted = cluster_sizes(rows, cluster).join(
        kept.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_kept")), cluster, "left"
    )
    return (
        counted.rollup(cluster)
        .agg(F.sum("n_rows").alias("n_rows"), F.sum(F.coalesce("n_kept", F.lit(0))).alias("n_kept"))
        .withColumn("kept_percent", F.col("n_kept") * 100.0 / F.col("n_rows"))
    )


def running_keep_ratio(ratios: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """The share kept over all clusters up to and including each one, in percent."""
    per_cluster = ratios.filter(F.col(cluster).isNotNull()).select(cluster, "n_rows", "n_kept")
    rows = running_total(per_cluster, [F.col(cluster)], "n_rows", "total_rows")
    both = running_total(rows, [F.col(cluster)], "n_kept", "total_kept")
    return both.withColumn("running_percent", F.col("total_kept") * 100.0 / F.col("total_rows"))


def threshold_sweep(
    scores: DataFrame, thresholds: list[float], score: str = "semdedup_score"
) -> DataFrame:
    """Rows kept at each threshold, from saved scores, in one pass."""
    counts = scores.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(score) <= F.lit(t)).alias(f"_{i}") for i, t in enumerate(thresholds)],
    )
    kept = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("n_kept"))
            for i, t in enumerate(thresholds)
        ]
    )
    return counts.select("n_rows", F.inline(kept)).select(
        "threshold", "n_kept", (F.col("n_kept") * 100.0 / F.col("n_rows")).alias("kept_percent")
    )


def threshold_for_fraction(scores: DataFrame, fraction: float, score: str = "semdedup_score") -> float:
    """The lowest score at which at least ``fraction`` of the rows stays at or below it."""
    total = scores.filter(F.col(score).isNotNull()).count()
    wanted = max(1, math.ceil(fraction * total))
    return kth_largest(scores, score, total - wanted + 1)


def score_histogram(
    scores: DataFrame, low: float, high: float, bins: int, score: str = "semdedup_score"
) -> DataFrame:
    """Rows per equal-width bin of the score; bin 0 is below ``low``, bin ``bins + 1`` at or above
    ``high``."""
    slot = F.width_bucket(F.col(score), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return scores.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
