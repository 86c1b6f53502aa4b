"""Connected groups of near-duplicates and the choice of one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import COMPARE_DECIMALS, l2_distance
from gleaner.operators.clustering import mean_vectors
from gleaner.operators.ranking import rank_in_group
from gleaner.storage import materialize

MAX_ROUNDS = 100


def connected_components(rows: DataFrame, edges: DataFrame, identity: str = "id") -> DataFrame:
    """(id, component): the lowest id a row is connected to, for every row of ``rows``.

    Alternates two aggregations ("large star" and "small star") that move each link to the lowest
    neighbour, until every row hangs directly on the root of its group. The number of rounds
    grows with the logarithm of the longest chain. Rows without edges own a group each.
    """
    links = materialize(
        edges.select(
            F.greatest("src", "dst").alias("child"), F.least("src", "dst").alias("parent")
        )
        .filter("child <> parent")
        .distinct(),
        "links",
    )
    for _ in range(MAX_ROUNDS):
        if _is_star(links):
            break
        links = materialize(_small_star(_large_star(links)), "links")
    else:
        raise RuntimeError("the groups did not settle")
    return rows.select(identity).join(
        links.select(F.col("child").alias(identity), "parent"), identity, "left"
    ).select(identity, F.coalesce("parent", identity).alias("component"))


def _is_star(links: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    ends = links.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("parent", F.lit(0), F.lit(1))
    )
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every higher neighbour of a node on the node's lowest neighbour."""
    both = links.union(links.select("parent", "child")).toDF("node", "near")
    lowest = both.groupBy("node").agg(F.min("near").alias("_least")).select(
        "node", F.least("node", "_least").alias("root")
    )
    return (
        both.filter("near > node")
        .join(lowest, "node")
        .select(F.col("near").alias("child"), F.col("root").alias("parent"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Hang the lower neighbours of a node, and the node itself, on the lowest of them."""
    lowest = links.groupBy("child").agg(F.min("parent").alias("root"))
    moved = links.join(lowest, "child").filter("parent <> root").select(
        F.col("parent").alias("child"), F.col("root").alias("parent")
    )
    return moved.union(lowest.select("child", F.col("root").alias("parent"))).distinct()


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"))


def pick_per_component(
    rows: DataFrame,
    components: DataFrame,
    pick: str | list[Column] = "middle",
    identity: str = "id",
    embedding: str = "embedding",
    score: str = "clip_score",
    distance: str = "centroid_dist",
) -> DataFrame:
    """(component, id): the row kept in each group.

    ``far`` keeps the row farthest from the cluster centroid, ``score-max`` the one with the best
    pair score, ``middle`` the upper median by distance to the centroid, ``inner-middle`` the
    upper median by distance to the group's own mean. A list of sort Columns keeps the first row
    in that order. Ties go to the lower id in ascending order.
    """
    if isinstance(pick, list):
        keyed = rows.select(identity, F.struct(*pick, F.col(identity)).alias("_key"))
        return _extreme(keyed, components, identity, F.min("_key"))
    if pick == "far":
        keyed = rows.select(identity, F.struct(distance, identity).alias("_key"))
        return _extreme(keyed, components, identity, F.max("_key"))
    if pick == "score-max":
        keyed = rows.select(
            identity, F.struct((-F.col(score)).alias("_cost"), F.col(identity)).alias("_key")
        )
        return _extreme(keyed, components, identity, F.min("_key"))
    if pick == "middle":
        return _median(
            components.join(rows.select(identity, F.col(distance).alias("_dist")), identity), identity
        )
    if pick == "inner-middle":
        return _median(_inner_distance(rows, components, identity, embedding), identity)
    raise ValueError(f"unknown pick {pick!r}")


def _extreme(keyed: DataFrame, components: DataFrame, identity: str, best: Column) -> DataFrame:
    joined = components.join(keyed, identity)
    return joined.groupBy("component").agg(best.alias("_best")).select(
        "component", F.col("_best")[identity].alias(identity)
    )


def _median(measured: DataFrame, identity: str) -> DataFrame:
    """The row at index ``n // 2`` by (distance, id) of each group. Groups of one need no rank."""
    measured = materialize(measured.select("component", identity, "_dist"), "measured")
    sizes = component_sizes(measured)
    larger = sizes.filter("n_rows > 1")
    ranked = rank_in_group(
        measured.join(larger.select("component"), "component", "left_semi"),
        [F.col("_dist"), F.col(identity)],
        ["component"],
        "_rank",
    )
    middle = (
        ranked.join(larger, "component")
        .filter(F.col("_rank") == F.expr("n_rows div 2 + 1"))
        .select("component", identity)
    )
    single = measured.join(sizes.filter("n_rows = 1").select("component"), "component", "left_semi")
    return middle.unionByName(single.select("component", identity))


def _inner_distance(
    rows: DataFrame, components: DataFrame, identity: str, embedding: str
) -> DataFrame:
    """Distance of each row to the mean of its group. Only groups of several rows move vectors."""
    larger = component_sizes(components).filter("n_rows > 1").select("component")
    several = components.join(larger, "component", "left_semi")
    vectors = materialize(several.join(rows.select(identity, embedding), identity), "grouped")
    means = mean_vectors(vectors, "component", embedding, "_mean")
    measured = vectors.join(means, "component").select(
        "component",
        identity,
        F.round(l2_distance(embedding, "_mean"), COMPARE_DECIMALS).alias("_dist"),
    )
    single = components.join(larger, "component", "left_anti")
    return measured.unionByName(single.select("component", identity, F.lit(0.0).alias("_dist")))
