"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns some points of a ring; a row goes to the owner of the first point clockwise from
its own hash. A shard takes no more rows than its bound: rows that find it full go on clockwise,
round by round, to the owner of the next point. Within a round, points are served in ring order
and the rows of a point in hash order. With no slack the bounds differ by one at most and all
shards are filled, so counts are balanced exactly.

Rows that share a point have the same way round the ring, so only the number of rows per point
reaches the driver (shards x virtual nodes numbers). Rows are laid out by range of their hash and
numbered there, hot keys included; runs of numbers are then mapped to shards and slots.

Defined cases: null, empty and repeated keys are placed like any other, equal keys next to each
other; further columns pass through, names beginning with an underscore and ``shard`` or ``slot``
in the input are not allowed and raise; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleaner.operators.ranking import row_index

VIRTUAL_NODES = 64
_CELL_BITS = 12
_POINT_BITS = 62


def _hash(*columns):
    """A number of 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - _POINT_BITS)


def ring(spark, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(arc, shard, point): the points in ring order. Its size is set by the parameters."""
    points = spark.range(shards * virtual_nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        # A shard has the same points however many others there are.
        _hash(F.col("id") % shards, F.expr(f"id div {shards}"), F.lit("ring")).alias("point"),
    )
    order = Window.orderBy("point", "shard")  # over the points, not over rows
    return points.withColumn("arc", F.row_number().over(order) - 1)


def _cells(points: DataFrame) -> DataFrame:
    """(cell, arcs before the cell, points inside) for equal cells of the ring."""
    spark = points.sparkSession
    placed = points.withColumn("_cell", F.shiftrightunsigned("point", _POINT_BITS - _CELL_BITS).cast("int"))
    inside = placed.groupBy("_cell").agg(F.sort_array(F.collect_list("point")).alias("_points"))
    cells = spark.range(1 << _CELL_BITS).select(F.col("id").cast("int").alias("_cell")).join(inside, "_cell", "left")
    filled = cells.withColumn("_points", F.coalesce("_points", F.array().cast("array<bigint>")))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # over the cells
    return filled.withColumn("_before", F.coalesce(F.sum(F.size("_points")).over(before), F.lit(0)))


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard may take."""
    if slack == 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil((1 + slack) * rows / shards)] * shards


def fill(arriving: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first, after, shard, slot): which of an arc's rows go where.

    ``arriving[a]`` rows begin at arc ``a``, whose point belongs to ``owners[a]``.
    """
    waiting = {a: (0, n) for a, n in enumerate(arriving) if n}
    taken = [0] * len(room)
    runs = []
    for step in range(len(owners)):
        left = {}
        for arc, (first, n) in waiting.items():
            shard = owners[(arc + step) % len(owners)]
            here = min(n, room[shard] - taken[shard])
            if here:
                runs.append((arc, first, first + here, shard, taken[shard]))
                taken[shard] += here
            if n > here:
                left[arc] = (first + here, n - here)
        waiting = left
        if not waiting:
            break
    return runs


def shard_rows(
    rows: DataFrame, shards: int, key: str = "doc_id", virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (bigint, gapless from 0 in each shard)."""
    taken = [c for c in rows.columns if c.startswith("_") or c.lower() in ("shard", "slot")]
    if taken:
        raise ValueError(f"columns {taken} stand in the way")
    spark = rows.sparkSession
    points = ring(spark, shards, virtual_nodes)
    placed = (
        rows.withColumn("_hash", _hash(key))
        .withColumn("_cell", F.shiftrightunsigned("_hash", _POINT_BITS - _CELL_BITS).cast("int"))
        # One row per cell: a fixed number.
        .join(F.broadcast(_cells(points)), "_cell")
        .withColumn("_arc", F.col("_before") + F.size(F.filter("_points", lambda p: p < F.col("_hash"))))
        .drop("_cell", "_before", "_points")
        .withColumn("_tie", F.xxhash64(*rows.columns))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    order = [F.col("_hash"), F.col(key), F.col("_tie"), F.col("_row")]
    numbered = row_index(placed, order, "_place")
    counts = {r["_arc"]: r["count"] for r in numbered.groupBy("_arc").count().collect()}
    owners = [r["shard"] for r in points.orderBy("arc").collect()]
    # Rows beyond the last point come to the first one.
    arriving = [counts.get(a, 0) for a in range(len(owners) + 1)]
    total = sum(arriving)
    begins, at = [], 0
    for n in arriving:
        begins.append(at)
        at += n
    runs = fill(arriving, owners, bounds(total, shards, slack))
    schema = T.StructType(
        [T.StructField("_to_arc", T.LongType())]
        + [T.StructField(n, T.LongType()) for n in ("_first", "_after", "_shard", "_slot")]
    )
    table = spark.createDataFrame(
        [(a, begins[a] + first, begins[a] + after, shard, slot) for a, first, after, shard, slot in runs], schema
    )
    # At most one run per arc and shard: a bound set by the parameters.
    here = (
        (F.col("_arc") == F.col("_to_arc"))
        & (F.col("_place") >= F.col("_first"))
        & (F.col("_place") < F.col("_after"))
    )
    return numbered.join(F.broadcast(table), here).select(
        *rows.columns,
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_slot") + F.col("_place") - F.col("_first")).alias("slot"),
    )
