"""Comparison of all vectors inside a cluster, as matrix products over pairs of row blocks.

A cluster is cut into blocks of bounded size by a hash of the id, and every pair of blocks is one
task group ("tile"). A cluster that holds a third of all rows becomes many tiles of the same size
as any other. A tile reduces what it sees before it returns: a maximum per row, a spanning forest,
counts. Pairs are only returned by the operator that is asked for them.

Blocks may be small. A cluster of more than ``FACING`` blocks sends them in bundles: a row travels once
for each bundle it faces, and a task compares all pairs of blocks of two bundles. So small blocks
do not multiply the rows that are shuffled; a bundle has as many rows as a worker may hold.

The rows of a tile never exceed two bundles, and the similarity matrix is formed in strips.

Where only similarities above a threshold matter, a strip is stopped early. The vectors are turned so
that most of their length lies in few dimensions, largest first. The product over the first
dimensions plus the product of the norms of what is left bounds a similarity from above
(Cauchy-Schwarz); pairs whose bound stays below the threshold are done, and when few are left they
are finished one by one. Nothing depends on how large a cluster is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import COMPARE_DECIMALS, COMPARE_STEP, matrix, unit_rows
from gleaner.storage import materialize

# Rows of one block. Two blocks of 768 doubles are about 100 MB in a Python worker.
BLOCK_ROWS = 8192
# Entries of the vectors of a bundle that has several blocks (50 MB of doubles), and its rows.
BUNDLE_ENTRIES = BLOCK_ROWS * 768
BUNDLE_ROWS = 4 * BLOCK_ROWS
# Blocks that a row faces one by one; from here on they come in bundles, in no fewer than this.
FACING = 16
# Entries of a similarity matrix held at one time (8 MB of doubles).
STRIP_ENTRIES = 1_000_000
# Rows on either side of a piece of a similarity matrix, where maxima and pairs are taken; fewer right
# rows where a piece would exceed a strip.
PIECE_ROWS = 512
# Bounds are taken from an eighth of the dimensions, then from half of them, if that is this many.
MIN_DIMENSIONS = 8
# The share of a strip's pairs that are finished one by one.
FEW = 0.02
# Rows from which a tile learns how to turn its vectors. Any choice gives the same result.
BASIS_ROWS = 2048
# What rounding may take from a bound, which is a sum of 32-bit products of unit vectors.
BOUND_ERROR = 1e-4


def cluster_rows(df: DataFrame, cluster: str, width: Column) -> DataFrame:
    """(cluster, _rows, _width): ``width`` is the length of a row's vector."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_rows"), F.max(width).alias("_width"))


def block_counts(sizes: DataFrame, cluster: str, block_rows: int) -> DataFrame:
    """Clusters that need more than one block, how many, and the bundles these travel in. Written
    once, so that Spark knows its size when it plans the join."""
    held = F.least(F.lit(BUNDLE_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BUNDLE_ENTRIES) / F.col("_width"))))
    blocks = sizes.select(
        cluster, F.ceil(F.col("_rows") / F.lit(block_rows)).cast("int").alias("_blocks"),
        F.ceil(F.col("_rows") / held).cast("int").alias("_fewest"),
    )
    bundles = F.least("_blocks", F.greatest(F.lit(FACING), "_fewest")).alias("_bundles")
    return materialize(blocks.filter("_blocks > 1").select(cluster, "_blocks", bundles), "blocks")


def _with_bundle(df: DataFrame, cluster: str, identity: str, blocks: DataFrame) -> DataFrame:
    counted = df.join(blocks, cluster, "left").withColumns(
        {c: F.coalesce(c, F.lit(1)) for c in ("_blocks", "_bundles")}
    )
    block = F.pmod(F.xxhash64(identity), F.col("_blocks"))
    return counted.withColumn("_bundle", F.floor(block * F.col("_bundles") / F.col("_blocks")).cast("int"))


def _spread(df: DataFrame, cluster: str) -> DataFrame:
    """One partition count for every tile job. Named explicitly, because the work of a tile grows
    with the square of its bytes and merging small partitions by size would serialise it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, cluster, "_left", "_right")


def self_tiles(
    df: DataFrame,
    cluster: str,
    identity: str,
    embedding: str,
    order: str | None,
    work: Callable[[pa.Table], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Run ``work`` on every unordered pair of blocks of every cluster.

    ``sizes`` gives the ``cluster_rows`` where they are known from narrow columns, so that
    the vectors are not read for counting. ``work`` gets the columns ``_id``, ``_order``, ``_vector``, ``_side`` (0 left, 1 right; all 0 on a diagonal
    tile) and ``_cluster``.
    """
    narrow = df.select(
        F.col(cluster).alias("_cluster"),
        F.col(identity).alias("_id"),
        (F.col(order) if order else F.lit(0.0)).cast("double").alias("_order"),
        F.col(embedding).alias("_vector"),
    )
    counted = sizes.withColumnRenamed(cluster, "_cluster") if sizes is not None else cluster_rows(narrow, "_cluster", F.size("_vector"))
    blocks = block_counts(counted, "_cluster", block_rows)
    placed = _with_bundle(narrow, "_cluster", "_id", blocks)
    tiles = _facing(placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_bundles") - 1))))
    return (
        _spread(tiles, "_cluster").groupBy("_cluster", "_left", "_right").applyInArrow(work, schema)
    )


def _facing(paired: DataFrame) -> DataFrame:
    """One row per tile a row takes part in, from its ``_bundle`` and the ``_other`` one."""
    return paired.select(
        "_cluster",
        F.least("_bundle", "_other").alias("_left"),
        F.greatest("_bundle", "_other").alias("_right"),
        F.when(F.col("_bundle") > F.col("_other"), 1).otherwise(0).alias("_side"),
        "_id",
        "_order",
        "_vector",
    )


def cross_tiles(
    left: DataFrame,
    right: DataFrame,
    work: Callable[[pa.Table], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    further: Sequence[str] = (),
) -> DataFrame:
    """Run ``work`` on every (left block, right block) of every cluster.

    Both inputs have the columns ``_cluster``, ``_id``, ``_order`` and ``_vector``, and the ``further`` ones. A
    cluster found on one side only still yields its left rows, against an empty right side.
    """
    left_blocks, right_blocks = (
        block_counts(cluster_rows(side, "_cluster", F.size("_vector")), "_cluster", block_rows) for side in (left, right)
    )

    def placed(df: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
        counts = other.select("_cluster", F.col("_bundles").alias("_facing"))
        return (
            _with_bundle(df, "_cluster", "_id", own)
            .join(counts, "_cluster", "left")
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_facing", F.lit(1)) - 1)))
        )

    columns = ["_cluster", "_left", "_right", "_side", "_id", "_order", "_vector", *further]
    lefts = placed(left, left_blocks, right_blocks).select(
        "_cluster", F.col("_bundle").alias("_left"), F.col("_other").alias("_right"),
        F.lit(0).alias("_side"), "_id", "_order", "_vector", *further,
    )
    rights = placed(right, right_blocks, left_blocks).select(
        "_cluster", F.col("_other").alias("_left"), F.col("_bundle").alias("_right"),
        F.lit(1).alias("_side"), "_id", "_order", "_vector", *further,
    )
    tiles = lefts.select(columns).union(rights.select(columns))
    return (
        _spread(tiles, "_cluster").groupBy("_cluster", "_left", "_right").applyInArrow(work, schema)
    )


# --- inside a tile --------------------------------------------------------------------------


class Tile:
    """The rows of one tile, each side sorted by (order, id)."""

    def __init__(self, table: pa.Table):
        self.cluster = table.column("_cluster")[0].as_py()
        self.diagonal = table.column("_left")[0] == table.column("_right")[0]
        side = table.column("_side").to_numpy()
        ids = table.column("_id").to_numpy()
        order = table.column("_order").to_numpy()
        vectors = matrix(table.column("_vector"))
        # Positions in the common order of both sides decide which row of a pair comes first.
        ranked = np.lexsort((ids, order))
        position = np.empty(len(ids), dtype=np.int64)
        position[ranked] = np.arange(len(ids))
        chosen = [ranked[side[ranked] == s] for s in (0, 1)]
        self.ids = [ids[c] for c in chosen]
        self.order = [order[c] for c in chosen]
        self.position = [position[c] for c in chosen]
        self.left = unit_rows(vectors[chosen[0]])
        self.right = self.left if self.diagonal else unit_rows(vectors[chosen[1]])
        if self.diagonal:
            self.ids[1], self.order[1] = self.ids[0], self.order[0]
            self.position[1] = self.position[0]

    def strips(self):
        """(start, stop, similarities) of all left rows with a strip of right rows."""
        step = max(1, STRIP_ENTRIES // max(1, len(self.left)))
        for start in range(0, len(self.right), step):
            stop = min(start + step, len(self.right))
            yield start, stop, self.left @ self.right[start:stop].T


    def pieces(self):
        """(first left, last left, first right, last right) of pieces of the similarity matrix; on a
        diagonal tile those that may hold a pair with the left row first."""
        step = _piece_columns()
        for start in range(0, len(self.right), step):
            stop = min(start + step, len(self.right))
            for a in range(0, stop if self.diagonal else len(self.left), PIECE_ROWS):
                yield a, min(a + PIECE_ROWS, len(self.left)), start, stop

    def above(self, bar: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        """(left row, right row, similarity) of the pairs above ``bar``, piece by piece. On a diagonal
        tile the left row comes first. Pairs that are not ``wanted`` when their turn comes are left out."""
        width = self.left.shape[1] if len(self.left) else 0
        shares = [n for n in (width // 8, width // 2) if n >= MIN_DIMENSIONS]
        bounds = _Bounds(self, shares[0]) if shares else None
        whole = None
        slack = max(BOUND_ERROR, _slack(width))
        for a, b, start, stop in self.pieces():
            alive = None
            while bounds is not None:
                alive = bounds.reach(a, b, start, stop) > bar - slack
                if np.count_nonzero(alive) <= FEW * alive.size:
                    break
                # What this piece needs the next ones will need too.
                shares, alive = shares[1:], None
                bounds = _Bounds(self, shares[0]) if shares else None
            if alive is None:
                if whole is None:
                    left = self.left.astype(np.float32)
                    whole = left, left if self.diagonal else self.right.astype(np.float32)
                alive = whole[0][a:b] @ whole[1][start:stop].T > bar - slack
            i, j = np.nonzero(alive)
            i, j = i + a, j + start
            if self.diagonal and b > start:
                i, j = i[i < j], j[i < j]
            if wanted is not None and len(i):
                kept = wanted(i, j)
                i, j = i[kept], j[kept]
            if len(i) > FEW * alive.size:
                exact = (self.left[a:b] @ self.right[start:stop].T)[i - a, j - start]
                hit = exact > bar
                yield i[hit], j[hit], exact[hit]
                continue
            chunk = max(1, STRIP_ENTRIES // max(1, width))
            for c in range(0, len(i), chunk):
                ic, jc = i[c : c + chunk], j[c : c + chunk]
                exact = np.einsum("ij,ij->i", self.left[ic], self.right[jc])
                hit = exact > bar
                yield ic[hit], jc[hit], exact[hit]


def _piece_columns() -> int:
    return max(1, min(PIECE_ROWS, STRIP_ENTRIES // PIECE_ROWS))


def _slack(width: int) -> float:
    """What a 32-bit product of unit vectors can be off by."""
    return (width + 8) * 2.0**-23


class _Bounds:
    """Upper bounds of similarities from the first dimensions and the norms of the rest, as one product
    of 32-bit matrices: the norms are one more column."""

    def __init__(self, tile: Tile, first: int):
        basis = _basis(tile.left, tile.right)[:, :first]
        self.left = self._columns(tile.left, basis)
        self.right = self.left if tile.diagonal else self._columns(tile.right, basis)

    @staticmethod
    def _columns(rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
        turned = rows @ basis
        rest = 1.0 - np.einsum("ij,ij->i", turned, turned)  # the rows have norm 1
        return np.column_stack([turned, np.sqrt(np.maximum(rest, 0.0))]).astype(np.float32)

    def reach(self, a: int, b: int, start: int, stop: int) -> np.ndarray:
        return self.left[a:b] @ self.right[start:stop].T


def _basis(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An orthonormal basis in which the first dimensions hold most of the rows' lengths."""
    some = [x[:: max(1, 2 * len(x) // BASIS_ROWS)] for x in (left, right)]
    return np.linalg.eigh(sum(x.T @ x for x in some))[1][:, ::-1]


def above_floor(floor: float) -> Callable[[pa.Table], pa.Table]:
    """``earlier_maxima`` for scores above ``floor``; rows without one are given the floor."""
    bar = floor - COMPARE_STEP

    def work(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        best = [np.full(len(tile.left), floor), np.full(len(tile.right), floor)]
        for i, j, sims in tile.above(bar):
            first = tile.position[0][i] < tile.position[1][j]
            np.maximum.at(best[1], j[first], sims[first])
            np.maximum.at(best[0], i[~first], sims[~first])
        if tile.diagonal:
            ids, found = tile.ids[0], best[1]
        else:
            ids, found = np.concatenate(tile.ids), np.concatenate(best)
        return pa.table({"_id": ids, "_best": np.round(found, COMPARE_DECIMALS)})

    return work


def _raise(best: np.ndarray, sims: np.ndarray, rows: np.ndarray) -> None:
    """Raise ``best`` of these rows to the highest of their similarities."""
    best[rows] = np.fmax(best[rows], np.fmax.reduce(sims, axis=1))


def _highest(
    mine: np.ndarray, theirs: np.ndarray, tops: np.ndarray, step: int, before: Callable[[np.ndarray, slice], np.ndarray]
) -> np.ndarray:
    """The highest similarity, in double and not below zero, of each row of ``mine`` to a row of ``theirs``
    that counts for it.

    ``tops`` has the 32-bit maximum of every row in every ``step`` rows of ``theirs`` (-2 without a pair). Only
    those that may hold a row's maximum are multiplied again; ``before`` says which pairs count.
    """
    best = np.zeros(len(mine))
    if not tops.size:
        return best
    bar = np.maximum(tops.max(axis=1), 0.0) - 2 * _slack(mine.shape[1])
    held = max(1, STRIP_ENTRIES // step)
    for block in range(tops.shape[1]):
        place = slice(block * step, (block + 1) * step)
        may = np.flatnonzero(tops[:, block] >= bar)
        for a in range(0, len(may), held):
            some = may[a : a + held]
            _raise(best, np.where(before(some, place), mine[some] @ theirs[place].T, 0.0), some)
    return best


def earlier_maxima(table: pa.Table) -> pa.Table:
    """For each row, its highest similarity to a row before it, and not below zero.

    Maxima of pieces are taken from products in 32 bits, and finished in double where they may be a row's
    highest. Rows are sorted, so most pieces have all their left rows before the right ones, or behind.
    """
    tile = Tile(table)
    # A vector without a direction has no similarity to any, and must not hide those of others.
    left32 = np.nan_to_num(tile.left.astype(np.float32), nan=0.0)
    right32 = left32 if tile.diagonal else np.nan_to_num(tile.right.astype(np.float32), nan=0.0)
    left_at, right_at = tile.position
    none, step = np.float32(-2), _piece_columns()
    right_tops = np.full((len(right32), -(-len(left32) // PIECE_ROWS)), none)
    left_tops = np.full((len(left32), 0 if tile.diagonal else -(-len(right32) // step)), none)
    for a, b, c, d in tile.pieces():
        sims = left32[a:b] @ right32[c:d].T
        if left_at[b - 1] < right_at[c]:
            right_tops[c:d, a // PIECE_ROWS] = sims.max(axis=0)
        elif right_at[d - 1] < left_at[a]:
            left_tops[a:b, c // step] = sims.max(axis=1)
        else:
            earlier = left_at[a:b, None] < right_at[None, c:d]
            right_tops[c:d, a // PIECE_ROWS] = np.where(earlier, sims, none).max(axis=0)
            if not tile.diagonal:
                left_tops[a:b, c // step] = np.where(earlier, none, sims).max(axis=1)
    best = _highest(
        tile.right, tile.left, right_tops, PIECE_ROWS, lambda rows, place: left_at[None, place] < right_at[rows, None]
    )
    ids = tile.ids[1]
    if not tile.diagonal:
        others = _highest(
            tile.left, tile.right, left_tops, step, lambda rows, place: right_at[None, place] < left_at[rows, None]
        )
        ids, best = np.concatenate(tile.ids), np.concatenate([others, best])
    return pa.table({"_id": ids, "_best": np.round(best, COMPARE_DECIMALS)})


def facing_maxima(table: pa.Table) -> pa.Table:
    """For each left row of a cross tile, its highest similarity to a right row (-1 if none)."""
    tile = _cross(table)
    best = np.full(len(tile.left), -1.0)
    if len(tile.right):
        for _, _, sims in tile.strips():
            np.maximum(best, sims.max(axis=1), out=best)
    return pa.table({"_id": tile.ids[0], "_best": np.round(best, COMPARE_DECIMALS)})


def facing_counts(table: pa.Table) -> pa.Table:
    """For each row of a cross tile that has an ``_order``, the rows of the other side that are ``_faced``
    and more similar to it than that."""
    tile = _cross(table)
    side, every_id = table.column("_side").to_numpy(), table.column("_id")
    ranked = table.column("_order").is_valid().to_numpy()
    faced = table.column("_faced").to_numpy()
    faced = [faced[side == s] for s in (0, 1)]
    better = [np.zeros(len(ids), np.int64) for ids in tile.ids]
    bars = [order + COMPARE_STEP for order in tile.order]
    every = [bool(f.all()) for f in faced]
    for a, b, start, stop in tile.pieces():
        sims = tile.left[a:b] @ tile.right[start:stop].T
        above = sims > bars[0][a:b, None]
        better[0][a:b] += np.count_nonzero(above if every[1] else above & faced[1][None, start:stop], axis=1)
        above = sims > bars[1][None, start:stop]
        better[1][start:stop] += np.count_nonzero(above if every[0] else above & faced[0][a:b, None], axis=0)
    parts = []
    for s in (0, 1):
        # Rows with an order have an id; others may have none.
        ids = every_id.filter(pa.array((side == s) & ranked))
        parts.append({"_side": pa.array(np.full(len(ids), s, np.int32)), "_id": ids, "_better": better[s][ranked[side == s]]})
    return pa.concat_tables([pa.table(p) for p in parts])


def _cross(table: pa.Table) -> Tile:
    tile = Tile.__new__(Tile)
    side = table.column("_side").to_numpy()
    ids = table.column("_id").to_numpy()
    order = table.column("_order").to_numpy()
    vectors = matrix(table.column("_vector"))
    tile.cluster = table.column("_cluster")[0].as_py()
    tile.diagonal = False
    tile.ids = [ids[side == s] for s in (0, 1)]
    tile.order = [order[side == s] for s in (0, 1)]
    tile.left, tile.right = (unit_rows(vectors[side == s]) for s in (0, 1))
    return tile


def pairs_above(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs with similarity above the threshold, lower id first."""
    bar = threshold + COMPARE_STEP

    def work(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        found = {"src": [], "dst": [], "sim": []}
        for i, j, sims in tile.above(bar):
            a, b = tile.ids[0][i], tile.ids[1][j]
            found["src"].append(np.minimum(a, b))
            found["dst"].append(np.maximum(a, b))
            found["sim"].append(sims)
        columns = {k: np.concatenate(v) for k, v in found.items() if v}
        if not columns:
            columns = {"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64), "sim": np.empty(0)}
        columns["sim"] = np.round(columns["sim"], COMPARE_DECIMALS)
        cluster = pa.array([tile.cluster] * len(columns["src"]), table.schema.field("_cluster").type)
        return pa.table({"cluster_id": cluster, **columns})

    return work


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest place of each part after linking ``a`` and ``b``, given that before."""
    while len(a):
        one, two = label[a], label[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def forest_above(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """A spanning forest of the tile's graph: each row of a connected part, linked to the part's
    lowest id. It joins the same rows as all pairs would, in fewer links than rows."""
    bar = threshold + COMPARE_STEP

    def work(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        ids = tile.ids[0] if tile.diagonal else np.concatenate(tile.ids)
        label = np.arange(len(ids))
        shift = 0 if tile.diagonal else len(tile.left)
        # Rows that are linked already need no further comparison.
        for i, j, _ in tile.above(bar, lambda i, j: label[i] != label[j + shift]):
            label = _joined(label, i, j + shift)
        lowest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(lowest, label, ids)
        root = lowest[label]
        linked = ids != root
        return pa.table({"src": root[linked], "dst": ids[linked]})

    return work


def profile_above(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Counts of a tile: pairs, pairs above the threshold, and the highest similarity."""
    bar = threshold + COMPARE_STEP

    def work(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        n, m = len(tile.left), len(tile.right)
        pairs = n * (n - 1) // 2 if tile.diagonal else n * m
        above, best = 0, -1.0
        for start, stop, sims in tile.strips():
            if tile.diagonal:
                counted = np.arange(n)[:, None] < np.arange(start, stop)[None, :]
                sims = np.where(counted, sims, -1.0)
            above += int((sims > bar).sum())
            best = max(best, float(sims.max(initial=-1.0)))
        cluster = pa.array([tile.cluster], table.schema.field("_cluster").type)
        return pa.table(
            {"cluster_id": cluster, "_pairs": [pairs], "_above": [above], "_best": [round(best, COMPARE_DECIMALS)]}
        )

    return work
