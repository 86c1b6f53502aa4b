"""Row positions, ranks and rank bands without a one-partition window.

Two tools carry this module.

*Positions*: rows are laid out by range partitioning, numbered inside each partition, and written
once. A table with one row per (partition, group) then holds what to add. No task sees more than
one range partition, however large a group is.

*Cuts*: a band or a top fraction needs only the rows at its two ends. They are found by a few
aggregations that narrow an interval of values, after which the selection is a plain filter: the
selected rows are never sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.keys import seeded_hash
from gleaner.storage import materialize

# An interval with no more rows than this is finished on the driver. It is a fixed bound, reached
# by narrowing; it does not grow with the data.
CUT_ROWS = 20000
# Intervals tried per narrowing step.
CUT_SPLITS = 64


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _lay_out(df: DataFrame, order: list[Column], group: list[str]) -> DataFrame:
    keys = [F.col(g).asc() for g in group] + order
    placed = (
        df.repartitionByRange(_shuffle_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return materialize(placed, "order").withColumn("_part", F.shiftright("_place", 33))


def rank_in_group(
    df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rank"
) -> DataFrame:
    """``df`` with the 1-based rank of each row in its group.

    ``order`` must end in a unique column. Keep ``df`` narrow: it is shuffled and written once.
    """
    group = group or []
    laid = _lay_out(df, order, group)
    parts = laid.groupBy("_part", *group).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per partition and group, so this window sees few rows.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    shifts = materialize(
        parts.select(
            F.col("_part").alias("_at"),
            *[F.col(g).alias(f"_group_{i}") for i, g in enumerate(group)],
            (before - F.col("_first")).alias("_shift"),
        ),
        "shifts",
    )
    # Null is a group like any other.
    same = F.col("_part") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{i}"))
    return laid.join(shifts, same).select(
        *df.columns, (F.col("_place") + F.col("_shift") + 1).alias(name)
    )


def row_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """``df`` with a dense 0-based position in the given order."""
    ranked = rank_in_group(df, order, name=name)
    return ranked.withColumn(name, F.col(name) - 1)


def running_total(
    df: DataFrame, order: list[Column], value: str, name: str = "running"
) -> DataFrame:
    """``df`` with the running sum of ``value`` over the whole table in the given order."""
    laid = _lay_out(df, order, [])
    inside = Window.partitionBy("_part").orderBy("_place")
    parts = laid.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    shifts = materialize(
        parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift")),
        "shifts",
    )
    return (
        laid.withColumn("_inside", F.sum(value).over(inside))
        .join(shifts, "_part")
        .select(*df.columns, (F.col("_inside") + F.col("_shift")).alias(name))
    )


# --- cuts -----------------------------------------------------------------------------------


def _interval_of(value: Column, splits: list) -> Column:
    """Index of the largest split not above ``value``, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(value < F.lit(splits[mid]), tree(lo, mid - 1)).otherwise(tree(mid, hi))

    return tree(0, len(splits) - 1)


@dataclass(frozen=True)
class _Shape:
    """What one aggregation tells about the values under search."""

    rows: int
    splits: tuple


@dataclass(frozen=True)
class Cut:
    """The row at one rank of a table ordered by (score desc, id desc)."""

    score: object
    identity: object

    def at_or_above(self, score: str, identity: str) -> Column:
        return (F.col(score) > F.lit(self.score)) | (
            (F.col(score) == F.lit(self.score)) & (F.col(identity) >= F.lit(self.identity))
        )


def _shape(rows: DataFrame) -> _Shape:
    fractions = [i / CUT_SPLITS for i in range(1, CUT_SPLITS)]
    found = rows.agg(
        F.count("s").alias("n"),
        F.min("s").alias("low"),
        F.max("s").alias("high"),
        F.percentile_approx("s", fractions, 1000).alias("quantiles"),
    ).first()
    if not found["n"]:
        return _Shape(0, ())
    return _Shape(found["n"], tuple(sorted({found["low"], *found["quantiles"], found["high"]})))


def _slot_counts(rows: DataFrame, splits: tuple) -> dict:
    """Rows on each split and strictly between it and the next."""
    slotted = rows.select("s", _interval_of(F.col("s"), splits).alias("slot"))
    on_split = F.get(F.array(*[F.lit(v) for v in splits]), F.col("slot"))
    grouped = slotted.groupBy("slot", (F.col("s") == on_split).alias("exact")).count()
    return {(r["slot"], r["exact"]): r["count"] for r in grouped.collect()}  # two per split


def _locate(counts: dict, splits: tuple, rank: int) -> tuple[int, bool, int]:
    """(slot, on the split itself, rows above) of a descending rank."""
    above = 0
    for slot in range(len(splits) - 1, -1, -1):
        for exact in (False, True):
            here = counts.get((slot, exact), 0)
            if rank <= above + here:
                return slot, exact, above
            above += here
    raise ValueError(f"rank {rank} is outside the table")


def _search(rows: DataFrame, rank: int, shape: _Shape, counts: dict | None = None) -> Cut:
    """The row (s, i) at a descending rank.

    Exact. Each step takes approximate quantiles as split points, counts the rows on and between
    them in one aggregation, and goes on in the one interval that holds the rank. A value held by
    many rows soon becomes a split point itself; the search then goes on among the ids.
    """
    while shape.rows > CUT_ROWS:
        splits = shape.splits
        counts = counts or _slot_counts(rows, splits)
        slot, exact, above = _locate(counts, splits, rank)
        here = counts[(slot, exact)]
        counts = None
        rank -= above
        if exact:
            value = splits[slot]
            tied = rows.filter(F.col("s") == F.lit(value))
            ids = tied.select(F.col("i").alias("s"), "i")
            if here <= CUT_ROWS:
                return Cut(value, _search(ids, rank, _Shape(here, ())).identity)
            among = _shape(ids)
            if among.splits[0] == among.splits[-1]:  # rows that share the id as well
                return Cut(value, among.splits[0])
            return Cut(value, _search(ids, rank, among).identity)
        rows = rows.filter((F.col("s") > F.lit(splits[slot])) & (F.col("s") < F.lit(splits[slot + 1])))
        shape = _Shape(here, ()) if here <= CUT_ROWS else _shape(rows)
    ordered = sorted(((r["s"], r["i"]) for r in rows.collect()), reverse=True)
    if not 1 <= rank <= len(ordered):
        raise ValueError(f"rank {rank} is outside the table")
    return Cut(*ordered[rank - 1])


def _given(df: DataFrame, score: str) -> Column:
    """The score; a null has no rank and raises, since leaving it out would shift all fractions."""
    missing = F.raise_error(F.lit(f"{score} is null; fill or filter it before ranking"))
    return F.coalesce(F.col(score), missing.cast(df.schema[score].dataType))


def find_cuts(
    df: DataFrame, score: str, identity: str, ranks: Callable[[int], list[int]]
) -> tuple[int, list[Cut | None]]:
    """The number of rows and the rows at the ranks that ``ranks`` names for that number.

    A rank of 0 or of the last row needs no cut and yields None.
    """
    rows = df.select(_given(df, score).alias("s"), F.col(identity).alias("i"))
    shape = _shape(rows)
    wanted = ranks(shape.rows)
    open_ranks = [r for r in wanted if 0 < r < shape.rows]
    counts = _slot_counts(rows, shape.splits) if open_ranks and shape.rows > CUT_ROWS else None
    cuts = [
        _search(rows, r, shape, counts) if 0 < r < shape.rows else None for r in wanted
    ]
    return shape.rows, cuts


def kth_largest(df: DataFrame, column: str, rank: int):
    """The value at a 1-based descending rank."""
    rows = df.select(_given(df, column).alias("s"), F.lit(0).alias("i"))
    return _search(rows, rank, _shape(rows)).score


def _between_ranks(
    df: DataFrame, score: str, identity: str, ends: Callable[[int], tuple[int, int]]
) -> DataFrame:
    """Rows with ``after < rank <= through`` by (score desc, id desc)."""
    total, (lower, upper) = find_cuts(df, score, identity, lambda n: list(ends(n)))
    after, through = ends(total)
    if through <= after:
        return df.filter(F.lit(False))
    kept = df
    if upper is not None:
        kept = kept.filter(upper.at_or_above(score, identity))
    if lower is not None:
        kept = kept.filter(~lower.at_or_above(score, identity))
    return kept


def rank_band(
    df: DataFrame, score: str, identity: str, low: float, high: float, mode: str = "exact"
) -> DataFrame:
    """Rows whose descending rank by ``score`` lies between two fractions of the table.

    ``exact`` keeps ``floor(low*n) < rank <= floor(high*n)``. ``reference`` keeps
    ``int(low*n + 1) < rank <= int(high*n)``, the off-by-one of the published coresets.
    Equal scores rank by higher id first. A null score raises. The score must be the same each time
    it is computed: write sums of floating numbers first.
    """
    if not 0 <= low <= high <= 1:
        raise ValueError("need 0 <= low <= high <= 1")
    if mode not in ("exact", "reference"):
        raise ValueError(f"unknown mode {mode!r}")

    def ends(n: int) -> tuple[int, int]:
        through = int(high * n)
        if mode == "exact":
            return int(low * n), through
        if through < 1:
            raise ValueError("the reference formula needs int(high*n) >= 1")
        return min(int(low * n + 1), n), through

    return _between_ranks(df, score, identity, ends)


def chained_bands(
    df: DataFrame, identity: str, bands: list[tuple[str, float, float]], mode: str = "exact"
) -> DataFrame:
    """Bands applied one after another; each ranks the survivors of the one before."""
    for score, low, high in bands:
        df = rank_band(df, score, identity, low, high, mode)
    return df


def top_fraction(df: DataFrame, score: str, identity: str, fraction: float) -> DataFrame:
    """The ``int(n * fraction)`` rows with the highest score; none when that is zero."""
    return _between_ranks(df, score, identity, lambda n: (0, min(int(n * fraction), n)))


def random_fraction(df: DataFrame, identity: str, fraction: float, seed: int) -> DataFrame:
    """Exactly ``int(n * fraction)`` rows, chosen by a seeded hash of the id."""
    hashed = df.withColumn("_hash", seeded_hash(identity, seed))
    return top_fraction(hashed, "_hash", identity, fraction).drop("_hash")


# --- splits ---------------------------------------------------------------------------------


def split_by_worker(df: DataFrame, order: list[Column], workers: int, name: str = "worker"):
    """Rows dealt to workers in turn."""
    return row_index(df, order, "_row").withColumn(name, F.col("_row") % workers).drop("_row")


def contiguous_split(
    df: DataFrame, order: list[Column], parts: int, drop_tail: bool = False, name: str = "part"
) -> DataFrame:
    """Contiguous ranges of rows: ``[i*N//parts, (i+1)*N//parts)``, or, with ``drop_tail``, ranges
    of ``N//parts`` rows and the remainder left out."""
    indexed = row_index(df, order, "_row")
    total = df.count()
    if drop_tail:
        size = total // parts
        if size == 0:
            return indexed.withColumn(name, F.lit(0).cast("bigint")).drop("_row").filter(F.lit(False))
        placed = indexed.withColumn(name, F.expr(f"_row div {size}"))
        return placed.filter(F.col(name) < parts).drop("_row")
    return indexed.withColumn(name, F.expr(f"((_row + 1) * {parts} - 1) div {max(total, 1)}")).drop("_row")


def even_splits(df: DataFrame, order: list[Column], parts: int, name: str = "part") -> DataFrame:
    """Ranges with bounds ``round(i*N/parts)``, halves to the even number."""
    indexed = row_index(df, order, "_row")
    total = max(df.count(), 1)
    # The last range that starts at or before row r is the largest i with i*N/parts <= r + 1/2,
    # where the tie counts only for even r (a half rounds down to it).
    reach = f"(2 * _row + 1) * {parts}"
    tie_up = F.expr(f"({reach}) % {2 * total} = 0 and _row % 2 = 1")
    return indexed.withColumn(
        name, F.expr(f"({reach}) div {2 * total}") - F.when(tie_up, 1).otherwise(0)
    ).drop("_row")
