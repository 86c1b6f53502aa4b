"""Seeded samples of rows, files and shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.keys import seeded_hash, seeded_uniform
from gleaner.operators.joins import range_lookup
from gleaner.operators.ranking import rank_in_group, running_total
from gleaner.storage import materialize


def sample_files(files: DataFrame, name: str, count: int, seed: int, epoch: int) -> DataFrame:
    """``count`` files without replacement; another set in each epoch."""
    hashed = files.select(name).distinct().withColumn("_hash", seeded_hash(name, seed, epoch))
    return hashed.orderBy("_hash", name).limit(count).select(name)


def per_class_cap(df: DataFrame, label: str, identity: str, k: int, seed: int) -> DataFrame:
    """Up to ``k`` random rows of every class, a null class included.

    Only class, hash and id are laid out in order and numbered, by range, so a class with most of the
    rows is spread over tasks whatever ``k`` is.
    """
    hashed = df.select(label, identity, seeded_hash(identity, seed).alias("_hash"))
    ranked = rank_in_group(hashed, [F.col("_hash"), F.col(identity)], [label], "_rank")
    return df.join(ranked.filter(F.col("_rank") <= k).select(identity), identity, "left_semi")


def resample_weighted(
    shards: DataFrame, url: str, draws: int, seed: int, epoch: int, weight: str | None = None
) -> DataFrame:
    """``draws`` shards with replacement, in proportion to ``weight`` (equal if none is given).

    Returns ``draw`` (0-based) and the shard's ``url``.
    """
    weighed = shards.select(
        url, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_weight")
    ).filter(F.col("_weight") > 0)
    ends = running_total(weighed, [F.col(url)], "_weight", "_end")
    total, count = ends.agg(F.max("_end"), F.count(F.lit(1))).first()
    intervals = ends.select(
        url, (F.col("_end") - F.col("_weight")).alias("_start"), F.col("_end")
    )
    points = shards.sparkSession.range(draws).select(
        F.col("id").alias("draw"),
        (seeded_uniform("id", seed, epoch) * F.lit(total)).alias("_point"),
    )
    return range_lookup(points, "_point", intervals, "_start", "_end", total / count).select(
        "draw", url
    )


def shuffle_deterministic(df: DataFrame, identity: str, seed: int, epoch: int) -> DataFrame:
    """A full shuffle, the same for the same seed and epoch. Adds ``shuffle_key``, the order."""
    hashed = df.withColumn("shuffle_key", seeded_hash(identity, seed + epoch))
    return hashed.orderBy("shuffle_key", identity)


# --- shuffles without a sort -----------------------------------------------------------------

_PRIME = (1 << 31) - 1
ROUNDS = 4
# Steps of a walk at most. Walks are through the numbers beyond the last row: there are at most
# 2 * sqrt(rows) + 1 of them, and a step meets one with a chance of 2 / sqrt(rows).
WALK = 64


def round_constants(seed: int, epoch: int) -> list[tuple[int, int]]:
    """(factor, summand) of each round, below the prime."""
    digests = [hashlib.md5(f"{seed}/{epoch}/{i}".encode()).hexdigest() for i in range(ROUNDS)]
    return [(int(d[:8], 16) % (_PRIME - 1) + 1, int(d[8:16], 16) % _PRIME) for d in digests]


def permuted(row: Column, rows: int, seed: int, epoch: int) -> Column:
    """The place of row number ``row`` (0 to ``rows - 1``) in a shuffle: a bijection, by arithmetic alone.

    A number is written as (low, high) with low < a and high < b, where a * b is just above ``rows``.
    Rounds add a keyed function of one part to the other, in turn, which can always be undone. A
    result beyond the last row is put in again until it is not.
    """
    if not 0 <= rows < 1 << 60:
        raise ValueError("need 0 <= rows < 2**60")
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    b = max(1, -(-rows // a))
    constants = round_constants(seed, epoch)

    def mixed(x: Column, i: int) -> Column:
        factor, summand = (F.lit(c).cast("bigint") for c in constants[i])
        return (((x % _PRIME) * (x % _PRIME)) % _PRIME * factor + summand) % _PRIME

    def once(x: Column) -> Column:
        high = F.call_function("div", x, F.lit(a).cast("bigint"))
        parts = F.struct((x % a).cast("bigint").alias("l"), high.alias("h"))
        steps = F.array(*[F.lit(i) for i in range(ROUNDS)])
        for_each = F.aggregate(steps, parts, lambda p, i: _round(p, i))
        return for_each["l"] + for_each["h"] * a

    def _round(p: Column, i: Column) -> Column:
        change = [F.when(i == j, mixed(p["h"] if j % 2 == 0 else p["l"], j)) for j in range(ROUNDS)]
        low = F.when(i % 2 == 0, (p["l"] + F.coalesce(*change[0::2])) % a).otherwise(p["l"])
        high = F.when(i % 2 == 1, (p["h"] + F.coalesce(*change[1::2])) % b).otherwise(p["h"])
        return F.struct(low.cast("bigint").alias("l"), high.cast("bigint").alias("h"))

    first = once(row.cast("bigint"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < rows, x).otherwise(once(x)))
    lost = F.raise_error(F.lit("a row number is outside the table")).cast("bigint")
    return F.when(first < rows, first).when(walk < rows, walk).otherwise(lost)


def shuffle_rows(df: DataFrame, row: str, rows: int, seed: int, epoch: int, name: str = "position") -> DataFrame:
    """``df`` with every row's position in the shuffle of an epoch, from its dense number ``row``.

    A projection: nothing is sorted or moved. Readers of shard ``i`` take the positions that belong to
    it. The same seed and epoch give the same order.
    """
    return df.withColumn(name, permuted(F.col(row), rows, seed, epoch))


# --- draws as counts -------------------------------------------------------------------------

DRAW_PARTS = 1 << 14


def _split(draws: int, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of ``draws`` fall on each weight: halves by a binomial draw, then halves of those."""
    width = 1 << max(0, math.ceil(math.log2(max(1, len(weights)))))
    levels = [np.concatenate([weights, np.zeros(width - len(weights))])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    counts = np.array([draws], np.int64)
    for sums, below in zip(levels[:0:-1], levels[-2::-1], strict=True):
        share = np.divide(below[0::2], sums, out=np.zeros(len(sums)), where=sums > 0)
        left = rng.binomial(counts, np.minimum(share, 1.0))
        # Nothing falls on a half without weight.
        left = np.where(below[1::2] > 0, left, counts)
        counts = np.stack([left, counts - left], axis=1).ravel()
    return counts[: len(weights)]


def resample_counts(
    shards: DataFrame, url: str, draws: int, seed: int, epoch: int, weight: str | None = None, parts: int = DRAW_PARTS
) -> DataFrame:
    """(url, n_draws): how often each shard is drawn in ``draws`` draws with replacement, in proportion to
    ``weight`` (equal if none is given); shards without a draw are left out.

    The counts have the multinomial distribution that as many single draws would have, but the work
    grows with the shards alone. Shards are put into ``parts`` by a hash; the draws are split over the
    parts' weights, one number each, and inside a part over its shards in name order. The same
    arguments give the same counts however Spark divides the work. Names must be unique.
    """
    weighed = shards.select(F.col(url).cast("string").alias("url"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    weighed = weighed.filter(F.col("w") > 0).withColumn("part", (seeded_hash("url", "part") % parts).cast("int"))
    laid = materialize(weighed, "weights")
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = laid.repartition(n, "part").sortWithinPartitions("part", "url")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
        at, names, weights = None, [], []
        for batch in batches:
            for name, w, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != at and names:
                    yield at, names, weights
                    names, weights = [], []
                at = part
                names.append(name)
                weights.append(w)
        if names:
            yield at, names, weights

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(at, math.fsum(weights)) for at, _, weights in groups(batches)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found])], ["part", "w"])

    sums = np.zeros(parts)
    for r in dealt.mapInArrow(totals, "part int, w double").collect():  # one row per part
        sums[r["part"]] = r["w"]
    if draws and not sums.any():
        raise ValueError("no shard has a weight")
    counts = _split(draws, sums, np.random.default_rng([seed, epoch]))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, names, weights in groups(batches):
            drawn = _split(int(counts[at]), np.array(weights), np.random.default_rng([seed, epoch, at]))
            some = np.flatnonzero(drawn)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array(drawn[some])], [url, "n_draws"])

    return dealt.mapInArrow(shares, f"`{url}` string, n_draws bigint")
