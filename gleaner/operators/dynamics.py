"""Scores from training histories: how uncertain a model was about a sample over the epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import COMPARE_DECIMALS
from gleaner.operators.ranking import top_fraction
from gleaner.storage import materialize

# Fixed value: uncertainty is this many times the standard deviation.
SCALE = 10


def merge_ranks(history: DataFrame) -> DataFrame:
    """(epoch, sample_id, prob): the highest probability any worker reported. Workers that did
    not see a sample report 0."""
    return history.groupBy("epoch", "sample_id").agg(F.max("prob").alias("prob"))


def _padded_std(values: Column, frame, window: int) -> Column:
    """Sample standard deviation of the frame's values padded with zeros to ``window``.

    With m values of mean a and population variance v, the padded values have the squared
    deviations m*v + m*(window-m)/window*a^2: a sum of terms that cannot cancel.
    """
    m = F.count(values).over(frame)
    deviations = m * F.var_pop(values).over(frame) + m * (window - m) / F.lit(window) * F.pow(
        F.avg(values).over(frame), 2
    )
    return F.sqrt(F.coalesce(deviations, F.lit(0.0)) / F.lit(window - 1))


def _check(window: int) -> None:
    if window < 2:
        raise ValueError("a window needs at least two epochs")


def rolling_buffer(history: DataFrame, window: int) -> DataFrame:
    """``history`` (one row per epoch and sample) with ``buffer``: the last ``window`` non-zero
    probabilities up to that epoch, oldest first, padded in front with 0. A zero leaves the buffer
    as it was."""
    _check(window)
    seen = F.col("prob") != 0
    # Both windows need rows of a sample together; the first runs over its non-zero rows only.
    together = history.repartition("sample_id").withColumn("_seen", seen)
    recent = Window.partitionBy("sample_id", "_seen").orderBy("epoch").rowsBetween(1 - window, 0)
    so_far = Window.partitionBy("sample_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.when(F.col("_seen"), F.collect_list("prob").over(recent))
    carried = F.last("_fresh", ignorenulls=True).over(so_far)
    zeros = F.array_repeat(F.lit(0.0), window)
    held = F.coalesce("_held", F.array().cast("array<double>"))
    return (
        together.withColumn("_fresh", filled)
        .withColumn("_held", carried)
        .withColumn("buffer", F.slice(F.concat(zeros, held), -window, window))
        .select(*history.columns, "buffer")
    )


def buffer_uncertainty(buffer: Column | str, window: int) -> Column:
    """10 times the sample standard deviation of a buffer."""
    values = F.col(buffer) if isinstance(buffer, str) else buffer
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.lit(window)
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return SCALE * F.sqrt(squares / F.lit(window - 1))


def window_uncertainty(history: DataFrame, window: int) -> DataFrame:
    """Rows of ``history`` with a non-zero probability, with ``uncertainty``: 10 times the sample
    standard deviation of the buffer after that epoch. It holds until the sample is seen again."""
    _check(window)
    recent = Window.partitionBy("sample_id").orderBy("epoch").rowsBetween(1 - window, 0)
    return history.filter("prob <> 0").withColumn(
        "uncertainty", SCALE * _padded_std(F.col("prob"), recent, window)
    )


def _epoch_positions(history: DataFrame) -> DataFrame:
    """(epoch, position): epochs in numeric order. One row per epoch of training."""
    return history.select("epoch").distinct().select(
        "epoch", (F.row_number().over(Window.orderBy("epoch")) - 1).alias("position")
    )


def dynamic_uncertainty(history: DataFrame, window: int, epochs: DataFrame | None = None) -> DataFrame:
    """(sample_id, dynamic_uncertainty): the mean of the buffer's uncertainty over the epochs at
    positions ``window-1`` to ``E-2``, for every sample in ``history``.

    A value holds from the epoch that set it until the next one, so each non-zero row is weighted by
    how long it held. Rows of a sample are ordered with the non-zero ones first, so that one window,
    and one shuffle by sample, serves both the buffers and the sum.
    """
    _check(window)
    positions = _epoch_positions(epochs if epochs is not None else history)
    total = positions.count()
    if total <= window:
        raise ValueError(f"{total} epochs leave nothing to average with a window of {window}")
    placed = history.filter("prob is not null").join(positions, "epoch")
    unseen = F.col("prob") == 0
    by_sample = Window.partitionBy("sample_id").orderBy(unseen, "position")
    recent = by_sample.rowsBetween(1 - window, 0)
    ends = F.coalesce(F.lead(F.when(~unseen, F.col("position"))).over(by_sample), F.lit(total)) - 1
    held = F.least(ends, F.lit(total - 2)) - F.greatest("position", F.lit(window - 1)) + 1
    part = SCALE * _padded_std(F.col("prob"), recent, window) * F.greatest(held, F.lit(0))
    return (
        placed.select("sample_id", F.when(unseen, F.lit(0.0)).otherwise(part).alias("_part"))
        .groupBy("sample_id")
        .agg(F.round(F.sum("_part") / F.lit(total - window), COMPARE_DECIMALS).alias("dynamic_uncertainty"))
    )


def prune_by_uncertainty(
    file_list: DataFrame, history: DataFrame, window: int, fraction: float
) -> DataFrame:
    """Rows of the file list with the highest uncertainty, ``int(n * fraction)`` of them, in the
    original order. Samples without a history count as never uncertain."""
    # Written once, so that the cut and the comparison with it see the same numbers.
    scores = materialize(dynamic_uncertainty(history, window), "uncertainty")
    scored = file_list.join(scores, "sample_id", "left").withColumn(
        "dynamic_uncertainty", F.coalesce("dynamic_uncertainty", F.lit(0.0))
    )
    return top_fraction(scored, "dynamic_uncertainty", "sample_id", fraction).orderBy("sample_id")
