"""Functions of model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def target_probability(logits: Column | str, label: Column | str) -> Column:
    """Softmax probability of the label's entry, shifted by the maximum so it cannot overflow."""
    values = _column(logits).cast("array<double>")
    peak = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - peak))
    return F.exp(F.get(values, _column(label)) - peak) / total


def select_classes(logits: Column | str, positions: list[int] | Column) -> Column:
    """Entries of ``logits`` at the given positions, in that order."""
    index = (
        F.array(*[F.lit(int(p)) for p in positions]) if isinstance(positions, list) else positions
    )
    return F.transform(index, lambda i: F.get(_column(logits), i))


def top_classes(logits: Column | str, k: int) -> Column:
    """Positions of the ``k`` largest logits, best first; equal logits by lower position."""
    scored = F.transform(
        _column(logits), lambda x, i: F.struct((-x.cast("double")).alias("cost"), i.alias("position"))
    )
    return F.transform(F.slice(F.array_sort(scored), 1, k), lambda s: s["position"])


def any_in_labels(ranked: Column | str, labels: Column | str, k: int) -> Column:
    """Whether one of the first ``k`` predicted classes is among the accepted labels."""
    return F.arrays_overlap(F.slice(_column(ranked), 1, k), _column(labels))
