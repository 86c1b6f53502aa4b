"""Words of whole texts inside Arrow batches, as numbers.

Words are the runs of characters other than space and the control characters 9 to 13. Their
64-bit hashes come from one running sum over the bytes of a slice, so that no Python loop runs
over words. Slices are bounded in bytes, except that one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd base modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.table = np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def running(values: np.ndarray) -> np.ndarray:
    """Sums of ``values[i] * base**i`` over prefixes, one longer than ``values``."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _UP.first(len(values)), out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges ``[start, end)``, independent of where they lie."""
    down = _DOWN.first(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Slice:
    """Some texts of a batch: row ``i`` of the slice is row ``first + i`` of the batch."""

    batch: pa.RecordBatch
    first: int
    data: np.ndarray  # bytes of the texts, one after another
    bounds: np.ndarray  # byte offsets of the texts, one more than texts
    starts: np.ndarray  # byte offsets of the words
    ends: np.ndarray
    of_text: np.ndarray  # word offsets of the texts, one more than texts

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name)).slice(
            self.first, self.texts
        )

    def hashes(self, fold: bool = False) -> np.ndarray:
        """One number per word; ``fold`` makes A-Z equal a-z."""
        sums = running((_FOLDED if fold else _BYTES)[self.data])
        return spans(sums, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.of_text)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts())


def longs(array: pa.Array, null: int) -> np.ndarray:
    return np.asarray(array.fill_null(null).to_numpy(zero_copy_only=False), np.int64)


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[Slice]:
    """The batches cut into runs of whole texts of about ``limit`` bytes; a null text has no words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).fill_null("")
        wide = pa.types.is_large_string(column.type)
        _, where, data = column.buffers()
        offsets = np.frombuffer(where, np.int64 if wide else np.int32)[
            column.offset : column.offset + len(column) + 1
        ].astype(np.int64)
        everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(column))
            yield _cut(batch, first, everything[offsets[first] : offsets[last]],
                       offsets[first : last + 1] - offsets[first])
            first = last


def _cut(batch: pa.RecordBatch, first: int, data: np.ndarray, bounds: np.ndarray) -> Slice:
    solid = ~_SPACES[data]
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.concatenate([[False], solid[:-1]])
        after = np.concatenate([solid[1:], [False]])
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return Slice(batch, first, data, bounds, starts, ends, np.searchsorted(starts, bounds))


def positions_in_text(of_text: np.ndarray) -> np.ndarray:
    """For every word its index in its own text."""
    n = int(of_text[-1])
    return np.arange(n) - np.repeat(of_text[:-1], np.diff(of_text))


def window_starts(of_text: np.ndarray, width: int) -> np.ndarray:
    """Word offsets at which ``width`` words of one text begin."""
    n = int(of_text[-1])
    left = np.repeat(of_text[1:], np.diff(of_text)) - np.arange(n)
    return np.flatnonzero(left >= width)
