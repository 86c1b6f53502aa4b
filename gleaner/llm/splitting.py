"""Words of a slice by another alphabet than that of ``words``."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from gleaner.llm.words import Slice


def alphabet(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true for the bytes in the closed ranges."""
    inside = np.zeros(256, bool)
    for low, high in ranges:
        inside[low : high + 1] = True
    return inside


def resplit(s: Slice, inside: np.ndarray) -> Slice:
    """The slice with the runs of ``inside`` bytes of each text as its words."""
    edge = np.zeros(len(s.data) + 1, bool)
    edge[s.bounds] = True
    solid = inside[s.data]
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return replace(s, starts=starts, ends=ends, of_text=np.searchsorted(starts, s.bounds))


def folded(s: Slice, word: int) -> bytes:
    """A word's bytes with A-Z as a-z."""
    return s.data[s.starts[word] : s.ends[word]].tobytes().lower()  # bytes.lower() knows ASCII only
