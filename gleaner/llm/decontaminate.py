"""Benchmark decontamination by pigeonhole runs of words and exact edit distance.

An item of ``n`` words may be met with up to ``k = int(RATE * n)`` edits. It is cut into ``k + 1``
pieces of nearly equal length; every edit spoils at most one of them, so a stretch of a document
that is near enough holds at least one piece word for word, at most ``k`` words from where it lies
in the item. Each run of a document that equals a piece therefore names a window that holds the
whole stretch, and no stretch is without such a window: recall is 1 at every length and every
allowed number of edits.

Windows with fewer than ``n - k`` words that occur in the item at all cannot hold it. What is left
is confirmed: the item against the window, by exact edit distance in words, with the ends in the
document free. Reported is the stretch with the fewest edits, of those the one that ends first, of
those the shortest.

Items are read in blocks of bounded bytes; each block is one pass over the documents.

Defined cases: a null or empty text holds no item; items of fewer than ``MIN_WORDS`` words, null
ones included, prove nothing and are left out; A-Z counts as a-z; equal items are all reported;
ids may be null or repeat; further columns are ignored by ``search`` and pass through ``clean``; with
no documents or no items nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import Slice, mix, slices, window_starts

MIN_WORDS = 5
RATE = 0.2  # edits allowed per word of the item
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 21  # words of windows that are looked at together
_FILTER_BITS = 22


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One number for every run of ``width`` words, by where it begins."""
    n = max(len(words) - width + 1, 0)
    seen = np.zeros(n, np.uint64)
    for i in range(width):
        seen = (seen ^ words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        seen ^= seen >> np.uint64(29)
    return seen


def pieces(n: int) -> list[tuple[int, int]]:
    """(offset, words) of the pieces of an item of ``n`` words, one more than it may have edits."""
    cuts = [n * i // (int(RATE * n) + 1) for i in range(int(RATE * n) + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose sizes add up to about ``CHUNK``, one row at least."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + CHUNK, "right")), first + 1)
        yield slice(first, last)
        first = last


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(distance, end): the fewest edits from ``item`` to a stretch of ``text``, and where it ends."""
    columns = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item):
        step = np.empty_like(row)
        step[0] = i + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(step - columns) + columns
    end = int(np.argmin(row))
    return int(row[end]), end


def stretches(items: np.ndarray, text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The fewest edits from an item to a stretch of its window, for windows laid one after another.

    Window ``i`` is ``text[edges[i]:edges[i + 1]]``, and row ``i`` of ``items`` is its item; all items
    have one length.
    """
    n = items.shape[1]
    sizes = np.diff(edges)
    # Between windows lie more blanks than an item has words, and no edit distance crosses them.
    shift = np.arange(len(sizes)) * (n + 1)
    row = np.zeros(len(text) + (n + 1) * len(sizes) + 1, np.int64)
    place = flat(edges[:-1] + shift, sizes)
    columns = np.arange(len(row))
    differs = np.ones(len(row) - 1, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(n):
        differs[place] = text != items[of, i]
        step = np.empty_like(row)
        step[0] = i + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + differs)
        row = np.minimum.accumulate(step - columns) + columns
    return np.minimum.reduceat(row[1:][place], edges[:-1])


class Items:
    """A block of items, ready to be looked up by their pieces."""

    def __init__(self, rows: list[tuple[object, np.ndarray]]):
        self.rows = [(i, w) for i, w in rows if len(w) >= MIN_WORDS]
        self.sizes = np.array([len(w) for _, w in self.rows], np.int64)
        self.most = np.array([int(RATE * n) for n in self.sizes], np.int64)
        made: dict[int, list[tuple[np.uint64, int, int]]] = {}
        for n, (_, w) in enumerate(self.rows):
            for offset, width in pieces(len(w)):
                made.setdefault(width, []).append((run_hashes(w[offset : offset + width], width)[0], n, offset))
        self.tables = []
        for width, got in sorted(made.items()):
            keys, of, offset = (np.array(x) for x in zip(*got, strict=True))
            order = np.argsort(keys, kind="stable")
            self.tables.append((width, keys[order], of[order], offset[order], self._filter(keys)))
        words = np.concatenate([self._of_item(w, np.full(len(w), n)) for n, (_, w) in enumerate(self.rows)] or [np.zeros(0, np.uint64)])
        self.words = np.unique(words)
        self.maybe = self._filter(self.words)

    @staticmethod
    def _of_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
        """One number for every word in an item."""
        return mix(words ^ mix(item.astype(np.uint64) + np.uint64(1)))

    @staticmethod
    def _filter(keys: np.ndarray) -> np.ndarray:
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True
        return maybe

    def find(self, s: Slice) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, words, distance): the best stretch per row and item, starts in words."""
        words = s.hashes(fold=True)
        texts = s.text_of_word()
        left = [np.zeros((3, 0), np.int64)]
        for width, keys, of, offset, maybe in self.tables:
            at = window_starts(s.of_text, width)
            seen = run_hashes(words, width)[at]
            some = maybe[seen >> np.uint64(64 - _FILTER_BITS)]
            at, seen = at[some], seen[some]
            low, high = np.searchsorted(keys, seen, "left"), np.searchsorted(keys, seen, "right")
            for part in chunks(high - low):
                k = flat(low[part], (high - low)[part])
                begin = np.repeat(at[part], (high - low)[part])
                left.append(self._possible(s, words, texts[begin], of[k], begin - offset[k]))
        return self._confirm(s, words, np.unique(np.concatenate(left, axis=1), axis=1))

    def _window(self, s: Slice, t: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The window of an item that lies at ``start`` but for its edits."""
        return (
            np.maximum(start - self.most[n], s.of_text[t]),
            np.minimum(start + self.sizes[n] + self.most[n], s.of_text[t + 1]),
        )

    def _possible(self, s: Slice, words: np.ndarray, t: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(text, item, start) of the places whose windows hold enough of the item's words."""
        if not len(t):
            return np.zeros((3, 0), np.int64)
        t, n, start = np.unique(np.stack([t, n, start]), axis=1)
        kept = []
        low, high = self._window(s, t, n, start)
        for part in chunks(high - low):
            size = (high - low)[part]
            keys = self._of_item(words[flat(low[part], size)], np.repeat(n[part], size))
            held = self.maybe[keys >> np.uint64(64 - _FILTER_BITS)]
            at = np.minimum(np.searchsorted(self.words, keys[held]), len(self.words) - 1)
            held[held] = self.words[at] == keys[held]
            count = np.add.reduceat(held.astype(np.int64), np.cumsum(size) - size)
            kept.append(count >= (self.sizes - self.most)[n[part]])
        return np.stack([t, n, start])[:, np.concatenate(kept)]

    def _confirm(self, s: Slice, words: np.ndarray, places: np.ndarray):
        t, n, start = places
        if not len(t):
            return []
        low, high = self._window(s, t, n, start)
        # Windows of one text and item that overlap are one. They are in order, and of one length but for the text's ends.
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (low[1:] > high[:-1])])
        first = np.flatnonzero(new)
        t, n, low, high = t[first], n[first], low[first], np.maximum.reduceat(high, first)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for size in np.unique(self.sizes[n]):
            mine = np.flatnonzero(self.sizes[n] == size)
            for part in chunks((high - low)[mine]):
                own = mine[part]
                edges = np.concatenate([[0], np.cumsum((high - low)[own])])
                text = words[flat(low[own], (high - low)[own])]
                used, row = np.unique(n[own], return_inverse=True)
                least = stretches(np.stack([self.rows[i][1] for i in used])[row], text, edges)
                for k in own[least <= self.most[n[own]]].tolist():
                    item = self.rows[n[k]][1]
                    distance, end = edit_distance(item, words[low[k] : high[k]])
                    _, back = edit_distance(item[::-1], words[low[k] : low[k] + end][::-1])
                    row_item = int(t[k]), int(n[k])
                    found = (distance, int(low[k] - s.of_text[t[k]]) + end, back)
                    if row_item not in best or found < best[row_item]:
                        best[row_item] = found
        return [(t, n, end - size, size, distance) for (t, n), (distance, end, size) in sorted(best.items())]


def _blocks(items: DataFrame, identity: str, text: str) -> Iterator[Items]:
    """The items in blocks whose texts have about ``BLOCK_BYTES`` bytes together."""
    narrow = items.select(F.col(identity).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for block in range(blocks):
        mine = narrow.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).toArrow()
        rows = []
        for s in slices(iter(mine.to_batches())):
            hashes, ids = s.hashes(fold=True), s.column("id").to_pylist()
            rows += [(i, hashes[a:b]) for i, a, b in zip(ids, s.of_text[:-1], s.of_text[1:], strict=True)]
        yield Items(sorted(rows, key=lambda r: (r[0] is None, r[0])))


def search(
    docs: DataFrame,
    items: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(identity, item, start_word, n_words, distance) for every document and item it holds."""
    kinds = docs.schema[identity].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{identity}` {kinds[0]}, `{item_id}` {kinds[1]}, start_word bigint, n_words bigint, distance bigint"
    narrow = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    found = None
    for block in _blocks(items, item_id, item_text):
        part = narrow.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(block)), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _searcher(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        item_type = pa.array([i for i, _ in items.rows]).type if items.rows else pa.int64()
        for s in slices(batches):
            hits = items.find(s)
            if hits:
                rows, ns, starts, sizes, distances = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        s.column("id").take(pa.array(rows)),
                        pa.array([items.rows[n][0] for n in ns], item_type),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(distances, pa.int64()),
                    ],
                    ["id", "item", "start_word", "n_words", "distance"],
                )

    return run


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows pass through, so no join and no shuffle is needed."""

    def dropper(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, text):
                keep = np.ones(s.texts, bool)
                keep[[row for row, *_ in block.value.find(s)]] = False
                yield s.batch.slice(s.first, s.texts).filter(pa.array(keep))

        return run

    schema = docs.schema
    for block in _blocks(items, item_id, item_text):
        docs = docs.mapInArrow(dropper(docs.sparkSession.sparkContext.broadcast(block)), schema)
    return docs
