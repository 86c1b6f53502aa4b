"""Exact removal of repeated word windows behind a count-min prefilter.

Every window of ``width`` words is hashed. First, tasks count the windows of their partition in a
sketch whose counters stop at two; it is so wide that a partition touches few counters, so it is
sent as a list of those, cut into blocks by hash. The blocks of all partitions are merged by adding
counters. What is left of the merged sketch is its rows of bits "at least two", of a fixed size:
a window is estimated as repeated if its counter says so in every row, the minimum of the rows.
Estimates are never too low, so no repeated window is lost.

The second pass looks only at windows estimated as repeated. Tasks keep the first of equal windows
in their own partition, mark the others, and send one row per window on; equal windows then meet
under a 96-bit key, and all but the first are marked. A window that fills a third of the table is
thus at most one row per task when it is shuffled.

Marks are gathered per document and the words they cover are taken out.

Defined cases: a null or empty text has no words; a null id comes before every other; rows that
share an id are one document in the order, compared by start and then by a checksum of the text, and
equal rows count as one; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import Slice, longs, mix, positions_in_text, running, slices, spans, window_starts

WIDTH = 20
# Counters of the sketch: 2 ** (BLOCK_BITS + 8 * OFFSET_BYTES). One more byte per counter holds
# 256 times the corpus.
BLOCK_BITS = 12
OFFSET_BYTES = 3
# Bits of a block that the merged sketch keeps, per row; 2 rows of 2 ** 27 bits, 32 MB in all.
ROW_BITS = 15
ROWS = 2
# Windows that a task holds before it passes them on.
HELD = 1_000_000
_NULL = -(1 << 63)


def window_hashes(s: Slice, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first key, second key, word offset) of every window in the slice."""
    words = s.hashes()
    at = window_starts(s.of_text, width)
    one = spans(running(words), at, at + width)
    two = spans(running(mix(words ^ np.uint64(0xA0761D6478BD642F))), at, at + width)
    return one, (two >> np.uint64(32)).astype(np.uint32), at


def _counter(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - BLOCK_BITS - 8 * OFFSET_BYTES)


def _bits(counters: np.ndarray) -> list[np.ndarray]:
    """Where each row of the merged sketch has the counter, inside its block."""
    offset = counters & np.uint64((1 << (8 * OFFSET_BYTES)) - 1)
    mask = np.uint64((1 << ROW_BITS) - 1)
    spread = mix(offset + np.uint64(1))
    return [offset >> np.uint64(8 * OFFSET_BYTES - ROW_BITS), spread & mask]


def _packed(keys: list[np.ndarray]) -> pa.RecordBatch:
    """The partial sketch over some windows: its touched counters per block, twice for two or more."""
    touched, times = np.unique(_counter(np.concatenate(keys)), return_counts=True)
    touched = np.repeat(touched, np.minimum(times, 2))
    edges = np.searchsorted(
        touched >> np.uint64(8 * OFFSET_BYTES), np.arange((1 << BLOCK_BITS) + 1, dtype=np.uint64)
    )
    blocks = np.flatnonzero(np.diff(edges))
    raw = touched.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :OFFSET_BYTES].tobytes()
    offsets = np.concatenate([edges[blocks], edges[-1:]]).astype(np.int32) * OFFSET_BYTES
    data = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), data], ["block", "touched"])


def partial_sketches(texts: DataFrame, width: int) -> DataFrame:
    """(block, touched): what every task counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for s in slices(batches):
            held.append(window_hashes(s, width)[0])
            if sum(map(len, held)) > HELD:
                yield _packed(held)
                held = []
        if sum(map(len, held)):
            yield _packed(held)

    return texts.mapInArrow(run, "block int, touched binary")


def _unpacked(data: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, OFFSET_BYTES)
    wide = np.zeros((len(raw), 4 if OFFSET_BYTES < 4 else 8), np.uint8)
    wide[:, :OFFSET_BYTES] = raw
    return wide.view(np.uint32 if OFFSET_BYTES < 4 else np.uint64).ravel()


def merged_sketch(partial: DataFrame) -> DataFrame:
    """(block, bits): for each block with a counter of two or more, its rows of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has a few blocks, with a fixed share of the windows each.
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(block, []).append(data)
        for block, data in held.items():
            offsets = np.sort(_unpacked(data))
            twice = offsets[1:][offsets[1:] == offsets[:-1]].astype(np.uint64)
            if len(twice):
                rows = np.zeros((ROWS, 1 << ROW_BITS), bool)
                for r, where in enumerate(_bits(twice)):
                    rows[r, where] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([np.packbits(rows).tobytes()], pa.binary())],
                    ["block", "bits"],
                )

    return partial.repartition("block").mapInArrow(run, "block int, bits binary")


def _gathered(merged: DataFrame) -> np.ndarray:
    """The merged sketch as one array of a fixed size."""
    size = ROWS << (ROW_BITS - 3)
    out = np.zeros(((1 << BLOCK_BITS), size), np.uint8)
    table = merged.toArrow()  # as large as ``out`` at most, in one job
    for block, bits in zip(table.column("block").to_numpy(), table.column("bits"), strict=True):
        out[block] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def _estimated_repeated(keys: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    counters = _counter(keys)
    block = (counters >> np.uint64(8 * OFFSET_BYTES)).astype(np.int64)
    yes = np.ones(len(keys), bool)
    for r, where in enumerate(_bits(counters)):
        at = where.astype(np.int64) + (r << ROW_BITS)
        yes &= (sketch[block, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return yes


def _checksums(s: Slice) -> np.ndarray:
    """A number of 31 bits per text."""
    sums = running(s.hashes())
    whole = spans(sums, s.of_text[:-1], s.of_text[1:]) if len(sums) > 1 else np.zeros(s.texts, np.uint64)
    return (mix(whole + s.counts().astype(np.uint64)) >> np.uint64(33)).astype(np.int64)


def _first_of_equal(one: np.ndarray, two: np.ndarray, doc: np.ndarray, spot: np.ndarray):
    """(order, first): rows by key and place, and whether each stands where its key stands first."""
    order = np.lexsort((spot, doc, two, one))
    one, two, doc, spot = one[order], two[order], doc[order], spot[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    leader = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, (doc == doc[leader]) & (spot == spot[leader]), new


_SENT = "one bigint, two int, doc bigint, spot bigint"
_SENT_NAMES = ["one", "two", "doc", "spot"]


def _candidates(texts: DataFrame, sketch, width: int) -> DataFrame:
    """(one, two, doc, spot): of the windows estimated as repeated, each task's first per key.

    ``spot`` is the start above the checksum of the text. Windows that stand behind an equal one
    of the same task come with a null key: they are marked already.
    """

    def emit(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        one, two, doc, spot = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first, new = _first_of_equal(one, two, doc, spot)
        keep = new | ~first  # equal rows need to be sent once
        order, known = order[keep], ~first[keep]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(one[order].view(np.int64), mask=known),
                pa.array(two[order].view(np.int32), mask=known),
                pa.array(doc[order]),
                pa.array(spot[order]),
            ],
            _SENT_NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sketch.value, np.uint8).reshape(1 << BLOCK_BITS, -1)
        held: list[tuple[np.ndarray, ...]] = []
        for s in slices(batches):
            one, two, at = window_hashes(s, width)
            yes = _estimated_repeated(one, bits)
            if not yes.any():
                continue
            at = at[yes]
            text = s.text_of_word()[at]
            start = positions_in_text(s.of_text)[at]
            spot = (start << 31) | _checksums(s)[text]
            held.append((one[yes], two[yes], longs(s.column("id"), _NULL)[text], spot))
            if sum(len(h[0]) for h in held) > HELD:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return texts.mapInArrow(run, _SENT)


def _marks(candidates: DataFrame) -> DataFrame:
    """(doc, checksum, start): window starts to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal keys are in one task, whose share of the candidates is fixed by the partitioning.
        held = []
        for b in batches:
            known = np.asarray(b.column(0).is_null())
            held.append((known, *(longs(b.column(i), 0) for i in range(4))))
        if not held:
            return
        known, one, two, doc, spot = (np.concatenate(x) for x in zip(*held, strict=True))
        done = doc[known], spot[known]
        one, two, doc, spot = one[~known], two[~known], doc[~known], spot[~known]
        order, first, _ = _first_of_equal(one, two, doc, spot)
        later = order[~first]
        doc, spot = np.concatenate([done[0], doc[later]]), np.concatenate([done[1], spot[later]])
        # In order of documents, runs of starts compress well.
        order = np.lexsort((spot, doc))
        doc, spot = doc[order], spot[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(spot & ((1 << 31) - 1)), pa.array((spot >> 31).astype(np.int32))],
            ["doc", "checksum", "start"],
        )

    # Rows without a key are dealt out by place.
    dealt = candidates.repartition(F.coalesce("one", F.xxhash64("doc", "spot")), F.coalesce("two", F.lit(0)))
    return dealt.mapInArrow(run, "doc bigint, checksum bigint, start int")


def _numbered(texts: DataFrame) -> DataFrame:
    """``texts`` (id, text) with the checksum that marks are joined by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [s.column("id"), s.column("text"), pa.array(_checksums(s))], ["id", "text", "checksum"]
            )

    return texts.mapInArrow(run, "id bigint, text string, checksum bigint")


def cut(docs: DataFrame, width: int = WIDTH, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, n_words, n_removed, kept): ``kept`` has the words left, joined by one space."""
    texts = docs.select(F.col(identity).cast("bigint").alias("id"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    sketch = context.broadcast(_gathered(merged_sketch(partial_sketches(texts, width))).tobytes())
    marks = _marks(_candidates(texts, sketch, width)).groupBy("doc", "checksum").agg(
        F.collect_list("start").alias("starts")
    )
    joined = _numbered(texts).join(
        marks.withColumnRenamed("checksum", "of"),
        (F.coalesce("id", F.lit(_NULL)) == F.col("doc")) & (F.col("checksum") == F.col("of")),
        "left",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            counts = s.counts()
            removed = np.zeros(len(s.starts), bool)
            for i, starts in enumerate(s.column("starts")):
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    step = np.zeros(counts[i] + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + width, -1)
                    removed[s.of_text[i] : s.of_text[i + 1]] = np.cumsum(step)[:-1] > 0
            raw = s.data.tobytes()
            kept = []
            for a, b in zip(s.of_text[:-1], s.of_text[1:], strict=True):
                left = a + np.flatnonzero(~removed[a:b])
                kept.append(b" ".join([raw[x:y] for x, y in zip(s.starts[left].tolist(), s.ends[left].tolist(), strict=True)]).decode())
            gone = np.concatenate([[0], np.cumsum(removed)])[s.of_text]
            yield pa.RecordBatch.from_arrays(
                [s.column("id"), pa.array(counts.astype(np.int64)), pa.array(np.diff(gone)), pa.array(kept, pa.string())],
                [identity, "n_words", "n_removed", "kept"],
            )

    return joined.select("id", "text", "starts").mapInArrow(
        run, f"`{identity}` bigint, n_words bigint, n_removed bigint, kept string"
    )
