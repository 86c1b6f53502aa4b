"""Importance resampling: draw the documents that look most like a target set.

Features are all runs of 1 to ``longest`` consecutive words, joined by one space. A feature's bucket
is the CRC-32 of its bytes modulo ``buckets``. Two multinomials over the buckets, one counted on all
documents and one on all target texts, give every bucket a gain; a document's weight is the mean
gain of its features, and Gumbel noise from a hash of the id turns the highest weights into a draw
without replacement.

Most occurrences are of few features. A *head* of frequent words and frequent pairs is gathered from
all documents and broadcast: words with their CRC states and lengths, pairs with their buckets. The
state of a run of head words follows from the states of its words, since CRC-32 is linear: appending
``n`` bytes is a fixed linear map of the state. Whatever holds a word outside the head, the *tail*,
has the CRC of its bytes taken directly. Both give the same number, so bucket totals are exact
whatever the head holds; the head only saves work. Its size is bounded by ``HEAD_WORDS`` and
``HEAD_PAIRS`` entries of at most ``HEAD_BYTES`` bytes, whatever the corpus.

Tasks add up their texts' buckets before the shuffle, so at most ``buckets`` rows leave a task.

Defined cases: a null or empty text has no features and weight 0; a null id hashes as the empty
string and ranks last among equals; rows that repeat an id are rows of their own; further columns are
ignored; without target texts the target counts are 0; an empty table gives an empty one. Frequent
words are recognised by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.splitting import alphabet, folded, resplit
from gleaner.llm.words import Slice, mix, slices, window_starts
from gleaner.operators.ranking import rank_in_group
from gleaner.storage import materialize

BUCKETS = 10_000
HEAD_WORDS = 1 << 14
HEAD_PAIRS = 1 << 14
HEAD_BYTES = 64
# Digits, letters and all bytes of characters beyond ASCII.
INSIDE = alphabet((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


# --- CRC states -----------------------------------------------------------------------------


def _byte_steps() -> np.ndarray:
    """What one zero byte does to the low byte of a state."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _byte_steps()
_SPACE = np.uint32(zlib.crc32(b" "))
_shifts: dict[int, np.ndarray] = {}


def _shift_table(length: int) -> np.ndarray:
    """Four tables, one per byte of a state, that together move it over ``length`` zero bytes."""
    if length not in _shifts:
        states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(length):
            states = (states >> 8) ^ _STEPS[states & 255]
        _shifts[length] = states
    return _shifts[length]


def joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of two strings one after the other, from theirs and the second one's length."""
    out = np.empty(len(left), np.uint32)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        tables, states = _shift_table(int(length)), left[at]
        moved = tables[0][states & 255]
        for i in (1, 2, 3):
            moved = moved ^ tables[i][(states >> (8 * i)) & 255]
        out[at] = moved ^ right[at]
    return out


@dataclass
class Head:
    """Frequent words with CRC states and lengths, frequent pairs with buckets; keys in order."""

    words: np.ndarray
    states: np.ndarray
    lengths: np.ndarray
    pairs: np.ndarray
    pair_buckets: np.ndarray

    @classmethod
    def of(cls, found: dict[int, list[tuple[int, str]]], buckets: int) -> Head:
        words = sorted((k & (2**64 - 1), w.encode()) for k, w in found.get(1, []))
        pairs = sorted((k & (2**64 - 1), w.encode()) for k, w in found.get(2, []))
        return cls(
            np.array([k for k, _ in words], np.uint64),
            np.array([zlib.crc32(w) for _, w in words], np.uint32),
            np.array([len(w) for _, w in words], np.int64),
            np.array([k for k, _ in pairs], np.uint64),
            np.array([zlib.crc32(w) % buckets for _, w in pairs], np.int64),
        )


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, known) of every wanted key in the ordered ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _run_keys(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    keys = hashes[starts]
    for i in range(1, n):
        keys = mix(keys * np.uint64(3) + hashes[starts + i])
    return keys


def _direct(s: Slice, start: int, n: int) -> int:
    return zlib.crc32(b" ".join(folded(s, start + i) for i in range(n)))


def run_buckets(s: Slice, hashes: np.ndarray, n: int, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, bucket) of all runs of ``n`` words inside a text."""
    starts = window_starts(s.of_text, n)
    keys, first, back = np.unique(_run_keys(hashes, starts, n), return_index=True, return_inverse=True)
    at = starts[first]
    found = np.full(len(keys), -1, np.int64)
    if n == 2:
        place, known = _find(head.pairs, keys)
        found[known] = head.pair_buckets[place[known]]
    open_ = np.flatnonzero(found < 0)
    place, known = _find(head.words, hashes[at[open_]])
    state = head.states[place] if len(head.words) else np.zeros(len(open_), np.uint32)
    for i in range(1, n):
        place, here = _find(head.words, hashes[at[open_] + i])
        known &= here
        ok = np.flatnonzero(known)
        spaced = joined(state[ok], np.full(len(ok), _SPACE), np.ones(len(ok), np.int64))
        state[ok] = joined(spaced, head.states[place[ok]], head.lengths[place[ok]])
    found[open_[known]] = state[known].astype(np.int64) % buckets
    for j in open_[~known]:
        found[j] = _direct(s, int(at[j]), n) % buckets
    return starts, found[back]


# --- head, totals, weights ------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, np.ndarray]]:
    for s in slices(batches):
        s = resplit(s, INSIDE)
        yield s, s.hashes(fold=True)


def frequent(texts: DataFrame, longest: int, buckets: int) -> Head:
    """The head: words, and pairs if there are any, that tasks saw most often.

    Every task counts all its texts in a table of bounded size, out of which rare entries fall when
    it is full, and hands on its most frequent ones; the sums rank them. Ties go to the smaller key.
    """
    sizes = {1: HEAD_WORDS, 2: HEAD_PAIRS}
    widths = [n for n in sizes if n <= longest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, dict[int, list]] = {n: {} for n in widths}
        for s, hashes in _cut(batches):
            for n in widths:
                starts = window_starts(s.of_text, n)
                keys, first, counts = np.unique(_run_keys(hashes, starts, n), return_index=True, return_counts=True)
                fits = s.ends[starts[first] + n - 1] - s.starts[starts[first]] <= HEAD_BYTES
                table = seen[n]
                for k, at, c in zip(keys[fits].tolist(), starts[first[fits]].tolist(), counts[fits].tolist(), strict=True):
                    if k in table:
                        table[k][0] += c
                    else:
                        table[k] = [c, b" ".join(folded(s, at + i) for i in range(n))]
                if len(table) > 16 * sizes[n]:
                    seen[n] = dict(heapq.nlargest(4 * sizes[n], table.items(), key=lambda e: e[1][0]))
        for n in widths:
            best = heapq.nlargest(sizes[n], seen[n].items(), key=lambda e: e[1][0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n] * len(best), pa.int32()),
                    pa.array(np.array([k for k, _ in best], np.uint64).view(np.int64)),
                    pa.array([e[1].decode() for _, e in best], pa.string()),
                    pa.array([e[0] for _, e in best], pa.int64()),
                ],
                ["width", "key", "run", "n"],
            )

    summed = texts.mapInArrow(run, "width int, key bigint, run string, n bigint").groupBy("width", "key")
    counted = materialize(summed.agg(F.min("run").alias("run"), F.sum("n").alias("n")), "head")
    found = {}
    for n in widths:
        best = counted.filter(F.col("width") == n).orderBy(F.desc("n"), "key").limit(sizes[n])
        found[n] = [(r.key, r.run) for r in best.select("key", "run").collect()]  # at most sizes[n]
    return Head.of(found, buckets)


def bucket_totals(texts: DataFrame, head: Head, longest: int, buckets: int) -> np.ndarray:
    """Exact counts of all features per bucket."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for s, hashes in _cut(batches):
            for n in range(1, longest + 1):
                totals += np.bincount(run_buckets(s, hashes, n, shared.value, buckets)[1], minlength=buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["bucket", "n"])

    counted = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row per bucket
        totals[r.bucket] = r.n
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log-ratio of target and source shares, floored."""
    n = len(source)
    every_s, every_t = int(source.sum()) + n, int(target.sum()) + n
    ratio = [(float(t) + 1) * every_s / ((float(s) + 1) * every_t) for s, t in zip(source, target, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, head: Head, longest: int, identity: str) -> DataFrame:
    """(id, n_features, weight, n_words): the floored mean gain of each text's features."""
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))
    kind = docs.schema[identity].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = shared.value
        for s, hashes in _cut(batches):
            number, total = np.zeros(s.texts, np.int64), np.zeros(s.texts, np.int64)
            for n in range(1, longest + 1):
                starts, found = run_buckets(s, hashes, n, head, buckets)
                upto = np.concatenate([[0], np.cumsum(gain[found])])
                ends = np.searchsorted(starts, s.of_text)
                number += np.diff(ends)
                total += np.diff(upto[ends])
            yield pa.RecordBatch.from_arrays(
                [
                    s.column(identity),
                    pa.array(number),
                    pa.array(total // np.maximum(number, 1)),
                    pa.array(s.counts()),
                ],
                [identity, "n_features", "weight", "n_words"],
            )

    return docs.mapInArrow(run, f"`{identity}` {kind}, n_features bigint, weight bigint, n_words bigint")


def noise(identity: str, seed: str):
    """Thousandths of a Gumbel variate from the id's SHA-256, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(identity).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    min_words: int = 20,
    seed: str = "2024",
    identity: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank, n_words) of every document.

    Of the N documents with ``min_words`` words or more, the ``floor(percent * N / 100)`` with the
    highest scores are drawn and ranked from 1, ties to the smaller id; the others' rank is null.
    """
    texts = docs.select(F.col(identity), F.col(text).alias("text"))
    wanted = target.select(F.col(target_text).alias("text"))
    head = frequent(texts.select("text"), longest, buckets)
    source = bucket_totals(texts.select("text"), head, longest, buckets)
    gain = gains(source, bucket_totals(wanted, head, longest, buckets))
    weighed = weights(texts, gain, head, longest, identity)
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(identity, seed)), "weights")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last(identity), F.asc("n_features"), F.asc("weight")]
    ranked = rank_in_group(able, order, name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint")))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select(identity, "n_features", "weight", "score", "rank", "n_words")
