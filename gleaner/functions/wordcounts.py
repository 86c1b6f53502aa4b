"""Hashed word counts of whole texts, taken where the texts are read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _slot(word: bytes, width: int) -> int:
    """The first two bytes of the word's MD5 digest, as a number, modulo ``width``; -1 for no word."""
    return int.from_bytes(hashlib.md5(word).digest()[:2]) % width if word else -1


def _counting(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            spoken = words.flatten().cast(pa.binary()).dictionary_encode()
            # A word is hashed once per batch, whatever its repeats.
            slot = np.array([_slot(w, width) for w in spoken.dictionary.to_pylist()], np.int64)
            slots = slot[spoken.indices.to_numpy()]
            rows = pc.list_parent_indices(words).to_numpy()[slots >= 0]
            counts = np.bincount(rows * width + slots[slots >= 0], minlength=batch.num_rows * width)
            columns = [pa.array(np.ascontiguousarray(c)) for c in counts.reshape(-1, width).T]
            names = [f"_{i}" for i in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", *names])

    return work


def hashed_word_counts(docs: DataFrame, identity: str, words: str, width: int) -> DataFrame:
    """(identity, counts): how many words of an id's rows fall in each of ``width`` slots, as doubles.

    ``words`` is a column of arrays; empty strings are no words. Ids without a word, and null ids,
    are left out. What is shuffled is one row of counts per document, whatever its length.
    """
    kind = docs.schema[identity].dataType.simpleString()
    slots = [f"_{i}" for i in range(width)]
    schema = ", ".join([f"_id {kind}", *[f"{s} bigint" for s in slots]])
    known = docs.filter(F.col(identity).isNotNull()).select(identity, words)
    counted = known.mapInArrow(_counting(width), schema).groupBy("_id").agg(*[F.sum(s).alias(s) for s in slots])
    counts = F.array(*[F.col(s).cast("double") for s in slots])
    return counted.select(F.col("_id").alias(identity), counts.alias("counts")).filter(F.exists("counts", lambda n: n > 0))
