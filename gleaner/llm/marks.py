"""Marks: a bitmap of keys that tells most rows of a table from those that a join would find.

A join of texts with few keys shuffles all texts. Marks drop nearly all rows without a key where
they are read, so only the others are shuffled. A row with a key always passes; the join behind the
marks stays, since a few others pass too. The bitmap's size is ``MARKS`` bits, whatever the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = 1 << 25  # 4 MB; of more than some ten million keys, many rows without one pass, and all rows at last


def marks(ids: DataFrame) -> DataFrame:
    """(bits), one row: longs with a bit for the hash of every id. Their size is set by ``MARKS`` alone."""
    place = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    some = ids.select(F.shiftrightunsigned(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = ids.sparkSession.range(MARKS // 64).toDF("at").join(some, "at", "left")
    pair = F.struct("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["bits"]).alias("bits"))


def marked(identity: Column, bits: DataFrame) -> Column:
    """Whether the bit of an id is set: it is for every id that was marked, and for few others."""
    place = F.pmod(F.xxhash64(identity), F.lit(MARKS))
    word = F.get(bits.scalar(), F.shiftrightunsigned(place, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
