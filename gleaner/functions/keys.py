"""Keys, shards and seeded orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value of the key format: six digits of shard, four of index inside the shard.
KEYS_PER_SHARD = 10000

_HASH_RANGE = float(16**13)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shard_of(key: Column | str) -> Column:
    """Shard that holds a key (integer division)."""
    return F.floor(_column(key).cast("bigint") / F.lit(KEYS_PER_SHARD)).cast("int")


def parse_key(key: Column | str) -> Column:
    """Ten-digit text key as a number."""
    return _column(key).cast("bigint")


def seeded_hash(identity: Column | str, *seed: int | str) -> Column:
    """A repeatable 52-bit hash of an identity under a seed.

    Built on MD5, which other engines share, so a seeded order can be reproduced outside Spark.
    The value is exact in a double.
    """
    text = F.concat_ws("/", *[F.lit(str(s)) for s in seed], _column(identity).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def seeded_uniform(identity: Column | str, *seed: int | str) -> Column:
    """``seeded_hash`` scaled to [0, 1)."""
    return seeded_hash(identity, *seed).cast("double") / F.lit(_HASH_RANGE)
