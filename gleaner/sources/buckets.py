"""Tables that are laid out once for the joins that follow.

Two tables in the same number of buckets by the join key are joined without a shuffle of either, and
one such table is read without a shuffle by a join whose other side is brought to its buckets. That
pays where a large table (vectors, metadata, samples by shard) is joined again and again.

A bucket is one task in such a join, so the key must spread: a table in which one bucket would hold
more than ``most_share`` of the rows (and more than its even share) is refused. Name further columns
then, such as a part number within a hot cluster.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.storage import read_text, write_once

_LAYOUT = "_layout.json"  # names with an underscore are no data to Spark


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.hash(*[F.col(_quoted(k)) for k in keys]), F.lit(buckets))


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, most_share: float = 0.05) -> DataFrame:
    """Write ``df`` to a new folder in ``buckets`` buckets by ``keys``, sorted by them; the table as read back.

    One shuffle, one file per bucket. Nulls in a key are a key of their own and join with nothing. A
    folder that holds a table already, and a key that does not spread, raise.
    """
    spark = df.sparkSession
    if buckets < 1 or not keys:
        raise ValueError("need a key and at least one bucket")
    if read_text(spark, f"{path}/{_LAYOUT}") is not None:
        raise ValueError(f"{path} holds a bucketed table already")
    sizes = df.groupBy(_bucket(keys, buckets).alias("bucket")).count()
    found = sizes.agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    allowed = max(most_share, 2 / buckets) * (found["all"] or 0)
    # Below some rows per bucket, chance alone makes shares uneven.
    if found["most"] and found["most"] > allowed + 100:
        raise ValueError(f"one bucket would hold {found['most']} of {found['all']} rows; add a column to {keys}")
    name = f"bucketed_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *[F.col(_quoted(k)) for k in keys])
    writer = placed.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
    writer.saveAsTable(name, format="parquet", mode="errorifexists")
    columns = [[f.name, f.dataType.simpleString()] for f in df.schema.fields]
    write_once(spark, f"{path}/{_LAYOUT}", json.dumps({"keys": keys, "buckets": buckets, "columns": columns}))
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_bucketed``, with its buckets, in whatever session."""
    text = read_text(spark, f"{path}/{_LAYOUT}")
    if text is None:
        raise FileNotFoundError(f"{path} holds no bucketed table")
    layout = json.loads(text)
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"{_quoted(c)} {kind}" for c, kind in layout["columns"])
    keys = ", ".join(_quoted(k) for k in layout["keys"])
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
        f"INTO {int(layout['buckets'])} BUCKETS LOCATION {json.dumps(path)}"
    )
    return spark.table(name)
