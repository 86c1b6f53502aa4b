"""Writers for cluster maps, coresets and file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.keys import shard_of
from gleaner.storage import exists


def with_bucket(df: DataFrame, buckets: int, cluster: str = "cluster_id") -> DataFrame:
    """``df`` with the output folder of each cluster. A folder per cluster would be too many."""
    return df.withColumn("bucket", F.pmod(F.col(cluster), F.lit(buckets)).cast("int"))


def write_cluster_map(df: DataFrame, path: str, buckets: int = 1000, cluster: str = "cluster_id", mode: str = "overwrite") -> None:
    """Write the rows of a cluster together, in folders of clusters.

    The rebalance hint evens out file sizes: a large cluster is split over several files.
    """
    placed = with_bucket(df, buckets, cluster).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", cluster).write.mode(mode).partitionBy("bucket").parquet(path)


def pending_clusters(wanted: DataFrame, path: str, cluster: str = "cluster_id") -> DataFrame:
    """Rows of ``wanted`` whose cluster is not in the output yet."""
    spark = wanted.sparkSession
    if not exists(spark, path):
        return wanted
    return skip_done(wanted, spark.read.parquet(path), cluster)


def skip_done(wanted: DataFrame, done: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return wanted.join(done.select(cluster).distinct(), cluster, "left_anti")


def coreset_by_shard(kept: DataFrame, shards: int, key: str = "key") -> DataFrame:
    """(shard, keys): the selected keys of every shard in order, an empty list where there are
    none. The key format bounds a shard's distinct keys, and copies collapse before the shuffle.
    A key of a shard beyond the last one raises."""
    shard = shard_of(key)
    beyond = F.raise_error(F.concat(F.lit("no such shard: "), shard.cast("string"))).cast("int")
    lists = (
        kept.select(
            F.when((shard >= 0) & (shard < shards), shard).otherwise(beyond).alias("shard"),
            F.col(key).cast("bigint").alias("key"),
        )
        .groupBy("shard")
        .agg(F.array_sort(F.collect_set("key")).alias("keys"))
    )
    every = kept.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(lists, "shard", "left").select(
        "shard", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys")
    )


def write_coreset_by_shard(kept: DataFrame, path: str, shards: int, key: str = "key") -> None:
    coreset_by_shard(kept, shards, key).write.mode("overwrite").parquet(path)


def file_list_lines(kept: DataFrame) -> DataFrame:
    """The lines of a kept file list, in the original order."""
    return kept.orderBy("sample_id").select(F.concat_ws(" ", "path", "label").alias("value"))


def write_file_list(kept: DataFrame, path: str) -> None:
    """Text files that, read in name order, list the kept samples in their original order."""
    file_list_lines(kept).write.mode("overwrite").text(path)
