"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the documents of the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, marks, mixing, neardup, quality, sharding
from gleaner.storage import materialize, passing

SHARDS = 40
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.ratios(docs, quality.trusted_ids(labels))
    return quality.keep(docs, weights)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, nulls last.

    Groups are of rows, so ids may be null or repeat: rows that share an id come down to one only if
    their texts are near-duplicates. Among rows of one group and id a hash of the whole row decides;
    of rows that are equal in all columns one stays at most. A row whose text has no words is a
    group of its own. Further columns of any name pass through.

    Rows are known by id and hash (128 bits), so no copy of the texts is written. Marks leave few rows
    besides those that are decided on; only these are joined with the decisions, the others pass unshuffled.
    """
    values = [F.col(f"`{c}`") for c in docs.columns]
    marked = [*values, *[v.isNull() for v in values]]
    key = F.struct(
        F.col("doc_id").isNull().alias("none"),
        "doc_id",
        F.xxhash64(*marked).alias("hash1"),
        F.xxhash64(F.lit(1), *marked).alias("hash2"),
    )
    with passing(spark):
        found = neardup.near_duplicates(docs.select(key.alias("id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT, identity="id")
        rows = found.filter("n_shingles > 0").groupBy("id", "kept").agg(F.count(F.lit(1)).alias("n"))
        decided = materialize(rows.filter("not kept or n > 1"), "decided", lasting=True)
    # Structs keep the names of the columns apart from those used here.
    whole = docs.select(F.struct(*values).alias("row"), key.alias("key"))
    bits = materialize(marks.marks(decided.select("id")), "marks")
    concerned = marks.marked(F.col("key"), bits)
    some = whole.filter(concerned)
    left = some.join(decided.select(F.col("id").alias("key")), "key", "left_anti").select("row")
    left = whole.filter(~concerned).select("row").unionByName(left)
    again = decided.filter("kept").select(F.col("id").alias("key"))
    if not again.isEmpty():
        equal = some.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        left = left.unionByName(equal.select("row"))
    return left.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with their columns as they are, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return mixing.repeat(mixing.mix(docs.select("doc_id", "text", "source", row)), ["row"]).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shards),
]

# Hashed n-grams, MinHash bands and the ring have no SQL twin; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
