"""Tables, text files and their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.keys import parse_key
from gleaner.operators.ranking import row_index
from gleaner.storage import materialize


def read_keys(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """Keys of a metadata table, with the file and position of each. Reads one column."""
    return spark.read.parquet(path).select(
        parse_key(key).alias("key"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("row_id"),
    )


def with_file_id(rows: DataFrame, file: str = "file") -> DataFrame:
    """``rows`` of a file table with the place of their file in name order, counted from 0."""
    names = sorted({f.rpartition("/")[2] for f in rows.inputFiles()})
    listed = rows.sparkSession.createDataFrame(list(enumerate(names)), f"file_id int, `{file}` string")
    return rows.join(materialize(listed, "files"), file)


def align_by_position(**tables: DataFrame) -> DataFrame:
    """Tables with (file_id, row_id), joined where both agree: row ``i`` of file ``f`` of one table
    belongs to row ``i`` of file ``f`` of the others. Raises if files differ in number or length.

    The lengths are compared first, from one row per file and table.
    """
    counts = None
    for name, rows in tables.items():
        own = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias(name))
        counts = own if counts is None else counts.join(own, "file_id", "full")
    first, *others = tables
    unequal = " or ".join(f"not ({first} <=> {other})" for other in others)
    wrong = counts.filter(unequal).orderBy("file_id").limit(5).collect() if others else []
    if wrong:
        raise ValueError(f"files of different lengths: {[r.asDict() for r in wrong]}")
    joined = tables[first]
    for other in others:
        joined = joined.join(tables[other], ["file_id", "row_id"])
    return joined


def _number(lines: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number lines from 0 inside ``group``, splits in ``order``, lines in file order.

    Lines keep their order inside a split, so this takes one row per split: how many lines it has
    and where they start.
    """
    splits = lines.groupBy(*group, *order).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    starts = materialize(
        splits.select(*group, *order, (before - F.col("_first")).alias("_shift")), "splits"
    )
    return lines.join(starts, [*group, *order]).withColumn(name, F.col("_place") + F.col("_shift"))


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, value): the lines of a text file or folder, numbered in file and line order."""
    lines = materialize(
        spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_place"),
        ),
        "lines",
    )
    return _number(lines, [], ["_file", "_block"], "line_id").select("line_id", "value")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, path, label) of a list with one ``path label`` per line."""
    parts = F.split(F.rtrim("value"), " ")
    return number_lines(spark, path).select(
        F.col("line_id").alias("sample_id"),
        F.get(parts, F.lit(0)).alias("path"),
        F.get(parts, F.lit(1)).cast("int").alias("label"),
    )


def make_file_list(files: DataFrame, class_name: str = "class_name", file_name: str = "file_name") -> DataFrame:
    """(sample_id, path, label): classes in name order get dense labels, files are listed by class
    and name."""
    labels = row_index(files.select(class_name).distinct(), [F.col(class_name)], "label")
    ordered = row_index(
        files.select(class_name, file_name), [F.col(class_name), F.col(file_name)], "sample_id"
    )
    return ordered.join(labels, class_name).select(
        "sample_id",
        F.concat(F.lit("/"), class_name, F.lit("/"), file_name).alias("path"),
        F.col("label").cast("int").alias("label"),
    )


# The first number in the last part of a path.
FIRST_NUMBER_IN_NAME = r"^(?:.*/)?[^/0-9]*(\d+)[^/]*$"


def read_prob_history(
    spark: SparkSession, path: str, epoch_pattern: str = FIRST_NUMBER_IN_NAME
) -> DataFrame:
    """(epoch, sample_id, prob): one probability per line, line number = sample; an epoch may have
    several files, which follow each other in name order. ``epoch_pattern`` finds the epoch in the file's path, by default the first number in
    its name; a table written by epoch has it in the folder."""
    lines = materialize(
        spark.read.text(path).select(
            F.regexp_extract(F.col("_metadata.file_path"), epoch_pattern, 1).cast("int").alias("epoch"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_place"),
            F.col("value").cast("double").alias("prob"),
        ),
        "history",
    )
    return _number(lines, ["epoch"], ["_file", "_block"], "sample_id").select("epoch", "sample_id", "prob")


def read_caption_csv(
    spark: SparkSession, path: str, sep: str = "\t", image_key: str = "filepath", caption_key: str = "title"
) -> DataFrame:
    """Two columns of a delimited file with a header. Quoted values may hold line breaks, so a file
    is read by one task: give large tables as several files."""
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True).select(
        image_key, caption_key
    )


def source_size(shards: DataFrame, sizes: DataFrame, name: str = "shard") -> DataFrame:
    """(total_size, num_shards) of a list of shards. Raises when a shard has no listed size."""
    listed = shards.join(sizes, name, "left")
    return listed.agg(
        F.sum(
            F.coalesce(
                F.col("size"), F.raise_error(F.concat(F.lit("no size listed for "), F.col(name))).cast("bigint")
            )
        ).alias("total_size"),
        F.count(F.lit(1)).alias("num_shards"),
    )
