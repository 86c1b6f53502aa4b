"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. Each of its documents is taken whole as often as the target
holds the source, and the rest of the target is filled by an order sample: documents are ranked by
their random odds divided by their inclusion odds, and the first ones are taken until the words
come nearest to the rest. Inclusion odds fall with the square root of a document's length, so
that one very long document does not take the place of many.

The ranking is laid out by range over a narrow table and only its end row per source is kept, so a
source that holds a third of all rows is spread over tasks, and texts are not shuffled: each row
compares itself with the end row of its source.

Defined cases: a null or empty text has size 0 and is taken at no cost; a null source is a source,
the last one; ids may be null or repeat; rows equal in source, id and text share one draw; further
columns pass through, except that those of a result's name give way to it; an empty table gives an empty one. Draws depend on seed, id and text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import row_index, running_total
from gleaner.storage import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "copies")
_HEX_DIGITS = 13  # 52 bits: exact in a double


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _digest(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def _uniform(seed: int, identity: Column, digest: Column) -> Column:
    """A number strictly between 0 and 1."""
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(identity.cast("string"), F.lit("")), digest).cast("binary"))
    return (F.conv(F.substring(told, 1, _HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16**_HEX_DIGITS)


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``.

    All words are shared by weight; a share stops at ``most`` times its source, and what is left
    is shared anew among the others until no share is above. Every round is one aggregation.
    """
    cap = F.col("source_size") * most
    level, stopped = 0.0, -1
    while True:
        above = (F.col("weight") * level > cap) if stopped >= 0 else F.lit(False)
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, cap).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(above.cast("int")).alias("stopped"),
        ).first()
        if row["stopped"] == stopped or not row["weights"]:
            break
        stopped = row["stopped"]
        level = (row["total"] - row["full"]) / row["weights"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def mix(
    docs: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the row).

    Columns of ``docs`` with one of these names are replaced.
    """
    digest = _digest(F.col(text))
    numbered = {
        "_size": size_of(F.col(text)),
        "_digest": digest,
        "_u": _uniform(seed, F.col(identity), digest),
    }
    known_as = [F.col(source).alias("_source"), F.col(identity).alias("_id"), *[c.alias(n) for n, c in numbered.items()]]
    narrow = materialize(docs.select(*known_as), "mix-narrow")
    # Inside a struct the columns of docs cannot clash with those used here.
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *known_as)
    sources = _sources(narrow, weights, most)
    ends = _ends(narrow, sources)
    known = materialize(sources.join(ends, "_spot", "left"), "mix-sources")
    joined = wide.join(known, F.col("_source").eqNullSafe(F.col("_from")))
    mine = F.struct(_rank(), F.col("_id").alias("id"), F.col("_digest").alias("digest"))
    extra = F.coalesce((mine <= F.col("_end")).cast("int"), F.lit(0))
    copies = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.least(F.col("_whole") + extra, F.lit(most)))
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in RESULTS],
        F.col("_size").alias("size"),
        F.col("source_size"),
        F.col("target"),
        copies.cast("int").alias("copies"),
    )


def _rank() -> Column:
    """Random odds over inclusion odds; documents without words cost nothing and need no rank."""
    share = F.try_divide(F.col("_rest"), F.col("source_size"))
    length = F.sqrt(F.try_divide(F.col("source_size") / F.col("_rows"), F.col("_size")))
    odds = F.try_divide(share, 1 - share) * length
    return F.try_divide(F.col("_u") / (1 - F.col("_u")), odds).alias("rank")


def _sources(narrow: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    sized = narrow.groupBy(F.col("_source").alias("_from")).agg(
        F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows")
    )
    placed = row_index(sized, [F.col("_from").asc_nulls_last()], "_spot")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_spot") % len(weights)).cast("int"))
    aimed = targets(materialize(placed.withColumn("weight", weight), "mix-weights"), most)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    return materialize(
        aimed.withColumn("_whole", whole.cast("int")).withColumn(
            "_rest", F.col("target") - F.col("_whole") * F.col("source_size")
        ),
        "mix-targets",
    )


def _ends(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """(place, end): the last row of every source's order sample."""
    drawn = (
        narrow.filter("_size > 0")
        .join(sources.filter("_rest > 0"), F.col("_source").eqNullSafe(F.col("_from")))
        .select("_spot", "_rest", _rank(), "_id", "_digest", "_size")
    )
    # Equal rows first become one, so none of them can fill a task.
    units = drawn.groupBy("_spot", "rank", "_id", "_digest").agg(
        F.sum("_size").alias("_size"), F.first("_rest").alias("_rest")
    )
    order = [F.col("_spot"), F.col("rank"), F.col("_id"), F.col("_digest")]
    summed = materialize(running_total(units, order, "_size", "_run"), "mix-order")
    # One row per source, written so that Catalyst knows its size: joined to a hot source without moving it.
    starts = materialize(summed.groupBy("_spot").agg(F.min(F.col("_run") - F.col("_size")).alias("_start")), "mix-starts")
    middle = F.col("_run") - F.col("_start") - F.col("_size") / 2
    return (
        summed.join(starts, "_spot")
        .filter(middle <= F.col("_rest"))
        .groupBy("_spot")
        .agg(F.max(F.struct("rank", F.col("_id").alias("id"), F.col("_digest").alias("digest"))).alias("_end"))
    )


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix as often as it takes them."""
    turn = "_copy"
    while turn in columns:
        turn = f"_{turn}"
    copied = mixed.filter("copies > 0").withColumn(turn, F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return copied.select(*[F.col(f"`{c}`") for c in columns])
