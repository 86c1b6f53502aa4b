"""Quality rules: counts of a text, and how much likelier a trusted source made it than the corpus.

Words and word pairs are hashed into a fixed number of slots. Two multinomials over the slots, one
counted on trusted documents and one on the whole corpus, give every slot a log-likelihood ratio.
A document's score is the mean over its words and pairs; it is kept at or above a fixed threshold.
Ratios are whole thousandths, so scores are exact sums and the verdict never depends on the order
of addition.

The trusted side is a sample of at most ``trusted_rows`` labelled ids (lowest hashes first), a
documented bound, so the ids fit a broadcast. The corpus side counts every word of every text.

Defined cases: a null or empty text has no words and fails the base rules; ids may be null or
repeat, every row gives one row; further columns are ignored; an empty table gives an empty one;
with nobody trusted all ratios are 0. Windows of three words are compared by hash (more than 40
bits beside the position, for texts of up to 16 million words).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 16384
TRUSTED_ROWS = 8192
# Thousandths of a natural logarithm per word or pair.
THRESHOLD = -70
# Occurrences that every slot is given on both sides, so that rare slots say little.
PRIOR = 5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _numbers(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _at(numbers: Column, i: Column) -> Column:
    return F.coalesce(F.get(numbers, i), F.lit(0).cast("bigint"))


def _slots(numbers: Column) -> Column:
    """A slot for every word and for every pair of neighbours."""
    singles = F.transform(numbers, lambda h: F.pmod(h, F.lit(SLOTS)).cast("int"))
    pairs = F.transform(
        F.slice(numbers, F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(h, _at(numbers, i + 1)), F.lit(SLOTS)).cast("int"),
    )
    return F.concat(singles, pairs)


def slot_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(slot, n) over all words and pairs; one row per slot and task is shuffled."""
    numbered = docs.select(_numbers(words(F.col(text))).alias("_h"))
    return (
        numbered.select(F.explode(_slots(F.col("_h"))).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def trusted_ids(labels: DataFrame, identity: str = "doc_id", most: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``most`` ids of documents labelled good and not toxic, by lowest hash."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    ids = good.filter(F.col(identity).isNotNull()).select(identity).distinct()
    return ids.orderBy(F.xxhash64(identity), identity).limit(most)


def ratios(docs: DataFrame, trusted: DataFrame, identity: str = "doc_id", text: str = "text") -> list[int]:
    """Thousandths of log(trusted / corpus) for every slot.

    The trusted count is set against the count expected from the corpus' shares, both plus ``PRIOR``.

    What reaches the driver has one row per slot. ``trusted`` holds ids and is broadcast: keep it
    bounded, as ``trusted_ids`` does.
    """
    raw = {r["slot"]: r["n"] for r in slot_counts(docs, text).collect()}
    chosen = docs.select(identity, text).join(F.broadcast(trusted), identity, "left_semi")
    good = {r["slot"]: r["n"] for r in slot_counts(chosen, text).collect()}
    if not good:
        return [0] * SLOTS
    n_raw, n_good = sum(raw.values()), sum(good.values())
    expected = [n_good * raw.get(slot, 0) / n_raw for slot in range(SLOTS)]
    return [round(1000 * math.log((good.get(s, 0) + PRIOR) / (expected[s] + PRIOR))) for s in range(SLOTS)]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _position_mask(n: Column) -> Column:
    """Bits that hold a position among ``n`` words."""
    return (
        F.when(n < (1 << 12), (1 << 12) - 1)
        .when(n < (1 << 16), (1 << 16) - 1)
        .when(n < (1 << 20), (1 << 20) - 1)
        .otherwise((1 << 24) - 1)
        .cast("bigint")
    )


def _packed_windows(numbers: Column, mask: Column) -> Column:
    """Each window of three words as one number, its hash above its position, in order.

    Sorting brings equal windows together.
    """
    return F.sort_array(
        F.transform(
            F.slice(numbers, F.lit(1), F.greatest(F.size(numbers) - 2, F.lit(0))),
            lambda h, i: F.xxhash64(h, _at(numbers, i + 1), _at(numbers, i + 2))
            .bitwiseAND(F.bitwise_not(mask))
            .bitwiseOR(i.cast("bigint")),
        )
    )


def _repeated_places(packed: Column, mask: Column) -> Column:
    """Positions of the windows that have a twin beside them, in order."""

    def same(x: Column, i: Column) -> Column:
        return _at(packed, i).bitwiseXOR(x).bitwiseAND(F.bitwise_not(mask)) == 0

    # Both ends have one neighbour only; what is read beyond them is ruled out by position.
    twins = F.filter(
        packed, lambda x, i: ((i > 0) & same(x, i - 1)) | ((i + 1 < F.size(packed)) & same(x, i + 1))
    )
    return F.sort_array(F.transform(twins, lambda x: x.bitwiseAND(mask)))


def _covered(places: Column) -> Column:
    """Words under windows of three at these positions."""
    three = F.lit(3).cast("bigint")
    return F.aggregate(
        F.transform(places, lambda p, i: F.least(three, F.coalesce(F.get(places, i + 1) - p, three))),
        F.lit(0).cast("bigint"),
        lambda a, b: a + b,
    )


def repeat_words(numbers: Column) -> Column:
    """Words inside windows of three that occur twice or more in the text."""
    return _let(
        _position_mask(F.size(numbers)),
        lambda mask: _let(
            _packed_windows(numbers, mask), lambda packed: _let(_repeated_places(packed, mask), _covered)
        ),
    )


def _dup_lines(text: Column) -> Column:
    spoken = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return _let(spoken, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"))


def verdict(text: Column, weights: list[int], threshold: int = THRESHOLD) -> Column:
    """All counts, score (thousandths, summed), n_grams, base_failed and kept as one struct."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    whole = F.coalesce(text, F.lit(""))

    def counted(tokens: Column) -> Column:
        return _let(
            _numbers(tokens),
            lambda h: F.struct(
                F.size(tokens).cast("bigint").alias("n_words"),
                F.length(F.array_join(tokens, "")).cast("bigint").alias("word_chars"),
                (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                _dup_lines(whole).alias("n_dup_lines"),
                repeat_words(h).alias("n_repeat_words"),
                F.aggregate(_slots(h), F.lit(0).cast("bigint"), lambda a, s: a + F.get(table, s)).alias("score"),
            ),
        )

    def judged(c: Column) -> Column:
        n_grams = F.greatest(2 * c["n_words"] - 1, F.lit(0).cast("bigint"))
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        return F.struct(
            *[c[name].alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            c["score"].alias("score"),
            n_grams.alias("n_grams"),
            failed.alias("base_failed"),
            (~failed & (c["score"] >= n_grams * threshold)).alias("kept"),
        )

    return _let(_let(words(text), counted), judged)


def judge(docs: DataFrame, weights: list[int], text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the fields of ``verdict``; columns of ``docs`` with their names give way to them."""
    mine = "_verdict"
    while mine in docs.columns:
        mine = f"_{mine}"
    judged = docs.withColumn(mine, verdict(F.col(text), weights, threshold))
    results = judged.schema[mine].dataType.names
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in results]
    return judged.select(*others, f"{mine}.*")


def keep(docs: DataFrame, weights: list[int], text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return docs.filter(verdict(F.col(text), weights, threshold)["kept"])
