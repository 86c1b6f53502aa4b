"""Hashed word counts of texts."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from gleaner.functions.wordcounts import hashed_word_counts


def test_counts_are_summed_per_id(spark):
    rows = [(1, "a b a"), (1, "b  zebra"), (2, ""), (3, None), (4, " "), (None, "lost"), (5, "été a")]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    found = hashed_word_counts(docs.select("id", F.split("text", r"\s+").alias("words")), "id", "words", 7)
    expected = {}
    for i, text in rows:
        for w in (text or "").split():
            if i is not None:
                slot = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 7
                expected.setdefault(i, Counter())[slot] += 1
    assert {r["id"]: r["counts"] for r in found.collect()} == {
        i: [float(n[s]) for s in range(7)] for i, n in expected.items()
    }


def test_document_vectors_do_not_shuffle_words(spark, tmp_path):
    from catalog.inputs import document_vectors

    rows = [(1, "en", 1200, "a b a"), (1, "de", 7, "c"), (2, None, 5, "x y"), (3, "en", 0, "")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, n_chars bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = document_vectors(spark, str(tmp_path))
    assert sorted((r["id"], r["cluster_id"] or 0, r["clip_score"], sum(r["embedding"])) for r in found.collect()) == [
        (1, 1, 0.007, 4.0), (1, 4, 0.2, 4.0), (2, 0, 0.005, 2.0)
    ]
    assert "Generate" not in found._jdf.queryExecution().toString()
