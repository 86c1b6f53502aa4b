"""Ranks of partners, counted in both directions by one comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluation, tiles


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_both_directions_come_from_one_comparison(spark, monkeypatch, block_rows):
    """Also with ids that repeat, are null or stand on one side only."""
    r = np.random.default_rng(4)
    sides = [([*range(20), 3, 3, None, None, 50], 0), ([*range(20), 3, 5, None, 60], 1)]
    rows = {s: [(i, v.tolist()) for i, v in zip(ids, r.normal(size=(len(ids), 6)), strict=True)] for ids, s in sides}
    images, texts = (spark.createDataFrame(rows[s], "id bigint, embedding array<double>") for s in (0, 1))
    calls = []
    whole = tiles.cross_tiles
    monkeypatch.setattr(tiles, "cross_tiles", lambda *a: (calls.append(1), whole(*a))[1])
    found = evaluation.retrieval_metrics(images, texts, block_rows=block_rows).collect()
    assert len(calls) == 1

    def ranks(own, other):
        unit = {s: [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows[s]] for s in (own, other)}
        total = {}
        for i, v in unit[own]:
            for j, w in unit[other]:
                if i is not None and i == j:
                    total[i] = total.get(i, 1) + sum(round(float(v @ x), 9) > round(float(v @ w), 9) for _, x in unit[other])
        return total

    for s, row in enumerate(found):
        want = ranks(s, 1 - s)
        assert row["mean_rank"] == pytest.approx(np.mean(list(want.values())))
        assert row["recall_5"] == pytest.approx(np.mean([k <= 5 for k in want.values()]))
    single = evaluation.partner_ranks(images, texts, block_rows=block_rows).select("id", F.col("partner_rank"))
    assert {row["id"]: row["partner_rank"] for row in single.collect()} == ranks(0, 1)
