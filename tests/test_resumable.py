"""Runs that end early and go on; tables aligned by position; small files written whole."""

import numpy as np
import pytest

from gleaner.operators import clustering
from gleaner.plans import coresets, resumable
from gleaner.sources import tables, vectors
from gleaner.storage import read_text, write_once


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    around = r.normal(size=(30, 8))
    data = [(i, (around[i % 30] + 0.2 * r.normal(size=8)).tolist(), float(r.random())) for i in range(400)]
    return spark.createDataFrame(data, "id bigint, embedding array<double>, clip_score double")


@pytest.fixture(scope="module")
def centroids(spark, rows):
    return clustering.initial_centroids(rows, 6, "id").cache()


def found(df):
    return sorted(tuple(r) for r in df.select("id", "cluster_id").collect())


def test_a_broken_run_gives_the_same_rows(spark, rows, centroids, tmp_path, monkeypatch):
    whole = found(coresets.score_coreset(rows, centroids, 0.9))
    path = str(tmp_path / "run")
    real, calls = resumable.score_table, []

    def breaks(part, *args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the machine went away")
        return real(part, *args, **kwargs)

    monkeypatch.setattr(resumable, "score_table", breaks)
    with pytest.raises(RuntimeError):
        resumable.score_coreset(rows, centroids, path, 0.9, batches=5)
    assert len(resumable.finished_batches(spark, path, 5)) == 2
    # A result without its manifest entry is not trusted.
    (tmp_path / "run" / "result" / "batch=2").mkdir()
    monkeypatch.setattr(resumable, "score_table", real)
    again = []
    monkeypatch.setattr(resumable, "assign_clusters", lambda *a: again.append(a))
    assert found(resumable.score_coreset(rows, centroids, path, 0.9, batches=5)) == whole
    assert not again  # the assigned rows were there
    assert found(resumable.score_coreset(rows, centroids, path, 0.8, batches=5)) == found(coresets.score_coreset(rows, centroids, 0.8))


def test_other_settings_are_refused(spark, rows, centroids, tmp_path):
    path = str(tmp_path / "run")
    assert resumable.graph_coreset(rows, centroids, path, 0.9, batches=4, most=1) is None
    for other in ({"threshold": 0.8}, {"batches": 5}, {"exclude": [2]}, {"pick": "far"}):
        with pytest.raises(ValueError, match="other settings"):
            resumable.graph_coreset(rows, centroids, path, **({"threshold": 0.9, "batches": 4} | other))
    whole = found(coresets.graph_coreset(rows, centroids, 0.9))
    assert found(resumable.graph_coreset(rows, centroids, path, 0.9, batches=4)) == whole


def test_excluded_clusters_are_not_compared(spark, rows, centroids, tmp_path):
    whole = found(coresets.score_coreset(rows, centroids, 0.9))
    for i, out in enumerate([[0, 4], spark.createDataFrame([(0,), (4,), (4,)], "cluster_id int")]):
        kept = resumable.score_coreset(rows, centroids, str(tmp_path / str(i)), 0.9, exclude=out, batches=3)
        assert found(kept) == [r for r in whole if r[1] not in (0, 4)]


def test_no_rows(spark, rows, centroids, tmp_path):
    assert resumable.score_coreset(rows.limit(0), centroids, str(tmp_path / "run"), 0.9, batches=2).count() == 0


def test_small_files_are_whole_and_stay(spark, tmp_path):
    name = str(tmp_path / "a" / "b.json")
    assert read_text(spark, name) is None
    write_once(spark, name, "é one")
    write_once(spark, name, "two")
    assert read_text(spark, name) == "é one"
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["b.json"]


def test_files_of_different_lengths_raise(spark, tmp_path):
    for name, lengths in (("v", (4, 3)), ("s", (4, 3)), ("t", (4, 2)), ("u", (4, 3, 1))):
        (tmp_path / name).mkdir()
        for i, n in enumerate(lengths):
            shape = (n, 2) if name == "v" else n
            np.save(tmp_path / name / f"{name}{i}.npy", np.arange(n * (2 if name == "v" else 1), dtype=np.float32).reshape(shape))
    v = vectors.read_embeddings(spark, str(tmp_path / "v"), "npy").drop("file")
    scores = {n: vectors.read_scores(spark, str(tmp_path / n), "npy").drop("file") for n in "stu"}
    joined = tables.align_by_position(v=v, s=scores["s"]).orderBy("file_id", "row_id").collect()
    assert [(r.embedding[0], r.value) for r in joined] == [(2.0 * i, float(i)) for n in (4, 3) for i in range(n)]
    for name in "tu":
        with pytest.raises(ValueError, match="different lengths"):
            tables.align_by_position(v=v, s=scores[name])
