import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import dynamics, evaluation
from gleaner.streaming import streams


def history(spark, probs):
    return spark.createDataFrame(
        [(e, s, float(p)) for s, ps in enumerate(probs) for e, p in enumerate(ps)],
        "epoch int, sample_id bigint, prob double",
    )


def brute(probs, window):
    """The definition, epoch by epoch."""
    epochs = len(probs[0])
    result = []
    for ps in probs:
        buffer, found = [0.0] * window, []
        for e, p in enumerate(ps):
            if p != 0:
                buffer = buffer[1:] + [p]
            if window - 1 <= e < epochs - 1:
                found.append(10 * np.std(buffer, ddof=1))
        result.append(float(np.mean(found)))
    return result


def test_by_hand(spark):
    df = history(spark, [[0.2, 0.4, 0.4, 0.9], [0.5, 0, 0.7, 0.9]])
    found = {r["sample_id"]: round(r["dynamic_uncertainty"], 6) for r in dynamics.dynamic_uncertainty(df, 2).collect()}
    assert found == {0: 0.707107, 1: 2.474874}
    files = spark.createDataFrame([(0, "/a", 0), (1, "/b", 0)], "sample_id bigint, path string, label int")
    kept = dynamics.prune_by_uncertainty(files, df, 2, 0.5).collect()
    assert [r["sample_id"] for r in kept] == [1]


@pytest.mark.parametrize("window", [2, 4])
def test_against_the_definition(spark, window):
    r = np.random.default_rng(window)
    probs = np.round(r.random((40, 9)), 3)
    probs[r.random((40, 9)) < 0.4] = 0
    probs[3] = 0  # never seen
    df = history(spark, probs.tolist())
    found = dynamics.dynamic_uncertainty(df, window).orderBy("sample_id").collect()
    assert np.allclose([x["dynamic_uncertainty"] for x in found], brute(probs.tolist(), window))
    # Rows with probability 0 say nothing that the list of epochs does not.
    sparse = dynamics.dynamic_uncertainty(df.filter("prob <> 0"), window, df.select("epoch")).orderBy("sample_id").collect()
    assert np.allclose(
        [x["dynamic_uncertainty"] for x in sparse],
        [b for i, b in enumerate(brute(probs.tolist(), window)) if probs[i].any()],
    )


def test_equal_probabilities_have_no_uncertainty(spark):
    df = history(spark, [[0.1] * 8])
    assert dynamics.window_uncertainty(df, 3).filter("epoch >= 2").agg(F.max("uncertainty")).first()[0] < 1e-12


def test_short_windows_and_histories_are_refused(spark):
    df = history(spark, [[0.1, 0.2, 0.3]])
    with pytest.raises(ValueError):
        dynamics.dynamic_uncertainty(df, 1)
    with pytest.raises(ValueError):
        dynamics.dynamic_uncertainty(df, 3)


def test_stream_keeps_its_buffer_between_batches(spark, tmp_path):
    probs = [[0.2, 0.4, 0, 0.9, 0.3], [0.5, 0, 0.7, 0.9, 0.1]]
    df = history(spark, probs)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for e in range(5):
        df.filter(F.col("epoch") == e).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = (
        streams.stream_uncertainty(arriving, 3)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", str(tmp_path / "log"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    batch = dynamics.window_uncertainty(df, 3).select("sample_id", "epoch", F.round("uncertainty", 9))
    found = spark.read.parquet(target).select("sample_id", "epoch", F.round("uncertainty", 9))
    assert found.count() == 8 and found.exceptAll(batch).isEmpty()


def _run_late(arriving, tmp_path, lateness):
    run = (
        streams.write_updates(streams.stream_uncertainty_late(arriving, 3, lateness), str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "log"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return run


def test_late_epochs_are_put_in_their_place(spark, tmp_path):
    """Epochs in shuffled order, a repeated row, a restart in between: what the batch gives."""
    rng = np.random.default_rng(3)
    probs = np.round(rng.random((12, 10)) * (rng.random((12, 10)) < 0.7), 3).tolist()
    df = history(spark, probs)
    source = str(tmp_path / "in")

    def put(epoch):
        df.filter(F.col("epoch") == epoch).coalesce(1).write.mode("append").parquet(source)

    epochs = df.select("epoch").distinct().count()
    order = [2, 0, 1, 5, 3, 7, 4, 6, *range(8, epochs)]
    for e in order[:5]:
        put(e)
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    _run_late(arriving, tmp_path, 4)
    for e in [*order[5:], order[-1]]:
        put(e)
    _run_late(arriving, tmp_path, 4)
    found = streams.latest(spark.read.parquet(str(tmp_path / "out")), ["sample_id", "epoch"])
    want = dynamics.window_uncertainty(df, 3).select("sample_id", "epoch", F.round("uncertainty", 9))
    found = found.select("sample_id", "epoch", F.round("uncertainty", 9))
    assert found.count() == want.count() and found.exceptAll(want).isEmpty()


def test_samples_share_calls_to_the_state(spark, tmp_path, monkeypatch):
    """One call per bucket and trigger, whatever the number of samples; a null id is a sample of its own."""
    rng = np.random.default_rng(5)
    probs = np.round(rng.random((9, 40)) * (rng.random((9, 40)) < 0.7), 3)
    rows = [(e, None if s == 7 else s * 10**16 + 1, float(probs[e, s])) for e in range(9) for s in range(40)]
    df = spark.createDataFrame(rows, "epoch int, sample_id bigint, prob double")
    source = str(tmp_path / "in")
    for part in ([3, 0, 8], [1, 7, 2], [6, 5, 4]):
        df.filter(F.col("epoch").isin(part)).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    late = streams.stream_uncertainty_late
    monkeypatch.setattr(streams, "stream_uncertainty_late", lambda *args: late(*args, buckets=3))
    run = _run_late(arriving, tmp_path, 8)
    held = max(o.numRowsTotal for p in run.recentProgress for o in p.stateOperators)
    found = streams.latest(spark.read.parquet(str(tmp_path / "out")), ["sample_id", "epoch"]).collect()
    want = {}
    for s in range(40):
        seen = [0.0, 0.0]
        for e in range(9):
            if probs[e, s]:
                seen.append(float(probs[e, s]))
                want[None if s == 7 else s * 10**16 + 1, e] = 10 * np.std(seen[-3:], ddof=1)
    got = {(r.sample_id, r.epoch): r.uncertainty for r in found}
    assert len(found) == len(want) and got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert held < 40  # one state and its timers per bucket


def test_epochs_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    source = str(tmp_path / "in")
    for e in (0, 9, 10, 1, 11):
        rows = spark.createDataFrame([(e, 1, 0.5 + e / 100)], "epoch int, sample_id bigint, prob double")
        rows.coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = _run_late(arriving, tmp_path, 2)
    dropped = sum(o.numRowsDroppedByWatermark for p in run.recentProgress for o in p.stateOperators)
    found = streams.latest(spark.read.parquet(str(tmp_path / "out")), ["sample_id", "epoch"]).collect()
    assert dropped == 1
    values = {r["epoch"]: r["uncertainty"] for r in found}
    assert sorted(values) == [0, 9, 10, 11]
    assert abs(values[11] - 10 * np.std([0.59, 0.6, 0.61], ddof=1)) < 1e-9


def test_uncertainty_takes_one_shuffle_by_sample(spark):
    rows = [(e, s, ((e * 7 + s * 3) % 10) / 10) for e in range(12) for s in range(20)]
    df = spark.createDataFrame(rows, "epoch int, sample_id bigint, prob double")
    found = dynamics.dynamic_uncertainty(df, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sample_id") == 1
    for r in found.collect():
        seen = [p for _, s, p in sorted(rows) if s == r["sample_id"]]
        held, values = [0.0] * 3, []
        for e, p in enumerate(seen):
            held = (held + [p])[-3:] if p else held
            if 2 <= e <= 10:
                values.append(10 * np.std(held, ddof=1))
        assert abs(r["dynamic_uncertainty"] - np.mean(values)) < 1e-8


def test_places_of_labels(spark):
    rows = [([3.0, 5.0, 5.0, 1.0], 2), ([3.0, 5.0, 5.0, 1.0], 1), ([9.0, 5.0, 5.0, 1.0], 3), ([1.0], 7), ([1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "logits array<double>, label int")
    assert evaluation.topk_accuracy(df, ks=(1, 2, 4)).first().asDict() == {"top1": 0.25, "top2": 0.5, "top4": 0.75}
