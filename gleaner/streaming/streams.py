"""Selection of rows as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators import tiles
from gleaner.operators.clustering import assign_clusters, drop_zero_vectors
from gleaner.operators.dedup import max_similarity_to, semdedup_score
from gleaner.operators.dynamics import SCALE
from gleaner.storage import exists, materialize


def stream_filter_coreset(samples: DataFrame, coreset: DataFrame, key: str = "key") -> DataFrame:
    """Arriving samples whose key is in the (static) coreset."""
    return samples.join(coreset.select(key), key, "left_semi")


def stream_assign_clusters(rows: DataFrame, centroids: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Arriving rows with their nearest centroid. Stateless."""
    return assign_clusters(rows, centroids, embedding)


def keep_first_arrivals(
    rows: DataFrame,
    kept: DataFrame | None,
    threshold: float,
    cluster: str = "cluster_id",
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataFrame:
    """The rows of one batch that a reader of ids in ascending order would keep: a row is kept if
    its similarity to every row kept before it, here or in ``kept``, is at most the threshold.

    Each round settles rows by the thousands: a row without any similar earlier row is kept, and
    rows similar to a kept one are dropped. What remains goes to the next round.
    """
    columns = [cluster, identity, embedding]
    rest = drop_zero_vectors(rows.select(columns), embedding)
    if kept is not None:
        near = max_similarity_to(rest, kept.select(columns), cluster, identity, embedding, block_rows)
        rest = rest.join(near.filter(F.col("max_sim") <= threshold), identity, "left_semi")
    rest = materialize(rest, "arrivals")
    found = None
    while not rest.isEmpty():
        scores = semdedup_score(
            rest, F.lit(0.0), cluster, identity, embedding, block_rows=block_rows, floor=threshold
        )
        first = scores.filter(F.col("semdedup_score") <= threshold).select(identity)
        fresh = materialize(rest.join(first, identity, "left_semi").select(columns), "kept")
        found = fresh if found is None else found.unionByName(fresh)
        near = max_similarity_to(rest, fresh, cluster, identity, embedding, block_rows)
        rest = materialize(
            rest.join(near.filter(F.col("max_sim") <= threshold), identity, "left_semi")
            .join(fresh.select(identity), identity, "left_anti")
            .select(columns),
            "arrivals",
        )
    return found if found is not None else rest


def stream_semdedup(
    rows: DataFrame,
    path: str,
    threshold: float,
    cluster: str = "cluster_id",
    identity: str = "id",
    embedding: str = "embedding",
    block_rows: int = tiles.BLOCK_ROWS,
) -> DataStreamWriter:
    """A writer that appends to ``path`` the arriving rows that resemble no row kept before.

    Batches go to folders of their own. A batch that runs again sees only earlier folders and
    overwrites its own, so the result is the same.
    """

    def settle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A batch always leaves a folder, also if it keeps nothing.
        earlier = exists(spark, f"{path}/batch=*/_SUCCESS")
        kept = spark.read.parquet(path).filter(F.col("batch") < batch_id) if earlier else None
        fresh = keep_first_arrivals(batch, kept, threshold, cluster, identity, embedding, block_rows)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(settle)


def stream_uncertainty(history: DataFrame, window: int) -> DataFrame:
    """(sample_id, epoch, uncertainty) after every arriving probability other than 0.

    The state of a sample is its buffer: at most ``window`` numbers. Epochs must arrive in order;
    rows of one trigger are sorted.
    """
    if window < 2:
        raise ValueError("a window needs at least two epochs")

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0]) if state.exists else np.zeros(window)
        rows = pd.concat([b for b in batches if len(b)]).sort_values("epoch")
        rows = rows[rows["prob"] != 0]
        run = np.concatenate([held, rows["prob"].to_numpy(float)])
        buffers = np.lib.stride_tricks.sliding_window_view(run, window)[1:]
        values = SCALE * buffers.std(axis=1, ddof=1)
        state.update((run[-window:].tolist(),))
        yield pd.DataFrame({"sample_id": key[0], "epoch": rows["epoch"], "uncertainty": values})

    return (
        history.select("sample_id", "epoch", "prob")
        .groupBy("sample_id")
        .applyInPandasWithState(
            advance,
            "sample_id bigint, epoch int, uncertainty double",
            "held array<double>",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


LATE_BUCKETS = 4096
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in arrays that are in order."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return new


class _LateEpochs(StatefulProcessor):
    """The values of a bucket's samples that a late epoch can still touch, in order of samples and epochs.

    These are, per sample, the epochs that the watermark has not passed and the ``window - 1`` values before them.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "samples array<bigint>, epochs array<int>, probs array<double>")

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        samples, epochs, probs = self.seen.get() if self.seen.exists() else ([], [], [])
        return np.array(samples, np.int64), np.array(epochs, np.int64), np.array(probs, float)

    def _keep(self, samples: np.ndarray, epochs: np.ndarray, probs: np.ndarray, passed: int) -> None:
        starts = np.flatnonzero(_starts(samples))
        counts = np.diff(np.append(starts, len(samples)))
        settled = np.add.reduceat((epochs < passed).astype(np.int64), starts)
        place = np.arange(len(samples)) - np.repeat(starts, counts)
        left = place > np.repeat(settled, counts) - self.window
        self.seen.update((samples[left].tolist(), epochs[left].tolist(), probs[left].tolist()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([r for r in rows if len(r)])
        fresh = fresh[(fresh["prob"] > 0) & fresh["epoch"].notna()]
        held = self._held()
        samples, epochs, probs = (
            np.concatenate([h, fresh[c].to_numpy(h.dtype)]) for h, c in zip(held, ("sample", "epoch", "prob"), strict=True)
        )
        if not len(samples):
            return
        # Of a sample's rows with one epoch, the last one in this order has the highest probability.
        order = np.lexsort((probs, epochs, samples))
        new = _starts(samples[order], epochs[order])
        was = np.zeros(np.count_nonzero(new))
        old = order < len(held[0])
        was[(np.cumsum(new) - 1)[old]] = probs[order[old]]
        last = order[np.append(np.flatnonzero(new)[1:] - 1, len(order) - 1)]
        samples, epochs, probs = samples[last], epochs[last], probs[last]
        changed = probs > was
        if not changed.any():
            return
        begins = _starts(samples)
        of = np.cumsum(begins) - 1
        since = np.minimum.reduceat(np.where(changed, epochs, np.iinfo(np.int64).max), np.flatnonzero(begins))
        touched = epochs >= since[of]
        # Every sample's values follow ``window - 1`` zeros of their own.
        at = np.arange(len(samples)) + (self.window - 1) * (of + 1)
        padded = np.zeros(at[-1] + 1)
        padded[at] = probs
        buffers = np.lib.stride_tricks.sliding_window_view(padded, self.window)[at[touched] - self.window + 1]
        values = SCALE * buffers.std(axis=1, ddof=1)
        # The watermark is in milliseconds; an epoch is a second, the first one ends at 1.
        self._keep(samples, epochs, probs, timerValues.getCurrentWatermarkInMs() // 1000)
        self.handle.registerTimer((int(epochs.max()) + 1) * 1000)
        yield pd.DataFrame(
            {
                "bucket": np.full(len(values), key[0], np.int32),
                "sample": samples[touched],
                "epoch": epochs[touched].astype("int32"),
                "uncertainty": values,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What no late epoch can touch any more goes, also for a sample that is not seen again."""
        if self.seen.exists():
            self._keep(*self._held(), timerValues.getCurrentWatermarkInMs() // 1000)
        yield pd.DataFrame({"bucket": [], "sample": [], "epoch": [], "uncertainty": []}).astype(
            {"bucket": "int32", "sample": "int64", "epoch": "int32", "uncertainty": "float64"}
        )

    def close(self) -> None:
        pass


def stream_uncertainty_late(history: DataFrame, window: int, lateness: int, buckets: int = LATE_BUCKETS) -> DataFrame:
    """(sample_id, epoch, uncertainty) in update mode, for epochs that arrive in any order.

    A probability that arrives late is put in its place, and the values of its epoch and the later ones
    are sent again; of repeated rows of a sample and epoch the highest probability counts, as in
    ``merge_ranks``. Zeros and nulls change nothing. Epochs more than ``lateness`` behind the highest
    one of the earlier triggers are dropped by the watermark (``numRowsDroppedByWatermark``), and a
    timer takes from a sample's state what they could have touched. A sample has at most ``window - 1``
    values and those of the last ``lateness`` epochs in the state. Epochs count from 0. Needs the RocksDB state store, which is set here.

    Samples share a state by a hash of their id, so a trigger calls Python once per bucket and not once
    per sample. A bucket that has new rows is read and written whole: raise ``buckets`` with the number of
    samples, so that a bucket has some thousands of them at most. It must stay the same for a checkpoint.
    """
    if window < 2 or lateness < 0:
        raise ValueError("a window needs at least two epochs, and lateness cannot be negative")
    history.sparkSession.conf.set(_STORE, _ROCKS)
    at = F.timestamp_seconds(F.col("epoch") + 1)  # a watermark begins at 0, where nothing may lie
    bucket = F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int")
    none = F.col("sample_id").isNull()  # a sample of its own, in the bucket -1
    return (
        history.filter(F.col("prob") != 0)
        .select(
            F.when(none, -1).otherwise(bucket).alias("bucket"),
            F.coalesce("sample_id", F.lit(0)).cast("bigint").alias("sample"),
            "epoch",
            "prob",
            at.alias("at"),
        )
        .withWatermark("at", f"{lateness + 1} seconds")
        .groupBy("bucket")
        .transformWithStateInPandas(
            _LateEpochs(window),
            "bucket int, sample bigint, epoch int, uncertainty double",
            outputMode="Update",
            timeMode="EventTime",
        )
        .select(F.when(F.col("bucket") >= 0, F.col("sample")).alias("sample_id"), "epoch", "uncertainty")
    )


def write_updates(values: DataFrame, path: str) -> DataStreamWriter:
    """A writer of a stream of updates: a folder per batch, which a batch that runs again overwrites."""

    def settle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return values.writeStream.outputMode("update").foreachBatch(settle)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every key in the folders of ``write_updates``."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), "batch").alias("_last")
    return updates.groupBy(*keys).agg(newest).select(*keys, "_last.*")
