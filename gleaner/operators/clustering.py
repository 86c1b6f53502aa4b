"""k-means training, assignment to centroids and geometry relative to a centroid."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.keys import seeded_hash
from gleaner.functions.vectors import COMPARE_DECIMALS, COMPARE_STEP, is_zero_vector, matrix
from gleaner.operators.ranking import row_index
from gleaner.operators.sampling import sample_files
from gleaner.sources.files import list_files, resolved
from gleaner.sources.vectors import read_embeddings
from gleaner.storage import exists, materialize, scratch_path

# Centroids a worker holds at one time. A larger table goes out in blocks, which a task visits in turn.
BROADCAST_BYTES = 256 * 1024 * 1024
# Rows that a task compares with one block after the other.
CHUNK_ROWS = 32768
# Sums of vectors held by a task before they are handed on.
PARTIAL_BYTES = 64 * 1024 * 1024
# Entries of a distance matrix held at one time (64 MB of doubles).
STRIP_ENTRIES = 8_000_000


def zero_vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows without direction. They are dropped by the operators below; report them from here."""
    return df.filter(is_zero_vector(embedding))


def drop_zero_vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.filter(~is_zero_vector(embedding))


# --- means ----------------------------------------------------------------------------------


class _Sums:
    """Counts and sums of vectors per group, and how many bytes they take."""

    def __init__(self):
        self.held: dict = {}
        self.bytes = 0

    def add(self, groups: pa.Array, rows: np.ndarray) -> None:
        coded = groups.dictionary_encode("encode")
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        sums = np.add.reduceat(rows[order].astype(np.float64), starts, axis=0)
        counts = np.diff(np.append(starts, len(order))).tolist()
        for group, n, total in zip(coded.dictionary.to_pylist(), counts, sums, strict=True):
            self.merge(group, n, total)

    def merge(self, group, n: int, total: np.ndarray) -> None:
        if group in self.held:
            self.held[group][0] += n
            self.held[group][1] += total
        else:
            self.held[group] = [n, total.copy()]
            self.bytes += total.nbytes + 200

    def take(self, kind: pa.DataType) -> tuple[pa.Array, pa.Array, pa.Array] | None:
        """(groups, counts, sums), which are forgotten here."""
        if not self.held:
            return None
        groups = pa.array(list(self.held), kind)
        counts = pa.array([n for n, _ in self.held.values()], pa.int64())
        sums = np.stack([t for _, t in self.held.values()])
        ends = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
        self.__init__()
        return groups, counts, pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))


def _partial(sums: _Sums, kind: pa.DataType, run: int) -> pa.RecordBatch | None:
    found = sums.take(kind)
    if found is None:
        return None
    place = (TaskContext.get().partitionId() << 20) + run
    order = pa.array(np.full(len(found[0]), place, dtype=np.int64))
    return pa.RecordBatch.from_arrays([found[0], order, *found[1:]], ["group", "run", "n", "total"])


def _merged_means(partial: DataFrame, group: str, name: str) -> DataFrame:
    """Means from partial sums, which are added up in the order of the tasks they come from."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, last = _Sums(), None

        def means(kind: pa.DataType) -> pa.RecordBatch:
            groups, counts, totals = sums.take(kind)
            rows = matrix(totals) / counts.to_numpy()[:, None]
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            return pa.RecordBatch.from_arrays([groups, pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], [group, name])

        for batch in batches:
            kind = batch.column(0).type
            for g, n, total in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), matrix(batch.column(3)), strict=True):
                if sums.bytes > PARTIAL_BYTES and g != last:
                    yield means(kind)
                sums.merge(g, n, total)
                last = g
        if sums.held:
            yield means(kind)

    n = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial.repartition(n, "group").sortWithinPartitions("group", "run")
    return dealt.mapInArrow(merge, f"`{group}` {partial.schema['group'].dataType.simpleString()}, `{name}` array<double>")


def mean_vectors(df: DataFrame, group: str, embedding: str, name: str = "centroid") -> DataFrame:
    """Element-wise mean per group. A task adds up what it reads, in bounded memory, and sends one
    partial sum per group."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, run, kind = _Sums(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            sums.add(batch.column(0), matrix(batch.column(1)))
            if sums.bytes > PARTIAL_BYTES:
                yield _partial(sums, kind, run)
                run += 1
        if sums.held:
            yield _partial(sums, kind, run)

    vectors = df.select(group, embedding).filter(F.col(embedding).isNotNull())
    kind = df.schema[group].dataType.simpleString()
    return _merged_means(vectors.mapInArrow(add, f"group {kind}, run bigint, n bigint, total array<double>"), group, name)


# --- centroids ------------------------------------------------------------------------------


class _Block:
    """Centroids in id order, as a matrix on the driver, no larger than the broadcast bound."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("cluster_id").to_numpy().astype(np.int64)
        self.matrix = matrix(rows.column("centroid")).astype(np.float64)
        self.squares = np.einsum("ij,ij->i", self.matrix, self.matrix)


class _Index:
    """A block's centroids in groups: each lies nearest to the pivot of its group, and no farther
    from it than the group's radius."""

    def __init__(self, block: _Block):
        n = len(block.ids)
        count = max(1, round(n**0.5))
        self.pivots = block.matrix[np.arange(count) * n // count]
        pivot_squares = np.einsum("ij,ij->i", self.pivots, self.pivots)
        group = np.empty(n, np.int64)
        step = max(1, STRIP_ENTRIES // count)
        for a in range(0, n, step):
            group[a : a + step] = (pivot_squares - 2 * (block.matrix[a : a + step] @ self.pivots.T)).argmin(axis=1)
        order = np.argsort(group, kind="stable")
        self.ids, self.squares = block.ids[order], block.squares[order]
        self.extended = np.column_stack([block.matrix[order], self.squares])
        self.matrix = self.extended[:, :-1]
        self.bounds = np.searchsorted(group[order], np.arange(count + 1))
        apart = np.sqrt(np.einsum("ij,ij->i", self.matrix - self.pivots[group[order]], self.matrix - self.pivots[group[order]]))
        self.radius = np.zeros(count)
        np.maximum.at(self.radius, group[order], apart)
        self.lengths = np.sqrt(pivot_squares)
        self.largest = np.zeros(count)
        np.maximum.at(self.largest, group[order], self.squares)


# A bound on the error of a squared distance taken from products, relative to the squared lengths, and
# of the distance itself near zero.
_SQUARE_ERROR = 1e-11
_LENGTH_ERROR = 1e-5


class _Nearest:
    """The nearest centroid so far of each of some rows, by rounded distance, ties to the lower id."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.squares = np.einsum("ij,ij->i", rows, rows)
        self.doubled = np.column_stack([-2.0 * rows, np.ones(len(rows))])
        self.distance = np.full(len(rows), np.inf)
        self.cosine = np.zeros(len(rows))
        self.ids = np.full(len(rows), -1, np.int64)

    def visit(self, index: _Index) -> None:
        """Every group of a block that the triangle inequality does not rule out."""
        square = self.squares[:, None] + np.einsum("ij,ij->i", index.pivots, index.pivots) - 2 * (self.rows @ index.pivots.T)
        to_pivot = np.sqrt(np.maximum(square, 0))
        own = to_pivot.argmin(axis=1)
        for g in range(len(index.pivots)):
            self._compare(np.flatnonzero(own == g), index, g)
        lengths = np.sqrt(self.squares)
        for g in range(len(index.pivots)):
            slack = _LENGTH_ERROR * (lengths + index.lengths[g])
            near = to_pivot[:, g] - index.radius[g] <= self.distance + slack
            self._compare(np.flatnonzero(near & (own != g)), index, g)

    def _compare(self, at: np.ndarray, index: _Index, g: int) -> None:
        a, b = index.bounds[g], index.bounds[g + 1]
        if a == b:
            return
        step = max(1, STRIP_ENTRIES // (b - a))
        for start in range(0, len(at), step):
            here = at[start : start + step]
            # The square of the distance without that of the row, as one product.
            part = self.doubled[here] @ index.extended[a:b].T
            least = part.min(axis=1)
            best = np.minimum(least + self.squares[here], self.distance[here] ** 2)
            error = _SQUARE_ERROR * (self.squares[here] + index.largest[g]) + 4 * COMPARE_STEP * np.sqrt(np.maximum(best, 0))
            bar = best + error - self.squares[here]
            open_ = np.flatnonzero(least <= bar)
            row, place = np.nonzero(part[open_] <= bar[open_, None])
            row = open_[row]
            width = max(1, STRIP_ENTRIES // max(1, self.rows.shape[1]))
            for i in range(0, len(row), width):
                self._settle(here[row[i : i + width]], place[i : i + width] + a, index)

    def _settle(self, row: np.ndarray, place: np.ndarray, index: _Index) -> None:
        """Direct distances of the pairs that products cannot tell apart from the nearest."""
        apart = self.rows[row] - index.matrix[place]
        distance = np.round(np.sqrt(np.einsum("ij,ij->i", apart, apart)), COMPARE_DECIMALS)
        order = np.lexsort((index.ids[place], distance, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        row, place, distance = row[first], place[first], distance[first]
        closer = (distance < self.distance[row]) | ((distance == self.distance[row]) & (index.ids[place] < self.ids[row]))
        row, place = row[closer], place[closer]
        self.distance[row], self.ids[row] = distance[closer], index.ids[place]
        lengths = np.sqrt(self.squares[row] * index.squares[place])
        lengths[lengths == 0] = 1.0
        cosine = np.einsum("ij,ij->i", self.rows[row], index.matrix[place]) / lengths
        self.cosine[row] = np.round(cosine, COMPARE_DECIMALS)


class _Shared:
    """The centroids of a table as broadcast blocks."""

    def __init__(self, centroids: DataFrame, limit: int):
        context = centroids.sparkSession.sparkContext
        self.blocks = [context.broadcast(_Index(block)) for block in centroid_blocks(centroids, limit)]

    def nearest(self, rows: np.ndarray) -> _Nearest:
        found = _Nearest(rows.astype(np.float64))
        for block in self.blocks:
            found.visit(block.value)
            if len(self.blocks) > 1:
                vars(block).pop("_value", None)  # one block in memory at a time; the next use loads it anew
        return found


@contextmanager
def shared_centroids(centroids: DataFrame, limit: int = BROADCAST_BYTES):
    """Broadcast centroids that are given back at the end; use them in finished actions only."""
    shared = _Shared(centroids, limit)
    try:
        yield shared
    finally:
        for block in shared.blocks:
            block.destroy()


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches put together to about ``CHUNK_ROWS`` rows, with their vectors."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield _together(held, column)
            held, rows = [], 0
    if rows:
        yield _together(held, column)


def _together(held: list[pa.RecordBatch], column: str) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return batch, matrix(batch.column(column))


def centroid_blocks(centroids: DataFrame, limit: int) -> Iterator[_Block]:
    """The centroid table in blocks of bounded size, in id order."""
    shape = centroids.agg(
        F.count(F.lit(1)).alias("k"), F.max(F.size("centroid")).alias("dim")
    ).first()
    if not shape["k"]:
        raise ValueError("no centroids")
    per_block = max(1, limit // (shape["dim"] * 8))
    table = centroids.select("cluster_id", F.col("centroid").cast("array<double>").alias("centroid"))
    low = None
    for _ in range(0, shape["k"], per_block):
        rest = table if low is None else table.filter(F.col("cluster_id") > F.lit(low))
        block = _Block(rest.orderBy("cluster_id").limit(per_block).toArrow())
        low = int(block.ids[-1])
        yield block


def _with_fields(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {name for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType(kept + [T.StructField(name, kind) for name, kind in fields])


def _append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in columns]
    arrays = [batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays(arrays + list(columns.values()), names + list(columns))


def assign_clusters(
    df: DataFrame,
    centroids: DataFrame,
    embedding: str = "embedding",
    limit: int = BROADCAST_BYTES,
    geometry: bool = True,
) -> DataFrame:
    """``df`` with the nearest centroid of each row by Euclidean distance, ties to the lower id.

    Adds ``cluster_id`` and, with ``geometry``, ``centroid_dist`` (to the raw centroid) and
    ``centroid_cosine`` (to the normalised one). A map over Arrow batches: no shuffle, and nothing is
    written however many centroids there are. Select the columns you need first.

    Centroids are indexed by pivots; groups farther away than the nearest centroid found are skipped.
    Distances that products cannot tell apart are taken directly and compared at 9 decimals, so the
    result does not depend on blocks, groups or batches.
    """
    shared = _Shared(centroids, limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _chunks(batches, embedding):
            found = shared.nearest(rows)
            columns = {"cluster_id": pa.array(found.ids.astype(np.int32))}
            if geometry:
                columns |= {"centroid_dist": pa.array(found.distance), "centroid_cosine": pa.array(found.cosine)}
            yield _append(batch, columns)

    fields = [("cluster_id", T.IntegerType())]
    if geometry:
        fields += [("centroid_dist", T.DoubleType()), ("centroid_cosine", T.DoubleType())]
    return drop_zero_vectors(df, embedding).mapInArrow(work, _with_fields(df, fields))


def _geometry(rows: np.ndarray, centres: np.ndarray, lengths: np.ndarray, place: np.ndarray):
    """Distance and cosine of each row to the centroid at ``place``, by direct differences."""
    distance = np.empty(len(rows))
    cosine = np.empty(len(rows))
    step = max(1, STRIP_ENTRIES // max(1, rows.shape[1]))
    for start in range(0, len(rows), step):
        strip = rows[start : start + step].astype(np.float64)
        own = centres[place[start : start + step]]
        apart = strip - own
        distance[start : start + step] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        norms = np.sqrt(np.einsum("ij,ij->i", strip, strip)) * lengths[place[start : start + step]]
        norms[norms == 0] = 1.0
        cosine[start : start + step] = np.einsum("ij,ij->i", strip, own) / norms
    return np.round(distance, COMPARE_DECIMALS), np.round(cosine, COMPARE_DECIMALS)


def centroid_geometry(
    df: DataFrame,
    centroids: DataFrame,
    cluster: str = "cluster_id",
    embedding: str = "embedding",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` with ``centroid_dist`` and ``centroid_cosine`` to the centroid of its own cluster.

    Rows whose cluster has no centroid are dropped, as in an inner join.
    """
    results = None
    for block in centroid_blocks(centroids, limit):
        # One block holds a range of cluster ids; its rows are found by a filter on that range.
        part = df.filter(F.col(cluster).between(int(block.ids[0]), int(block.ids[-1])))
        measured = _own_geometry(part, block, cluster, embedding)
        results = measured if results is None else results.unionByName(measured)
    return results


def _own_geometry(df: DataFrame, block: _Block, cluster: str, embedding: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((block.ids, block.matrix, block.squares))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres, squares = shared.value
        lengths = np.sqrt(squares)
        for batch in batches:
            own = batch.column(cluster).to_numpy()
            place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            known = ids[place] == own
            batch = batch.filter(pa.array(known))
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(embedding))
            distance, cosine = _geometry(rows, centres, lengths, place[known])
            yield _append(
                batch, {"centroid_dist": pa.array(distance), "centroid_cosine": pa.array(cosine)}
            )

    schema = _with_fields(df, [("centroid_dist", T.DoubleType()), ("centroid_cosine", T.DoubleType())])
    return drop_zero_vectors(df, embedding).mapInArrow(work, schema)


def initial_centroids(
    df: DataFrame, k: int, identity: str, embedding: str = "embedding", seed: int = 0
) -> DataFrame:
    """``k`` rows by seeded hash order, as (cluster_id, centroid)."""
    usable = drop_zero_vectors(df, embedding)
    chosen = (
        usable.select(identity, seeded_hash(identity, seed).alias("_hash"))
        .orderBy("_hash", identity)
        .limit(k)
    )
    numbered = materialize(row_index(chosen, [F.col("_hash"), F.col(identity)], "_row"), "initial")
    found = numbered.count()
    if found < k:
        raise ValueError(f"asked for {k} centroids, found {found} usable rows")
    return usable.join(numbered, identity).select(
        F.col("_row").cast("int").alias("cluster_id"),
        F.col(embedding).cast("array<double>").alias("centroid"),
    )


def lloyd_step(df: DataFrame, centroids: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One round of k-means, written: assign, then average. A cluster without rows keeps its centroid.

    A task assigns the rows it reads and adds them up at once; only sums leave it.
    """
    with shared_centroids(centroids) as shared:

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, run = _Sums(), 0
            for _, rows in _chunks(batches, embedding):
                sums.add(pa.array(shared.nearest(rows).ids.astype(np.int32)), rows)
                if sums.bytes > PARTIAL_BYTES:
                    yield _partial(sums, pa.int32(), run)
                    run += 1
            if sums.held:
                yield _partial(sums, pa.int32(), run)

        vectors = drop_zero_vectors(df.select(embedding), embedding)
        partial = vectors.mapInArrow(add, "group int, run bigint, n bigint, total array<double>")
        means = _merged_means(partial, "cluster_id", "_mean")
        return materialize(
            centroids.join(means, "cluster_id", "left").select(
                "cluster_id", F.coalesce("_mean", "centroid").alias("centroid")
            ),
            "lloyd",
        )


def train_kmeans(
    df: DataFrame,
    k: int,
    epochs: int,
    iterations: int,
    identity: str,
    embedding: str = "embedding",
    file: str | None = None,
    files_per_epoch: int | None = None,
    seed: int = 0,
    start: DataFrame | None = None,
    path: str | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """Warm-started k-means in epochs; each epoch sees a fresh sample of files.

    Files are drawn from ``files``, a small table with the column ``file``, or else from ``df``. The
    rows of an epoch's files are read once and written; the steps of the epoch read that table. If no
    centroids are given, the first ones come from the first epoch's rows. The centroids of every epoch are written under ``path`` (by default in the shared folder), and
    training goes on after the last epoch found there.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "centroids")
    done, centroids = _last_epoch(spark, path, epochs)
    centroids = start if centroids is None else centroids
    for epoch in range(done, epochs):
        sample = df
        if file and files_per_epoch:
            chosen = sample_files(files if files is not None else df, file, files_per_epoch, seed, epoch)
            names = [r[0] for r in chosen.collect()]  # as many as files_per_epoch
            sample = materialize(df.filter(F.col(file).isin(names)).select(identity, embedding), "sample")
        if centroids is None:
            centroids = materialize(initial_centroids(sample, k, identity, embedding, seed), "start")
        for _ in range(iterations):
            centroids = lloyd_step(sample, centroids, embedding)
        centroids.write.mode("overwrite").parquet(f"{path}/epoch={epoch:05d}")
        centroids = spark.read.parquet(f"{path}/epoch={epoch:05d}")
    return centroids.select("cluster_id", "centroid")


def train_kmeans_on_files(
    spark: SparkSession, path: str, k: int, epochs: int, iterations: int, files_per_epoch: int, seed: int = 0, out: str | None = None
) -> DataFrame:
    """``train_kmeans`` on a folder of ``.npy`` files, whose names come from the listing: only the
    files drawn for an epoch are opened, once each. Rows are known by file name and position."""
    rows = read_embeddings(spark, path, "npy").withColumn("row", F.concat_ws("/", "file", "row_id"))
    listed = [(p.rpartition("/")[2],) for p, _ in list_files(resolved(spark, path), ".npy")]
    names = spark.createDataFrame(listed, "file string")
    return train_kmeans(rows, k, epochs, iterations, "row", file="file", files_per_epoch=files_per_epoch, seed=seed, path=out, files=names)


def _last_epoch(spark: SparkSession, path: str, epochs: int):
    """The number of epochs already finished under ``path`` and the last centroids."""
    for epoch in range(epochs - 1, -1, -1):
        if exists(spark, f"{path}/epoch={epoch:05d}/_SUCCESS"):
            return epoch + 1, spark.read.parquet(f"{path}/epoch={epoch:05d}")
    return 0, None
