"""Spark data source for folders of ``.npy`` vector files.

``spark.read.format("vector_files").load(folder)`` gives one row per vector:
``file_id`` (position of the file in name order), ``file``, ``row_id`` (position in the file) and
``embedding``; for one-dimensional files (scores) ``value`` takes the place of ``embedding``.
A file is read in ranges of rows, each range its own task. Filters on ``file`` and ``file_id`` reach
the reader: other files are not opened. ``file_sizes`` has the number of rows of every file from the
headers alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    Filter,
    InputPartition,
    WriterCommitMessage,
)

from gleaner.functions.vectors import matrix
from gleaner.sources.files import PushedFilters, allow_pushdown, list_files, open_filesystem, resolved
from gleaner.storage import materialize

# Bytes of one read range and rows of one Arrow batch.
RANGE_BYTES = 128 * 1024 * 1024
BATCH_ROWS = 10000
# Rows of one written file.
FILE_ROWS = 100_000


@dataclass
class _Header:
    shape: tuple
    dtype: np.dtype
    offset: int


def _header(system, path: str) -> _Header:
    with system.open_input_file(path) as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
        shape, column_major, dtype = read[version](f)
        if column_major and len(shape) > 1:
            raise ValueError(f"{path}: stored column by column")
        return _Header(shape, dtype, f.tell())


@dataclass
class _Range(InputPartition):
    path: str
    file_id: int
    start: int
    stop: int


class _VectorReader(DataSourceReader):
    def __init__(self, options: dict, flat: bool, wide: bool):
        self.path = options["path"]
        self.flat, self.kind = flat, np.float64 if wide else np.float32
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.filters = PushedFilters(("file", "file_id"), [])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.filters.take(filters)

    def partitions(self) -> list[_Range]:
        system, _ = open_filesystem(self.path)
        ranges, passes = [], self.filters.passes
        for file_id, (path, _) in enumerate(list_files(self.path, ".npy")):
            if not (passes("file_id", file_id) and passes("file", path.rpartition("/")[2])):
                continue
            header = _header(system, path)
            width = header.dtype.itemsize * int(np.prod(header.shape[1:], dtype=np.int64))
            step = max(1, self.range_bytes // max(1, width))
            for start in range(0, header.shape[0], step):
                ranges.append(_Range(path, file_id, start, min(start + step, header.shape[0])))
        return ranges

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        system, _ = open_filesystem(self.path)
        header = _header(system, part.path)
        dim = int(np.prod(header.shape[1:], dtype=np.int64))
        width = header.dtype.itemsize * dim
        name = part.path.rpartition("/")[2]
        with system.open_input_file(part.path) as f:
            for start in range(part.start, part.stop, BATCH_ROWS):
                count = min(BATCH_ROWS, part.stop - start)
                raw = f.read_at(count * width, header.offset + start * width)
                values = np.frombuffer(raw, dtype=header.dtype)
                if self.flat:
                    last, kind = pa.array(values.astype(np.float64)), "value"
                else:
                    if not np.can_cast(values.dtype, self.kind, "same_kind") or values.dtype.itemsize > np.dtype(self.kind).itemsize:
                        raise ValueError(f"{part.path}: vectors of {values.dtype} do not fit 32 bits; read them with wide=True")
                    flat = pa.array(values.astype(self.kind))
                    ends = pa.array(np.arange(count + 1, dtype=np.int32) * dim)
                    last, kind = pa.ListArray.from_arrays(ends, flat), "embedding"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, part.file_id, dtype=np.int32)),
                        pa.array([name] * count),
                        pa.array(np.arange(start, start + count, dtype=np.int64)),
                        last,
                    ],
                    ["file_id", "file", "row_id", kind],
                )


class _VectorWriter(DataSourceArrowWriter):
    """Writes the vectors of a task as files of at most ``rows_per_file`` rows. Files wait in a folder of
    the job until it commits; a task that runs again replaces its own."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.rows_per_file = int(options.get("rows_per_file", FILE_ROWS))
        self.job = f".job-{uuid.uuid4().hex}"

    def _waiting(self):
        system, inner = open_filesystem(self.path)
        return system, inner, f"{inner}/{self.job}"

    def write(self, batches) -> WriterCommitMessage:
        system, _, waiting = self._waiting()
        system.create_dir(waiting, recursive=True)
        task = TaskContext.get().partitionId()
        held, files = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, self.rows_per_file):
                held.append(matrix(batch.column(0).slice(start, self.rows_per_file)))
                while sum(len(h) for h in held) >= self.rows_per_file:
                    rows = np.concatenate(held)
                    self._save(system, waiting, task, files, rows[: self.rows_per_file])
                    held, files = [rows[self.rows_per_file :]], files + 1
        rest = np.concatenate(held) if held else np.empty((0, 0))
        if len(rest):
            self._save(system, waiting, task, files, rest)
        return WriterCommitMessage()

    def _save(self, system, folder: str, task: int, number: int, rows: np.ndarray) -> None:
        name = f"{task:06d}_{number:04d}.npy"
        temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as f:
            np.lib.format.write_array(f, np.ascontiguousarray(rows), allow_pickle=False)
        system.move(temporary, f"{folder}/{name}")

    def commit(self, messages) -> None:
        system, inner, waiting = self._waiting()
        system.create_dir(waiting, recursive=True)
        earlier = {path.rpartition("/")[2]: path for path, _ in list_files(self.path, ".npy")}
        new = [i for i in system.get_file_info(fs.FileSelector(waiting)) if i.base_name.endswith(".npy")]
        clash = [i.base_name for i in new if i.base_name in earlier]
        if clash and not self.overwrite:
            system.delete_dir(waiting)
            raise FileExistsError(f"{self.path} has files of an earlier run: {clash[:3]}; write to another folder or overwrite")
        for i in new:
            system.move(i.path, f"{inner}/{i.base_name}")
        for name in set(earlier) - {i.base_name for i in new} if self.overwrite else ():
            system.delete_file(earlier[name])
        system.delete_dir(waiting)

    def abort(self, messages) -> None:
        system, _, waiting = self._waiting()
        if system.get_file_info(waiting).type == fs.FileType.Directory:
            system.delete_dir(waiting)


class VectorFiles(DataSource):
    """The ``vector_files`` format. Options: ``flat`` (one number per row), ``wide`` (64-bit vectors),
    ``range_bytes``, ``rows_per_file``."""

    @classmethod
    def name(cls) -> str:
        return "vector_files"

    def _flat(self) -> bool:
        return str(self.options.get("flat", "false")).lower() == "true"

    def _wide(self) -> bool:
        return str(self.options.get("wide", "false")).lower() == "true"

    def schema(self) -> str:
        last = "value double" if self._flat() else f"embedding array<{'double' if self._wide() else 'float'}>"
        return f"file_id int, file string, row_id bigint, {last}"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(dict(self.options), self._flat(), self._wide())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _VectorWriter(dict(self.options), overwrite)


def _load(spark: SparkSession, path: str, flat: bool, wide: bool = False) -> DataFrame:
    spark.dataSource.register(VectorFiles)
    allow_pushdown(spark)
    reader = spark.read.format("vector_files").option("flat", str(flat).lower()).option("wide", str(wide).lower())
    return reader.load(resolved(spark, path))


def read_embeddings(spark: SparkSession, path: str, fmt: str = "parquet", wide: bool = False) -> DataFrame:
    """Vectors in name order: parquet tables, or ``.npy`` folders with ``fmt="npy"``, of 64-bit numbers
    with ``wide``; without it such files raise, since half of their digits would be lost."""
    return spark.read.parquet(path) if fmt == "parquet" else _load(spark, path, False, wide)


def read_scores(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scores, one number per row: parquet tables, or ``.npy`` folders with ``fmt="npy"``."""
    return spark.read.parquet(path) if fmt == "parquet" else _load(spark, path, True)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, file, rows, start) of every ``.npy`` file, read from the headers: ``start`` is the
    global position of its first row. The listing is one row per file; headers are read by tasks."""
    root = resolved(spark, path)
    listed = [(i, p) for i, (p, _) in enumerate(list_files(root, ".npy"))]
    files = spark.createDataFrame(listed, "file_id int, path string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_filesystem(root)
        for batch in batches:
            rows = [_header(system, p).shape[0] for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], ["file_id", "path", "rows"])

    counted = files.repartition(min(max(len(listed), 1), 256)).mapInArrow(read, "file_id int, path string, rows bigint")
    earlier = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return materialize(counted, "headers").select(
        "file_id",
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "rows",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"),
    )


def write_embeddings(
    df: DataFrame, path: str, embedding: str = "embedding", rows_per_file: int = FILE_ROWS, mode: str = "append"
) -> None:
    """Write the vectors as ``.npy`` files, in the order and partitions of ``df``.

    Nothing is seen before all of it is there. ``append`` refuses to replace files of an earlier run,
    ``overwrite`` removes them.
    """
    spark = df.sparkSession
    spark.dataSource.register(VectorFiles)
    writer = df.select(embedding).write.format("vector_files").mode(mode)
    writer.option("rows_per_file", rows_per_file).save(resolved(spark, path))
